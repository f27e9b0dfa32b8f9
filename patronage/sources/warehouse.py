"""Reading the donor warehouse and writing the extract."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fv

# Logical table -> the columns the operators read (DDL).  Keys are bigint.
SCHEMAS: dict[str, str] = {
    "constituent": (
        "constituent_dim_id bigint, constituent_id string, constituent_system_id bigint, "
        "household_system_id bigint, spouse_constituent_system_id bigint, key_indicator string, "
        "is_deceased string, is_inactive string, is_a_constituent string, no_valid_address string, "
        "send_mail string, title string, first_name string, surname string, nickname string, "
        "suffix string, salutation string, addressee string, full_name string, address1 string, "
        "address2 string, address3 string, address4 string, address5 string, city string, "
        "state string, post_code string, country string, email_address string"
    ),
    "comprehensive_giving": (
        "cg_fact_id bigint, gift_fact_id bigint, constituent_dim_id bigint, amount decimal(19,4), "
        "fund string, gift_fiscal_year int, gift_type string, gift_date timestamp_ntz"
    ),
    "gift_credit": "gift_fact_id bigint, is_ag_gift string, appeal_identifier string",
    "gift": (
        "gift_fact_id bigint, gift_system_id bigint, gift_type_dim_id int, gift_date_dim_id int, "
        "fund_dim_id bigint, appeal_dim_id bigint, constituent_dim_id bigint, "
        "planned_gift_id bigint, gift_date timestamp_ntz, amount decimal(19,4)"
    ),
    "gift_type": "gift_type_dim_id int, gift_type string",
    "gift_attribute": "gift_fact_id bigint, attribute_category string",
    "gift_commitment": (
        "gift_fact_id bigint, amount decimal(19,4), write_off_amount decimal(19,4)"
    ),
    "installment_payment": "gift_payment_fact_id bigint, gift_commitment_system_id bigint",
    "recurring_gift": "gift_fact_id bigint, amount decimal(19,4), write_offs decimal(19,4)",
    "calendar": "date_dim_id int, actual_date date, fiscal_year int",
    "annual_projection": (
        "cap_dim_id bigint, constituent_id string, gift_fact_id bigint, "
        "gift_amount decimal(19,4), fund_identifier string, fiscal_year int, "
        "gift_date timestamp_ntz, gift_commitment_date timestamp_ntz, is_ag_gift string, "
        "appeal_identifier string"
    ),
    "production": (
        "ocpr_dim_id bigint, constituent_dim_id bigint, gift_fact_id bigint, gift_type string, "
        "gift_sub_type string, cg_gift_type string, fund_identifier string, "
        "cgpr_amount decimal(19,4), gift_date timestamp_ntz, fiscal_year int, is_ag_gift string, "
        "data_source string, measure string, key_indicator string, is_deceased string"
    ),
    "primary_code": "constituent_dim_id bigint, constituent_code string",
    "position": "constituent_dim_id bigint, position string",
    "constituent_code": "constituent_dim_id bigint, constituent_code string",
    "financial_information": (
        "constituent_dim_id bigint, information_type string, information_source string, "
        "value decimal(19,4)"
    ),
    "constituent_attribute": (
        "constituent_dim_id bigint, attribute_category string, attribute_description string, "
        "comments string"
    ),
    "us_state": "state string",
    "education": (
        "constituent_dim_id bigint, constituent_education_dim_id bigint, school_name string, "
        "school_type string, degree string, is_primary string, fuzzy_date_graduated string, "
        "class_year int"
    ),
    "education_major": (
        "constituent_dim_id bigint, constituent_education_dim_id bigint, major_code string, "
        "sequence int"
    ),
    "education_attribute": (
        "constituent_dim_id bigint, constituent_education_dim_id bigint, "
        "attribute_category string, attribute_description string, sequence int"
    ),
    "address": (
        "constituent_dim_id bigint, constituent_address_system_id bigint, address_type string, "
        "preferred string"
    ),
    "phone": (
        "constituent_dim_id bigint, constituent_address_system_id bigint, phone_type string, "
        "phone_number string"
    ),
    "donor_type": (
        "constituent_system_id bigint, dpag_donor_type_bucket string, fiscal_year int"
    ),
    "fund": (
        "fund_dim_id bigint, fund_identifier string, fund_description string, is_inactive string"
    ),
    "solicitable_fund": "designation string",
    "appeal": "appeal_dim_id bigint, appeal_identifier string, campaign_identifier string",
    "fund_translation": "fund_identifier string, suggested_fund_identifier string",
    "department_fund": (
        "college string, degree_department string, degree_major_description string, "
        "fund_id1 string, fund_id2 string"
    ),
    "manager": (
        "constituent_dim_id bigint, mgr1 string, mgr2 string, mgr3 string, cl1 string, "
        "cl2 string, cl3 string, disc_mgr string, disc_cl_mgr string"
    ),
    "relationship": (
        "constituent_dim_id bigint, related_constituent_dim_id bigint, relationship string, "
        "reciprocal string, position string, is_primary string"
    ),
    "fund_attribute": (
        "fund_dim_id bigint, attribute_category string, attribute_description string"
    ),
}


def snake_case(name: str) -> str:
    """Warehouse column names to ours: ``IsAGGift`` -> ``is_ag_gift``."""
    name = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"_+", "_", name).lower()


def normalise(df: DataFrame, collation: str | None = None, schema: str | None = None) -> DataFrame:
    """Snake-case names and text without trailing blanks; columns of ``schema`` get its types.

    ``collation`` (for instance ``UTF8_LCASE``) makes every later comparison of
    these texts ignore case, as the warehouse's own collation does.
    """

    def text(c: str) -> Column:
        trimmed = F.rtrim(F.col(f"`{c}`"))
        return F.collate(trimmed, collation) if collation else trimmed

    declared = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields} if schema else {}

    def column(f: T.StructField) -> Column:
        name, is_text = snake_case(f.name), isinstance(f.dataType, T.StringType)
        kind = declared.get(name, f.dataType)
        if isinstance(kind, T.StringType):
            if not is_text:
                text_of = F.col(f"`{f.name}`").cast("string")
                return (F.collate(text_of, collation) if collation else text_of).alias(name)
            return text(f.name).alias(name)
        value = F.rtrim(F.col(f"`{f.name}`")) if is_text else F.col(f"`{f.name}`")
        return (value if kind == f.dataType else value.cast(kind)).alias(name)

    return df.select(*[column(f) for f in df.schema.fields])


class Warehouse:
    """Logical table name -> DataFrame; tables are opened when first used."""

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open = open_table
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def from_tables(cls, tables: Mapping[str, DataFrame]) -> Warehouse:
        return cls(lambda name: tables[name])

    @classmethod
    def from_catalog(
        cls,
        spark: SparkSession,
        names: Mapping[str, str] | None = None,
        collation: str | None = None,
    ) -> Warehouse:
        """Catalog tables; ``names`` maps a logical table to its real name."""
        names = names or {}
        return cls(lambda name: normalise(spark.table(names.get(name, name)), collation, SCHEMAS[name]))

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        folder: str,
        source: str = "parquet",
        names: Mapping[str, str] | None = None,
        collation: str | None = None,
        **options: str,
    ) -> Warehouse:
        """One file or folder per table; text formats get the declared schema."""
        names = names or {}

        def open_table(name: str) -> DataFrame:
            reader = spark.read.format(source).options(**options)
            if source in ("csv", "json"):
                reader = reader.schema(SCHEMAS[name])
            return normalise(reader.load(f"{folder}/{names.get(name, name)}"), collation, SCHEMAS[name])

        return cls(open_table)


def write_extract(df: DataFrame, path: str, source: str = "csv", headings: bool = True) -> None:
    """Write the extract, with its printed headings if wanted."""
    if headings:
        df = df.withColumnsRenamed(fv.EXTRACT_HEADINGS)
    writer = df.write.mode("overwrite").format(source)
    if source == "csv":
        writer = writer.option("header", "true")
    writer.save(path)
