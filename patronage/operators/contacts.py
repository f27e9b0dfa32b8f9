"""Contact data and per-person dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import (
    active_individual,
    contains_any,
    fuzzy_date,
    is_yes,
    recode,
    starts_with_any,
    strip_chars,
)
from ..policy import CELL_PHONE, HOME_PHONE, PhonePolicy
from .generic import PERSON, attribute_lookup, drop_empty, keep_members, pick_one
from .skew import balanced_lookup, lookup

EDUCATION_KEYS = (PERSON, "constituent_education_dim_id")


def primary_education(
    education: DataFrame, constituent: DataFrame, major: DataFrame, attribute: DataFrame
) -> DataFrame:
    """One primary degree per living person, with major, department and campus.

    A person with several primary rows keeps the lowest education key; report
    those with ``quality.duplicate_keys`` on :func:`primary_education_rows`.
    """
    rows = primary_education_rows(education, constituent, major, attribute)
    return pick_one(rows, [PERSON], [F.col("constituent_education_dim_id")]).drop(
        "constituent_education_dim_id"
    )


def primary_education_rows(
    education: DataFrame, constituent: DataFrame, major: DataFrame, attribute: DataFrame
) -> DataFrame:
    """Primary degrees of living people, before one per person is chosen."""
    living = constituent.where(F.col("is_deceased") == fv.NO).select(PERSON)
    degrees = education.where(
        F.col("school_name").isin(*fv.SCHOOLS)
        & is_yes("is_primary")
        & (F.col("school_type") != fv.UNKNOWN_SCHOOL_TYPE)
    ).select(
        *EDUCATION_KEYS,
        "school_name",
        "school_type",
        fuzzy_date("fuzzy_date_graduated", "class_year").alias("date_graduated"),
    )
    majors = pick_one(
        major.select(*EDUCATION_KEYS, "major_code", "sequence"),
        EDUCATION_KEYS,
        [F.col("sequence").asc_nulls_first(), F.col("major_code").asc_nulls_last()],
    ).select(*EDUCATION_KEYS, F.col("major_code").alias("major"))
    departments = attribute_lookup(
        attribute, fv.DEPARTMENT_CATEGORY, EDUCATION_KEYS, order_by=["sequence"], name="department"
    )
    tulsa = (
        attribute.where(
            (F.col("attribute_category") == fv.TULSA_CATEGORY)
            & (F.col("attribute_description") == fv.YES)
        )
        .select(*EDUCATION_KEYS)
        .distinct()
        .withColumn("at_tulsa", F.lit(True))
    )
    rows = keep_members(degrees, living)
    for side in (majors, departments, tulsa):
        rows = lookup(rows, side, EDUCATION_KEYS)
    school_type = (
        F.when(F.col("at_tulsa"), fv.TULSA_SCHOOL_TYPE)
        .when(F.col("school_type") == fv.HEALTH_GRAD_SCHOOL_TYPE, fv.HEALTH_SCHOOL)
        .otherwise(F.col("school_type"))
    )
    return (
        rows.withColumn("school_type", school_type)
        .withColumn("school_type_trans", recode("school_type", fv.SCHOOL_TYPE_RECODE))
        .select(
            *EDUCATION_KEYS,
            "major",
            "date_graduated",
            "department",
            "school_name",
            "school_type",
            "school_type_trans",
        )
    )


def clean_phone_filter(phone_type: str = "phone_type", number: str = "phone_number") -> Column:
    """Keep real phone numbers: no e-mail, web or fax entries, enough characters."""
    return (
        ~contains_any(phone_type, fv.UNWANTED_PHONE_TYPES)
        & ~contains_any(number, fv.UNWANTED_PHONE_TEXT)
        & (F.length(strip_chars(number)) >= fv.PHONE_MIN_LENGTH)
    )


def phone_rank(policy: PhonePolicy) -> Column:
    """Position of a phone on the ladder, smaller is better, NULL off the ladder.

    On the preferred part of the ladder a preferred address beats the same type
    at another address.
    """
    phone_type = F.rtrim("phone_type")

    def step(ladder: tuple[str, ...]) -> Column:
        listed = F.array(*[F.lit(t) for t in ladder])
        return F.nullif(F.array_position(listed, phone_type), F.lit(0).cast("bigint"))

    at_home = F.col("address_type") == policy.address_type
    top = step(policy.preferred_ladder) * 2 - F.when(is_yes("preferred"), 1).otherwise(0)
    below = step(policy.other_ladder) + 2 * len(policy.preferred_ladder)
    return F.when(
        at_home & starts_with_any("phone_type", policy.type_prefixes), F.coalesce(top, below)
    )


def ranked_phones(address: DataFrame, phone: DataFrame, policies: dict[str, PhonePolicy]) -> DataFrame:
    """Usable phones with one rank column per policy, on at least one ladder."""
    keys = [PERSON, "constituent_address_system_id"]
    prefixes = [p for policy in policies.values() for p in policy.type_prefixes]
    places = {policy.address_type for policy in policies.values()}
    addresses = address.where(F.col("address_type").isin(*places)).select(
        *keys, "address_type", "preferred"
    )
    phones = phone.where(clean_phone_filter() & starts_with_any("phone_type", prefixes)).select(
        *keys, "phone_type", "phone_number"
    )
    rows = balanced_lookup(phones, addresses, keys, "inner").select(
        PERSON,
        "phone_number",
        "phone_type",
        *[phone_rank(policy).alias(name) for name, policy in policies.items()],
    )
    return rows.where(F.coalesce(*policies).isNotNull())


def best_contact(address: DataFrame, phone: DataFrame, policy: PhonePolicy = HOME_PHONE) -> DataFrame:
    """Best phone number per person; ties go to the lowest number."""
    rows = ranked_phones(address, phone, {"rank": policy})
    order = [F.col(c) for c in ("rank", "phone_number", "phone_type")]
    return pick_one(rows, [PERSON], order).drop("rank")


def contact_sheet(
    constituent: DataFrame,
    address: DataFrame,
    phone: DataFrame,
    home: PhonePolicy = HOME_PHONE,
    cell: PhonePolicy = CELL_PHONE,
) -> DataFrame:
    """Best home phone and best cell phone of living, active individuals.

    Both come from one grouped pass over the phones.  People with neither stay in
    as blank rows; :func:`reachable` drops them.
    """
    people = constituent.where(
        F.col("constituent_id").isNotNull()
        & (F.col(PERSON) != fv.UNKNOWN_MEMBER_KEY)
        & active_individual()
    ).select(PERSON)

    def best(rank: str) -> Column:
        choice = F.struct(rank, "phone_number", "phone_type")
        return F.min(F.when(F.col(rank).isNotNull(), choice))["phone_number"]

    numbers = (
        ranked_phones(address, phone, {"home_rank": home, "cell_rank": cell})
        .groupBy(PERSON)
        .agg(best("home_rank").alias("home_phone"), best("cell_rank").alias("home_cell"))
    )
    return lookup(people, numbers, PERSON)


def reachable(sheet: DataFrame) -> DataFrame:
    return drop_empty(sheet, ["home_phone", "home_cell"])


def donor_type(
    donor_type_table: DataFrame, constituent: DataFrame, fiscal_year: int = fv.DONOR_TYPE_YEAR
) -> DataFrame:
    """Donor-type bucket of living, active individuals in one fiscal year."""
    people = constituent.where(active_individual()).select(PERSON, "constituent_system_id")
    buckets = donor_type_table.where(F.col("fiscal_year") == fiscal_year).select(
        "constituent_system_id", "dpag_donor_type_bucket", "fiscal_year"
    )
    return lookup(buckets, people, "constituent_system_id", "inner").select(
        PERSON, "dpag_donor_type_bucket", "fiscal_year"
    )


def primary_employer(relationship: DataFrame, constituent: DataFrame) -> DataFrame:
    """Name of the primary employer and the position there, one per person."""
    jobs = relationship.where(
        (F.col("relationship") == fv.EMPLOYER)
        & (F.col("reciprocal") == fv.EMPLOYEE)
        & is_yes("is_primary")
    ).select(PERSON, "related_constituent_dim_id", "position")
    employers = constituent.where(F.col("full_name") != fv.UNKNOWN_EMPLOYER).select(
        F.col(PERSON).alias("related_constituent_dim_id"), "full_name"
    )
    rows = balanced_lookup(jobs, employers, "related_constituent_dim_id", "inner")
    return pick_one(
        rows,
        [PERSON],
        [
            F.col("related_constituent_dim_id"),
            F.col("position").asc_nulls_last(),
        ],
    ).select(PERSON, "full_name", "position")


def loyalty_years(constituent_attribute: DataFrame) -> DataFrame:
    """Number of loyal giving years as recorded, one per person: the smallest number."""
    recorded = constituent_attribute.where(
        (F.col("attribute_category") == fv.LOYALTY_CATEGORY) & (F.col("comments") == fv.LOYALTY_COMMENT)
    )
    value = F.col("attribute_description")
    return pick_one(
        recorded, [PERSON], [value.try_cast("bigint").asc_nulls_last(), value.asc_nulls_last()]
    ).select(PERSON, value.alias("loyalty_years"))
