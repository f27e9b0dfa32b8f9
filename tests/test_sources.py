from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patronage import fixed_values as fv
from patronage.operators import giving
from patronage.operators.generic import PERSON
from patronage.operators.stage import materialize, shared_folder
from patronage.sources import SCHEMAS, Warehouse, snake_case, write_extract
from patronage.sources.retail import ARRANGED, DIMENSIONS, VIEWS, retail_warehouse, tables_in


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("ConstituentDimID", "constituent_dim_id"),
        ("CGFactID", "cg_fact_id"),
        ("IsAGGift", "is_ag_gift"),
        ("IsAConstituent", "is_a_constituent"),
        ("OCPRDimID", "ocpr_dim_id"),
        ("CGPRAmount", "cgpr_amount"),
        ("CGGiftType", "cg_gift_type"),
        ("DPAGDonorTypeBucket", "dpag_donor_type_bucket"),
        ("Degree Major Description", "degree_major_description"),
        ("FundID1", "fund_id1"),
        ("Mgr1", "mgr1"),
        ("Address5", "address5"),
    ],
)
def test_snake_case(name, expected):
    assert snake_case(name) == expected


def test_every_table_has_a_retail_view_with_the_declared_types(spark, data_dir):
    warehouse = retail_warehouse(spark, data_dir)
    assert set(VIEWS) == set(SCHEMAS)
    for name, ddl in SCHEMAS.items():
        declared = spark.createDataFrame([], ddl).schema
        assert {f.name: f.dataType for f in declared} == {
            f.name: f.dataType for f in warehouse[name].schema
        }, name


def test_files_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Alumni  ")], "ConstituentDimID bigint, ConstituentCode string")
    rows.write.parquet(str(tmp_path / "codes"))
    warehouse = Warehouse.from_files(spark, str(tmp_path), names={"primary_code": "codes"})
    assert [tuple(r) for r in warehouse.primary_code.collect()] == [(1, "Alumni")]
    rows.createOrReplaceTempView("code_view")
    warehouse = Warehouse.from_catalog(spark, {"primary_code": "code_view"})
    assert [tuple(r) for r in warehouse.primary_code.collect()] == [(1, "Alumni")]
    with pytest.raises(AttributeError):
        warehouse.no_such_table


def test_csv_takes_the_declared_schema(spark, tmp_path):
    (tmp_path / "fund").write_text("1,F1,First,No\n")
    warehouse = Warehouse.from_files(spark, str(tmp_path), "csv")
    assert tuple(warehouse.fund.first()) == (1, "F1", "First", "No")


def test_extract_is_written_with_its_headings(spark, tmp_path):
    row = spark.createDataFrame([("7", "Ann")], "constituent_id string, first_name string")
    write_extract(row, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["ConstituentID", "First Name"]
    assert back.collect()[0][1] == "Ann"


def test_extract_columns(plan):
    extract = plan.mail_extract
    assert extract.columns == list(fv.EXTRACT_HEADINGS) and len(extract.columns) == 57
    rows = extract.collect()
    ids = [int(r["constituent_id"]) for r in rows]
    assert ids == sorted(set(ids)) and len(ids) == plan.segments.count()


@pytest.mark.parametrize("mode", ["lazy", "persist", "table"])
def test_materialize_keeps_the_rows(spark, mode):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    kept = materialize(df, "numbers", mode)
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    if mode == "persist":
        kept.unpersist()


def test_table_mode_uses_the_configured_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = materialize(spark.range(3), "three", "table")
    assert all(shared_folder(spark) in f for f in kept.inputFiles())
    with pytest.raises(ValueError, match="unknown mode"):
        materialize(spark.range(1), "x", "other")


def test_collation_makes_codes_ignore_case(spark, table, tmp_path):
    from patronage.operators import lists

    table("position", [{PERSON: 1, "position": "PRINCIPAL gift prospect"}]).write.parquet(
        str(tmp_path / "position")
    )
    for collation, expected in ((None, 0), ("UTF8_LCASE", 1)):
        wh = Warehouse.from_files(spark, str(tmp_path), collation=collation)
        policy = lists.AudiencePolicy()
        hits = wh.position.where(F.col("position").isin(*policy.excluded_positions))
        assert hits.count() == expected


def test_small_dimensions_are_tables_with_the_rows_of_their_views(spark, data_dir):
    lazy, kept = retail_warehouse(spark, data_dir), retail_warehouse(spark, data_dir, "table")
    for name in DIMENSIONS:
        assert all(shared_folder(spark) in f for f in kept[name].inputFiles()), name
        assert kept[name].dtypes == lazy[name].dtypes
        assert sorted(map(str, kept[name].collect())) == sorted(map(str, lazy[name].collect())), name


def test_arranged_views_have_the_rows_of_their_views(spark, data_dir):
    for name, text in ARRANGED.items():
        read = lambda t: {n: spark.read.parquet(f"{data_dir}/{n}.parquet") for n in tables_in(t)}
        plain, arranged = (spark.sql(t, **read(t)) for t in (VIEWS[name], text))
        assert arranged.sameSemantics(spark.sql(text, **read(text))), name  # a store knows its stages again
        assert text != VIEWS[name] and arranged.dtypes == plain.dtypes, name
        assert Counter(map(str, arranged.collect())) == Counter(map(str, plain.collect())), name


def test_payments_find_the_commitments_of_their_year_and_the_years_beside_it(spark):
    when = lambda year: datetime(year, 8, 1)
    orders = spark.createDataFrame(
        [(1, 7, when(2000)), (2, 7, when(2000)), (3, 7, when(2001)), (3, 7, when(2001)), (4, None, when(2001)),
         (None, 7, when(2000)), (5, 7, None), (6, 8, when(2001))],
        "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    )
    lines = [(o, n) for o in (1, 2, 3, 4, 5, 6, None) for n in (1, 2, 2, -1, None)]
    tables = {"orders": orders, "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int")}
    texts = VIEWS["installment_payment"], ARRANGED["installment_payment"]
    plain, arranged = (Counter(map(tuple, spark.sql(t, **tables).collect())) for t in texts)
    assert arranged == plain and arranged[(3, 4)] == 2 and arranged[(2, 4)] == 2 and arranged[(2, 10)] == 1


def test_production_meets_gifts_and_payments_meet_commitments_without_another_shuffle(spark, data_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        w = retail_warehouse(spark, data_dir, "table")
        met = w.production.join(w.gift.select("gift_fact_id", "fund_dim_id"), "gift_fact_id")
        assert _exchanges(met) == 5  # lines by part, parts, lines by order, orders, gifts
        links = w.installment_payment.distinct()
        assert _exchanges(links) == 6  # orders by payer and year, its years thrice, orders and lines by order
        lineage = giving.commitment_lineage(w.installment_payment, w.gift, w.calendar)
        text = lineage._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet [l_orderkey") == 1  # payments are put together once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
