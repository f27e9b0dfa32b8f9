import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage.operators import segments
from patronage.operators.generic import PERSON
from patronage.operators.giving import annual_giving_years
from patronage.operators.stage import materialize

MULTI = "2YRG2-3LAPSED"


@pytest.mark.parametrize(
    ("segment", "average", "raw", "printed"),
    [
        ("4PLUS", "5000", (100, 50, 25), (100, 50, 25)),
        ("1YRG2-3LAPSED", None, (100, 50, 25), (100, 50, 25)),
        (MULTI, "75", (100, 50, 25), (200, 50, 25)),
        (MULTI, "75.01", ("150.02", "82.511", "37.505"), (200, 100, 40)),
        (MULTI, "100", (200, 110, 50), (200, 100, 50)),
        (MULTI, "125", (250, "137.5", "62.5"), (250, 100, 65)),
        (MULTI, "166.67", ("333.34", "183.337", "83.335"), (1000, 100, 50)),
        (MULTI, "250", (500, 275, 125), (1000, 500, 50)),
        (MULTI, "250.01", ("375.015", "275.011", "125.005"), (1000, 500, 50)),
        (MULTI, "667", ("1000.5", "733.7", "333.5"), (5000, 500, 200)),
        (MULTI, "1000", (1500, 1100, 500), (5000, 2500, 200)),
        (MULTI, "1000.01", ("1100.011", "1000.01", "500.005"), (5000, 2500, 200)),
        (MULTI, None, (None,) * 3, (None,) * 3),
        ("16&17DONOR", "500", (None,) * 3, (None,) * 3),
        ("", "500", (None,) * 3, (None,) * 3),
        (None, "500", (None,) * 3, (None,) * 3),
    ],
)
def test_asks(spark, segment, average, raw, printed):
    def decimals(values):
        return [None if v is None else Decimal(v) for v in values]

    row = spark.createDataFrame(
        [(segment, None if average is None else Decimal(average))],
        "marketing_segment string, avg_amount decimal(19,4)",
    )
    laddered = row.select("marketing_segment", *segments.ask_ladder())
    assert list(laddered.select(*segments.ASKS).first()) == decimals(raw)
    assert list(laddered.select(*segments.ask_snap()).first()) == decimals(printed)


def test_segment_branches(spark, table):
    members = spark.createDataFrame([(k,) for k in range(1, 8)], f"{PERSON} bigint")
    buckets = {1: "4+ Year Lapsed", 2: "4+ Year Lapsed", 3: "Lapsed", 4: "Lapsed", 5: "Lapsed", 7: "Lapsed"}
    donor_types = spark.createDataFrame(
        list(buckets.items()), f"{PERSON} bigint, dpag_donor_type_bucket string"
    )
    giving = spark.createDataFrame(
        [(1, 2017, Decimal(5)), (2, 2015, Decimal(5)), (3, 2016, Decimal(0))],
        f"{PERSON} bigint, fiscal_year int, amount decimal(19,4)",
    )

    def gift(person, year, **more):
        row = {
            PERSON: person,
            "fiscal_year": year,
            "is_ag_gift": "Yes",
            "cgpr_amount": Decimal(1),
            "data_source": "Development",
        }
        return {**row, **more}

    production = table(
        "production",
        [gift(3, 2010), gift(3, 2010), gift(4, 2010), gift(4, 2012), gift(7, 2010, is_ag_gift="No")],
    )
    got = segments.segment(
        members, donor_types, giving, annual_giving_years(production)
    ).collect()
    assert {r[PERSON]: r["marketing_segment"] for r in got} == {
        1: "16&17DONOR",
        2: "4PLUS",
        3: "1YRG2-3LAPSED",
        4: MULTI,
        5: "",
        7: "",
    }


@pytest.fixture
def giving(spark):
    return spark.createDataFrame(
        [
            (1, 2016, Decimal(10)),
            (1, 2017, Decimal(20)),
            (1, 2010, Decimal("0.0001")),
            (2, 2015, Decimal(7)),
        ],
        f"{PERSON} bigint, fiscal_year int, amount decimal(19,4)",
    )


def test_year_figures(giving):
    totals = {r[0]: tuple(r)[1:] for r in segments.year_totals(giving, (2017, 2016)).collect()}
    assert totals == {1: (20, 10), 2: (0, 0)}
    assert [tuple(r) for r in segments.year_amount(giving, 2016).collect()] == [(1, 10)]
    summary = segments.giving_summary(giving, {"a": 2016, "b": 2015}).collect()
    assert {tuple(r) for r in summary} == {(1, 10, None), (2, None, 7)}
    averages = {r[0]: r["avg_amount"] for r in segments.avg_per_giving_year(giving).collect()}
    assert averages == {1: Decimal("10.0000"), 2: Decimal(7)}


def test_production_figures(spark):
    gifts = spark.createDataFrame(
        [
            (1, 2017, Decimal(9), "Yes", "No"),
            (1, 2016, Decimal(1), "Yes", "Yes"),
            (1, 2015, Decimal(2), "Yes", "No"),
            (1, 2015, Decimal(3), "No", "No"),
            (2, 2017, Decimal(4), "No", "No"),
            (3, 2014, Decimal(4), "Yes", "Yes"),
        ],
        f"{PERSON} bigint, fiscal_year int, amount decimal(19,4), is_ag_gift string, is_matching_gift string",
    )
    got = {tuple(r) for r in segments.production_summary(gifts, 2017).collect()}
    assert got == {(1, 3, 2017, 2016, 6), (2, None, None, None, None), (3, 1, None, 2014, 4)}
    last = {tuple(r) for r in segments.prior_total(gifts, 2017, last_year_only=True).collect()}
    assert last == {(1, 1), (3, 4)}
    both = {(r[0], r["prior_total"]) for r in segments.production_summary(gifts, 2017, True).collect()}
    assert both == {(1, 1), (2, None), (3, 4)}


def test_manager_fallback(table):
    rows = table(
        "manager",
        [
            {PERSON: 1, "mgr1": "A", "cl1": "B", "cl2": "C"},
            {PERSON: 2, "disc_cl_mgr": "D", "mgr3": "E"},
            {PERSON: 3, "disc_mgr": "F", "disc_cl_mgr": "D"},
        ],
    )
    got = {tuple(r) for r in segments.manager_fallback(rows).collect()}
    assert got == {(1, "A", "C", ""), (2, "D", "", "E"), (3, "F", "", "")}


def test_households_and_segments_are_not_gathered_in_the_driver(spark):
    """Packed columns: their files are under the broadcast limit with any number of rows."""
    people = spark.range(200_000).withColumnRenamed("id", PERSON)
    members = materialize(people, "members", "table")
    named = materialize(people.withColumn("marketing_segment", F.lit("4PLUS")), "named", "table")
    donor_types = people.where(f"{PERSON} < 2").withColumn("dpag_donor_type_bucket", F.lit("4+ Year Lapsed"))
    averages = spark.createDataFrame([(1, Decimal(100))], f"{PERSON} bigint, avg_amount decimal(19,4)")
    giving = spark.createDataFrame([], f"{PERSON} bigint, fiscal_year int, amount decimal(19,4)")
    found = segments.segment(members, donor_types, giving, giving.select(PERSON, "fiscal_year"))
    asks = segments.ask_array(members, named, averages)
    for df in (found, asks):
        executed = df._jdf.queryExecution().executedPlan().toString()
        before = [executed[: at.start()] for at in re.finditer("FileScan parquet", executed)]
        assert before and all(text.rfind("BroadcastExchange") <= text.rfind("Exchange hash") for text in before)
    assert [r[PERSON] for r in found.orderBy(PERSON).collect()] == [0, 1]
    assert asks.count() == 200_000
