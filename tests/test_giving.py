from datetime import date, datetime
from decimal import Decimal
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from patronage import fixed_values as fv
from patronage.operators import giving
from patronage.operators.generic import PERSON
from patronage.policy import GivingPolicy, ProjectionPolicy

SAME, LATE = fv.STATUS_EXCLUDE_SAME_YEAR, fv.STATUS_EXCLUDE_AFTER_YEAR

STATUS_SCHEMA = (
    "re_gift_type string, fund string, gift_fiscal_year int, gift_date timestamp_ntz, "
    "counted_year int, in_grace boolean, pledge_fiscal_year int, is_credited boolean, "
    "is_realized boolean, planned_gift_fiscal_year int"
)

NOON_2015 = datetime(2015, 12, 1)
EARLY_JULY = datetime(2014, 7, 10)  # fiscal year 2015, inside the window of 2014

# type, fund, gift FY, date, counted FY, grace, pledge FY, credited, planned FY -> status
STATUS_CASES = [
    ("Planned Gift", "F", 2016, NOON_2015, 2016, False, 2016, True, 2016, "Include"),
    ("Cash", "F", 2016, NOON_2015, 2016, False, None, None, 2016, SAME["planned gift"]),
    ("Cash", "F", 2016, NOON_2015, 2016, False, None, None, 2015, "Include"),
    ("Cash", "F", 2015, EARLY_JULY, 2014, True, None, None, 2014, LATE["planned gift"]),
    ("Cash", "F", 2015, EARLY_JULY, 2015, True, None, None, 2014, "Include"),
    ("Pledge", "F", 2016, NOON_2015, 2016, False, 2016, True, None, "Include"),
    ("Pay-Cash", "11-00100", 2016, NOON_2015, 2016, False, 2016, True, None, "Include"),
    ("Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2016, True, None, SAME["pledge"]),
    ("Pay-Cash", None, 2016, NOON_2015, 2016, False, 2016, True, None, SAME["pledge"]),
    ("Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2016, None, None, "Include"),
    ("Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2015, True, None, "Include"),
    ("Pay-Cash", "F", 2016, NOON_2015, 2016, False, None, True, None, "Include"),
    ("Pay-Cash", "F", 2015, EARLY_JULY, 2014, True, 2014, True, None, LATE["pledge"]),
    ("Pay-Cash", "F", 2015, EARLY_JULY, 2014, True, 2014, None, None, "Include"),
    ("Pay-Cash", "F", 2015, EARLY_JULY, 2014, True, 2013, True, None, "Include"),
    ("Pay-Cash", "F", 2015, datetime(2014, 7, 21), 2014, True, 2014, True, None, LATE["pledge"]),
    ("Pay-Cash", "F", 2015, datetime(2014, 7, 22), 2014, True, 2014, True, None, "Include"),
    ("Recurring Gift", "F", 2016, NOON_2015, 2016, False, 2016, True, None, "Include"),
    ("Recurring Gift Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2016, None, None, "Include"),
    ("Recurring Gift Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2016, True, None, SAME["recurring gift"]),
    ("Recurring Gift Pay-Cash", "F", 2015, EARLY_JULY, 2014, True, 2014, True, None, LATE["recurring gift"]),
    ("Recurring Gift Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2015, True, None, "Include"),
    ("MG Pledge", "F", 2016, NOON_2015, 2016, False, 2016, True, None, "Include"),
    ("MG Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2016, None, None, SAME["matching gift"]),
    ("MG Pay-Cash", "F", 2015, EARLY_JULY, 2014, True, 2014, None, None, LATE["matching gift"]),
    ("MG Pay-Cash", "F", 2016, NOON_2015, 2016, False, 2015, None, None, "Include"),
    ("Other", "F", 2016, NOON_2015, 2016, False, 2016, True, None, "Include"),
]


def test_include_status_branches(spark):
    rows = [
        (t, f, y, d, c, g, p, cr, True if pl is not None else None, pl)
        for t, f, y, d, c, g, p, cr, pl, _ in STATUS_CASES
    ]
    got = spark.createDataFrame(rows, STATUS_SCHEMA).select(giving.include_status().alias("s"))
    expected = [s for *_, s in STATUS_CASES]
    assert [r["s"] for r in got.coalesce(1).collect()] == expected


@pytest.mark.parametrize(
    ("kind", "committed", "scheduled", "face", "credit", "worth"),
    [
        ("Pledge", 90, None, 1, 2, 90),
        ("Pledge", None, None, 1, 2, 0),
        ("MG Pledge", 80, 5, 1, 2, 80),
        ("Recurring Gift", 5, 70, 1, 2, 70),
        ("Recurring Gift", 5, None, 1, 2, 0),
        ("Planned Gift", 5, 5, 60, 2, 60),
        ("Cash", 5, 5, 5, 2, 2),
    ],
)
def test_countable_amount(spark, kind, committed, scheduled, face, credit, worth):
    row = spark.createDataFrame(
        [(kind, committed, scheduled, face, credit)],
        "re_gift_type string, committed_amount int, scheduled_amount int, face_amount int, amount int",
    )
    assert row.select(giving.countable_amount().alias("x")).first()["x"] == worth


def test_net_amounts_treat_null_as_zero_and_keep_the_largest(table):
    rows = table(
        "gift_commitment",
        [
            {"gift_fact_id": 1, "amount": Decimal(100), "write_off_amount": Decimal(30)},
            {"gift_fact_id": 1, "amount": Decimal(50)},
            {"gift_fact_id": 2, "write_off_amount": Decimal(5)},
        ],
    )
    got = {r["gift_fact_id"]: r["committed_amount"] for r in giving.committed_amounts(rows).collect()}
    assert got == {1: Decimal(70), 2: Decimal(-5)}


@pytest.mark.parametrize(
    ("day", "recorded", "expected"),
    [
        (datetime(2015, 7, 5), 2016, [(2016, False), (2015, True)]),
        (datetime(2014, 7, 1), 2015, [(2015, True), (2014, True)]),
        (datetime(2014, 7, 20), 2015, [(2015, True), (2014, True)]),
        (datetime(2014, 7, 20, 0, 1), 2015, [(2015, True)]),
        (datetime(2014, 7, 21), 2015, [(2015, True)]),
        (datetime(2015, 6, 30, 23, 59), 2015, [(2015, True)]),
        (datetime(2005, 7, 1), 2006, [(2006, True)]),
        (datetime(2005, 6, 30), 2005, []),
        (datetime(2017, 7, 1), 2018, []),
        (datetime(2016, 8, 1), 2017, [(2017, False)]),
    ],
)
def test_counted_years(spark, day, recorded, expected):
    row = spark.createDataFrame([(day, recorded)], "gift_date timestamp_ntz, gift_fiscal_year int")
    got = row.select(giving.counted_years().alias("y")).first()["y"]
    assert [tuple(y) for y in got] == expected
    kept = row.where(giving._gift_date_bounds(GivingPolicy())).count()
    assert kept >= bool(expected)


def test_planned_gift_dates(spark, table):
    def gift(key, day, **more):
        return {"gift_fact_id": key, "gift_system_id": key, "gift_date": day, **more}

    early, late, realized = datetime(2010, 1, 5), datetime(2012, 1, 5), datetime(2011, 3, 3)
    cases = {
        # person: ([planned gifts], realised date, link) -> date
        1: ([early, late], realized, 900, realized),
        2: ([early, late], datetime(2013, 1, 1), None, late),
        3: ([early, late], realized, None, early),
        4: ([], realized, None, datetime(1900, 1, 1)),
        5: ([early], early, 12345, early),
    }
    ledger, gifts, attributes, number = [], [gift(900, datetime(2009, 1, 1))], [], 0
    for person, (planned, day, link, _) in cases.items():
        for planned_day in planned:
            number += 1
            ledger.append((number, number, person, "Planned Gift", planned_day, planned_day, person, None))
        number += 1
        ledger.append((number, number, person, "Cash", day, day, person, link))
        attributes.append({"gift_fact_id": number, "attribute_category": "Planned Gift Realized"})
    frame = spark.createDataFrame(
        ledger,
        "cg_fact_id bigint, gift_fact_id bigint, constituent_dim_id bigint, re_gift_type string, "
        "gift_date timestamp_ntz, entry_date timestamp_ntz, giver_dim_id bigint, planned_gift_id bigint",
    )
    got = giving.planned_gift_dates(frame, table("gift", gifts), table("gift_attribute", attributes))
    by_gift = {r["gift_fact_id"]: r["planned_gift_date"] for r in got.collect()}
    assert list(dict(sorted(by_gift.items())).values()) == [d for *_, d in cases.values()]
    original = giving.planned_gift_dates(
        frame,
        table("gift", gifts),
        table("gift_attribute", attributes),
        GivingPolicy(use_original_planned_date=True),
    )
    assert min(r["planned_gift_date"] for r in original.where("gift_fact_id = 3").collect()) == datetime(2009, 1, 1)


def test_projected_gifts(table, person):
    def due(key, **more):
        row = {
            "cap_dim_id": key,
            "constituent_id": "1001",
            "gift_amount": Decimal(10),
            "fiscal_year": 2017,
            "gift_date": datetime(2016, 9, 1),
            "gift_commitment_date": datetime(2016, 6, 30),
            "fund_identifier": "F",
            "is_ag_gift": "Yes",
        }
        return {**row, **more}

    people = table("constituent", [person(1), person(2, is_deceased="Yes"), person(3, key_indicator="O")])
    rows = table(
        "annual_projection",
        [
            due(1),
            due(2, gift_amount=Decimal(0)),
            due(3, gift_commitment_date=datetime(2016, 7, 1)),
            due(4, gift_fact_id=5),
            due(5, fiscal_year=2016),
            due(6, constituent_id="1002"),
            due(7, constituent_id="1003"),
            due(8, constituent_id=None),
        ],
    )
    got = giving.projected_gifts(rows, people, ProjectionPolicy()).collect()
    assert sorted((r["cg_fact_id"], r["gift_fact_id"], r[PERSON]) for r in got) == [(-7, -7, 3), (-1, -1, 1)]


def test_positive_totals(spark):
    rows = spark.createDataFrame(
        [(1, Decimal(5)), (1, Decimal(-9)), (2, Decimal(0)), (3, Decimal(-1))],
        "k int, amount decimal(19,4)",
    )
    assert [tuple(r) for r in giving.positive_totals(rows, ["k"]).collect()] == [(1, Decimal(5))]


def test_dedupe_payments_keeps_the_largest_and_breaks_ties(spark):
    rows = spark.createDataFrame(
        [(1, 5, 2), (1, 9, 7), (1, 9, 3), (2, None, 1), (2, 1, 9)], "k int, amount int, t int"
    )
    got = giving.dedupe_payments(rows, ["k"], "amount", ["t"]).collect()
    assert sorted(map(tuple, got)) == [(1, 9, 3), (2, 1, 9)]


def test_translate_fund(spark, table):
    funds = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), (None,)], "fund_identifier string")
    solicitable = spark.createDataFrame([("A",)], "fund_identifier string")
    translation = table(
        "fund_translation",
        [
            {"fund_identifier": "A", "suggested_fund_identifier": "X"},
            {"fund_identifier": "B", "suggested_fund_identifier": "Y"},
            {"fund_identifier": "D", "suggested_fund_identifier": "Z"},
            {"fund_identifier": "D", "suggested_fund_identifier": "Y"},
        ],
    )
    got = giving.translate_fund(funds, solicitable, translation).collect()
    expected = {("A", "A"), ("B", "Y"), ("C", "C"), ("D", "Y"), (None, None)}
    assert {tuple(r) for r in got} == expected and len(got) == 5


@pytest.mark.parametrize(
    ("kind", "sub", "cg", "expected"),
    [
        ("MG Pledge", None, None, "Yes"),
        ("Other", "Recognition Credit", "Corporate MatchingGift", "Yes"),
        ("Other", "Recognition Credit", "MatchingGift Other", "No"),
        ("Other", None, "MatchingGift", "No"),
        ("Cash", "Recognition Credit", "MatchingGift", "No"),
    ],
)
def test_is_matching_gift(spark, kind, sub, cg, expected):
    row = spark.createDataFrame(
        [(kind, sub, cg)], "gift_type string, gift_sub_type string, cg_gift_type string"
    )
    assert row.select(giving.is_matching_gift().alias("m")).first()["m"] == expected


# --- properties over the retail data -------------------------------------


def _year_turn(plan, year):
    """Giving of one grace year, computed alone as one turn of a yearly loop."""
    policy = GivingPolicy(strict_years=(), grace_years=(year,))
    w = plan.wh
    return giving.giving_per_fiscal_year(
        plan.ledger,
        w.constituent,
        w.gift,
        w.gift_attribute,
        w.gift_commitment,
        w.recurring_gift,
        w.installment_payment,
        w.calendar,
        policy=policy,
    )


def test_one_pass_equals_one_turn_per_year(plan):
    together = {tuple(r) for r in plan.giving.where("fiscal_year in (2013, 2014)").collect()}
    apart = {tuple(r) for y in (2013, 2014) for r in _year_turn(plan, y).collect()}
    assert together == apart and together


def test_order_of_the_input_does_not_matter(plan, spark):
    shuffled = plan.ledger.orderBy(F.xxhash64("cg_fact_id"))
    w = plan.wh
    again = giving.giving_per_fiscal_year(
        shuffled,
        w.constituent,
        w.gift.orderBy(F.xxhash64("gift_fact_id")),
        w.gift_attribute,
        w.gift_commitment,
        w.recurring_gift,
        w.installment_payment.orderBy(F.rand(1)),
        w.calendar,
        plan.projections,
    )
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in plan.giving.collect()}


def test_lookups_do_not_multiply_ledger_rows(plan):
    w = plan.wh
    counted = giving.countable_gifts(
        plan.ledger,
        w.gift,
        w.gift_attribute,
        w.gift_commitment,
        w.recurring_gift,
        w.installment_payment,
        w.calendar,
    )
    repeated = counted.groupBy("cg_fact_id", "counted_year").count().where("count > 1")
    assert repeated.count() == 0
    assert {r["status"] for r in counted.select("status").distinct().collect()} >= {
        giving.INCLUDE,
        SAME["pledge"],
    }


def test_fiscal_years_are_contiguous(plan):
    years = sorted(r[0] for r in plan.giving.select("fiscal_year").distinct().collect())
    assert all(b - a == 1 for a, b in pairwise(years)) and years[-1] == 2017
    assert date(years[0], 1, 1) >= date(2006, 1, 1)


def test_rows_of_one_status_and_kept_stages_give_the_same_giving(spark, plan):
    w, policy = plan.wh, GivingPolicy()
    sources = (w.gift, w.gift_attribute, w.gift_commitment, w.recurring_gift, w.installment_payment, w.calendar)
    lineage = giving.commitment_lineage(w.installment_payment, w.gift, w.calendar)
    realized = giving.realized_planned_gift_date(plan.ledger, w.gift, w.gift_attribute, w.calendar)
    every = giving.countable_gifts(plan.ledger, *sources, policy)
    included = giving.countable_gifts(plan.ledger, *sources, policy, status=giving.INCLUDE, lineage=lineage, realized=realized)
    assert "_if_credited" not in included.columns
    columns = ["cg_fact_id", "counted_year", "countable", "status"]
    rows = sorted(map(str, included.select(*columns).collect()))
    assert rows == sorted(map(str, every.where(F.col("status") == giving.INCLUDE).select(*columns).collect())) and rows
    again = giving.giving_per_fiscal_year(
        plan.ledger, w.constituent, *sources, plan.projections, policy, lineage=lineage, realized=realized
    )
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in plan.giving.collect()}


def test_a_credit_is_looked_up_once_however_often_it_is_given(spark):
    rows = spark.createDataFrame([(1, 7, 10), (2, 8, 10), (3, 7, None)], f"gift_fact_id long, {PERSON} long, commitment_gift_fact_id long")
    ledger = spark.createDataFrame([(10, 7), (10, 7), (11, 8)], f"gift_fact_id long, {PERSON} long")
    marked = giving.mark_credited(rows, ledger)
    got = marked.select("gift_fact_id", "is_credited").collect()
    assert sorted(map(tuple, got)) == [(1, True), (2, None), (3, None)]
    # the credits are made distinct in the exchange of the join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = giving.mark_credited(rows, ledger)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_production_gifts_meet_their_gifts_without_a_scan_before(plan, monkeypatch):
    sketched = []
    monkeypatch.setattr(giving.HotKeys, "counts", lambda self: sketched.append(self.columns) or {c: [] for c in self.columns})
    spark, w = plan.wh.gift.sparkSession, plan.wh
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = giving.production_gifts(w.production, w.gift, w.fund, w.appeal, plan.solicitable, w.fund_translation)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows.columns and not any("gift_fact_id" in columns for columns in sketched)


def test_giving_for_credits_shuffles_flags_and_no_texts(plan, monkeypatch):
    kinds = []
    mark = giving.mark_credited
    monkeypatch.setattr(giving, "mark_credited", lambda rows, ledger: (kinds.append(dict(rows.dtypes)), mark(rows, ledger))[1])
    w = plan.wh
    giving.countable_gifts(
        plan.ledger, w.gift, w.gift_attribute, w.gift_commitment, w.recurring_gift, w.installment_payment, w.calendar,
        status=giving.INCLUDE,
    )
    assert kinds[0]["_if_credited"] == kinds[0]["_if_not"] == "boolean"
