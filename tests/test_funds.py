from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage.operators import funds, generic, lists
from patronage.operators.generic import PERSON
from patronage.operators.stage import materialize
from patronage.policy import CASCADE, SuggestionPolicy

GIFT = f"{PERSON} bigint, fund_identifier_trans string, gift_date timestamp_ntz, amount decimal(19,4), is_matching_gift string"


@pytest.fixture
def gifts(spark):
    def gift(person, fund, day, amount, matching="No"):
        return (person, fund, datetime(2015, 1, day), Decimal(amount), matching)

    return spark.createDataFrame(
        [
            gift(1, "A", 1, 10),
            gift(1, "A", 5, 10),
            gift(1, "B", 9, 30),
            gift(1, "B", 20, 500, "Yes"),
            gift(1, "Unknown", 30, 900),
            gift(2, "C", 3, 7),
            *[gift(3, f, 2, 5) for f in "FEDCBA"],
        ],
        GIFT,
    )


@pytest.fixture
def fund(table):
    return table(
        "fund",
        [
            {"fund_dim_id": i, "fund_identifier": f, "fund_description": f"Fund {f}"}
            for i, f in enumerate("ABCDEF")
        ],
    )


def by_person(df, column, person):
    rows = df.where(F.col(PERSON) == person).orderBy("seq").collect()
    return [r[column] for r in rows]


def test_rankings(gifts, fund):
    affinity = funds.fund_affinity(gifts, fund)
    name = "fund_identifier_trans"
    assert by_person(funds.rank_by_recency(affinity), name, 1) == ["B", "A"]
    assert by_person(funds.rank_by_money(affinity), name, 1) == ["B", "A"]
    assert by_person(funds.rank_by_frequency(affinity), name, 1) == ["A", "B"]
    assert by_person(funds.rank_by_frequency(affinity), name, 3) == list("ABCDEF")


def test_points_blend(gifts, fund):
    blend = funds.points_blend(funds.rank_all(funds.fund_affinity(gifts, fund)))
    assert by_person(blend, "total_points", 1) == [11, 10]
    assert by_person(blend, "total_points", 2) == [12]
    assert by_person(blend, "fund_identifier_trans", 3) == list("ABCD")
    totals = blend.groupBy(PERSON).agg(F.sum("total_points").alias("t")).collect()
    assert all(r["t"] <= 30 for r in totals)


@pytest.fixture
def cascade(table, person):
    """Everyone: 1 and 2 are a couple, 3 is inactive, 4 an organisation."""
    people = [
        person(1, spouse_constituent_system_id=2),
        person(2, spouse_constituent_system_id=1),
        person(3, is_inactive="Yes", spouse_constituent_system_id=1),
        person(4, key_indicator="O"),
    ]

    def run(degrees=(), education=(), attributes=(), rules=(), known=None, policy=SuggestionPolicy()):
        constituent = table("constituent", people)
        pairs = lists.spouse_pairs(constituent)
        stage = constituent.sparkSession.createDataFrame(
            list(degrees),
            f"{PERSON} bigint, school_name string, school_type_trans string, department string",
        )
        known = {r.fund for r in CASCADE} | {"F1", "F2"} if known is None else known
        fund = table(
            "fund", [{"fund_identifier": f, "fund_description": f"Fund {f}"} for f in known]
        )
        eligible = funds.eligibility(
            constituent,
            stage,
            table("education", list(education)),
            table("education_attribute", list(attributes)),
            pairs,
        )
        rows = funds.rule_cascade(
            eligible, stage, table("department_fund", list(rules)), pairs, fund, policy
        )
        return sorted(
            (r[PERSON], r["designations_order"], r["fund_identifier"]) for r in rows.collect()
        )

    return run


GENERAL = [(108, "20-24400"), (119, "20-24400"), (120, "20-81600"), (121, "20-19650")]


def general(*people):
    return [(p, o, f) for p in people for o, f in GENERAL]


def test_everyone_arms(cascade):
    assert cascade() == sorted(general(1, 2))


def test_unknown_fund_drops_out(cascade):
    assert cascade(known={"20-81600"}) == [(1, 120, "20-81600"), (2, 120, "20-81600")]


def test_school_arms_reach_the_spouse_and_need_an_active_source(cascade):
    degrees = [
        (1, "OSU-Oklahoma City", "X", None),
        (3, "OSU-Center for Health Sciences", "X", None),
    ]
    city = [(117, "30-88500"), (118, "30-93100")]
    expected = general(1, 2) + [(p, o, f) for p in (1, 2) for o, f in city]
    assert cascade(degrees=degrees) == sorted(expected)


def test_graduate_and_honors_arms_have_no_active_test(cascade):
    education = [
        {PERSON: 3, "school_name": "Oklahoma State University", "degree": "DOCTOR of Music"},
        {PERSON: 3, "school_name": "Oklahoma State University", "degree": "Master of Arts"},
        {PERSON: 2, "school_name": "Elsewhere", "degree": "Master of Arts"},
        {PERSON: 77, "school_name": "Oklahoma State University", "degree": "Masters"},
    ]
    honors = {"attribute_category": "Degree Honors Degree", "attribute_description": "Yes"}
    expected = general(1, 2)
    expected += [(p, 109, "20-94430") for p in (3, 1, 77)] + [(2, 110, "20-29300"), (1, 110, "20-29300")]
    assert cascade(education=education, attributes=[{PERSON: 2, **honors}]) == sorted(expected)


def test_department_and_college_arms(cascade):
    def rule(department, major):
        return {
            "college": "Business",
            "degree_department": department,
            "degree_major_description": major,
            "fund_id1": "F1",
            "fund_id2": "F2",
        }

    degrees = [(1, "Elsewhere", "Business", "Finance")]
    with_major = cascade(degrees=degrees, rules=[rule("Finance", "History")])
    assert with_major == sorted(general(1, 2) + [(2, 101, "F1"), (2, 103, "F2")])
    plain = cascade(degrees=degrees, rules=[rule("Finance", " ")])
    assert plain == sorted(
        general(1, 2) + [(1, 100, "F1"), (1, 102, "F2"), (2, 101, "F1"), (2, 103, "F2")]
    )
    college = cascade(degrees=degrees, rules=[rule(None, None), rule("", "History")])
    assert college == sorted(
        general(1, 2) + [(1, 104, "F1"), (1, 106, "F2"), (2, 105, "F1"), (2, 107, "F2")]
    )


def suggestions(spark, rows):
    return spark.createDataFrame(
        rows,
        f"{PERSON} bigint, fund_identifier string, fund_description string, "
        "designations_order int, data_source string",
    )


def test_dedupe_and_sequence(spark):
    rows = suggestions(
        spark,
        [
            (1, "B", "b", 108, "x"),
            (1, "A", "a", 108, "x"),
            (1, "A", "a", 119, "x"),
            (1, "C", "c", 2, "x"),
            (1, "B", "b", 1, "y"),
            (2, "A", "a", 5, "x"),
        ],
    )
    audience = spark.createDataFrame([(1,)], f"{PERSON} bigint")
    got = funds.dedupe_and_sequence(rows, audience).orderBy("seq").collect()
    assert [(r["fund_identifier"], r["seq"]) for r in got] == [("B", 1), ("C", 2), ("A", 3)]


def test_control_and_test_suggestions(spark, gifts, fund):
    rankings = funds.rank_all(funds.fund_affinity(gifts, fund))
    cascade = suggestions(spark, [(1, "C", "Fund C", 108, "x")])
    control = funds.control_suggestions(rankings, cascade, fund)
    mine = control.where(F.col(PERSON) == 1).collect()
    assert sorted((r["designations_order"], r["fund_identifier"]) for r in mine) == [
        (1, "B"),
        (2, "A"),
        (3, "B"),
        (108, "C"),
    ]
    third = control.where((F.col(PERSON) == 3) & (F.col("designations_order") > 1)).collect()
    assert sorted(r["fund_identifier"] for r in third) == ["A", "B", "C"]
    test = funds.test_suggestions(funds.points_blend(rankings), cascade, fund)
    assert test.where(F.col(PERSON) == 3).count() == 4


def test_pivot_top_n(spark):
    rows = spark.createDataFrame(
        [(1, "A", "a", 1), (1, "B", "b", 2), (1, "C", "c", 4), (2, "D", None, 1)],
        f"{PERSON} bigint, fund_identifier string, fund_description string, seq int",
    )
    got = {r[PERSON]: r.asDict() for r in generic.pivot_top_n(rows, 3).collect()}
    assert (got[1]["fund_id_1"], got[1]["fund_id_2"], got[1]["fund_id_3"]) == ("A", "B", None)
    assert (got[2]["fund_id_1"], got[2]["fund_description_1"]) == ("D", None)


def test_sequences_have_no_gaps(plan):
    summary = plan.final_ranking.groupBy(PERSON).agg(
        F.count("*").alias("n"),
        F.max("seq").alias("last"),
        F.count_distinct("seq").alias("distinct"),
        F.count_distinct("fund_identifier").alias("funds"),
    )
    assert summary.count() > 0
    assert summary.where("n <> last OR n <> distinct OR n <> funds").count() == 0


def test_stages_of_persons_are_not_gathered_in_the_driver(spark, table, person):
    """Packed columns: their files are under the broadcast limit with any number of rows."""
    people = spark.range(200_000).withColumnRenamed("id", PERSON)
    texts = ["school_name", "school_type_trans", "department"]
    degrees = materialize(people.select(PERSON, *[F.lit(f"The same {c}").alias(c) for c in texts]), "degrees", "table")
    pairs = materialize(people.select(PERSON, (F.col(PERSON) + 1).alias("spouse_dim_id")), "pairs", "table")
    constituent = table("constituent", [person(k) for k in (1, 2)])
    education, attribute, departments = (table(n, []) for n in ("education", "education_attribute", "department_fund"))
    eligible = funds.eligibility(constituent, degrees, education, attribute, pairs)
    academic = funds.academic_funds(degrees, departments, pairs, SuggestionPolicy())
    for df in (eligible, academic):
        executed = df._jdf.queryExecution().executedPlan().toString()
        assert f"BroadcastHashJoin [{PERSON}" not in executed and f"SortMergeJoin [{PERSON}" in executed
    got = {r[PERSON]: (r["school_name"], r["spouse_dim_id"]) for r in eligible.collect()}
    assert got == {1: ("The same school_name", 2), 2: ("The same school_name", 3)}


def test_unmapped_translations(table):
    translation = [
        {"fund_identifier": "A", "suggested_fund_identifier": "X"},
        {"fund_identifier": "B", "suggested_fund_identifier": "Y"},
    ]
    got = funds.unmapped_translations(
        table("fund_translation", translation), table("solicitable_fund", [{"designation": "X"}] * 2)
    )
    assert [tuple(r) for r in got.collect()] == [("B", "Y")]


def test_stages_with_one_reader_are_not_written(spark, data_dir, monkeypatch):
    import __spark_entry__ as entry
    from patronage.plans import mailing

    written = []
    monkeypatch.setattr(mailing, "materialize", lambda df, name, mode: (written.append((name, mode)), df)[1])
    entry.queries()["dedupe_sequence"](spark, data_dir)
    modes = dict(written)
    assert {n for n, mode in modes.items() if mode == "lazy"} == {"production_gifts", "giving"}
    assert modes["rankings"] == modes["cascade"] == modes["ledger"] == modes["education"] == "table"
