"""Stores, refreshes, gates in one pass, bitmaps of years, and a warehouse whose texts ignore case."""

import os
import random
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage.operators import funds, generic, giving, quality, refresh, years
from patronage.operators.generic import PERSON
from patronage.operators.stage import materialize
from patronage.operators.store import QualityError, StageStore
from patronage.plans import MailingPlan
from patronage.policy import GivingPolicy
from patronage.sources import SCHEMAS, Warehouse, normalise
from patronage.sources.retail import retail_warehouse


def folder(spark, store):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{store.database}"


@pytest.mark.parametrize("key", [["k"], []])
def test_a_stage_that_breaks_its_rules_stops_and_leaves_nothing(spark, key):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "c"), (None, "d")], "k long, v string")
    with StageStore(spark, 3) as store:
        store.table("x")
        with pytest.raises(QualityError) as broken:
            store.keep("x", rows, key, key, ["v", "k"])
        nulls = [("not null", "v", 1), ("not null", "k", 2)]
        assert broken.value.violations == nulls + ([("unique", "k", 2)] if key else [])
        assert spark.catalog.listTables(store.database) == []
        good = store.keep("x", rows.where("v IN ('a', 'b')"), key, key, ["v", "k"])
        assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, "b")]
        assert good.columns == ["k", "v"]
        assert store.keep("none", rows.limit(0), key, key, ["v"]).count() == 0
    assert not os.path.exists(folder(spark, store))


def test_rules_need_the_buckets_key(spark):
    with pytest.raises(ValueError, match="is not part of"):
        StageStore(spark).keep("x", spark.range(1), ["id"], ["other"])


def test_a_stage_is_written_again_only_if_its_plan_or_files_change(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    with StageStore(spark, 2) as store:
        read = lambda: spark.read.parquet(path)
        store.keep("x", read().where("id > 1"), ["id"], ["id"])
        assert store.keep("x", read().where("id > 1"), ["id"], ["id"]).count() == 3
        assert store.written == ["x"]
        assert store.keep("x", read().where("id > 2"), ["id"], ["id"]).count() == 2
        spark.range(100).write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)
        assert store.keep("x", read().where("id > 2"), ["id"], ["id"]).count() == 97
        assert store.written == ["x"] * 3


def test_the_extract_joins_stages_of_persons_without_an_exchange(spark, data_dir, plan):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with StageStore(spark) as store:
            mailing = MailingPlan(retail_warehouse(spark, data_dir), store=store)
            rows = mailing.extract_rows
            text = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in text and text.count("SortMergeJoin") == 11
            assert sorted(map(str, rows.collect())) == sorted(map(str, plan.extract_rows.collect()))
            written = len(store.written)
            MailingPlan(retail_warehouse(spark, data_dir), store=store).extract_rows.count()
            assert len(store.written) == written
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_table_near_a_key_is_joined_without_an_exchange_and_leaves_no_name(spark):
    rows = spark.createDataFrame([(i % 7 or None, f"v{i}") for i in range(40)], "k long, v string")
    side = spark.createDataFrame([(i, i * 2) for i in range(7)], "k long, n long")
    kept = materialize(rows, "near", "table", ["k"])
    assert kept.columns == rows.columns and Counter(kept.collect()) == Counter(rows.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("near")]
    joined = kept.join(side.hint("merge"), "k", "left")
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1
    assert Counter(joined.collect()) == Counter(rows.join(side, "k", "left").collect())


def test_a_repeated_person_stops_the_mailing(spark, data_dir):
    wh = retail_warehouse(spark, data_dir)
    tables = {name: wh[name] for name in SCHEMAS}
    tables["manager"] = tables["manager"].unionByName(tables["manager"].limit(1))
    with StageStore(spark) as store, pytest.raises(QualityError, match="figures_0"):
        _ = MailingPlan(Warehouse.from_tables(tables), store=store).extract_rows


def test_check_all_counts_every_rule(spark):
    a = spark.createDataFrame([(1, "x", date(2020, 1, 1)), (1, "X", None), (None, None, None), (None, None, None)],
                              "k long, t string, d date")
    collated = a.withColumn("t", F.collate("t", "UTF8_LCASE"))
    checks = [
        quality.Check(a, "a", ["k"], ["k", "t"]), quality.Check(a, "pair", ["k", "t"], ["d"]),
        quality.Check(collated, "lower", ["k", "t"]), quality.Check(a.limit(0), "empty", ["k"], ["t"]),
    ]
    got = {(r["stage"], r["rule"], r["columns"]): r["violations"] for r in quality.check_all(checks).collect()}
    assert got == {
        ("a", "unique", "k"): 2, ("a", "not null", "k"): 2, ("a", "not null", "t"): 2, ("pair", "unique", "k, t"): 1,
        ("pair", "not null", "d"): 3, ("lower", "unique", "k, t"): 2, ("empty", "unique", "k"): 0, ("empty", "not null", "t"): 0,
    }
    rows = generic.union_all([quality.violations(c.df, c.stage, c.unique, c.not_null) for c in checks]).collect()
    assert {(r["stage"], r["rule"], r["columns"]): r["violations"] for r in rows} == got


def test_year_bitmaps_equal_sets(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(9), rng.choice([1919, 1920, 1983, 1984, 2015, 2016, 2017, 2047, 2048, None]), rng.random() < 0.7)
            for _ in range(120)]
    df = spark.createDataFrame(rows, "p long, fiscal_year int, own boolean")
    sets = {"every": F.lit(True), "own": F.col("own")}
    parts = [years.year_bitmaps(df.where(c), ["p"], sets) for c in ("p % 2 = 0 OR own", "NOT (p % 2 = 0 OR own)", "own")]
    whole = years.unite(parts, ["p"], ["every", "own"])
    got = whole.groupBy("p").agg(
        years.count_years("every"), years.count_years("own"), years.last_year("own"),
        years.last_year("every", but=[2047, 2048]), years.has_year("own", [1983, 2016]), years.has_year("every", []),
    )
    expected = set()
    for p in {r[0] for r in rows}:
        every = {y for q, y, _ in rows if q == p and y}
        own = {y for q, y, o in rows if q == p and o and y}
        if every:
            left = every - {2047, 2048}
            expected.add((p, len(every), len(own) or None, max(own, default=None), max(left, default=None), bool(own & {1983, 2016}), False))
    assert {tuple(r) for r in got.collect()} == expected


def giving_of(plan, ledger):
    w = plan.wh

    def compute(policy):
        return giving.giving_per_fiscal_year(
            ledger(), w.constituent, w.gift, w.gift_attribute, w.gift_commitment, w.recurring_gift, w.installment_payment,
            w.calendar, plan.projections, policy,
        )

    return compute


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def files_of(spark, table):
    return {f for f in spark.table(table).inputFiles()}


def test_two_refreshed_years_equal_a_full_run_and_again(spark, plan):
    years_kept = GivingPolicy(strict_years=(2016, 2017), grace_years=(2014, 2015))
    late = F.col("gift_fiscal_year") == 2017
    state = {"ledger": plan.ledger.where(~late)}
    compute = giving_of(plan, lambda: state["ledger"])
    with StageStore(spark) as store:
        table = refresh.GivingTable(spark, store.table("giving"), compute, years_kept)
        table.build()
        untouched = {f for f in files_of(spark, table.name) if "=2014" in f}
        state["ledger"] = plan.ledger
        lineage = giving.commitment_lineage(plan.wh.installment_payment, plan.wh.gift, plan.wh.calendar)
        realized = giving.realized_planned_gift_date(plan.ledger, plan.wh.gift, plan.wh.gift_attribute, plan.wh.calendar)
        touched = refresh.touched_years(
            plan.ledger, plan.ledger.where(late).select("gift_fact_id"), lineage, realized, plan.ledger.where(~late), years_kept
        )
        assert 2017 in touched
        full = rows_of(compute(years_kept))
        assert rows_of(table.refresh(touched)) == full
        if 2014 not in touched:
            assert {f for f in files_of(spark, table.name) if "=2014" in f} == untouched
        assert rows_of(table.refresh(touched)) == full
        assert rows_of(table.refresh([1999])) == full


def test_a_year_that_lost_its_gifts_goes(spark, plan):
    policy = GivingPolicy(strict_years=(2016, 2017), grace_years=(2015,))
    state = {"ledger": plan.ledger}
    w = plan.wh

    def compute(p):
        return giving.giving_per_fiscal_year(
            state["ledger"], w.constituent, w.gift, w.gift_attribute, w.gift_commitment, w.recurring_gift,
            w.installment_payment, w.calendar, None, p,
        )

    with StageStore(spark) as store:
        table = refresh.GivingTable(spark, store.table("giving"), compute, policy)
        assert table.build().where("fiscal_year = 2016").count() > 0
        state["ledger"] = plan.ledger.where("gift_fiscal_year <> 2016")
        left = table.refresh([2016, 2017])
        assert left.where("fiscal_year = 2016").count() == 0
        assert rows_of(left.where("fiscal_year = 2017")) == rows_of(compute(refresh.years_policy(policy, [2017])))


def test_touched_years_follow_commitments_and_planned_gifts(spark):
    ledger = spark.createDataFrame(
        [(1, 7, 2015, "2014-12-01"), (2, 8, 2016, "2015-12-01"), (3, 7, 2017, "2016-12-01"), (4, 9, 2014, "2013-12-01")],
        f"gift_fact_id long, {PERSON} long, gift_fiscal_year int, d string",
    ).withColumn("gift_date", F.col("d").cast("timestamp_ntz"))
    lineage = spark.createDataFrame([(2, 1, 2015)], "gift_fact_id long, commitment_gift_fact_id long, pledge_fiscal_year int")
    realized = spark.createDataFrame([(3,), (4,)], "gift_fact_id long")
    policy = GivingPolicy(strict_years=(2016, 2017), grace_years=(2014, 2015))
    changed = lambda *ids: spark.createDataFrame([(i,) for i in ids], "gift_fact_id long")
    touched = lambda ids, before=None: refresh.touched_years(ledger, ids, lineage, realized, before, policy)
    assert touched(changed(1)) == [2015, 2016, 2017]  # itself, its payment, its giver's realised gift
    assert touched(changed(2)) == [2016]
    assert touched(changed(99)) == []
    moved = ledger.where("gift_fact_id = 2").withColumn("gift_fiscal_year", F.lit(2017))
    assert touched(changed(2), moved) == [2016, 2017]


def test_the_whole_extract_ignores_case_where_the_warehouse_does(spark, data_dir, plan):
    """Keys are narrower than declared and texts are collated; rows stay those of the plain plan."""
    wh = retail_warehouse(spark, data_dir)

    def narrow(df):
        return df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "bigint" else f.name for f in df.schema.fields])

    collated = Warehouse(lambda name: normalise(narrow(wh[name]), "UTF8_LCASE", SCHEMAS[name]))
    mailing = MailingPlan(collated, stage_mode="table")
    assert {f.dataType.simpleString() for f in collated.gift.schema.fields if f.name == "gift_fact_id"} == {"bigint"}
    got, expected = (sorted(map(str, p.extract_rows.collect())) for p in (mailing, plan))
    assert got == expected
    assert mailing.cascade.schema["fund_identifier"].dataType.collation == "UTF8_LCASE"
    assert mailing.violations.count() == plan.violations.count()


def test_the_audit_takes_its_test_group_from_the_policy(plan):
    def found(segment):
        rows = funds.unsolicitable_suggestions(
            plan.control_ranking, plan.final_ranking, plan.segments, plan.wh.fund, plan.wh.fund_attribute, plan.solicitable,
            test_segment=segment,
        )
        return {r["fund_identifier"] for r in rows.collect()}

    open_ = {r[0] for r in plan.solicitable.select("fund_identifier").collect()}
    segments = plan.segments.select(PERSON, "marketing_segment")
    for segment in ("Test Array", plan.policy.segments.current):
        expected = set()
        for ranking, group in ((plan.control_ranking, F.col("marketing_segment") != segment), (plan.final_ranking, F.col("marketing_segment") == segment)):
            rows = ranking.where("seq <= 10").join(segments.where(group), PERSON)
            expected |= {r[0] for r in rows.select("fund_identifier").collect()}
        known = {r[0] for r in plan.wh.fund.select("fund_identifier").collect()}
        assert found(segment) == (expected & known) - open_


def test_check_all_groups_by_the_keys_own_types(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, -0.0), (None, 1.0), (None, 1.0)], "k long, x double")
    found = quality.check_all([quality.Check(rows, "a", ["k", "x"], ["k"]), quality.Check(rows, "no key", [], ["k"])])
    assert "to_json" not in found._jdf.queryExecution().analyzed().toString()
    got = sorted((r["stage"], r["rule"], r["violations"]) for r in found.collect())
    assert got == [("a", "not null", 2), ("a", "unique", 2), ("no key", "not null", 2)]


def test_the_extract_is_joined_in_steps(plan):
    """A stage of few joins needs the memory of few sorts."""
    names = [f.rsplit("/", 2)[-2].partition("-")[0] for f in plan.extract_rows.inputFiles()]
    assert "people_8" in names


def test_a_stage_kept_as_a_table_is_written_with_zstd(spark):
    kept = materialize(spark.range(10), "packed", "table")
    assert kept.inputFiles() and all(".zstd.parquet" in f for f in kept.inputFiles())
