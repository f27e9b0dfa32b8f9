"""Interval joins, ordered files, ambiguous picks and sketched hot keys, against plain Python."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patronage.operators.audit import ambiguous_picks
from patronage.operators.giving import counted_windows, counted_years, in_counted_windows
from patronage.operators.intervals import in_effect
from patronage.operators.skew import HotKeys, balanced_lookup, frequent_values, salted_join
from patronage.policy import GivingPolicy
from patronage.sources.ordered import order_report, read_ordered, write_ordered


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def pairs(points, windows):
    return sorted(
        (i, w)
        for i, k, at in points
        for w, wk, first, last in windows
        if at is not None
        and k is not None
        and k == wk
        and (first is None or first <= at)
        and (last is None or at <= last)
        and not (first is not None and last is not None and first > last)
    )


@pytest.mark.parametrize("seed", range(4))
def test_in_effect_equals_all_pairs(spark, no_broadcast, seed):
    draw = random.Random(seed)

    def place():
        return draw.choice([None, draw.randint(-50, 50), draw.randint(-(2**39), 2**39), draw.choice([-64, -1, 0, 63, 64])])

    points = [(i, draw.choice(["a", "b", None]), place()) for i in range(120)]
    windows = []
    for w in range(60):
        first = place()
        last = draw.choice([None, first, place(), None if first is None else first + draw.randint(-2, 70)])
        windows.append((w, draw.choice(["a", "b"]), first, last))
    windows.append((60, *windows[0][1:]))
    rows = spark.createDataFrame(points, "i int, k string, at bigint")
    table = spark.createDataFrame(windows, "w int, k string, first bigint, last bigint")
    got = in_effect(rows, table, "at", "first", "last", ["k"]).select("i", "w").collect()
    assert sorted(map(tuple, got)) == pairs(points, windows)


def test_in_effect_of_times_and_odd_tables(spark):
    start = datetime(1969, 12, 30, 23, 59)
    points = [(i, "k", start + timedelta(hours=7 * i)) for i in range(40)] + [(99, "k", None)]
    windows = [(w, "k", start + timedelta(hours=5 * w), start + timedelta(hours=5 * w + 30 * (w % 3))) for w in range(30)]
    rows = spark.createDataFrame(points, "i int, k string, at timestamp_ntz")
    table = spark.createDataFrame(windows, "w int, k string, first timestamp_ntz, last timestamp_ntz")
    got = in_effect(rows, table, "at", "first", "last", ["k"]).select("i", "w").collect()
    assert sorted(map(tuple, got)) == pairs(points, windows)
    assert in_effect(rows, table.limit(0), "at", "first", "last", ["k"]).count() == 0
    assert in_effect(rows.limit(0), table, "at", "first", "last", ["k"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        in_effect(rows, table, "at", "first", "last")
    odd = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "i int, at double")
    bounds = spark.createDataFrame([(1, 1.4, None), (2, 1.6, 2.0)], "w int, first double, last double")
    assert [tuple(r) for r in in_effect(odd, bounds, "at", "first", "last").select("i", "w").collect()] == [(2, 1)]


def test_windows_hold_the_years_of_the_policy(spark):
    draw = random.Random(5)
    policy = GivingPolicy()
    rows = []
    for i in range(400):
        day = date(draw.randint(2004, 2018), draw.choice([6, 7, 7, 1]), draw.choice([1, 19, 20, 21, 30]))
        at = datetime.combine(day, datetime.min.time()) + timedelta(hours=draw.choice([0, 0, 12]))
        rows.append((i, draw.choice([None, 2014, 2016, 2017, 2018]), draw.choice([at, at, at, None])))
    gifts = spark.createDataFrame(rows, "cg_fact_id int, gift_fiscal_year int, gift_date timestamp_ntz")
    want = gifts.withColumn("y", F.explode(counted_years(policy))).select("cg_fact_id", "y.*")
    got = in_counted_windows(gifts, counted_windows(spark, policy)).select("cg_fact_id", "counted_year", "in_grace")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="no windows"):
        counted_windows(spark, GivingPolicy(strict_years=(), grace_years=()))


def test_ambiguous_picks(spark):
    rows = [
        (1, 5, "a"), (1, 5, "b"), (1, 5, "c"),  # tie in front
        (2, 1, "a"), (2, 2, "b"), (2, 2, "c"),  # tie behind the first
        (3, None, "a"), (3, None, "a"),  # NULLs tie, the same row twice
        (4, None, "x"), (4, 0, "y"),
        (5, 1, "alone"),
        (None, 1, "n"), (None, 1, None),
    ]
    df = spark.createDataFrame(rows, "k int, sequence int, v string")
    got = ambiguous_picks(
        df, "s", ["k"], {"sequence": F.col("sequence").asc_nulls_first()}, [F.col("v").asc_nulls_last()], ["v"]
    )
    assert sorted(map(tuple, got.collect())) == [
        ("s", "", "n", "", True),
        ("s", "1", "a", "b", True),
        ("s", "3", "a", "a", False),
    ]
    assert got.limit(0).columns == ["stage", "key", "picked", "other", "differ"]


def test_ordered_files(spark, tmp_path):
    draw = random.Random(2)
    ids = [draw.randint(0, 400) for _ in range(1000)] + [None] * 3
    rows = [(i, n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id int, n int").repartition(7)
    path = str(tmp_path / "ordered")
    order = {"id": F.col("id"), "n": F.col("n")}
    write_ordered(df, path, list(order.values()), files=6, rows_per_file=90)
    report = order_report(spark, path, order).collect()
    assert len(report) > 6 and sum(r["rows"] for r in report) == len(rows)
    assert not any(r["misplaced"] or r["overlaps"] for r in report)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = read_ordered(spark, path).orderBy("position").collect()
    assert [(r["id"], r["n"], r["position"]) for r in got] == [(*r, i) for i, r in enumerate(want, 1)]
    with pytest.raises(Exception, match="already exists"):
        write_ordered(df, path, ["id"])


def test_disorder_is_reported(spark, tmp_path):
    path = str(tmp_path / "unordered")
    spark.range(20).selectExpr("int(20 - id) AS id").coalesce(1).write.parquet(path)
    spark.range(20).selectExpr("int(id) AS id").coalesce(1).write.mode("append").parquet(path)
    report = order_report(spark, path, {"id": F.col("id")}).collect()
    assert sorted(r["misplaced"] for r in report) == [0, 19]
    assert sorted(r["overlaps"] for r in report) == [False, True]


def test_empty_extract_is_ordered(spark, tmp_path):
    path = str(tmp_path / "empty")
    write_ordered(spark.range(0), path, ["id"])
    assert read_ordered(spark, path).collect() == []
    assert order_report(spark, path, {"id": F.col("id")}).collect() == []


def facts(spark):
    return spark.range(3000).selectExpr(
        "id AS n", "CASE WHEN id % 3 = 0 THEN 7L WHEN id % 10 = 1 THEN NULL ELSE id END AS a", "string(id % 50) AS b"
    )


def test_hot_keys_share_one_scan(spark):
    hot = HotKeys(facts(spark), ["a", "b"])
    assert [tuple(r) for r in hot.of(["a"], 400).collect()] == [(7, 3)]
    assert sorted(r[0] for r in hot.of(["b"], 50).collect()) == sorted(str(i) for i in range(50))
    assert hot.of(["b"], 60) is None
    assert hot.of(["a", "b"], 15).columns == ["a", "b", "_salts"]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("partition_rows", [100, 100_000])
def test_join_by_sketch_equals_plain_join(spark, no_broadcast, how, partition_rows):
    fact = facts(spark)
    side = spark.range(0, 3000, 7).selectExpr("id AS a", "id * 2 AS v")
    joined = salted_join(fact, side, ["a"], how, HotKeys(fact, ["a"]), ["n"], partition_rows)
    plain = fact.join(side, "a", how)
    assert sorted(map(str, joined.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert balanced_lookup(fact, side, "a", how, HotKeys(fact, ["a"]), ["n"]).count() == plain.count()


def test_frequent_values(spark):
    got = frequent_values(facts(spark), ["a", "b"], 60)
    # 1000 multiples of three and the seven itself
    want = {("a", "7"): 1001, **{("b", str(i)): 60 for i in range(50)}}
    assert {(r["column"], r["value"]): r["rows"] for r in got.collect()} == want
    assert frequent_values(facts(spark), ["b"], 61).collect() == []
