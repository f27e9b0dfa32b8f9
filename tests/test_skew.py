import pytest
from pyspark.sql import functions as F

from patronage.operators import skew


@pytest.fixture
def hot(spark):
    """One key with a third of the rows, many NULLs, and a side that misses some keys."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(7)).when(n % 3 == 1, n).otherwise(F.lit(None))
    fact = spark.range(3000).select(n.alias("row"), key.cast("bigint").alias("k"))
    side = spark.range(0, 2000).select(n.alias("k"), (n * 10).alias("v")).where("k % 5 <> 0")
    return fact, side


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


HOW = ["inner", "left", "left_semi", "left_anti"]


@pytest.mark.parametrize("how", HOW)
def test_salted_join_equals_plain_join(hot, how):
    fact, side = hot
    salted = skew.salted_join(fact, side, ["k"], how, partition_rows=50)
    assert rows(salted) == rows(fact.join(side, ["k"], how))


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize(("ours", "theirs"), [("int", "bigint"), ("decimal(12,0)", "bigint"), ("bigint", "int")])
def test_salted_join_of_mixed_types_equals_plain_join(hot, how, ours, theirs):
    fact, side = hot
    fact = fact.withColumn("k", F.col("k").cast(ours))
    side = side.withColumn("k", F.col("k").cast(theirs))
    salted = skew.salted_join(fact, side, ["k"], how, partition_rows=50)
    assert rows(salted) == rows(fact.join(side, ["k"], how))


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UTF8_LCASE_RTRIM"])
def test_salted_join_of_collated_keys_equals_plain_join(spark, how, collation):
    name = f"string collate {collation}"
    hot = F.when(F.col("id") % 2 == 0, "Key").when(F.col("id") % 5 == 0, "KEY ").otherwise("b")
    fact = spark.range(1000).select(F.col("id").alias("row"), hot.cast(name).alias("k"))
    side = spark.createDataFrame([("key", 1), ("B ", 2)], "k string, v int")
    side = side.withColumn("k", F.col("k").cast(name))
    salted = skew.salted_join(fact, side, ["k"], how, by=["row"], partition_rows=50)
    assert rows(salted) == rows(fact.join(side, ["k"], how))


def test_salted_join_measures_another_table(hot):
    fact, side = hot
    salted = skew.salted_join(fact, side, ["k"], "left", fact.select("k"), partition_rows=50)
    assert rows(salted) == rows(fact.join(side, ["k"], "left"))


def test_an_inner_join_without_hot_keys_leaves_the_fact_where_it_lies(hot):
    fact, side = hot
    placed = fact.where("k IS NOT NULL").repartition(4, "k")
    joined = skew.salted_join(placed, side, ["k"], "inner", skew.HotKeys(fact, ["k"]))
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined) == rows(fact.join(side, ["k"]))


def test_hot_keys_are_marked_without_a_shuffle_of_the_fact(spark, hot):
    fact, side = hot
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.salted_join(fact, side, ["k"], "left", partition_rows=50)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("BroadcastHashJoin") == 2 and physical.count("SortMergeJoin") == 1


def test_hot_keys_get_salts_by_their_size(hot):
    fact, _ = hot
    assert [tuple(r) for r in skew.heavy_hitters(fact, ["k"], 300).collect()] == [(7, 4)]


def test_filter_above_a_salted_join_reaches_the_scan(spark, hot, tmp_path):
    fact, side = hot
    fact.withColumn("year", F.lit(3)).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    joined = skew.salted_join(fact, side, ["k"], "left", by=["row"]).where("year = 3")
    assert "EqualTo(year,3)" in joined._jdf.queryExecution().executedPlan().toString()


def test_hot_rows_spread_over_salts(hot):
    fact, side = hot
    spread = fact.where("k = 7").select(skew._spread(fact, 32).alias("s"))
    assert spread.distinct().count() > 16


def test_sparse_lookup_equals_left_join_and_spreads_null_keys(spark, hot):
    fact, side = hot
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.sparse_lookup(fact, side, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [k" in plan and "_salt" in plan.split("SortMergeJoin")[1].split("]")[0]
        assert rows(joined) == rows(fact.join(side, ["k"], "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_balanced_lookup_salts_a_large_side_only(spark, hot, tmp_path):
    fact, side = hot
    side.write.parquet(str(tmp_path / "side"))
    side = spark.read.parquet(str(tmp_path / "side"))

    def salted():
        joined = skew.balanced_lookup(fact, side, "k")
        assert rows(joined) == rows(fact.join(side, ["k"], "left"))
        plan = joined._jdf.queryExecution().analyzed().toString()
        assert "strategy=broadcast" not in plan
        return "_salt" in plan

    assert not salted()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert salted()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", HOW)
def test_merged_lookup_equals_plain_join(hot, how):
    fact, side = hot
    assert rows(skew.merged_lookup(fact, side, "k", how)) == rows(fact.join(side, ["k"], how))


@pytest.mark.parametrize(
    ("text", "size"), [("10485760b", 10485760), ("10MB", 10485760), ("-1", -1), ("2g", 2**31)]
)
def test_broadcast_limit(spark, text, size):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
    try:
        assert skew.broadcast_limit(spark.range(1)) == size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
