"""Joins that attach columns to a fact and keep their balance under skew.

``lookup``           plain join.  Spark broadcasts a small side after measuring it
                     and splits skewed partitions at run time (AQE).
``balanced_lookup``  for a base fact joined on a key that may be hot.  A side whose
                     files are under the broadcast limit is left to Spark, which
                     measures it.  A larger one is shuffled with the hot keys salted:
                     their fact rows spread over several tasks, and only those keys'
                     rows of the other side are repeated.
``merged_lookup``    for a stage that has a row for many of the keys.  Spark plans by the size of
                     files, which says little of the rows in them; both sides are shuffled.
``sparse_lookup``    for a key that is NULL on many rows.  Those rows match nothing
                     and are spread instead of meeting in one task.

A key is hot when its rows exceed one partition's share, and it gets as many salts as
it fills partitions.  Both sides look the key up in one list with the join's own
equality, so types and collations that the join takes as equal get the same salts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

PARTITION_ROWS = 1_000_000  # rows of one key that a task takes
SALTS = 32
SKETCHED = 65_536  # values that the sketch of a column holds at most
MOST_HOT = 10_000  # hot values of a column that a sketch gives at most
HOT_BYTES = 64 * 1024  # a list of hot keys is not broadcast where the limit allows less
BROADCAST_DEFAULT = 10 * 1024 * 1024


def source_bytes(df: DataFrame) -> int | None:
    """Size of the tables a DataFrame reads, or None where Spark does not tell.

    Summed over the sources: Catalyst's estimate for a join is the product of its
    sides, which says nothing about a dimension put together from two tables.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    except (AttributeError, PySparkException):
        return None


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_DEFAULT))
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    text = text.strip().lower().removesuffix("b")
    if text[-1:] in units:
        return int(float(text[:-1]) * units[text[-1]])
    return int(text)


def is_small(df: DataFrame) -> bool:
    """Whether everything the side reads stays under Spark's broadcast limit.

    For sides that are unique on their key, which cannot outgrow their sources.
    """
    size = source_bytes(df)
    return size is not None and size <= broadcast_limit(df)


def heavy_hitters(
    df: DataFrame, keys: Sequence[str], partition_rows: int = PARTITION_ROWS
) -> DataFrame:
    """The keys with more than ``partition_rows`` rows, and the salts each needs.

    Counts are combined before the shuffle.  The list is never longer than the rows
    divided by ``partition_rows``, so than the tasks that the join needs anyway.
    """
    keyed = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > partition_rows).select(
        *keys, F.ceil(F.col("_n") / partition_rows).cast("int").alias("_salts")
    )


class HotKeys:
    """The hot values of several columns of a fact, from one scan without a shuffle by value.

    Each task sketches all columns at once (frequent items, at most ``SKETCHED`` values each),
    and the sketches combine.  A value that holds more than a 1/18,000 of the rows is never
    missed, and no count is too low; the 10,000 most frequent come back.  A value that is
    missed is not split, which costs time and no rows.  The scan runs at the first use.
    """

    def __init__(self, fact: DataFrame, columns: Sequence[str]):
        self.fact, self.columns = fact, list(columns)
        self._found: dict[str, list[tuple[object, int]]] | None = None

    def counts(self) -> dict[str, list[tuple[object, int]]]:
        """The frequent values of each column, with counts that are not too low."""
        if self._found is None:
            tops = [
                F.call_function("approx_top_k", F.col(c), F.lit(MOST_HOT), F.lit(SKETCHED)).alias(c)
                for c in self.columns
            ]
            row = self.fact.agg(*tops).first()
            self._found = {
                c: [(top["item"], top["count"]) for top in row[c] if top["item"] is not None] for c in self.columns
            }
        return self._found

    def of(self, keys: Sequence[str], partition_rows: int = PARTITION_ROWS) -> DataFrame | None:
        """Hot keys and their salts, None without any.  Keys of several columns are counted whole."""
        if len(keys) != 1 or keys[0] not in self.columns:
            return heavy_hitters(self.fact, keys, partition_rows)
        hot = [(v, -(-n // partition_rows)) for v, n in self.counts()[keys[0]] if n > partition_rows]
        if not hot:
            return None
        schema = T.StructType(
            [T.StructField(keys[0], self.fact.schema[keys[0]].dataType), T.StructField("_salts", T.IntegerType())]
        )
        # at most MOST_HOT rows
        return F.broadcast(self.fact.sparkSession.createDataFrame(hot, schema))


def frequent_values(fact: DataFrame, columns: Sequence[str], at_least: int) -> DataFrame:
    """Values with ``at_least`` rows or more: ``column``, ``value`` as text, ``rows``, exact.

    A sketch names the candidates of all columns, a second scan counts those alone.  Whole
    where ``at_least`` is over a 1/18,000 of the rows and fewer than ``MOST_HOT`` values
    reach it; raises where it cannot know.
    """
    hot = HotKeys(fact, columns)
    found = {c: [(v, n) for v, n in top if n >= at_least] for c, top in hot.counts().items()}
    full = [c for c, values in found.items() if len(values) >= MOST_HOT - 1]
    if full:
        raise ValueError(f"{MOST_HOT} values or more of {full} have {at_least} rows")
    marks = []
    for c, values in found.items():
        if values:
            one = F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            marks.append(F.when(F.col(c).isin([v for v, _ in values]), one))
    if not marks:
        none = fact.sparkSession.range(0)
        return none.selectExpr("'' AS column", "'' AS value", "id AS rows")
    rows = fact.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m")
    return rows.agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= at_least).select("m.*", "rows")


def _spread(fact: DataFrame, salts: int | Column, by: Sequence[str] | None = None) -> Column:
    """Salt from the row itself, so a recomputed task gives its rows the same salts.

    ``by`` names columns that tell the rows of one key apart.  Give a row id where
    there is one: hashing every column would keep them all from being pruned.
    """
    columns = fact.columns if by is None else by
    return F.pmod(F.xxhash64(*columns), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def salted_join(
    fact: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str,
    measure: DataFrame | HotKeys | None = None,
    by: Sequence[str] | None = None,
    partition_rows: int = PARTITION_ROWS,
) -> DataFrame:
    """Equi-join with the hot keys of ``fact`` spread over as many tasks as they fill.

    Fact rows without a key match nothing and are spread as well.
    """
    keys = list(keys)
    if isinstance(measure, HotKeys):
        hot = measure.of(keys, partition_rows)
    else:
        hot = heavy_hitters(fact if measure is None else measure, keys, partition_rows)
    if hot is None and how == "inner":
        return lookup(fact, side, keys, how)  # drops rows without a key, and keeps the fact where it lies
    if hot is None:
        return sparse_lookup(fact, side, keys, by, SALTS, how)
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_salts")
    if not 0 <= broadcast_limit(fact) < HOT_BYTES:
        # a row for each ``partition_rows`` of the fact at most: neither side is shuffled to be marked
        named = F.broadcast(named)
    unkeyed = reduce(Column.__or__, [F.col(k).isNull() for k in keys])

    def marked(df: DataFrame) -> DataFrame:
        match = reduce(Column.__and__, [df[k] == named[f"_hot_{k}"] for k in keys])
        return df.join(named, match, "left").drop(*[f"_hot_{k}" for k in keys])

    salts = F.coalesce("_salts", F.lit(1))
    left = marked(fact).withColumn(
        "_salt", F.when(unkeyed, _spread(fact, SALTS, by)).otherwise(_spread(fact, salts, by))
    )
    right = marked(side).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def lookup(fact: DataFrame, side: DataFrame, keys: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join ``fact`` to a side on ``keys``."""
    return fact.join(side, _names(keys), how)


def merged_lookup(fact: DataFrame, side: DataFrame, keys: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join with a stage of persons, or another that grows with the keys of ``fact``.

    Packed columns of ids and codes take a thirtieth of their size as rows or less.  By the size of such
    files Spark would gather millions of rows in the driver to broadcast them, and what it
    measures at run time does not take that back.  So both sides are sorted and merged.
    """
    return fact.join(side.hint("merge"), _names(keys), how)


def balanced_lookup(
    fact: DataFrame,
    side: DataFrame,
    keys: str | Sequence[str],
    how: str = "left",
    measure: DataFrame | HotKeys | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Join a fact on a key that may be hot to a side read straight from a table.

    A side whose source files stay under the broadcast limit is left to Spark: it
    broadcasts by its own measure, not by a hint.  Beyond the limit the join is salted.

    ``measure`` is the table to take the hot keys from when ``fact`` is already a
    chain of joins; the chain is then not computed a second time for it.  Give
    :class:`HotKeys` for a fact with several such keys: they share one scan.
    """
    if is_small(side):
        return lookup(fact, side, keys, how)
    return salted_join(fact, side, _names(keys), how, measure, by)


def sparse_lookup(
    fact: DataFrame,
    side: DataFrame,
    keys: str | Sequence[str],
    by: Sequence[str] | None = None,
    salts: int = SALTS * 8,
    how: str = "left",
    flag: str | None = None,
) -> DataFrame:
    """Join, mostly left, on keys that are NULL on many fact rows.

    ``flag`` takes the side's keys alone, each once, and names a column that is true where one
    is found; equal keys meet in the join's own exchange.
    Keyed rows of both sides get salt 0.  It is written as a remainder of the key
    and not as a literal: a literal would be folded out of the join keys, and the
    NULL rows would meet in one task again.
    """
    keys = _names(keys)
    unkeyed = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    keyed = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    left = fact.withColumn("_salt", F.when(unkeyed, _spread(fact, salts, by) + 1).otherwise(keyed))
    right = side.withColumn("_salt", keyed)
    if flag:
        right = right.select(*keys, "_salt").distinct().withColumn(flag, F.lit(True))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
