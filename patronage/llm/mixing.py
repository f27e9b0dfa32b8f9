"""Mixing sources to target weights by a splitting tree.

A source's documents are put in the order of a hash and cut into blocks of about
``BLOCK_DOCS``.  The quota of a source is exact in words: whole rounds over all its
blocks, then blocks in order up to the quota; in the block where it ends documents are
taken in order, the last one in part.

The blocks drawn, counted by source, are dealt to the output shards by a binary tree.
At each node the left half gets a multivariate hypergeometric share: the node's blocks
stand in one row, source by source, and the number of left ones before a place of that
row is found by halving the row, each half's part drawn as a hypergeometric variate from
a hash of the node and the half.  So a node needs no list of its blocks, only the ends
of its sources, and any task finds the same numbers.  Shards then take disjoint runs of a
source's blocks, and within a shard documents sort by a hash.

Defined results: a NULL text has no words and nothing is taken from it; sources sort by
code point, NULL last; a source without words has target 0; equal rows are treated alike,
in the last block they share what is taken of them, rounded down; no rows give none.
Other columns are carried along; of these names, the operator's own replace them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.common import stage, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_DOCS = 64
SUPER = 1024  # blocks per first-level running sum
SHARDS = 64
SEED = 17


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """Add ``target`` to (source, source_size): words, in total as many as there are.

    Weights repeat over the sources in order.  Sources above ``most`` times their size
    stop there and the others share the rest by weight, until none is above.  The driver
    sees two sums a round.
    """
    # one row per source; sources are ranked in one sequence
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage(
        sizes.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int"))),
        "sources",
    )
    cap = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, settled = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        row = ranked.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(full).alias("full"),
        ).first()
        if row["full"] == settled or not row["open"]:
            break
        settled, level = row["full"], (total - row["used"]) / row["open"]
    target = F.least(F.col("weight") * level, cap.cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def _log_factorial(n: Column) -> Column:
    """Exact below 16, then Stirling's series."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
        + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(n < 16, F.log(F.factorial(F.greatest(F.least(n, F.lit(15)), F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times and compute it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(size: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``size`` are among the ``marked``, by inversion.

    Walks the distribution over the mean and nine standard deviations to either side.
    """

    def bounds(q: Column) -> Column:
        mean = q["n"] * q["m"] / q["size"]
        sd = F.sqrt(mean * (q["size"] - q["m"]) / q["size"]) + 1
        least = F.greatest(F.lit(0).cast("long"), q["n"] + q["m"] - q["size"], F.floor(mean - 9 * sd))
        most = F.least(q["n"], q["m"], F.ceil(mean + 9 * sd))
        return _let(F.struct(least.alias("least"), most.alias("most")), lambda b: draw(q, b))

    def draw(q: Column, b: Column) -> Column:
        first = F.exp(
            _log_choose(q["m"], b["least"])
            + _log_choose(q["size"] - q["m"], q["n"] - b["least"])
            - _log_choose(q["size"], q["n"])
        )

        def step(acc: Column, k: Column) -> Column:
            ratio = (q["m"] - k) * (q["n"] - k) / ((k + 1) * (q["size"] - q["m"] - q["n"] + k + 1))
            return _let(acc["p"] * ratio, lambda p: F.struct(
                F.when(acc["sum"] < q["u"], k + 1).otherwise(acc["k"]).alias("k"),
                p.alias("p"),
                (acc["sum"] + p).alias("sum"),
            ))

        walk = F.aggregate(
            F.sequence(b["least"], b["most"] - 1),
            _let(first, lambda p: F.struct(b["least"].alias("k"), p.alias("p"), p.alias("sum"))),
            step,
            lambda acc: acc["k"],
        )
        return F.when(b["most"] > b["least"], walk).otherwise(b["least"])

    given = F.struct(
        size.cast("long").alias("size"), marked.cast("long").alias("m"),
        drawn.cast("long").alias("n"), uniform.alias("u"),
    )
    return _let(given, bounds)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / float(1 << 53)


def _left_before(place: Column, size: Column, half: Column, node: Column) -> Column:
    """How many of the first ``place`` of a node's ``size`` blocks go to its left half.

    The row is halved until the place is a border; each halving draws how many of the
    left ones stand in the first part.
    """

    def halve(acc: Column, _: Column) -> Column:
        length = acc["high"] - acc["low"]
        inside = (place > acc["low"]) & (place < acc["high"]) & (length > 1)
        return F.when(inside, _let(F.floor(length / 2), lambda n: cut(acc, length, n))).otherwise(acc)

    def cut(acc: Column, length: Column, first: Column) -> Column:
        drawn = hypergeometric(
            length, first, acc["left"], _uniform(node, acc["low"], acc["high"])
        )
        middle = acc["low"] + first
        return _let(
            drawn,
            lambda d: F.when(
                place >= middle,
                F.struct(middle.alias("low"), acc["high"].alias("high"),
                         (acc["left"] - d).alias("left"), (acc["before"] + d).alias("before")),
            ).otherwise(
                F.struct(acc["low"].alias("low"), middle.alias("high"), d.alias("left"),
                         acc["before"].alias("before"))
            ),
        )

    zero = F.lit(0).cast("long")
    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(size.cast("double"))) + 1, F.lit(1)).cast("int"))
    return F.aggregate(
        levels,
        F.struct(zero.alias("low"), size.alias("high"), half.alias("left"), zero.alias("before")),
        halve,
        lambda acc: acc["before"] + F.when(place >= acc["high"], acc["left"]).otherwise(F.lit(0)),
    )


def shard_quotas(drawn: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal blocks to shards: (source, first, blocks) -> (source, shard, from_unit, to_unit).

    ``first`` is the number of blocks of the sources before, so the sources stand in one
    row.  ``shards`` is a power of two; their totals differ by one at most.
    """
    total = drawn.agg(F.max(F.col("first") + F.col("blocks"))).first()[0] or 0
    at = drawn.select(
        "source",
        F.lit(1).cast("long").alias("node"),
        F.lit(total).cast("long").alias("size"),
        F.col("first").alias("low"),
        (F.col("first") + F.col("blocks")).alias("high"),
        F.lit(0).cast("long").alias("unit"),
    ).where("high > low")
    for level in range(shards.bit_length() - 1):
        half = F.ceil(F.col("size") / 2)
        split = at.withColumn("half", half).select(
            "*",
            _left_before(F.col("low"), F.col("size"), F.col("half"), F.col("node")).alias("a"),
            _left_before(F.col("high"), F.col("size"), F.col("half"), F.col("node")).alias("b"),
        )
        left = F.struct(
            (2 * F.col("node")).alias("node"), F.col("half").alias("size"), F.col("a").alias("low"),
            F.col("b").alias("high"), F.col("unit").alias("unit"),
        )
        right = F.struct(
            (2 * F.col("node") + 1).alias("node"), (F.col("size") - F.col("half")).alias("size"),
            (F.col("low") - F.col("a")).alias("low"), (F.col("high") - F.col("b")).alias("high"),
            (F.col("unit") + F.col("b") - F.col("a")).alias("unit"),
        )
        at = split.select("source", F.explode(F.array(left, right)).alias("n")).select("source", "n.*")
        at = stage(at.where("high > low"), f"quotas{level}")
    return at.select(
        "source",
        (F.col("node") - shards).alias("shard"),
        F.col("unit").alias("from_unit"),
        (F.col("unit") + F.col("high") - F.col("low")).alias("to_unit"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    shards: int = SHARDS,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` with size, source_size, target and draws.

    ``draws`` is an array of (shard, place, words): the shard a copy goes to, the value it
    sorts by there, and how many of its words it gives.
    """
    own = ("size", "source_size", "target", "draws")
    carry = [c for c in docs.columns if c not in own]
    rows = docs.select(
        *carry,
        F.col(source).alias("_source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(SEED), F.col(key), F.col(text)).alias("_hash"),
    )
    light = stage(rows.select("_source", "size", "_hash"), "sizes")
    sizes = light.groupBy(F.col("_source").alias("source")).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    sizes = stage(sizes, "source_sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    # whole rounds over the source, then a quota of words in the next round
    match = F.col("source").eqNullSafe(F.col("s"))
    planned = (
        sizes.withColumnRenamed("source", "s")
        .join(targets.drop("source_size"), match)
        .drop("s")
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS))
        .withColumn("rounds", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
        .withColumn("quota", F.round("target").cast("long") - F.col("rounds") * F.col("source_size"))
    )
    planned = stage(planned, "planned").withColumnRenamed("source", "_s")

    def with_plan(df: DataFrame) -> DataFrame:
        joined = df.join(planned, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        spot = F.shiftrightunsigned(F.col("_hash"), 11).cast("double") / float(1 << 53)
        return joined.withColumn(
            "block", F.least(F.floor(spot * F.col("n_blocks")), F.col("n_blocks") - 1)
        )

    placed = with_plan(light)
    blocks = placed.groupBy("_source", "block", "rounds", "quota", "n_blocks").agg(
        F.sum("size").alias("words")
    )
    blocks = stage(blocks.withColumn("super", F.floor(F.col("block") / SUPER)), "blocks")
    # running sums in two levels, so that no window holds all blocks of a source
    supers = blocks.groupBy("_source", "super").agg(F.sum("words").alias("words"))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(
        F.col("_source").alias("_s"),
        F.col("super").alias("_u"),
        F.coalesce(F.sum("words").over(prior(Window.partitionBy("_source").orderBy("super"))), F.lit(0)).alias("before"),
    )
    inside = prior(Window.partitionBy("_source", "super").orderBy("block"))
    blocks = blocks.join(
        supers, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("super") == F.col("_u"))
    ).withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    # what the last round takes of the block: all of it, a part, or nothing
    part = F.greatest(F.lit(0), F.least(F.col("quota") - F.col("before"), F.col("words")))
    blocks = stage(
        blocks.select(
            "_source", "block", "n_blocks", "words", part.alias("part"),
            (F.col("rounds") + F.when(part > 0, 1).otherwise(0)).alias("copies"),
        ).where("copies > 0"),
        "drawn",
    )

    drawn = blocks.groupBy("_source").agg(F.sum("copies").alias("blocks"))
    # one row per source
    first = F.sum("blocks").over(prior(Window.orderBy(F.col("_source").asc_nulls_last())))
    drawn = drawn.select(F.col("_source").alias("source"), "blocks", F.coalesce(first, F.lit(0)).alias("first"))
    quotas = shard_quotas(stage(drawn, "row_of_sources"), shards)
    units = quotas.select(
        F.col("source").alias("_s"), "shard", F.explode(F.expr("sequence(from_unit, to_unit - 1)")).alias("unit")
    )
    # the c-th copy of block b is unit c * n_blocks + b of its source; in the last round
    # only the first blocks are drawn, so units have no gaps
    copies = blocks.withColumn("copy", F.explode(F.expr("sequence(0, int(copies) - 1)"))).withColumn(
        "u", F.col("copy") * F.col("n_blocks") + F.col("block")
    )
    dealt = (
        copies.join(units, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("u") == F.col("unit")), "left")
        .groupBy("_source", "block")
        .agg(
            F.max(F.struct("words", "part", "copies")).alias("b"),
            F.sort_array(F.collect_list(F.struct("copy", F.coalesce("shard", F.lit(0)).alias("shard")))).alias("to"),
        )
    )
    dealt = stage(dealt.select(F.col("_source").alias("_s"), F.col("block").alias("_b"), "b", "to"), "dealt")

    # in a source's block where the quota ends, equal rows together, in order
    ends = dealt.where("b.part > 0 AND b.part < b.words").select("_s", "_b", "b.part")
    match = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    last = (
        placed.select("_source", "block", "_hash", "size")
        .join(ends, match)
        .groupBy("_s", "_b", "_hash", "size", "part")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = prior(Window.partitionBy("_s", "_b").orderBy("_hash", "size"))
    gone = F.coalesce(F.sum(F.col("n") * F.col("size")).over(running), F.lit(0))
    each = F.floor(F.greatest(F.lit(0), F.least(F.col("part") - gone, F.col("n") * F.col("size"))) / F.col("n"))
    last = last.select("_s", "_b", F.col("_hash").alias("_h"), F.col("size").alias("_z"), each.alias("partly"))

    with_blocks = with_plan(rows).join(dealt, match, "left").drop("_s", "_b")
    same = (F.col("_hash") == F.col("_h")) & (F.col("size") == F.col("_z"))
    taken = with_blocks.join(last, match & same, "left")

    def draw(copy: Column) -> Column:
        words = F.when(copy["copy"] < F.col("rounds"), F.col("size")).otherwise(
            F.coalesce("partly", "size")
        )
        return F.struct(
            copy["shard"].alias("shard"),
            F.xxhash64(F.lit(SEED + 1), copy["shard"], copy["copy"], F.col("_hash")).alias("place"),
            words.alias("words"),
        )

    draws = F.filter(F.transform("to", draw), lambda d: d["words"] > 0)
    empty = F.array().cast("array<struct<shard:bigint,place:bigint,words:bigint>>")
    return taken.select(
        *carry, "size", "source_size", "target", F.coalesce(draws, empty).alias("draws")
    )
