"""N-gram Jaccard join: candidate pairs of narrow columns, verified, and a blocked sparse
product of documents by n-gram incidence for wide ones.

Rows of the incidence matrix are the distinct sets; equal sets are one row.  Sets are
numbered by half of a 128-bit digest; the other half tells sets of one number apart, which
are then numbered anew.  A set is kept as 64-bit hashes of its shingles, and columns are
ordered by how many sampled rows have them, then by hash.

*Sample*: a row's ``SKETCH`` least hashes.  Of two sets at the threshold, each of the
union's least hashes is in both with the threshold's chance, so two samples share fewer
than ``LEAST_SHARED`` of 128 with a chance below 1e-12; smaller sets are held whole.
*Signature*: one bit of each of 256 minimum hashes.  Sets at the threshold differ in a tenth
of the bits; over ``MOST_DIFFERENT`` of 256 has a chance below 1e-12.  A pair is only made
if sizes and signatures let it reach the threshold; this is tested where columns meet, so
documents that share a passage make no pair.
*Bound*: rows that share s of their sampled columns share one within the first
``size - s + 1`` in the common order, rarest first, so only that many of a row's columns
take part.  A column of one row links nothing and is dropped at once, which ends most rows.

Candidates are made in passes, and whole sets decide on each (no overlap counts are
accumulated outside wide columns).  First each column meets
its least row only, which costs no more than the incidence has entries; sizes bound the
overlap and what cannot reach it is dropped; the rest is verified on whole sets and
components are formed.  While the columns whose rows are still in several components hold
many more pairs across components than entries, such a column meets one other row, chosen
by a hash that changes with the turn; this goes on as long as turns bring the pairs down.
Then columns of up to ``WIDE`` rows give all pairs that are left across components; those
are verified as well.  Wider columns are multiplied in blocks of rows: two blocks that share
a column meet in one task, where signatures tell which rows may link, and meet again with
these rows' whole sets, where overlaps are accumulated and only links come out.  Pairs
inside a component are never listed for the components, so large groups of copies cost in
proportion to their rows.

*Links*: the count of all of a set's links is a product of its own (``link_counts``), over
every column and inside components too.  Blocks give a count for each row and not the
pairs; its work grows with the pairs that are near enough, so it is left out on request.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Defined results: a text of
under five words is one shingle; NULL, empty and blank texts have the empty set and link
to nothing; equal rows link; rows with NULL id take part, and a component's id is the
least id that is not NULL; no rows give none.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, Window

from patronage.llm.common import DROP_SHUFFLES, session_settings, stage
from patronage.llm.components import components

WORDS = 5
PERCENT = 80
SKETCH = 128
LEAST_SHARED = 64
WHOLE_BELOW = 103  # a set under this has all its partners' shared shingles sampled
CACHED_WORDS = 1_000_000
SIGNATURE = 256  # bits
MOST_DIFFERENT = 65
SIGNS = [f"s{i}" for i in range(SIGNATURE // 64)]
WIDE = 64  # rows of a column
BLOCK_ROWS, BLOCK_ENTRIES = 256, 1 << 18  # of a block of rows, about
HUBS = 8  # rows that a group of near copies meets in one turn
PAIRS_AN_ENTRY = 2  # with fewer pairs left across components, all of them are made
LEFT_BY_A_TURN = 0.75  # of the pairs; with more left, turns have ended being of use


class Shingles:
    """64-bit hashes of the distinct word n-grams of texts."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self.known: dict[bytes, int] = {}
        self.factors = np.array(
            [xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(n)], np.uint64
        )

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = len(words) - self.n + 1
        mixed = np.zeros(size, np.uint64)
        for i, factor in enumerate(self.factors):
            mixed += hashes[i : i + size] * factor
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def signature(members: np.ndarray) -> np.ndarray:
    """Four 64-bit words: one bit of the least of each of 256 hashes of the members."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 512):
        part = members[start : start + 512]
        hashed = (part[None, :] ^ FLIPS[:, None]) * FACTORS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    bits = (_mixed(least) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


FLIPS, FACTORS = np.array(
    [[xxhash.xxh3_64_intdigest(b"flip %d" % i), xxhash.xxh3_64_intdigest(b"factor %d" % i) | 1] for i in range(SIGNATURE)],
    np.uint64,
).T.copy()


def set_digest(members: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of a whole set; of the first, ``bits`` bits."""
    first, second = divmod(xxhash.xxh3_128_intdigest(members.tobytes()), 1 << 64)
    return first % (1 << bits) - (1 << 63), second - (1 << 63)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = _signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """``key``, n_shingles, set_id and check (a digest of the whole set) and the sampled hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sets = [shingles.of(t) for t in batch.column("text").to_pylist()]
            digests = [set_digest(s, bits) for s in sets]
            yield pa.record_batch(
                {
                    "k": batch.column("k"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_id": pa.array([d[0] for d in digests], pa.int64()),
                    "check": pa.array([d[1] for d in digests], pa.int64()),
                    "sketch": _lists([s[:SKETCH] for s in sets]),
                }
                | dict(zip(SIGNS, _signed(np.array([signature(s) for s in sets]).reshape(-1, len(SIGNS)).T.copy()), strict=True))
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    schema = f"k {kind}, n_shingles long, set_id long, check long, sketch array<long>, " + ", ".join(f"{s} long" for s in SIGNS)
    return rows.mapInArrow(read, schema).withColumnRenamed("k", key)


@dataclass
class Corpus:
    """Texts, the set of each row, and the sets that are not numbered by their digest."""

    docs: DataFrame
    key: str
    key_sets: DataFrame
    renumbered: DataFrame | None
    bits: int


def _distinct_sets(read: DataFrame, key: str) -> DataFrame:
    """A row for each number, with the least and the greatest check that go by it."""
    return read.where("n_shingles > 0").groupBy("set_id").agg(
        F.min(key).alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.min("check").alias("low"), F.max("check").alias("high"), *[F.first(s).alias(s) for s in SIGNS],
    )


def _renumber(rows: DataFrame, renumbered: DataFrame | None) -> DataFrame:
    """Rows with a set_id and a check, by the number of their own."""
    if renumbered is None:
        return rows
    found = rows.join(renumbered, ["set_id", "check"], "left")
    return found.withColumn("set_id", F.coalesce("own", "set_id")).select(*rows.columns)


def _sets(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """(set_id, members) of the wanted sets, made again from one text of each.

    Only the texts that some candidate pair needs are read a second time.
    """
    key, bits = corpus.key, corpus.bits
    ids = wanted.join(corpus.key_sets, "set_id").groupBy("set_id").agg(F.min(key).alias("k"))
    # NULL ids find each other too
    texts = corpus.docs.join(ids.select("k").distinct(), F.col(key).eqNullSafe(F.col("k")), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sets = [shingles.of(t) for t in batch.column("text").to_pylist()]
            digests = np.array([set_digest(s, bits) for s in sets], np.int64).reshape(-1, 2)
            yield pa.record_batch(
                {"set_id": pa.array(digests[:, 0]), "check": pa.array(digests[:, 1]), "members": _lists(sets)}
            )

    made = texts.select("text").mapInArrow(read, "set_id long, check long, members array<long>")
    # several rows may carry one id; the digest tells whose set it is
    return _renumber(made, corpus.renumbered).groupBy("set_id").agg(F.first("members").alias("members"))


def _can_reach(percent: int) -> Column:
    """Whether the rows (n, s0..) and (m, t0..) may be at the threshold."""
    different = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"t{i}"))) for i, s in enumerate(SIGNS[1:], 1)),
                    F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return sizes & (different <= MOST_DIFFERENT)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("of_b"))
    joined = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return joined.where(100 * shared >= percent * union).select("a", "b")


def entries(rows: DataFrame) -> DataFrame:
    """(gram, set_id, n): the columns of each distinct set that can lead to a pair."""
    sampled = rows.withColumn("sampled", F.size("sketch")).select(
        "set_id", "n", "sampled", F.explode("sketch").alias("gram")
    )
    # the rows of a column are counted beside them; a third of all rows in one column is
    # a count per task and a join that adaptive execution splits
    counts = sampled.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = stage(sampled.join(counts, "gram"), "shared_grams")
    least = F.when(
        F.col("n") < WHOLE_BELOW, F.ceil(F.col("n") * F.lit(PERCENT) / 100)
    ).otherwise(LEAST_SHARED)
    order = Window.partitionBy("set_id").orderBy("held", "gram")  # at most SKETCH rows
    alone = F.col("sampled") - F.count(F.lit(1)).over(Window.partitionBy("set_id"))
    ranked = shared.withColumn("place", F.row_number().over(order) + alone)
    return stage(
        ranked.where(F.col("place") <= F.col("sampled") - least + 1).select("gram", "set_id", "n"), "entries"
    )


def ngram_jaccard_join(
    docs: DataFrame,
    percent: int = PERCENT,
    text: str = "text",
    key: str = "doc_id",
    count_links: bool = True,
    bits: int = 64,
) -> DataFrame:
    """``key``, n_shingles, set_id, component_id of every row, and n_links of its set.

    ``n_links`` counts all other sets that reach the threshold with the row's set; without
    ``count_links`` there is no such column.  Sets are numbered by ``bits`` bits of their digest.
    """
    if percent < PERCENT:
        raise ValueError(f"the sample's bounds hold for {PERCENT} % and more")
    docs = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    with session_settings(docs.sparkSession, DROP_SHUFFLES):
        return _joined(docs, percent, key, count_links, bits)


def _joined(docs: DataFrame, percent: int, key: str, count_links: bool, bits: int) -> DataFrame:
    read = stage(sketches(docs, "text", key, bits), "sketches")
    sets = stage(_distinct_sets(read, key), "sets")
    clashing, renumbered = sets.where("low <> high").select("set_id"), None
    if not clashing.isEmpty():
        own = F.xxhash64("set_id", "check").alias("own")
        renumbered = read.join(clashing, "set_id", "left_semi").where("n_shingles > 0").select("set_id", "check", own)
        renumbered = stage(renumbered.distinct(), "renumbered")
        read = stage(_renumber(read, renumbered), "sketches")
        sets = stage(_distinct_sets(read, key), "sets")
    corpus = Corpus(docs, key, read.select(key, "set_id"), renumbered, bits)
    held = entries(sets)

    signs = sets.select("set_id", *SIGNS)
    held = stage(held.join(signs, "set_id"), "signed_entries")
    tried = stage(_meet(held.withColumn("label", F.col("set_id")), F.col("set_id"), percent), "stars")
    links = stage(_checked(tried, corpus, percent), "links")
    labels = components(links)

    turn, before = 0, None
    while True:
        open_ = _open_columns(held, labels)
        entries_left, pairs_left = _across(open_)
        useless = before is not None and pairs_left > LEFT_BY_A_TURN * before
        if useless or pairs_left <= PAIRS_AN_ENTRY * entries_left:
            break
        turn, before = turn + 1, pairs_left
        hub = F.xxhash64("set_id", F.pmod(F.xxhash64("gram"), F.lit(HUBS)), F.lit(turn))
        met = stage(_meet(open_, hub, percent).join(tried, ["a", "b"], "left_anti"), "met")
        links = stage(links.unionByName(_checked(met, corpus, percent)), "links")
        tried = tried.unionByName(met)
        labels = components(links)

    rows_held = open_.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    wide = open_.join(rows_held.where(F.col("rows") > WIDE), "gram")
    dense = _block_links(stage(wide, "wide_columns"), corpus, percent)
    open_ = open_.join(rows_held.where(F.col("rows") <= WIDE).select("gram"), "gram", "left_semi")
    across = stage(_pairs(open_, percent).join(tried, ["a", "b"], "left_anti"), "across")
    links = links.unionByName(dense).unionByName(_checked(across, corpus, percent))
    links = stage(links.distinct(), "all_links")
    labels = components(links)

    joined = (
        sets.select("set_id", "least")
        .join(labels, F.col("set_id") == F.col("node"), "left")
        .withColumn("label", F.coalesce("label", "set_id"))
        .drop("node")
    )
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stage(joined.drop("least").join(least, "label"), "classes")
    # rows without a set meet no class and stay alone
    out = read.select(key, "n_shingles", "set_id").join(classes, "set_id", "left")
    columns = [
        key,
        "n_shingles",
        "set_id",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"),
    ]
    if count_links:
        out = out.join(link_counts(held, corpus, percent), "set_id", "left")
        counted = F.when(F.col("n_shingles") > 0, F.col("n_links"))
        columns.append(F.coalesce(counted, F.lit(0)).cast("long").alias("n_links"))
    return out.select(*columns)


def link_counts(held: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """(set_id, n_links): with how many other sets each set of the entries reaches the threshold.

    Two rows that are in blocks which meet are counted there; the pairs of narrow columns
    count unless they are such rows.
    """
    held = held.withColumn("label", F.col("set_id"))  # every two sets are apart
    rows_held = held.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    wide = stage(held.join(rows_held.where(F.col("rows") > WIDE), "gram"), "wide_columns")
    rows, meeting, full = _blocks(wide, corpus, percent)
    dense = full.groupBy("x", "y").applyInPandas(
        lambda frame: _counted(_product(frame, percent)), "set_id long, n_links long"
    )
    narrow = held.join(rows_held.where(F.col("rows") <= WIDE).select("gram"), "gram", "left_semi")
    pairs = _pairs(narrow, percent)
    blocks = rows.select(F.col("set_id").alias("a"), F.col("block").alias("p"))
    placed = pairs.join(blocks, "a", "left").join(blocks.select(F.col("a").alias("b"), F.col("p").alias("q")), "b", "left")
    placed = placed.withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q"))
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    known = meeting.select("x", "y", F.lit(True).alias("known"))
    left = placed.join(known, ["x", "y"], "left").where(~(both & F.coalesce("known", F.lit(False)))).select("a", "b")
    links = _checked(stage(left, "narrow_pairs"), corpus, percent)
    ends = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    return stage(dense.unionByName(ends).groupBy("set_id").agg(F.sum("n_links").alias("n_links")), "n_links")


def _counted(links: pd.DataFrame) -> pd.DataFrame:
    ids, n = np.unique(links[["a", "b"]].to_numpy(np.int64), return_counts=True)
    return pd.DataFrame({"set_id": ids, "n_links": n})


def _pairs(held: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the rows of different labels that share a column and may link."""
    other = held.select(
        "gram", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"),
        *[F.col(s).alias(f"t{i}") for i, s in enumerate(SIGNS)],
    )
    return (
        held.withColumnRenamed("set_id", "a")
        .join(other, "gram")
        .where((F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & _can_reach(percent))
        .select("a", "b")
        .distinct()
    )


def _meet(held: DataFrame, order: Column, percent: int) -> DataFrame:
    """(a, b), a < b: each column's first row by ``order`` with its rows of other labels."""
    first = held.withColumn("order", order).groupBy("gram").agg(
        F.min(F.struct("order", "set_id", "label", "n", *SIGNS)).alias("first")
    )
    first = first.select(
        "gram", F.col("first.set_id").alias("hub"), F.col("first.label").alias("other"), F.col("first.n").alias("m"),
        *[F.col(f"first.{s}").alias(f"t{i}") for i, s in enumerate(SIGNS)],
    )
    met = held.join(first, "gram").where((F.col("label") != F.col("other")) & _can_reach(percent))
    return met.select(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b")).distinct()


def _open_columns(held: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries, with their labels, of columns whose rows are in several components."""
    labelled = held.join(labels, F.col("set_id") == F.col("node"), "left").select(
        "gram", "set_id", "n", *SIGNS, F.coalesce("label", "set_id").alias("label")
    )
    labelled = stage(labelled, "labelled")
    apart = labelled.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return stage(labelled.join(apart.select("gram"), "gram", "left_semi"), "open_columns")


def _across(open_: DataFrame) -> tuple[int, float]:
    """How many entries these columns have, and how many pairs across components."""
    rows = F.col("rows").cast("double")
    total = (
        open_.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("gram").agg(F.sum("rows").alias("all"), ((F.sum(rows) * F.sum(rows) - F.sum(rows * rows)) / 2).alias("pairs"))
        .agg(F.sum("all").alias("all"), F.sum("pairs").alias("pairs"))
        .first()
    )
    return total["all"] or 0, total["pairs"] or 0.0


def _block_links(wide: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """Links (a, b) across components of rows that share one of the wide columns."""
    _, _, full = _blocks(wide, corpus, percent)
    found = full.groupBy("x", "y").applyInPandas(lambda frame: _product(frame, percent), "a long, b long")
    return stage(found, "dense_links")


def _blocks(
    wide: DataFrame, corpus: Corpus, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their blocks, the blocks that meet, and the whole sets that may link there."""
    # a row's block is a part of the rows that have the same widest column
    rows = wide.groupBy("set_id").agg(
        *[F.first(c).alias(c) for c in ("n", "label", *SIGNS)],
        F.max(F.struct("rows", "gram")).getField("gram").alias("anchor"),
    )
    sized = rows.groupBy("anchor").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_ENTRIES)).alias("parts")
    )
    block = F.xxhash64("anchor", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    rows = stage(rows.join(sized, "anchor").withColumn("block", block).drop("anchor", "parts"), "rows")
    columns = wide.select("gram", "set_id").join(rows.select("set_id", "block"), "set_id").select("gram", "block").distinct()
    columns = stage(columns, "columns")
    meeting = (
        columns.withColumnRenamed("block", "x").join(columns.withColumnRenamed("block", "y"), "gram")
        .where("x <= y").select("x", "y").distinct()
    )
    meeting = stage(meeting, "meeting")
    sides = meeting.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    near = sides.join(rows, "block").groupBy("x", "y").applyInPandas(
        lambda frame: _may_link(frame, percent), "x long, y long, set_id long"
    )
    near = stage(near, "near_rows")
    sets = stage(_sets(near.select("set_id").distinct(), corpus), "members")
    full = near.join(rows.select("set_id", "label", "block"), "set_id").join(sets, "set_id")
    return rows, meeting, full


def _facing(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of the two blocks, and whether they are one and the same."""
    x, y = frame["x"].iloc[0], frame["y"].iloc[0]
    return frame[frame["block"] == x], frame[frame["block"] == y], bool(x == y)


def _apart(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> np.ndarray:
    apart = left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]
    return np.triu(apart, 1) if same else apart


def _may_link(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of two blocks whose size and signature let them link to another of them."""
    left, right, same = _facing(frame)
    fits = _apart(left, right, same)
    n, m = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    fits &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    different = np.zeros(fits.shape, np.int64)
    for sign in SIGNS:
        s = left[sign].to_numpy().view(np.uint64)[:, None] ^ right[sign].to_numpy().view(np.uint64)[None, :]
        different += np.bitwise_count(s)
    fits &= different <= MOST_DIFFERENT
    ids = np.union1d(left["set_id"].to_numpy()[fits.any(axis=1)], right["set_id"].to_numpy()[fits.any(axis=0)])
    return pd.DataFrame({"x": frame["x"].iloc[0], "y": frame["y"].iloc[0], "set_id": ids})


def _product(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The links of two blocks: overlaps of their rows, accumulated column by column."""
    left, right, same = _facing(frame)
    n, m = (side["members"].map(len).to_numpy(np.int64) for side in (left, right))
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(n) or not len(m):
        return none
    held = np.concatenate(right["members"].to_list())
    order = np.argsort(held, kind="stable")
    held, holder = held[order], np.repeat(np.arange(len(m)), m)[order]
    shared = np.zeros((len(n), len(m)), np.int64)
    for i, members in enumerate(left["members"]):
        begin, end = np.searchsorted(held, members, "left"), np.searchsorted(held, members, "right")
        width = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        shared[i] = np.bincount(holder[at], minlength=len(m))
    links = _apart(left, right, same) & (100 * shared >= percent * (n[:, None] + m[None, :] - shared))
    i, j = np.nonzero(links)
    a, b = left["set_id"].to_numpy()[i], right["set_id"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _checked(pairs: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    return _verify(pairs, stage(_sets(wanted, corpus), "members"), percent)


__all__ = ["Shingles", "entries", "ngram_jaccard_join", "sketches"]
