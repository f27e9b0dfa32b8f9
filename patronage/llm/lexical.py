"""Ranked lexical search by presence masks.

Documents are read once, into blocks of at most ``BLOCK_DOCS`` documents or
``BLOCK_POSTINGS`` postings; a block holds, for each term that an item asks for, the
places of the documents with it and how often.  The statistics of the corpus are sums
over the blocks.  In each block and for each item, one bit a term is set in the masks of
the documents that hold it.  Documents with equal masks are a group, whose score is at
most the sum of its terms' largest contributions in the block.  Groups are scored in
falling order of that bound until it is below the score of the k-th best found so far; a
bound that equals it is still scored, as an equal score may win by its smaller key.

A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; its contribution is that times
``1000000000 tf div (1000 tf + 8 m)``, ``m = 10 + 90 n N div L``, all in 64-bit integers.

Items are taken in turns of at most about ``TURN_TERMS`` pairs of item and term, which are
what the driver holds and sends out; the documents are read once a turn.

Defined results: NULL and empty texts have no terms and neither count nor match; an item
without terms has no rows; an item's repeated rows are one item with all their terms; a
NULL item key is an item; rows that repeat a document's key are documents of their own;
equal scores rank by key, NULL first; no documents or no items give none.  Only keys and
texts are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.common import stage

BLOCK_DOCS = 4096
BLOCK_POSTINGS = 2_000_000
TURN_TERMS = 500_000
READ = 1 << 20  # bytes of a text cut into terms together
# letters, digits and all beyond ASCII stay, A to Z lower-cased; the rest parts terms
TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in bytes(range(256)).lower()
)


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in order, some at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + READ)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@dataclass
class Block:
    """Documents (key, number of terms) and the postings of the terms asked for.

    ``rows`` and ``counts`` are sorted by term; the postings of ``terms[i]`` end at
    ``ends[i]``.
    """

    keys: list
    lengths: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    counts: np.ndarray


def index_blocks(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Blocks of the documents, each with its part of the corpus's statistics."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        keys: list = []
        lengths: list[int] = []
        found: list[tuple[int, int, int]] = []  # term, row, count
        n_docs = n_terms = 0

        def flush() -> pa.RecordBatch:
            at = np.array(found, np.int64).reshape(-1, 3)
            at = at[np.lexsort((at[:, 1], at[:, 0]))]
            terms, first = np.unique(at[:, 0], return_index=True)
            ends = np.append(first[1:], len(at)).astype(np.int64) if len(terms) else first
            made = pa.table(
                {
                    "n_docs": pa.array([n_docs], pa.int64()),
                    "n_terms": pa.array([n_terms], pa.int64()),
                    "keys": pa.array([keys], pa.list_(key_type)),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "terms": pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                    "ends": pa.array([ends], pa.list_(pa.int64())),
                    "places": pa.array([at[:, 1].astype("<u4").tobytes()], pa.binary()),
                    "counts": pa.array([at[:, 2].astype("<u4").tobytes()], pa.binary()),
                }
            )
            keys.clear(), lengths.clear(), found.clear()
            return made.to_batches()[0]

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field("k").type
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                held: Counter = Counter()
                for part in term_lists(t):
                    held.update(map(get, part))
                n = held.total()
                if not n:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + n
                held.pop(None, None)
                if held:
                    place = len(keys)
                    keys.append(k)
                    lengths.append(n)
                    found.extend((term, place, count) for term, count in held.items())
                    if len(keys) >= BLOCK_DOCS or len(found) >= BLOCK_POSTINGS:
                        yield flush()
                        n_docs = n_terms = 0
        if n_docs:
            yield flush()

    schema = (
        f"n_docs long, n_terms long, keys array<{kind}>, lengths array<long>, terms array<int>, "
        "ends array<long>, places binary, counts binary"
    )
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(build, schema)


def contributions(block: Block, weights: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What each posting adds to its document's score."""
    # in Python's integers: 90 n N may pass 64 bits
    m = np.array([10 + 90 * n * total_docs // total_terms for n in block.lengths.tolist()], np.int64)
    tf = block.counts.astype(np.int64)
    of = np.repeat(weights[block.terms], np.diff(block.ends, prepend=0))
    return of * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[block.rows]))


class Best:
    """The k best (score, key) so far: larger scores first, then smaller keys."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, keys: Sequence) -> None:
        rows = [*self.rows, *zip(scores.tolist(), keys, strict=True)]
        self.rows = heapq.nsmallest(self.k, rows, key=lambda r: (-r[0], r[1] is not None, r[1]))


def search_block(block: Block, added: np.ndarray, asked: np.ndarray, best: Best) -> int:
    """Bring the best of a block for the terms ``asked``; the number of documents scored."""
    at = np.searchsorted(block.terms, asked)
    at = at[(at < len(block.terms)) & (block.terms[np.minimum(at, len(block.terms) - 1)] == asked)]
    if not len(at):
        return 0
    starts = np.where(at > 0, block.ends[at - 1], 0)
    postings = [slice(s, e) for s, e in zip(starts.tolist(), block.ends[at].tolist(), strict=True)]
    most = np.array([added[p].max() for p in postings])
    if most.sum() < best.floor:
        return 0
    words = (len(at) + 63) // 64
    masks = np.zeros((len(block.keys), words), "<u8")
    for j, p in enumerate(postings):
        masks[block.rows[p], j // 64] |= np.uint64(1 << j % 64)
    own = masks[:, 0] if words == 1 else masks.view(f"V{8 * words}")[:, 0]
    distinct, group = np.unique(own, return_inverse=True)
    bits = np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, bitorder="little")
    bounds = bits[:, : len(at)].astype(np.int64) @ most
    falling = np.argsort(-bounds, kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[falling] = np.arange(len(distinct))
    turn = place[group]  # of each document: when its mask's turn comes
    by_turn = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn, minlength=len(distinct)))
    bounds = bounds[falling]
    done, scored, many = 0, 0, 1
    while done < len(distinct) and bounds[done] >= best.floor:
        last = min(done + many, len(distinct))
        # no mask below the floor joins the turn
        last = done + int(np.searchsorted(-bounds[done:last], -best.floor, side="right"))
        docs = np.sort(by_turn[(ends[done - 1] if done else 0) : ends[last - 1]])
        scores = np.zeros(len(docs), np.int64)
        for p in postings:
            rows = block.rows[p]
            i = np.minimum(np.searchsorted(rows, docs), len(rows) - 1)
            scores += np.where(rows[i] == docs, added[p][i], 0)
        good = np.flatnonzero(scores >= best.floor)
        best.add(scores[good], [block.keys[i] for i in docs[good].tolist()])
        done, scored, many = last, scored + len(docs), many * 2
    return scored


def _search(
    blocks: DataFrame, items: dict, weights: np.ndarray, totals: tuple[int, int], k: int, kinds: tuple[str, str]
) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast((list(items), list(items.values()), weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, own_weights = sent.value
        best = [Best(k) for _ in names]
        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block = Block(
                    row["keys"].as_py(),
                    row["lengths"].values.to_numpy(),
                    row["terms"].values.to_numpy(),
                    row["ends"].values.to_numpy(),
                    np.frombuffer(row["places"].as_py(), "<u4"),
                    np.frombuffer(row["counts"].as_py(), "<u4"),
                )
                if not len(block.keys):
                    continue
                added = contributions(block, own_weights, *totals)
                for terms, found in zip(asked, best, strict=True):
                    search_block(block, added, terms, found)
        rows = [(name, key, score) for name, b in zip(names, best, strict=True) for score, key in b.rows]
        yield pa.record_batch(
            {
                "item": pa.array([r[0] for r in rows]) if rows else pa.array([], pa.null()),
                "k": pa.array([r[1] for r in rows], key_type),
                "score": pa.array([r[2] for r in rows], pa.int64()),
            }
        )

    return blocks.drop("n_docs", "n_terms").mapInArrow(search, f"item long, k {kinds[1]}, score long")


def _pairs(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """Distinct (item, term) of all items."""
    kind = items.schema[item_key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("t").to_pylist()):
                terms = sorted({x for part in term_lists(t) for x in part})
                if terms:
                    keys = batch.column("item").slice(i, 1).take(pa.array([0] * len(terms)))
                    yield pa.record_batch({"item": keys, "term": pa.array(terms, pa.binary())})

    rows = items.select(F.col(item_key).alias("item"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(cut, f"item {kind}, term binary").distinct()


def _turns(pairs: DataFrame) -> tuple[Column, int]:
    """A number for each item, and how many, so that no turn holds many over ``TURN_TERMS`` pairs."""
    items, total = pairs.agg(F.count_distinct(F.struct("item")), F.count("*")).first()
    turns = max(1, -(-total // TURN_TERMS))
    while True:
        turn = F.pmod(F.xxhash64("item"), F.lit(turns))
        most = pairs.groupBy(turn).count().agg(F.max("count")).first()[0] or 0
        if most <= 2 * TURN_TERMS or turns >= items:
            return turn, turns
        turns *= 2


def lexical_search(
    items: DataFrame,
    docs: DataFrame,
    k: int = 10,
    item_key: str = "item_id",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Each item's ``k`` best documents: item key, rank, document key, score."""
    pairs = stage(_pairs(items, item_key, text), "item_terms")
    kinds = items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    turn, turns = _turns(pairs)
    found = [_one_turn(pairs.where(turn == i), docs, k, key, text, kinds) for i in range(turns)]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("k"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("k").alias(key), "score")


def _one_turn(
    pairs: DataFrame, docs: DataFrame, k: int, key: str, text: str, kinds: tuple[str, str]
) -> DataFrame:
    asked = pairs.collect()  # bounded by TURN_TERMS
    vocabulary = sorted({bytes(r["term"]) for r in asked})
    known = {term: i for i, term in enumerate(vocabulary)}
    items: dict = {}
    for r in asked:
        items.setdefault(r["item"], []).append(known[bytes(r["term"])])
    names = list(items)
    blocks = stage(index_blocks(docs, known, key, text), "lexical")
    total_docs, total_terms = (x or 0 for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    sizes = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    held = blocks.select(F.explode(F.arrays_zip("terms", sizes.alias("n"))).alias("p"))
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in held.groupBy("p.terms").agg(F.sum("p.n")).collect():
        df[term] = n
    weights = np.array(
        [math.floor(1000 * math.log((2 * total_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64
    )
    numbered = {i: np.array(sorted(items[name]), np.int32) for i, name in enumerate(names)}
    found = _search(blocks, numbered, weights, (total_docs, total_terms), k, kinds)
    by_number = pairs.sparkSession.createDataFrame(list(enumerate(names)), f"number long, own {kinds[0]}")
    return found.join(F.broadcast(by_number), F.col("item") == F.col("number")).select(
        F.col("own").alias("item"), "k", "score"
    )
