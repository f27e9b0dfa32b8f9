"""Best-fit packing of token sequences by patterns.

Documents longer than a sequence are cut into full pieces behind one shorter first
piece, so one histogram of lengths, of fixed size, holds all there is to know.  On it:

1. patterns of two or three lengths that fill a sequence exactly are enumerated;
2. non-negative least squares fits repeat counts of the patterns to the histogram;
3. the counts are rounded down, the largest first, while stock lasts;
4. what is left is packed by best fit, longest first, again by length and not by piece.

The plan says, for each length, which ranks go to which sequences and at what offset.
A piece finds its place by its rank among pieces of its length.  Ranks come from counts
per (length, block of rows), so neither a common length nor copies meet in one task.

Defined results: a NULL text counts as empty, so it is the end token alone; repeated
rows are packed each for itself; no rows give none.  Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from patronage.llm.common import stage
from patronage.llm.token_fst import encode_texts

CAPACITY = 2048
END_ID = 0
SPREAD = 16  # triples per longest length
FIT_STEPS = 300
STRENGTHS = (1.0, 0.9, 0.75, 0.5)
BLOCKS = 4096


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """The pieces of every document: ``key``, piece, start, length, ids_crc32, block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode_texts(batch.column("text").to_pylist(), tokenizer)):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                size = len(data) // 4
                ends = range((size - 1) % capacity + 1, size + 1, capacity)
                for number, end in enumerate(ends):
                    begin = max(0, end - capacity)
                    rows.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(data[4 * begin : 4 * end]))
            yield pa.record_batch(
                {
                    "k": batch.column("k").take(pa.array(rows, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    cut_rows = rows.mapInArrow(
        cut, f"k {kind}, piece int, start long, length long, ids_crc32 long"
    ).withColumnRenamed("k", key)
    return cut_rows.withColumn("block", F.spark_partition_id() % BLOCKS)


def patterns(have: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Triples of lengths, 0 for none, longest first, that fill a sequence exactly.

    ``have`` tells which lengths occur.  All pairs, and for each longest length up to
    ``SPREAD`` triples spread over its range.
    """
    found = {(capacity, 0, 0)} if have[capacity] else set()
    for a in np.flatnonzero(have[:capacity])[::-1].tolist():
        rest = capacity - a
        if rest <= a and have[rest]:
            found.add((a, rest, 0))
        low, high = -(-rest // 2), min(a, rest - 1)
        if low <= high:
            b = np.arange(low, high + 1)
            b = b[have[b] & have[rest - b]]
            if len(b):
                chosen = b[np.linspace(0, len(b) - 1, min(SPREAD, len(b))).astype(int)]
                found.update((a, int(x), rest - int(x)) for x in chosen)
    return np.array(sorted(found, reverse=True), np.int64).reshape(-1, 3)


def fit_counts(triples: np.ndarray, stock: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts whose pieces come closest to the stock.

    Accelerated projected gradient; the step comes from a bound on the normal matrix.
    """
    if not len(triples):
        return np.zeros(0)
    size, flat = len(stock), triples.ravel()
    used = np.bincount(flat, minlength=size).astype(float)
    used[0] = 0
    bound = max(1.0, 3 * used.max())
    x = y = np.zeros(len(triples))
    momentum = 1.0
    for _ in range(steps):
        made = np.bincount(flat, np.repeat(y, 3), minlength=size)
        short = stock - made
        short[0] = 0
        after = np.maximum(0, y + short[triples].sum(axis=1) / bound)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = after + (momentum - 1) / grown * (after - x)
        x, momentum = after, grown
    return x


def best_fit(stock: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Best fit, longest first, on counts by length: content of a sequence -> how many."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # ascending free lengths that some open sequence has
    closed: dict[tuple[int, ...], int] = {}

    def put(content: tuple[int, ...], free: int, count: int) -> None:
        if free == 0:
            closed[content] = closed.get(content, 0) + count
            return
        if free not in room:
            room[free] = {}
            insort(rooms, free)
        room[free][content] = room[free].get(content, 0) + count

    for length in sorted(stock, reverse=True):
        left = stock[length]
        while left > 0:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # no room anywhere: as many as fit to a new one
                if full := left // each:
                    put((length,) * each, capacity - each * length, full)
                if over := left % each:
                    put((length,) * over, capacity - over * length, 1)
                break
            free = rooms[at]
            content, count = room[free].popitem()
            each = min(free // length, left)
            many = min(count, left // each)
            if many < count:
                room[free][content] = count - many
            elif not room[free]:
                del room[free]
                rooms.pop(at)
            put((*content, *(length,) * each), free - each * length, many)
            left -= each * many
    for group in room.values():
        for content, count in group.items():
            closed[content] = closed.get(content, 0) + count
    return closed


def plan_packing(stock: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences with their numbers, for ``stock[length]`` pieces.

    The fitted counts are rounded down at a few strengths: a weaker one leaves more short
    pieces to fill the gaps of the residue.  The plan with the fewest sequences is taken.
    """
    stock = stock.copy()
    stock[0] = 0
    triples = patterns(stock > 0, capacity)
    counts = fit_counts(triples, stock.astype(float))
    fewest = -(-int(stock @ np.arange(len(stock))) // capacity)
    best: dict[tuple[int, ...], int] | None = None
    for strength in STRENGTHS:
        left = stock.copy()
        plan: dict[tuple[int, ...], int] = {}
        for i in np.argsort(-counts, kind="stable"):
            content = tuple(int(n) for n in triples[i] if n)
            lengths, times = np.unique(content, return_counts=True)
            repeat = min(int(strength * counts[i] + 1e-6), int((left[lengths] // times).min()))
            if repeat > 0:
                plan[content] = repeat
                left[lengths] -= repeat * times
        residue = {int(n): int(left[n]) for n in np.flatnonzero(left)}
        for content, count in best_fit(residue, capacity).items():
            plan[content] = plan.get(content, 0) + count
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) == fewest:
            break
    return list((best or {}).items())


class Placement:
    """For each length, intervals of ranks with their sequences and offsets."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for content, repeat in plan:
            offset = 0
            for length in sorted(set(content), reverse=True):
                each = content.count(length)
                rows.setdefault(length, []).append((used.get(length, 0), base, each, offset))
                used[length] = used.get(length, 0) + each * repeat
                offset += each * length
            base += repeat
        self.sequences = base
        self.rows = {n: np.array(r, np.int64).T for n, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            first, base, each, start = self.rows[int(n)]
            at = np.searchsorted(first, rank[mine], side="right") - 1
            inside = rank[mine] - first[at]
            sequence[mine] = base[at] + inside // each[at]
            offset[mine] = start[at] + inside % each[at] * n
        return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (see :func:`pieces`).

    The driver sees one count per length, at most ``capacity`` rows.
    """
    cut = stage(cut, "pieces")
    blocks = cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = stage(blocks, "piece_counts")
    stock = np.zeros(capacity + 1, np.int64)
    for row in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        stock[row["length"]] = row["n"]
    placement = Placement(plan_packing(stock, capacity))

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    among = Window.partitionBy("length", "block").orderBy(key, "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(among)).join(first, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first") - 1).drop("first", "block")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = placement.find(
                frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            )
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields
    )
    return ranked.select(*ranked.drop("rank").columns, "rank").mapInPandas(
        place, f"{schema}, sequence_id long, offset long"
    )
