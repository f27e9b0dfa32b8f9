"""Phrase collocations by weighted acyclic automata.

Texts are lower-cased (A to Z), cut into pieces at ``. , ; : ! ?`` and line ends, and those
into words at blanks and tabs.  All is done for each language by itself:

1.  A task counts the one- to three-word phrases of some ``FLUSH_WORDS`` words, sorts them,
    and builds count automata from them, ``SEGMENT`` phrases each.
2.  Ranges of phrases are cut so that each holds about ``RANGE_GRAMS``, by marks that every
    ``MARK``-th phrase of each segment leaves; a frequent first word is cut like any other.
    Segments are cut at these bounds and the parts of a range united, weights added.
    Where there are more than ``FAN`` ranges, segments are first merged within ``FAN`` wider
    ones, a group of them at a time, then within ``FAN`` times as many, so that cuts do not
    leave crumbs.
3.  Phrases with a count of ``least`` are candidates.  Their parts, the words before and
    after each cut, are sent to the ranges that hold them, where an automaton of what is
    asked is composed with that of the counts.
4.  The lowest floor(1000000 a a / (l r)) over the cuts is a candidate's score, in decimals of
    38 digits.  A candidate inside a longer one with ``share`` percent of its count goes; what
    is asked for carries the largest count of the phrases that hold it.

Defined results: NULL and empty texts have no words; a NULL language is ``und``; repeated rows
count as often as they occur; equal scores rank by count and then by the phrase's bytes; no
rows give none.  Only the language and the text are read.  A text is cut into words in
parts of ``READ`` bytes; its words stay together until the next flush.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from patronage.llm.common import session_settings, stage
from patronage.llm.count_automaton import CountAutomaton, Grams, Phrase, count_grams, union

FLUSH_WORDS = 1_000_000
SEGMENT = 131_072
MARK = 8192
RANGE_GRAMS = 800_000
MOST_RANGES = 200_000
FAN = 512
ROWS_AT_ONCE = 8  # texts or automata that a batch brings a task: Spark and the task both hold it
READ = 1 << 20
NO_LANGUAGE = "und"
TAB = b"\t"  # parts the words of a phrase while it is a key
# a full stop stands for all that parts pieces
PIECE_BYTES = bytes(
    ord(".") if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 0x09 else b for b in bytes(range(256)).lower()
)


class _Numbers(dict):
    """A number from 1 for each word, as they come; 0 parts pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def numbered(text: bytes, numbers: _Numbers) -> Iterator[np.ndarray]:
    """The words of a whole text as numbers, and a 0 where a piece ends."""
    data = text.translate(PIECE_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + READ)
        end = len(data) if end < 0 else end
        tokens = data[start:end].replace(b".", b" . ").split()  # blanks are all that is left to part words
        yield np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        start = end
    yield np.zeros(1, np.int32)


def _segments(lang: str, grams: Grams) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(grams), SEGMENT):
        own = grams.part(start, start + SEGMENT)
        yield pa.record_batch(
            {
                "lang": pa.array([lang], pa.string()),
                "n_grams": pa.array([len(own)], pa.int64()),
                "marks": pa.array([[TAB.join(own.phrase(i)) for i in range(0, len(own), MARK)]], pa.list_(pa.binary())),
                "automaton": pa.array([CountAutomaton.build(own).to_bytes()], pa.binary()),
            }
        )


def _flushed(sequences: dict[str, list[np.ndarray]], numbers: _Numbers) -> Iterator[pa.RecordBatch]:
    """The segments of what a task has read."""
    by_number = list(numbers)
    order = sorted(range(1, len(by_number)), key=by_number.__getitem__)
    words = [by_number[i] for i in order]
    place = np.zeros(len(by_number), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    for lang, parts in sequences.items():
        for grams in count_grams(words, place[np.concatenate(parts)], SEGMENT):
            yield from _segments(lang, grams)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row at a time: a batch of long values is not held twice."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [column[i].as_py() for column in batch.columns]


def segments(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Count automata of the phrases of each task, in sorted segments."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sequences, held = _Numbers({b".": 0}), defaultdict(list), 0
        for own, data in _rows(batches):
            for part in numbered(data, numbers):
                sequences[own].append(part)
                held += len(part)
            if held >= FLUSH_WORDS:
                yield from _flushed(sequences, numbers)
                numbers, sequences, held = _Numbers({b".": 0}), defaultdict(list), 0
        yield from _flushed(sequences, numbers)

    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.col(text).cast("string").cast("binary").alias("t"),
    ).where(F.length("t") > 0)
    return rows.mapInArrow(count, SEGMENTS)


SEGMENTS = "lang string, n_grams long, marks array<binary>, automaton binary"


def ranges_of(parts: DataFrame) -> tuple[int, int]:
    """How many phrases segments hold, and how many ranges they make."""
    total = parts.agg(F.sum("n_grams")).first()[0] or 0
    return total, min(MOST_RANGES, -(-total // RANGE_GRAMS))


def range_bounds(parts: DataFrame, ranges: int) -> dict[str, list[Phrase]]:
    """The first phrases of a language's ranges but the first."""
    if ranges < 2:
        return {}
    marks = parts.select("lang", F.explode("marks").alias("mark"))
    dealt = marks.repartitionByRange(ranges, "lang", "mark").withColumn("part", F.spark_partition_id())
    least = dealt.groupBy("part").agg(F.min(F.struct("lang", "mark")).alias("m")).select("m.*").collect()
    bounds: dict[str, set[Phrase]] = defaultdict(set)
    for own, mark in least:
        bounds[own].add(tuple(bytes(mark).split(TAB)))
    return {own: sorted(found) for own, found in bounds.items()}


def cut(grams: Grams, bounds: list[Phrase]) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the parts of sorted phrases that lie in one range each."""
    if not len(grams):
        return
    low, high = (bisect_right(bounds, grams.phrase(i)) for i in (0, len(grams) - 1))
    places = [0, *[grams.first_from(b) for b in bounds[low:high]], len(grams)]
    for i, (start, end) in enumerate(zip(places, places[1:], strict=False)):
        if end > start:
            yield low + i, start, end


def _cut(parts: DataFrame, bounds: dict[str, list[Phrase]], groups: int) -> DataFrame:
    """(lang, range, group, automaton): segments cut at the bounds, dealt by all but the last."""

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, group, data in _rows(batches):
            grams = CountAutomaton.from_bytes(data).grams()
            found = list(cut(grams, bounds.get(lang, [])))
            # what only travels is a tree; the union shares states again
            own = [CountAutomaton.build(grams.part(s, e), False).to_bytes() for _, s, e in found]
            own = own if len(found) > 1 else [data]
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * len(own), pa.string()),
                    "range": pa.array([i for i, _, _ in found], pa.int32()),
                    "group": pa.array([group] * len(own), pa.int64()),
                    "automaton": pa.array(own, pa.binary()),
                }
            )

    group = F.pmod(F.xxhash64("automaton"), F.lit(groups))
    dealt = parts.select("lang", group.alias("group"), "automaton")
    dealt = dealt.mapInArrow(to_ranges, "lang string, range int, group long, automaton binary")
    return dealt.repartition("lang", "range", "group").sortWithinPartitions("lang", "range", "group")


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Grams]]:
    """(lang, range, phrases) of each group of sorted rows, added up as they come."""
    current, pending, size = None, [], 0
    for *key, data in _rows(batches):
        if key != current:
            if pending:
                yield current[0], current[1], union(pending)
            current, pending, size = key, [], 0
        pending.append(CountAutomaton.from_bytes(data).grams())
        size += len(pending[-1])
        if size > 2 * max(len(pending[0]), RANGE_GRAMS // 2):
            pending = [union(pending)]
            size = len(pending[0])
    if pending:
        yield current[0], current[1], union(pending)


def merged(parts: DataFrame, bounds: dict[str, list[Phrase]], groups: int) -> DataFrame:
    """Fewer segments, each within one range: those of a range and group as one sorted list."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, grams in _unions(batches):
            yield from _segments(lang, grams)

    return _cut(parts, bounds, groups).mapInArrow(merge, SEGMENTS)


def united(parts: DataFrame, bounds: dict[str, list[Phrase]]) -> DataFrame:
    """One automaton for each language and range."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, grams in _unions(batches):
            words = int(grams.weight[grams.at[:, 1] == 0].sum())
            yield pa.record_batch(
                {
                    "lang": pa.array([lang], pa.string()),
                    "range": pa.array([number], pa.int32()),
                    "n_words": pa.array([words], pa.int64()),
                    "automaton": pa.array([CountAutomaton.build(grams).to_bytes()], pa.binary()),
                }
            )

    return _cut(parts, bounds, 1).mapInArrow(unite, "lang string, range int, n_words long, automaton binary")


def candidate_parts(automata: DataFrame, bounds: dict[str, list[Phrase]], least: int) -> DataFrame:
    """(lang, phrase, words, a, cut, last, part, range): each side of each cut of the candidates,
    with the range that holds it."""

    def cut_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _rows(batches):
            grams = CountAutomaton.from_bytes(data).grams()
            own, rows = bounds.get(lang, []), []
            for i in np.flatnonzero((grams.at[:, 1] > 0) & (grams.weight >= least)).tolist():
                phrase, a = grams.phrase(i), int(grams.weight[i])
                key = TAB.join(phrase)
                for k in range(1, len(phrase)):
                    for last, part in ((False, phrase[:k]), (True, phrase[k:])):
                        rows.append((key, len(phrase), a, k, last, TAB.join(part), bisect_right(own, part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32())
            names = ("phrase", "words", "a", "cut", "last", "part", "range")
            made = {n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds, strict=True)}
            yield pa.record_batch({"lang": pa.array([lang] * len(rows), pa.string()), **made})

    columns = "lang string, phrase binary, words int, a long, cut int, last boolean, part binary, range int"
    return automata.select("lang", "automaton").mapInArrow(cut_candidates, columns)


def counted_parts(automata: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, part, n, longest): the count of each part, and the largest of a candidate that
    holds it and is longer by a word or more."""
    asked = parts.groupBy("lang", "range", "part").agg(F.max("a").alias("longest"))

    def look_up(key: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
        phrases = [tuple(p.split(TAB)) for p in wanted.column("part").to_pylist()]
        words = sorted({w for p in phrases for w in p})
        index = {w: i for i, w in enumerate(words, 1)}
        at = np.zeros((len(phrases), 3), np.int64)
        for i, p in enumerate(phrases):
            at[i, : len(p)] = [index[w] for w in p]
        order = np.lexsort(at.T[::-1])
        longest = wanted.column("longest").to_numpy()
        acceptor = CountAutomaton.build(Grams(words, at[order], longest[order]))
        rows = [x for data in held.column("automaton").to_pylist() for x in acceptor.compose(CountAutomaton.from_bytes(data))]
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(rows), pa.string()),
                "part": pa.array([TAB.join(p) for p, _, _ in rows], pa.binary()),
                "n": pa.array([n for _, _, n in rows], pa.int64()),
                "longest": pa.array([m for _, m, _ in rows], pa.int64()),
            }
        )

    held = automata.select("lang", "range", "automaton").groupBy("lang", "range")
    return held.cogroup(asked.groupBy("lang", "range")).applyInArrow(
        look_up, "lang string, part binary, n long, longest long"
    )


def scored(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates, by their lowest cut."""
    rows = parts.join(counts.select("lang", "part", "n"), ["lang", "part"])
    sides = rows.groupBy("lang", "phrase", "words", "a", "cut").agg(
        F.max(F.when(~F.col("last"), F.col("n"))).alias("l"), F.max(F.when(F.col("last"), F.col("n"))).alias("r")
    )
    score = F.expr("(1000000BD * CAST(a AS DECIMAL(38, 0)) * a) div (CAST(l AS DECIMAL(38, 0)) * r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return sides.groupBy("lang", "phrase", "words", "a").agg(lowest).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "best.score"
    )


def collocations(
    docs: DataFrame,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    with session_settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_AT_ONCE)}):
        read = stage(segments(docs, lang, text), "segments")
        total, ranges = ranges_of(read)
        wide = FAN
        while wide < ranges:
            groups = max(1, total // (wide * RANGE_GRAMS))
            read = stage(merged(read, range_bounds(read, wide), groups), "merged")
            total, ranges = ranges_of(read)
            wide *= FAN
        bounds = range_bounds(read, ranges)
        automata = stage(united(read, bounds), "automata")
        parts = stage(candidate_parts(automata, bounds, least), "parts")
        counts = stage(counted_parts(automata, parts), "counted")
    # a candidate is inside another as a part of it, at the start or the end
    inside = counts.select("lang", F.col("part").alias("phrase"), "longest")
    rows = scored(parts, counts).join(inside, ["lang", "phrase"], "left")
    kept = rows.where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    own = kept.withColumn("phrase", F.translate(F.col("phrase").cast("string"), "\t", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = automata.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
