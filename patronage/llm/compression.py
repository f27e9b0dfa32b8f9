"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built, one from texts labelled 1 and one from texts labelled 0.  A
text is cut into blocks of ``BLOCK`` bytes, so that a dictionary matters all along it;
each block is compressed with either dictionary, and the sizes are summed.  The
difference of the sums, divided by the text's size, is positive where good text
predicts it better.  A logistic curve, fitted to labelled rows that no dictionary has
seen, makes it a probability.  Every text is scored whole.

Learning takes at most ``PER_LABEL`` rows of a label, those with the least hash of their
id; one in ``CALIBRATE`` of them fits the curve instead, weighed by the labels' counts.

Defined results: NULL and empty texts have a difference of 0 and get the curve's value
there; a NULL label or id teaches nothing, nor does a label without a document; a document
with both labels counts with the larger; a repeated id counts once, with its least text;
without rows of both labels every score is the share of label 1, smoothed ((n1 + 1) / (n + 2));
the same text has the same score; no rows give none.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import crc_fold, fit_in_task, labelled_sample

PER_LABEL = 2500
CALIBRATE = 4
BLOCK = 1024
DICTIONARY = 110 << 10
LEVEL = 3
FOLDS, HELD_OUT = 3, 1
SCALE = 100.0  # differences are a few hundredths


def held_out(key: Column) -> Column:
    return crc_fold(key, FOLDS) == HELD_OUT


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(texts: Sequence[str], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train on."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes) -> Callable[[str | None], int]:
    """The summed size of a text's compressed blocks."""
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    made = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False)
    return lambda text: sum(len(made.compress(b)) for b in blocks(text))


@dataclass
class CompressionModel:
    """Dictionaries and the curve ``1 / (1 + exp(-(slope * difference + constant)))``."""

    good: bytes
    bad: bytes
    slope: float
    constant: float

    def scorer(self) -> Callable[[str | None], float]:
        curve = lambda d: 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * d + self.constant))))
        if not self.good or not self.bad:
            return lambda text: curve(0.0)
        difference = differences(self.good, self.bad)
        return lambda text: curve(difference(text))


def differences(good: bytes, bad: bytes) -> Callable[[str | None], float]:
    """Bytes by which good text shortens a text more than bad text does, per byte of it."""
    by_good, by_bad = compressor(good), compressor(bad)

    def difference(text: str | None) -> float:
        size = len((text or "").encode("utf-8", "surrogatepass"))
        return SCALE * (by_bad(text) - by_good(text)) / size if size else 0.0

    return difference


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value by Newton's method, held by a small ridge."""
    at = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    loss = lambda w: float(weight @ np.logaddexp(0.0, np.where(y == 1, -1, 1) * (at @ w)) + w @ ridge @ w / 2)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(at @ w, -30, 30)))
        slope = at.T @ (weight * (p - y)) + ridge @ w
        bend = (at * (weight * p * (1 - p))[:, None]).T @ at + ridge
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def train_model(sample: Sequence[tuple[str, int]], counts: dict[int, int]) -> CompressionModel:
    """Fit to (text, label) rows; ``counts`` are the labels' counts before sampling."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = math.log((n1 + 1) / (n0 + 1))
    by_label = {v: [t for t, label in sample if label == v and t] for v in (0, 1)}
    if not by_label[0] or not by_label[1]:
        return CompressionModel(b"", b"", 0.0, share)
    aside = {v: ts[::CALIBRATE] if len(ts) > 1 else ts for v, ts in by_label.items()}
    learn = {v: [t for i, t in enumerate(ts) if i % CALIBRATE] or ts for v, ts in by_label.items()}
    good, bad = build_dictionary(learn[1]), build_dictionary(learn[0])
    difference = differences(good, bad)
    x = np.array([difference(t) for v in (0, 1) for t in aside[v]])
    y = np.repeat([0.0, 1.0], [len(aside[0]), len(aside[1])])
    weight = np.where(y == 1, n1 / len(aside[1]), n0 / len(aside[0])) / (n0 + n1) * len(x)
    return CompressionModel(good, bad, *fit_curve(x, y, weight))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", per_label: int = PER_LABEL
) -> CompressionModel:
    """Learn from documents with a label of 0 or 1, outside the held-out fold."""
    marked = labels.where(~held_out(F.col(key))).groupBy(key).agg(F.max(F.col(label).cast("int")).alias(label))
    marked = marked.where(F.col(label).isin(0, 1))
    counts = {r[label]: r["n"] for r in marked.groupBy(label).agg(F.count("*").alias("n")).collect()}
    sample = labelled_sample(marked, docs, key, label, per_label, 2 * per_label, F.xxhash64(key, F.lit("compression")))
    return fit_in_task(
        sample, ["place", label], lambda rows: train_model([(r["text"], r[label]) for r in rows], counts)
    )


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, held_out, score and predicted, of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            found = [of(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"k": batch.column("k"), "score": pa.array(found, pa.float64())})

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(score, f"k {kind}, score double").withColumnRenamed("k", key)
    return scored.select(
        key,
        held_out(F.col(key)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
