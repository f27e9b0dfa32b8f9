"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  Each has a linear model on the words of a
text (present or not, of the vocabulary below) and on the probabilities of the
categories before it.  While training, those probabilities come from models that did not
see the row: ``FOLDS`` folds, each predicted by a model of the others.  Models are
fitted by follow-the-regularised-leader with an elastic net.

Training takes at most ``PER_VALUE`` rows for each value of the last category, those of
``LONGEST`` characters at most with the least hash of their id.  The vocabulary holds the
words, and beginnings of ``STEM`` letters, of at least ``LEAST_DOCS`` of these rows; words
are lower-cased and stripped of punctuation.  The threshold weighs, out of fold, a clean
row flagged as ``FALSE_WEIGHT`` times a toxic row missed.  Every text is scored whole.

Defined results: NULL and empty texts have no words, and are scored by the constants;
a label or id of NULL leaves its row out of training; a label repeated for a document
counts once, as the largest, and a repeated document with its least text; labels without
a document are not used; without positive and negative rows all probabilities are 0 and
nothing is flagged; a repeated row has the same scores; a very long text is scored by all
its words; of a row only id and text are read, and the result has no other columns of it;
no rows give none.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import fit_in_task, labelled_sample
from patronage.llm.ftrl import Ftrl, Row, scores, softmax

PER_VALUE = 2500
LONGEST = 30_000
LEAST_DOCS = 5
FOLDS = 3
UPDATES = 20_000  # of a model, in 3 to 20 passes
STEM = 4
FALSE_WEIGHT = 20
STRIP = string.punctuation + "«»“”„’‘…–—¿¡"


def words_of(text: str | None) -> set[str]:
    """Words, and beginnings of words, which inflected forms share."""
    words = {w.strip(STRIP) for w in set((text or "").lower().split())}
    return words | {w[:STEM] + "~" for w in words if len(w) > STEM}


@dataclass
class ToxicityModel:
    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]
    threshold: float

    def features(self, text: str | None) -> np.ndarray:
        known = self.vocabulary
        return np.array(sorted(known[w] for w in words_of(text) if w in known), int)

    def predict(self, text: str | None) -> list[float]:
        if not self.weights:
            return [0.0] * len(self.categories)
        at, earlier = self.features(text), []
        for weights in self.weights:
            row = _row(at, earlier, len(self.vocabulary))
            earlier.append(float(softmax(scores([row], weights))[0, 1]))
        return earlier


def _row(at: np.ndarray, earlier: Sequence[float], words: int) -> Row:
    places = np.concatenate([at, words + np.arange(len(earlier))]).astype(int)
    return places, np.concatenate([np.ones(len(at)), np.array(earlier, float)])


def _fit(rows: list[Row], labels: np.ndarray, size: int) -> np.ndarray:
    passes = min(20, max(3, UPDATES // max(len(rows), 1)))
    return Ftrl(size, 2, alpha=0.3, l1=5.0, l2=0.1).fit(rows, labels, passes).weights()


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Where the share caught less ``FALSE_WEIGHT`` times the share falsely caught is largest."""
    order = np.argsort(-scores, kind="stable")
    caught = np.cumsum(labels[order]) / labels.sum()
    false = np.cumsum(1 - labels[order]) / (1 - labels).sum()
    at = int(np.argmax(caught - FALSE_WEIGHT * false))
    below = scores[order[at + 1]] if at + 1 < len(order) else 0.0
    return float((scores[order[at]] + below) / 2)


def train_chain(sample: Sequence[tuple[str, Sequence[int]]], categories: Sequence[str]) -> ToxicityModel:
    """Fit a chain to (text, values of the categories) rows."""
    labels = np.array([v for _, v in sample], int).reshape(len(sample), len(categories))
    empty = ToxicityModel(list(categories), {}, [], 1.0)
    if not len(sample) or any(len(set(column)) < 2 for column in labels.T):
        return empty
    held = Counter(w for text, _ in sample for w in words_of(text))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in held.items() if n >= LEAST_DOCS))}
    model = ToxicityModel(list(categories), vocabulary, [], 1.0)
    places = [model.features(text) for text, _ in sample]
    fold = np.arange(len(sample)) % FOLDS
    earlier: list[list[float]] = [[] for _ in sample]
    for c in range(len(categories)):
        size = len(vocabulary) + c
        rows = [_row(at, e, len(vocabulary)) for at, e in zip(places, earlier, strict=True)]
        unseen = np.zeros(len(sample))
        for k in range(FOLDS):
            seen = np.flatnonzero(fold != k)
            weights = _fit([rows[i] for i in seen], labels[seen, c], size)
            other = np.flatnonzero(fold == k)
            unseen[other] = softmax(scores([rows[i] for i in other], weights))[:, 1]
        model.weights.append(_fit(rows, labels[:, c], size))
        for e, p in zip(earlier, unseen, strict=True):
            e.append(float(p))
    model.threshold = best_threshold(np.array([e[-1] for e in earlier]), labels[:, -1])
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, Column]],
    key: str = "doc_id",
    per_value: int = PER_VALUE,
    longest: int = LONGEST,
) -> ToxicityModel:
    """Learn from documents with labels.

    ``categories`` are names and 0/1 columns of ``labels`` in the order of the chain.
    """
    names = [name for name, _ in categories]
    marked = labels.groupBy(key).agg(*[F.max(value.cast("int")).alias(name) for name, value in categories])
    short = docs.select(key, F.length("text").alias("size")).where(F.col("size") <= longest).select(key)
    rows = marked.dropna(subset=names).join(short, key, "left_semi")
    sample = labelled_sample(rows, docs, key, names[-1], per_value, 2 * per_value, F.xxhash64(key))
    return fit_in_task(
        sample,
        ["place", names[-1]],
        lambda rows: train_chain([(r["text"], [r[n] for n in names]) for r in rows], names),
    )


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, a probability ``p_<category>`` each, and ``toxic``, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    names = [f"p_{c}" for c in model.categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            columns = {"k": batch.column("k")}
            for i, name in enumerate(names):
                columns[name] = pa.array([f[i] for f in found], pa.float64())
            toxic = [f[-1] > shared.value.threshold for f in found]
            yield pa.record_batch(columns | {"toxic": pa.array(toxic, pa.bool_())})

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    schema = ", ".join([f"k {kind}", *[f"`{n}` double" for n in names], "toxic boolean"])
    return rows.mapInArrow(score, schema).withColumnRenamed("k", key)
