"""Language identification by sparse softmax regression on TF-IDF character n-grams.

Characters are lower-cased, digits and blanks count as one symbol each, and n-grams of
one to three characters are hashed to ``2**BITS`` features.  Document frequencies are
counted over all training rows.  The weights are fitted, by follow-the-regularised-leader
with an elastic net, to at most ``PER_LANGUAGE`` training rows of a language, those of
``LONGEST`` characters at most with the least hash of their id, and ``TOTAL_ROWS`` in all;
one in ``CALIBRATE`` of these sets the temperature instead.  Every text is then scored whole.

Defined results: a NULL text or one without a letter is ``und`` with score 0, as is all
where nothing can be learned; NULL ids count as the empty id and teach no weights; the same text has the same
answer; no rows give none.  Of a row only id, text and, to learn from, language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import crc_fold, fit_in_task, labelled_sample
from patronage.llm.ftrl import Ftrl, Row, scores, softmax, temperature

BITS = 16
FEATURES = 1 << BITS
ORDERS = 3
PER_LANGUAGE = 1200
TOTAL_ROWS = 60_000
LONGEST = 20_000
CALIBRATE = 5
PASSES = 2
FOLDS = 5
UNKNOWN = "und"
BLOCK = 1 << 20  # characters of a text looked at together


def held_out(key: Column) -> Column:
    return crc_fold(key, FOLDS) == 0


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= 48) & (points <= 57), 48, points)
    return np.where(points <= 32, 32, points).astype(np.uint64)


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in a text."""
    counts = np.zeros(FEATURES, np.int64)
    lowered = text.lower()
    for start in range(0, max(len(lowered), 1), BLOCK):
        # a block reads on a little, so that grams across its end count once
        symbols = _symbols(lowered[start : start + BLOCK + ORDERS - 1])
        own, code = min(BLOCK, len(lowered) - start), symbols
        for order in range(1, ORDERS + 1):
            if order > 1:
                code = code[:-1] * np.uint64(0x100000001B3) + symbols[order - 1 :]
            if not len(code):
                break
            mixed = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount((mixed[:own] >> np.uint64(64 - BITS)).view(np.int64), minlength=FEATURES)
    return counts


def tf_idf(text: str, idf: np.ndarray) -> Row:
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-9) * 10.0


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = tf_idf(text, self.idf)
        p = softmax((x @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs; one array of fixed size a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found += gram_counts(text) > 0
                n += 1
        at = np.flatnonzero(found)
        yield pa.record_batch({"feature": np.append(at, -1), "n": np.append(found[at], n)})

    counted = rows.select("text").mapInArrow(count, "feature long, n long")
    frequencies, total = np.zeros(FEATURES), 0
    for feature, n in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if feature < 0:
            total = n
        else:
            frequencies[feature] = n
    return frequencies, total


def train(
    rows: DataFrame,
    key: str,
    per_language: int = PER_LANGUAGE,
    longest: int = LONGEST,
    total_rows: int = TOTAL_ROWS,
) -> LanguageModel:
    """Learn from (key, text, lang) rows."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequencies, total = document_frequencies(rows)
    idf = np.log((1.0 + total) / (1.0 + frequencies)) + 1.0
    short = rows.select(key, "lang", F.length("text").alias("size")).where(F.col("size") <= longest)
    digest = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    sample = labelled_sample(
        short.select(key, "lang").distinct(), rows, key, "lang", per_language, total_rows, digest
    )
    sample = sample.where(F.length("text") <= longest)
    return fit_in_task(
        sample, ["lang", "place"], lambda rows: fit_model([(r["text"], r["lang"], r["place"]) for r in rows], idf)
    )


def fit_model(sample: list[tuple[str, str, int]], idf: np.ndarray) -> LanguageModel:
    """Learn from (text, language, place) rows; one place in ``CALIBRATE`` sets the temperature."""
    sample = [r for r in sample if has_letter(r[0])]
    languages = sorted({lang for _, lang, _ in sample})
    labels = np.array([languages.index(lang) for _, lang, _ in sample], int)
    features = [tf_idf(t, idf) for t, _, _ in sample]
    aside = np.array([place % CALIBRATE == 0 for _, _, place in sample], bool)
    fitting = [f for f, a in zip(features, aside, strict=True) if not a]
    model = Ftrl(FEATURES, max(len(languages), 1)).fit(fitting, labels[~aside], PASSES)
    weights = model.weights()
    kept = [f for f, a in zip(features, aside, strict=True) if a]
    heat = temperature(scores(kept, weights), labels[aside])
    return LanguageModel(languages, idf, weights, heat)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
            columns = {n: batch.column(n) for n in names}
            columns["lang_pred"] = pa.array([f[0] for f in found], pa.string())
            columns["score"] = pa.array([f[1] for f in found], pa.float64())
            yield pa.record_batch(columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(label, f"{schema}, lang_pred string, score double")


def train_on_documents(docs: DataFrame, key: str = "doc_id") -> LanguageModel:
    """Learn from the documents outside the held-out fold."""
    return train(docs.where(~held_out(F.col(key))).select(key, "text", "lang"), key)
