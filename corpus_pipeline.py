"""From raw documents to packed sequences, each stage on all that the one before kept.

Defined results, for every stage: NULL and empty texts have no letter, so the first stage
ends them; NULL or repeated ids, languages and sources are values like others; other columns
than those of ``documents``, also of names that stages use, are dropped; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronage.llm import language_id, mixing, ngram_join, packing, quality
from patronage.llm.common import BLANK, DROP_SHUFFLES, session_settings, stage
from patronage.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3
# what no stage can express in SQL: trained weights, hashed draws, fitted patterns
ORACLE_SQL = None


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: id and text.  Sorts by id, rows without one last."""
    digest = F.when(F.col("text").isNull(), "none").otherwise(F.sha2("text", 256))
    return F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), digest)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or that no language is likely for, go.

    Where no row names its language nothing can be learned, and all texts with a letter stay.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.train_on_documents(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    read = language_id.identify_languages(docs, model)
    fine = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return read.where(fine).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts under the limits and outliers of their language and source go."""
    docs = docs.select(*COLUMNS).withColumn("_row", row_key(docs))
    judged = quality.quality_rules(docs.select("doc_id", "text", "lang", "source", "_row"), carry=("_row",))
    kept = judged.where("kept").select("_row").distinct()
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, the one with the least id.

    A row that repeats an id and its text goes; texts without words are near nothing.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", row_key(docs))
    classes = ngram_join.ngram_jaccard_join(docs, key="_row", count_links=False)
    first = classes.where(F.col("_row") == F.col("component_id")).select("_row").distinct()
    return docs.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix draws; a copy drawn in part is cut there."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS))
    drawn = mixed.withColumn("draw", F.explode("draws"))
    text = F.when(F.col("draw.words") < F.col("size"), first_words("text", "draw.words")).otherwise(F.col("text"))
    return drawn.withColumn("text", text).select(
        *[c for c in COLUMNS if c != "n_chars"], F.length("text").cast("long").alias("n_chars")
    )


def first_words(text: str, count: str) -> Column:
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), F.col(count).cast("int")), " ")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with session_settings(spark, DROP_SHUFFLES):
        for name, function in STAGES[:-1]:
            docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
