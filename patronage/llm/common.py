"""Helpers the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
# a write that is read back from its files needs its shuffles no more: they go when it ends, not when the driver collects
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _scratch_folder() -> str:
    return tempfile.mkdtemp(prefix="stages-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session may lack the setting."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = _scratch_folder()
    return folder.rstrip("/")


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what runs inside, and are then as they were."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a read, never the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """``crc32`` of a key as text, modulo ``folds``; NULL is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def labelled_sample(
    rows: DataFrame, docs: DataFrame, key: str, value: str, per_value: int, total: int, digest: Column
) -> DataFrame:
    """``rows``, their ``place`` and text: at most ``per_value`` of each value, ``total`` of all.

    ``rows`` hold each (key, value) once, without texts.  Those with the least ``digest``, a
    64-bit hash of the key, are taken: first all under a hash that leaves little over the bound, by each value's
    count, then by rank, so no ranking meets all rows of a frequent value.  Texts are read
    last, for the chosen keys only; a key that repeats counts once, with its least text.
    """
    rows = stage(rows.dropna(subset=[key, value]), "labelled")
    counts = stage(rows.groupBy(value).agg(F.count("*").alias("_of")), "label_counts")
    values = counts.count()
    bound = min(per_value, max(total // max(values, 1), 1))
    # as many values as rows may be sampled are few; a shuffle by value would meet in one task
    counts = F.broadcast(counts) if values <= total else counts
    uniform = digest / F.lit(float(1 << 64)) + 0.5
    few = rows.join(counts, value).where(uniform * F.col("_of") < bound + 10 * bound**0.5 + 64).drop("_of")
    first = Window.partitionBy(value).orderBy(digest, key)
    chosen = few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= bound)
    on = [key, value] if value in docs.columns else [key]
    texts = docs.select(*on, "text").where(F.col("text").isNotNull())
    # at most ``total`` keys, or one a value beyond that
    found = texts.join(F.broadcast(chosen), on)
    return found.groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def fit_in_task(sample: DataFrame, order: list[str], fit: Callable[[list[dict]], object]) -> object:
    """What ``fit`` makes of a bounded sample's rows, in order.  The rows meet in one task,
    which another executor repeats if it is lost; the driver gets the result alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    made = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([])


def carried(df: DataFrame, order: list[str], value: str, known: Column) -> DataFrame:
    """Give every row the ``value`` of the last row at or before it where ``known`` holds.

    A scan in two levels over any number of rows: rows are range-partitioned by
    ``order`` and staged with their partition's number; each partition fills its own
    rows, and one row per partition passes the value on to the partitions after it.
    The staged number, not a fresh one, joins the two levels, so a recomputed task
    cannot see other bounds.
    """
    placed = stage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "carried"
    )
    last = (
        placed.where(known)
        .groupBy("_part")
        .agg(F.max_by(value, F.struct(*order)).alias("_ends_with"))
    )
    parts = placed.select("_part").distinct().join(last, "_part", "left")
    # one row per partition of the shuffle, however many rows the table has
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part", F.last("_ends_with", ignorenulls=True).over(before).alias("_brought")
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(known, F.col(value)), ignorenulls=True).over(inside)
    return (
        placed.withColumn("_own", own)
        .join(parts, "_part", "left")
        .withColumn(value, F.coalesce("_own", "_brought"))
        .drop("_part", "_own", "_brought")
    )
