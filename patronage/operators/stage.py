"""Materialising a stage that several later stages read."""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Columns that the readers of a stage join it on, where they may repeat: its table is buckets of them.
NEAR = {"ledger": ("gift_fact_id",)}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        raise ValueError(f"stages kept as tables need {CHECKPOINT_CONF}, a folder that all executors share")
    return configured


def materialize(df: DataFrame, name: str, mode: str = "lazy", near: Sequence[str] | None = None) -> DataFrame:
    """Fix a stage so that its readers do not compute it again.

    ``lazy``     leave it in the plan; readers share it through reused exchanges
    ``persist``  keep it in executor memory and disk; lost blocks are recomputed
    ``table``    write it as Parquet to the shared checkpoint folder and read it
                 back: the lineage is cut, a lost executor costs a read, readers
                 prune columns, and the size Spark plans with is that of the
                 files, which may be far below that of the rows.
                 Without a shared folder it raises.

    ``near``, by name in ``NEAR``, are columns that readers of a table join it on: its files are
    buckets of them, as many as the session's shuffle partitions, and such a join does not shuffle
    the stage again.
    """
    if mode == "lazy":
        return df
    if mode not in ("persist", "table"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "persist":
        return df.persist()
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    near = NEAR.get(name, ()) if near is None else near
    if near:
        return _bucketed(df, f"{name}_{uuid.uuid4().hex}", path, list(near))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, table: str, path: str, near: list[str]) -> DataFrame:
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, *near).write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, *near).sortBy(*near).saveAsTable(table)
    kept = spark.table(table)
    # the files stay, and so does what the plan knows of their buckets; only the name goes
    spark.sql(f"DROP TABLE {table}")
    return kept
