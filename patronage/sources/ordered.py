"""Ordered results as files: sorted ranges, one after the other, and the proof that they are.

The rows are cut into ranges by a sample of the order, each range is sorted in its own task
and written as files whose names rise with the ranges.  Reading the files by name gives the
whole order, and a row's place in it is its file's first place plus its place in the file:
no task ever holds more than one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE = "_metadata.file_name"


def write_ordered(
    df: DataFrame, path: str, order: Sequence[Column | str], files: int | None = None, rows_per_file: int = 0
) -> None:
    """Write Parquet files that hold the rows in ascending ``order``, NULLs first.

    ``files`` ranges, or as many as adaptive execution makes of the shuffle partitions.  Rows
    that are equal in the whole order share a range, so end the order in a key.
    ``rows_per_file`` cuts a range into several files.
    """
    parts = [files] if files else []
    rows = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    rows.write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows with their place in the order, from 1."""
    rows = spark.read.parquet(path)
    numbered = rows.withColumns({"_file": F.col(FILE), "_row": F.col("_metadata.row_index")})
    starts = _starts(rows.select(F.col(FILE).alias("_file")))
    return (
        numbered.join(starts, "_file")
        .withColumn(position, (F.col("_start") + F.col("_row") + 1).cast("bigint"))
        .drop("_file", "_row", "_start")
    )


def _starts(files: DataFrame) -> DataFrame:
    """Rows before each file; the window holds one row per file."""
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = files.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def order_report(spark: SparkSession, path: str, order: Mapping[str, Column]) -> DataFrame:
    """One row per file: ``file``, ``rows``, ``misplaced`` rows that are less than the one before
    them in the file, and whether the file ``overlaps`` one before it, that is, starts below
    what an earlier file ends with.  All are 0 and false where the files are in order."""
    key = F.struct(*[c.alias(n) for n, c in order.items()])
    rows = spark.read.parquet(path).select(
        F.col(FILE).alias("file"), F.col("_metadata.row_index").alias("_row"), key.alias("_key")
    )
    previous = F.lag("_key").over(Window.partitionBy("file").orderBy("_row"))
    per_file = (
        rows.withColumn("_previous", previous)
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("_key") < F.col("_previous")).alias("misplaced"),
            F.min("_key").alias("_least"),
            F.max("_key").alias("_most"),
        )
    )
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    overlaps = F.coalesce(F.col("_least") < F.max("_most").over(earlier), F.lit(False))
    return per_file.withColumn("overlaps", overlaps).select("file", "rows", "misplaced", "overlaps")
