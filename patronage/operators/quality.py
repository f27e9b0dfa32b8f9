"""Data-quality gates: violations as rows, never as an aborted job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import blank, fuzzy_date
from .generic import union_all


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def violations(
    df: DataFrame, stage: str, unique: Sequence[str] = (), not_null: Sequence[str] = ()
) -> DataFrame:
    """One row per check of a stage: how many rows break it."""
    parts = []
    if unique:
        parts.append(
            duplicate_keys(df, unique).agg(
                F.lit(stage).alias("stage"),
                F.lit("unique").alias("rule"),
                F.lit(", ".join(unique)).alias("columns"),
                F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("bigint").alias("violations"),
            )
        )
    if not_null:
        checks = [
            F.struct(
                F.lit(c).alias("columns"), F.count_if(F.col(c).isNull()).alias("violations")
            )
            for c in not_null
        ]
        parts.append(
            df.agg(F.array(*checks).alias("checks"))
            .select(F.explode("checks").alias("c"))
            .select(
                F.lit(stage).alias("stage"),
                F.lit("not null").alias("rule"),
                "c.columns",
                "c.violations",
            )
        )
    return union_all(parts)


@dataclass(frozen=True)
class Check:
    """The rules of a table: columns that may occur once together, columns that hold values."""

    df: DataFrame
    stage: str
    unique: Sequence[str] = ()
    not_null: Sequence[str] = ()


def check_all(checks: Sequence[Check]) -> DataFrame:
    """One row per rule: how many rows break it.  Every table is read once.

    A table is grouped by its key in the key's own types, and the same groups count its
    NULLs; a table without a key is counted as a whole.
    """
    rules, parts = [], []
    for check in checks:
        nulls = {f"_null_{i}": c for i, c in enumerate(check.not_null)}
        counts = [F.count_if(F.col(c).isNull()).alias(n) for n, c in nulls.items()]
        found = [("not null", c, F.sum(n)) for n, c in nulls.items()]
        if check.unique:
            groups = check.df.groupBy(*check.unique).agg(F.count(F.lit(1)).alias("_rows"), *counts)
            found.insert(0, ("unique", ", ".join(check.unique), F.sum(F.col("_rows") - 1)))
        else:
            groups = check.df.agg(*counts)
        marks = []
        for rule, columns, broken in found:
            marks.append(F.struct(F.lit(len(rules)).alias("number"), broken.alias("broken")))
            rules.append((len(rules), check.stage, rule, columns))
        parts.append(groups.agg(F.array(*marks).alias("m")).select(F.explode("m").alias("m")).select("m.*"))
    broken = union_all(parts)
    spark = checks[0].df.sparkSession
    names = spark.createDataFrame(rules, "number int, stage string, rule string, columns string")
    return names.join(broken, "number", "left").select(
        "stage", "rule", "columns", F.coalesce("broken", F.lit(0)).cast("bigint").alias("violations")
    )


def bad_dates(df: DataFrame, text: str, class_year: str) -> DataFrame:
    """Rows whose date text or class year is given but is no date."""
    given = ~blank(text) | F.col(class_year).isNotNull()
    return df.where(given & fuzzy_date(text, class_year).isNull())


def calendar_misses(df: DataFrame, column: str, calendar: DataFrame) -> DataFrame:
    """Rows whose date the calendar does not hold."""
    days = calendar.select(F.to_date("actual_date").alias("_day"))
    return df.withColumn("_day", F.to_date(column)).join(days, "_day", "left_anti").drop("_day")
