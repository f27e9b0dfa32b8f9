"""Range-in-effect joins: rows paired with the windows that hold their point in time.

Windows are a table: any number, any length, overlapping, open at either end.  A window lies
in at most two bins of the least power of two that is longer than it, and a point in one bin
of each size that any window needs, so a pair meets in exactly one bin: an equi-join that
shuffles, salts its hot bins and spills like any other, and then compares the exact bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .skew import balanced_lookup

FARTHEST = 2**40  # an open end, in days or units: beyond all points


def in_effect(
    rows: DataFrame,
    windows: DataFrame,
    at: str,
    first: str,
    last: str,
    keys: Sequence[str] = (),
    by: Sequence[str] | None = None,
) -> DataFrame:
    """``rows`` with the columns of each window that has ``first <= at <= last`` and the same ``keys``.

    Points and bounds are dates, timestamps or numbers up to 2^40, points and bounds of one
    kind.  A NULL bound is open; a NULL point or key, and NaN, is in no window; a window that ends before
    it starts holds nothing; equal windows each give a pair.  A row in no window goes.  Columns
    of ``windows`` other than the keys must not be named as those of ``rows``.  ``by`` tells
    rows of one bin apart, where a hot bin is to be split.
    """
    clash = (set(rows.columns) & set(windows.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    start = F.coalesce(_place(windows, first), F.lit(-FARTHEST))
    end = F.coalesce(_place(windows, last), F.lit(FARTHEST))
    # as many bits as the width has: bins of that size are longer than the window
    level = F.length(F.bin(F.col("_end") - F.col("_start"))).cast("int")
    sized = (
        windows.withColumns({"_start": start, "_end": end})
        .where(F.col("_start") <= F.col("_end"))
        .withColumn("_level", level)
    )
    # one of 42 sizes at most
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    binned = sized.withColumn(
        "_bin",
        F.explode(F.array_distinct(F.array(_bin(F.col("_start"), "_level"), _bin(F.col("_end"), "_level")))),
    ).drop("_start", "_end")
    place = _place(rows, at)
    points = (
        rows.where(place.isNotNull())
        .withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
        .withColumn("_bin", _bin(place, "_level"))
    )
    pairs = balanced_lookup(points, binned, [*keys, "_level", "_bin"], "inner", by=[*by, "_level"] if by else None)
    held = (F.coalesce(F.col(first) <= F.col(at), F.lit(True))) & (F.coalesce(F.col(at) <= F.col(last), F.lit(True)))
    return pairs.where(held).drop("_level", "_bin")


def _place(df: DataFrame, column: str) -> Column:
    """A whole number that never falls where the column rises."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("bigint")
    place = F.floor(F.col(column)).cast("bigint")
    return F.when(~F.isnan(column), place) if isinstance(kind, (T.FloatType, T.DoubleType)) else place


def _bin(place: Column, level: str) -> Column:
    return F.call_function("shiftright", place, F.col(level))
