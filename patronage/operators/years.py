"""Fiscal years as bitmaps: sets that combine before and after a shuffle.

A row holds, for its keys, one ``word`` of 64 consecutive years and the ``bits`` of the years
that occur in it, so any year has a place and a person mostly has one row.  Sets of any
number of parts unite by ``bit_or``: over the rows of a task, over tasks, and over tables
that were made on different days.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BITS = 64


def year_bitmaps(df: DataFrame, keys: Sequence[str], sets: dict[str, Column], year: str = "fiscal_year") -> DataFrame:
    """``keys``, ``word`` and a bitmap for each of the named sets: the years of the rows where
    the set's condition holds.  All sets are one pass; rows without a year are in none."""
    word = F.floor(F.col(year) / BITS).cast("int")
    place = F.pmod(F.col(year), F.lit(BITS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    kept = reduce(Column.__or__, sets.values())
    bitmaps = [F.bit_or(F.when(held, bit).otherwise(F.lit(0).cast("bigint"))).alias(name) for name, held in sets.items()]
    return df.where(F.col(year).isNotNull() & kept).groupBy(*keys, word.alias("word")).agg(*bitmaps)


def unite(parts: Sequence[DataFrame], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The union of the sets of several tables of bitmaps."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*keys, "word").agg(*[F.bit_or(n).alias(n) for n in names])


def count_years(name: str) -> Column:
    """Aggregate: number of distinct years, NULL without any."""
    n = F.sum(F.bit_count(name)).cast("bigint")
    return F.when(n > 0, n)


def last_year(name: str, but: Sequence[int] = ()) -> Column:
    """Aggregate: the latest year that is not among ``but``, NULL without any."""
    bits = _masked(name, but, keep=False)
    # the digits of a negative number are all 64
    highest = F.length(F.bin(bits)) - 1
    return F.max(F.when(bits != 0, F.col("word") * BITS + highest)).cast("int")


def has_year(name: str, years: Sequence[int]) -> Column:
    """Aggregate: whether any of these years occurs."""
    return F.coalesce(F.bool_or(_masked(name, years, keep=True) != 0), F.lit(False))


def _masked(name: str, years: Sequence[int], keep: bool) -> Column:
    masks: dict[int, int] = {}
    for y in years:
        masks[y // BITS] = masks.get(y // BITS, 0) | 1 << y % BITS
    bits = F.col(name)
    out = F.lit(0).cast("bigint") if keep else bits
    for word, mask in masks.items():
        mask = mask if keep else ~mask & (1 << BITS) - 1
        signed = mask - (1 << BITS) if mask >= 1 << BITS - 1 else mask
        out = F.when(F.col("word") == word, bits.bitwiseAND(F.lit(signed).cast("bigint"))).otherwise(out)
    return out
