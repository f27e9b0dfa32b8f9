"""Operators that know nothing about donors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

PERSON = "constituent_dim_id"


def pick_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """First row per key.

    ``order_by`` must end in a tie-break that is unique within the key.  The
    rank filter becomes a group limit before the shuffle, so each task sends at
    most one row per key however many rows the key has.
    """
    return top_k(df, keys, order_by, 1, "_rank").drop("_rank")


def top_k(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int, name: str = "seq"
) -> DataFrame:
    """First ``k`` rows per key, numbered from 1."""
    return ranked(df, keys, order_by, name).where(F.col(name) <= k)


def ranked(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], name: str = "seq") -> DataFrame:
    """Number the rows of each key from 1."""
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(window))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts.  Texts take the collation that any part has for them."""
    collated = {
        f.name: f.dataType
        for part in parts
        for f in part.schema.fields
        if isinstance(f.dataType, T.StringType) and f.dataType.collation != T.StringType().collation
    }

    def aligned(part: DataFrame) -> DataFrame:
        plain = [c for c, kind in collated.items() if part.schema[c].dataType != kind]
        return part.withColumns({c: F.col(c).cast(collated[c]) for c in plain}) if plain else part

    return reduce(DataFrame.unionByName, [aligned(p) for p in parts])


def _keys_once(members: DataFrame, key: str) -> DataFrame:
    """Each key once.  Combined before the shuffle the join needs anyway, so a key
    with very many member rows reaches it as one row per task."""
    return members.select(key).distinct()


def keep_members(df: DataFrame, members: DataFrame, key: str = PERSON) -> DataFrame:
    return df.join(_keys_once(members, key), key, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, key: str = PERSON) -> DataFrame:
    return df.join(_keys_once(members, key), key, "left_anti")


def flag_members(members: DataFrame, name: str, key: str = PERSON) -> DataFrame:
    """Distinct keys with a true flag, ready to be looked up."""
    return members.select(key).distinct().withColumn(name, F.lit(True))


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the rows where all of these columns are NULL."""
    return df.dropna(how="all", subset=list(columns))


def attribute_lookup(
    attributes: DataFrame,
    category: str,
    keys: Sequence[str] = (PERSON,),
    where: Column | None = None,
    value: str = "attribute_description",
    order_by: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """One value per key from a category / description table.

    The lowest ``order_by`` wins, then the lowest value, so the lookup never
    multiplies rows.
    """
    name = name or value
    chosen = attributes.where(F.col("attribute_category") == category)
    if where is not None:
        chosen = chosen.where(where)
    if not order_by:
        return chosen.groupBy(*keys).agg(F.min(value).alias(name))
    order = [F.col(c) for c in (*order_by, value)]
    return pick_one(chosen, keys, order).select(*keys, F.col(value).alias(name))


def pivot_top_n(
    suggestions: DataFrame,
    n: int = 3,
    key: str = PERSON,
    values: dict[str, str] | None = None,
) -> DataFrame:
    """Spread the first ``n`` ranked rows of a key over columns.

    ``values`` maps a column to the prefix of its ``n`` output columns.  One
    grouped pass, however many columns come out.
    """
    values = values or {"fund_description": "fund_description", "fund_identifier": "fund_id"}
    cells = [
        F.max(F.when(F.col("seq") == i, F.col(source))).alias(f"{prefix}_{i}")
        for i in range(1, n + 1)
        for source, prefix in values.items()
    ]
    return suggestions.where(F.col("seq") <= n).groupBy(key).agg(*cells)
