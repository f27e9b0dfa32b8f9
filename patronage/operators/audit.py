"""Picks that the business order does not decide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .generic import top_k


def ambiguous_picks(
    df: DataFrame,
    stage: str,
    keys: Sequence[str],
    business_order: Mapping[str, Column],
    tie_break: Sequence[Column],
    values: Sequence[str],
) -> DataFrame:
    """Keys whose first two rows are equal in the business order, so that only the tie-break chose.

    ``business_order`` names the sort columns that the rules state, ``tie_break`` those that the
    operator adds.  Two rows per key and task reach the shuffle, however many the key has.  NULLs
    tie with NULLs.  One row per such key: ``stage``, ``key``, the ``picked`` and the ``other``
    row's values as text, and whether they ``differ``; without, the tie changes nothing.
    """
    named = {f"_by_{n}": order for n, order in business_order.items()}
    bare = {n: F.col(n) for n in business_order}
    top = top_k(df, keys, [*named.values(), *tie_break], 2, "_seq")
    rank = F.struct(*[bare[n] for n in business_order]) if bare else F.lit(1)
    shown = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    pairs = (
        top.select(*keys, "_seq", rank.alias("_rank"), shown.alias("_shown"))
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("_seq") == i, F.struct("_rank", "_shown"))).alias(name)
                for i, name in ((1, "_first"), (2, "_second"))
            ]
        )
    )
    tied = F.col("_second").isNotNull() & F.col("_first._rank").eqNullSafe(F.col("_second._rank"))
    return pairs.where(tied).select(
        F.lit(stage).alias("stage"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        F.col("_first._shown").alias("picked"),
        F.col("_second._shown").alias("other"),
        (F.col("_first._shown") != F.col("_second._shown")).alias("differ"),
    )
