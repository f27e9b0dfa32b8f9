"""Marketing segments, ask amounts and per-person giving figures."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import MONEY, money
from ..policy import SegmentPolicy
from .generic import PERSON, flag_members, union_all
from .skew import lookup, merged_lookup

ASKS = ("ask_1", "ask_2", "ask_3")


# --- per-person figures ---------------------------------------------------


def year_totals(giving: DataFrame, years: Sequence[int]) -> DataFrame:
    """One column of giving per fiscal year, 0 where there is none."""
    amount = F.col("amount")
    cells = [
        F.sum(F.when(F.col("fiscal_year") == y, amount).otherwise(money(F.lit(0))))
        .cast(MONEY)
        .alias(f"fy{y}")
        for y in years
    ]
    return giving.groupBy(PERSON).agg(*cells)


def year_amount(giving: DataFrame, year: int, name: str = "amount") -> DataFrame:
    """Giving of one fiscal year; people without any have no row."""
    return (
        giving.where(F.col("fiscal_year") == year)
        .groupBy(PERSON)
        .agg(F.sum("amount").cast(MONEY).alias(name))
    )


def distinct_years(gifts: DataFrame, name: str = "total_years") -> DataFrame:
    """Number of fiscal years with a gift."""
    return gifts.groupBy(PERSON).agg(F.count_distinct("fiscal_year").alias(name))


def avg_per_giving_year(giving: DataFrame) -> DataFrame:
    """Average over the years with giving of each year's total."""
    per_year = giving.groupBy(PERSON, "fiscal_year").agg(F.sum("amount").alias("amount"))
    return per_year.groupBy(PERSON).agg(
        F.sum("amount").cast(MONEY).alias("sum_amount"),
        (F.sum("amount") / F.count("amount")).cast(MONEY).alias("avg_amount"),
    )


def last_giving_year(gifts: DataFrame, name: str = "last_year") -> DataFrame:
    """Latest fiscal year with a gift."""
    return gifts.groupBy(PERSON).agg(F.max("fiscal_year").alias(name))


def ledger_years(ledger: DataFrame, projections: DataFrame, reported_year: int) -> DataFrame:
    """Fiscal years of the ledger; projections are reported in a given year."""
    return union_all(
        [
            ledger.select(PERSON, F.col("gift_fiscal_year").alias("fiscal_year")),
            projections.select(PERSON, F.lit(reported_year).alias("fiscal_year")),
        ]
    )


def own_annual_gifts(production_gifts: DataFrame) -> DataFrame:
    return production_gifts.where(
        (F.col("is_ag_gift") == fv.YES) & (F.col("is_matching_gift") == fv.NO)
    )


def gifts_outside(production_gifts: DataFrame, year: int) -> DataFrame:
    return production_gifts.where((F.col("amount") > 0) & (F.col("fiscal_year") != year))


def prior_total(production_gifts: DataFrame, report_year: int, last_year_only: bool = False) -> DataFrame:
    """Giving outside the report year: all of it, or only the latest year's."""
    rows = gifts_outside(production_gifts, report_year)
    if not last_year_only:
        return rows.groupBy(PERSON).agg(F.sum("amount").cast(MONEY).alias("prior_total"))
    per_year = rows.groupBy(PERSON, "fiscal_year").agg(F.sum("amount").cast(MONEY).alias("amount"))
    return per_year.groupBy(PERSON).agg(F.max_by("amount", "fiscal_year").alias("prior_total"))


def manager_fallback(manager: DataFrame) -> DataFrame:
    """First named manager per slot, empty when there is none."""
    nobody = F.lit("")
    return manager.select(
        PERSON,
        F.coalesce("mgr1", "cl1", "disc_mgr", "disc_cl_mgr", nobody).alias("manager_1"),
        F.coalesce("mgr2", "cl2", nobody).alias("manager_2"),
        F.coalesce("mgr3", "cl3", nobody).alias("manager_3"),
    )


# --- segments -------------------------------------------------------------


def segment(
    members: DataFrame,
    donor_types: DataFrame,
    giving: DataFrame,
    annual_years: DataFrame,
    policy: SegmentPolicy = SegmentPolicy(),
) -> DataFrame:
    """Marketing segment of each member that has a donor type.

    ``annual_years`` is :func:`giving.annual_giving_years`.
    """
    current = giving.where(
        F.col("fiscal_year").isin(*policy.current_years) & (F.col("amount") > 0)
    )
    rows = merged_lookup(
        members.select(PERSON), donor_types.select(PERSON, "dpag_donor_type_bucket"), PERSON, "inner"
    )
    rows = lookup(rows, flag_members(current, "is_current"), PERSON)
    rows = lookup(rows, distinct_years(annual_years), PERSON)
    name = (
        F.when(F.col("is_current"), policy.current)
        .when(F.col("dpag_donor_type_bucket") == policy.lapsed_bucket, policy.lapsed_4plus)
        .when(F.col("total_years") <= 1, policy.lapsed_one_year)
        .when(F.col("total_years") >= 2, policy.lapsed_multi_year)
        .otherwise("")
    )
    return rows.select(PERSON, name.alias("marketing_segment"))


# --- ask amounts ----------------------------------------------------------


def _amount(text: str) -> Column:
    return F.lit(Decimal(text))


def ask_ladder(
    average: str = "avg_amount",
    segment_name: str = "marketing_segment",
    policy: SegmentPolicy = SegmentPolicy(),
) -> list[Column]:
    """Unrounded asks: flat for light donors, a multiple of the average else.

    NULL outside the lapsed segments.  A value on a bracket's upper edge belongs
    to the lower bracket.
    """
    name, avg = F.col(segment_name), F.col(average)
    low, middle, high = (_amount(b) for b in fv.ASK_BRACKETS)
    asks = []
    for i, alias in enumerate(ASKS):
        flat = _amount(fv.ASK_FLAT[i])
        times = {bracket: avg * _amount(f[i]) for bracket, f in fv.ASK_FACTORS.items()}
        by_average = (
            F.when(avg <= low, flat)
            .when(avg <= middle, times["75-250"])
            .when(avg <= high, times["250-1000"])
            .when(avg > high, times["1000+"])
        )
        asks.append(
            F.when(name.isin(policy.lapsed_4plus, policy.lapsed_one_year), flat)
            .when(name == policy.lapsed_multi_year, by_average)
            .cast("decimal(24,6)")
            .alias(alias)
        )
    return asks


def ask_snap(
    segment_name: str = "marketing_segment", policy: SegmentPolicy = SegmentPolicy()
) -> list[Column]:
    """Printed asks: strictly inside a bracket the bracket's amount, else the
    raw ask to the nearest five.  Reads the columns :func:`ask_ladder` gives."""
    several = F.col(segment_name) == policy.lapsed_multi_year
    low, middle, high = (_amount(b) for b in fv.ASK_BRACKETS)
    asks = []
    for i, alias in enumerate(ASKS):
        raw = F.col(alias)
        snapped = {bracket: money(_amount(v[i])) for bracket, v in fv.ASK_SNAP.items()}
        asks.append(
            F.when(several & (raw > low) & (raw < middle), snapped["75-250"])
            .when(several & (raw > middle) & (raw < high), snapped["250-1000"])
            .when(several & (raw > high), snapped["1000+"])
            .otherwise(money(F.round(raw / fv.ASK_ROUNDING, 0) * fv.ASK_ROUNDING))
            .alias(alias)
        )
    return asks


def ask_array(
    members: DataFrame,
    segments: DataFrame,
    averages: DataFrame,
    policy: SegmentPolicy = SegmentPolicy(),
) -> DataFrame:
    """Three ask amounts per member."""
    rows = merged_lookup(members.select(PERSON), segments.select(PERSON, "marketing_segment"), PERSON)
    rows = lookup(rows, averages.select(PERSON, "avg_amount"), PERSON)
    raw = rows.select(PERSON, "marketing_segment", *ask_ladder(policy=policy))
    return raw.select(PERSON, *ask_snap(policy=policy))


def production_summary(
    production_gifts: DataFrame, report_year: int, last_year_only: bool = False
) -> DataFrame:
    """All figures the extract takes from production gifts, in one pass.

    Rolls up to person and year first (combined before the shuffle), so the
    counts of distinct years are plain counts afterwards.
    """
    positive = F.col("amount") > 0
    annual = F.col("is_ag_gift") == fv.YES
    own = F.col("is_matching_gift") == fv.NO
    per_year = production_gifts.groupBy(PERSON, "fiscal_year").agg(
        F.max(annual & positive).alias("has_annual"),
        F.max(annual & own).alias("has_own_annual"),
        F.sum(F.when(positive, F.col("amount"))).cast(MONEY).alias("amount"),
    )
    outside = F.col("amount").isNotNull() & (F.col("fiscal_year") != report_year)
    if last_year_only:
        total = F.max_by(F.when(outside, F.col("amount")), F.when(outside, F.col("fiscal_year")))
    else:
        total = F.sum(F.when(outside, F.col("amount")))
    years = F.count_if(F.col("has_annual"))
    return per_year.groupBy(PERSON).agg(
        F.when(years > 0, years).cast("bigint").alias("annual_giving_years"),
        F.max(F.when(F.col("has_own_annual"), F.col("fiscal_year"))).alias("last_annual_giving_year"),
        F.max(F.when(outside, F.col("fiscal_year"))).alias("last_year_before_report"),
        total.cast(MONEY).alias("prior_total"),
    )


def giving_summary(giving: DataFrame, years: dict[str, int]) -> DataFrame:
    """Giving of the named years side by side, NULL where there is none."""
    cells = [
        F.sum(F.when(F.col("fiscal_year") == y, F.col("amount"))).cast(MONEY).alias(name)
        for name, y in years.items()
    ]
    return giving.where(F.col("fiscal_year").isin(*years.values())).groupBy(PERSON).agg(*cells)
