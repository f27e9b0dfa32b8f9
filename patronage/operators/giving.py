"""Giving ledger: which gifts count, for how much, in which fiscal year.

Shuffle layout.  Everything known about one gift (commitment, schedule,
original pledge, planned-gift date) is first reduced to one row per
``gift_fact_id`` and looked up on that key, so the ledger is partitioned by gift
once.  Those reductions also remove the fan-out that would otherwise need a
dedupe of ledger rows.  The final total per person and year aggregates before it
shuffles, so a person with very many gifts costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import MONEY, active_individual, fiscal_year, money
from ..policy import GivingPolicy, ProjectionPolicy
from .generic import PERSON, flag_members, keep_members, pick_one, union_all
from .intervals import in_effect
from .skew import HotKeys, balanced_lookup, lookup, sparse_lookup

INCLUDE = fv.STATUS_INCLUDE

LEDGER_COLUMNS = (
    "cg_fact_id",
    "gift_fact_id",
    PERSON,
    "amount",
    "fund",
    "gift_fiscal_year",
    "gift_type",
    "gift_date",
    "is_ag_gift",
    "appeal_identifier",
    "re_gift_type",
)


# --- ledger ---------------------------------------------------------------


def gift_ledger(
    comprehensive_giving: DataFrame,
    constituent: DataFrame,
    gift_credit: DataFrame,
    gift: DataFrame,
    gift_type: DataFrame,
) -> DataFrame:
    """Credited gifts of living, active individuals with their gift type.

    Besides the ledger columns it carries what later steps would have to fetch
    from the gift table again: face amount, giver, entry date, planned-gift link.
    """
    people = constituent.where(active_individual()).select(PERSON)
    credits = gift_credit.select("gift_fact_id", "is_ag_gift", "appeal_identifier")
    # a gift's type is a number until the gifts have met their credits
    types = gift_type.select("gift_type_dim_id", F.col("gift_type").alias("re_gift_type"))
    gifts = gift.select(
        "gift_fact_id",
        "gift_type_dim_id",
        F.col("amount").alias("face_amount"),
        F.col("gift_date").alias("entry_date"),
        F.col(PERSON).alias("giver_dim_id"),
        "planned_gift_id",
    )
    rows = comprehensive_giving.select(
        "cg_fact_id",
        "gift_fact_id",
        PERSON,
        money("amount").alias("amount"),
        "fund",
        "gift_fiscal_year",
        "gift_type",
        "gift_date",
    )
    # a person with very many gifts is split at run time: counting gifts by person would move them once more
    rows = lookup(rows, people, PERSON, "inner")
    rows = lookup(rows, credits, "gift_fact_id", "inner")
    rows = lookup(rows, gifts, "gift_fact_id", "inner")
    return lookup(rows, types, "gift_type_dim_id", "inner").select(
        *LEDGER_COLUMNS, "face_amount", "entry_date", "giver_dim_id", "planned_gift_id"
    )


def projected_gifts(
    projection: DataFrame, constituent: DataFrame, policy: ProjectionPolicy = ProjectionPolicy()
) -> DataFrame:
    """Ledger rows for scheduled gifts that are not paid yet.

    They have no gift of their own, so both ids are the negated projection id.
    """
    people = constituent.where(
        (F.col("is_deceased") == fv.NO) & (F.col("is_inactive") == fv.NO)
    ).select("constituent_id", PERSON)
    due = projection.where(
        (F.col("gift_amount") > 0)
        & (F.col("gift_commitment_date") < F.lit(policy.committed_before))
        & F.col("gift_fact_id").isNull()
        & (F.col("fiscal_year") == policy.fiscal_year)
        & F.col("constituent_id").isNotNull()
    )
    surrogate = -F.col("cap_dim_id")
    due = due.select(
        surrogate.alias("cg_fact_id"),
        surrogate.alias("gift_fact_id"),
        "constituent_id",
        money("gift_amount").alias("amount"),
        F.col("fund_identifier").alias("fund"),
        F.col("fiscal_year").alias("gift_fiscal_year"),
        F.lit(fv.ANNUAL_PROJECTION).alias("gift_type"),
        "gift_date",
        "is_ag_gift",
        "appeal_identifier",
        F.lit(fv.ANNUAL_PROJECTION).alias("re_gift_type"),
    )
    people = people.where(F.col("constituent_id").isNotNull())
    return balanced_lookup(due, people, "constituent_id", "inner", by=["cg_fact_id"]).select(*LEDGER_COLUMNS)


# --- planned gifts --------------------------------------------------------


def first_last_by_type(ledger: DataFrame, gift_type: str = fv.PLANNED_GIFT) -> DataFrame:
    """First and last gift date per person for one gift type."""
    return (
        ledger.where(F.col("re_gift_type") == gift_type)
        .groupBy(PERSON)
        .agg(
            F.min("gift_date").alias("first_gift_date"),
            F.max("gift_date").alias("last_gift_date"),
        )
    )


def planned_gift_dates(
    ledger: DataFrame,
    gift: DataFrame,
    gift_attribute: DataFrame,
    policy: GivingPolicy = GivingPolicy(),
) -> DataFrame:
    """The planned-gift date each realised planned gift belongs to."""
    realized = gift_attribute.where(F.col("attribute_category") == fv.REALIZED_ATTRIBUTE)
    given = ledger.where(F.col(PERSON) == F.col("giver_dim_id"))
    rows = keep_members(given, realized, "gift_fact_id")
    originals = gift.select(
        F.col("gift_system_id").alias("planned_gift_id"),
        F.col("gift_date").alias("original_date"),
        F.lit(True).alias("has_original"),
    )
    rows = sparse_lookup(rows, originals, "planned_gift_id", by=["gift_fact_id"])
    rows = lookup(rows, first_last_by_type(ledger), PERSON)
    linked_date = F.col("original_date" if policy.use_original_planned_date else "entry_date")
    planned = (
        F.when(F.col("has_original"), linked_date)
        .when(F.col("gift_date") >= F.col("last_gift_date"), F.col("last_gift_date"))
        .otherwise(
            F.coalesce(
                "first_gift_date", F.lit(policy.no_planned_gift_date).cast("timestamp_ntz")
            )
        )
    )
    return rows.groupBy("gift_fact_id").agg(F.min(planned).alias("planned_gift_date"))


def realized_planned_gift_date(
    ledger: DataFrame,
    gift: DataFrame,
    gift_attribute: DataFrame,
    calendar: DataFrame,
    policy: GivingPolicy = GivingPolicy(),
) -> DataFrame:
    """Planned-gift date and its fiscal year per realised planned gift.

    Dates the calendar does not hold drop out (``quality.calendar_misses``).
    """
    years = calendar.select(
        F.to_date("actual_date").alias("planned_day"),
        F.col("fiscal_year").alias("planned_gift_fiscal_year"),
    )
    dated = planned_gift_dates(ledger, gift, gift_attribute, policy).withColumn(
        "planned_day", F.to_date("planned_gift_date")
    )
    return lookup(dated, years, "planned_day", "inner").select(
        "gift_fact_id", "planned_gift_date", "planned_gift_fiscal_year"
    )


# --- commitments and their payments ---------------------------------------


def commitment_lineage(
    installment_payment: DataFrame, gift: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Payment -> commitment -> fiscal year of the commitment.

    A payment that settles several instalments of one commitment appears once.
    """
    links = installment_payment.select(
        F.col("gift_payment_fact_id").alias("gift_fact_id"), "gift_commitment_system_id"
    ).distinct()
    commitments = gift.select(
        F.col("gift_system_id").alias("gift_commitment_system_id"),
        F.col("gift_fact_id").alias("commitment_gift_fact_id"),
        F.col("gift_date_dim_id").alias("date_dim_id"),
    )
    years = calendar.select("date_dim_id", F.col("fiscal_year").alias("pledge_fiscal_year"))
    # a commitment with very many payments is split at run time: to count them, the payments would be
    # put together once more
    rows = lookup(links, commitments, "gift_commitment_system_id", "inner")
    return lookup(rows, years, "date_dim_id").select(
        "gift_fact_id", "commitment_gift_fact_id", "pledge_fiscal_year"
    )


def settled_commitment(lineage: DataFrame) -> DataFrame:
    """One commitment per payment: the earliest recorded one."""
    return lineage.groupBy("gift_fact_id").agg(
        F.min("commitment_gift_fact_id").alias("commitment_gift_fact_id"),
        F.min_by("pledge_fiscal_year", "commitment_gift_fact_id").alias("pledge_fiscal_year"),
    )


def credited_commitments(ledger: DataFrame) -> DataFrame:
    """Distinct (person, gift) pairs of the ledger."""
    return ledger.select(PERSON, "gift_fact_id").distinct()


def _net_amount(df: DataFrame, written_off: str, name: str) -> DataFrame:
    """Largest amount less write-off per gift."""
    net = F.coalesce(money("amount"), money(F.lit(0))) - F.coalesce(
        money(written_off), money(F.lit(0))
    )
    return df.groupBy("gift_fact_id").agg(F.max(money(net)).alias(name))


def committed_amounts(gift_commitment: DataFrame) -> DataFrame:
    return _net_amount(gift_commitment, "write_off_amount", "committed_amount")


def scheduled_amounts(recurring_gift: DataFrame) -> DataFrame:
    return _net_amount(recurring_gift, "write_offs", "scheduled_amount")


def countable_amount() -> Column:
    """What a gift is worth: the promise for commitments, else the credit."""
    gift_type = F.col("re_gift_type")
    nothing = money(F.lit(0))
    return (
        F.when(
            gift_type.isin(fv.PLEDGE, fv.MATCHING_PLEDGE),
            F.coalesce("committed_amount", nothing),
        )
        .when(gift_type == fv.RECURRING_GIFT, F.coalesce("scheduled_amount", nothing))
        .when(gift_type == fv.PLANNED_GIFT, money("face_amount"))
        .otherwise(money("amount"))
    )


# --- include status -------------------------------------------------------


def _day_of(year: Column, month_day: tuple[int, int]) -> Column:
    """Midnight of a month and day in the given year."""
    month, day = month_day
    return F.make_date(year, F.lit(month), F.lit(day)).cast("timestamp_ntz")


def include_status(policy: GivingPolicy = GivingPolicy(), is_credited: Column | None = None) -> Column:
    """Whether a gift counts, or why it would count a promise twice.

    A payment is dropped when the promise it settles already counts in the same
    fiscal year.  Rows with ``in_grace`` are counted in ``counted_year`` through
    the window after year end; for those the promise of the year before clashes
    too.  Needs the columns of :func:`countable_gifts`; ``is_credited`` stands for the column
    of that name.
    """
    gift_type = F.col("re_gift_type")
    own_year = F.col("gift_fiscal_year")
    in_window = F.col("in_grace") & F.col("gift_date").between(
        _day_of(F.col("counted_year"), (fv.FISCAL_YEAR_START_MONTH, 1)),
        _day_of(F.col("counted_year"), policy.grace_last_excluded),
    )

    def clash(promise_year: Column, what: str) -> Column:
        return (
            F.when(own_year == promise_year, fv.STATUS_EXCLUDE_SAME_YEAR[what])
            .when(
                in_window & (own_year - 1 == promise_year),
                fv.STATUS_EXCLUDE_AFTER_YEAR[what],
            )
            .otherwise(INCLUDE)
        )

    credited = F.coalesce(F.col("is_credited") if is_credited is None else is_credited, F.lit(False))
    realized = F.col("is_realized").isNotNull()
    pledge_payment = (
        gift_type.ilike(f"{fv.PLEDGE_PAYMENT_PREFIX}%")
        & ~F.coalesce(F.col("fund").isin(*policy.membership_funds), F.lit(False))
        & credited
    )
    recurring_payment = (gift_type == fv.RECURRING_PAYMENT) & credited
    matching_payment = gift_type.ilike(f"{fv.MATCHING_PAYMENT_PREFIX}%")
    pledge_year = F.col("pledge_fiscal_year")
    return (
        F.when(gift_type == fv.PLANNED_GIFT, INCLUDE)
        .when(realized, clash(F.col("planned_gift_fiscal_year"), "planned gift"))
        .when(pledge_payment, clash(pledge_year, "pledge"))
        .when(recurring_payment, clash(pledge_year, "recurring gift"))
        .when(matching_payment, clash(pledge_year, "matching gift"))
        .otherwise(INCLUDE)
    )


# --- fiscal years ---------------------------------------------------------


def counted_years(policy: GivingPolicy = GivingPolicy()) -> Column:
    """Array of (counted_year, in_grace) a gift may count in.

    Strict years take the gift's recorded fiscal year.  Grace years take the
    year of the gift date and, for the first days after year end, also the year
    that just closed.  Gifts outside all years get an empty array.
    """

    def entry(year: Column, in_grace: bool, when: Column) -> Column:
        return F.when(
            when, F.struct(year.cast("int").alias("counted_year"), F.lit(in_grace).alias("in_grace"))
        )

    def within(year: Column, years: Sequence[int]) -> Column:
        return year.isin(*years) if years else F.lit(False)

    recorded = F.col("gift_fiscal_year")
    dated = fiscal_year("gift_date")
    closed = dated - 1
    early = F.col("gift_date") <= _day_of(closed, policy.grace_last_counted)
    return F.array_compact(
        F.array(
            entry(recorded, False, within(recorded, policy.strict_years)),
            entry(dated, True, within(dated, policy.grace_years)),
            entry(closed, True, within(closed, policy.grace_years) & early),
        )
    )


def _gift_date_bounds(policy: GivingPolicy) -> Column:
    """Coarse filter on the stored columns, so the scan can skip row groups."""
    keep = F.lit(False)
    if policy.strict_years:
        keep = keep | F.col("gift_fiscal_year").isin(*policy.strict_years)
    if policy.grace_years:
        first, last = min(policy.grace_years), max(policy.grace_years)
        keep = keep | F.col("gift_date").between(
            F.lit(date(first - 1, fv.FISCAL_YEAR_START_MONTH, 1)).cast("timestamp_ntz"),
            F.lit(date(last, *policy.grace_last_counted)).cast("timestamp_ntz"),
        )
    return keep


RECORDED, DATED = "recorded", "dated"


def counted_windows(spark: SparkSession, policy: GivingPolicy = GivingPolicy()) -> DataFrame:
    """The years of a policy as a table of windows, of any length and number.

    ``basis`` tells which point of a gift a window asks for: the fiscal year on record or the
    gift's date.  A grace window runs on into the year that follows, over that year's own.
    """
    start = fv.FISCAL_YEAR_START_MONTH

    def window(basis: str, year: int, in_grace: bool, last: tuple[int, int]) -> Column:
        bounds = {"counted_from": (year - 1, start, 1), "counted_to": (year, *last)}
        return F.struct(
            F.lit(basis).alias("basis"),
            F.lit(year).alias("counted_year"),
            F.lit(in_grace).alias("in_grace"),
            *[F.lit(date(*day)).cast("timestamp_ntz").alias(name) for name, day in bounds.items()],
        )

    rows = [window(RECORDED, y, False, (start - 1, 1)) for y in policy.strict_years]
    rows += [window(DATED, y, True, policy.grace_last_counted) for y in policy.grace_years]
    if not rows:
        raise ValueError("a policy without years has no windows")
    return spark.range(1).select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def in_counted_windows(ledger: DataFrame, windows: DataFrame) -> DataFrame:
    """Ledger rows with ``counted_year`` and ``in_grace`` of every window they are in.

    A gift stands on its date, and for its fiscal year on record on a day of that year's last month.
    """
    recorded = _day_of(F.col("gift_fiscal_year"), (fv.FISCAL_YEAR_START_MONTH - 1, 1))
    points = F.array(
        *[
            F.struct(F.lit(basis).alias("basis"), at.cast("timestamp_ntz").alias("counted_at"))
            for basis, at in ((RECORDED, recorded), (DATED, F.col("gift_date")))
        ]
    )
    rows = ledger.withColumn("_point", F.explode(points)).select("*", "_point.*").drop("_point")
    return in_effect(
        rows, windows, "counted_at", "counted_from", "counted_to", ["basis"], by=["cg_fact_id"]
    ).drop("basis", "counted_at", "counted_from", "counted_to")


def countable_gifts(
    ledger: DataFrame,
    gift: DataFrame,
    gift_attribute: DataFrame,
    gift_commitment: DataFrame,
    recurring_gift: DataFrame,
    installment_payment: DataFrame,
    calendar: DataFrame,
    policy: GivingPolicy = GivingPolicy(),
    windows: DataFrame | None = None,
    status: str | None = None,
    lineage: DataFrame | None = None,
    realized: DataFrame | None = None,
) -> DataFrame:
    """Ledger rows per counted fiscal year with countable amount and status.

    The years are the policy's, or those of a table like :func:`counted_windows` makes.
    ``status`` keeps the rows of one status; those that cannot have it go before the last
    shuffle.  ``lineage`` and ``realized`` are :func:`commitment_lineage` and
    :func:`realized_planned_gift_date` where a stage holds them.
    """
    if lineage is None:
        lineage = commitment_lineage(installment_payment, gift, calendar)
    lineage = settled_commitment(lineage)
    if realized is None:
        realized = realized_planned_gift_date(ledger, gift, gift_attribute, calendar, policy)
    realized = realized.select("gift_fact_id", "planned_gift_fiscal_year", F.lit(True).alias("is_realized"))
    if windows is None:
        rows = ledger.where(_gift_date_bounds(policy))
    else:
        rows = in_counted_windows(ledger, windows)
    for side in (
        committed_amounts(gift_commitment),
        scheduled_amounts(recurring_gift),
        lineage,
        realized,
    ):
        rows = lookup(rows, side, "gift_fact_id")
    if windows is None:
        rows = rows.withColumn("year", F.explode(counted_years(policy))).select("*", "year.*").drop("year")
    # both outcomes are known before the credits are: only they need pass the shuffle, not what decides them
    outcomes = {"_if_credited": include_status(policy, F.lit(True)), "_if_not": include_status(policy, F.lit(False))}
    if status is not None:
        outcomes = {name: outcome == status for name, outcome in outcomes.items()}
    rows = rows.withColumns({"countable": countable_amount(), **outcomes})
    if status is not None:
        rows = rows.where(F.col("_if_credited") | F.col("_if_not"))
    found = F.when(F.col("is_credited"), F.col("_if_credited")).otherwise(F.col("_if_not"))
    rows = mark_credited(rows, ledger)
    rows = rows.withColumn("status", found) if status is None else rows.where(found).withColumn("status", F.lit(status))
    return rows.drop("_if_credited", "_if_not")


def mark_credited(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Flag the rows whose person is also credited for the settled commitment."""
    credits = ledger.select(PERSON, F.col("gift_fact_id").alias("commitment_gift_fact_id"))
    return sparse_lookup(rows, credits, [PERSON, "commitment_gift_fact_id"], by=["gift_fact_id"], flag="is_credited")


def dedupe_payments(
    df: DataFrame, keys: Sequence[str], amount: str, tie_break: Sequence[str]
) -> DataFrame:
    """One row per key: the largest amount, ties by ``tie_break``."""
    order = [F.col(amount).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    return pick_one(df, keys, order)


def positive_totals(df: DataFrame, keys: Sequence[str], amount: str = "amount") -> DataFrame:
    """Sum of the positive amounts per key, where that is positive."""
    return (
        df.where(F.col(amount) > 0)
        .groupBy(*keys)
        .agg(F.sum(amount).cast(MONEY).alias("amount"))
        .where(F.col("amount") > 0)
    )


def giving_per_fiscal_year(
    ledger: DataFrame,
    constituent: DataFrame,
    gift: DataFrame,
    gift_attribute: DataFrame,
    gift_commitment: DataFrame,
    recurring_gift: DataFrame,
    installment_payment: DataFrame,
    calendar: DataFrame,
    projections: DataFrame | None = None,
    policy: GivingPolicy = GivingPolicy(),
    windows: DataFrame | None = None,
    lineage: DataFrame | None = None,
    realized: DataFrame | None = None,
) -> DataFrame:
    """Countable giving per person and fiscal year, all years in one pass.

    Projections count in the strict years only.  The check that the person is
    active follows the aggregation, when there is one row per person and year.
    ``lineage`` and ``realized``: see :func:`countable_gifts`.
    """
    # an amount that a gift's type does not ask for is not shuffled, nor a fund that decides nothing
    gift_type = F.col("re_gift_type")
    promised = gift_type.isin(fv.PLEDGE, fv.MATCHING_PLEDGE, fv.RECURRING_GIFT, fv.PLANNED_GIFT)
    rows = ledger.withColumns(
        {
            "amount": F.when(promised, None).otherwise(F.col("amount")),
            "face_amount": F.when(gift_type == fv.PLANNED_GIFT, F.col("face_amount")),
            "fund": F.when(F.col("fund").isin(*policy.membership_funds), F.col("fund")),
        }
    )
    counted = (
        countable_gifts(
            rows,
            gift,
            gift_attribute,
            gift_commitment,
            recurring_gift,
            installment_payment,
            calendar,
            policy,
            windows,
            INCLUDE,
            lineage,
            realized,
        )
        .select(PERSON, F.col("counted_year").alias("fiscal_year"), F.col("countable").alias("amount"))
    )
    if projections is not None:
        planned = projections.where(F.col("gift_fiscal_year").isin(*policy.strict_years)).select(
            PERSON, F.col("gift_fiscal_year").alias("fiscal_year"), "amount"
        )
        counted = union_all([counted, planned])
    totals = positive_totals(counted, [PERSON, "fiscal_year"])
    people = constituent.where(active_individual()).select(PERSON)
    return totals.join(people, PERSON, "left_semi")


# --- production gifts -----------------------------------------------------


def solicitable_funds(fund: DataFrame, campaign_list: DataFrame) -> DataFrame:
    """Funds that are on the campaign's list."""
    listed = campaign_list.select(F.col("designation").alias("fund_identifier"))
    return keep_members(fund, listed, "fund_identifier").select("fund_dim_id", "fund_identifier")


def translate_fund(
    df: DataFrame,
    solicitable: DataFrame,
    translation: DataFrame,
    column: str = "fund_identifier",
    name: str = "fund_identifier_trans",
    measure: DataFrame | HotKeys | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """The fund itself where it can be solicited, else its suggested
    replacement, else the fund itself."""
    kept = flag_members(solicitable, "_solicitable", "fund_identifier")
    mapped = translation.groupBy("fund_identifier").agg(
        F.min("suggested_fund_identifier").alias("_suggested"), F.lit(True).alias("_mapped")
    )
    fund = F.col(column)
    rows = balanced_lookup(
        df, kept.withColumnRenamed("fund_identifier", column), column, "left", measure, by
    )
    rows = balanced_lookup(
        rows, mapped.withColumnRenamed("fund_identifier", column), column, "left", measure, by
    )
    chosen = (
        F.when(F.col("_solicitable"), fund).when(F.col("_mapped"), F.col("_suggested")).otherwise(fund)
    )
    return rows.withColumn(name, chosen).drop("_solicitable", "_suggested", "_mapped")


def is_matching_gift() -> Column:
    """Whether a production row is an employer's match."""
    credited_match = (
        (F.col("gift_type") == fv.OTHER_GIFT)
        & (F.col("gift_sub_type") == fv.RECOGNITION_CREDIT)
        & F.col("cg_gift_type").ilike(f"%{fv.MATCHING_GIFT_SUFFIX}")
    )
    return F.when((F.col("gift_type") == fv.MATCHING_PLEDGE) | credited_match, fv.YES).otherwise(fv.NO)


def production_gifts(
    production: DataFrame,
    gift: DataFrame,
    fund: DataFrame,
    appeal: DataFrame,
    solicitable: DataFrame,
    translation: DataFrame,
) -> DataFrame:
    """Gifts produced or recognised, with fund, appeal and translated fund."""
    produced = (
        (F.col("data_source") == fv.DATA_SOURCE_DEVELOPMENT)
        & (F.col("measure") == fv.MEASURE_PRODUCTION)
    ) | F.col("data_source").isin(*fv.DATA_SOURCES_ALWAYS)
    rows = production.where(
        produced
        & (F.col("key_indicator") == fv.INDIVIDUAL)
        & (F.col("is_deceased") == fv.NO)
        & (F.col("cgpr_amount") > 0)
    ).select(
        "ocpr_dim_id",
        PERSON,
        "gift_fact_id",
        "gift_type",
        "fund_identifier",
        money("cgpr_amount").alias("amount"),
        "gift_date",
        "fiscal_year",
        is_matching_gift().alias("is_matching_gift"),
        "is_ag_gift",
    )
    gifts = gift.select("gift_fact_id", "fund_dim_id", "appeal_dim_id")
    row_id = ["ocpr_dim_id"]
    # one pass over each fact for all of its keys that a large dimension is looked up by
    produced_keys = HotKeys(rows, ["fund_identifier"])
    gift_keys = HotKeys(gifts, ["fund_dim_id", "appeal_dim_id"])
    # a hot gift's partition is split at run time: a sketch would put the production rows together once more
    rows = lookup(rows, gifts, "gift_fact_id", "inner")
    rows = balanced_lookup(
        rows, fund.select("fund_dim_id", "is_inactive"), "fund_dim_id", "inner", gift_keys, row_id
    )
    appeals = appeal.select(
        "appeal_dim_id", "appeal_identifier", F.col("campaign_identifier").alias("appeal_campaign")
    )
    rows = balanced_lookup(rows, appeals, "appeal_dim_id", "left", gift_keys, row_id)
    rows = translate_fund(rows, solicitable, translation, measure=produced_keys, by=row_id)
    return rows.select(
        "ocpr_dim_id",
        PERSON,
        "gift_type",
        "fund_identifier",
        "fund_identifier_trans",
        "amount",
        "gift_date",
        "fiscal_year",
        "is_matching_gift",
        "is_ag_gift",
        "is_inactive",
        "appeal_identifier",
        "appeal_campaign",
    )


def annual_giving_years(production: DataFrame) -> DataFrame:
    """Distinct (person, fiscal year) of giving defined as annual giving.

    Reads the production table once for every list and segment rule that asks
    when somebody gave.
    """
    annual = (
        (F.col("is_ag_gift") == fv.YES)
        & (F.col("cgpr_amount") > 0)
        & F.col("data_source").isin(fv.DATA_SOURCE_DEVELOPMENT, *fv.DATA_SOURCES_ALWAYS)
    )
    return production.where(annual).select(PERSON, "fiscal_year").distinct()
