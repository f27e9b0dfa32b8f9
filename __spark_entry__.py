"""

Every query runs the library over the whole retail tables, bound to the donor
warehouse by :mod:`patronage.sources.retail`.  Money leaves a query as double so
that both engines hand over the same type; the operators themselves keep decimals.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from checks.oracle import FINAL, oracle
from patronage import fixed_values as fv
from patronage.operators import (
    audit, contacts, funds, generic, giving, lists, quality, refresh, segments, years,
)
from patronage.operators.generic import PERSON
from patronage.operators.skew import frequent_values, lookup, merged_lookup
from patronage.operators.stage import materialize
from patronage.operators.store import StageStore
from patronage.plans import MailingPlan
from patronage.policy import CELL_PHONE, ExtractPolicy, GivingPolicy, ProjectionPolicy
from patronage.sources.ordered import order_report, read_ordered, write_ordered
from patronage.sources.retail import retail_warehouse

FLAGSHIP_DIR = "/root/testdata/sf0.001"
STRICT = GivingPolicy(grace_years=())
GRACE = GivingPolicy(strict_years=())


def _counted(plan: MailingPlan, policy: GivingPolicy) -> DataFrame:
    w = plan.wh
    return giving.countable_gifts(
        plan.ledger,
        w.gift,
        w.gift_attribute,
        w.gift_commitment,
        w.recurring_gift,
        w.installment_payment,
        w.calendar,
        policy,
    )


def _status(policy: GivingPolicy) -> Callable[[MailingPlan], DataFrame]:
    return lambda p: _counted(p, policy).select("cg_fact_id", "counted_year", "status")


def _giving(policy: GivingPolicy) -> Callable[[MailingPlan], DataFrame]:
    return lambda p: MailingPlan(p.wh, replace(p.policy, giving=policy), p.stage_mode).giving


def _ledger_rows(df: DataFrame) -> DataFrame:
    return df.select(*giving.LEDGER_COLUMNS)


def _lineage(p: MailingPlan) -> DataFrame:
    return p.lineage


def _dedupe_payments(p: MailingPlan) -> DataFrame:
    settled = p.ledger.join(_lineage(p), "gift_fact_id")
    return giving.dedupe_payments(
        settled, [PERSON, "cg_fact_id"], "amount", ["commitment_gift_fact_id"]
    ).select("cg_fact_id", PERSON, "commitment_gift_fact_id", "amount")


def _realized(p: MailingPlan) -> DataFrame:
    return giving.realized_planned_gift_date(
        p.ledger, p.wh.gift, p.wh.gift_attribute, p.wh.calendar
    )


def _projected(year: int) -> Callable[[MailingPlan], DataFrame]:
    policy = ProjectionPolicy(year, fv.PROJECTION_COMMITTED_BEFORE[year])
    return lambda p: giving.projected_gifts(p.wh.annual_projection, p.wh.constituent, policy)


def _calendar_misses(p: MailingPlan) -> DataFrame:
    dated = giving.planned_gift_dates(p.ledger, p.wh.gift, p.wh.gift_attribute)
    return quality.calendar_misses(dated, "planned_gift_date", p.wh.calendar).select(
        "gift_fact_id", "planned_gift_date"
    )


def _education_rows(p: MailingPlan) -> DataFrame:
    w = p.wh
    return contacts.primary_education_rows(
        w.education, w.constituent, w.education_major, w.education_attribute
    )


def _pick_major(p: MailingPlan) -> DataFrame:
    keys = list(contacts.EDUCATION_KEYS)
    return generic.pick_one(
        p.wh.education_major, keys, [F.col("sequence"), F.col("major_code")]
    ).select(*keys, "major_code")


def _quality(p: MailingPlan) -> DataFrame:
    own = [
        quality.Check(
            p.ledger, "ledger", ["cg_fact_id"], ["gift_fact_id", PERSON, "amount", "fund"]
        ),
        quality.Check(p.production_gifts, "production gifts", ["ocpr_dim_id"]),
        quality.Check(
            _education_rows(p), "primary education", [PERSON], ["school_type", "date_graduated"]
        ),
        quality.Check(p.wh.fund_translation, "fund translation", ["fund_identifier"]),
    ]
    return quality.check_all([*own, *p.checks])


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own where a local session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stages-")


def _beyond(store: StageStore, df: DataFrame, name: str) -> DataFrame:
    """A result that stays when its store is closed."""
    path = f"{store.folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _giving_incremental(p: MailingPlan) -> DataFrame:
    """Giving built without the gifts of the last two years, refreshed when they come in."""
    spark, late = p.wh.gift.sparkSession, F.col("gift_fiscal_year") >= p.policy.report_year - 1
    before, lineage = p.ledger.where(~late), materialize(_lineage(p), "lineage", p.stage_mode)
    realized = materialize(_realized(p), "realized", p.stage_mode)
    state = {"ledger": before, "realized": None}

    def compute(policy: GivingPolicy) -> DataFrame:
        w = p.wh
        return giving.giving_per_fiscal_year(
            state["ledger"], w.constituent, w.gift, w.gift_attribute, w.gift_commitment, w.recurring_gift,
            w.installment_payment, w.calendar, p.projections, policy, lineage=lineage, realized=state["realized"],
        )

    with StageStore(spark, folder=_folder(spark)) as store:
        kept = refresh.GivingTable(spark, store.table("giving_by_year"), compute, p.policy.giving)
        kept.build()
        state.update(ledger=p.ledger, realized=realized)
        changed = p.ledger.where(late).select("gift_fact_id")
        touched = refresh.touched_years(p.ledger, changed, lineage, realized, before, p.policy.giving)
        return _beyond(store, kept.refresh(touched), "giving_by_year")


def _extract_from_store(p: MailingPlan) -> DataFrame:
    """The extract from bucketed stages whose keys are checked as they are written."""
    spark = p.wh.gift.sparkSession
    with StageStore(spark, folder=_folder(spark)) as store:
        plan = MailingPlan(p.wh, p.policy, store=store)
        return _beyond(store, plan.mail_extract, "extract")


def _giving_from_windows(p: MailingPlan) -> DataFrame:
    """Giving with the years as a table of overlapping windows."""
    w, policy = p.wh, p.policy.giving
    return giving.giving_per_fiscal_year(
        p.ledger, w.constituent, w.gift, w.gift_attribute, w.gift_commitment, w.recurring_gift,
        w.installment_payment, w.calendar, p.projections, policy,
        giving.counted_windows(w.gift.sparkSession, policy),
    )


def _extract_order_columns() -> dict[str, Column]:
    return {"id": F.col("constituent_id").cast("bigint"), "text": F.col("constituent_id")}


def _ordered_extract(p: MailingPlan) -> str:
    """The folder of the extract, written in the order of the ids."""
    path = f"{_folder(p.wh.gift.sparkSession)}/ordered-{uuid.uuid4().hex}"
    # ranges are cut by a sample: the joins of the extract are not run once more for it
    rows = materialize(p.extract_rows, "extract", p.stage_mode)
    write_ordered(rows, path, list(_extract_order_columns().values()))
    return path


def _extract_positions(p: MailingPlan) -> DataFrame:
    """Each household's place in the files of the extract."""
    rows = read_ordered(p.wh.gift.sparkSession, _ordered_extract(p))
    return rows.select("constituent_id", "position")


def _extract_order(p: MailingPlan) -> DataFrame:
    """What the files of the extract hold, and how many rows and files are out of order."""
    report = order_report(p.wh.gift.sparkSession, _ordered_extract(p), _extract_order_columns())
    return report.agg(
        F.sum("rows").alias("rows"),
        F.sum("misplaced").alias("misplaced"),
        F.count_if("overlaps").alias("overlapping"),
    )


def _ambiguous(p: MailingPlan) -> DataFrame:
    """Keys of every pick whose first two rows the rules leave open."""
    w, policy = p.wh, p.policy.suggestions
    p.lineage = materialize(p.lineage, "lineage", p.stage_mode, ["gift_fact_id"])  # giving reads it as well
    settled = p.ledger.join(p.lineage, "gift_fact_id")
    departments = w.education_attribute.where(F.col("attribute_category") == fv.DEPARTMENT_CATEGORY)
    by_sequence = {"sequence": F.col("sequence").asc_nulls_first()}
    by_position = {"best_order": F.col("best_order").asc()}
    fund = ["fund_identifier", "fund_description"]
    picks = [
        (w.education_major, "major", contacts.EDUCATION_KEYS, by_sequence, ["major_code"]),
        (departments, "department", contacts.EDUCATION_KEYS, by_sequence, ["attribute_description"]),
        (
            settled, "payment", [PERSON, "cg_fact_id"],
            {"amount": F.col("amount").desc_nulls_last()}, ["commitment_gift_fact_id"],
        ),
        (
            funds.best_positions(p.control_suggestions, funds.giving_audience(p.giving, policy.control_years)),
            "control ranking", [PERSON], by_position, fund,
        ),
        (
            funds.best_positions(p.test_suggestions, funds.giving_audience(p.giving, policy.final_years)),
            "final ranking", [PERSON], by_position, fund,
        ),
    ]
    return generic.union_all(
        [
            audit.ambiguous_picks(df, stage, keys, order, [F.col(v).asc_nulls_last() for v in values], values)
            for df, stage, keys, order, values in picks
        ]
    )


def _frequent_keys(p: MailingPlan) -> DataFrame:
    """Keys of the gift fact and of the ledger that at least 200 rows share."""
    return generic.union_all(
        [
            frequent_values(fact, keys, 200).withColumn("fact", F.lit(name))
            for name, fact, keys in (
                ("gift", p.wh.gift, ["fund_dim_id", "appeal_dim_id", "gift_type_dim_id"]),
                ("ledger", p.ledger, [PERSON, "fund"]),
            )
        ]
    )


def _annual(p: MailingPlan) -> DataFrame:
    """Years of production gifts by what they were."""
    annual = F.col("is_ag_gift") == fv.YES
    return years.year_bitmaps(
        p.production_gifts,
        [PERSON],
        {"own_annual": annual & (F.col("is_matching_gift") == fv.NO), "positive": F.col("amount") > 0},
    )


def _year_figures(p: MailingPlan) -> DataFrame:
    """Distinct years, last years and audience of everybody, from one table of bitmaps."""
    names = ["own_annual", "positive", "annual", "given"]
    parts = [
        _annual(p),
        years.year_bitmaps(p.annual_years, [PERSON], {"annual": F.lit(True)}),
        years.year_bitmaps(p.giving, [PERSON], {"given": F.col("amount") > 0}),
    ]
    whole = years.unite(
        [
            part.select(PERSON, "word", *[n if n in part.columns else F.lit(0).cast("bigint").alias(n) for n in names])
            for part in parts
        ],
        [PERSON],
        names,
    )
    return whole.groupBy(PERSON).agg(
        years.count_years("annual").alias("total_years"),
        years.last_year("own_annual").alias("last_annual_giving_year"),
        years.last_year("positive", [p.policy.report_year]).alias("last_year_before_report"),
        years.has_year("given", p.policy.segments.current_years).alias("is_current"),
    )


def _fund_years(p: MailingPlan) -> DataFrame:
    """Distinct and latest years of each person's gifts to a fund."""
    keys = [PERSON, "fund_identifier"]
    bits = years.year_bitmaps(p.production_gifts, keys, {"given": F.col("amount") > 0})
    return bits.groupBy(*keys).agg(
        years.count_years("given").alias("total_years"), years.last_year("given").alias("last_year")
    )


def _loyalty(p: MailingPlan) -> DataFrame:
    loyal = contacts.loyalty_years(p.wh.constituent_attribute).withColumn("_loyal", F.lit(True))
    rows = lookup(p.wh.constituent.select(PERSON), loyal, PERSON)
    return rows.select(
        PERSON,
        F.when(F.col("_loyal"), F.col("loyalty_years")).otherwise("0").alias("loyalty_years"),
    )


def _ask_ladder(p: MailingPlan) -> DataFrame:
    rows = merged_lookup(p.household_list, p.segments, PERSON)
    rows = lookup(rows, p.averages, PERSON)
    return rows.select(PERSON, *segments.ask_ladder())


def _unsolicitable(p: MailingPlan) -> DataFrame:
    return funds.unsolicitable_suggestions(
        p.control_ranking,
        p.final_ranking,
        p.segments,
        p.wh.fund,
        p.wh.fund_attribute,
        p.solicitable,
        test_segment=p.policy.audit_test_segment,
    )


QUERIES: dict[str, Callable[[MailingPlan], DataFrame]] = {
    # giving ledger
    "gift_ledger": lambda p: _ledger_rows(p.ledger),
    "giving_fy_strict": _giving(STRICT),
    "giving_fy_grace": _giving(GRACE),
    "giving_per_fiscal_year": lambda p: p.giving,
    "countable_amount": lambda p: _counted(p, GivingPolicy()).select(
        "cg_fact_id", "counted_year", "re_gift_type", "countable"
    ),
    "include_status_strict": _status(STRICT),
    "include_status_grace": _status(GRACE),
    "dedupe_payments": _dedupe_payments,
    "positive_totals": lambda p: giving.positive_totals(p.ledger, [PERSON, "fund"]),
    "credited_commitments": lambda p: giving.credited_commitments(p.ledger),
    "commitment_lineage": _lineage,
    "realized_planned_date": _realized,
    "first_last_by_type": lambda p: giving.first_last_by_type(p.ledger),
    "projected_gifts": _projected(2017),
    "projected_gifts_prior": _projected(2016),
    "calendar_misses": _calendar_misses,
    "production_gifts": lambda p: p.production_gifts,
    "translate_fund": lambda p: giving.translate_fund(
        p.wh.fund.select("fund_identifier"), p.solicitable, p.wh.fund_translation
    ),
    "solicitable_funds": lambda p: p.solicitable,
    # lists
    "include_list": lambda p: p.include_list,
    "exclude_list": lambda p: p.exclude_list,
    "never_donor_with_code": lambda p: lists.never_donor_with_code(
        p.wh.constituent, p.wh.primary_code, p.wh.constituent_code, p.wh.financial_information
    ),
    "mailability_rules": lambda p: lists.mailability_rules(
        p.wh.constituent, p.wh.constituent_code, p.wh.us_state
    ),
    "expand_to_spouse": lambda p: lists.expand_to_spouse(p.include_list, p.spouse_pairs),
    "household_list": lambda p: p.household_list,
    # contacts and dimensions
    "pick_one": _pick_major,
    "primary_education": lambda p: p.education,
    "fuzzy_date": lambda p: _education_rows(p).select(*contacts.EDUCATION_KEYS, "date_graduated"),
    "bad_dates": lambda p: quality.bad_dates(
        p.wh.education, "fuzzy_date_graduated", "class_year"
    ).select(PERSON, "fuzzy_date_graduated"),
    "recode": lambda p: _education_rows(p).select(PERSON, "school_type", "school_type_trans"),
    "clean_phone": lambda p: p.wh.phone.where(contacts.clean_phone_filter()).select(
        PERSON, "phone_type", "phone_number"
    ),
    "best_contact_home": lambda p: contacts.best_contact(p.wh.address, p.wh.phone),
    "best_contact_cell": lambda p: contacts.best_contact(p.wh.address, p.wh.phone, CELL_PHONE),
    "contact_sheet": lambda p: contacts.contact_sheet(p.wh.constituent, p.wh.address, p.wh.phone),
    "drop_empty": lambda p: p.phones,
    "donor_type": lambda p: p.donor_types,
    "primary_employer": lambda p: contacts.primary_employer(p.wh.relationship, p.wh.constituent),
    "attribute_lookup": lambda p: generic.attribute_lookup(
        p.wh.education_attribute,
        fv.DEPARTMENT_CATEGORY,
        contacts.EDUCATION_KEYS,
        order_by=["sequence"],
        name="department",
    ),
    "quality_violations": _quality,
    "duplicate_keys": lambda p: quality.duplicate_keys(p.wh.fund_translation, ["fund_identifier"]),
    # fund suggestions
    "rank_recency": lambda p: funds.rank_by_recency(p.affinity),
    "rank_money": lambda p: funds.rank_by_money(p.affinity),
    "rank_frequency": lambda p: funds.rank_by_frequency(p.affinity),
    "points_blend": lambda p: p.blend,
    "rule_cascade": lambda p: p.cascade,
    "control_suggestions": lambda p: p.control_suggestions,
    "test_suggestions": lambda p: p.test_suggestions,
    "dedupe_sequence_control": lambda p: p.control_ranking,
    "dedupe_sequence": lambda p: p.final_ranking,
    "pivot_top3": lambda p: generic.pivot_top_n(p.final_ranking, 3),
    # segments, asks, extract
    "segment": lambda p: p.segments,
    "year_totals": lambda p: segments.year_totals(p.giving, (2017, 2016)),
    "distinct_years": lambda p: segments.distinct_years(p.annual_years),
    "avg_per_year": lambda p: p.averages,
    "ask_ladder": _ask_ladder,
    "ask_snap": lambda p: p.asks,
    "last_giving_year": lambda p: segments.last_giving_year(
        segments.own_annual_gifts(p.production_gifts)
    ),
    "last_ledger_year": lambda p: segments.last_giving_year(
        segments.ledger_years(p.ledger, p.projections, p.policy.projection_reported_year)
    ),
    "last_year_before_report": lambda p: segments.last_giving_year(
        segments.gifts_outside(p.production_gifts, p.policy.report_year)
    ),
    "prior_total": lambda p: segments.prior_total(p.production_gifts, p.policy.report_year),
    "prior_total_last_year": lambda p: segments.prior_total(
        p.production_gifts, p.policy.report_year, last_year_only=True
    ),
    "year_amount": lambda p: segments.year_amount(p.giving, p.policy.prior_year),
    "manager_fallback": lambda p: segments.manager_fallback(p.wh.manager),
    "loyalty_years": _loyalty,
    "mail_extract": lambda p: p.mail_extract,
    # stages, refreshes and sets of years
    "extract_bucketed": _extract_from_store,
    "giving_incremental": _giving_incremental,
    "year_bitmaps": _annual,
    "year_figures": _year_figures,
    "fund_years": _fund_years,
    # windows, ordered files, audits
    "giving_from_windows": _giving_from_windows,
    "extract_positions": _extract_positions,
    "extract_order": _extract_order,
    "ambiguous_picks": _ambiguous,
    "frequent_keys": _frequent_keys,
    # analysis
    "unsolicitable_funds": _unsolicitable,
    "unmapped_translations": lambda p: funds.unmapped_translations(
        p.wh.fund_translation, p.wh.solicitable_fund
    ),
}


def _as_double(df: DataFrame) -> DataFrame:
    """Decimals as double, everything else as it is."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# Queries that read each of their stages once; the others keep shared stages as
# tables.
SINGLE_PASS = {
    "gift_ledger",
    "dedupe_payments",
    "positive_totals",
    "credited_commitments",
    "first_last_by_type",
    "production_gifts",
    "primary_education",
    "last_ledger_year",
    "distinct_years",
    "rank_recency",
    "rank_money",
    "rank_frequency",
    "points_blend",
    "last_giving_year",
    "last_year_before_report",
    "prior_total",
    "prior_total_last_year",
}


# Stages that have one reader in these queries: they are not written.  Rankings and cascade are: with
# the joins and windows of the suggestions in one stage they took a task 1,106 MB of memory for 432.
READ_ONCE = {
    "dedupe_sequence": {"production_gifts", "giving"},
    "dedupe_sequence_control": {"production_gifts", "giving"},
    "pivot_top3": {"production_gifts", "giving"},
    "household_list": {"giving", "annual_years", "household_list"},
    "segment": {"household_list", "segments"},
    "ask_ladder": {"segments"},
    "ask_snap": {"segments"},
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        mode = "lazy" if name in SINGLE_PASS else "table" if shared else "persist"
        warehouse = retail_warehouse(spark, sf_dir, "table" if shared else "lazy")
        plan = MailingPlan(warehouse, ExtractPolicy(), mode, read_once=READ_ONCE.get(name, ()))
        return _as_double(QUERIES[name](plan))

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Giving per person and fiscal year on the smallest data set."""
    return queries()["giving_per_fiscal_year"](spark, FLAGSHIP_DIR)


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators, where they are installed."""
    try:
        import corpus_pipeline
        from patronage.llm import queries as llm
    except ImportError as error:
        warnings.warn(f"without the training-data operators: {error}", stacklevel=2)
        return {}, {}
    sql = dict(llm.SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return {name: _query(name) for name in QUERIES} | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    """The same results in SQL for DuckDB."""
    return {name: oracle(name) for name in FINAL} | _training_data()[1]
