"""Fund suggestions: affinity rankings and the prioritised rule cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import MONEY, blank, rank_points
from ..policy import FundRule, SuggestionPolicy
from .generic import PERSON, keep_members, ranked, union_all
from .skew import balanced_lookup, lookup, merged_lookup

FUND = "fund_identifier_trans"
SUGGESTION_COLUMNS = (
    PERSON,
    "fund_identifier",
    "fund_description",
    "designations_order",
    "data_source",
)


# --- rankings -------------------------------------------------------------


def fund_affinity(gifts: DataFrame, fund: DataFrame) -> DataFrame:
    """Last date, total and number of own gifts per person and known fund.

    All three rankings read this one aggregate.  It combines before the shuffle
    and leaves at most one row per fund and person for the windows after it.
    """
    known = fund.select(F.col("fund_identifier").alias(FUND))
    totals = (
        gifts.where(F.col("is_matching_gift") == fv.NO)
        .groupBy(PERSON, FUND)
        .agg(
            F.max("gift_date").alias("gift_date"),
            F.sum("amount").cast(MONEY).alias("amount"),
            F.count(F.lit(1)).alias("gift_count"),
        )
    )
    return balanced_lookup(totals, known, FUND, "left_semi", measure=gifts)


def _rank_by(affinity: DataFrame, measure: str, name: str = "seq") -> DataFrame:
    return ranked(affinity, [PERSON], [F.col(measure).desc_nulls_last(), F.col(FUND)], name)


def rank_by_recency(affinity: DataFrame) -> DataFrame:
    return _rank_by(affinity, "gift_date").select(PERSON, FUND, "gift_date", "seq")


def rank_by_money(affinity: DataFrame) -> DataFrame:
    return _rank_by(affinity, "amount").select(PERSON, FUND, "amount", "seq")


def rank_by_frequency(affinity: DataFrame) -> DataFrame:
    return _rank_by(affinity, "gift_count").select(PERSON, FUND, "gift_count", "seq")


def rank_all(affinity: DataFrame) -> DataFrame:
    """The three rankings side by side, sharing one shuffle."""
    rows = _rank_by(affinity, "gift_date", "recency_seq")
    rows = _rank_by(rows, "gift_count", "frequency_seq")
    return _rank_by(rows, "amount", "money_seq")


def points_blend(rankings: DataFrame, points: Sequence[int] = fv.RANK_POINTS) -> DataFrame:
    """Points for the top ranks of each ranking, added up and ranked again."""
    total = sum(
        (rank_points(c, points) for c in ("recency_seq", "frequency_seq", "money_seq")), F.lit(0)
    )
    scored = rankings.select(PERSON, FUND, total.cast("int").alias("total_points")).where(
        F.col("total_points") > 0
    )
    return ranked(scored, [PERSON], [F.col("total_points").desc(), F.col(FUND)])


# --- rule cascade ---------------------------------------------------------


def _suggestion(receiver: Column, fund: Column, order: int, label: str) -> Column:
    return F.struct(
        receiver.alias(PERSON),
        fund.alias("fund_identifier"),
        F.lit(order).alias("designations_order"),
        F.lit(label).alias("data_source"),
    )


def _exploded(rows: DataFrame, suggestions: Sequence[Column]) -> DataFrame:
    """One row per suggestion that applies."""
    return rows.select(
        F.explode(F.array_compact(F.array(*suggestions))).alias("s")
    ).select("s.*")


def eligibility(
    constituent: DataFrame,
    degrees: DataFrame,
    education: DataFrame,
    education_attribute: DataFrame,
    pairs: DataFrame,
) -> DataFrame:
    """What decides the cascade, one row per person.

    ``degrees`` is the primary-education stage, ``education`` the raw table.
    People known only from the education tables stay in.
    """
    graduate = F.lit(False)
    for fragment in fv.GRADUATE_DEGREE_FRAGMENTS:
        graduate = graduate | F.col("degree").ilike(f"%{fragment}%")
    graduates = education.where((F.col("school_name") == fv.MAIN_SCHOOL) & graduate)
    honors = education_attribute.where(
        (F.col("attribute_category") == fv.HONORS_CATEGORY)
        & (F.col("attribute_description") == fv.YES)
    )
    academic = (
        union_all(
            [
                graduates.select(PERSON, F.lit(True).alias("graduate"), F.lit(False).alias("honors")),
                honors.select(PERSON, F.lit(False).alias("graduate"), F.lit(True).alias("honors")),
            ]
        )
        .groupBy(PERSON)
        .agg(F.max("graduate").alias("is_graduate"), F.max("honors").alias("is_honors"))
    )
    active = (
        F.col("constituent_id").isNotNull()
        & (F.col("key_indicator") == fv.INDIVIDUAL)
        & (F.col("is_inactive") == fv.NO)
    )
    people = constituent.select(PERSON, active.alias("is_active"))
    rows = people.join(academic, PERSON, "full_outer")
    rows = merged_lookup(rows, degrees.select(PERSON, "school_name"), PERSON)
    return merged_lookup(rows, pairs, PERSON)


def _audience_test(rule: FundRule) -> Column:
    return {
        "everyone": F.col("is_active"),
        "graduate": F.col("is_graduate"),
        "honors": F.col("is_honors"),
        "school": F.col("is_active") & (F.col("school_name") == rule.school),
    }[rule.audience]


def specified_funds(people: DataFrame, rules: Sequence[FundRule]) -> DataFrame:
    """All fixed-fund rules in one pass over the people."""
    suggestions = []
    for rule in rules:
        applies = _audience_test(rule)
        suggestions.append(
            F.when(
                applies, _suggestion(F.col(PERSON), F.lit(rule.fund), rule.own_order, rule.label)
            )
        )
        if rule.spouse_order is not None:
            spouse = F.col("spouse_dim_id")
            suggestions.append(
                F.when(
                    applies & spouse.isNotNull(),
                    _suggestion(spouse, F.lit(rule.fund), rule.spouse_order, rule.label),
                )
            )
    return _exploded(people, suggestions)


def academic_funds(
    degrees: DataFrame, department_fund: DataFrame, pairs: DataFrame, policy: SuggestionPolicy
) -> DataFrame:
    """Department and college funds of a person's degree, for person and spouse.

    A department rule that names a major still reaches the spouse.
    """
    people = merged_lookup(degrees.select(PERSON, "school_type_trans", "department"), pairs, PERSON)
    rules = department_fund.select(
        F.col("college").alias("school_type_trans"),
        F.col("degree_department").alias("rule_department"),
        blank("degree_department").alias("whole_college"),
        blank("degree_major_description").alias("any_major"),
        "fund_id1",
        "fund_id2",
    )
    by_department = rules.where(~F.col("whole_college")).withColumnRenamed(
        "rule_department", "department"
    )
    by_college = rules.where(F.col("whole_college") & F.col("any_major"))

    def suggestions(
        orders: tuple[tuple[int, int], ...], labels: Sequence[str], spouse_labels: Sequence[str]
    ) -> list[Column]:
        spouse = F.col("spouse_dim_id")
        result = []
        for number, (own, other) in enumerate(orders, start=1):
            fund = F.col(f"fund_id{number}")
            has_fund = fund.isNotNull()
            result.append(
                F.when(
                    has_fund & F.col("any_major"),
                    _suggestion(F.col(PERSON), fund, own, labels[number - 1]),
                )
            )
            result.append(
                F.when(
                    has_fund & spouse.isNotNull(),
                    _suggestion(spouse, fund, other, spouse_labels[number - 1]),
                )
            )
        return result

    departments = balanced_lookup(
        people, by_department, ["school_type_trans", "department"], "inner", degrees
    )
    colleges = balanced_lookup(people, by_college, "school_type_trans", "inner", degrees)
    return union_all(
        [
            _exploded(departments, suggestions(policy.department_orders, fv.SOURCE_DEPARTMENT, fv.SOURCE_SPOUSE_DEPARTMENT)),
            _exploded(colleges, suggestions(policy.college_orders, fv.SOURCE_COLLEGE, fv.SOURCE_SPOUSE_COLLEGE)),
        ]
    )


def with_fund(rows: DataFrame, fund: DataFrame) -> DataFrame:
    """Add the description; suggestions of unknown funds drop out."""
    known = fund.select("fund_identifier", "fund_description")
    return balanced_lookup(rows, known, "fund_identifier", "inner").select(*SUGGESTION_COLUMNS)


def rule_cascade(
    people: DataFrame,
    degrees: DataFrame,
    department_fund: DataFrame,
    pairs: DataFrame,
    fund: DataFrame,
    policy: SuggestionPolicy = SuggestionPolicy(),
) -> DataFrame:
    """Every suggestion the rules give, with its priority."""
    return with_fund(
        union_all(
            [
                academic_funds(degrees, department_fund, pairs, policy),
                specified_funds(people, policy.cascade),
            ]
        ),
        fund,
    )


# --- suggestions ----------------------------------------------------------


def _from_ranking(rows: DataFrame, order: Column, label: str) -> DataFrame:
    return rows.select(
        PERSON,
        F.col(FUND).alias("fund_identifier"),
        order.cast("int").alias("designations_order"),
        F.lit(label).alias("data_source"),
    )


def control_suggestions(
    rankings: DataFrame,
    cascade: DataFrame,
    fund: DataFrame,
    policy: SuggestionPolicy = SuggestionPolicy(),
) -> DataFrame:
    """Biggest fund first, then the most frequent ones, then the cascade."""
    by_money = _from_ranking(rankings.where(F.col("money_seq") == 1), F.lit(1), fv.SOURCE_MOST_MONEY)
    frequent = _from_ranking(
        rankings.where(F.col("frequency_seq") <= policy.frequent_funds),
        F.col("frequency_seq") + 1,
        fv.SOURCE_MOST_FREQUENT,
    )
    return union_all([with_fund(union_all([by_money, frequent]), fund), cascade])


def test_suggestions(
    blend: DataFrame,
    cascade: DataFrame,
    fund: DataFrame,
    policy: SuggestionPolicy = SuggestionPolicy(),
) -> DataFrame:
    """Best blended funds first, then the cascade."""
    best = _from_ranking(
        blend.where(F.col("seq") <= policy.blended_funds), F.col("seq"), fv.SOURCE_MOST_POINTS
    )
    return union_all([with_fund(best, fund), cascade])


def giving_audience(giving: DataFrame, years: tuple[int, int]) -> DataFrame:
    """People with giving in a span of fiscal years."""
    return giving.where(F.col("fiscal_year").between(*years)).select(PERSON).distinct()


def dedupe_and_sequence(suggestions: DataFrame, audience: DataFrame) -> DataFrame:
    """Each fund once per person at its best position, renumbered from 1."""
    best = best_positions(suggestions, audience)
    return ranked(
        best, [PERSON], [F.col("best_order"), F.col("fund_identifier"), F.col("fund_description")]
    ).drop("best_order")


def best_positions(suggestions: DataFrame, audience: DataFrame) -> DataFrame:
    """Each fund once per person of the audience, at its best position."""
    return (
        keep_members(suggestions, audience)
        .groupBy(PERSON, "fund_identifier", "fund_description")
        .agg(F.min("designations_order").alias("best_order"))
    )


# --- analysis -------------------------------------------------------------


def unsolicitable_suggestions(
    control: DataFrame,
    test: DataFrame,
    segments: DataFrame,
    fund: DataFrame,
    fund_attribute: DataFrame,
    solicitable: DataFrame,
    depth: int = 10,
    test_segment: str = fv.SEGMENT_TEST_ARRAY,
) -> DataFrame:
    """Funds suggested within the first ``depth`` that cannot be solicited."""
    in_test = F.col("marketing_segment") == test_segment

    def suggested(ranking: DataFrame, members: DataFrame) -> DataFrame:
        top = ranking.where(F.col("seq") <= depth)
        return keep_members(top, members).select("fund_identifier")

    def attribute(category: str, name: str) -> DataFrame:
        return fund_attribute.where(F.col("attribute_category") == category).select(
            "fund_dim_id", F.col("attribute_description").alias(name)
        )

    ids = union_all(
        [suggested(control, segments.where(~in_test)), suggested(test, segments.where(in_test))]
    ).distinct()
    rows = fund.select("fund_dim_id", "fund_identifier", "fund_description")
    rows = rows.join(ids, "fund_identifier", "left_semi").join(
        solicitable.select("fund_identifier"), "fund_identifier", "left_anti"
    )
    for category, name in (("College", "college"), ("Department", "department")):
        rows = lookup(rows, attribute(category, name), "fund_dim_id")
    return rows.select(
        "fund_identifier",
        "fund_description",
        F.coalesce("college", F.lit("")).alias("college"),
        F.coalesce("department", F.lit("")).alias("department"),
    ).distinct()


def unmapped_translations(translation: DataFrame, campaign_list: DataFrame) -> DataFrame:
    """Translations whose suggested fund is not on the campaign's list."""
    listed = campaign_list.select(F.col("designation").alias("suggested_fund_identifier"))
    return translation.join(listed, "suggested_fund_identifier", "left_anti").select(
        *translation.columns
    )
