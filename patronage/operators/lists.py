"""Audience lists: who is in, who is out, and one row per household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import blank, or_empty, starts_with_any
from ..policy import AudiencePolicy
from .generic import PERSON, drop_members, flag_members, keep_members, union_all
from .skew import balanced_lookup, lookup


def include_list(
    giving: DataFrame,
    annual_years: DataFrame,
    primary_code: DataFrame,
    policy: AudiencePolicy = AudiencePolicy(),
) -> DataFrame:
    """Donors of the given years and annual-giving donors, by primary code.

    ``annual_years`` is :func:`giving.annual_giving_years`.
    """
    first, last = policy.annual_giving_years
    donors = giving.where(F.col("fiscal_year").isin(*policy.giving_years)).select(PERSON)
    annual = annual_years.where(F.col("fiscal_year").between(first, last)).select(PERSON)
    coded = primary_code.where(F.col("constituent_code").isin(*policy.included_codes))
    return keep_members(union_all([donors, annual]).distinct(), coded)


def never_donor_with_code(
    constituent: DataFrame,
    primary_code: DataFrame,
    constituent_code: DataFrame,
    financial_information: DataFrame,
    policy: AudiencePolicy = AudiencePolicy(),
) -> DataFrame:
    """Friends with a given secondary code who never gave."""
    friends = primary_code.where(F.col("constituent_code") == policy.friend_code)
    coded = constituent_code.where(F.col("constituent_code").isin(*policy.never_donor_codes))
    donors = financial_information.where(
        (F.col("information_type") == fv.LIFETIME_GIVING_TYPE)
        & (F.col("information_source") == fv.LIFETIME_GIVING_SOURCE)
        & (F.col("value") > 0)
    )
    people = keep_members(keep_members(constituent.select(PERSON), friends), coded)
    return drop_members(people, donors)


def mailability_reason(policy: AudiencePolicy = AudiencePolicy()) -> Column:
    """First reason why a record cannot be mailed, NULL when it can.

    Needs the flags ``is_held`` and ``is_home_state`` next to the constituent's
    columns.
    """
    address = F.rtrim("address1")
    rules: list[tuple[str, Column]] = [
        ("held record", F.col("is_held")),
        ("not a constituent", F.col("is_a_constituent") == fv.NO),
        ("deceased", F.col("is_deceased") == fv.YES),
        ("no valid address", F.col("no_valid_address") == fv.YES),
        ("inactive", F.col("is_inactive") == fv.YES),
        ("organisation", F.col("key_indicator") == fv.ORGANISATION),
        ("no mail", F.col("send_mail") == fv.NO),
        ("foreign country", ~or_empty(F.rtrim("country")).isin(*policy.home_countries)),
        ("foreign state", F.col("is_home_state").isNull()),
        ("no address", blank("address1")),
        ("no city", blank("city")),
        ("no state", blank("state")),
        ("no post code", blank("post_code")),
        ("duplicate record", starts_with_any(address, fv.DUPLICATE_ADDRESS_PREFIXES)),
        ("anonymous", F.col("full_name").ilike(fv.ANONYMOUS_NAME_PATTERN)),
        ("unknown name", F.rtrim("full_name").ilike(fv.UNKNOWN_NAME_PATTERN)),
    ]
    (first_reason, first_test), *rest = rules
    reason = F.when(first_test, first_reason)
    for name, test in rest:
        reason = reason.when(test, name)
    return reason


def mailability_rules(
    constituent: DataFrame,
    constituent_code: DataFrame,
    us_state: DataFrame,
    policy: AudiencePolicy = AudiencePolicy(),
) -> DataFrame:
    """Records that cannot be mailed, with the first reason."""
    people = constituent.where(
        F.col("constituent_id").isNotNull() & (F.col(PERSON) != fv.UNKNOWN_MEMBER_KEY)
    ).select(
        PERSON,
        "is_a_constituent",
        "is_deceased",
        "no_valid_address",
        "is_inactive",
        "key_indicator",
        "send_mail",
        "country",
        "state",
        "address1",
        "city",
        "post_code",
        "full_name",
        or_empty(F.rtrim("state")).alias("state_key"),
    )
    held = constituent_code.where(F.col("constituent_code").isin(*policy.held_codes))
    states = us_state.where(F.col("state").isNotNull()).select(F.rtrim("state").alias("state_key"))
    rows = lookup(people, flag_members(held, "is_held"), PERSON)
    rows = balanced_lookup(
        rows,
        flag_members(states, "is_home_state", "state_key"),
        "state_key",
        measure=people,
        by=[PERSON],
    )
    return rows.select(PERSON, mailability_reason(policy).alias("reason")).where(
        F.col("reason").isNotNull()
    )


def exclude_list(
    constituent: DataFrame,
    primary_code: DataFrame,
    position: DataFrame,
    constituent_code: DataFrame,
    financial_information: DataFrame,
    constituent_attribute: DataFrame,
    us_state: DataFrame,
    policy: AudiencePolicy = AudiencePolicy(),
) -> DataFrame:
    """Everyone a rule excludes: distinct (person, rule)."""

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select(PERSON, F.lit(name).alias("rule"))

    code = F.col("constituent_code")
    solicit = (F.col("attribute_category") == fv.SOLICIT_CATEGORY) & F.col(
        "attribute_description"
    ).isin(*policy.solicit_codes)
    return union_all(
        [
            rule(position.where(F.col("position").isin(*policy.excluded_positions)), "position"),
            rule(primary_code.where(code.isin(*policy.excluded_codes)), "primary code"),
            rule(constituent_code.where(code == policy.staff_code), "staff"),
            rule(
                never_donor_with_code(
                    constituent, primary_code, constituent_code, financial_information, policy
                ),
                "never gave",
            ),
            rule(constituent_attribute.where(solicit), "solicit code"),
            rule(mailability_rules(constituent, constituent_code, us_state, policy), "not mailable"),
        ]
    ).distinct()


def spouse_pairs(constituent: DataFrame) -> DataFrame:
    """Person and the spouse's key, for spouses that have an id."""
    spouses = constituent.where(F.col("constituent_id").isNotNull()).select(
        F.col("constituent_system_id").alias("spouse_constituent_system_id"),
        F.col(PERSON).alias("spouse_dim_id"),
    )
    people = constituent.where(F.col("spouse_constituent_system_id").isNotNull()).select(
        PERSON, "spouse_constituent_system_id"
    )
    return lookup(people, spouses, "spouse_constituent_system_id", "inner").select(
        PERSON, "spouse_dim_id"
    )


def expand_to_spouse(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members and their spouses, each once."""
    spouses = keep_members(pairs, members).select(F.col("spouse_dim_id").alias(PERSON))
    return union_all([members.select(PERSON), spouses]).distinct()


def household_list(
    include: DataFrame, exclude: DataFrame, constituent: DataFrame, pairs: DataFrame | None = None
) -> DataFrame:
    """Household heads among the included who are not excluded.

    Both lists count for a member's spouse as well.
    """
    pairs = spouse_pairs(constituent) if pairs is None else pairs
    heads = constituent.where(
        F.col("constituent_id").isNotNull()
        & (F.col(PERSON) != fv.UNKNOWN_MEMBER_KEY)
        & (F.col("constituent_system_id") == F.col("household_system_id"))
    ).select(PERSON)
    eligible = keep_members(heads, expand_to_spouse(include, pairs))
    return drop_members(eligible, expand_to_spouse(exclude, pairs))
