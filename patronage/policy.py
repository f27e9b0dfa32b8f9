"""Business rules as parameters.

Each operator takes one of these frozen dataclasses; the defaults are the
warehouse's fixed values, and another campaign only needs another instance.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from . import fixed_values as fv


@dataclass(frozen=True)
class GivingPolicy:
    """How gifts count towards a fiscal year."""

    strict_years: tuple[int, ...] = fv.STRICT_YEARS
    grace_years: tuple[int, ...] = fv.GRACE_YEARS
    grace_last_counted: tuple[int, int] = fv.GRACE_LAST_COUNTED_DAY
    grace_last_excluded: tuple[int, int] = fv.GRACE_LAST_EXCLUDED_DAY
    membership_funds: tuple[str, ...] = fv.MEMBERSHIP_FUNDS
    no_planned_gift_date: date = fv.NO_PLANNED_GIFT_DATE
    use_original_planned_date: bool = False


@dataclass(frozen=True)
class ProjectionPolicy:
    """Which scheduled but unpaid gifts stand in for ledger rows."""

    fiscal_year: int = 2017
    committed_before: date = fv.PROJECTION_COMMITTED_BEFORE[2017]


@dataclass(frozen=True)
class AudiencePolicy:
    """Who may and who may not receive the mailing."""

    giving_years: tuple[int, ...] = fv.CURRENT_YEARS
    annual_giving_years: tuple[int, int] = (fv.ANNUAL_GIVING_SINCE, fv.REPORT_YEAR)
    included_codes: tuple[str, ...] = fv.INCLUDED_PRIMARY_CODES
    excluded_positions: tuple[str, ...] = fv.EXCLUDED_POSITIONS
    excluded_codes: tuple[str, ...] = fv.EXCLUDED_PRIMARY_CODES
    staff_code: str = fv.STAFF_CODE
    friend_code: str = fv.FRIEND_CODE
    never_donor_codes: tuple[str, ...] = fv.NEVER_DONOR_SECONDARY_CODES
    solicit_codes: tuple[str, ...] = fv.EXCLUDED_SOLICIT_CODES
    held_codes: tuple[str, ...] = fv.HELD_RECORD_CODES
    home_countries: tuple[str, ...] = fv.HOME_COUNTRIES


@dataclass(frozen=True)
class PhonePolicy:
    """Which phone number of a person is the best one."""

    address_type: str = fv.HOME_ADDRESS
    preferred_ladder: tuple[str, ...] = fv.HOME_PHONE_PREFERRED_LADDER
    other_ladder: tuple[str, ...] = fv.HOME_PHONE_OTHER_LADDER
    type_prefixes: tuple[str, ...] = fv.HOME_PHONE_PREFIXES


HOME_PHONE = PhonePolicy()
CELL_PHONE = PhonePolicy(
    preferred_ladder=fv.CELL_PHONE_PREFERRED_LADDER,
    other_ladder=fv.CELL_PHONE_OTHER_LADDER,
    type_prefixes=fv.CELL_PHONE_PREFIXES,
)


@dataclass(frozen=True)
class FundRule:
    """One line of the suggestion cascade: who qualifies for which fund.

    ``own_order`` ranks the suggestion for the person who qualifies,
    ``spouse_order`` for that person's spouse (``None``: spouse gets nothing).
    """

    audience: str  # everyone | graduate | honors | school
    fund: str
    own_order: int
    spouse_order: int | None = None
    school: str | None = None
    label: str = "Specified Fund"


def _school(fund: str, order: int, school: str) -> FundRule:
    return FundRule("school", fund, order, order, school)


CASCADE: tuple[FundRule, ...] = (
    FundRule("everyone", fv.GENERAL_SCHOLARSHIP_FUND, 108),
    FundRule("graduate", fv.GRADUATE_COLLEGE_FUND, 109, 109, label="Grad College"),
    FundRule("honors", fv.HONORS_COLLEGE_FUND, 110, 110, label="Honors College"),
    _school(fv.HOMECOMING_FUND, 111, fv.MAIN_SCHOOL),
    _school(fv.STUDENT_SUCCESS_FUND, 112, fv.MAIN_SCHOOL),
    _school(fv.HEALTH_EXCELLENCE_FUND, 113, fv.HEALTH_SCHOOL),
    _school(fv.HEALTH_SCHOLARSHIP_FUND, 114, fv.HEALTH_SCHOOL),
    _school(fv.TECHNOLOGY_EXCELLENCE_FUND, 115, fv.TECHNOLOGY_SCHOOL),
    _school(fv.TECHNOLOGY_SCHOLARSHIP_FUND, 116, fv.TECHNOLOGY_SCHOOL),
    _school(fv.CITY_EXCELLENCE_FUND, 117, fv.CITY_SCHOOL),
    _school(fv.CITY_SCHOLARSHIP_FUND, 118, fv.CITY_SCHOOL),
    FundRule("everyone", fv.GENERAL_SCHOLARSHIP_FUND, 119),
    FundRule("everyone", fv.PET_THERAPY_FUND, 120),
    FundRule("everyone", fv.VETERANS_FUND, 121),
)


@dataclass(frozen=True)
class SuggestionPolicy:
    """Points, rules and audiences of the fund suggestions."""

    points: tuple[int, ...] = fv.RANK_POINTS
    cascade: tuple[FundRule, ...] = CASCADE
    department_orders: tuple[tuple[int, int], tuple[int, int]] = ((100, 101), (102, 103))
    college_orders: tuple[tuple[int, int], tuple[int, int]] = ((104, 105), (106, 107))
    control_years: tuple[int, int] = fv.CONTROL_AUDIENCE_YEARS
    final_years: tuple[int, int] = fv.FINAL_AUDIENCE_YEARS
    frequent_funds: int = 3
    blended_funds: int = 4


@dataclass(frozen=True)
class SegmentPolicy:
    """Segment names and the donor-type bucket that decides them."""

    current_years: tuple[int, ...] = fv.CURRENT_YEARS
    lapsed_bucket: str = fv.LAPSED_BUCKET
    current: str = fv.SEGMENT_CURRENT
    lapsed_4plus: str = fv.SEGMENT_LAPSED_4PLUS
    lapsed_one_year: str = fv.SEGMENT_LAPSED_ONE_YEAR
    lapsed_multi_year: str = fv.SEGMENT_LAPSED_MULTI_YEAR


@dataclass(frozen=True)
class ExtractPolicy:
    """Everything the mailing extract needs."""

    giving: GivingPolicy = field(default_factory=GivingPolicy)
    projection: ProjectionPolicy = field(default_factory=ProjectionPolicy)
    audience: AudiencePolicy = field(default_factory=AudiencePolicy)
    suggestions: SuggestionPolicy = field(default_factory=SuggestionPolicy)
    segments: SegmentPolicy = field(default_factory=SegmentPolicy)
    home_phone: PhonePolicy = HOME_PHONE
    cell_phone: PhonePolicy = CELL_PHONE
    donor_type_year: int = fv.DONOR_TYPE_YEAR
    report_year: int = fv.REPORT_YEAR
    prior_year: int = fv.PRIOR_YEAR
    projection_reported_year: int = fv.PROJECTION_REPORTED_YEAR
    appeal_package: str = fv.APPEAL_PACKAGE
    audit_test_segment: str = fv.SEGMENT_TEST_ARRAY
    last_year_only: bool = False
