from .columns import (
    MONEY,
    active_individual,
    blank,
    contains_any,
    fiscal_year,
    fuzzy_date,
    is_yes,
    money,
    money_text,
    or_empty,
    rank_points,
    recode,
    starts_with_any,
    strip_chars,
)

__all__ = [
    "MONEY",
    "active_individual",
    "blank",
    "contains_any",
    "fiscal_year",
    "fuzzy_date",
    "is_yes",
    "money",
    "money_text",
    "or_empty",
    "rank_points",
    "recode",
    "starts_with_any",
    "strip_chars",
]
