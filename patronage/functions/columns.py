"""Column expressions shared by the operators.

All of them are compositions of Spark built-ins, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F, types as T

from .. import fixed_values as fv

MONEY = T.DecimalType(19, 4)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    return _col(c).cast(MONEY)


def fiscal_year(c: Column | str, start_month: int = fv.FISCAL_YEAR_START_MONTH) -> Column:
    """Fiscal year a date falls in; the year is named after its last month."""
    c = _col(c)
    return (F.year(c) + (F.month(c) >= start_month).cast("int")).cast("int")


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def blank(c: Column | str) -> Column:
    """NULL, empty or only blanks."""
    return or_empty(F.rtrim(_col(c))) == ""


def is_yes(c: Column | str) -> Column:
    return _col(c) == fv.YES


def active_individual(prefix: str = "") -> Column:
    """Living, active person (not an organisation)."""
    return (
        (F.col(f"{prefix}key_indicator") == fv.INDIVIDUAL)
        & (F.col(f"{prefix}is_deceased") == fv.NO)
        & (F.col(f"{prefix}is_inactive") == fv.NO)
    )


def _quoted(fragments: Iterable[str]) -> str:
    return "|".join(rf"\Q{f}\E" for f in fragments)


def contains_any(c: Column | str, fragments: Sequence[str]) -> Column:
    """True where the text holds one of the literal fragments, ignoring case."""
    return _col(c).rlike(f"(?i)(?:{_quoted(fragments)})")


def starts_with_any(c: Column | str, prefixes: Sequence[str]) -> Column:
    """True where the text starts with one of the literal prefixes, ignoring case."""
    return _col(c).rlike(f"(?i)^(?:{_quoted(prefixes)})")


def strip_chars(c: Column | str, chars: str = fv.PHONE_PUNCTUATION) -> Column:
    return F.translate(_col(c), chars, "")


def fuzzy_date(text: Column | str, class_year: Column | str) -> Column:
    """Timestamp from ``YYYY``, ``YYYYMM`` or ``YYYYMMDD``, else the class year.

    A text of another length falls back to the class year; a text of the right
    length that is no date gives NULL (count those with ``quality.bad_dates``).
    """
    t = F.rtrim(_col(text))
    size = F.length(t)
    year, month, day = F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)
    iso = (
        F.when(size == 4, F.concat(year, F.lit(fv.FUZZY_DATE_MONTH_DAY)))
        .when(size == 6, F.concat_ws("-", year, month, F.lit("01")))
        .when(size == 8, F.concat_ws("-", year, month, day))
        .otherwise(
            F.concat(F.substring(_col(class_year).cast("string"), 1, 4), F.lit(fv.FUZZY_DATE_MONTH_DAY))
        )
    )
    return iso.try_cast("timestamp_ntz")


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Translate codes, leaving unknown ones as they are."""
    c = _col(c)
    found = None
    for code, label in mapping.items():
        found = F.when(c == code, label) if found is None else found.when(c == code, label)
    return c if found is None else found.otherwise(c)


def money_text(c: Column | str) -> Column:
    """Money as text with two decimals."""
    return F.round(_col(c), 2).cast(T.DecimalType(19, 2)).cast("string")


def rank_points(rank: Column | str, points: Sequence[int] = fv.RANK_POINTS) -> Column:
    """Points of a rank: ``points[0]`` for rank 1 and so on, then 0."""
    rank = _col(rank)
    scale = F.array(*[F.lit(p) for p in points])
    return F.coalesce(F.try_element_at(scale, rank.cast("int")), F.lit(0))
