from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage import fixed_values as fv
from patronage.functions import (
    blank,
    contains_any,
    fiscal_year,
    fuzzy_date,
    money_text,
    rank_points,
    recode,
    starts_with_any,
    strip_chars,
)


def one(spark, column, **values):
    """Value of a column over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(
        column.alias("x")
    ).first()["x"]


@pytest.mark.parametrize(
    ("day", "year"),
    [(date(2015, 6, 30), 2015), (date(2015, 7, 1), 2016), (date(2016, 1, 1), 2016)],
)
def test_fiscal_year(spark, day, year):
    assert one(spark, fiscal_year("d"), d=day) == year


@pytest.mark.parametrize(
    ("text", "class_year", "expected"),
    [
        ("1999", None, datetime(1999, 5, 1)),
        ("199908", None, datetime(1999, 8, 1)),
        ("19990512", None, datetime(1999, 5, 12)),
        ("1999  ", None, datetime(1999, 5, 1)),
        (None, 1987, datetime(1987, 5, 1)),
        ("", 1987, datetime(1987, 5, 1)),
        ("199", 1987, datetime(1987, 5, 1)),
        ("199913", 1987, None),
        (None, None, None),
    ],
)
def test_fuzzy_date(spark, text, class_year, expected):
    row = spark.createDataFrame([(text, class_year)], "t string, y int")
    assert row.select(fuzzy_date("t", "y").alias("x")).first()["x"] == expected


def test_recode_keeps_unknown_codes(spark):
    rows = spark.createDataFrame([("SSB",), ("Other",), (None,)], "c string")
    got = [r[0] for r in rows.select(recode("c", fv.SCHOOL_TYPE_RECODE)).collect()]
    assert got == ["Business", "Other", None]


@pytest.mark.parametrize(
    ("amount", "text"), [("12.3", "12.30"), ("0.005", "0.01"), ("1000", "1000.00")]
)
def test_money_text(spark, amount, text):
    assert one(spark, money_text("m"), m=Decimal(amount)) == text


def test_text_matching_ignores_case_and_takes_fragments_literally(spark):
    assert one(spark, contains_any("t", [".com"]), t="A.COM")
    assert not one(spark, contains_any("t", [".com"]), t="Acom")
    assert one(spark, starts_with_any("t", ["Home Cell"]), t="home cell 2")
    assert not one(spark, starts_with_any("t", ["Home"]), t="My Home")


def test_blank(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), (" x",)], "t string")
    assert [r[0] for r in rows.select(blank("t")).collect()] == [True, True, True, False]


def test_strip_chars(spark):
    assert one(spark, strip_chars("t"), t="(405) 555-1.234") == "4055551234"


def test_rank_points(spark):
    rows = spark.range(1, 7).select(rank_points("id").alias("p"))
    assert [r["p"] for r in rows.collect()] == [4, 3, 2, 1, 0, 0]
