"""Giving that is kept by fiscal year and refreshed only where gifts changed.

The table is partitioned by fiscal year.  A refresh computes the touched years alone, by a
policy cut down to them, so that the ledger's filter reaches the scan, and replaces their
partitions in one write (dynamic partition overwrite).  A year that lost all its rows is
dropped.  The same refresh again replaces the partitions by the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..policy import GivingPolicy
from . import giving
from .generic import PERSON

YEAR = "fiscal_year"


def years_policy(policy: GivingPolicy, years: Sequence[int]) -> GivingPolicy:
    """A policy that counts in these years only."""
    return replace(
        policy,
        strict_years=tuple(y for y in policy.strict_years if y in years),
        grace_years=tuple(y for y in policy.grace_years if y in years),
    )


def touched_years(
    ledger: DataFrame,
    changed: DataFrame,
    lineage: DataFrame,
    realized: DataFrame,
    before: DataFrame | None = None,
    policy: GivingPolicy = GivingPolicy(),
) -> list[int]:
    """The years in which giving may differ, when the gifts ``changed`` (gift_fact_id) did.

    A gift changes the years it may count in, those of the payments that settle it, and those
    of the realised gifts of its giver.  ``before`` is the ledger that the table was made from,
    for years that a gift has left.  ``lineage`` is :func:`giving.commitment_lineage`,
    ``realized`` names the gifts that realise a planned one.  Changes of other tables than
    the gifts' call for a full build.  The driver gets at most one row a counted year.
    """
    rows = ledger.select("gift_fact_id", PERSON, "gift_fiscal_year", "gift_date")
    if before is not None:
        rows = rows.unionByName(before.select(*rows.columns))
    ids = changed.select("gift_fact_id").distinct()
    settled = lineage.select("gift_fact_id", "commitment_gift_fact_id").join(
        ids.withColumnRenamed("gift_fact_id", "commitment_gift_fact_id"), "commitment_gift_fact_id", "left_semi"
    )
    # a realised gift looks at all planned gifts of its giver
    people = rows.join(ids, "gift_fact_id", "left_semi").select(PERSON).distinct()
    planned = rows.join(people, PERSON, "left_semi").join(realized.select("gift_fact_id"), "gift_fact_id", "left_semi")
    ids = ids.unionByName(settled.select("gift_fact_id")).unionByName(planned.select("gift_fact_id")).distinct()
    years = rows.join(ids, "gift_fact_id", "left_semi").select(F.explode(giving.counted_years(policy)).alias("y"))
    return sorted(r[0] for r in years.select("y.counted_year").distinct().collect())


class GivingTable:
    """A catalog table of giving by fiscal year; ``compute`` gives the rows a policy counts."""

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        compute: Callable[[GivingPolicy], DataFrame],
        policy: GivingPolicy = GivingPolicy(),
    ):
        self.spark, self.name, self.compute, self.policy = spark, name, compute, policy

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """By year and person, so a year is as many files as tasks wrote it."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(YEAR, F.pmod(F.xxhash64(PERSON), F.lit(parts)))

    def build(self) -> DataFrame:
        """Write all years."""
        rows = self._dealt(self.compute(self.policy))
        rows.write.partitionBy(YEAR).format("parquet").saveAsTable(self.name)
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(PERSON, YEAR, "amount")

    def refresh(self, years: Sequence[int]) -> DataFrame:
        """Replace these years, and no other."""
        years = [y for y in years if y in (*self.policy.strict_years, *self.policy.grace_years)]
        if not years:
            return self.read()
        rows = self.compute(years_policy(self.policy, years)).select(PERSON, "amount", YEAR)
        written = Observation()
        rows = self._dealt(rows).observe(written, *[F.count_if(F.col(YEAR) == y).alias(f"y{y}") for y in years])
        rows.write.option("partitionOverwriteMode", "dynamic").insertInto(self.name, overwrite=True)
        # a year without rows is not written, so it still has its old ones
        for year in [y for y in years if not written.get[f"y{y}"]]:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({YEAR} = {year})")
        self.spark.catalog.refreshTable(self.name)
        return self.read()
