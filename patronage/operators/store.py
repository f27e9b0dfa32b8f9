"""Stages as bucketed, sorted tables that are checked while they are written.

A :class:`StageStore` owns one database in the cluster's shared checkpoint folder.  A
stage with a key is written into buckets of that key, sorted, one file a bucket: stages of
the same key then join without an exchange.  Its rules are observed on the write itself: the
rows of a key stand side by side there, so neither repeated keys nor NULLs cost a second
pass.  A stage that breaks a rule is dropped before anybody can read it, and the run
stops.  A stage that is asked for again, by the same plan over the same files, is read and
not written.  ``close`` drops the database with all its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from .stage import shared_folder


class QualityError(ValueError):
    """A stage breaks its rules; ``violations`` are (rule, columns, rows)."""

    def __init__(self, stage: str, violations: Sequence[tuple[str, str, int]]):
        self.stage, self.violations = stage, list(violations)
        found = "; ".join(f"{n} rows break {rule} ({columns})" for rule, columns, n in violations)
        super().__init__(f"stage {stage}: {found}")


@dataclass
class _Kept:
    plan: DataFrame
    files: tuple
    table: str


class StageStore:
    """``buckets``: of each keyed stage, as many as the session's shuffle partitions unless given.
    ``folder``: one that all executors share, the cluster's own unless given."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"stages_{uuid.uuid4().hex}"
        self.written: list[str] = []
        self._kept: dict[str, _Kept] = {}
        self._open = False

    def __enter__(self) -> StageStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def keep(
        self, name: str, df: DataFrame, key: Sequence[str] = (), unique: Sequence[str] = (), not_null: Sequence[str] = ()
    ) -> DataFrame:
        """Write a stage and read it back.

        ``key`` are the columns of the buckets.  ``unique`` columns may occur once each, and
        need a key that is among them; ``not_null`` columns must hold values.
        """
        if unique and not set(key) <= set(unique) or unique and not key:
            raise ValueError(f"stage {name}: the buckets' key {list(key)} is not part of {list(unique)}")
        files = _files(df)
        known = self._kept.get(name)
        if known and known.files == files and known.plan.sameSemantics(df):
            return self.spark.table(known.table)
        table = self.table(f"{name}_{len(self.written)}")
        self._write(name, df, table, list(key), list(unique), list(not_null))
        self.written.append(name)
        self._kept[name] = _Kept(df, files, table)
        return self.spark.table(table)

    def table(self, name: str) -> str:
        """The full name of a table of the store, which is made if need be."""
        if not self._open:
            folder = (self.folder or shared_folder(self.spark)).rstrip("/")
            self.spark.sql(f"CREATE DATABASE {self.database} LOCATION '{folder}/{self.database}'")
            self._open = True
        return f"{self.database}.{name}"

    def _write(
        self, name: str, df: DataFrame, table: str, key: list[str], unique: list[str], not_null: list[str]
    ) -> None:
        columns, rows = df.columns, df
        if key:
            rows = rows.repartition(self.buckets, *key).sortWithinPartitions(*[*key, *[c for c in unique if c not in key]])
        rules: dict[str, tuple[str, str, Column]] = {}
        for i, c in enumerate(not_null):
            rules[f"null_{i}"] = ("not null", c, F.count_if(F.col(c).isNull()))
        if unique:
            # the buckets' own order: no exchange and no sort of its own
            again = F.row_number().over(Window.partitionBy(*unique).orderBy(*unique)) > 1
            rows = rows.withColumn("_again", again)
            rules["repeated"] = ("unique", ", ".join(unique), F.count_if(F.col("_again")))
        observed = Observation(f"{table}")
        if rules:
            rows = rows.observe(observed, *[check.alias(k) for k, (_, _, check) in rules.items()])
        rows = rows.select(*columns)
        writer = rows.write.format("parquet")
        if key:
            writer = writer.bucketBy(self.buckets, *key).sortBy(*key)
        unchecked = f"{table}_unchecked"
        writer.saveAsTable(unchecked)
        broken = [(rule, c, observed.get[k]) for k, (rule, c, _) in rules.items() if observed.get[k]] if rules else []
        if broken:
            self.spark.sql(f"DROP TABLE {unchecked}")
            raise QualityError(name, broken)
        self.spark.sql(f"ALTER TABLE {unchecked} RENAME TO {table}")

    def close(self) -> None:
        """Drop all stages and their files."""
        if self._open:
            self.spark.sql(f"DROP DATABASE {self.database} CASCADE")
        self._open = False
        self._kept.clear()


def _files(df: DataFrame) -> tuple:
    """What a plan reads: number, size and last change of its files, summed where they lie."""
    paths = sorted(df.inputFiles())
    if not paths:
        return ()
    listed = df.sparkSession.read.format("binaryFile").load(paths)
    state = F.struct("path", "modificationTime", "length")
    sums = [F.sum(F.xxhash64(state, F.lit(i)).cast("decimal(20,0)")) for i in range(2)]
    return tuple(listed.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), *sums).first())
