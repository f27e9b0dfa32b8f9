"""Quality rules: fixed limits, then robust multivariate outliers.

The statistics of a text become a vector of four logarithms (mean word length, symbols,
repeated lines and repeated words, each as a share smoothed by ``PRIOR_WORDS`` words of
the corpus mean).  For every language and source the minimum covariance determinant
gives a centre and a scatter.  Three fixed starts take the three quarters nearest the
medians, by the largest, the summed squared and the summed logarithmic deviation in units
of the absolute deviations.  From each, ``TRIAL_STEPS`` concentration steps refit to the
three quarters nearest by Mahalanobis distance; the start whose scatter has the least
determinant goes on until no group's determinant falls, at most ``MOST_STEPS`` times, and a
step that does not lower a group's determinant is not taken.  Then the fit is made once to
all rows within the 97.5 % bound.  A row whose distance is over ``CUTOFF`` is rejected.

Values are whole ten-thousandths and are summed exactly, quantiles are read from
histograms, so neither the order of rows nor the number of tasks changes a verdict.
Every aggregate is combined before it is shuffled.

Defined results: a NULL text has no words and fails the limits; NULL language or source
is a value of its own; a group of under ``MIN_ROWS`` rows is judged with the other small
groups of its language, or of all languages if these are few as well, and if there are
still under ``MIN_ROWS`` rows nothing is an outlier; repeated rows count each; no rows
give none.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.common import stage

BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
PRIOR_WORDS = 200
MIN_ROWS = 200
UNIT = 10_000
# Standard deviations below which a statistic is not taken to vary, in the same units.
FLOORS = (300, 800, 800, 800)
TRIAL_STEPS, MOST_STEPS = 2, 20
LEAST_FALL = 1e-6  # of the logarithm of a determinant, by which a step must lower it
KEEP = 0.75
# Fixed values for four dimensions: scale of the scatter of the nearest three quarters,
# and the 97.5 % and 99.9 % points of chi-square.
CONSISTENCY, REWEIGHT = 1.487, 11.143
CUTOFF = 18.467
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``STATS`` and n_lines; columns of these names are replaced."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    # A split of nothing is one empty word.  Each select keeps its arrays as columns, so
    # that they are made once and not for each use.
    docs = docs.drop(*STATS, "n_lines")
    words = docs.withColumn("_body", body).withColumn(
        "_words",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
            F.split(trimmed, r"[\x20\x09-\x0D]+")
        ),
    )
    windows = F.size("_words") - 2
    counted = words.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(_without(F.col("_body"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("_body", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("_lines"),
        F.when(
            windows > 1,
            F.sort_array(
                F.arrays_zip(
                    F.slice("_words", 1, windows).alias("a"),
                    F.slice("_words", 2, windows).alias("b"),
                    F.slice("_words", 3, windows).alias("c"),
                    F.sequence(F.lit(0), windows - 1).alias("at"),
                )
            ),
        ).alias("_grams"),
    ).drop("_words", "_body")
    again = counted.select(
        "*",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.filter(F.sequence(F.lit(1), F.size("_grams") - 1), _as_before).alias("_twins"),
    ).drop("_lines")
    both = F.transform(
        "_twins", lambda i: F.array(F.get("_grams", i - 1)["at"], F.get("_grams", i)["at"])
    )
    places = again.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(both)))).drop("_grams")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(
            (at + 3).alias("end"), (acc["n"] + at + 3 - F.greatest(acc["end"], at)).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return places.withColumn(
        "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")
    ).drop("_twins", "_at")


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def _as_before(at: Column) -> Column:
    """Whether a window of the sorted list equals the one before it."""
    one, other = F.get("_grams", at - 1), F.get("_grams", at)
    return (one["c"] == other["c"]) & (one["b"] == other["b"]) & (one["a"] == other["a"])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _vector(totals: dict[str, float]) -> list[Column]:
    """The statistics as whole ten-thousandths of logarithms."""
    words = max(totals["n_words"], 1.0)

    def share(part: str, weight: float) -> Column:
        smoothed = (F.col(part) + PRIOR_WORDS * totals[part] / words) / (F.col("n_words") + PRIOR_WORDS)
        return F.log(F.lit(1.0) + weight * smoothed)

    parts = [share("word_chars", 1.0), share("n_symbols", 10.0), share("n_dup_lines", 20.0),
             share("n_repeat_words", 5.0)]
    return [F.round(p * UNIT).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def _quantile_bin(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """The least ``value`` with at least ``share`` of the group's rows at or below it.

    ``value`` is a whole number of limited range, so a group's histogram is small.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(*keys).orderBy(value)
    return (
        counts.withColumn("up_to", F.sum("n").over(up_to))
        .withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        .where(F.col("up_to") >= share * F.col("all"))
        .groupBy(*keys)
        .agg(F.min(value).alias(value))
    )


def _groups(rows: DataFrame) -> DataFrame:
    """Add ``grp``, the name of the group a row is judged in; NULL where there are too few."""
    counts = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < MIN_ROWS
    by_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    named = counts.withColumn("of_lang", by_lang).withColumn(
        "grp",
        F.when(~small, F.to_json(F.struct("lang", "source"))).when(
            F.col("of_lang") >= MIN_ROWS, F.to_json(F.struct("lang", F.lit(1).alias("rest")))
        ),
    )
    left = named.where("grp IS NULL").agg(F.sum("n")).first()[0] or 0
    pooled = F.lit("{}") if left >= MIN_ROWS else F.lit(None).cast("string")
    named = named.select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), F.coalesce("grp", pooled).alias("grp")
    )
    match = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    return rows.join(named, match, "left").drop("_l", "_s")


def _estimate(chosen: DataFrame, scale: float, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Centre, Cholesky factor of the scatter and its log determinant of each group's chosen rows."""
    size = range(len(FLOORS))
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  exact sums at any number of rows
    sums = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(whole(F.col(f"x{i}"))).cast("double").alias(f"s{i}") for i in size],
        *[
            F.sum(whole(F.col(f"x{i}") * F.col(f"x{j}"))).cast("double").alias(f"s{i}{j}")
            for i in size
            for j in range(i + 1)
        ],
    )
    for i in size:
        sums = sums.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in size:
        for j in range(i + 1):
            scatter = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            value = scatter * scale
            if i == j:
                value = F.greatest(value, F.lit(float(FLOORS[i] ** 2)))
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floors keep every pivot above zero
            least = F.lit(float(FLOORS[i] ** 2) / 4)
            value = F.sqrt(F.greatest(value, least)) if i == j else value / F.col(f"l{j}{j}")
            sums = sums.withColumn(f"l{i}{j}", value)
    names = [f"m{i}" for i in size] + [f"l{i}{j}" for i in size for j in range(i + 1)]
    log_det = reduce(Column.__add__, [2 * F.log(f"l{i}{i}") for i in size])
    return stage(sums.select(*keys, *names, log_det.alias("log_det")), "estimates")


def _least(estimates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of each group's estimates the one with the least determinant."""
    names = [c for c in estimates.columns if c not in ("grp", *order)]
    first = F.min(F.struct("log_det", *order, *[n for n in names if n != "log_det"])).alias("e")
    return estimates.groupBy("grp").agg(first).select("grp", *[f"e.{n}" for n in names])


def _distances(rows: DataFrame, estimates: DataFrame, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Add the squared Mahalanobis distance ``d2``; NULL without an estimate."""
    rows = rows.join(estimates, list(keys), "left")
    solved: list[str] = []
    for i in range(len(FLOORS)):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(solved[k])
        solved.append(f"y{i}")
        rows = rows.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    d2 = sum((F.col(y) * F.col(y) for y in solved[1:]), F.col(solved[0]) * F.col(solved[0]))
    return rows.withColumn("d2", d2).drop(*solved, *[c for c in estimates.columns if c not in keys])


def _nearest(rows: DataFrame, distance: str, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """The ``KEEP`` share of each group that is nearest, and what ties with it.

    The bins are an 1/64 of the distance wide.
    """
    binned = rows.withColumn("bin", F.floor(64 * F.log(F.col(distance) + 1e-3)))
    cut = _quantile_bin(binned, keys, "bin", KEEP).withColumnRenamed("bin", "cut")
    return binned.join(cut, list(keys)).where("bin <= cut").drop("bin", "cut", distance)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant of every ``grp`` over x0 to x3."""
    size = range(len(FLOORS))
    long = rows.select(
        "grp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in size])).alias("v"),
    ).select("grp", "v.i", F.floor(F.col("v.x") / 50).alias("x"))
    middle = _quantile_bin(long, ["grp", "i"], "x", 0.5).withColumnRenamed("x", "mid")
    away = long.join(middle, ["grp", "i"]).withColumn("x", F.abs(F.col("x") - F.col("mid")))
    spread = _quantile_bin(away, ["grp", "i"], "x", 0.5).join(middle, ["grp", "i"])
    start = spread.groupBy("grp").agg(
        *[F.max(F.when(F.col("i") == i, 50 * F.col("mid"))).alias(f"mid{i}") for i in size],
        *[F.max(F.when(F.col("i") == i, 50 * F.col("x"))).alias(f"mad{i}") for i in size],
    )
    apart = [
        F.abs(F.col(f"x{i}") - F.col(f"mid{i}")) / F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(FLOORS[i]))
        for i in size
    ]
    total = lambda parts: reduce(Column.__add__, parts)
    ways = [F.greatest(*apart), total([z * z for z in apart]), total([F.log1p(z * z) for z in apart])]
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), w.alias("far")) for i, w in enumerate(ways)]))
    vector = [f"x{i}" for i in size]
    each = ("grp", "start")
    begun = rows.join(stage(start, "starts"), "grp").select("grp", *vector, trial.alias("t")).select("grp", *vector, "t.*")
    estimates = _estimate(_nearest(begun, "far", each), CONSISTENCY, each)
    tried = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(ways) - 1))))
    for _ in range(TRIAL_STEPS):
        estimates = _estimate(_nearest(_distances(tried, estimates, each), "d2", each), CONSISTENCY, each)
    best = stage(_least(estimates, ["start"]), "least")
    for _ in range(MOST_STEPS):
        step = _estimate(_nearest(_distances(rows, best), "d2"), CONSISTENCY)
        before = best.select("grp", F.col("log_det").alias("_before"))
        fallen = step.join(before, "grp").where(F.col("log_det") < F.col("_before") - LEAST_FALL).drop("_before")
        if fallen.isEmpty():
            break
        best = stage(_least(best.unionByName(fallen), []), "least")
    return _estimate(_distances(rows, best).where(F.col("d2") <= REWEIGHT), 1.0)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with STATS, base_failed, distance (squared) and kept."""
    wanted = [c for c in dict.fromkeys([*carry, "lang", "source"]) if c != "text"]
    rows = text_statistics(docs.select(*wanted, "text")).drop("text")
    rows = stage(rows.withColumn("base_failed", base_failed()), "statistics")
    good = rows.where(~F.col("base_failed"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    totals = good.agg(*[F.sum(F.col(n)).cast("double").alias(n) for n in names]).first().asDict()
    vectors = rows.select("*", *_vector({k: v or 0.0 for k, v in totals.items()}))
    grouped = stage(_groups(vectors.where(~F.col("base_failed"))), "vectors")
    estimates = robust_estimates(grouped.where("grp IS NOT NULL").select("grp", "x0", "x1", "x2", "x3"))
    judged = _distances(grouped, estimates).withColumnRenamed("d2", "distance")
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    together = judged.select(*rows.columns, "distance").unionByName(failed)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return together.withColumn("kept", kept)
