"""The pipeline's stages on odd rows, and against the operators' own rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from patronage.llm.common import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randrange(2, 8)))
    return [" ".join(word() for _ in range(rng.randrange(60, 120))) + "." for _ in range(40)]


@pytest.fixture
def odd(spark):
    base = texts()
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t)) for i, t in enumerate(base)]
    near = base[3].split(" ")
    near[40] = "other"
    rows += [(3, base[3], "en", "a", 1), (100, " ".join(near), "en", "a", 1), (None, base[5].upper(), "de", "b", 1),
             (None, base[6] + " tail", "en", "a", 1), (7, base[9] + " w" * 300, "en", "a", 1), (200, None, "en", "a", 0),
             (201, "", None, None, 0), (202, "123 456", "en", "a", 7), (None, None, None, None, None),
             (300, "word " * 50000, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(c) for c in ("row_key", "_row", "_text", "draw", "draws", "size", "kept", "score", "gram")})


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_run_on_odd_rows_and_keep_the_columns(spark, odd):
    docs = odd
    for name, function in cp.STAGES[:-1]:
        docs = stage(function(spark, docs, ""), name)
        assert docs.columns == list(cp.COLUMNS)
        assert docs.where("text IS NULL OR text = ''").count() == 0
        # the next stage meets clashing names as well
        docs = docs.withColumns({c: F.lit(1) for c in ("_row", "draw", "label", "size")})
    packed = cp.STAGES[-1][1](spark, docs, "")
    assert packed.count() > 0


def test_stages_run_on_nothing(spark, odd):
    docs = odd.limit(0)
    for _, function in cp.STAGES:
        docs = function(spark, docs, "")
        assert docs.count() == 0


def test_without_named_languages_texts_with_letters_stay(spark, odd):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = cp.language(spark, docs, "")
    assert kept.count() == odd.where("text RLIKE '[A-Za-z]'").count()


def test_near_duplicates_keep_one_row_of_each_group(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    distinct = list(dict.fromkeys(rows))
    sets = [shingles(t) for _, t in distinct]
    group = list(range(len(distinct)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    least = lambda r: (r[0] is None, r[0] or 0)
    kept = cp.near_duplicates(spark, odd, "").select("doc_id", "text").collect()
    assert len(kept) == len(set(group)) == len({tuple(r) for r in kept})
    places = {p: i for i, p in enumerate(distinct)}
    assert {group[places[tuple(r)]] for r in kept} == set(group)
    for r in kept:
        members = [d for d, g in zip(distinct, group, strict=True) if g == group[places[tuple(r)]]]
        assert least(tuple(r)) == min(map(least, members))


def test_shuffles_go_when_a_write_inside_a_stage_ends(spark, data_dir, monkeypatch):
    (name,), held = cp.DROP_SHUFFLES, []
    before = spark.conf.get(name)
    monkeypatch.setattr(cp, "STAGES", [(n, lambda spark, docs, sf_dir: docs) for n in ("first", "second", "last")])
    monkeypatch.setattr(cp, "stage", lambda df, what: (held.append(spark.conf.get(name)), df)[1])
    cp.run(spark, data_dir)
    assert held == ["true", "true"] and spark.conf.get(name) == before
