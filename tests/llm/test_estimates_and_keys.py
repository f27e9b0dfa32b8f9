"""Robust estimates against plain numpy; pieces and sets whose short hashes collide."""

import math
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from patronage.llm import quality, token_fst, url_rules
from patronage.llm.ngram_join import ngram_jaccard_join

PATH = public_tokenizers.path("byte_bpe_50k.json")


def least_with_share(values, share):
    """The least value with at least ``share`` of all at or below it."""
    ordered = np.sort(values)
    return ordered[math.ceil(share * len(ordered) - 1e-9) - 1]


def estimate(x, scale):
    centre = x.mean(axis=0)
    scatter = (x.T @ x / len(x) - np.outer(centre, centre)) * scale
    scatter[np.diag_indices(4)] = np.maximum(np.diag(scatter), np.square(quality.FLOORS))
    return centre, scatter


def distances(x, centre, scatter):
    away = x - centre
    return np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter), away)


def nearest(x, far):
    bins = np.floor(64 * np.log(far + 1e-3))
    return x[bins <= least_with_share(bins, quality.KEEP)]


def log_det(e):
    return np.linalg.slogdet(e[1])[1]


def robust(x):
    """The final estimate and the log determinants of the starts."""
    coarse = np.floor(x / 50)
    mid = np.array([least_with_share(coarse[:, i], 0.5) for i in range(4)])
    mad = np.array([least_with_share(np.abs(coarse[:, i] - mid[i]), 0.5) for i in range(4)])
    z = np.abs(x - 50 * mid) / np.maximum(1.4826 * 50 * mad, quality.FLOORS)
    trials = []
    for far in (z.max(axis=1), (z**2).sum(axis=1), np.log1p(z**2).sum(axis=1)):
        e = estimate(nearest(x, far), quality.CONSISTENCY)
        for _ in range(quality.TRIAL_STEPS):
            e = estimate(nearest(x, distances(x, *e)), quality.CONSISTENCY)
        trials.append(e)
    best = min(trials, key=log_det)
    for _ in range(quality.MOST_STEPS):
        step = estimate(nearest(x, distances(x, *best)), quality.CONSISTENCY)
        if log_det(step) >= log_det(best) - quality.LEAST_FALL:
            break
        best = step
    return estimate(x[distances(x, *best) <= quality.REWEIGHT], 1.0), [log_det(e) for e in trials]


def test_estimates_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for g, planted in (("clean", 0), ("near", 60), ("many", 120)):
        mix = rng.normal(size=(4, 4)) * 900 + np.eye(4) * 2000
        x = rng.normal(size=(500, 4)) @ mix + 20_000
        x[:planted] = rng.normal(size=(planted, 4)) * 1500 + [30_000, 9_000, 26_000, 31_000]
        groups[g] = np.round(x)
    groups["flat"] = np.round(rng.normal(size=(250, 4)) * [2000, 1, 0, 3000] + 5000)  # held by the floors
    groups["same"] = np.full((210, 4), 700.0)
    rows = [(g, *map(int, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "grp string, x0 long, x1 long, x2 long, x3 long").repartition(5)
    found = quality.robust_estimates(df)
    got = {r["grp"]: r for r in found.collect()}
    judged = quality._distances(df, found).groupBy("grp").agg({"d2": "sum", "*": "count"}).collect()
    sums = {r["grp"]: (r["sum(d2)"], r["count(1)"]) for r in judged}
    apart = 0
    for g, x in groups.items():
        (centre, scatter), trials = robust(x)
        apart += max(trials) - min(trials) > 1e-3
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], centre, rtol=1e-9)
        lower = np.array([[got[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose(lower @ lower.T, scatter, rtol=1e-6)
        assert sums[g][1] == len(x) and math.isclose(sums[g][0], distances(x, centre, scatter).sum(), rel_tol=1e-6)
    assert apart  # the starts do not all end in the same place


def test_no_groups_no_estimates(spark):
    none = spark.createDataFrame([], "grp string, x0 long, x1 long, x2 long, x3 long")
    assert quality.robust_estimates(none).collect() == []


def test_pieces_with_equal_short_hashes_keep_their_tokens(monkeypatch):
    whole = token_fst._piece_keys

    def colliding(data, at, size):
        keys, checks = whole(data, at, size)
        long = size >= 8
        keys[long] = (size[long] % 2).astype(np.uint64) | np.uint64(0xFF << 56)
        return keys, checks

    monkeypatch.setattr(token_fst, "_piece_keys", colliding)
    token_fst.transducer(PATH)._forget()
    texts = ["internationalisation understanding wonderful", "understanding wonderful wonderful", " extraordinary" * 3,
             "wonderful internationalisation " + "q" * 90, None, "a b"]
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time all are held
        for text, ids in zip(texts, expected, strict=True):
            assert token_fst.encode_texts([text], PATH)[0].tolist() == ids
        assert token_fst.count_tokens(texts, PATH).tolist() == list(map(len, expected))
    assert len(token_fst.transducer(PATH).clashes) >= 3
    token_fst.transducer(PATH)._forget()


def test_hosts_that_share_a_key_are_judged_each(spark):
    urls = [f"http://h{i}.com/" for i in range(300)] + ["http://h1.com/x", "http://a.h2.com/", "http://h2.com/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("h2.com", "/", "allow")], "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == (("h2.com/", "allow") if r["host"].endswith("h2.com") else ("com/", "block"))


def test_sets_of_one_number_are_told_apart(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(0, 30, 3)]  # copies
    rows += [(200 + i, base[i] + " tail") for i in range(0, 30, 2)]  # near copies
    rows += [(300, None), (301, ""), (302, "two words"), (303, "TWO words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # three bits number at most eight sets, so nearly every number is several sets'
    short = {r["doc_id"]: r for r in ngram_jaccard_join(docs, bits=3).collect()}
    whole = {r["doc_id"]: r for r in ngram_jaccard_join(docs).collect()}
    assert len(short) == len(rows)
    for doc, row in whole.items():
        assert all(short[doc][c] == row[c] for c in ("n_shingles", "component_id", "n_links")), doc
    for i in range(30):
        assert short[i]["component_id"] == i and short[i]["n_links"] == (1 if i % 2 == 0 else 0)
        if i % 2 == 0:
            assert short[200 + i]["component_id"] == i
    assert short[303]["component_id"] == 302 and short[300]["component_id"] == 300
