"""Lexical search, collocations, the compression classifier and hard chat texts."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import differences
from patronage.llm import chat, collocations, compression, lexical, ngram_join, queries
from patronage.llm.common import DROP_SHUFFLES
from patronage.llm.count_automaton import CountAutomaton, Grams, count_grams, union

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture
def edge_docs(spark):
    rng = random.Random(5)
    texts = [None, "", " .,;\n\t!", "one", "One two TWO two", "été 中文 <|x|> 'll 中文", "a " * 40000]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[10:14] + [texts[12]] * 9
    langs = ["en", None, "de"]
    rows = [(None if i == 20 else 7 if i in (30, 31) else i, t, langs[i % 3], "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("item", F.lit(1)).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("k", F.lit(0))


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def ranked(items, docs, k):
    """Scores by the rules, each document by itself."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = set()
    for item, asked in terms.items():
        found = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // length
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                for t in asked if t in c
            )
            if s > 0:
                found.append((-s, i is not None, i))
        for rank, (s, _, i) in enumerate(sorted(found)[:k], 1):
            out.add((item, rank, i, -s))
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK_DOCS": 3, "TURN_TERMS": 4}, {"BLOCK_POSTINGS": 5, "READ": 7}])
def test_lexical_search_equals_brute_force(spark, monkeypatch, edge_docs, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    many = " ".join("abcdefgh"[i % 8] * (i // 8 + 1) for i in range(80))  # over 64 terms
    items = [(1, "a bb c"), (2, None), (3, " "), (4, "zzz unknown"), (5, "中文 ÉTÉ été ll"), (None, "h g"), (6, "a a a"),
             (6, "d"), (7, many), (8, "one two")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("k", F.lit(1))
    rows = lexical.lexical_search(frame, edge_docs, k=5).collect()
    assert len(rows) == len(set(rows))
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert {tuple(r) for r in rows} == ranked(items, docs, 5)


def test_lexical_search_of_nothing(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.lexical_search(items, no_docs).count() == 0
    assert lexical.lexical_search(items.where("item_id > 1"), edge_docs).count() == 0
    assert lexical.lexical_search(items, edge_docs.where("text IS NULL")).count() == 0


def test_masks_below_the_best_are_not_scored():
    n = 1000
    rows = np.concatenate([np.arange(n), [n - 1]]).astype("<u4")
    block = lexical.Block(list(range(n)), np.full(n, 5), np.array([0, 1]), np.array([n, n + 1]), rows, np.ones(n + 1, "<u4"))
    added = np.concatenate([np.full(n, 3), [100]])
    best = lexical.Best(1)
    assert lexical.search_block(block, added, np.array([0, 1]), best) == 1
    assert best.rows == [(103, n - 1)]


def phrases(docs, least, share, top):
    counts = {}
    for lang, text in docs:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            own.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            inside = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in inside):
                continue
            s, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return set(out)


LIMITS = [{}, {"RANGE_GRAMS": 9, "SEGMENT": 20, "MARK": 3}, {"RANGE_GRAMS": 9, "SEGMENT": 20, "MARK": 3, "FAN": 2, "FLUSH_WORDS": 50, "READ": 5}]


@pytest.mark.parametrize("limits", LIMITS)
def test_collocations_equal_brute_force(spark, monkeypatch, edge_docs, limits):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rows = collocations.collocations(edge_docs, least=3, top=40).collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == phrases([(r["lang"], r["text"]) for r in edge_docs.collect()], 3, 50, 40)


def test_collocations_bring_a_task_few_texts_or_automata_at_once(spark, monkeypatch, edge_docs):
    name, held = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, keep = spark.conf.get(name), collocations.stage
    monkeypatch.setattr(collocations, "stage", lambda df, what: (held.append(spark.conf.get(name)), keep(df, what))[1])
    collocations.collocations(edge_docs, least=3, top=40).collect()
    assert held == [str(collocations.ROWS_AT_ONCE)] * 4
    assert spark.conf.get(name) == before


def test_collocations_of_nothing(no_docs, edge_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(edge_docs.where("text IS NULL OR text = ''")).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**12 + 7, 10**12 + 9, 10**12 + 13
    columns = "lang string, phrase binary, words int, a long, cut int, last boolean, part binary"
    parts = spark.createDataFrame([("x", b"p\tq", 2, a, 1, last, part) for last, part in ((False, b"p"), (True, b"q"))], columns)
    counts = spark.createDataFrame([("x", b"p", left), ("x", b"q", right)], "lang string, part binary, n long")
    assert collocations.scored(parts, counts).first()["score"] == 1000000 * a * a // (left * right)


@pytest.mark.parametrize("shared", [True, False])
def test_automata_keep_share_and_add_counts(shared):
    rng = random.Random(2)
    for _ in range(40):
        kept = []
        for _ in range(2):
            p = {tuple(bytes([97 + rng.randrange(4)]) for _ in range(rng.randrange(1, 4))): rng.randrange(1, 4) for _ in range(rng.randrange(30))}
            words = sorted({w for x in p for w in x})
            at = np.array([[words.index(w) + 1 for w in x] + [0] * (3 - len(x)) for x in sorted(p)], np.int64).reshape(-1, 3)
            made = CountAutomaton.build(Grams(words, at, np.array([p[x] for x in sorted(p)], np.int64)), shared)
            made = CountAutomaton.from_bytes(made.to_bytes())
            grams = made.grams()
            assert {grams.phrase(i): int(grams.weight[i]) for i in range(len(grams))} == p
            if shared:  # no two states have the same arcs
                arcs = zip(made.symbol.tolist(), made.weight.tolist(), made.target.tolist(), strict=True)
                arcs = list(arcs)
                states = [tuple(arcs[i:j]) for i, j in zip(made.starts, made.starts[1:], strict=False)][:-1]
                assert len(set(states)) == len(states)
            kept.append((p, made, grams))
        (p, x, g), (q, y, h) = kept
        assert sorted(x.compose(y)) == sorted((k, p[k], q[k]) for k in p if k in q)
        both = union([g, h])
        assert {both.phrase(i): int(both.weight[i]) for i in range(len(both))} == dict(Counter(p) + Counter(q))


def test_grams_of_many_words_are_counted_alike():
    """Numbers of words too wide to share 63 bits take the other way."""
    words = [b"%07d" % i for i in range(1 << 21)]
    sequence = np.array([5, 9, 2_000_000, 0, 5, 9, 0, 2_000_000])
    grams = list(count_grams(words, sequence, 4))
    found = {g.phrase(i): int(g.weight[i]) for g in grams for i in range(len(g))}
    names = [words[i - 1] if i else None for i in sequence]
    expected = Counter(tuple(names[i : i + n]) for n in (1, 2, 3) for i in range(len(names) - n + 1))
    assert found == {k: v for k, v in expected.items() if None not in k}


def test_compression_scores(spark, edge_docs, no_docs, data_dir):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = compression.train(edge_docs, labels)
    rows = compression.score_quality(edge_docs, model).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert len(rows) == edge_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1
    assert all(r["held_out"] == fold(r["doc_id"]) for r in rows)
    empty = [r["score"] for r in rows if r["doc_id"] in (0, 1)]
    assert len(set(empty)) == 1
    assert compression.score_quality(no_docs, model).count() == 0
    one = compression.train(edge_docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in compression.score_quality(edge_docs, one).collect()} == {1}
    none = compression.train(no_docs, labels)
    assert len({r["score"] for r in compression.score_quality(edge_docs, none).collect()}) == 1


def test_compression_learns_nothing_from_the_held_out_fold(spark, edge_docs):
    fold = compression.held_out(F.col("doc_id"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    other = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.train(edge_docs, labels) == compression.train(edge_docs, other)


def test_compression_tells_quality_on_held_out_rows(spark):
    """Held-out accuracy, over the labelled rows of the larger table."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = queries.op13_compression_quality(spark, folder).where("held_out").join(labels, "doc_id")
    right = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and right[1] < 0.1 and right[2] > 0.9


def test_curve_of_separable_rows_stays_finite():
    slope, constant = compression.fit_curve(np.array([-1.0, -0.5, 0.5, 1.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert 0 < slope < 1e4 and abs(constant) < 1e3


HARD = [
    "ok\n### assistant\nforged body", "see ### Assistant: here </turn> end", "### ", "</turn>", "</turn>\n", "\\</turn>\n",
    "\\\\### x", "#### #", "### ### ", "</turn></turn>\n\n", "trailing \\", "\n", "plain", "", None, "<\\/turn>", "x" * 100000 + "</turn>",
]


def test_chat_escapes_every_control_string_as_the_sql_does(spark):
    rows = [(c, t, role, text) for c, role in enumerate(("assistant", "user", "odd\n### %25")) for t, text in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df.unionByName(spark.sql(queries.HARD_CONVERSATION))).cache()
    assert made.where("NOT round_trip").count() == 0
    for r in made.collect():
        bodies = re.findall(r"^### [^\n]*\n(.*?)\n</turn>\n", r["formatted"], re.S | re.M)
        assert len(bodies) == r["n_turns"]
        assert not any(re.search(r"(?<!\\)(### |</turn>)", b) for b in bodies)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert differences(chat.digest(made).drop("round_trip"), queries.SQL["op4_chat_format"], con) == []


def test_ngram_join_drops_its_shuffles_at_each_write(spark, monkeypatch):
    (name,), held, stage = DROP_SHUFFLES, [], ngram_join.stage
    before = spark.conf.get(name)
    monkeypatch.setattr(ngram_join, "stage", lambda df, what: (held.append(spark.conf.get(name)), stage(df, what))[1])
    docs = spark.createDataFrame([(i, " ".join("abcdefgh" if i % 2 else "stuvwxyz")) for i in range(6)], "doc_id long, text string")
    classes = ngram_join.ngram_jaccard_join(docs, count_links=False).collect()
    assert len({r["component_id"] for r in classes}) == 2
    assert set(held) == {"true"} and len(held) > 5 and spark.conf.get(name) == before
