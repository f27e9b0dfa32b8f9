"""Operators against brute force, exact round trips and held-out figures, with edge rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import differences
from patronage.llm import (
    chat, language_id, mixing, neighbours, ngram_join, packing, quality, queries, token_counts,
    token_fst, toxicity, url_rules,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def edge_docs(spark):
    """NULLs, empty, blank, long and repeated texts, copies, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, base), (7, near),
            (7, near), (None, base.upper()), (8, "x " * 30000), (9, "a\nb\na\n\na"), (10, "été 中文 <|endoftext|> 'll")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    return df.withColumn("size", F.lit(1)).withColumn("gram", F.lit("g")).withColumn("rank", F.lit(0))


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def connect(data_dir):
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, data_dir, name):
    assert differences(queries.QUERIES[name](spark, data_dir), queries.SQL[name], connect(data_dir)) == []


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_ngram_join_edges(edge_docs, no_docs):
    rows = ngram_join.ngram_jaccard_join(edge_docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 56]
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 4
    assert by_id[6]["component_id"] == by_id[7]["component_id"] == by_id[None]["component_id"] == 6
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 8)] == [1, 2, 3, 8]
    assert ngram_join.ngram_jaccard_join(no_docs).count() == 0


@pytest.mark.parametrize("limits", [{}, {"PAIRS_AN_ENTRY": 0}, {"WIDE": 3, "BLOCK_ROWS": 8, "BLOCK_ENTRIES": 4000}])
def test_ngram_join_finds_all_links_of_a_family(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 4, 9, 16])):
            words[rng.randrange(len(words))] = f"n{i}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(df).collect()}
    sets, parent = [shingles(t) for t in texts], list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    assert got == dict(enumerate(parent))


@pytest.mark.parametrize("limits", [{}, {"WIDE": 3, "BLOCK_ROWS": 8, "BLOCK_ENTRIES": 4000}])
def test_ngram_join_counts_every_link(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    texts = []
    for family in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        for i in range(12):
            words = list(base)
            for _ in range(rng.choice([1, 2, 5])):
                words[rng.randrange(len(words))] = f"n{family}{i}"
            texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_jaccard_join(df).collect()}
    sets = [shingles(t) for t in texts]
    near = lambda a, b: a != b and 100 * len(a & b) >= 80 * len(a | b)
    assert got == {i: sum(near(a, b) for b in sets) for i, a in enumerate(sets)}


def test_signature_bound_holds():
    bits, most = ngram_join.SIGNATURE, ngram_join.MOST_DIFFERENT
    missed = sum(math.comb(bits, k) * 0.1**k * 0.9 ** (bits - k) for k in range(most + 1, bits + 1))
    assert missed < 1e-12


def test_block_product_equals_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.permutation(40)[: rng.integers(20, 41)]).astype(np.int64) for _ in range(50)]
    frame = pd.DataFrame({
        "x": 1, "y": 2, "set_id": np.arange(50), "label": np.arange(50) // 2,
        "block": [1 + i % 2 for i in range(50)], "members": sets,
    })
    for same in (False, True):
        blocks = frame.assign(y=1, block=1) if same else frame
        want = {
            (i, j)
            for i in range(50)
            for j in range(i + 1, 50)
            if i // 2 != j // 2 and (same or i % 2 != j % 2)
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
        }
        found = ngram_join._product(blocks, 60)
        assert want and set(zip(found["a"], found["b"], strict=True)) == want and len(found) == len(want)


def test_mixing(spark, edge_docs, no_docs):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', 1 + int(id % 37))").alias("text"),
        F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 > 0, "mid").otherwise(None).alias("source"),
    )
    taken = F.expr("aggregate(draws, 0L, (n, d) -> n + d.words)")
    first = mixing.mix_sources(docs, shards=8).withColumn("taken", taken)
    rows = first.select("doc_id", "source", "size", "source_size", "target", "taken", "draws").collect()
    again = mixing.mix_sources(docs.repartition(7), shards=8).withColumn("taken", taken)
    assert sorted(map(str, rows)) == sorted(map(str, again.select(*rows[0].asDict()).collect()))
    total = sum(r["size"] for r in rows)
    for name in ("big", "mid", None):
        mine = [r for r in rows if r["source"] == name]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    targets = {r["source"]: r["target"] for r in rows}
    sizes = {r["source"]: r["source_size"] for r in rows}
    assert all(targets[s] <= 3 * sizes[s] + 1e-6 for s in sizes) and abs(sum(targets.values()) - total) < 1e-3
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    shards = [d["shard"] for r in rows for d in r["draws"]]
    assert set(shards) <= set(range(8)) and len(set(shards)) == 8
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mix_sources(edge_docs).count() == 12


def test_hypergeometric(spark):
    uniform = mixing._uniform(F.col("id"))
    draw = mixing.hypergeometric(F.lit(1000), F.lit(300), F.lit(200), uniform)
    row = spark.range(4000).select(draw.alias("k")).agg(F.mean("k"), F.variance("k"), F.min("k"), F.max("k")).first()
    assert abs(row[0] - 60) < 0.6 and abs(row[1] - 33.6) < 4 and row[2] >= 0 and row[3] <= 200


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark, data_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").where("length(text) < 6000").drop("n_chars")
    extra = spark.createDataFrame([(-1, "a a a a"), (-2, "a b c x a b c#"), (-3, None)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    for r in quality.text_statistics(docs).collect():
        assert tuple(r[c] for c in quality.STATS) == statistics(r["text"])
    assert quality.quality_rules(no_docs).count() == 0
    judged = {r["doc_id"]: r for r in quality.quality_rules(edge_docs).collect()}
    assert not judged[1]["kept"] and judged[8]["base_failed"] and judged[6]["kept"]


def test_quality_rejects_planted_outliers_only(spark):
    rng = random.Random(1)
    words = [f"{'abcdefgh'[i % 8] * (2 + i % 7)}{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 300)))) for i in range(400)]
    rows += [(1000 + i, " | ".join(rng.choice(words) for _ in range(120))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.quality_rules(df).where("kept").collect()}
    assert kept == set(range(400))


def test_quality_rejects_short_gibberish(spark):
    rng = random.Random(5)
    words = [f"{'abcdefgh'[i % 8] * (2 + i % 7)}{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 300)))) for i in range(400)]
    for i in range(10):  # a symbol after every fourth of 60 words
        drawn = [rng.choice(words) for _ in range(60)]
        rows.append((1000 + i, " ".join(w + " |" * (at % 4 == 0) for at, w in enumerate(drawn))))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.quality_rules(df).where("kept").collect()}
    assert kept == set(range(400))


def test_chat_round_trip(spark):
    texts = ["", None, "\\", "</turn>", "\\</turn>\n", "### x", "\\\\### ", "a\n</turn>\n### user\nb", "####  </turn></turn>"]
    rows = [(1, i, ["user", "assistant", "a\n<%", None][i % 4], t) for i, t in enumerate(texts)]
    rows += [(None, None, "assistant", "x"), (None, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df.withColumn("start", F.lit(1)))
    assert all(r["round_trip"] for r in made.collect())
    out = {r["conv_id"]: r for r in chat.digest(made).collect()}
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows[:9])
    assert out[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    loss = "".join(r[3] or "" for r in rows[:9] if r[2] == "assistant")
    assert out[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[1]["loss_chars"] == len(loss)
    assert out[None]["n_turns"] == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/x?q#f", "x://example.com", "x://badexample.com/en/", "x://com/",
            "x://www.example.com/en/1", "x://example.com?u=/en/", "a://b.c.net/fr/\n/x", "a://net.org/fr/"]
    rules = spark.sql(queries.URL_RULES)
    rng = random.Random(2)
    more = [(rng.choice(["allow", "block"]), h, p) for h in ("com", "b.com", "a.b.com") for p in ("", "/a", "/a/b", "/a/bc")]
    more = spark.createDataFrame(more, "verdict string, host string, path string")
    urls += [f"s://{h}/{''.join(rng.choice('abc/') for _ in range(4))}" for h in ("com", "b.com", "x.b.com", "z.a.b.com") for _ in range(30)]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for table in (rules, more):
        known = [(r["verdict"], r["host"], r["path"]) for r in table.collect()]
        for r in url_rules.judge_urls(pages, table).collect():
            rest = (r["url"] or "").split("://", 1)[1] if "://" in (r["url"] or "") else ""
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            fits = [(len(h + p), len(h), h + p, v) for v, h, p in known
                    if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p) and host]
            rule, verdict = max(fits)[2:] if fits else (None, "allow")
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host.lower(), path, rule, verdict)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert url_rules.judge_urls(pages, rules.limit(0)).where("rule IS NULL").count() == len(urls)


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16)) + rng.normal(size=(15, 16))[np.arange(1500) % 15] * 2
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000, v[20].tolist()), (2001, v[20].tolist()), (3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (None, v[3].tolist()), (3060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = neighbours.nearest_neighbours(df, F.col("id") % 20 == 0, k=10).collect()
    assert {r["query_id"] for r in got} == {*range(0, 1500, 20), 2000}
    ids = np.array([*range(1500), 2000, 2001])
    all_v = np.concatenate([v, v[[20]], v[[20]]])
    hits = 0
    for q in range(0, 1500, 20):
        score = all_v @ v[q]
        best = [i for i in ids[np.lexsort((ids, -np.round(score, 9)))] if i != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and q not in [r["vec_id"] for r in mine]
        assert all(abs(r["score"] - score[list(ids).index(r["vec_id"])]) < 1e-9 for r in mine)
        hits += len(set(best) & {r["vec_id"] for r in mine})
    assert hits / (10 * 75) >= 0.9
    assert neighbours.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("length", [100.0, 10_000.0])
def test_neighbours_with_one_very_long_vector(spark, length):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 32)) + rng.normal(size=(40, 32))[np.arange(4000) % 40]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] *= length
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, F.col("id") % 100 == 0, k=10).groupBy("query_id").agg(F.collect_set("vec_id"))
    mine = {q: set(found) for q, found in got.collect()}
    hits = 0
    for q in range(0, 4000, 100):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(mine[q] & set(np.argsort(-score)[:10].tolist()))
    assert hits / (10 * 40) >= 0.9


def test_toxicity_chain(spark, no_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        if toxic := i % 6 == 0:
            text[rng.randrange(60)] = rng.choice(["idiot", "scum", "trash"])
        low = i % 5 == 0
        rows.append((i, " ".join(text) + (" ###" if low else ""), int(low), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (5000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:600]] + [(7, None, None)], "doc_id long, low int, toxic int")
    chain = [("low", F.col("low")), ("toxic", F.col("toxic"))]
    model = toxicity.train(docs, labels, chain)
    found = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(found[r[0]], bool(r[3])) for r in rows[600:]]
    assert np.mean([a == b for a, b in held]) > 0.97 and found[None] is False
    nothing = toxicity.train(docs, labels.limit(0), chain)
    assert toxicity.score_toxicity(docs, nothing).where("toxic").count() == 0
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_tokens_equal_the_library(edge_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    letters = " \n\t'srevtmdlla1²½é\u00a0　!?<|>Zß中😀\u200b\u0301"
    texts = ["", "<|endoftext|> a<|endoftext|>", "a" * 3000, "!?" * 900, "don't  we'll'v", " x" * 20000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_fst.encode_texts(texts, PATH)] == expected
    assert token_fst.count_tokens(texts, PATH).tolist() == list(map(len, expected))
    rows = token_counts.token_counts(edge_docs, PATH).collect()
    assert len(rows) == 12 and [r["n_tokens"] for r in rows if r["doc_id"] == 1] == [0]
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_long_text_is_cut_where_a_piece_starts(monkeypatch):
    monkeypatch.setattr(token_fst, "BATCH_CHARS", 50)
    text = "it's  a test\n\n of we'll  cuts " * 40
    assert token_fst.encode_texts([text], PATH)[0].tolist() == Tokenizer.from_file(PATH).encode(text).ids


def test_language_identification(spark, data_dir, no_docs):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    model = language_id.train_on_documents(docs)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 %")], "doc_id long, text string")
    read = docs.unionByName(more, allowMissingColumns=True).withColumn("held", language_id.held_out(F.col("doc_id")))
    rows = language_id.identify_languages(read, model).collect()
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held"] and r["lang"]]
    assert np.mean(held) > 0.9
    assert [r["lang_pred"] for r in rows if r["doc_id"] < 0] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    nothing = language_id.train_on_documents(no_docs)
    assert language_id.identify_languages(docs.limit(3), nothing).where("lang_pred = 'und'").count() == 3


def test_packing(spark, edge_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    rows = packing.pack(packing.pieces(edge_docs, PATH)).collect()
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 2048 and packing.pack(packing.pieces(no_docs, PATH)).count() == 0


@pytest.mark.parametrize("size", [1, 40, 5000])
def test_packing_plan(size):
    rng = np.random.default_rng(size)
    stock = np.bincount(rng.integers(1, 2049, size), minlength=2049)
    plan = packing.plan_packing(stock)
    used = np.zeros_like(stock)
    for content, count in plan:
        assert sum(content) <= 2048
        np.add.at(used, list(content), count)
    assert (used == stock).all()
    plain = sum(packing.best_fit({int(n): int(stock[n]) for n in np.flatnonzero(stock)}).values())
    assert sum(c for _, c in plan) <= plain


def test_pipeline(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data_dir)
        assert after.columns == docs.columns and after.count() > 0, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.pack(spark, docs, data_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
