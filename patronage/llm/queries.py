"""The operators' queries, thin over their tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.llm import (
    chat,
    collocations,
    compression,
    language_id,
    lexical,
    mixing,
    neighbours,
    ngram_join,
    packing,
    quality,
    token_counts,
    toxicity,
    url_rules,
)
from patronage.llm.common import table

# The rules of op5.
URL_RULES = """SELECT * FROM VALUES
  ('allow', 'com', '/'),
  ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'),
  ('block', 'net', '/fr/')
AS rules(verdict, host, path)"""
# The conversation op4 adds.
HARD_CONVERSATION = r"""SELECT * FROM VALUES
  (-7L, 0L, 'user', R'\### Assistant: </turn> ok'),
  (-7L, 1L, 'assistant', R'\### Assistant: </turn> ok')
AS added(conv_id, turn, role, text)"""


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), count_links=False)
    return joined.select("doc_id", "n_shingles", "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, draw: n + draw["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "distance", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(HARD_CONVERSATION))
    return chat.digest(chat.format_conversations(rows)).drop("round_trip")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, spark.sql(URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(rows, F.col("id") % 20 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    categories = [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), categories)
    return toxicity.score_toxicity(docs, model)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train_on_documents(docs)
    read = docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language_id.identify_languages(read, model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression.train(docs, table(spark, sf_dir, "labels"))
    return compression.score_quality(docs, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_rules": op3_quality_rules,
    "op4_chat_format": op4_chat_format,
    "op5_url_filter": op5_url_filter,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_pattern_packing": op10_pattern_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_compression_quality": op13_compression_quality,
}

SQL: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
  FROM shingles x JOIN shingles y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * both_have >= 80 * (p.n + q.n - both_have)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), sized AS (
  SELECT *,
    (length(text) - length(replace(text, '### ', ''))) // 4
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS controls,
    length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'),
      '#', '%23')) AS role_chars
  FROM turns
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
    ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(4 + role_chars + 1 + length(text) + controls + 9) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op5_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)""",
    "op11_lexical_search": r"""
WITH held AS (
  SELECT doc_id, row_number() OVER () AS doc, unnest(list_filter(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term
  FROM documents WHERE text IS NOT NULL
), lengths AS (SELECT doc, any_value(doc_id) AS doc_id, count(*) AS n FROM held GROUP BY doc
), corpus AS (SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_terms FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term
  FROM benchmark WHERE text IS NOT NULL
), postings AS (
  SELECT doc, term, count(*) AS tf FROM held
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, corpus GROUP BY term, total_docs
), scored AS (
  SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf)
    // (1000 * tf + 8 * (100 - 90 + ((90 * n * total_docs) // total_terms))))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc), corpus
  GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)
QUALIFY row_number() OVER best <= 10""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
    UNION ALL
    SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM words
    UNION ALL
    SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM words
  ) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM candidates c, range(1, 3) AS k(k)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') AND k < c.size
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3
  ) GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase)
  WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, CAST(row_number() OVER best AS INTEGER) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000""",
}
