"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    compression_quality,
    maxent_lm,
    mil_toxicity,
    mixing,
    nnls_packing,
    rule_cascade,
    simhash,
    surrogates,
    url_rules,
    va_search,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the setting ``tessera.surrogate.key``; without one a fixed key for reproducible test rows."""
    return spark.conf.get("tessera.surrogate.key", "rows of synthetic test tables").encode()


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data, and how many mentions were replaced."""
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents"), surrogate_key(spark)).select("doc_id", "text", "n_replaced")


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return nnls_packing.pack(_table(spark, sf_dir, "documents"))


def op3_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the numbers of its sentences and of the offending ones."""
    return mil_toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in a mixture of as many tokens as there are."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the name of the failed rule, which depends on the measured order."""
    return rule_cascade.cascade(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under the unigram base and under the model."""
    return maxent_lm.score(_table(spark, sf_dir, "documents"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return compression_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    return va_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rule and the verdict of every page."""
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_surrogates, op2_nnls_packing, op3_mil_toxicity, op4_hierarchical_mixing, op5_rule_cascade, op6_maxent_lm,
    op7_compression_quality, op8_va_search, op9_url_rules, op10_covering_simhash,
)}

ORACLE_SQL = {
    "op8_va_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
""",
    "op4_hierarchical_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
    md5(coalesce(text, '')) AS print
  FROM documents
), e AS (
  SELECT *, CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'web' END AS domain FROM d
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL
), d1 AS (
  SELECT domain, sum(tokens) * 4.0::DOUBLE AS c, CASE domain WHEN 'web' THEN 3.0::DOUBLE WHEN 'books' THEN 2.0 ELSE 1.0 END AS w, (SELECT sum(tokens) FROM leaves)::DOUBLE AS b
  FROM leaves GROUP BY domain
), x1 AS (
  SELECT *, (b - coalesce(sum(c) OVER (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY c / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM d1
), s1 AS (SELECT domain, least(c, w * max(x) OVER ()) AS b FROM x1),
d2 AS (
  SELECT domain, lang, sum(tokens) * 4.0::DOUBLE AS c, any_value(s1.b) AS b,
    CASE WHEN domain = 'web' AND lang = 'en' THEN 4.0::DOUBLE WHEN domain = 'web' AND lang = 'de' THEN 2.0 WHEN domain = 'books' AND lang = 'en' THEN 2.0 ELSE 1.0 END AS w
  FROM leaves JOIN s1 USING (domain) GROUP BY domain, lang
), x2 AS (
  SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM d2
), s2 AS (SELECT domain, lang, least(c, w * max(x) OVER (PARTITION BY domain)) AS b FROM x2),
d3 AS (SELECT domain, lang, source, tokens, tokens * 4.0::DOUBLE AS c, b FROM leaves JOIN s2 USING (domain, lang)),
x3 AS (
  SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY domain, lang ORDER BY c, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / count(*) OVER (PARTITION BY domain, lang ORDER BY c, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM d3
), s3 AS (
  SELECT domain, lang, source, tokens, CAST(floor(least(c, max(x) OVER (PARTITION BY domain, lang)) + 1e-6) AS BIGINT) AS budget FROM x3
), used AS (
  SELECT e.*, budget // tokens AS epochs, budget % tokens AS rest,
    CAST('0x' || substr(md5('1:' || (budget // tokens) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || print), 1, 15) AS BIGINT) AS place
  FROM e JOIN s3 USING (domain, lang, source) WHERE n_tokens > 0 AND budget > 0
), places AS (
  SELECT domain, lang, source, rest, place, sum(n_tokens) AS t, count(*) AS copies FROM used GROUP BY ALL
), starts AS (
  SELECT *, coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM places
), stops AS (
  SELECT domain, lang, source, place AS stop, CAST((rest - start) // copies AS BIGINT) AS last FROM starts WHERE rest > 0 AND start < rest AND start + t >= rest
), parts AS (
  SELECT used.*, CASE WHEN rest = 0 THEN 0 WHEN place < stop THEN n_tokens WHEN place = stop THEN least(n_tokens, last) ELSE 0 END AS part
  FROM used LEFT JOIN stops USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, epoch, n_tokens, n_tokens AS taken_tokens FROM (SELECT *, unnest(range(epochs)) AS epoch FROM parts)
UNION ALL
SELECT doc_id, domain, lang, source, epochs, n_tokens, part FROM parts WHERE part > 0
""",
    "op5_rule_cascade": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), g AS (
  SELECT id, unnest(range(len(words) - 4)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) AS five
  FROM d WHERE len(words) >= 5
), h AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, five) AS times FROM g
), k AS (
  SELECT id, count(DISTINCT j) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 5)) AS j FROM h WHERE times > 1) GROUP BY id
), b AS (
  SELECT id, doc_id, t, words, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS full_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN k USING (id)
), c AS (
  SELECT *, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.3 * n_words OR word_chars < 2.0 * n_words OR word_chars > 16.0 * n_words
    OR (n_dup_lines > 0 AND 10 * n_dup_lines > 3 * len(full_lines))
    OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars
    OR length(t) - length(replace(t, '!', '')) > 0.3 * n_words OR (n_words >= 30 AND 10 * len(list_distinct(words)) < n_words)
    OR (instr(t, '...') > 0 AND n_words > 0 AND 3 * len(list_filter(lines, lambda x: rtrim(x) LIKE '%...')) > len(lines))) AS kept
FROM c
""",
}
