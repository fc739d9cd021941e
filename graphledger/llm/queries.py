"""The thin opN_ queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphledger.llm import mixing, toxicity, url_filter
from graphledger.llm.common import table
from graphledger.llm.decontamination import contaminated
from graphledger.llm.exact_topk import exact_topk
from graphledger.llm.ngram_jaccard import ngram_jaccard
from graphledger.llm.substring_dedup import substring_dedup
from graphledger.llm.suffix_dedup import suffix_dedup
from graphledger.llm.token_binary import token_binary
from graphledger.llm.token_counts import token_counts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=50)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), words=5, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), seed=17, with_copy=True)


#: The rules of the query's contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), good).alias("good"))
    return url_filter.url_filter(table(spark, sf_dir, "pages"), outcomes, URL_RULES, threshold=0.5)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_binary": op6_token_binary,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_url_filter": op10_url_filter,
}

ORACLE = {
    "op1_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), least AS (
  SELECT passage, min(doc_id) AS first_id FROM windows GROUP BY passage
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN least USING (passage) WHERE first_id < doc_id
), flat AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
), marked AS (
  SELECT flat.doc_id, flat.i, word, gone.doc_id IS NOT NULL AS removed
  FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.i = gone.i
), runs AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked
), each AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_spans,
    string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept
  FROM runs GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM words LEFT JOIN each USING (doc_id)
""",
    "op2_exact_topk": """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op4_suffix_dedup": """
WITH bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT doc_id, 1000 * k AS base, substr(h, 2000 * k + 1, 2098) AS part, n
  FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS k FROM bytes)
), flat AS (
  SELECT doc_id, base + i AS i, substr(part, 2 * i + 1, 2) AS x, CASE WHEN base + i + 50 <= n THEN substr(part, 2 * i + 1, 100) END AS piece
  FROM (SELECT *, unnest(range(0, least(1000, n - base))) AS i FROM parts)
), least AS (
  SELECT hash(piece) AS a, md5_number(piece) AS b, min(doc_id) AS first_id, max(doc_id) AS last_id FROM flat WHERE piece IS NOT NULL GROUP BY ALL HAVING first_id < last_id
), starts AS (
  SELECT flat.doc_id, i, x, coalesce(first_id < flat.doc_id, false) AS starts
  FROM flat LEFT JOIN least ON hash(piece) = a AND md5_number(piece) = b
), marked AS (
  SELECT doc_id, i, x, max(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) = 1 AS removed FROM starts
), runs AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked
), each AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT removed), '') AS kept
  FROM runs GROUP BY doc_id
)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes b LEFT JOIN each USING (doc_id)
""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT reach.node, ways.b FROM reach JOIN ways ON reach.seen = ways.a
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id)::BIGINT AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.node = w.doc_id
""",
    "op8_mixing": """
WITH counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rated AS (
  SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM counts) * (SELECT sum(n)::DOUBLE FROM counts) / n AS rate FROM counts
), terms AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rated
), facts AS (
  SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS log_factorial FROM terms
), cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS below FROM facts
), drawn AS (
  SELECT d.doc_id, count(*) AS copies
  FROM documents d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source
  WHERE cdf.below < ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
  GROUP BY d.doc_id
)
SELECT d.*, unnest(range(1, copies + 1))::INTEGER AS copy FROM documents d JOIN drawn USING (doc_id)
""",
    "op10_url_filter": """
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM rests
), known AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k, string_split(host, '.') AS l
  FROM parsed LEFT JOIN known USING (page_id) GROUP BY host
), cut AS (
  SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 3 ELSE least(len(l), 2) END AS keep FROM hosts
), named AS (
  SELECT host, n, k, array_to_string(l[len(l) - keep + 1:], '.') AS domain,
    CASE WHEN len(l) = 1 THEN host ELSE array_to_string(l[len(l) - keep + 2:], '.') END AS suffix
  FROM cut
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL
), levels AS (
  SELECT 'h' AS level, n, k FROM named UNION ALL SELECT 'd', n, k FROM domains UNION ALL SELECT 's', n, k FROM suffixes
), sums AS (
  SELECT level, count(*) AS g, sum(n) AS t, sum(k) AS s, sum(n * n) AS q, sum(k * k / n) AS r FROM levels WHERE n > 0 GROUP BY level
), parts AS (
  SELECT *, (s - r) / nullif(t - g, 0) AS within, (r - s * s / t) / nullif(g - 1, 0) AS between_, (t - q / t) / nullif(g - 1, 0) AS size FROM sums
), shares AS (
  SELECT *, (between_ - within) / (between_ + (size - 1) * within) AS share FROM parts
), pulls AS (
  SELECT l.level, CASE WHEN g > 1 AND t > g AND share > 0 THEN least(greatest((1 - share) / share, 2.0), 200.0) ELSE 200.0 END AS pull
  FROM (VALUES ('h'), ('d'), ('s')) l(level) LEFT JOIN shares USING (level)
), means AS (
  SELECT suffix, (k + p.pull * ((SELECT sum(k) FROM suffixes) + 1.0) / ((SELECT sum(n) FROM suffixes) + 2.0)) / (n + p.pull) AS mean_s
  FROM suffixes, pulls p WHERE p.level = 's'
), middle AS (
  SELECT domain, d.suffix, (k + p.pull * mean_s) / (n + p.pull) AS mean_d
  FROM domains d JOIN means ON d.suffix = means.suffix, pulls p WHERE p.level = 'd'
), ab AS (
  SELECT host, k + p.pull * mean_d AS a, n - k + p.pull * (1 - mean_d) AS b
  FROM named h JOIN middle m ON h.domain = m.domain AND h.suffix = m.suffix, pulls p WHERE p.level = 'h'
), bounds AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT DISTINCT ON (host, path) host, path, rule_host || rule_path AS rule, verdict
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules ON suffix('.' || host, '.' || rule_host) AND prefix(path, rule_path)
  ORDER BY host, path, length(rule_host || rule_path) DESC, rule
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path LEFT JOIN bounds b ON p.host = b.host
""",
}
