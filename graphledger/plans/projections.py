"""Graphs made of the driver's tables. Each is SQL that Spark and the oracle read alike; {table} names a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphledger.operators.graph import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CATEGORY = "CASE p_size % 6 WHEN 0 THEN 'stdlib' WHEN 1 THEN 'unknown' WHEN 2 THEN 'internal_module' WHEN 3 THEN 'relative_internal_module' ELSE 'third_party' END"

SQL = {
    # Customers are modules that import parts; some parts are modules of the code itself.
    "import_entities": f"""
SELECT concat('m', CAST(c_custkey AS VARCHAR(20))) AS entity_id, 'CodeModule' AS kind, 'canonical' AS canonical_status, concat(c_mktsegment, '.', c_name) AS module, CAST(NULL AS VARCHAR(80)) AS name, c_custkey AS ord FROM {{customer}}
UNION ALL
SELECT concat('p', CAST(p_partkey AS VARCHAR(20))), CASE WHEN {CATEGORY} IN ('internal_module', 'relative_internal_module') THEN 'CodeModule' ELSE 'ExternalPackage' END,
  CASE WHEN p_partkey % 11 = 0 THEN 'candidate' ELSE 'canonical' END,
  CASE WHEN {CATEGORY} IN ('internal_module', 'relative_internal_module') THEN concat(p_brand, '.', p_name, '.', CAST(p_partkey AS VARCHAR(20))) END,
  CASE WHEN {CATEGORY} IN ('internal_module', 'relative_internal_module') THEN CAST(NULL AS VARCHAR(80)) ELSE p_name END, 1000000000 + p_partkey FROM {{part}}""",
    "import_facts": f"""
SELECT concat('f', CAST(o_custkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS fact_id, 'IMPORTS' AS predicate, concat('m', CAST(o_custkey AS VARCHAR(20))) AS subject_id, concat('p', CAST(l_partkey AS VARCHAR(20))) AS object_id,
  CASE WHEN (o_custkey + l_partkey) % 7 = 0 THEN 'candidate' ELSE 'canonical' END AS canonical_status, min({CATEGORY}) AS category, min(p_type) AS import_root, min(p_brand) AS distribution_name, min(l_orderkey * 10 + l_linenumber) AS ord
FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey JOIN {{part}} ON l_partkey = p_partkey
GROUP BY o_custkey, l_partkey""",
    # Users call the next user in time.
    "call_edges": """
SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR(20))) AS src, concat('u', CAST(nxt AS VARCHAR(20))) AS dst
FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM {events}) t
WHERE nxt IS NOT NULL AND nxt <> user_id""",
    "symbols": """
SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR(20))) AS entity_id, 'CodeSymbol' AS kind, 'canonical' AS canonical_status, concat('mod', CAST(user_id % 7 AS VARCHAR(20))) AS module,
  concat('fn', CAST(user_id AS VARCHAR(20))) AS qualname, concat('src/f', CAST(user_id % 10 AS VARCHAR(20)), '.py') AS path, CAST(user_id * 10 AS INT) AS line, CAST(user_id * 10 + 9 AS INT) AS end_line, user_id AS ord
FROM {events}""",
    # Pages expose or call endpoints of their host.
    "page_facts": """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'EXPOSES_ENDPOINT' ELSE 'CALLS_ENDPOINT' END AS predicate,
  CASE WHEN page_id % 6 = 1 THEN CAST(NULL AS VARCHAR(8)) WHEN page_id % 6 = 2 THEN 'ANY' WHEN page_id % 4 < 2 THEN 'GET' ELSE 'POST' END AS method,
  regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), '/[0-9]+', '/{{id}}') AS path
FROM {pages}""",
    # Event types are channels.
    "event_facts": """
SELECT DISTINCT event_type AS channel, user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'PRODUCES_EVENT' WHEN event_type IN ('click', 'view') THEN 'CONSUMES_EVENT' ELSE 'REFERENCES_EVENT_CHANNEL' END AS predicate,
  CASE WHEN user_id % 5 = 0 THEN 'candidate' ELSE 'canonical' END AS status
FROM {events}""",
    # Order lines are evidence of their order.
    "evidence": """
SELECT concat('e', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) AS evidence_id, concat('o', CAST(l_orderkey AS VARCHAR(20))) AS target_id,
  CASE l_returnflag WHEN 'A' THEN 'runtime_observed' WHEN 'N' THEN 'deterministic_static' ELSE 'inferred_llm' END AS derivation_class,
  CASE WHEN l_quantity > 10 THEN 'src/a.py' END AS path, CAST(l_linenumber AS INT) AS line_start, CAST(l_linenumber + l_quantity % 3 - 1 AS INT) AS line_end, l_shipdate AS ingested_at, l_orderkey * 10 + l_linenumber AS ord
FROM {lineitem}""",
    "order_facts": """
SELECT concat('o', CAST(o_orderkey AS VARCHAR(20))) AS fact_id, CASE o_orderstatus WHEN 'O' THEN 'canonical' WHEN 'F' THEN 'candidate' ELSE 'demoted' END AS canonical_status, o_orderkey AS ord FROM {orders}""",
    # Two overlapping snapshots of who bought what; small parts have left the range by the second.
    "base_edges": """
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20))) AS dst FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00'""",
    "head_edges": """
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20))) AS dst FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND p_size > 5""",
    # Customers belong to nations, nations to regions.
    "geo_edges": """
SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS src, concat('n', CAST(c_nationkey AS VARCHAR(20))) AS dst, 'DEFINED_IN' AS predicate, concat('n', CAST(c_nationkey AS VARCHAR(20))) AS display, concat('g', CAST(c_custkey AS VARCHAR(20))) AS fact_id FROM {customer}
UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))), 'RESOLVES_TO_REPO', concat('r', CAST(n_regionkey AS VARCHAR(20))), concat('h', CAST(n_nationkey AS VARCHAR(20))) FROM {nation}""",
}


def oracle_text(name: str) -> str:
    """The projection for the oracle, which names its tables directly."""
    return re.sub(r"\{(\w+)\}", r"\1", SQL[name].replace("{{id}}", "\0")).replace("\0", "{id}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def _graph(spark: SparkSession, sf_dir: str, entities: str, facts: DataFrame) -> Graph:
    return Graph.of(spark, frame(spark, sf_dir, entities), facts)


def import_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, "import_entities", frame(spark, sf_dir, "import_facts"))


def call_graph(spark: SparkSession, sf_dir: str) -> Graph:
    edges = frame(spark, sf_dir, "call_edges")
    facts = edges.selectExpr("concat(src, '>', dst) AS fact_id", "'CALLS' AS predicate", "src AS subject_id", "dst AS object_id", "CAST(substr(src, 2) AS long) * 1000000 + CAST(substr(dst, 2) AS long) AS ord")
    return _graph(spark, sf_dir, "symbols", facts)


def page_graph(spark: SparkSession, sf_dir: str) -> Graph:
    pages = frame(spark, sf_dir, "page_facts")
    facts = pages.selectExpr("concat('f', page_id) AS fact_id", "predicate", "concat('s', host) AS subject_id", "concat('e', page_id) AS object_id", "method", "path", "page_id AS ord")
    services = pages.selectExpr("concat('s', host) AS entity_id", "'Service' AS kind", "host AS name").distinct()
    ends = pages.selectExpr("concat('e', page_id) AS entity_id", "'Endpoint' AS kind", "path", "method")
    return Graph.of(spark, services.unionByName(ends, allowMissingColumns=True), facts)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    rows = frame(spark, sf_dir, "event_facts")
    facts = rows.selectExpr("concat(channel, '-', user_id) AS fact_id", "predicate", "concat('s', user_id) AS subject_id", "concat('ch', channel) AS object_id", "status AS canonical_status", "user_id AS ord")
    channels = rows.selectExpr("concat('ch', channel) AS entity_id", "'EventChannel' AS kind", "'bus' AS broker_kind", "channel AS channel_address").distinct()
    services = rows.selectExpr("concat('s', user_id) AS entity_id", "'Service' AS kind", "concat('svc', user_id) AS name").distinct()
    return Graph.of(spark, channels.unionByName(services, allowMissingColumns=True), facts)


def with_oracle(*names: str) -> str:
    """WITH clause of projections for an oracle query."""
    return "WITH " + ", ".join(f"{n} AS ({oracle_text(n)})" for n in names)


