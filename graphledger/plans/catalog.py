"""All graph queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphledger.functions import exprs
from graphledger.operators import build, calls, diff, extract, graph, hypotheses, imports, linker, metrics, reconcile, review, surfaces, traverse
from graphledger.plans.projections import call_graph, event_graph, frame, import_graph, page_graph, with_oracle
from graphledger.sources import store
from graphledger.sources.session import shared_top

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register


IMPORTS = with_oracle("import_entities", "import_facts") + """, edges AS (
  SELECT f.*, s.module AS s_display, coalesce(o.module, o.name) AS o_display, o.name AS o_name, o.module AS o_module, o.kind AS o_kind,
    f.canonical_status = 'canonical' AND s.canonical_status = 'canonical' AND o.canonical_status = 'canonical' AS sure
  FROM import_facts f JOIN import_entities s ON f.subject_id = s.entity_id JOIN import_entities o ON f.object_id = o.entity_id)
"""
MATCH = "lower('{q}') IN (coalesce(lower(o_name), ''), coalesce(lower(o_module), ''), lower(import_root), lower(distribution_name))"
CALLS = with_oracle("call_edges", "symbols")
#: Names that stand for one and for several packages of the import graph.
BRAND = "Brand#11"


@query("q01_summary", with_oracle("import_entities", "import_facts") + """
SELECT 'kind' AS section, kind AS name, count(*) AS n FROM import_entities GROUP BY kind
UNION ALL SELECT 'predicate', predicate, count(*) FROM import_facts GROUP BY predicate""")
def summary(spark, sf):
    return graph.summary(import_graph(spark, sf))


FIRST = "(SELECT min(CAST(substr(src, 2) AS BIGINT)) FROM call_edges)"


def _first_user(spark, sf) -> str:
    return frame(spark, sf, "call_edges").agg(F.min(F.expr("CAST(substr(src, 2) AS long)"))).first()[0]


@query("q02_find_callers", CALLS + f"""
SELECT concat(src, '>', dst) AS fact_id, concat(s.module, '.', s.qualname) AS caller, concat(o.module, '.', o.qualname) AS callee, CAST(substr(src, 2) AS BIGINT) * 1000000 + CAST(substr(dst, 2) AS BIGINT) AS ord
FROM call_edges JOIN symbols s ON src = s.entity_id JOIN symbols o ON dst = o.entity_id WHERE dst = concat('u', {FIRST}) ORDER BY ord LIMIT 25""")
def find_callers(spark, sf):
    return calls.find_callers(call_graph(spark, sf), f"fn{_first_user(spark, sf)}")


@query("q03_find_callees", CALLS + f"""
SELECT concat(src, '>', dst) AS fact_id, concat(s.module, '.', s.qualname) AS caller, concat(o.module, '.', o.qualname) AS callee, CAST(substr(src, 2) AS BIGINT) * 1000000 + CAST(substr(dst, 2) AS BIGINT) AS ord
FROM call_edges JOIN symbols s ON src = s.entity_id JOIN symbols o ON dst = o.entity_id WHERE src = concat('u', {FIRST}) ORDER BY ord LIMIT 25""")
def find_callees(spark, sf):
    return calls.find_callees(call_graph(spark, sf), f"fn{_first_user(spark, sf)}")


def _walk(depth: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return CALLS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", walk AS (
  SELECT concat('u', {FIRST}) AS node, 0 AS depth
  UNION SELECT {b}, depth + 1 FROM walk JOIN call_edges ON node = {a} WHERE depth < {depth}), least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


def _root(spark, sf) -> DataFrame:
    return calls.resolved(call_graph(spark, sf), f"fn{_first_user(spark, sf)}", None, None, False)


@query("q04_blast_radius", _walk(1) + """
SELECT src, dst, depth + 1 AS depth, CAST(substr(src, 2) AS BIGINT) * 1000000 + CAST(substr(dst, 2) AS BIGINT) AS ord FROM least JOIN call_edges ON node = src""")
def blast_radius(spark, sf):
    return traverse.blast_radius(traverse.call_edges(call_graph(spark, sf)), _root(spark, sf), depth=2)


@query("q05_reverse_impact", _walk(3, back=True) + """
SELECT node, depth FROM least WHERE depth > 0""")
def reverse_impact(spark, sf):
    return traverse.reverse_impact(traverse.call_edges(call_graph(spark, sf)), _root(spark, sf), depth=3)


@query("q05_impact_tiers", _walk(3, back=True) + " SELECT depth, count(*) AS symbol_count FROM least WHERE depth > 0 GROUP BY depth")
def impact_tiers(spark, sf):
    return traverse.impact_tiers(reverse_impact(spark, sf))


@query("q06_modules_importing", IMPORTS + f"""
SELECT fact_id, s_display AS module, o_display AS package, category, ord FROM edges WHERE {MATCH.format(q=BRAND)} ORDER BY ord, fact_id LIMIT 25""")
def modules_importing(spark, sf):
    return imports.modules_importing(import_graph(spark, sf), BRAND)


@query("q07_top_dependencies", IMPORTS + """
SELECT o_name AS name, min_by(category, (ord, fact_id)) AS category, count(*) AS importer_count FROM edges
WHERE o_kind = 'ExternalPackage' AND category NOT IN ('stdlib', 'node_builtin', 'unknown') GROUP BY o_name ORDER BY importer_count DESC, name LIMIT 25""")
def top_dependencies(spark, sf):
    return imports.top_dependencies(import_graph(spark, sf))


@query("q08_dependency_info", IMPORTS + f"""
SELECT o_name AS name, max_by(category, (ord, fact_id)) AS category, max_by(import_root, (ord, fact_id)) AS import_root FROM edges WHERE {MATCH.format(q=BRAND)} AND o_kind = 'ExternalPackage' GROUP BY o_name""")
def dependency_info(spark, sf):
    return imports.dependency_info(import_graph(spark, sf), BRAND)


MODULE = """, target AS (SELECT min(o_module) AS t FROM edges WHERE sure AND o_kind = 'CodeModule')"""


def _module(spark, sf, last: bool = False) -> str:
    rows = import_graph(spark, sf).edges("IMPORTS", only_canonical=True).where("o_kind = 'CodeModule'")
    return rows.agg((F.max if last else F.min)("o_module")).first()[0]


@query("q09_who_imports", IMPORTS + MODULE + """
SELECT s_display AS module, fact_id FROM edges WHERE sure AND o_module = (SELECT t FROM target) ORDER BY s_display, ord, fact_id LIMIT 25""")
def who_imports(spark, sf):
    return imports.who_imports(import_graph(spark, sf), _module(spark, sf))


@query("q09_who_imports_groups", IMPORTS + MODULE + """
, cut AS (SELECT s_display FROM edges WHERE sure AND o_module = (SELECT t FROM target) ORDER BY s_display, ord, fact_id LIMIT 25)
SELECT split_part(s_display, '.', 1) AS prefix, count(*) AS n FROM cut GROUP BY 1""")
def who_imports_groups(spark, sf):
    return imports.who_imports_groups(import_graph(spark, sf), _module(spark, sf), depth=1)


@query("q10_top_internal_dependencies", IMPORTS + """
SELECT o_display AS module, object_id, o_kind AS kind, count(DISTINCT s_display) AS importer_count, count(*) AS fact_count, min(s_display) AS first_sample FROM edges
WHERE sure AND category IN ('internal_module', 'relative_internal_module') AND o_kind = 'CodeModule' GROUP BY ALL ORDER BY importer_count DESC, module, object_id LIMIT 25""")
def top_internal_dependencies(spark, sf):
    return imports.top_internal_dependencies(import_graph(spark, sf))


@query("q11_top_fan_in_symbols", CALLS + """
SELECT concat(o.module, '.', o.qualname) AS symbol, dst AS object_id, 'CodeSymbol' AS kind, count(DISTINCT src) AS caller_count, count(*) AS fact_count, min(concat(s.module, '.', s.qualname)) AS first_sample
FROM call_edges JOIN symbols s ON src = s.entity_id JOIN symbols o ON dst = o.entity_id GROUP BY ALL ORDER BY caller_count DESC, symbol, object_id LIMIT 25""")
def top_fan_in_symbols(spark, sf):
    return imports.top_fan_in_symbols(call_graph(spark, sf))


@query("q12_modules_importing_both", IMPORTS + """, ends AS (SELECT min(o_module) AS l, max(o_module) AS r FROM edges WHERE sure AND o_kind = 'CodeModule')
SELECT DISTINCT a.s_display AS module, a.subject_id FROM edges a JOIN edges b ON a.subject_id = b.subject_id, ends
WHERE a.sure AND b.sure AND a.o_module = l AND b.o_module = r ORDER BY module, subject_id LIMIT 25""")
def modules_importing_both(spark, sf):
    return imports.modules_importing_both(import_graph(spark, sf), _module(spark, sf), _module(spark, sf, last=True))


@query("q13_dependency_path", with_oracle("geo_edges") + """
SELECT concat(a.src, ' > ', a.dst, ' > ', b.dst) AS path, 2 AS hops FROM geo_edges a JOIN geo_edges b ON a.dst = b.src WHERE a.src = 'c1' AND b.dst = (SELECT max(b.dst) FROM geo_edges a JOIN geo_edges b ON a.dst = b.src WHERE a.src = 'c1')""")
def dependency_path(spark, sf):
    edges = frame(spark, sf, "geo_edges")
    far = edges.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src = 'c1'").agg(F.max("b.dst")).first()[0]
    return traverse.dependency_paths(edges, "c1", far)


def _links(spark, sf) -> graph.Graph:
    rows = frame(spark, sf, "geo_edges").where("predicate = 'DEFINED_IN'")
    facts = rows.selectExpr("fact_id", "'RESOLVES_TO_REPO' AS predicate", "src AS subject_id", "dst AS object_id", "dst AS consumer_repo", "src AS package_name")
    ends = rows.selectExpr("src AS entity_id", "'ExternalPackage' AS kind", "src AS name").unionByName(rows.selectExpr("dst AS entity_id", "'Repo' AS kind", "dst AS name").distinct())
    return graph.Graph.of(spark, ends, facts)


@query("q14_cross_repo_links", with_oracle("geo_edges") + """
SELECT dst AS consumer_repo, src AS package_name, 'RESOLVES_TO_REPO' AS predicate, dst AS provider, fact_id, count(*) OVER () AS total FROM geo_edges WHERE predicate = 'DEFINED_IN' ORDER BY consumer_repo, package_name, fact_id LIMIT 25""")
def cross_repo_links(spark, sf):
    return surfaces.cross_repo_links(_links(spark, sf))


@query("q15_repo_dependencies", with_oracle("geo_edges") + """
SELECT dst AS consumer_repo, src AS package_name, dst AS provider FROM geo_edges WHERE predicate = 'DEFINED_IN' AND dst = 'n7' ORDER BY package_name LIMIT 25""")
def repo_dependencies(spark, sf):
    return surfaces.repo_dependencies(_links(spark, sf), "n7")


PAGES = with_oracle("page_facts")
SHAPE = r"CASE WHEN path = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '\{id\}(/|$)', '{param}\1', 'g'), '(.)/+$', '\1') END"


@query("q16_domain_references", PAGES + """
SELECT DISTINCT host AS subject, host AS object, 'REFERENCES_DOMAIN' AS predicate, 'direct' AS via FROM page_facts WHERE contains(host, 'example.net') ORDER BY object, subject LIMIT 25""")
def domain_references(spark, sf):
    rows = frame(spark, sf, "page_facts").select("host").distinct()
    facts = rows.selectExpr("concat('f', host) AS fact_id", "'REFERENCES_DOMAIN' AS predicate", "concat('s', host) AS subject_id", "concat('d', host) AS object_id")
    ends = rows.selectExpr("concat('s', host) AS entity_id", "'Service' AS kind", "host AS name").unionByName(rows.selectExpr("concat('d', host) AS entity_id", "'Domain' AS kind", "host AS name"))
    return surfaces.domain_references(graph.Graph.of(spark, ends, facts), "example.net")


@query("q17_endpoints", PAGES + """
SELECT concat('f', page_id) AS fact_id, path, predicate, host AS subject FROM page_facts WHERE contains(lower(path), '/en') ORDER BY path, predicate, concat_ws(' ', method, path), fact_id LIMIT 25""")
def endpoints(spark, sf):
    return surfaces.endpoints(page_graph(spark, sf), "/en")


@query("q17_endpoints_under", PAGES + f"""
, shaped AS (SELECT page_id, predicate, {SHAPE} AS shape FROM page_facts)
SELECT concat('f', page_id) AS fact_id, shape, predicate FROM shaped WHERE shape = '/en' OR starts_with(shape, '/en/')""")
def endpoints_under(spark, sf):
    return surfaces.endpoints_under(page_graph(spark, sf), "/en")


@query("q18_reconcile_endpoints", PAGES + f"""
, shaped AS (SELECT predicate, {SHAPE} AS key FROM page_facts)
SELECT key, CASE WHEN count(*) FILTER (predicate = 'EXPOSES_ENDPOINT') = 0 THEN 'right_only' WHEN count(*) FILTER (predicate = 'CALLS_ENDPOINT') = 0 THEN 'left_only' ELSE 'matched' END AS status,
  count(*) FILTER (predicate = 'EXPOSES_ENDPOINT') AS left_n, count(*) FILTER (predicate = 'CALLS_ENDPOINT') AS right_n FROM shaped GROUP BY key""")
def reconcile_endpoints(spark, sf):
    rows = frame(spark, sf, "page_facts").withColumn("key", exprs.path_shape(F.col("path")))
    return reconcile.reconcile(rows.where("predicate = 'EXPOSES_ENDPOINT'"), rows.where("predicate = 'CALLS_ENDPOINT'"))


@query("q19_possible_matches")
def possible_matches(spark, sf):
    rows = frame(spark, sf, "page_facts").withColumn("key", exprs.path_shape(F.col("path"))).select("page_id", "key")
    left, right = (rows.where(F.col("page_id") % 2 == k).select("key").distinct() for k in (0, 1))
    return reconcile.scored(reconcile.candidates(left.join(right, "key", "left_anti"), right.join(left, "key", "left_anti")))


@query("q20_event_channels", with_oracle("event_facts") + """
SELECT concat('bus:', channel) AS channel, concat('svc', user_id) AS service, predicate, CASE WHEN predicate <> 'REFERENCES_EVENT_CHANNEL' AND status = 'canonical' THEN 'known_linked' ELSE 'candidate' END AS bucket
FROM event_facts ORDER BY bucket DESC, channel, service, concat(channel, '-', user_id) LIMIT 100""")
def event_channels(spark, sf):
    return surfaces.event_channels(event_graph(spark, sf), "bus", limit=100)


@query("q20_event_asymmetry", with_oracle("event_facts") + """
SELECT concat('bus:', channel) AS channel, count(DISTINCT user_id) FILTER (predicate = 'PRODUCES_EVENT') AS producers, count(DISTINCT user_id) FILTER (predicate = 'CONSUMES_EVENT') AS consumers,
  CASE WHEN count(*) FILTER (predicate = 'CONSUMES_EVENT') = 0 THEN 'no_consumer' WHEN count(*) FILTER (predicate = 'PRODUCES_EVENT') = 0 THEN 'no_producer' END AS gap
FROM event_facts WHERE predicate <> 'REFERENCES_EVENT_CHANNEL' GROUP BY channel""")
def event_asymmetry(spark, sf):
    return surfaces.event_asymmetry(event_graph(spark, sf))


@query("q21_deploy_mappings", """
SELECT concat('site:', s_name) AS target, n_name AS source, 'DEPLOYS_VIA_CONFIG' AS predicate, CASE WHEN s_suppkey % 3 = 0 THEN 'candidate' ELSE 'known' END AS bucket
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', n_name, concat('site:', s_name), 'DEPLOYS_VIA_CONFIG')), 'supplier') ORDER BY bucket DESC, target, source, s_suppkey LIMIT 100""")
def deploy_mappings(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    facts = s.selectExpr("lpad(s_suppkey, 12, '0') AS fact_id", "'DEPLOYS_VIA_CONFIG' AS predicate", "concat('n', n_nationkey) AS subject_id", "concat('t', s_suppkey) AS object_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'candidate' ELSE 'canonical' END AS canonical_status")
    ends = s.selectExpr("concat('t', s_suppkey) AS entity_id", "'DeployTarget' AS kind", "'site' AS type", "s_name AS target").unionByName(s.selectExpr("concat('n', n_nationkey) AS entity_id", "'Service' AS kind", "n_name AS name").distinct(), allowMissingColumns=True)
    return surfaces.deploy_mappings(graph.Graph.of(spark, ends, facts), "supplier", limit=100)


@query("q22_lookup_symbol", with_oracle("symbols") + """
, hits AS (SELECT entity_id, concat(module, '.', qualname) AS display, kind, path, line FROM symbols WHERE contains(concat(module, '.', qualname), 'mod3.fn1'))
, tiers AS (SELECT *, CASE WHEN display = 'mod3.fn1' THEN 'exact_qualified' ELSE 'fuzzy' END AS tier FROM hits)
SELECT *, count(*) OVER () AS candidates FROM tiers WHERE tier = (SELECT min(tier) FROM tiers)""")
def lookup_symbol(spark, sf):
    return calls.lookup_symbol(call_graph(spark, sf), "mod3.fn1")


@query("q23_symbols_in_file", with_oracle("symbols") + """
SELECT concat(module, '.', qualname) AS display, kind, line FROM symbols WHERE path = 'src/f3.py' ORDER BY line, display LIMIT 100""")
def symbols_in_file(spark, sf):
    return calls.symbols_in_file(call_graph(spark, sf), "./src/f3.py")


@query("q25_resolve_import_target", IMPORTS + f"""
, found AS (SELECT DISTINCT object_id FROM edges WHERE sure AND {MATCH.format(q=BRAND)})
SELECT CASE count(*) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(object_id) END AS entity_id FROM found""")
def resolve_import_target(spark, sf):
    return imports.resolve_import_target(import_graph(spark, sf), BRAND)


EVIDENCE = with_oracle("evidence", "order_facts")


def _evidence(spark, sf) -> tuple[DataFrame, DataFrame]:
    return frame(spark, sf, "order_facts"), frame(spark, sf, "evidence")


@query("a04_strongest_derivation", EVIDENCE + """
, ranked AS (SELECT *, CASE derivation_class WHEN 'runtime_observed' THEN 4 WHEN 'deterministic_static' THEN 3 ELSE 1 END AS rank FROM evidence)
SELECT target_id, arg_max(derivation_class, rank * 1000000000000 - ord) AS derivation_class, count(*) AS n FROM ranked GROUP BY target_id""")
def strongest(spark, sf):
    facts, evidence = _evidence(spark, sf)
    return calls.strongest_derivation(graph.Graph.of(spark, facts.selectExpr("fact_id AS entity_id"), facts, evidence))


NOW = "1999-06-01 00:00:00"


@query("m03_freshness", EVIDENCE + f"""
SELECT round(avg(CASE WHEN ingested_at >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN 1.0 ELSE 0.0 END), 9) AS value FROM evidence""")
def freshness(spark, sf):
    return metrics.freshness(_evidence(spark, sf)[1], NOW).select(F.round("value", 9).alias("value"))


@query("m06_grounding", EVIDENCE + """
SELECT round(avg(CASE WHEN fact_id IN (SELECT target_id FROM evidence WHERE path IS NOT NULL AND line_start >= 1 AND line_end >= line_start) THEN 1.0 ELSE 0.0 END), 9) AS value FROM order_facts""")
def grounding(spark, sf):
    return metrics.grounding(*_evidence(spark, sf)).select(F.round("value", 9).alias("value"))


@query("m08_trust_mix", EVIDENCE + """
, best AS (SELECT target_id, max(CASE derivation_class WHEN 'runtime_observed' THEN 0.85 WHEN 'deterministic_static' THEN 0.95 ELSE 0.35 END) AS w FROM evidence GROUP BY target_id)
SELECT round(avg((CASE canonical_status WHEN 'canonical' THEN 1.0 WHEN 'candidate' THEN 0.5 ELSE 0.1 END)::DOUBLE * coalesce(w, 0)::DOUBLE), 9) AS value FROM order_facts LEFT JOIN best ON fact_id = target_id""")
def trust_mix(spark, sf):
    return metrics.trust_mix(*_evidence(spark, sf)).select(F.round("value", 9).alias("value"))


@query("m09_useful_edge", CALLS + """
SELECT round(avg(CASE WHEN entity_id IN (SELECT src FROM call_edges UNION SELECT dst FROM call_edges) THEN 1.0 ELSE 0.0 END), 9) AS value FROM symbols""")
def useful_edge(spark, sf):
    anchors = frame(spark, sf, "symbols").withColumnRenamed("entity_id", "node")
    return metrics.useful_edge(anchors, frame(spark, sf, "call_edges")).select(F.round("value", 9).alias("value"))


@query("m04_opportunity", """
WITH o AS (SELECT event_id AS id, event_type, user_id, CAST(floor(value) AS BIGINT) AS line FROM events WHERE event_id % 2 = 0), e AS (SELECT event_type, user_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 20 AS b FROM events WHERE event_id % 2 = 1),
met AS (SELECT DISTINCT id FROM o JOIN e ON o.event_type = e.event_type AND o.user_id = e.user_id WHERE line BETWEEN a AND b)
SELECT round(avg(CASE WHEN id IN (SELECT id FROM met) THEN 1.0 ELSE 0.0 END), 9) AS opportunity,
  round(avg(CASE WHEN id NOT IN (SELECT id FROM met) AND NOT (event_type = 'error' AND user_id % 2 = 0) THEN 1.0 ELSE 0.0 END), 9) AS silent_gap FROM o""")
def opportunity(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS id", "event_type AS predicate", "cast(user_id AS string) AS path", "CAST(floor(value) AS long) AS line", "user_id")
    o, e = events.where("id % 2 = 0"), events.where("id % 2 = 1").selectExpr("predicate", "path", "line AS line_start", "line + 20 AS line_end")
    told = events.where("predicate = 'error' AND user_id % 2 = 0")
    return metrics.opportunity(o, e, told).select(F.round("opportunity", 9).alias("opportunity"), F.round("silent_gap", 9).alias("silent_gap"))


@query("m12_cell_score", """
WITH cells AS (SELECT c_mktsegment AS cell, c_custkey AS id, (c_custkey % 10 + 1) / 11.0::DOUBLE AS freshness, (c_custkey % 7 + 1) / 8.0::DOUBLE AS opportunity, CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS grounding,
  0.9::DOUBLE AS meta, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 0.7 END::DOUBLE AS useful, (c_custkey % 3 + 1) / 4.0::DOUBLE AS trust, 0.1::DOUBLE AS silent_gap, 0.95::DOUBLE AS identity FROM customer),
scored AS (SELECT *, CASE WHEN useful IS NULL THEN NULL WHEN grounding = 0 THEN 0 ELSE exp((ln(freshness) + ln(opportunity) + ln(grounding) + ln(meta) + ln(useful) + ln(trust)) / 6) * (1 - silent_gap) * identity END AS score FROM cells)
SELECT cell, round(avg(score), 6) AS score, count(*) AS cells FROM scored GROUP BY cell""")
def cell_score(spark, sf):
    cells = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_mktsegment AS cell", "(c_custkey % 10 + 1) / 11D AS freshness", "(c_custkey % 7 + 1) / 8D AS opportunity", "CASE WHEN c_custkey % 13 = 0 THEN 0D ELSE 0.5D END AS grounding", "0.9D AS meta",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 0.7D END AS useful", "(c_custkey % 3 + 1) / 4D AS trust", "0.1D AS silent_gap", "0.95D AS identity",
    )
    return metrics.worst_first(metrics.cell_score(cells), "cell")


DIFF = with_oracle("base_edges", "head_edges")
LOST = ", lost AS (SELECT * FROM base_edges EXCEPT SELECT * FROM head_edges), won AS (SELECT * FROM head_edges EXCEPT SELECT * FROM base_edges)"


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    return frame(spark, sf, "base_edges"), frame(spark, sf, "head_edges")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@query("d01_row_diff", DIFF + LOST + " SELECT *, 'removed' AS change FROM lost UNION ALL SELECT *, 'added' FROM won")
def row_diff(spark, sf):
    return diff.row_diff(*_sides(spark, sf), "src", "dst")


@query("d01_diff_counts", DIFF + LOST + " SELECT (SELECT count(*) FROM lost) AS removed, (SELECT count(*) FROM won) AS added, (SELECT count(*) FROM base_edges SEMI JOIN head_edges USING (src, dst)) AS common")
def diff_counts(spark, sf):
    return diff.diff_counts(*_sides(spark, sf), "src", "dst")


HEAD = ", nodes AS (SELECT src AS node FROM head_edges UNION SELECT dst FROM head_edges)"


@query("d03_surviving_referrers", DIFF + HEAD + """
SELECT dst AS removed, count(DISTINCT src) AS referrers FROM base_edges WHERE dst NOT IN (SELECT node FROM nodes) AND src IN (SELECT node FROM nodes) GROUP BY dst""")
def surviving_referrers(spark, sf):
    base, head = _sides(spark, sf)
    return diff.surviving_referrers(base, _nodes(head))


@query("d04_responsibility_moved", DIFF + LOST + """
SELECT dst, l.n AS lost, w.n AS won FROM (SELECT dst, count(DISTINCT src) AS n FROM lost GROUP BY dst) l JOIN (SELECT dst, count(DISTINCT src) AS n FROM won GROUP BY dst) w USING (dst)""")
def responsibility_moved(spark, sf):
    return diff.responsibility_moved(*_sides(spark, sf))


@query("d07_guard_call_removed", DIFF + LOST + HEAD + " SELECT src, dst FROM lost WHERE src IN (SELECT node FROM nodes)")
def guard_call_removed(spark, sf):
    base, head = _sides(spark, sf)
    return diff.guard_call_removed(base, head, _nodes(head))


@query("d08_top_lost", DIFF + LOST + """
, refs AS (SELECT dst, count(DISTINCT src) AS refs FROM base_edges GROUP BY dst)
, ranked AS (SELECT src, dst, refs, row_number() OVER (PARTITION BY src ORDER BY refs DESC, dst)::INTEGER AS place, count(*) OVER (PARTITION BY src) AS n FROM lost JOIN refs USING (dst))
SELECT src, dst, refs, place, greatest(n - 3, 0) AS omitted, n > 5 AS flagged FROM ranked WHERE place <= 3""")
def top_lost(spark, sf):
    base, head = _sides(spark, sf)
    return diff.top_lost(base.join(head, ["src", "dst"], "left_anti"), base)


@query("d13_demote_channels", with_oracle("event_facts") + """
SELECT channel, CASE WHEN bool_or(predicate <> 'REFERENCES_EVENT_CHANNEL') THEN 'canonical' ELSE 'candidate' END AS status, count(*) AS mentions FROM event_facts GROUP BY channel""")
def demote_channels(spark, sf):
    facts = frame(spark, sf, "event_facts")
    return diff.demote_channels(facts.select("channel", F.lit(False).alias("has_literal")).distinct(), facts)


@query("j04_link_packages", """
WITH c AS (SELECT DISTINCT c_nationkey AS repo, lower(c_mktsegment) AS key FROM customer UNION SELECT DISTINCT c_nationkey, concat('pkg-', c_custkey % 40) FROM customer),
p AS (SELECT DISTINCT s_nationkey AS provider, concat('pkg-', s_suppkey % 40) AS key FROM supplier),
u AS (SELECT key, repo, count(DISTINCT provider) AS n, min(provider) AS provider FROM c JOIN p USING (key) WHERE repo <> provider GROUP BY key, repo)
SELECT repo, key AS package, provider FROM u WHERE key NOT IN (SELECT key FROM u WHERE n > 1)""")
def link_packages(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    consumers = c.selectExpr("c_nationkey AS repo", "lower(c_mktsegment) AS package").union(c.selectExpr("c_nationkey", "concat('pkg-', c_custkey % 40)")).distinct()
    providers = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey AS repo", "array(concat('PKG_', s_suppkey % 40), concat('pkg..', s_suppkey % 40)) AS names")
    return linker.link_packages(consumers, providers)


@query("j08_suffix_links", """
WITH t AS (SELECT p_partkey AS target, concat('/srv/', p_brand, '/', p_size % 10, '/', p_name) AS path FROM part), m AS (SELECT DISTINCT p_type AS service, concat(p_size % 10, '/', p_name) AS path FROM part UNION SELECT DISTINCT p_type, concat(p_brand, '/', p_size % 10, '/', p_name) FROM part),
hits AS (SELECT target, service, len(string_split(m.path, '/')) AS segments FROM t JOIN m ON suffix(t.path, '/' || m.path)), best AS (SELECT * FROM hits QUALIFY segments = max(segments) OVER (PARTITION BY target))
SELECT DISTINCT target, service, segments::INTEGER AS segments, CASE WHEN count(DISTINCT service) OVER (PARTITION BY target) = 1 THEN 'canonical' ELSE 'candidate' END AS status FROM best""")
def suffix_links(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    modules = p.selectExpr("p_type AS service", "concat(p_size % 10, '/', p_name) AS path").union(p.selectExpr("p_type", "concat(p_brand, '/', p_size % 10, '/', p_name)"))
    return linker.suffix_links(p.selectExpr("p_partkey AS target", "concat('/srv/', p_brand, '/', p_size % 10, '/', p_name) AS path"), modules.distinct())


@query("j11_endpoint_consumers", PAGES + f"""
, e AS (SELECT *, {SHAPE} AS shape FROM page_facts)
SELECT DISTINCT p.host AS provider, c.host AS consumer, shape, c.method FROM e p JOIN e c USING (shape) WHERE p.predicate = 'EXPOSES_ENDPOINT' AND c.predicate = 'CALLS_ENDPOINT' AND c.method IS NOT NULL AND p.host <> c.host AND (p.method = 'ANY' OR p.method = c.method)""")
def endpoint_consumers(spark, sf):
    return surfaces.endpoint_consumers(page_graph(spark, sf))


@query("j14_symbols_of_ranges", with_oracle("symbols") + """
, r AS (SELECT path, line + 3 AS a, line + 5 AS b FROM symbols UNION ALL SELECT path, line + 5, line + 14 FROM symbols)
, hits AS (SELECT r.path, a, b, entity_id, line <= a AND end_line >= b AS inside FROM r JOIN symbols s ON r.path = s.path AND line <= b AND a <= end_line)
SELECT path, a AS start, b AS end, entity_id, CASE WHEN inside THEN 'enclosing' ELSE 'overlapping' END AS match FROM hits QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY path, a, b)""")
def symbols_of_ranges(spark, sf):
    s = frame(spark, sf, "symbols")
    ranges = s.selectExpr("path", "line + 3 AS start", "line + 5 AS end").union(s.selectExpr("path", "line + 5", "line + 14"))
    return calls.symbols_of_ranges(call_graph(spark, sf), ranges)


@query("j15_inside_any", """
WITH p AS (SELECT event_type, event_id AS id, CAST(floor(value) AS BIGINT) AS line FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + user_id % 3 AS b FROM events WHERE event_id % 2 = 1)
SELECT event_type, id, line FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.event_type = p.event_type AND line BETWEEN a AND b)""")
def inside_any(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    points = e.where("event_id % 2 = 0").selectExpr("event_type", "event_id AS id", "CAST(floor(value) AS long) AS line")
    ranges = e.where("event_id % 2 = 1").selectExpr("event_type", "CAST(floor(value) AS long) AS start", "CAST(floor(value) AS long) + user_id % 3 AS end")
    return linker.inside_any(points, ranges, "event_type")


@query("j17_nearest_before", """
WITH p AS (SELECT event_type, event_id AS id, CAST(floor(value) AS BIGINT) AS line FROM events WHERE event_id % 2 = 0), m AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS line, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_id % 2 = 1)
SELECT p.event_type, id, p.line, (SELECT max_by(value, (m.line, value)) FROM m WHERE m.event_type = p.event_type AND m.line <= p.line) AS value FROM p""")
def nearest_before(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    points = e.where("event_id % 2 = 0").selectExpr("event_type", "event_id AS id", "CAST(floor(value) AS long) AS line")
    marks = e.where("event_id % 2 = 1").selectExpr("event_type", "CAST(floor(value) AS long) AS line", "CAST(user_id AS string) AS value")
    return linker.nearest_before(points, marks, "event_type")


@query("j18_select_workloads", """
SELECT concat('s', s.s_suppkey) AS service, concat('c', c_custkey) AS workload, s_nationkey AS namespace FROM supplier s JOIN customer c ON s_nationkey = c_nationkey WHERE s_suppkey % 3 = c_custkey % 3 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 = c_custkey % 5)""")
def select_workloads(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("concat('s', s_suppkey) AS service", "s_nationkey AS namespace", "CASE WHEN s_suppkey % 2 = 0 THEN map('app', cast(s_suppkey % 3 AS string)) ELSE map('app', cast(s_suppkey % 3 AS string), 'tier', cast(s_suppkey % 5 AS string)) END AS selector")
    w = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("concat('c', c_custkey) AS workload", "c_nationkey AS namespace", "map('app', cast(c_custkey % 3 AS string), 'tier', cast(c_custkey % 5 AS string), 'x', 'y') AS labels")
    return linker.select_workloads(s, w)


@query("l05_capped", """
WITH r AS (SELECT o_custkey AS key, o_totalprice AS rank, o_orderkey AS id FROM orders)
, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank DESC, id)::INTEGER AS place, count(*) OVER (PARTITION BY key) AS of FROM r)
SELECT * FROM p WHERE place <= 3 ORDER BY rank DESC, key, id LIMIT 12""")
def capped(spark, sf):
    return surfaces.capped(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS key", "o_totalprice AS rank", "o_orderkey AS id"), "key", 3, 12)


@query("l12_diverse_first", """
WITH r AS (SELECT o_orderpriority AS key, o_totalprice AS score, o_orderkey AS id FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id)::INTEGER AS round FROM r)
SELECT * FROM p ORDER BY round, score DESC, id LIMIT 40""")
def diverse_first(spark, sf):
    return surfaces.diverse_first(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderpriority AS key", "o_totalprice AS score", "o_orderkey AS id"), "key", "score", 40)


@query("f01_package_names", "SELECT p_partkey, regexp_replace(lower(trim(concat(' ', p_name, '__', p_brand, '..x '))), '[-_.]+', '-', 'g') AS name FROM part")
def package_names(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", exprs.package_name(F.concat(F.lit(" "), "p_name", F.lit("__"), "p_brand", F.lit("..x "))).alias("name"))


@query("f02_stable_hash", "SELECT c_custkey, substr(sha256(concat(c_name, '|', 'None', '|', c_mktsegment)), 1, 24) AS id FROM customer")
def stable_hashes(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", exprs.stable_hash(F.col("c_name"), F.lit(None), F.col("c_mktsegment")).alias("id"))


@query("f03_urn", "SELECT c_custkey, concat('graph://module/', url_encode(trim(c_mktsegment)), '/', url_encode(trim(c_name))) AS urn FROM customer")
def urns(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", exprs.urn("graph", "module", F.lit("x"), F.col("c_mktsegment"), F.col("c_name")).alias("urn"))


@query("t04_members", with_oracle("geo_edges").replace("WITH ", "WITH RECURSIVE ", 1) + """
, walk AS (SELECT DISTINCT src AS own, src AS here FROM geo_edges UNION SELECT own, dst FROM walk JOIN geo_edges ON here = src)
SELECT DISTINCT own AS class_id, concat('f', dst) AS member FROM walk JOIN geo_edges ON here = src""")
def members(spark, sf):
    edges = frame(spark, sf, "geo_edges")
    return traverse.transitive_members(edges.selectExpr("src AS class_id", "dst AS base_id"), edges.selectExpr("src AS class_id", "concat('f', dst) AS member"))


@query("x01_domains", """
WITH urls AS (SELECT page_id, unnest(regexp_extract_all(url, '[A-Za-z][A-Za-z0-9+.-]*://[^\\s"''<>]+')) AS u FROM pages),
hosts AS (SELECT page_id, lower(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/@]*@)?', ''), '[:/?#].*$', '')) AS domain FROM urls)
SELECT DISTINCT page_id, domain FROM hosts WHERE regexp_full_match(domain, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,63}')""")
def domains(spark, sf):
    return extract.domains_in(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "url")


@query("d05_call_edge_delta", DIFF + LOST + """
, changed AS (SELECT *, 'removed' AS change FROM lost UNION ALL SELECT *, 'added' FROM won)
SELECT src, dst, concat('src/', dst, '.py') AS path, change FROM changed WHERE dst IN ('p1', 'p2', 'p3')""")
def call_edge_delta(spark, sf):
    base, head = _sides(spark, sf)
    place = lambda x: x.withColumn("path", F.concat(F.lit("./src/"), "dst", F.lit(".py")))
    rows = diff.call_edge_delta(place(base.join(head, ["src", "dst"], "left_anti")), place(head.join(base, ["src", "dst"], "left_anti")), ["src/p1.py", "./src/p2.py", "src\\p3.py"])
    return rows.withColumn("path", exprs.strict_path(F.col("path")))


@query("d06_removed_test_references", DIFF + LOST + HEAD + """
SELECT src, dst, concat('tests/', src, '.py') AS path FROM lost WHERE src < 'c5' AND dst IN (SELECT node FROM nodes)""")
def removed_test_references(spark, sf):
    base, head = _sides(spark, sf)
    path = F.when(F.col("src") < "c5", F.concat(F.lit("tests/"), "src", F.lit(".py"))).otherwise(F.concat(F.lit("src/"), "src", F.lit(".py")))
    return diff.removed_test_references(base.join(head, ["src", "dst"], "left_anti").withColumn("path", path), _nodes(head))


@query("q24_evidence_for_call", """
SELECT concat('o', o_orderkey) AS fact_id, concat('e', l_orderkey, '-', l_linenumber) AS evidence_id, 'deterministic_static' AS derivation_class, CAST(NULL AS VARCHAR) AS path, l_linenumber::INTEGER AS line_start
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))
ORDER BY o_orderkey, l_linenumber, evidence_id LIMIT 25""")
def evidence_for_call(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    first = orders.agg(F.min(F.struct("o_custkey", "o_orderpriority")).alias("f")).first()["f"]
    facts = orders.selectExpr("concat('o', o_orderkey) AS fact_id", "'CALLS' AS predicate", "concat('c', o_custkey) AS subject_id", "o_orderpriority AS object_id", "o_orderkey AS ord")
    ends = orders.selectExpr("concat('c', o_custkey) AS entity_id", "'CodeSymbol' AS kind", "'m' AS module", "concat('c', o_custkey) AS qualname").union(orders.selectExpr("o_orderpriority", "'CodeSymbol'", "'m'", "concat('t', o_orderpriority)")).distinct()
    evidence = lines.selectExpr("concat('e', l_orderkey, '-', l_linenumber) AS evidence_id", "concat('o', l_orderkey) AS target_id", "'deterministic_static' AS derivation_class", "l_linenumber AS line_start", "l_linenumber AS ord")
    return calls.evidence_for_call(graph.Graph.of(spark, ends, facts, evidence), f"c{first['o_custkey']}", f"t{first['o_orderpriority']}")


@query("m11_identity_health", """
SELECT round(avg(CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 9) AS value FROM customer""")
def identity_health(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    name = exprs.urn("graph", "module", exprs.stable_hash(F.col("c_custkey")), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    return metrics.identity_health(c.select(name.alias("urn"))).select(F.round("value", 9).alias("value"))


@query("m07_meta_coverage", """
WITH known AS (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')
SELECT round(avg(CASE WHEN p IN (SELECT event_type FROM known) THEN 1.0 ELSE 0.0 END), 9) AS value FROM (VALUES ('click'), ('view'), ('error'), ('refund')) t(p)""")
def meta_coverage(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "predicate")
    tools = spark.createDataFrame([(x,) for x in ("click", "view", "error", "refund")], "predicate string")
    covered = e.select("predicate", F.when(F.col("predicate") == "error", "uninstrumented").otherwise("instrumented").alias("state"))
    return metrics.meta_coverage(tools, e.where("predicate IN ('click', 'purchase')"), covered).select(F.round("value", 9).alias("value"))


@query("m10_cross_repo_linkage", """
SELECT round(avg(CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) THEN 1.0 ELSE 0.0 END), 9) AS value FROM (SELECT DISTINCT p_brand FROM part)""")
def cross_repo_linkage(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumnRenamed("p_brand", "package")
    return metrics.cross_repo_linkage(p, p.where("p_size > 45")).select(F.round("value", 9).alias("value"))


@query("j05_prefer", """
WITH c AS (SELECT o_custkey AS package, o_orderstatus AS provider, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS rank FROM orders)
SELECT DISTINCT package, provider, rank FROM c QUALIFY rank = min(rank) OVER (PARTITION BY package)""")
def prefer(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS package", "o_orderstatus AS provider", "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS rank")
    return linker.prefer(o.distinct(), ["package"], "rank")


@query("j07_classify_packages", """
WITH c AS (SELECT DISTINCT c_nationkey AS repo, concat('pkg-', c_custkey % 40) AS key FROM customer), p AS (SELECT DISTINCT s_nationkey AS provider, concat('pkg-', s_suppkey % 40) AS key FROM supplier),
n AS (SELECT key, count(DISTINCT repo) AS consumers, count(DISTINCT provider) FILTER (provider <> repo) AS others, count(provider) AS hits FROM c LEFT JOIN p USING (key) GROUP BY key)
SELECT key, consumers, CASE WHEN others = 1 THEN 'internal' WHEN others > 1 THEN 'ambiguous' WHEN hits > 0 THEN 'self' ELSE 'external' END AS bucket FROM n""")
def classify_packages(spark, sf):
    consumers = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_nationkey AS repo", "concat('Pkg_', c_custkey % 40) AS package")
    providers = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey AS repo", "array(concat('pkg.', s_suppkey % 40)) AS names")
    return linker.classify_packages(consumers, providers)


@query("j09_sole_service", "SELECT c_nationkey AS repo, min(c_mktsegment) AS service FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) = 1")
def sole_service(spark, sf):
    return linker.sole_service(spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_nationkey AS repo", "c_mktsegment AS service"))


@query("j19_handler_policies", """
WITH h AS (SELECT DISTINCT p_brand AS module, p_type AS qualname FROM part), p AS (SELECT DISTINCT p_brand AS module, CASE WHEN p_size > 25 THEN concat(p_type, '.m') ELSE p_type END AS qualname, p_size AS policy FROM part)
SELECT DISTINCT h.qualname AS handler, policy, CASE WHEN p.qualname = h.qualname THEN 'exact' ELSE 'method' END AS via FROM h JOIN p ON h.module = p.module AND (p.qualname = h.qualname OR p.qualname = concat(h.qualname, '.m'))""")
def handler_policies(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    handlers = p.selectExpr("p_brand AS module", "p_type AS qualname", "p_type AS handler").distinct()
    return linker.handler_policies(handlers, p.selectExpr("p_brand AS module", "CASE WHEN p_size > 25 THEN concat(p_type, '.m') ELSE p_type END AS qualname", "p_size AS policy").distinct())


@query("l08_by_relevance", """
WITH r AS (SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN concat('src/', p_brand, '.py') END AS path, CASE p_size % 4 WHEN 0 THEN 'known_linked' WHEN 1 THEN 'candidate' WHEN 2 THEN 'unlinked' ELSE 'missing' END AS status,
  CASE p_size % 5 WHEN 0 THEN 'manual_override' WHEN 1 THEN 'runtime_observed' ELSE 'candidate' END AS derivation_class, p_size % 7 AS depth FROM part),
s AS (SELECT *, CASE WHEN lower(name) = 'brand#11.py' THEN 3 WHEN coalesce(suffix(lower(path), 'brand#11.py'), false) THEN 2 WHEN contains(lower(name), 'brand#11.py') OR contains('brand#11.py', lower(name)) THEN 1 ELSE 0 END AS m,
  CASE status WHEN 'known_linked' THEN 3 WHEN 'candidate' THEN 2 WHEN 'unlinked' THEN 1 ELSE 0 END AS l, CASE derivation_class WHEN 'manual_override' THEN 7 WHEN 'runtime_observed' THEN 4 ELSE 2 END AS d FROM r)
SELECT ord, name, m, l, d, -depth AS n, row_number() OVER (ORDER BY m DESC, l DESC, d DESC, depth, path IS NOT NULL DESC, ord)::INTEGER AS place FROM s""")
def by_relevance(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS ord", "p_name AS name", "CASE WHEN p_size % 3 <> 0 THEN concat('src/', p_brand, '.py') END AS path", "CASE p_size % 4 WHEN 0 THEN 'known_linked' WHEN 1 THEN 'candidate' WHEN 2 THEN 'unlinked' ELSE 'missing' END AS status",
        "CASE p_size % 5 WHEN 0 THEN 'manual_override' WHEN 1 THEN 'runtime_observed' ELSE 'candidate' END AS derivation_class", "p_size % 7 AS depth",
    )
    place = F.row_number().over(Window.orderBy(F.desc("score"), "ord"))
    return review.by_relevance(rows, "Brand#11.py").select("ord", "name", "score.m", "score.l", "score.d", "score.n", place.alias("place"))


@query("l09_edge_roles", """
WITH e AS (SELECT o_orderkey AS ord, o_custkey AS other_id, CASE WHEN o_custkey % 5 = 0 THEN 'ExternalPackage' ELSE 'CodeSymbol' END AS other_kind, CASE WHEN o_orderstatus = 'F' THEN concat('tests/c', o_custkey, '.py') ELSE concat('src/c', o_custkey, '.py') END AS other_path FROM orders),
f AS (SELECT c_custkey AS other_id, c_mktsegment = 'BUILDING' AS stores, c_mktsegment = 'MACHINERY' AS acts FROM customer)
SELECT ord, e.other_id, CASE WHEN starts_with(other_path, 'tests/') THEN 'test_assertion' WHEN other_kind = 'ExternalPackage' THEN 'generic_utility' WHEN stores THEN 'persistence' WHEN acts THEN 'external_side_effect' ELSE 'intra_repo_consumer' END AS edge_role FROM e LEFT JOIN f USING (other_id)""")
def edge_roles(spark, sf):
    edges = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS ord", "o_custkey AS other_id", "CASE WHEN o_custkey % 5 = 0 THEN 'ExternalPackage' ELSE 'CodeSymbol' END AS other_kind", "CASE WHEN o_orderstatus = 'F' THEN concat('tests/c', o_custkey, '.py') ELSE concat('src/c', o_custkey, '.py') END AS other_path")
    facts = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS subject_id", "CASE c_mktsegment WHEN 'BUILDING' THEN 'HANDLES_MODEL' WHEN 'MACHINERY' THEN 'CALLS_ENDPOINT' ELSE 'IMPORTS' END AS predicate")
    return review.edge_roles(edges, facts).select("ord", "other_id", "edge_role")


@query("l11_reorder_in_place", """
WITH r AS (SELECT o_orderkey AS ord, o_orderpriority AS grp, o_totalprice AS score FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, ord) AS k FROM r), b AS (SELECT grp, ord AS slot, row_number() OVER (PARTITION BY grp ORDER BY ord) AS k FROM r)
SELECT ord, grp, slot FROM a JOIN b USING (grp, k)""")
def reorder_in_place(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS ord", "o_orderpriority AS grp", "o_totalprice AS score")
    return review.reorder_in_place(rows, ["grp"]).select("ord", "grp", "slot")


@query("l14_within_budget", """
WITH r AS (SELECT p_partkey AS id, p_retailprice AS rank, sum(length(p_name)) OVER (ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM part) SELECT * FROM r WHERE used <= 15000""")
def within_budget(spark, sf):
    return review.within_budget(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", "p_retailprice AS rank", "p_name AS text"), 15000)


@query("l15_seats", """
WITH r AS (SELECT p_type AS family, p_size AS score, p_partkey % 8 AS tier, p_partkey AS ord FROM part) , b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, ord) = 1) SELECT * FROM b ORDER BY score DESC, tier DESC, ord LIMIT 5""")
def seats(spark, sf):
    return review.seats(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_type AS family", "p_size AS score", "p_partkey % 8 AS tier", "p_partkey AS ord"), 5)


@query("j26_paired_deltas", """
WITH t AS (SELECT o_custkey AS run_group, o_orderpriority AS task, CASE WHEN o_orderstatus = 'O' THEN 'on' ELSE 'off' END AS arm, o_totalprice AS value FROM orders),
g AS (SELECT run_group, task, count(*) FILTER (arm = 'on') AS a, count(*) FILTER (arm = 'off') AS b, max(value) FILTER (arm = 'on') AS x, max(value) FILTER (arm = 'off') AS y FROM t GROUP BY ALL)
SELECT run_group, task, CASE WHEN a > 1 OR b > 1 THEN 'duplicate' WHEN a = 0 OR b = 0 THEN 'unpaired' END AS problem, CASE WHEN a = 1 AND b = 1 THEN y - x END AS delta FROM g""")
def paired_deltas(spark, sf):
    return review.paired_deltas(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS run_group", "o_orderpriority AS task", "CASE WHEN o_orderstatus = 'O' THEN 'on' ELSE 'off' END AS arm", "o_totalprice AS value"))


@query("j27_baseline_drift", """
WITH a AS (SELECT 'c' AS section, n_name AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), e AS (SELECT 'c' AS section, n_name AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 OR c_acctbal > 0 GROUP BY n_name)
SELECT section, key, a.n AS actual, e.n AS expected FROM a FULL JOIN e USING (section, key) WHERE a.n IS DISTINCT FROM e.n""")
def baseline_drift(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    count = lambda x: x.groupBy(F.lit("c").alias("section"), F.col("n_name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return review.baseline_drift(count(rows), count(rows.where("n_regionkey <> 1 OR c_acctbal > 0")))


REPO = "concat('r', CAST(substr(src, 2) AS BIGINT) % 3)"


@query("d04_responsibility_moved_in_repo", DIFF + LOST + f"""
SELECT dst, repo, l.n AS lost, w.n AS won FROM (SELECT dst, {REPO} AS repo, count(DISTINCT src) AS n FROM lost GROUP BY ALL) l JOIN (SELECT dst, {REPO} AS repo, count(DISTINCT src) AS n FROM won GROUP BY ALL) w USING (dst, repo)""")
def responsibility_moved_in_repo(spark, sf):
    return diff.responsibility_moved(*(x.withColumn("repo", F.expr(REPO)) for x in _sides(spark, sf)))


@query("j20_in_both", """
SELECT concat('urn:', c_custkey) AS urn, concat('b', c_custkey) AS base_id, concat('h', c_custkey) AS head_id, c_mktsegment AS base_kind, c_mktsegment AS head_kind FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def in_both(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    side = lambda name, n: rows.where(f"c_custkey % {n} = 0").selectExpr("concat('urn:', c_custkey) AS urn", f"concat('{name}', c_custkey) AS entity_id", "c_mktsegment AS kind")
    return diff.in_both(side("b", 2), side("h", 3), "kind")


@query("d02_union_scopes", """
SELECT DISTINCT o_orderstatus AS repo, o_orderpriority AS predicate FROM orders""")
def union_scopes(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    one = rows.where("o_orderkey % 2 = 0").selectExpr("map('repo', o_orderstatus, 'predicate', o_orderpriority) AS scope")
    two = rows.where("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0").selectExpr("map('predicate', o_orderpriority, 'repo', o_orderstatus) AS scope")
    return diff.union_scopes(one, two).selectExpr("scope['repo'] AS repo", "scope['predicate'] AS predicate")


@query("j10_not_linked", """
SELECT DISTINCT l_suppkey AS service, l_partkey AS target FROM lineitem WHERE l_returnflag = 'N' AND (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')""")
def not_linked(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey AS service", "l_partkey AS target", "l_returnflag AS flag")
    return linker.not_linked(rows.where("flag = 'N'").drop("flag").distinct(), rows.where("flag = 'R'"), "service", "target")


@query("j06_with_fallback", """
SELECT p_partkey AS id, p_brand AS name, CASE WHEN p_partkey % 5 = 0 THEN concat('py:', p_partkey) WHEN p_partkey % 3 = 0 THEN concat('ts:', p_partkey) END AS value, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE -1 END AS resolver FROM part""")
def with_fallback(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", "p_brand AS name")
    resolvers = [rows.where(f"id % {n} = 0").selectExpr("id", f"concat('{name}:', id) AS value") for name, n in (("py", 5), ("ts", 3))]
    return linker.with_fallback(rows, resolvers, "id").withColumn("resolver", F.coalesce("resolver", F.lit(-1)))


@query("j25_routed", """
SELECT s_name AS domain, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A' AND l_linenumber = 7) AS routed FROM supplier""")
def routed(spark, sf):
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
    routes = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 49 AND l_returnflag = 'A' AND l_linenumber = 7")
    return linker.routed(suppliers.selectExpr("s_name AS domain"), routes.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("s_name AS domain"))


MODULE = "concat(CASE p_size % 5 WHEN 0 THEN 'app.tasks' WHEN 1 THEN 'app.API' WHEN 2 THEN 'shop.models' WHEN 3 THEN 'x.serializers.views' ELSE 'pkg.core' END, '.', p_type)"
PATH = "CASE WHEN p_partkey % 7 = 0 THEN 'shop/management/commands/run.py' WHEN p_partkey % 9 = 0 THEN 'jobs/x.py' ELSE 'shop/x.py' END"


@query("f15_roles", f"""
WITH r AS (SELECT p_partkey AS id, p_size % 5 AS k, p_partkey % 7 = 0 AS command, p_partkey % 7 <> 0 AND p_partkey % 9 = 0 AS jobs, p_partkey % 11 = 0 AS field FROM part)
SELECT id, array_to_string(list_filter([CASE WHEN k IN (1, 3) THEN 'api' END, CASE WHEN k = 2 AND NOT field THEN 'model' END, CASE WHEN command THEN 'scheduled_job' END, CASE WHEN k = 3 THEN 'serializer' END, CASE WHEN k = 0 OR jobs THEN 'worker' END], lambda x: x IS NOT NULL), ',') AS roles FROM r""")
def roles(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", f"{MODULE} AS module", f"{PATH} AS path", "CASE WHEN p_partkey % 11 = 0 THEN 'django_field' ELSE 'class' END AS kind")
    return rows.select("id", F.array_join(linker.roles(F.col("module"), F.col("path"), F.col("kind")), ",").alias("roles"))


@query("f19_callable", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 = 0 ELSE o_orderstatus <> 'P' END AS callable FROM orders""")
def callable_symbols(spark, sf):
    kind = "CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderstatus WHEN 'O' THEN 'function' WHEN 'F' THEN 'method' ELSE 'module' END END"
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", f"{kind} AS kind", "CASE WHEN o_orderkey % 3 = 0 THEN 'f' WHEN o_orderkey % 3 = 1 THEN '' END AS qualname")
    return rows.select("id", calls.is_callable(F.col("kind"), F.col("qualname")).alias("callable"))


@query("p04_call_site", """
SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN event_type END AS source_line, CASE WHEN user_id % 2 = 0 THEN props END AS source_excerpt, user_id % 3 = 0 OR user_id % 2 = 0 AS known FROM events""")
def call_sites(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    site = calls.call_site(F.expr("CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN '  ' END"), F.expr("CASE WHEN user_id % 2 = 0 THEN props ELSE '' END"))
    return rows.select(F.col("event_id").alias("id"), site.alias("s")).select("id", "s.source_line", "s.source_excerpt", F.col("s").isNotNull().alias("known"))


@query("l10_strongest_hypotheses", """
WITH h AS (SELECT o_orderkey AS ord, o_orderpriority AS risk_type, CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'medium' ELSE 'other' END AS specificity, o_custkey % 4 AS leads, o_orderkey % 3 AS evidence, o_custkey % 3 AS strength FROM orders)
SELECT ord, row_number() OVER o::INTEGER AS place FROM h WINDOW o AS (ORDER BY CASE specificity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, leads DESC, evidence DESC, strength DESC, risk_type, ord) ORDER BY place LIMIT 5""")
def strongest_hypotheses(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS ord", "o_orderpriority AS risk_type", "CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'medium' ELSE 'other' END AS specificity",
        "array_repeat('l', cast(o_custkey % 4 AS int)) AS leads", "array_repeat('e', cast(o_orderkey % 3 AS int)) AS evidence", "CASE o_custkey % 3 WHEN 2 THEN 'strong' WHEN 1 THEN 'medium' ELSE 'weak' END AS confidence",
    )
    return review.strongest_hypotheses(rows).select("ord", "place")


@query("a08_phase_means", """
SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'unknown') AS phase, count(*) AS tasks, round(avg(user_id), 6) AS avg_tool_calls_delta, round(avg(CASE WHEN user_id % 2 = 0 THEN event_id END + user_id), 6) AS avg_token_delta, round(avg(value), 6) AS avg_wall_time_delta FROM events GROUP BY 1""")
def phase_means(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CASE WHEN event_type <> 'error' THEN event_type END AS phase", "user_id AS tool_calls", "CASE WHEN user_id % 2 = 0 THEN event_id END AS tokens_in", "user_id AS tokens_out", "value AS wall_time")
    means = review.phase_means(rows)
    return means.select("phase", "tasks", *(F.round(c, 6).alias(c) for c in means.columns[2:]))


@query("a08_rubric_wins", """
WITH r AS (SELECT CASE user_id % 4 WHEN 0 THEN 'mcp_on' WHEN 1 THEN 'mcp_off' WHEN 2 THEN 'tie' END AS evidence, CASE event_type WHEN 'click' THEN 'tie' WHEN 'view' THEN 'draw' ELSE 'mcp_on' END AS correctness FROM events)
SELECT 'evidence' AS aspect, coalesce(evidence, 'unknown') AS winner, count(*) AS n FROM r GROUP BY 2
UNION ALL SELECT 'correctness', CASE correctness WHEN 'draw' THEN 'unknown' ELSE correctness END, count(*) FROM r GROUP BY 2""")
def rubric_wins(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CASE user_id % 4 WHEN 0 THEN 'mcp_on' WHEN 1 THEN 'mcp_off' WHEN 2 THEN 'tie' END AS evidence", "CASE event_type WHEN 'click' THEN 'tie' WHEN 'view' THEN 'draw' ELSE 'mcp_on' END AS correctness")
    return review.rubric_wins(rows, ["evidence", "correctness"])


#: Source files of a small repository: every supplier's module uses that of a nation's number, if there is one.
SOURCE = """concat('import os\\nimport requests\\nfrom src.m', s_nationkey, ' import f', s_nationkey, '\\n\\nclass C', s_suppkey, ':\\n    def run(self):\\n        return f', s_nationkey, '(os.getenv(\"KEY_', s_nationkey, '\"))\\n\\ndef f', s_suppkey, '():\\n    return C', s_suppkey, '()\\n')"""


def _stored(spark, sf) -> graph.Graph:
    """Extracts, builds, publishes and reads the graph of the suppliers' files."""
    files = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("'r' AS repo", "concat('src/m', s_suppkey, '.py') AS path", f"{SOURCE} AS content")
    repos = spark.createDataFrame([("r", "acme", "c0ffee")], "repo string, owner string, commit_sha string")
    path = f"{shared_top(spark)}/graphledger-{uuid.uuid4().hex}"
    store.publish(spark, build.build(files, repos), path)
    return store.read_graph(spark, path)


@query("g01_stored_edges", """
WITH f AS (SELECT s_suppkey AS k, s_nationkey AS n, s_nationkey IN (SELECT s_suppkey FROM supplier) AS inside FROM supplier)
SELECT 'DEFINED_IN' AS predicate, concat('src.m', k) AS subject, 'r' AS object FROM f
UNION ALL SELECT 'IMPLEMENTS', concat('src.m', k), 'r' FROM f
UNION ALL SELECT 'DEFINED_IN', concat('src.m', k, '.', s), concat('src.m', k) FROM (SELECT k, unnest([concat('C', k), concat('C', k, '.run'), concat('f', k)]) AS s FROM f)
UNION ALL SELECT 'IMPORTS', concat('src.m', k), unnest(['os', 'requests', CASE WHEN inside THEN concat('src.m', n) ELSE 'src' END]) FROM f
UNION ALL SELECT 'CALLS', concat('src.m', k, '.C', k, '.run'), unnest(['os', CASE WHEN inside THEN concat('src.m', n, '.f', n) ELSE 'src' END]) FROM f
UNION ALL SELECT 'REFERENCES_ENV_VAR', concat('src.m', k, '.C', k, '.run'), concat('KEY_', n) FROM f
UNION ALL SELECT 'CALLS', concat('src.m', k, '.f', k), concat('src.m', k, '.C', k) FROM f""")
def stored_edges(spark, sf):
    return _stored(spark, sf).edges().selectExpr("predicate", "s_display AS subject", "o_display AS object")


@query("g02_stored_symbols", """
WITH s AS (SELECT s_suppkey AS k, unnest([struct_pack(q := concat('C', s_suppkey), t := 'class', l := 5, e := 7), struct_pack(q := concat('C', s_suppkey, '.run'), t := 'method', l := 6, e := 7), struct_pack(q := concat('f', s_suppkey), t := 'function', l := 9, e := 10)]) AS x FROM supplier)
SELECT concat('graph://code-symbol/default/r/src.m', k, '/', x.q, '/', x.t) AS urn, concat('src/m', k, '.py') AS path, x.l AS line, x.e AS end_line,
  concat('ent_', substr(sha256(concat('CodeSymbol|{"module":"src.m', k, '","qualname":"', x.q, '","repo":"r","symbol_kind":"', x.t, '","tenant_id":"default"}')), 1, 24)) AS entity_id FROM s""")
def stored_symbols(spark, sf):
    return _stored(spark, sf).entities.where("kind = 'CodeSymbol'").select("urn", "path", "line", "end_line", "entity_id")


SNAPSHOT = """
WITH base AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS line FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), head AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS line FROM orders WHERE o_orderkey % 2 <> 0 GROUP BY ALL)"""


@query("d01_snapshot_diff", SNAPSHOT + """
, b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM base), h AS (SELECT DISTINCT o_custkey, o_orderstatus FROM head)
SELECT 'entity' AS section, 'CodeModule' AS name, 'removed' AS change, concat('urn:', o_custkey) AS key FROM (SELECT o_custkey FROM b EXCEPT SELECT o_custkey FROM h)
UNION ALL SELECT 'entity', 'CodeModule', 'added', concat('urn:', o_custkey) FROM (SELECT o_custkey FROM h EXCEPT SELECT o_custkey FROM b)
UNION ALL SELECT 'fact', 'CALLS', 'removed', concat('c', o_custkey, '|x|{"category":"', o_orderstatus, '"}') FROM (FROM b EXCEPT FROM h)
UNION ALL SELECT 'fact', 'CALLS', 'added', concat('c', o_custkey, '|x|{"category":"', o_orderstatus, '"}') FROM (FROM h EXCEPT FROM b)""")
def snapshot_diff(spark, sf):
    def side(n: int, line: str) -> graph.Graph:
        rows = spark.read.parquet(f"{sf}/orders.parquet").where(f"o_orderkey % {n} <> 0")
        # The lines of a fact differ on both sides and say nothing about what it is.
        facts = rows.selectExpr("concat('f', o_orderkey) AS fact_id", "'CALLS' AS predicate", "concat('c', o_custkey) AS subject_id", "'x' AS object_id", f"concat('{{\"{line}\":', o_orderkey, ',\"category\":\"', o_orderstatus, '\"}}') AS qualifier", "o_orderkey AS ord")
        entities = rows.selectExpr("concat('e', o_custkey) AS entity_id", "concat('urn:', o_custkey) AS urn", "'CodeModule' AS kind", "'t' AS tenant_id")
        return graph.Graph.of(spark, entities, facts)

    return diff.snapshot_diff(side(3, "line"), side(2, "source_line"))


@query("d03_former_referrers", DIFF + LOST + HEAD + """
, gone AS (SELECT DISTINCT dst FROM base_edges WHERE dst NOT IN (SELECT node FROM nodes))
SELECT DISTINCT dst AS removed, src AS referrer, src NOT IN (SELECT src FROM won) AS likely_unchanged FROM base_edges WHERE dst IN (SELECT dst FROM gone) AND src IN (SELECT node FROM nodes)""")
def former_referrers(spark, sf):
    base, head = _sides(spark, sf)
    return diff.former_referrers(base, head, _nodes(head))


@query("q05_reverse_impact_by_root", CALLS.replace("WITH ", "WITH RECURSIVE ", 1) + """
, roots AS (SELECT entity_id AS root FROM symbols ORDER BY ord LIMIT 3),
walk AS (SELECT root, root AS node, 0 AS depth FROM roots UNION SELECT root, src, depth + 1 FROM walk JOIN call_edges ON node = dst WHERE depth < 2),
least AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT root, node, depth, CASE WHEN node NOT IN (SELECT dst FROM call_edges) THEN 'no_callers' WHEN depth = 2 THEN 'max_depth_reached' END AS terminal FROM least WHERE depth > 0""")
def reverse_impact_by_root(spark, sf):
    g = call_graph(spark, sf)
    roots = g.entities.orderBy("ord").limit(3).select(F.col("entity_id").alias("root_id"))
    return traverse.reverse_impact_by_root(traverse.call_edges(g), roots, depth=2)


@query("h01_review_hypotheses", """
WITH l AS (SELECT l_orderkey AS review, l_linenumber AS k, l_suppkey AS s, l_returnflag AS r, l_partkey AS p FROM lineitem),
f AS (SELECT review, count(*) FILTER (k = 1) AS tests, count(*) FILTER (k <= 2) AS tests_or_configs, count(*) FILTER (k = 3) AS styles FROM l GROUP BY 1),
y AS (SELECT review, 'f' || s % 5 AS name FROM l WHERE k IN (2, 4)), ys AS (SELECT review, count(*) AS symbols FROM y GROUP BY 1), names AS (SELECT DISTINCT review, name FROM y),
e AS (SELECT review, 'f' || s % 5 AS subject, r = 'R' AS destroys FROM l WHERE k IN (3, 5)),
es AS (SELECT review, count(*) AS edges, count(*) FILTER ((review, subject) IN (SELECT (review, name) FROM names)) AS code_edges, count(*) FILTER (destroys AND (review, subject) IN (SELECT (review, name) FROM names)) AS destructive FROM e GROUP BY 1),
g AS (SELECT review, count(*) AS swallowed FROM l WHERE p % 4 = 0 AND k <= 5 GROUP BY 1), c AS (SELECT review, count(*) AS runtime FROM l WHERE p % 11 = 0 GROUP BY 1),
a AS (SELECT review, review % 7 = 0 AS low, coalesce(tests, 0) AS tests, coalesce(tests_or_configs, 0) AS tests_or_configs, coalesce(styles, 0) AS styles, coalesce(symbols, 0) AS symbols, coalesce(edges, 0) AS edges, coalesce(code_edges, 0) AS code_edges, coalesce(destructive, 0) AS destructive, coalesce(swallowed, 0) AS swallowed, coalesce(runtime, 0) AS runtime
  FROM (SELECT o_orderkey AS review FROM orders) LEFT JOIN f USING (review) LEFT JOIN ys USING (review) LEFT JOIN es USING (review) LEFT JOIN g USING (review) LEFT JOIN c USING (review)),
h AS (SELECT review, 'direct_call_contract_drift' AS risk_type, 'low' AS specificity, CASE WHEN runtime > 0 THEN 'strong' ELSE 'medium' END AS confidence, edges AS leads FROM a WHERE NOT low AND symbols > 0 AND edges > 0
  UNION ALL SELECT review, 'runtime_endpoint_or_event_contract_drift', 'low', CASE WHEN symbols > 0 THEN 'medium' ELSE 'weak' END, symbols FROM a WHERE NOT low AND runtime > 0
  UNION ALL SELECT review, 'test_or_config_masks_runtime_change', 'low', 'weak', symbols FROM a WHERE NOT low AND tests_or_configs > 0 AND symbols + edges > 0
  UNION ALL SELECT review, 'test_locks_in_regression', 'low', 'weak', symbols + code_edges FROM a WHERE NOT low AND tests > 0 AND code_edges > 0
  UNION ALL SELECT review, 'destructive_mutation_test_gap', 'medium', CASE WHEN symbols > 0 THEN 'medium' ELSE 'weak' END, destructive FROM a WHERE NOT low AND destructive > 0 AND tests = 0
  UNION ALL SELECT review, 'swallowed_exception_state_drift', 'high', CASE WHEN symbols > 0 AND edges > 0 THEN 'medium' ELSE 'weak' END, swallowed FROM a WHERE NOT low AND swallowed > 0
  UNION ALL SELECT review, 'low_coverage_stylesheet_gap', 'low', 'weak', symbols FROM a WHERE low AND styles > 0)
SELECT review, risk_type, specificity, confidence, leads, row_number() OVER (PARTITION BY review ORDER BY CASE specificity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, leads DESC, CASE confidence WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, risk_type)::INTEGER AS place FROM h QUALIFY place <= 5""")
def review_hypotheses(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS review", "l_linenumber AS k", "l_suppkey % 5 AS s", "l_returnflag AS r", "l_partkey AS p")
    reviews = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS review", "o_orderkey % 7 = 0 AS low_coverage")
    path = "CASE k WHEN 1 THEN 'tests/a.py' WHEN 2 THEN 'conf/a.yaml' WHEN 3 THEN 'a.css' WHEN 4 THEN 'src/a.py' WHEN 5 THEN 'src/b.py' ELSE 'src/c.py' END"
    files = l.selectExpr("review", f"{path} AS path")
    symbols = l.where("k IN (2, 4)").selectExpr("review", "concat('m.f', s) AS symbol", "'src/m.py' AS path")
    edges = l.where("k IN (3, 5)").selectExpr("review", "'callee' AS side", "concat('m.f', s) AS subject", "'db.q' AS object", "CASE WHEN r = 'R' THEN 'db.q.deleteMany' ELSE 'db.q.find' END AS call")
    # Signals lie on changed files; those of the sixth line and later do not.
    signals = l.where("p % 4 = 0").selectExpr("review", "'swallowed_exception' AS family", "'x' AS symbol", f"CASE WHEN k > 5 THEN 'other.py' ELSE concat('./', {path}) END AS path")
    sections = l.where("p % 11 = 0").selectExpr("review", "'endpoints' AS section", "1 AS n")
    return hypotheses.hypotheses(reviews, files, symbols, edges, signals, sections)
