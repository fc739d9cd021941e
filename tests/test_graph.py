"""Small hand-built graphs, with ambiguity and refusal as cases of their own."""

from __future__ import annotations

import hashlib
import json
import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from graphledger.functions import exprs
from graphledger.operators import calls, diff, graph, imports, linker, metrics, reconcile, surfaces, traverse
from graphledger.sources import store


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def module(name, **more):
    return {"entity_id": name, "kind": "CodeModule", "module": name} | more


def package(key, name, **more):
    return {"entity_id": key, "kind": "ExternalPackage", "name": name} | more


def fact(ord_, predicate, s, o, **more):
    return {"fact_id": f"f{ord_}", "predicate": predicate, "subject_id": s, "object_id": o, "ord": ord_} | more


def build(spark, entities, facts, evidence=()):
    def frame(rows, schema):
        names = [p.strip().split(" ")[0] for p in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return graph.Graph.of(spark, frame(entities, graph.ENTITY), frame(facts, graph.FACT), frame(evidence, graph.EVIDENCE))


def test_path_shapes(spark):
    cases = {"/orders/:orderId": "/orders/{param}", "/orders/{orderId}": "/orders/{param}", "/orders/<int:order_id>/": "/orders/{param}", "/orders/{orderId:int}": "/orders/{param}", "/files/{*path}": "/files/{param}"}
    same = ["/files/:name.json", "https://a.b/c"]
    assert values(spark, exprs.path_shape, *cases, *same) == [*cases.values(), *same]


def test_urn_parts_are_percent_encoded(spark):
    odd = ["a b", "é*~/", "x+y", " padded "]
    assert values(spark, exprs.urn_part, *odd, " ") == [*(quote(v.strip(), safe="") for v in odd), None]


def test_stable_hash_matches_plain_digest(spark):
    want = hashlib.sha256(b"a|None|b").hexdigest()[:24]
    assert values(spark, lambda c: exprs.stable_hash(c, F.lit(None), F.lit("b")), "a") == [want]


def test_git_urls(spark):
    got = values(spark, exprs.git_url, "git+ssh://git@gitlab.com/acme/platform/shared.git", "git@github.com:acme/api.git", "https://github.com/acme/api", "github:acme/api", "nonsense")
    assert [tuple(g) if g else None for g in got] == [("gitlab.com", "acme/platform", "shared"), *[("github.com", "acme", "api")] * 3, None]


def test_queue_arns(spark):
    good, bad = "arn:aws:sqs:eu-west-1:123456789012:orders-created", ["arn:aws:sqs:eu-west-1:123456789012:a.b", "arn:aws:sqs::123456789012:q", "arn:aws:sqs:eu_west:123456789012:q"]
    assert values(spark, exprs.queue_of_arn, good, *bad) == ["orders-created", None, None, None]


def test_test_paths_and_path_forms(spark):
    assert values(spark, exprs.is_test_path, "tests/a.py", "src/test_a.py", "src/a.spec.ts", "src/latest.py") == [True, True, True, False]
    assert values(spark, exprs.loose_path, "./.env", "../a") == ["env", "a"]
    assert values(spark, exprs.strict_path, "./.env", "../a") == [".env", "../a"]


def test_domains(spark):
    assert values(spark, exprs.domain_of, "https://User@API.example.com:8080/x", "example.com/", "localhost", "10.0.0.1") == ["api.example.com", "example.com", None, None]


def test_internal_ranking_ignores_resources(spark):
    g = build(spark, [module("src.app"), module("src.api")], [fact(1, "IMPORTS", "src.app", "src.api", category="internal_module"), fact(2, "IMPORTS", "src.app", "src.api", category="relative_resource_module")])
    rows = imports.top_internal_dependencies(g).collect()
    assert [(r["module"], r["importer_count"], r["fact_count"]) for r in rows] == [("src.api", 1, 1)]


def test_top_dependencies_count_facts_and_skip_standard(spark):
    g = build(spark, [module("a"), module("b"), package("p", "requests"), package("q", "json")], [fact(1, "IMPORTS", "a", "p", category="third_party"), fact(2, "IMPORTS", "b", "p", category="other"), fact(3, "IMPORTS", "a", "q", category="stdlib"), fact(4, "IMPORTS", "zz", "p")])
    assert [tuple(r) for r in imports.top_dependencies(g).collect()] == [("requests", "third_party", 2)]


@pytest.mark.parametrize(("names", "status"), [(["x"], "resolved"), (["x", "x"], "ambiguous"), (["y"], "not_found")])
def test_import_targets_resolve_only_without_doubt(spark, names, status):
    g = build(spark, [module("a"), *(package(f"p{i}", n) for i, n in enumerate(names))], [fact(i, "IMPORTS", "a", f"p{i}") for i in range(len(names))])
    assert imports.resolve_import_target(g, "X").first()["status"] == status
    assert imports.who_imports(g, "X").count() == (1 if status == "resolved" else 0)


def symbol(key, name, **more):
    return {"entity_id": key, "kind": "CodeSymbol", "module": "m", "qualname": name} | more


def test_ambiguous_symbols_return_no_callers(spark):
    g = build(spark, [symbol("a", "f"), symbol("b", "f", module="n"), symbol("c", "g")], [fact(2, "CALLS", "c", "a"), fact(1, "CALLS", "c", "b")])
    assert calls.find_callers(g, "f").count() == 0
    assert [r["fact_id"] for r in calls.find_callers(g, "f", include_all=True).collect()] == ["f1", "f2"]
    assert [r["fact_id"] for r in calls.find_callers(g, "m.f").collect()] == ["f2"]
    assert {r["tier"] for r in calls.lookup_symbol(g, "f").collect()} == {"exact_name"}


def test_walks_match_brute_force(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    frame = spark.createDataFrame([(str(a), str(b), i) for i, (a, b) in enumerate(sorted(edges))], "src string, dst string, ord long")
    roots = spark.createDataFrame([("0",)], "root_id string")
    want, front = {"0": 0}, {"0"}
    for hop in range(1, 4):
        front = {str(b) for a, b in edges if str(a) in front} - want.keys()
        want |= dict.fromkeys(front, hop)
    assert {r["node"]: r["depth"] for r in traverse.reach(frame, roots, 3).collect()} == want
    assert {r["node"]: r["depth"] for r in traverse.reach(frame.limit(0), roots, 3).collect()} == {"0": 0}
    paths = _paths(edges, "0", "7", 4)
    typed = frame.select("src", "dst", F.lit("CALLS").alias("predicate"), F.col("dst").alias("display"), F.col("ord").cast("string").alias("fact_id"))
    got = [r["path"] for r in traverse.dependency_paths(typed, "0", "7", max_depth=4, limit=25).collect()]
    assert got == sorted(paths, key=lambda p: (p.count(">"), p))[:25]


def _paths(edges, source, target, depth):
    found, front = [], [[source]]
    for _ in range(depth):
        ahead = [[*p, str(b)] for p in front for a, b in edges if str(a) == p[-1] and str(b) not in p]
        found += [" > ".join(p) for p in ahead if p[-1] == target]
        front = [p for p in ahead if p[-1] != target]
    return found


def test_constructors_bridge_to_their_class(spark):
    g = build(spark, [symbol("c", "A"), symbol("i", "A.__init__"), symbol("o", "A", module="other")], [])
    assert [tuple(r) for r in traverse.constructor_bridges(g).collect()] == [("c", "i")]


def test_innermost_symbol_of_a_range(spark):
    g = build(spark, [symbol("outer", "A", path="src/a.py", line=1, end_line=50), symbol("inner", "A.f", path="src/a.py", line=10, end_line=20)], [])
    ranges = spark.createDataFrame([("./src/a.py", 12, 14), ("src/a.py", 40, 60), ("b.py", 1, 2)], "path string, start int, end int")
    assert {(r["start"], r["entity_id"], r["match"]) for r in calls.symbols_of_ranges(g, ranges).collect()} == {(12, "inner", "enclosing"), (40, "outer", "overlapping")}


def test_channels_without_direction_are_demoted(spark):
    facts = spark.createDataFrame([("a", "REFERENCES_EVENT_CHANNEL"), ("b", "REFERENCES_EVENT_CHANNEL"), ("b", "PRODUCES_EVENT"), ("c", "REFERENCES_EVENT_CHANNEL")], "channel string, predicate string")
    channels = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "channel string, has_literal boolean")
    assert {r["channel"]: r["status"] for r in diff.demote_channels(channels, facts).collect()} == {"a": "candidate", "b": "canonical", "c": "canonical"}


def test_row_diff_counts(spark):
    base = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    head = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert tuple(diff.diff_counts(base, head, "k", "v").first()) == (1, 1, 1)
    assert {(r["k"], r["change"]) for r in diff.row_diff(base, head, "k", "v").collect()} == {("a", "removed"), ("c", "added")}


def test_suffix_links_refuse_ambiguity(spark):
    targets = spark.createDataFrame([("t", "/home/ubuntu/api/api/wsgi.py"), ("u", "/srv/app/wsgi.py"), ("v", "/x/wsgi.py")], "target string, path string")
    modules = spark.createDataFrame([("one", "api/wsgi.py"), ("two", "app/wsgi.py"), ("three", "app/wsgi.py"), ("four", "wsgi.py")], "service string, path string")
    got = {(r["target"], r["service"], r["status"]) for r in linker.suffix_links(targets, modules).collect()}
    assert got == {("t", "one", "canonical"), ("u", "two", "candidate"), ("u", "three", "candidate")}


def test_ambiguous_packages_link_for_nobody(spark):
    consumers = spark.createDataFrame([("r1", "Foo_Bar"), ("r2", "foo.bar"), ("r1", "solo")], "repo string, package string")
    providers = spark.createDataFrame([("p1", ["foo-bar"]), ("p2", ["foo--bar"]), ("p1", ["solo"])], "repo string, names array<string>")
    assert [tuple(r) for r in linker.link_packages(consumers, providers).collect()] == [("r1", "solo", "p1")]
    assert {r["key"]: r["bucket"] for r in linker.classify_packages(consumers, providers).collect()} == {"foo-bar": "ambiguous", "solo": "internal"}


def test_selectors_need_all_pairs(spark):
    s = spark.createDataFrame([("s", "n", {"a": "1", "b": "2"}), ("none", "n", {})], "service string, namespace string, selector map<string,string>")
    w = spark.createDataFrame([("w", "n", {"a": "1", "b": "2", "c": "3"}), ("x", "n", {"a": "1"}), ("y", "m", {"a": "1", "b": "2"})], "workload string, namespace string, labels map<string,string>")
    assert [(r["service"], r["workload"]) for r in linker.select_workloads(s, w).collect()] == [("s", "w")]


def test_selectors_in_any_number_and_with_nulls(spark):
    schema = "string, namespace string, selector map<string,string>"
    s = spark.createDataFrame([("s", "n", {"a": "1"}), ("s", "n", {"b": "2"}), ("s", "n", {"b": "2"}), ("s", None, {"a": "1"}), ("t", "n", {"a": None}), (None, "n", {"b": "2"})], f"service {schema}")
    w = spark.createDataFrame([("w", "n", {"b": "2", "a": "1"}), ("w", "n", {"a": "1", "c": None}), ("x", "n", {"a": None}), ("y", None, {"a": "1"}), (None, "n", {"a": "1"}), ("z", "n", None)], "workload string, namespace string, labels map<string,string>")
    assert sorted((r["service"] or "", r["workload"] or "") for r in linker.select_workloads(s, w).collect()) == [("", "w"), ("s", ""), ("s", "w")]


def test_pairs_of_selectors_are_never_shuffled(spark):
    """Three million pairs, most of them of one key; an exchange sees names and chunks of them alone."""
    s = spark.range(1000).selectExpr("concat('s', id) AS service", "if(id < 990, 'n', 'm') AS namespace", "map('a', '1') AS selector")
    w = spark.range(6000).selectExpr("concat('w', id) AS workload", "if(id % 2 = 0, 'n', 'm') AS namespace", "map('a', '1', 'b', cast(id % 2 AS string)) AS labels")
    got = linker.select_workloads(s, w)
    got = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("service", "workload", "namespace").alias("k")).collect()
    total = 990 * 3000 + 10 * 3000
    assert sum(r["n"] for r in got) == sum(r["k"] for r in got) == total
    assert max(r["n"] for r in got) < total * 0.6
    plan = linker.select_workloads(s, w)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition") and "Aggregate" not in plan[: plan.index("Repartition")]


def test_endpoint_without_method_matches_nothing(spark):
    ends = [{"entity_id": f"e{i}", "kind": "Endpoint", "path": p} for i, p in enumerate(["/a/{id}", "/a/:x", "/a/<y>"])]
    services = [{"entity_id": s, "kind": "Service", "name": s} for s in ("p", "c", "d")]
    g = build(spark, [*ends, *services], [fact(1, "EXPOSES_ENDPOINT", "p", "e0", method="GET"), fact(2, "CALLS_ENDPOINT", "c", "e1", method="get"), fact(3, "CALLS_ENDPOINT", "d", "e2")])
    assert [(r["provider"], r["consumer"]) for r in surfaces.endpoint_consumers(g).collect()] == [("p", "c")]


def test_reconcile_and_close_matches(spark):
    left = spark.createDataFrame([("/orders",), ("/v3/invoices",), ("/a",)], "key string")
    right = spark.createDataFrame([("/orders",), ("/invoices",), ("/very-long-endpoint",)], "key string")
    assert {r["key"]: r["status"] for r in reconcile.reconcile(left, right).collect()} == {"/orders": "matched", "/v3/invoices": "left_only", "/a": "left_only", "/invoices": "right_only", "/very-long-endpoint": "right_only"}
    assert [(a, b) for a, b, _ in reconcile.possible_matches(left.where("key <> '/orders'"), right.where("key <> '/orders'"))] == [("/v3/invoices", "/invoices")]


def test_metrics_closed_forms(spark):
    facts = spark.createDataFrame([("a", "canonical"), ("b", None)], "fact_id string, canonical_status string")
    evidence = spark.createDataFrame([("a", "authoritative_declared", "x.py", 1, 2), ("b", "inferred_llm", None, 1, 2)], "target_id string, derivation_class string, path string, line_start int, line_end int")
    assert metrics.grounding(facts, evidence).first()[0] == 0.5
    assert metrics.trust_mix(facts, evidence).first()[0] == (1.0 + 0.35) / 2
    assert metrics.grounding(facts.limit(0), evidence).first()[0] is None


def test_store_round_trip_keeps_first_rows(spark, tmp_path):
    path = tmp_path / "entities.jsonl"
    path.write_text('{"entity_id": "a", "kind": "Repo", "name": "one"}\n\n{"entity_id": "a", "kind": "Repo", "name": "two"}\n')
    rows = store.read_jsonl(spark, str(path), graph.ENTITY)
    empty = {n: spark.createDataFrame([], graph.SCHEMAS[n]) for n in ("facts", "evidence", "coverage")}
    store.write_tables({"entities": rows, **empty}, str(tmp_path / "graph"))
    assert [r["name"] for r in store.read_graph(spark, str(tmp_path / "graph")).entities.collect()] == ["one"]


def test_every_query_has_columns_like_its_oracle(spark):
    from graphledger.plans import catalog

    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_members_of_deep_hierarchies(spark):
    bases = spark.createDataFrame([*((f"c{i}", f"c{i + 1}") for i in range(11)), ("c11", "c10")], "class_id string, base_id string")
    members = spark.createDataFrame([("c11", "far"), ("c0", "near")], "class_id string, member string")
    got = {tuple(r) for r in traverse.transitive_members(bases, members).collect()}
    assert got == {("c0", "near"), *((f"c{i}", "far") for i in range(12))}


def test_jsonl_is_numbered_in_input_order(spark, tmp_path):
    """A short file read before a long one, which is read in several splits."""
    schema = "entity_id string, ord long"
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"entity_id": f"a{i:06}"}) + "\n" for i in range(10)))
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"entity_id": f"b{i:06}"}) + "\n\n" for i in range(20_000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = store.read_jsonl(spark, f"file://{tmp_path}", schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [r["entity_id"] for r in sorted(rows, key=lambda r: r["ord"])] == sorted(r["entity_id"] for r in rows) and len(rows) == 20_010
    assert store.read_jsonl_if_exists(spark, f"file://{tmp_path}/none", schema).count() == 0


def test_publish_is_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    table = lambda n: {"coverage": spark.createDataFrame([(f"c{i}", i) for i in range(n)], "coverage_id string, ord long")}
    store.publish(spark, table(3), path)
    store.publish(spark, table(5), path)
    assert spark.read.parquet(f"{path}/coverage").count() == 5
    with pytest.raises(Exception):
        store.publish(spark, {**table(7), "facts": spark.createDataFrame([(1,)], "x int")}, path)
    assert spark.read.parquet(f"{path}/coverage").count() == 5 and [p.name for p in tmp_path.iterdir()] == ["snapshot"]


def test_best_match_of_equal_ones_is_the_last_by_name(spark):
    side = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    found = reconcile.possible_matches(side("/orders/a", "/orders/b"), side("/orders/x", "/orders/y", "/other"))
    assert found == [("/orders/a", "/orders/y", 0.889), ("/orders/b", "/orders/x", 0.889)]


def test_opportunities_meet_evidence_and_coverage_of_their_own_scope(spark):
    columns = "predicate string, path string, repo string, language string"
    o = spark.createDataFrame([(1, 5, "CALLS", "a.py", "r1", "python"), (2, 5, "CALLS", "a.py", "r2", "python")], f"id int, line int, {columns}")
    e = spark.createDataFrame([("CALLS", "a.py", "r1", "python", 1, 9)], f"{columns}, line_start int, line_end int")
    c = spark.createDataFrame([("CALLS", "a.py", "r1", "go")], columns)
    row = metrics.opportunity(o, e, c).first()
    assert (row["opportunity"], row["silent_gap"]) == (0.5, 0.5)


def test_moves_stay_in_a_repository(spark):
    edges = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, repo string")
    moved = diff.responsibility_moved(edges(("x", "z", "r1"), ("v", "w", "r1")), edges(("y", "z", "r1"), ("u", "w", "r2")))
    assert [tuple(r) for r in moved.select("dst", "repo", "lost", "won").collect()] == [("z", "r1", 1, 1)]


def test_snapshot_diff_ignores_places_and_ids(spark):
    side = lambda i, line, *more: graph.Graph.of(
        spark,
        spark.createDataFrame([(f"e{i}", "urn:a", "Repo", "t"), (f"f{i}", f"urn:{i}", "Domain", "t")], "entity_id string, urn string, kind string, tenant_id string"),
        spark.createDataFrame([(f"x{i}", "CALLS", "a", "b", f'{{"line":{line},"b":[1],"a":"q"}}'), *more], "fact_id string, predicate string, subject_id string, object_id string, qualifier string"),
    )
    base, head = side(1, 5), side(2, 9, ("y", "CALLS", "a", "b", None))
    rows = {(r["section"], r["name"], r["change"], r["key"]) for r in diff.snapshot_diff(base, head).collect()}
    assert rows == {("entity", "Domain", "removed", "urn:1"), ("entity", "Domain", "added", "urn:2"), ("fact", "CALLS", "added", "a|b|{}")}
    diff.one_tenant(base, head)
    with pytest.raises(ValueError):
        diff.one_tenant(base, graph.Graph.of(spark, base.entities.withColumn("tenant_id", F.lit("u")), base.facts))


def test_impact_of_each_root_and_bridges(spark):
    edges = spark.createDataFrame([("x", "A"), ("y", "x"), ("z", "y"), ("A", "x")], "src string, dst string")
    roots = spark.createDataFrame([("i",), ("x",)], "root_id string")
    bridges = spark.createDataFrame([("A", "i")], "src string, dst string")
    got = {tuple(r) for r in traverse.reverse_impact_by_root(edges, roots, 2, bridges).collect()}
    assert got == {("i", "A", 1, None), ("i", "x", 2, "max_depth_reached"), ("x", "y", 1, None), ("x", "A", 1, None), ("x", "z", 2, "no_callers")}
