"""Extractors: what they find, what they leave alone, and what they report as a gap."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from graphledger.functions import exprs
from graphledger.operators import build, calls, extract, graph
from graphledger.sources import store
from graphledger.streaming import ingest

PY = '''
import os, json as j
from . import sibling
from flask import Flask
app = Flask(__name__)

class Base: pass

class A(Base):
    def f(self):
        return self.g(os.environ["TOKEN"])
    def g(self, x):
        try:
            return j.dumps(x)
        except Exception:
            pass

@app.route("/a/<int:i>", methods=["GET", "post"])
def view():
    return A()
'''


def facts(path, text):
    return {(p, s, o) for tag, p, _, s, o, *_ in extract.findings_of(path, text) if tag == "fact"}


def gaps(path, text):
    return {o for tag, _, _, _, o, *_ in extract.findings_of(path, text) if tag == "coverage"}


def test_python_golden():
    got = facts("src/m.py", PY)
    assert {("IMPORTS", "src.m", "os"), ("IMPORTS", "src.m", "json"), ("IMPORTS", "src.m", "src"), ("IMPORTS", "src.m", "flask")} <= got
    assert {("IMPLEMENTS", "src.m.A", "src.m.Base"), ("CALLS", "src.m.A.f", "src.m.A.g"), ("CALLS", "src.m.A.g", "json.dumps"), ("CALLS", "src.m.view", "src.m.A"), ("CALLS", "src.m", "flask.Flask")} <= got
    assert {("EXPOSES_ENDPOINT", "src.m.view", "GET /a/<int:i>"), ("EXPOSES_ENDPOINT", "src.m.view", "POST /a/<int:i>"), ("REFERENCES_ENV_VAR", "src.m.A.f", "TOKEN"), ("code_risk_signal", "src.m", "swallowed_exception")} <= got
    assert gaps("src/m.py", "def (") == {"python_parse_error"}


def test_dotenv_golden_and_false_positive():
    text = "# A=1\nexport API=\"https://u@api.example.com:1/x\" # c\nHOST = example.org # c\nN=5\nbad-key=1\n"
    assert facts(".env", text) == {("REFERENCES_ENV_VAR", "", "API"), ("REFERENCES_ENV_VAR", "", "HOST"), ("REFERENCES_ENV_VAR", "", "N"), ("REFERENCES_DOMAIN", "", "api.example.com"), ("REFERENCES_DOMAIN", "", "example.org")}
    assert extract.findings_of("notes.txt", text) == []


def test_cname_and_proto():
    assert facts("docs/CNAME", "docs.Example.com\n# x.y\nhttp://a.b\n") == {("REFERENCES_DOMAIN", "", "docs.example.com")}
    text = 'package a.b; // rpc No(\nservice S { rpc Get (X) returns (Y) { option x = "rpc Fake("; } rpc Put(X) returns (Y); }'
    assert facts("s.proto", text) == {("EXPOSES_ENDPOINT", "", "GRPC /a.b.S/Get"), ("EXPOSES_ENDPOINT", "", "GRPC /a.b.S/Put")}
    assert gaps("s.proto", "service S { rpc A(") == {"proto_parse_error"}


def test_openapi_and_manifests():
    doc = json.dumps({"openapi": "3.0.0", "paths": {"/a": {"get": {}, "x-note": 1}}})
    assert facts("api.json", doc) == {("DOCUMENTS_ENDPOINT", "", "ANY /a"), ("DOCUMENTS_ENDPOINT", "", "GET /a")}
    assert extract.findings_of("other.json", "{") == [] and gaps("openapi.json", "{") == {"openapi_parse_error"}
    assert {o for _, _, o in facts("requirements-dev.txt", "a==1\n# c\n-r x\nb_c>=2; python_version>'3'\n")} == {"a", "b_c"}
    assert {o for _, _, o in facts("pyproject.toml", '[project]\ndependencies=["x[y]>=1"]')} == {"x"}
    assert {o for _, _, o in facts("package.json", '{"dependencies": {"@a/b": "1"}}')} == {"@a/b"}


K8S = """
apiVersion: apps/v1
kind: Deployment
metadata: {name: orders-api}
spec: {template: {metadata: {labels: {app: orders-api, tier: web}}}}
---
apiVersion: v1
kind: Service
metadata: {name: orders-service}
spec: {selector: {app: orders-api}}
---
apiVersion: networking.k8s.io/v1
kind: Ingress
metadata: {name: in}
spec: {rules: [{host: orders.example.com, http: {paths: [{backend: {service: {name: orders-service}}}, {backend: {service: {name: other}}}]}}]}
"""


def test_kubernetes_golden():
    target = "kubernetes_deployment:default/orders-api"
    assert facts("k8s/a.yaml", K8S) == {("DEPLOYS_VIA_CONFIG", "", target), ("REFERENCES_DOMAIN", "", "orders.example.com"), ("ROUTES_DOMAIN_TO_DEPLOY", "orders.example.com", target)}
    assert facts("a.yaml", "a: 1\n") == set() and gaps("a.yaml", "kind: x\napiVersion: [") == {"kubernetes_failed:ValueError"}


def test_deployment_files():
    arn = "arn:aws:sqs:eu-west-1:123456789012:orders-created"
    sls = "functions:\n  ws: {events: [{websocket: {route: $connect}}]}\n  api: {events: [{http: {path: /orders, method: post}}]}\n"
    assert facts("serverless.yml", sls) == {("EXPOSES_ENDPOINT", "ws", "WEBSOCKET $connect"), ("CONSUMES_EVENT", "ws", "websocket:$connect"), ("EXPOSES_ENDPOINT", "api", "POST /orders")}
    got = facts("zappa_settings.json", json.dumps({"prod": {"app_function": "m.app", "events": [{"function": "h.c", "event_source": {"arn": arn}}]}}))
    assert got == {("DEPLOYS_VIA_CONFIG", "", "zappa_lambda:prod:m.app"), ("CONSUMES_EVENT", "h.c", "sqs:orders-created"), ("REFERENCES_EVENT_CHANNEL", "", "sqs:orders-created")}
    vhost = "<VirtualHost *:80>\n ServerName api.example.com # x\n WSGIScriptAlias / /srv/app/wsgi.py\n</VirtualHost>\n<VirtualHost *>\n ServerName no.example.com\n</VirtualHost>"
    assert facts("site.conf", vhost) == {("REFERENCES_DOMAIN", "", "api.example.com"), ("ROUTES_DOMAIN_TO_DEPLOY", "api.example.com", "wsgi:/srv/app/wsgi.py")}
    assert facts("main.tf", 'resource "r" "x" {\n name = "a.example.com"\n # name = "b.example.com"\n}') == {("REFERENCES_DOMAIN", "", "a.example.com")}


def test_channels():
    text = "a: arn:aws:sqs:us-east-1:123456789012:q.fifo\nb: https://sqs.us-east-1.amazonaws.com/123456789012/pay\nc: arn:aws:sns:us-east-1:123456789012:t\nd: arn:aws:sqs:us-east-1:123456789012:bad.name\n"
    assert {o for _, _, o in facts("app.yml", text)} == {"sqs:q.fifo", "sqs:pay", "sns:t"}
    assert {o for _, _, o in facts("prod.ini", "[m]\nemail_queue = email-created\nx = y\n")} == {"sqs:email-created"}


def test_gaps_are_reported():
    assert gaps("a.ts", "x") == {"typescript_parser_unavailable"} and gaps("a.go", "x") == {"unsupported_language"}
    assert gaps("a.py", "x" * (extract.LARGEST + 1)) == {"file_too_large"}


def test_extract_and_classify(spark):
    files = spark.createDataFrame([("r", "src/m.py", PY), ("r", "src/__init__.py", ""), ("r", "requirements.txt", "Flask>=1")], "repo string, path string, content string")
    rows = extract.classify_imports(extract.extract(files)).collect()
    assert {(r["object"], r["category"]) for r in rows} == {("os", "stdlib"), ("json", "stdlib"), ("src", "internal_module"), ("flask", "third_party")}


def test_read_files_skips_ignored_folders(spark, tmp_path):
    (tmp_path / "repo" / "node_modules").mkdir(parents=True)
    (tmp_path / "repo" / "a.py").write_text("x = 1")
    (tmp_path / "repo" / "node_modules" / "b.py").write_text("x = 1")
    assert [(r["path"], r["content"]) for r in extract.read_files(spark, str(tmp_path / "repo"), "r").collect()] == [("a.py", "x = 1")]


def test_stream_takes_each_id_once(spark, tmp_path):
    source, rows = tmp_path / "in", [{"evidence_id": "a", "ingested_at": "2024-01-01T00:00:00Z"}, {"evidence_id": "a", "ingested_at": "2024-01-01T00:01:00Z"}, {"evidence_id": "b", "ingested_at": "2024-01-01T00:02:00Z"}]
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.evidence_once(ingest.read_stream(spark, "evidence", str(source)))
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["evidence_id"] for r in spark.read.schema(graph.EVIDENCE).parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_routes_need_an_application_or_router():
    code = """
from unittest import mock
from fastapi import APIRouter, FastAPI
import flask
app, cache = FastAPI(), make_cache()
api = APIRouter(prefix="/v1")
odd = APIRouter(prefix=PREFIX)
site: flask.Blueprint = flask.Blueprint("site", __name__, url_prefix="/s")
app = FastAPI()

@mock.patch("pkg.mod.fn")
@cache.get("k")
def no(): ...

@app.get("/a")
def a(): ...

@api.post("/b")
def b(): ...

@odd.get("/c")
def c(): ...

@app.trace("/d")
def d(): ...

@site.route("/e", methods=["PUT"])
def e(): ...
"""
    routes = [f[4] for f in extract.python("m.py", code) if f[1] == "EXPOSES_ENDPOINT"]
    assert routes == ["GET /a", "POST /v1/b", "PUT /e"]


def _python_hash(*parts) -> str:
    text = "|".join(json.dumps(p, sort_keys=True, separators=(",", ":")) if isinstance(p, dict) else str(p) for p in parts)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def test_canonical_json_is_that_of_the_ids(spark):
    rows = ["plain", "é­\U0001f600", 'q"\\u00E9 \\\\u00C9\\', "tab\t\x01/\x7f", None]
    frame = spark.createDataFrame([(r,) for r in rows], "v string")
    got = [r[0] for r in frame.select(exprs.canonical_json({"b": F.col("v"), "a": F.lit(1)})).collect()]
    assert got == [json.dumps({"a": 1, "b": r}, separators=(",", ":"), sort_keys=True) for r in rows]


def test_graph_from_files(spark, tmp_path):
    other = "from src.m import A, view\nimport requests\n\nasync def go():\n    A()\n    print(requests.get('x'), view())\n"
    rows = [("r", "src/m.py", PY), ("r", "src/n.py", other), ("r", "src/__init__.py", ""), ("r", ".env", "HOST=é.example.org\nAPI=api.example.com\n"), ("r", "a.go", "x"), ("r", "none.py", None), ("other", "a.py", "x = 1")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    repos = spark.createDataFrame([("r", "acme", "c0ffee"), ("empty", None, None)], "repo string, owner string, commit_sha string")
    tables = build.build(files, repos)
    store.publish(spark, tables, f"file://{tmp_path}/graph")
    g = store.read_graph(spark, f"file://{tmp_path}/graph")
    edges = {(r["predicate"], r["s_display"], r["o_display"]) for r in g.edges().collect()}
    assert {("CALLS", "src.n.go", "src.m.A"), ("CALLS", "src.n.go", "src.m.view"), ("CALLS", "src.n.go", "requests"), ("CALLS", "src.n.go", "builtins.print"), ("IMPORTS", "src.n", "src.m"), ("IMPORTS", "src.n", "requests")} <= edges
    assert {("DEFINED_IN", "src.m.A.f", "src.m"), ("DEFINED_IN", "src.m", "r"), ("IMPLEMENTS", "src.m", "r"), ("IMPLEMENTS", "src.m.A", "src.m.Base"), ("EXPOSES_ENDPOINT", "src.m.view", "GET /a/<int:i>"), ("REFERENCES_DOMAIN", "r", "api.example.com"), ("REFERENCES_ENV_VAR", "r", "HOST")} <= edges
    assert not any("requests.get" in e for e in edges)
    entities = {r["urn"]: r for r in g.entities.collect()}
    identity = {"tenant_id": "default", "repo": "r", "module": "src.n", "qualname": "go", "symbol_kind": "async_function"}
    go = entities["graph://code-symbol/default/r/src.n/go/async_function"]
    assert go["entity_id"] == "ent_" + _python_hash("CodeSymbol", identity) and (go["path"], go["line"], go["end_line"]) == ("src/n.py", 4, 6)
    route = {"tenant_id": "default", "repo": "r", "protocol": "http", "method": "POST", "path": "/a/<int:i>", "host": None}
    assert entities["graph://endpoint/default/r/http/POST/_/%2Fa%2F%3Cint%3Ai%3E"]["entity_id"] == "ent_" + _python_hash("Endpoint", route)
    owner = {"tenant_id": "default", "host": "local", "owner": None, "name": "empty"}
    assert entities[f"graph://repo/{_python_hash(owner)}"]["entity_id"] == "ent_" + _python_hash("Repo", owner)
    facts = {r["fact_id"]: r for r in g.facts.collect()}
    assert all(i == "fact_" + _python_hash(r["predicate"], r["subject_id"], r["object_id"], json.loads(r["qualifier"])) for i, r in facts.items())
    evidence = g.evidence.collect()
    assert {r["target_id"] for r in evidence} == facts.keys() | {r["fact_id"] for r in tables["support_facts"].collect()}
    assert {(r["path"], r["reason"]) for r in g.coverage.collect()} == {("a.go", "unsupported_language"), ("none.py", "file_unreadable")}
    assert [r["qualifier"] for r in tables["support_facts"].collect()] == ['{"family":"swallowed_exception"}']
    assert {r["name"]: r["n"] for r in build.manifest(tables).collect()}["facts"] == len(facts)
    found = calls.find_callers(g, "src.m.view")
    assert [r["caller"] for r in found.collect()] == ["src.n.go"]


def test_graph_of_no_files(spark):
    empty = spark.createDataFrame([], "repo string, path string, content string")
    tables = build.build(empty, spark.createDataFrame([], "repo string, owner string, commit_sha string"))
    assert {r["name"]: r["n"] for r in build.manifest(tables).collect()} == dict.fromkeys(tables, 0)
