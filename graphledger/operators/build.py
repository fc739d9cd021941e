"""A graph's tables from files: findings get ends, ends get identities, and every row says where it was seen.

All of it is joins and expressions; only the reading of files is Python. Names
are resolved within a repository: to its symbols, then its modules, then
builtins, and what is left belongs to the package that its first part names.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphledger.functions.exprs import canonical_json, endpoint_path, stable_hash, urn
from graphledger.operators import extract
from graphledger.operators.graph import COVERAGE, ENTITY, EVIDENCE, FACT, conform, first_wins
from graphledger.sources.session import settled

# Fixed values that results depend on: what identifies an entity of each kind, and its place in the URN.
IDENTITY = {
    "Repo": ("repo", ("tenant_id", "host", "owner", "name")),
    "Service": ("service", ("tenant_id", "namespace", "repo", "slug")),
    "CodeModule": ("code-module", ("tenant_id", "repo", "module")),
    "CodeSymbol": ("code-symbol", ("tenant_id", "repo", "module", "qualname", "symbol_kind")),
    "ExternalPackage": ("external-package", ("tenant_id", "repo", "name")),
    "ExternalSymbol": ("external-symbol", ("tenant_id", "repo", "language", "module", "name", "symbol_kind")),
    "Endpoint": ("endpoint", ("tenant_id", "repo", "protocol", "method", "host", "path")),
    "Domain": ("domain", ("tenant_id", "repo", "name")),
    "EnvVar": ("env-var", ("tenant_id", "repo", "name")),
    "EventChannel": ("event-channel", ("tenant_id", "broker_kind", "channel_address")),
    "DeployTarget": ("deploy-target", ("tenant_id", "repo", "type", "target")),
}
#: Predicates of findings that support reviews and are no edges of the graph.
SUPPORT = ("code_risk_signal",)

_FIELDS = ("kind", *sorted({f for _, fields in IDENTITY.values() for f in fields}), "line", "end_line")


def _end(kind: str | Column, **fields: Column | str) -> Column:
    """One end of a fact: a struct of the same fields for every kind."""
    known = {"kind": kind, **fields}
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(as_column(known.get(f)).cast("int" if f in ("line", "end_line") else "string").alias(f) for f in _FIELDS))


def _by_kind(end: str, make) -> Column:
    out = F.lit(None).cast("string")
    for kind, (slug, fields) in IDENTITY.items():
        out = F.when(F.col(f"{end}.kind") == kind, make(kind, slug, {f: F.col(f"{end}.{f}") for f in fields})).otherwise(out)
    return out


def entity_id(end: str) -> Column:
    """The id of an end: a digest of its kind and identity."""
    return F.concat(F.lit("ent_"), _by_kind(end, lambda kind, _, fields: stable_hash(F.lit(kind), canonical_json(fields))))


def entity_urn(end: str, scheme: str) -> Column:
    """The URN of an end; an endpoint without a host has a _ there."""

    def one(kind: str, slug: str, fields: dict[str, Column]) -> Column:
        shown = fields | ({"host": F.coalesce(fields["host"], F.lit("_"))} if kind == "Endpoint" else {})
        # Where a field is missing, endpoints fall back to their kind, others to their slug.
        return urn(scheme, slug, stable_hash(canonical_json(fields)), *shown.values())

    return _by_kind(end, one)


def _resolved(rows: DataFrame, name: str, defined: DataFrame, out: str) -> DataFrame:
    """Adds what a dotted name is in its repository, as an end or null."""
    known = defined.select("repo", F.col("dotted").alias(name), F.col("end").alias(out))
    return rows.join(known, ["repo", name], "left")


def _definitions(facts: DataFrame, tenant: str) -> DataFrame:
    """Symbols and modules of repositories: repo, dotted, end. A name defined twice counts as its first definition."""
    rows = facts.where("predicate = 'DEFINED_IN'")
    short = F.expr("substring(subject, length(object) + 2)")
    symbol = _end("CodeSymbol", tenant_id=tenant, repo=F.col("repo"), module=F.col("object"), qualname=short, symbol_kind=F.col("detail"), path=F.col("path"), line=F.col("line"), end_line=F.col("end_line"))
    module = _end("CodeModule", tenant_id=tenant, repo=F.col("repo"), module=F.col("subject"), path=F.col("path"), line=F.lit(None), end_line=F.lit(None))
    rows = rows.select("repo", F.col("subject").alias("dotted"), F.when(F.col("kind") == "CodeSymbol", symbol).otherwise(module).alias("end"), "path", "place")
    first = F.min_by("end", F.struct((F.col("end.kind") == "CodeModule").alias("module"), "path", "place"))
    return rows.groupBy("repo", "dotted").agg(first.alias("end"))


def edges_of(findings: DataFrame, repos: DataFrame, tenant: str = "default") -> DataFrame:
    """Facts with both ends as structs: predicate, subject_end, object_end, qualifier, and where each was seen.

    Findings are what `extract` gives; repos: repo, owner, commit_sha, one row each. A finding without a subject of
    its own speaks for the repository's service. Findings of repositories that are not in `repos` drop out.
    """
    facts = findings.where("tag = 'fact' AND predicate <> 'DEPENDS_ON'").select(*findings.columns)
    defined = _definitions(facts, tenant)
    at = facts.join(repos.select("repo", "owner", "commit_sha"), "repo")
    at = _resolved(at, "subject", defined, "subject_known")
    at = _resolved(at, "object", defined, "object_known")
    categories = extract.classify_imports(findings).select("repo", "path", "object", "category").distinct()
    at = at.join(categories.withColumn("predicate", F.lit("IMPORTS")), ["repo", "path", "object", "predicate"], "left")

    repo, obj = F.col("repo"), F.col("object")
    here = {"tenant_id": F.lit(tenant), "repo": repo}
    service = _end("Service", namespace="default", slug=repo, **here)
    root = F.split(obj, "[.]")[0]
    head, tail = F.substring_index(obj, ":", 1), F.expr("substring(object, instr(object, ':') + 1)")
    verb, route = F.substring_index(obj, " ", 1), F.expr("substring(object, instr(object, ' ') + 1)")
    protocol = F.when(verb == "GRPC", "grpc").when(verb == "WEBSOCKET", "websocket").otherwise("http")
    package = _end("ExternalPackage", name=root, **here)
    builtin = _end("ExternalSymbol", language="python", module="builtins", name=obj, symbol_kind="builtin", **here)
    named = F.coalesce(F.col("object_known"), F.when(obj.isin(*(n for n in dir(builtins) if not n.startswith("_"))), builtin).otherwise(package))
    is_internal = F.col("category").isin("internal_module", "relative_internal_module")
    subject = (
        F.when(F.col("predicate") == "ROUTES_DOMAIN_TO_DEPLOY", _end("Domain", name=F.lower("subject"), **here))
        .when(F.col("subject_known").isNotNull(), F.col("subject_known"))
        .otherwise(service)
    )
    target = (
        F.when(F.col("predicate") == "IMPORTS", F.when(is_internal, F.col("object_known")).otherwise(package))
        .when(F.col("kind") == "CodeSymbol", named)
        .when(F.col("kind") == "CodeModule", F.coalesce(F.col("subject_known"), service))
        .when(F.col("kind") == "Endpoint", _end("Endpoint", protocol=protocol, method=F.when(verb == "GRPC", "POST").otherwise(verb), path=F.when(protocol == "http", endpoint_path(route)).otherwise(route), **here))
        .when(F.col("kind") == "Domain", _end("Domain", name=F.lower(obj), **here))
        .when(F.col("kind") == "EnvVar", _end("EnvVar", name=obj, **here))
        .when(F.col("kind") == "EventChannel", _end("EventChannel", tenant_id=F.lit(tenant), broker_kind=head, channel_address=tail))
        .when(F.col("kind") == "DeployTarget", _end("DeployTarget", type=head, target=tail, **here))
    )
    imported = canonical_json({"category": F.col("category"), "import_root": root, "raw_import": obj})
    signal = canonical_json({"family": obj})
    qualifier = F.when(F.col("predicate") == "IMPORTS", imported).when(F.col("predicate").isin(*SUPPORT), signal).otherwise("{}")
    seen = ["repo", "owner", "commit_sha", "path", "line", "end_line", "place", "category"]
    names = F.when(F.col("predicate") == "IMPORTS", F.filter(F.split(F.coalesce("detail", F.lit("")), ","), lambda n: n != ""))
    columns = [*seen, "predicate", subject.alias("subject_end"), "object_end", qualifier.alias("qualifier"), F.when(F.col("predicate") == "IMPORTS", root).alias("import_root"), names.alias("imported_names")]
    # A module belongs to its repository and makes up its service.
    own_repo = _end("Repo", tenant_id=tenant, host="local", owner=F.col("owner"), name=repo)
    modules = at.where("predicate = 'DEFINED_IN' AND kind = 'CodeModule'")
    ends = F.explode(F.array(F.struct(F.lit("DEFINED_IN").alias("p"), own_repo.alias("e")), F.struct(F.lit("IMPLEMENTS").alias("p"), service.alias("e"))))
    modules = modules.withColumn("both_", ends).withColumn("predicate", F.col("both_.p")).withColumn("object_end", F.col("both_.e"))
    others = at.where("NOT (predicate = 'DEFINED_IN' AND kind = 'CodeModule')").withColumn("object_end", target)
    rows = modules.select(*columns).unionByName(others.select(*columns)).where("object_end IS NOT NULL")
    return rows.withColumn("subject_id", entity_id("subject_end")).withColumn("object_id", entity_id("object_end")).withColumn("fact_id", F.concat(F.lit("fact_"), stable_hash(F.col("predicate"), F.col("subject_id"), F.col("object_id"), F.col("qualifier"))))


def tables_of(findings: DataFrame, repos: DataFrame, tenant: str = "default", scheme: str = "graph", source: str = "extract") -> dict[str, DataFrame]:
    """The five tables of a graph, ids once each, in order of repository, path and place in the file."""
    order = ["repo", "path", "place", "predicate"]
    edges = settled(edges_of(findings, repos, tenant).orderBy(*order).withColumn("ord", F.monotonically_increasing_id()))
    sides = [edges.select(F.col(f"{side}_id").alias("entity_id"), entity_urn(f"{side}_end", scheme).alias("urn"), f"{side}_end.*", "ord") for side in ("subject", "object")]
    own = repos.select(_end("Repo", tenant_id=tenant, host="local", owner=F.col("owner"), name=F.col("repo")).alias("e"))
    own = own.select(entity_id("e").alias("entity_id"), entity_urn("e", scheme).alias("urn"), "e.*", F.lit(-1).cast("long").alias("ord"))
    entities = first_wins(conform(sides[0].unionByName(sides[1]).unionByName(own), ENTITY), "entity_id")
    is_support = F.col("predicate").isin(*SUPPORT)
    every = edges.withColumn("canonical_status", F.lit("canonical"))
    facts = lambda rows: first_wins(conform(rows.drop("path"), FACT), "fact_id")
    ref = canonical_json({"extractor": F.lit(source), "predicate": F.col("predicate")})
    place = canonical_json({"repo": F.col("repo"), "commit_sha": F.col("commit_sha"), "path": F.col("path"), "line_start": F.col("line"), "line_end": F.col("end_line")})
    evidence = edges.select(
        F.concat(F.lit("ev_"), stable_hash(F.lit("fact"), F.col("fact_id"), F.lit(source), ref, place)).alias("evidence_id"), F.lit("fact").alias("target_type"), F.col("fact_id").alias("target_id"),
        F.lit("deterministic_static").alias("derivation_class"), F.lit(source).alias("source_system"), "repo", "commit_sha", "path", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"), F.lit(1.0).alias("confidence"), "ord",
    )
    gaps = findings.where("tag = 'coverage'").join(repos.select("repo"), "repo", "left_semi")
    scope = canonical_json({"repo": F.col("repo"), "path": F.col("path"), "reason": F.col("object")})
    coverage = gaps.select(
        F.concat(F.lit("cov_"), stable_hash(F.lit(tenant), F.lit("*"), scope, F.lit(source))).alias("coverage_id"), F.lit(tenant).alias("tenant_id"), F.lit("*").alias("predicate"), F.lit("uninstrumented").alias("state"),
        F.lit(source).alias("source_system"), "repo", F.col("object").alias("reason"), "path", F.col("place").cast("long").alias("ord"),
    )
    return {
        "entities": entities,
        "facts": facts(every.where(~is_support)),
        "support_facts": facts(every.where(is_support)),
        "evidence": first_wins(conform(evidence, EVIDENCE), "evidence_id"),
        "coverage": first_wins(conform(coverage, COVERAGE), "coverage_id"),
    }


def build(files: DataFrame, repos: DataFrame, tenant: str = "default", scheme: str = "graph") -> dict[str, DataFrame]:
    """files (repo, path, content) and repos (repo, owner, commit_sha) to a graph's tables; each file is read once.

    Null contents give coverage rows, files without findings nothing, and repositories without files their own entity.
    """
    return tables_of(settled(extract.extract(files)), repos, tenant, scheme)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has: name, n."""
    counts = [frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, frame in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
