"""Questions over endpoints, domains, event channels, deploy targets and cross-repository links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphledger.functions.exprs import canonical, path_shape, repo_matches, shape_has_prefix
from graphledger.operators.graph import DIRECTIONAL, Graph, clamp

ENDPOINT = ("EXPOSES_ENDPOINT", "CALLS_ENDPOINT", "DOCUMENTS_ENDPOINT")
RESOLVES = ("RESOLVES_TO_REPO", "RESOLVES_TO_SERVICE")


def cross_repo_links(graph: Graph, limit: int = 25) -> DataFrame:
    """Packages resolved to a provider: consumer_repo, package_name, predicate, provider, and how many there are in all."""
    rows = graph.edges(*RESOLVES).select("consumer_repo", "package_name", "predicate", F.col("o_display").alias("provider"), "fact_id")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("consumer_repo", "package_name", "predicate", "fact_id").limit(clamp(limit)).crossJoin(F.broadcast(total))


def repo_dependencies(graph: Graph, repo: str, limit: int = 25) -> DataFrame:
    """Repositories that a repository's packages come from: consumer_repo, package_name, provider."""
    rows = graph.edges("RESOLVES_TO_REPO").where(repo_matches(F.col("consumer_repo"), F.lit(repo)))
    return rows.orderBy("package_name", "o_display", "fact_id").limit(clamp(limit)).select("consumer_repo", "package_name", F.col("o_display").alias("provider"))


def domain_references(graph: Graph, domain: str, limit: int = 25) -> DataFrame:
    """Who refers or routes to a domain, and code that reads an environment variable set to it: subject, object, predicate, via."""
    needle = F.lit(domain.lower())
    direct = graph.edges("REFERENCES_DOMAIN", "ROUTES_DOMAIN_TO_DEPLOY").where(F.contains(F.lower("o_display"), needle) | F.contains(F.lower("s_display"), needle))
    env = direct.where("predicate = 'REFERENCES_DOMAIN' AND s_kind = 'EnvVar'").select(F.col("subject_id").alias("env_id"), F.col("o_display").alias("domain")).distinct()
    readers = graph.edges("REFERENCES_ENV_VAR").where(F.col("source_kind").isin("code_access", "endpoint_env_host")).join(env, F.col("object_id") == F.col("env_id"))
    rows = direct.select("fact_id", F.col("s_display").alias("subject"), F.col("o_display").alias("object"), "predicate", F.lit("direct").alias("via"))
    rows = rows.unionByName(readers.select("fact_id", F.col("s_display").alias("subject"), F.col("domain").alias("object"), "predicate", F.lit("env").alias("via")))
    once = rows.groupBy("fact_id").agg(F.min(F.struct("via", "object", "subject", "predicate")).alias("r")).select("fact_id", "r.*")
    return once.orderBy("object", "subject", "fact_id").limit(clamp(limit)).select("subject", "object", "predicate", "via")


def endpoints(graph: Graph, query: str, limit: int = 25) -> DataFrame:
    """Endpoint facts whose path, as it is or by shape, contains the query, as it is or by shape."""
    rows = graph.edges(*ENDPOINT).withColumn("shape", path_shape(F.col("o_path")))
    asked = [F.lit(query), path_shape(F.lit(query))]
    hit = F.lit(False)
    for q in asked:
        for p in ("o_path", "shape"):
            hit = hit | F.contains(F.lower(F.col(p)), F.lower(q))
    return rows.where(hit).orderBy("o_path", "predicate", "o_display", "fact_id").limit(clamp(limit)).select("fact_id", F.col("o_path").alias("path"), "predicate", F.col("s_display").alias("subject"))


def endpoints_under(graph: Graph, prefix: str) -> DataFrame:
    """Endpoint facts at or below a path, by shape."""
    rows = graph.edges(*ENDPOINT).withColumn("shape", path_shape(F.col("o_path")))
    return rows.where(shape_has_prefix(F.col("shape"), path_shape(F.lit(prefix)))).select("fact_id", "shape", "predicate")


def event_channels(graph: Graph, query: str, limit: int = 25) -> DataFrame:
    """Channel facts, those with a known direction first: channel, service, predicate, bucket."""
    rows = graph.edges("REFERENCES_EVENT_CHANNEL", *DIRECTIONAL).where(F.contains(F.lower("o_display"), F.lit(query.lower())))
    known = F.col("predicate").isin(*DIRECTIONAL) & canonical(F.col("canonical_status")) & canonical(F.col("o_canonical_status"))
    rows = rows.withColumn("bucket", F.when(known, "known_linked").otherwise("candidate"))
    return rows.orderBy(F.desc("bucket"), "o_display", "s_display", "fact_id").limit(clamp(limit)).select(F.col("o_display").alias("channel"), F.col("s_display").alias("service"), "predicate", "bucket")


def deploy_mappings(graph: Graph, query: str, limit: int = 25) -> DataFrame:
    """Deploy facts that mention the query anywhere, canonical ones first: target, source, predicate, bucket."""
    rows = graph.edges("DEPLOYS_VIA_CONFIG", "ROUTES_DOMAIN_TO_DEPLOY")
    text = F.lower(F.concat_ws(" ", "s_display", "o_display", "predicate", "qualifier"))
    rows = rows.where(F.contains(text, F.lit(query.lower()))).withColumn("bucket", F.when(canonical(F.col("canonical_status")), "known").otherwise("candidate"))
    return rows.orderBy(F.desc("bucket"), "o_display", "s_display", "fact_id").limit(clamp(limit)).select(F.col("o_display").alias("target"), F.col("s_display").alias("source"), "predicate", "bucket")


def endpoint_consumers(graph: Graph) -> DataFrame:
    """Calls matched to the endpoints that serve them, by path shape and method: provider, consumer, shape, method.

    A provider for any method takes all; a call without a method matches none.
    Services never consume themselves.
    """
    e = graph.edges("EXPOSES_ENDPOINT", "CALLS_ENDPOINT").withColumn("shape", path_shape(F.coalesce("o_path", "path")))
    p = e.where("predicate = 'EXPOSES_ENDPOINT'").select("shape", F.upper("method").alias("p_method"), F.col("s_display").alias("provider")).distinct()
    c = e.where("predicate = 'CALLS_ENDPOINT' AND method IS NOT NULL").select("shape", F.upper("method").alias("method"), F.col("s_display").alias("consumer")).distinct()
    rows = p.join(c, "shape").where("provider <> consumer AND (p_method = 'ANY' OR p_method = method)")
    return rows.select("provider", "consumer", "shape", "method").distinct()


def event_asymmetry(graph: Graph) -> DataFrame:
    """Channels with producers but no consumer or the other way round: channel, producers, consumers, gap."""
    rows = graph.edges(*DIRECTIONAL).groupBy("object_id", F.col("o_display").alias("channel")).agg(
        F.count_distinct(F.when(F.col("predicate") == "PRODUCES_EVENT", F.col("subject_id"))).alias("producers"),
        F.count_distinct(F.when(F.col("predicate") == "CONSUMES_EVENT", F.col("subject_id"))).alias("consumers"),
    )
    gap = F.when(F.col("consumers") == 0, "no_consumer").when(F.col("producers") == 0, "no_producer")
    return rows.select("channel", "producers", "consumers", gap.alias("gap"))


def diverse_first(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """One row of each key before any second one, by order within a key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), "id"))
    return rows.withColumn("round", place).orderBy("round", F.desc(order), "id").limit(limit)


def capped(rows: DataFrame, key: str, each: int, limit: int) -> DataFrame:
    """At most `each` rows of a key by rank and id, then at most `limit` in all; how many a key had goes along."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("rank"), "id"))).withColumn("of", F.count(F.lit(1)).over(w))
    return rows.where(F.col("place") <= each).orderBy(F.desc("rank"), key, "id").limit(limit)
