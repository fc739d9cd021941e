"""Joins across repositories: packages to providers, deploy targets to services, selectors to workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphledger.functions.exprs import package_name

#: Names in a chunk, on average at most; two chunks make up to the square of it in rows.
CHUNK = 256


def link_packages(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """Packages that exactly one other repository provides: repo, package, provider.

    consumers: repo, package. providers: repo, names (array). A package that
    is ambiguous for any consumer links for none.
    """
    p = providers.select(F.col("repo").alias("provider"), F.explode("names").alias("n")).select("provider", package_name(F.col("n")).alias("key")).distinct()
    c = consumers.select("repo", "package", package_name(F.col("package")).alias("key")).distinct()
    pairs = c.join(p, "key").where("repo <> provider")
    unique = pairs.groupBy("key", "repo", "package").agg(F.count_distinct("provider").alias("n"), F.min("provider").alias("provider"))
    unsafe = unique.where("n > 1").select("key").distinct()
    return unique.join(unsafe, "key", "left_anti").select("repo", "package", "provider")


def classify_packages(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """How each package stands: internal (one provider), ambiguous (several), self (only its own repository), external."""
    p = providers.select(F.col("repo").alias("provider"), F.explode("names").alias("n")).select("provider", package_name(F.col("n")).alias("key")).distinct()
    c = consumers.select("repo", package_name(F.col("package")).alias("key")).distinct()
    rows = c.join(p, "key", "left").groupBy("key").agg(F.count_distinct("repo").alias("consumers"), F.count_distinct(F.when(F.col("provider") != F.col("repo"), F.col("provider"))).alias("others"), F.count("provider").alias("any"))
    bucket = F.when(F.col("others") == 1, "internal").when(F.col("others") > 1, "ambiguous").when(F.col("any") > 0, "self").otherwise("external")
    return rows.select("key", "consumers", bucket.alias("bucket"))


def prefer(pairs: DataFrame, key: list[str], rank: str) -> DataFrame:
    """Of candidate links those of the best rank for each key."""
    return pairs.withColumn("best", F.min(rank).over(Window.partitionBy(*key))).where(F.col(rank) == F.col("best")).drop("best")


def suffix_links(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """Deploy targets matched to modules by the longest common path suffix of two segments or more.

    targets: target, path. modules: service, path. Columns: target, service,
    segments, status: canonical if one service has the longest, else candidate.
    """
    tail = lambda x, k: x.withColumn("s", F.filter(F.split("path", "/"), lambda v: v != "")).withColumn("k", F.explode(F.sequence(F.lit(2), F.greatest(F.size("s"), F.lit(2))))).where("size(s) >= k").select(*k, "k", F.array_join(F.slice("s", -F.col("k"), F.col("k")), "/").alias("suffix"), F.size("s").alias("n"))
    t = tail(targets, ["target"])
    m = tail(modules, ["service"]).where("k = n").select("service", "suffix").distinct()
    pairs = t.join(m, "suffix").withColumn("best", F.max("k").over(Window.partitionBy("target"))).where("k = best").select("target", "service", F.col("k").alias("segments")).distinct()
    many = pairs.withColumn("services", F.count(F.lit(1)).over(Window.partitionBy("target")))
    return many.select("target", "service", "segments", F.when(F.col("services") == 1, "canonical").otherwise("candidate").alias("status"))


def sole_service(services: DataFrame) -> DataFrame:
    """Repositories with exactly one service: repo, service."""
    return services.groupBy("repo").agg(F.count_distinct("service").alias("n"), F.min("service").alias("service")).where("n = 1").drop("n")


def _alike(rows: DataFrame, name: str, pairs: str) -> DataFrame:
    """Names grouped by all the pairs lists they have in a namespace: namespace, sets, n, and chunks of the names."""
    each = rows.groupBy("namespace", name).agg(F.array_sort(F.collect_set(F.array_sort(F.map_entries(pairs)))).alias("sets"))
    sizes = each.groupBy("namespace", "sets").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n"))
    dealt = each.join(sizes, ["namespace", "sets"]).withColumn("chunk", F.pmod(F.xxhash64(name), "n"))
    return dealt.groupBy("namespace", "sets", "chunk").agg(F.collect_list(F.struct(name)).alias(f"{name}s"))


def select_workloads(selectors: DataFrame, workloads: DataFrame) -> DataFrame:
    """Workloads whose labels hold all of a selector, in one namespace; an empty selector selects nothing.

    selectors: service, namespace, selector (map). workloads: workload,
    namespace, labels (map). Services with equal selectors and workloads with
    equal labels are compared once, on one pair of each selector. What fits is
    dealt out as chunks of names and only then expanded, each pair of names
    once, so that no pair is shuffled and no key makes a large task.
    """
    # A null value equals nothing; a selector with one selects nothing.
    known = selectors.where("namespace IS NOT NULL AND size(selector) > 0 AND forall(map_values(selector), v -> v IS NOT NULL)")
    s = _alike(known, "service", "selector").withColumnRenamed("sets", "s_sets")
    w = _alike(workloads.where("namespace IS NOT NULL AND size(labels) > 0"), "workload", "labels").withColumnRenamed("sets", "w_sets")
    wanted = s.select("namespace", "s_sets").distinct().withColumn("selector", F.explode("s_sets")).withColumn("pair", F.get("selector", F.lit(0)))
    held = w.select("namespace", "w_sets").distinct().withColumn("labels", F.explode("w_sets")).withColumn("pair", F.explode("labels"))
    fits = wanted.join(held, ["namespace", "pair"]).where(F.forall("selector", lambda e: F.array_contains(F.col("labels"), e))).select("namespace", "s_sets", "w_sets").distinct()
    chunks = fits.join(s, ["namespace", "s_sets"]).join(w, ["namespace", "w_sets"]).select("namespace", "services", "workloads")
    spread = chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.select("namespace", "workloads", F.explode("services").alias("s")).select("namespace", "s", F.explode("workloads").alias("w")).select("s.service", "w.workload", "namespace")


def nearest_before(points: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """For each point the last mark at or before it within its key, the largest value on ties: key, id, line, value.

    points: key, id, line. marks: key, line, value. One sort of both sides, no pairs.
    """
    p = points.select(key, "line", "id", F.lit(None).cast("string").alias("value"), F.lit(1).alias("side"))
    m = marks.select(key, "line", F.lit(None).cast("long").alias("id"), F.col("value").cast("string").alias("value"), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy("line", "side", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = p.unionByName(m).withColumn("nearest", F.last("value", ignorenulls=True).over(w))
    return rows.where("side = 1").select(key, "id", "line", F.col("nearest").alias("value"))


def inside_any(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Points that some range of their key covers, by one sort: points: key, id, line; ranges: key, start, end."""
    p = points.select(key, F.col("line").alias("at"), "id", F.lit(None).cast("long").alias("end"), F.lit(1).alias("side"))
    r = ranges.select(key, F.col("start").alias("at"), F.lit(None).cast("long").alias("id"), F.col("end").cast("long").alias("end"), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = p.unionByName(r).withColumn("reach", F.max("end").over(w))
    return rows.where("side = 1 AND reach >= at").select(key, "id", F.col("at").alias("line"))


def handler_policies(handlers: DataFrame, policies: DataFrame) -> DataFrame:
    """Handlers and the policies on them or on their direct methods: handler, policy, via. Both sides have module and qualname."""
    exact = handlers.alias("h").join(policies.alias("p"), ["module", "qualname"]).select("handler", "policy", F.lit("exact").alias("via"))
    child = policies.withColumn("qualname", F.regexp_replace("qualname", r"\.[^.]*$", "")).where(F.contains(policies.qualname, F.lit(".")))
    return exact.unionByName(handlers.join(child, ["module", "qualname"]).select("handler", "policy", F.lit("method").alias("via"))).distinct()


def not_linked(candidates: DataFrame, links: DataFrame, *key: str) -> DataFrame:
    """Candidates whose key no link has yet."""
    return candidates.join(links.select(*key).distinct(), [*key], "left_anti")


def with_fallback(wanted: DataFrame, resolvers: list[DataFrame], key: str) -> DataFrame:
    """Each wanted row with what the first resolver that knows its key says: the wanted columns, value, resolver (its place, null for none)."""
    known = None
    for place, resolver in enumerate(resolvers):
        one = resolver.select(key, "value", F.lit(place).alias("resolver"))
        known = one if known is None else known.unionByName(one)
    first = known.groupBy(key).agg(F.min(F.struct("resolver", "value")).alias("r"))
    return wanted.join(first, key, "left").select(*wanted.columns, F.col("r.value").alias("value"), F.col("r.resolver").alias("resolver"))


def routed(domains: DataFrame, routes: DataFrame) -> DataFrame:
    """Domains with whether any route serves them: the columns of domains, routed."""
    have = routes.select("domain").distinct().withColumn("routed", F.lit(True))
    return domains.join(have, "domain", "left").withColumn("routed", F.coalesce("routed", F.lit(False)))


# Fixed values that results depend on.
ROLE_TERMS = {
    "worker": ("task", "tasks", "worker", "workers", "job", "jobs", "consumer", "consumers", "processor", "processors"),
    "api": ("api", "apis", "view", "views", "route", "routes", "url", "urls", "controller", "controllers"),
    "serializer": ("serializer", "serializers", "schema", "schemas"),
    "model": ("model", "models", "entity", "entities"),
}


def roles(module: Column, path: Column, symbol_kind: Column) -> Column:
    """What a symbol is for by the segments of its module and path, as a sorted array of roles."""
    plain = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    parts = lambda x, by: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), by), plain), lambda t: t != "")
    m, p = parts(module, "[.]"), parts(path, "/")
    command = lambda x: F.contains(F.concat(F.lit("/"), F.array_join(x, "/"), F.lit("/")), F.lit("/management/commands/"))
    has = {name: F.arrays_overlap(m, F.array(*map(F.lit, terms))) | F.arrays_overlap(p, F.array(*map(F.lit, terms))) for name, terms in ROLE_TERMS.items()}
    has["scheduled_job"] = command(m) | command(p)
    has["model"] &= F.coalesce(symbol_kind, F.lit("")) != "django_field"
    return F.array_compact(F.array(*(F.when(has[name], F.lit(name)) for name in sorted(has))))
