"""Quality metrics of a graph; each is a value from 0 to 1, or null where it does not apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphledger.functions.exprs import is_hash_urn
from graphledger.operators.linker import inside_any

# Fixed values that results depend on.
STATUS_WEIGHT = {"canonical": 1.0, "candidate": 0.5, "demoted": 0.1}
TRUST_WEIGHT = {"authoritative_declared": 1.0, "authoritative_static": 1.0, "deterministic_static": 0.95, "manual_override": 0.9, "runtime_observed": 0.85, "static_inferred": 0.7, "candidate": 0.45, "inferred_llm": 0.35}
FRESH_DAYS = 365
CORE = ("freshness", "opportunity", "grounding", "meta", "useful", "trust")


def weight(column: Column, weights: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for name, value in weights.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def inventory(actual: int, expected: int) -> float | None:
    return min(actual / expected, 1.0) if expected else None


def freshness(evidence: DataFrame, now: str, days: int = FRESH_DAYS) -> DataFrame:
    """Share of evidence rows with a time that are recent enough; `now` is given, never the clock."""
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAY")
    return evidence.where("ingested_at IS NOT NULL").agg(F.avg((F.col("ingested_at") >= cutoff).cast("double")).alias("value"))


def grounding(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of facts with evidence that names a place in a file."""
    valid = evidence.where("path IS NOT NULL AND line_start >= 1 AND line_end >= line_start").select(F.col("target_id").alias("fact_id")).distinct()
    rows = facts.select("fact_id").join(valid.withColumn("ok", F.lit(1.0)), "fact_id", "left")
    return rows.agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("value"))


def trust_mix(facts: DataFrame, evidence: DataFrame, class_weight: dict[str, float] = TRUST_WEIGHT) -> DataFrame:
    """Mean over facts of status weight times the best evidence's class weight; no evidence counts 0."""
    best = evidence.groupBy(F.col("target_id").alias("fact_id")).agg(F.max(weight(F.col("derivation_class"), class_weight)).alias("best"))
    rows = facts.join(best, "fact_id", "left")
    return rows.agg(F.avg(weight(F.coalesce("canonical_status", F.lit("canonical")), STATUS_WEIGHT) * F.coalesce("best", F.lit(0.0))).alias("value"))


def identity_health(entities: DataFrame) -> DataFrame:
    """Share of entities whose URN is made of names, not of a hash."""
    return entities.agg(F.avg((~is_hash_urn(F.col("urn"))).cast("double")).alias("value"))


def opportunity(opportunities: DataFrame, evidence: DataFrame, coverage: DataFrame) -> DataFrame:
    """Expected facts that have evidence, and those with neither evidence nor coverage: opportunity, silent_gap.

    All share predicate, path and, where all have them, repo and language; an opportunity has a line, evidence a range.
    """
    key = ["predicate", "path", *(c for c in ("repo", "language") if all(c in x.columns for x in (opportunities, evidence, coverage)))]
    scope = F.struct(*key).alias("scope")
    o = opportunities.select("id", "line", scope)
    met = inside_any(o, evidence.select(scope, F.col("line_start").alias("start"), F.col("line_end").alias("end")), "scope").select("id").distinct().withColumn("met", F.lit(1.0))
    told = o.join(coverage.select(scope).distinct(), "scope", "left_semi").select("id").distinct().withColumn("told", F.lit(1.0))
    rows = o.join(met, "id", "left").join(told, "id", "left")
    gap = F.when(F.col("met").isNull() & F.col("told").isNull(), 1.0).otherwise(0.0)
    return rows.agg(F.avg(F.coalesce("met", F.lit(0.0))).alias("opportunity"), F.avg(gap).alias("silent_gap"))


def useful_edge(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of anchors (node) with a canonical edge at either end (src, dst)."""
    touched = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("ok", F.lit(1.0))
    return anchors.select("node").distinct().join(touched, "node", "left").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("value"))


def meta_coverage(tool_predicates: DataFrame, facts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Share of the predicates that tools read which facts or coverage know."""
    known = facts.select("predicate").union(coverage.where("state IN ('instrumented', 'partially_instrumented')").select("predicate")).distinct().withColumn("ok", F.lit(1.0))
    return tool_predicates.select("predicate").distinct().join(known, "predicate", "left").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("value"))


def cross_repo_linkage(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """Share of candidate packages that resolved; null without candidates."""
    rows = candidates.select("package").distinct().join(resolved.select("package").distinct().withColumn("ok", F.lit(1.0)), "package", "left")
    return rows.agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("value"))


def cell_score(cells: DataFrame) -> DataFrame:
    """The cells with their score: geometric mean of the core metrics, less silent gaps, times identity health; null if any is missing."""
    zero = F.least(*CORE) <= 0
    mean = F.when(zero, 0.0).otherwise(F.exp(sum(F.ln(F.when(F.col(c) > 0, F.col(c))) for c in CORE) / len(CORE)))
    usable = F.lit(True)
    for c in CORE:
        usable = usable & F.col(c).isNotNull()
    return cells.withColumn("score", F.when(usable, mean * (1 - F.col("silent_gap")) * F.col("identity")))


def worst_first(cells: DataFrame, group: str) -> DataFrame:
    """Groups by average score, the worst first: group, score, cells."""
    return cells.groupBy(group).agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("cells")).orderBy("score", group)
