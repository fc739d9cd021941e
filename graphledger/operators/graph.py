"""The five tables of an evidence graph, and the joins that every query starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphledger.functions.exprs import canonical, display

ENTITY = (
    "entity_id string, urn string, kind string, canonical_status string, tenant_id string, repo string, module string, qualname string, symbol_kind string, "
    "name string, slug string, path string, line int, end_line int, host string, method string, broker_kind string, channel_address string, type string, target string, ord long"
)
FACT = (
    "fact_id string, predicate string, subject_id string, object_id string, canonical_status string, category string, import_root string, distribution_name string, "
    "raw_import string, module_name string, imported_names array<string>, path string, method string, consumer_repo string, package_name string, source_kind string, "
    "source_line int, qualifier string, ord long"
)
EVIDENCE = (
    "evidence_id string, target_type string, target_id string, derivation_class string, source_system string, repo string, commit_sha string, path string, "
    "line_start int, line_end int, confidence double, ingested_at timestamp, ord long"
)
COVERAGE = "coverage_id string, tenant_id string, predicate string, state string, source_system string, repo string, language string, reason string, path string, path_prefix string, line int, checked_at timestamp, ord long"
SCHEMAS = {"entities": ENTITY, "facts": FACT, "support_facts": FACT, "evidence": EVIDENCE, "coverage": COVERAGE}

#: Facts that say which way an event flows.
DIRECTIONAL = ("PRODUCES_EVENT", "CONSUMES_EVENT")


def conform(frame: DataFrame, schema: str) -> DataFrame:
    """The frame with exactly the schema's columns; those it lacks are null."""
    wanted = [part.strip().split(" ", 1) for part in schema.split(", ")]
    return frame.select(*((F.col(n) if n in frame.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted))


@dataclass(frozen=True)
class Graph:
    """Lazy tables; `ord` is a row's place in its input, since limits cut in that order."""

    entities: DataFrame
    facts: DataFrame
    evidence: DataFrame
    coverage: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, entities: DataFrame, facts: DataFrame, evidence: DataFrame | None = None, coverage: DataFrame | None = None) -> Graph:
        empty = lambda schema: spark.createDataFrame([], schema)
        return cls(
            conform(entities, ENTITY),
            conform(facts, FACT),
            conform(evidence, EVIDENCE) if evidence is not None else empty(EVIDENCE),
            conform(coverage, COVERAGE) if coverage is not None else empty(COVERAGE),
        )

    def edges(self, *predicates: str, only_canonical: bool = False) -> DataFrame:
        """Facts with both ends, as s_ and o_ columns; facts that lack an end drop out."""
        facts = self.facts.where(F.col("predicate").isin(*predicates)) if predicates else self.facts
        ends = self.entities.withColumn("display", display())
        if only_canonical:
            facts, ends = facts.where(canonical(F.col("canonical_status"))), ends.where(canonical(F.col("canonical_status")))
        side = lambda p: ends.select(*(F.col(c).alias(p + c) for c in ("entity_id", "kind", "canonical_status", "display", "module", "name", "repo", "path", "line", "end_line", "qualname")))
        return facts.join(side("s_"), F.col("subject_id") == F.col("s_entity_id")).join(side("o_"), F.col("object_id") == F.col("o_entity_id"))


def first_wins(frame: DataFrame, key: str) -> DataFrame:
    """One row for each key, the first by input order; rows of a hot key are reduced before they are exchanged."""
    first = F.min_by(F.struct(*(F.col(c) for c in frame.columns if c != key)), F.struct("ord"))
    return frame.groupBy(key).agg(first.alias("first_")).select(key, "first_.*").select(*frame.columns)


def summary(graph: Graph) -> DataFrame:
    """Counts of entity kinds and fact predicates: section, name, n."""
    kinds = graph.entities.groupBy(F.lit("kind").alias("section"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    predicates = graph.facts.groupBy(F.lit("predicate").alias("section"), F.col("predicate").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(predicates)


def clamp(value: int, low: int = 1, high: int = 100) -> int:
    return max(low, min(high, value))
