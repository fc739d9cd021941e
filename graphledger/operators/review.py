"""Ranking, budgets and comparisons for reviews: what to show first and what to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphledger.functions.exprs import is_test_path

# Fixed values that results depend on.
DERIVATION_TIER = {"authoritative_declared": 8, "manual_override": 7, "authoritative_static": 6, "deterministic_static": 5, "runtime_observed": 4, "static_inferred": 3, "candidate": 2, "inferred_llm": 1}
LINKAGE_TIER = {"known_linked": 3, "candidate": 2, "candidate_or_unlinked": 2, "unlinked": 1, "unlinked_lead": 1, "inventory_context": 1, "missing": 0, "missing_or_unknown": 0}
ROLE_PRIORITY = {"test_assertion": 0, "persistence": 1, "external_side_effect": 2, "intra_repo_consumer": 3, "generic_utility": 4}
PERSISTENCE = ("HANDLES_MODEL", "TASK_USES_MODEL", "SERIALIZES_MODEL")
SIDE_EFFECTS = ("CALLS_ENDPOINT", "PRODUCES_EVENT", "CONSUMES_EVENT")
EXTERNAL = ("ExternalPackage", "ExternalSymbol")


def _tier(column: Column, tiers: dict[str, int], other: int = 0) -> Column:
    out = F.lit(other)
    for name, value in tiers.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def match_rank(name: Column, path: Column, anchor: str) -> Column:
    """How exactly a row is what was asked about: 3 by name, 2 by path, 1 by a part of the name, else 0."""
    needle = F.lit(anchor.strip().lower())
    n, p = F.lower(name), F.lower(path)
    near_path = (p != "") & ((p == needle) | F.endswith(p, needle) | F.endswith(needle, p))
    near_name = (n != "") & (F.contains(n, needle) | F.contains(needle, n))
    rank = F.when(n == needle, 3).when(F.coalesce(near_path, F.lit(False)), 2).when(F.coalesce(near_name, F.lit(False)), 1).otherwise(0)
    return rank if anchor.strip() else F.lit(0)


def by_relevance(rows: DataFrame, anchor: str) -> DataFrame:
    """Rows (name, path, status, derivation_class, depth, ord) with their place, the best first, ties by input order.

    The order is by match, linkage, derivation, nearness and whether there is a path.
    """
    score = F.struct(
        match_rank(F.col("name"), F.col("path"), anchor).alias("m"),
        _tier(F.col("status"), LINKAGE_TIER).alias("l"),
        _tier(F.col("derivation_class"), DERIVATION_TIER).alias("d"),
        (-F.coalesce("depth", F.lit(0))).alias("n"),
        (F.length(F.coalesce("path", F.lit(""))) > 0).cast("int").alias("c"),
    )
    return rows.withColumn("score", score).orderBy(F.desc("score"), "ord")


def edge_roles(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """What the other end of an edge is to a reviewer: edges (other_id, other_kind, other_path, ord), facts (subject_id, predicate)."""
    known = facts.groupBy(F.col("subject_id").alias("other_id")).agg(F.max(F.col("predicate").isin(*PERSISTENCE)).alias("stores"), F.max(F.col("predicate").isin(*SIDE_EFFECTS)).alias("acts"))
    role = (
        F.when(F.coalesce(is_test_path(F.col("other_path")), F.lit(False)), "test_assertion")
        .when(F.col("other_kind").isin(*EXTERNAL), "generic_utility")
        .when(F.col("stores"), "persistence")
        .when(F.col("acts"), "external_side_effect")
        .otherwise("intra_repo_consumer")
    )
    return edges.join(known, "other_id", "left").withColumn("edge_role", role).drop("stores", "acts")


def by_role(edges: DataFrame, limit: int) -> DataFrame:
    """The most telling edges first, ties by input order."""
    return edges.orderBy(_tier(F.col("edge_role"), ROLE_PRIORITY, 3), "ord").limit(limit)


def reorder_in_place(rows: DataFrame, group: list[str]) -> DataFrame:
    """Within a group the rows take the group's own slots (ord) by score, so that other groups do not move: slot replaces ord."""
    w = Window.partitionBy(*group)
    slots = rows.select(*group, F.col("ord").alias("slot"), F.row_number().over(w.orderBy("ord")).alias("k_"))
    best = rows.withColumn("k_", F.row_number().over(w.orderBy(F.desc("score"), "ord")))
    return best.join(slots, [*group, "k_"]).drop("k_")


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """The longest head of the rows by rank whose texts together stay within a number of characters: id, rank, used."""
    # Empty texts cost nothing; of the others no more than `budget` can fit, so one task never sees more of them.
    last = rows.where(F.length("text") > 0).orderBy("rank", "id").limit(budget + 1).agg(F.max(F.struct("rank", "id")).alias("last"), F.count(F.lit(1)).alias("n"))
    rows = rows.crossJoin(F.broadcast(last)).where((F.col("n") <= budget) | (F.struct("rank", "id") <= F.col("last"))).drop("last", "n")
    used = F.sum(F.length("text")).over(Window.orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget).select("id", "rank", "used")


def seats(rows: DataFrame, n: int) -> DataFrame:
    """The best row of each family, the families in order of it, the first n of them: rows (family, score, tier, ord)."""
    first = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "ord"))
    return rows.withColumn("k_", first).where("k_ = 1").drop("k_").orderBy(F.desc("score"), F.desc("tier"), "ord").limit(n)


def paired_deltas(traces: DataFrame) -> DataFrame:
    """Runs of two arms paired by group and task: off less on, and what is wrong with a pair if it is not one of each."""
    n = lambda arm: F.count(F.when(F.col("arm") == arm, 1))
    v = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    rows = traces.groupBy("run_group", "task").agg(n("on").alias("n_on"), n("off").alias("n_off"), v("on").alias("on"), v("off").alias("off"))
    problem = F.when((F.col("n_on") > 1) | (F.col("n_off") > 1), "duplicate").when((F.col("n_on") == 0) | (F.col("n_off") == 0), "unpaired")
    return rows.select("run_group", "task", problem.alias("problem"), F.when(problem.isNull(), F.col("off") - F.col("on")).alias("delta"))


def baseline_drift(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts that differ from a baseline, or are on one side only: section, key, actual, expected."""
    a, e = (x.select("section", "key", F.col("n").alias(name)) for x, name in ((actual, "actual"), (expected, "expected")))
    return a.join(e, ["section", "key"], "full_outer").where(~F.col("actual").eqNullSafe(F.col("expected")))


# Fixed values that results depend on.
SPECIFICITY_RANK = {"high": 0, "medium": 1, "low": 2}
CONFIDENCE_RANK = {"strong": 2, "medium": 1, "weak": 0}
WINNERS = ("mcp_off", "mcp_on", "tie")


def _rank(column: str, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def strongest_hypotheses(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n hypotheses: by specificity, then most leads, most evidence, confidence and risk type; place is their order."""
    order = [F.asc(_rank("specificity", SPECIFICITY_RANK, 2)), F.desc(F.coalesce(F.size("leads"), F.lit(0))), F.desc(F.coalesce(F.size("evidence"), F.lit(0))), F.desc(_rank("confidence", CONFIDENCE_RANK, 0)), F.asc("risk_type"), F.asc("ord")]
    best = rows.orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def phase_means(rows: DataFrame) -> DataFrame:
    """For each phase: tasks and the mean differences of tool calls, tokens and time; what is missing counts in no mean."""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    mean = lambda x, name: F.avg(x).alias(name)
    return rows.groupBy(F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count(F.lit(1)).alias("tasks"), mean("tool_calls", "avg_tool_calls_delta"), mean(tokens, "avg_token_delta"), mean("wall_time", "avg_wall_time_delta"))


def rubric_wins(rows: DataFrame, aspects: list[str]) -> DataFrame:
    """How often each side won each aspect; anything else is unknown: aspect, winner, n. rows: one column for each aspect."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(a).alias("winner")) for a in aspects))).alias("r")).select("r.*")
    return each.groupBy("aspect", F.when(F.col("winner").isin(*WINNERS), F.col("winner")).otherwise("unknown").alias("winner")).agg(F.count(F.lit(1)).alias("n"))
