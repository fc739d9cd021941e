"""What changed between two snapshots of a graph, and what that may break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphledger.functions.exprs import is_test_path, strict_path
from graphledger.operators.graph import Graph

# Fixed values that results depend on: parts of a qualifier that move with the source and do not tell facts apart.
VOLATILE = ("source_line", "source_excerpt", "line", "line_start", "line_end", "col", "column")


def row_diff(base: DataFrame, head: DataFrame, *key: str) -> DataFrame:
    """Rows of only one side by key, with a change column; rows with equal keys count once."""
    b, h = (x.dropDuplicates([*key]) for x in (base, head))
    removed = b.join(h, [*key], "left_anti").withColumn("change", F.lit("removed"))
    return removed.unionByName(h.join(b, [*key], "left_anti").withColumn("change", F.lit("added")))


def natural_key() -> Column:
    """What a fact is, whatever its id and place: subject, object and the lasting parts of its qualifier, sorted."""
    parts = F.from_json(F.coalesce("qualifier", F.lit("{}")), "map<string,string>")
    lasting = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(parts, lambda k, _: ~k.isin(*VOLATILE)))))
    return F.concat_ws("|", F.coalesce("subject_id", F.lit("")), F.coalesce("object_id", F.lit("")), F.to_json(lasting))


def snapshot_diff(base: Graph, head: Graph) -> DataFrame:
    """What one snapshot has and the other lacks: section entity or fact, name (kind or predicate), change, key (URN or natural key).

    Entities are told apart by URN alone, so changed attributes, lines and ids are no change. Duplicates count once.
    """
    entities = [g.entities.groupBy(F.col("urn").alias("key")).agg(F.first("kind").alias("name")).withColumn("section", F.lit("entity")) for g in (base, head)]
    facts = [g.facts.select(F.col("predicate").alias("name"), natural_key().alias("key")).distinct().withColumn("section", F.lit("fact")) for g in (base, head)]
    wanted = ["section", "name", "change", "key"]
    return row_diff(*entities, "key").select(*wanted).unionByName(row_diff(*facts, "name", "key").select(*wanted))


def one_tenant(base: Graph, head: Graph) -> None:
    """Fails if the snapshots belong to different tenants; tables without one fit each other only."""
    found = [sorted(str(r[0]) for r in g.entities.select("tenant_id").distinct().limit(2).collect()) for g in (base, head)]
    if found[0] != found[1]:
        raise ValueError(f"snapshots of different tenants: {found[0]} and {found[1]}")


def diff_counts(base: DataFrame, head: DataFrame, *key: str) -> DataFrame:
    """One row: removed, added, common."""
    b = base.select(*key).distinct().withColumn("b", F.lit(1))
    h = head.select(*key).distinct().withColumn("h", F.lit(1))
    both = b.join(h, [*key], "full_outer")
    return both.agg(F.count(F.when(F.col("h").isNull(), 1)).alias("removed"), F.count(F.when(F.col("b").isNull(), 1)).alias("added"), F.count(F.when(F.col("b").isNotNull() & F.col("h").isNotNull(), 1)).alias("common"))


def surviving_referrers(base_edges: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """Removed nodes whose former referrers are still there: removed, referrers. edges: src, dst; nodes: node."""
    gone = base_edges.select(F.col("dst").alias("node")).distinct().join(head_nodes, "node", "left_anti")
    rows = base_edges.join(gone, base_edges.dst == gone.node).join(head_nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return rows.groupBy(F.col("dst").alias("removed")).agg(F.count_distinct("src").alias("referrers"))


def former_referrers(base_edges: DataFrame, head_edges: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """The referrers behind surviving_referrers, one by one: removed, referrer, likely_unchanged (no call was added to the referrer)."""
    gone = base_edges.select(F.col("dst").alias("node")).distinct().join(head_nodes, "node", "left_anti")
    rows = base_edges.join(gone, base_edges.dst == gone.node, "left_semi").join(head_nodes.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    gained = head_edges.select("src", "dst").join(base_edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src").distinct().withColumn("gained", F.lit(True))
    return rows.join(gained, "src", "left").select(F.col("dst").alias("removed"), F.col("src").alias("referrer"), F.col("gained").isNull().alias("likely_unchanged"))


def responsibility_moved(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Targets that lost a caller and won another in the same repository: dst, repo, lost, won. Edges: src, dst, repo (of src).

    Sides are counted, never paired, so hot targets stay small. Without a repo column all is one repository.
    """
    key = ["dst", *(["repo"] if "repo" in removed.columns and "repo" in added.columns else [])]
    lost = removed.join(added, ["src", "dst"], "left_anti").groupBy(*key).agg(F.count_distinct("src").alias("lost"))
    won = added.join(removed, ["src", "dst"], "left_anti").groupBy(*key).agg(F.count_distinct("src").alias("won"))
    return lost.join(won, key)


def in_both(base: DataFrame, head: DataFrame, *carried: str) -> DataFrame:
    """Base and head entities with the same URN: urn, base_id, head_id, and the carried columns of both sides; ids differ from run to run."""
    side = lambda x, name: x.select("urn", F.col("entity_id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in carried))
    return side(base, "base").join(side(head, "head"), "urn")


def union_scopes(*scopes: DataFrame) -> DataFrame:
    """All scopes, each once by its JSON with sorted keys: scope (a map of strings)."""
    rows = scopes[0]
    for more in scopes[1:]:
        rows = rows.unionByName(more)
    plain = F.to_json(F.array_sort(F.map_entries("scope")))
    return rows.withColumn("plain", plain).groupBy("plain").agg(F.first("scope").alias("scope")).select("scope")


def call_edge_delta(removed: DataFrame, added: DataFrame, paths: list[str]) -> DataFrame:
    """Changed edges that touch some files: src, dst, path, change."""
    wanted = [p.replace("\\", "/").removeprefix("./") for p in paths]
    rows = removed.withColumn("change", F.lit("removed")).unionByName(added.withColumn("change", F.lit("added")))
    return rows.where(strict_path(F.col("path")).isin(*wanted))


def removed_test_references(removed: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """Edges out of tests that went while their target stayed: src, dst, path."""
    return removed.where(is_test_path(F.col("path"))).join(head_nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "path")


def guard_call_removed(base_edges: DataFrame, head_edges: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """Calls that surviving callers no longer make: src, dst."""
    gone = base_edges.select("src", "dst").distinct().join(head_edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return gone.join(head_nodes.select(F.col("node").alias("src")), "src", "left_semi")


def top_lost(lost: DataFrame, base_edges: DataFrame, each: int = 3, many: int = 5) -> DataFrame:
    """For each caller the lost targets with most referrers before: src, dst, refs, place, omitted, flagged."""
    refs = base_edges.groupBy("dst").agg(F.count_distinct("src").alias("refs"))
    w = Window.partitionBy("src")
    rows = lost.join(refs, "dst").withColumn("place", F.row_number().over(w.orderBy(F.desc("refs"), "dst"))).withColumn("all", F.count(F.lit(1)).over(w))
    return rows.where(F.col("place") <= each).select("src", "dst", "refs", "place", F.greatest(F.col("all") - each, F.lit(0)).alias("omitted"), (F.col("all") > many).alias("flagged"))


def demote_channels(channels: DataFrame, facts: DataFrame) -> DataFrame:
    """Channels that only mentions support become candidates: channel, status, mentions.

    A producer, a consumer or a literal address (has_literal) keeps a channel.
    """
    f = facts.groupBy("channel").agg(F.count(F.when(F.col("predicate").isin("PRODUCES_EVENT", "CONSUMES_EVENT"), 1)).alias("directed"), F.count(F.lit(1)).alias("mentions"))
    rows = channels.join(f, "channel", "left")
    keep = F.coalesce(F.col("has_literal"), F.lit(False)) | (F.coalesce("directed", F.lit(0)) > 0)
    return rows.select("channel", F.when(keep, "canonical").otherwise("candidate").alias("status"), F.coalesce("mentions", F.lit(0)).alias("mentions"))
