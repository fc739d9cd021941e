"""Walks over CALLS and other edges: one join for each hop, visited nodes pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphledger.operators.graph import Graph
from graphledger.sources.session import settled

#: (predicate, subject kind, object kind) that a dependency path may use.
PATH_EDGES = [
    ("CALLS", "CodeSymbol", "CodeSymbol"),
    ("CALLS", "CodeSymbol", "ExternalPackage"),
    ("CALLS", "CodeSymbol", "ExternalSymbol"),
    ("CALLS", "CodeSymbol", "CodeModule"),
    ("DEFINED_IN", "CodeSymbol", "CodeModule"),
    ("IMPORTS", "CodeModule", "ExternalPackage"),
    ("IMPORTS", "CodeModule", "CodeModule"),
    ("RESOLVES_TO_REPO", "ExternalPackage", "Repo"),
    ("RESOLVES_TO_SERVICE", "ExternalPackage", "Service"),
]


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Least number of hops from any root to each node, up to depth: node, depth. edges: src, dst; roots: root_id."""
    seen = settled(roots.select(F.col("root_id").alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    links = edges.select("src", "dst").distinct()
    for hop in range(1, depth + 1):
        ahead = front.join(links, front.node == links.src).select(F.col("dst").alias("node")).distinct()
        front = settled(ahead.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop)))
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front))
    return seen


def blast_radius(edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """All edges out of nodes within depth - 1 hops of a root: src, dst, depth, ord. Cut by depth, then input order."""
    nodes = reach(edges, roots, depth - 1).select(F.col("node").alias("n"), F.col("depth").alias("d"))
    rows = edges.join(nodes, F.col("src") == F.col("n")).select("src", "dst", (F.col("d") + 1).alias("depth"), "ord")
    return rows.orderBy("depth", "ord", "src", "dst").limit(limit) if limit is not None else rows


def constructor_bridges(graph: Graph) -> DataFrame:
    """Edges from a class to its constructor, so that callers of the class count as callers of it: src, dst."""
    s = graph.entities.where("kind = 'CodeSymbol'")
    init = s.where(F.endswith("qualname", F.lit(".__init__"))).select(F.col("entity_id").alias("init"), "tenant_id", "repo", "module", F.expr("substring(qualname, 1, length(qualname) - 9)").alias("qualname"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in ("tenant_id", "repo", "module")]
    return s.alias("c").join(init.alias("i"), [F.col("c.qualname") == F.col("i.qualname"), *same]).select(F.col("c.entity_id").alias("src"), F.col("init").alias("dst"))


def reverse_impact(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes that lead to a root, with the least hops: node, depth. Roots themselves are left out."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, roots, depth).where("depth > 0")


def impact_tiers(impact: DataFrame) -> DataFrame:
    """How many nodes each number of hops reaches: depth, symbol_count."""
    return impact.groupBy("depth").agg(F.count(F.lit(1)).alias("symbol_count"))


def allowed_edges(graph: Graph) -> DataFrame:
    """Edges of the kinds that a dependency path may use: src, dst, predicate, display, fact_id."""
    spark: SparkSession = graph.facts.sparkSession
    rules = spark.createDataFrame(PATH_EDGES, "predicate string, s_kind string, o_kind string")
    rows = graph.edges(*{p for p, _, _ in PATH_EDGES}, only_canonical=True)
    rows = rows.join(F.broadcast(rules), ["predicate", "s_kind", "o_kind"])  # a fixed list
    return rows.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "predicate", F.col("o_display").alias("display"), "fact_id")


def dependency_paths(edges: DataFrame, source: str, target: str, max_depth: int = 4, limit: int = 5) -> DataFrame:
    """Simple paths from source to target, the shortest first; each sequence of nodes once: path, hops.

    Only nodes that can still reach the target in time are walked, so the
    search does not fan out over the whole graph.
    """
    max_depth, limit = max(1, min(6, max_depth)), max(1, min(25, limit))
    spark = edges.sparkSession
    best = Window.partitionBy("src", "dst").orderBy("predicate", "display", "fact_id")
    step = edges.withColumn("r", F.row_number().over(best)).where("r = 1").select("src", "dst")
    goal = spark.createDataFrame([(target,)], "root_id string")
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = reach(back, goal, max_depth).select(F.col("node").alias("n"), F.col("depth").alias("left"))
    step = settled(step.join(left, step.dst == left.n).select("src", "dst", "left"))
    front = spark.createDataFrame([([source],)], "nodes array<string>")
    done = None
    for hop in range(1, max_depth + 1):
        ahead = front.join(step, (F.element_at("nodes", -1) == F.col("src")) & (F.col("left") <= max_depth - hop)).where(~F.array_contains("nodes", F.col("dst")))
        ahead = settled(ahead.select(F.concat("nodes", F.array("dst")).alias("nodes")))
        arrived = ahead.where(F.element_at("nodes", -1) == target)
        done = arrived if done is None else done.unionByName(arrived)
        front = ahead.where(F.element_at("nodes", -1) != target)
        if done.limit(limit).count() >= limit or front.isEmpty():
            break
    rows = done.select(F.array_join("nodes", " > ").alias("path"), (F.size("nodes") - 1).alias("hops"))
    return rows.orderBy("hops", "path").limit(limit)


def call_edges(graph: Graph) -> DataFrame:
    return graph.edges("CALLS").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "ord")


def import_consumer_leads(graph: Graph, module: str, names: list[str], limit: int = 25) -> DataFrame:
    """Imports of a symbol's module, by name or of the whole module, where no call is known: fact_id, module."""
    rows = graph.edges("IMPORTS").where((F.col("o_module") == module) & (F.coalesce(F.size("imported_names"), F.lit(0)) <= 0) | (F.col("o_module") == module) & F.arrays_overlap("imported_names", F.array(*map(F.lit, names))))
    return rows.orderBy("ord", "fact_id").limit(limit).select("fact_id", F.col("s_display").alias("module"))


def transitive_members(bases: DataFrame, members: DataFrame) -> DataFrame:
    """Members of classes and of all their bases, however far: class_id, member. bases: class_id, base_id; members: class_id, member."""
    pairs = settled(members.select(F.col("class_id").alias("own"), F.col("class_id").alias("at")).union(bases.select("class_id", "class_id")).distinct())
    front = pairs
    while True:  # each pair is in front once, so cycles end too
        ahead = front.join(bases, front["at"] == bases.class_id).select("own", F.col("base_id").alias("at")).distinct()
        front = settled(ahead.join(pairs, ["own", "at"], "left_anti"))
        if front.isEmpty():
            break
        pairs = settled(pairs.unionByName(front))
    return pairs.join(members, pairs["at"] == members.class_id).select(F.col("own").alias("class_id"), "member").distinct()




def reach_by_root(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Least number of hops from each root to each node, every root walked for itself: root, node, depth (from 0)."""
    links = edges.select("src", "dst").distinct()
    seen = settled(roots.select(F.col("root_id").alias("root"), F.col("root_id").alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for hop in range(1, depth + 1):
        ahead = front.join(links, front.node == links.src).select("root", F.col("dst").alias("node")).distinct()
        front = settled(ahead.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front))
    return seen


def reverse_impact_by_root(edges: DataFrame, roots: DataFrame, depth: int = 3, bridges: DataFrame | None = None) -> DataFrame:
    """What leads to each root and where a walk ends: root, node, depth, terminal (null, max_depth_reached or no_callers).

    Callers of a class count as callers of its constructor through bridges (src, dst), as one hop.
    """
    links = edges.select("src", "dst")
    links = (links.unionByName(bridges.select("src", "dst")) if bridges is not None else links).distinct()
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rows = reach_by_root(back, roots, depth)
    called = back.select(F.col("src").alias("node")).distinct().withColumn("called", F.lit(True))
    rows = rows.join(called, "node", "left")
    terminal = F.when(F.col("called").isNull(), "no_callers").when(F.col("depth") == depth, "max_depth_reached")
    return rows.where("depth > 0").select("root", "node", "depth", terminal.alias("terminal"))
