"""Symbols, their callers and callees, and what a call rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphledger.functions.exprs import derivation_priority, display, loose_path
from graphledger.operators.graph import Graph


def lookup_symbol(graph: Graph, query: str, path: str | None = None, line: int | None = None, fuzzy: bool = True) -> DataFrame:
    """Candidates of the best tier (exact_qualified, exact_name, fuzzy), with how many there are; one means resolved."""
    rows = graph.entities.where(F.col("kind").isin("CodeSymbol", "ExternalSymbol")).withColumn("display", display())
    own = F.coalesce(F.element_at(F.split(F.coalesce("qualname", "name"), "[.]"), -1), F.lit(""))
    q = query.lower()
    tier = F.when(F.lower("display") == q, 1).when((F.lower(own) == q) | (F.lower(F.coalesce("qualname", "name")) == q), 2)
    if fuzzy:
        tier = F.coalesce(tier, F.when(F.contains(F.lower("display"), F.lit(q)), 3))
    rows = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    if path is not None:
        rows = rows.where(loose_path(F.col("path")) == loose_path(F.lit(path)))
    if line is not None:
        rows = rows.where(F.lit(line).between(F.col("line"), F.coalesce("end_line", "line")))
    best = rows.agg(F.min("tier").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("best"))  # one row
    everything = rows.agg(F.count(F.lit(1)).alias("candidates"))
    return rows.crossJoin(F.broadcast(everything)).select("entity_id", "display", "kind", "path", "line", F.element_at(F.array(*map(F.lit, ("exact_qualified", "exact_name", "fuzzy"))), F.col("tier")).alias("tier"), "candidates")


def resolved(graph: Graph, query: str, path: str | None, line: int | None, include_all: bool) -> DataFrame:
    """Ids a query stands for: none if it is not found, none if it is ambiguous unless all are asked for."""
    found = lookup_symbol(graph, query, path, line, fuzzy=False)
    return (found if include_all else found.where("candidates = 1")).select(F.col("entity_id").alias("root_id"))


def _calls(graph: Graph, roots: DataFrame, end: str, limit: int) -> DataFrame:
    rows = graph.edges("CALLS").join(roots, F.col(end) == F.col("root_id"), "left_semi")
    return rows.orderBy("ord", "fact_id").limit(limit).select("fact_id", F.col("s_display").alias("caller"), F.col("o_display").alias("callee"), "ord")


def find_callers(graph: Graph, symbol: str, limit: int = 25, path: str | None = None, line: int | None = None, include_all: bool = False) -> DataFrame:
    """The first calls of a symbol in input order; candidates count too."""
    return _calls(graph, resolved(graph, symbol, path, line, include_all), "object_id", limit)


def find_callees(graph: Graph, symbol: str, limit: int = 25, path: str | None = None, line: int | None = None, include_all: bool = False) -> DataFrame:
    return _calls(graph, resolved(graph, symbol, path, line, include_all), "subject_id", limit)


def symbols_in_file(graph: Graph, path: str, limit: int = 100) -> DataFrame:
    """Symbols of a file by line: display, kind, line."""
    rows = graph.entities.where((F.col("kind") == "CodeSymbol") & (loose_path(F.col("path")) == loose_path(F.lit(path))))
    return rows.withColumn("display", display()).orderBy("line", "display").limit(limit).select("display", "kind", "line")


def evidence_for_call(graph: Graph, caller: str, callee: str, limit: int = 25) -> DataFrame:
    """What the calls from one symbol to another rest on: fact_id, evidence_id, derivation_class, path, line_start."""
    a, b = (resolved(graph, q, None, None, False) for q in (caller, callee))
    rows = graph.facts.where("predicate = 'CALLS'").join(a, F.col("subject_id") == F.col("root_id"), "left_semi").join(b, F.col("object_id") == F.col("root_id"), "left_semi")
    e = graph.evidence.select("evidence_id", "target_id", "derivation_class", F.col("path").alias("e_path"), "line_start", F.col("ord").alias("e_ord"))
    joined = rows.join(e, F.col("fact_id") == F.col("target_id")).orderBy("ord", "e_ord", "evidence_id").limit(limit)
    return joined.select("fact_id", "evidence_id", "derivation_class", F.col("e_path").alias("path"), "line_start")


def strongest_derivation(graph: Graph) -> DataFrame:
    """For each target the derivation class of highest priority, the first by input order among equals: target_id, derivation_class, rows."""
    rank = F.struct(derivation_priority(F.col("derivation_class")), -F.col("ord"))
    return graph.evidence.groupBy("target_id").agg(F.max_by("derivation_class", rank).alias("derivation_class"), F.count(F.lit(1)).alias("n"))


def symbols_of_ranges(graph: Graph, ranges: DataFrame) -> DataFrame:
    """Changed ranges (path, start, end) matched to symbols: those that enclose it, else those that overlap; of nested ones the innermost.

    Columns: path, start, end, entity_id, match.
    """
    s = graph.entities.where("kind = 'CodeSymbol' AND line IS NOT NULL").select("entity_id", loose_path(F.col("path")).alias("s_path"), "line", F.coalesce("end_line", "line").alias("end_line"))
    r = ranges.withColumn("key", loose_path(F.col("path")))
    hits = r.join(s, (F.col("key") == F.col("s_path")) & (F.col("line") <= F.col("end")) & (F.col("start") <= F.col("end_line")))
    hits = hits.withColumn("encloses", (F.col("line") <= F.col("start")) & (F.col("end_line") >= F.col("end")))
    one = Window.partitionBy("key", "start", "end")
    hits = hits.withColumn("any", F.max("encloses").over(one)).where("encloses OR NOT any")
    # Innermost: no other hit of the range begins as late and ends as early. Ranked by start, that is a running minimum of ends.
    inner = one.orderBy(F.desc("line"), F.asc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("least_end", F.min("end_line").over(inner)).where("least_end IS NULL OR least_end > end_line")
    return hits.select("path", "start", "end", "entity_id", F.when(F.col("encloses"), "enclosing").otherwise("overlapping").alias("match"))


# Fixed values that results depend on.
CALLABLE_KINDS = ("function", "method", "class")


def is_callable(kind: Column, qualname: Column) -> Column:
    """Whether a caller is a symbol that can be called, not a place in a module: by its kind, or without one by having a name."""
    return F.when(kind.isin(*CALLABLE_KINDS), True).when(kind.isNotNull(), False).otherwise(F.coalesce(qualname, F.lit("")) != "")


def call_site(source_line: Column, source_excerpt: Column) -> Column:
    """The texts of a call's place that are not blank; null without any."""
    bare = lambda x: F.when(F.trim(x) != "", x)
    line, excerpt = bare(source_line), bare(source_excerpt)
    return F.when(line.isNotNull() | excerpt.isNotNull(), F.struct(line.alias("source_line"), excerpt.alias("source_excerpt")))
