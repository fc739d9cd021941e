"""Who imports what: dependency questions over IMPORTS facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphledger.functions.exprs import dotted_prefix
from graphledger.operators.graph import Graph

INTERNAL = ("internal_module", "relative_internal_module")
STANDARD = ("stdlib", "node_builtin")


def import_matches(query: str) -> Column:
    """Whether an import's target is what was asked for, by any of its six names; case does not matter."""
    names = F.array(*(F.lower(F.col(c)) for c in ("o_name", "o_module", "raw_import", "import_root", "distribution_name", "module_name")))
    return F.exists(names, lambda n: n == F.lit(query.lower())) if query else F.lit(False)


def modules_importing(graph: Graph, package: str, limit: int = 25) -> DataFrame:
    """Import facts of a package in input order: fact_id, module, package, category, ord."""
    rows = graph.edges("IMPORTS").where(F.coalesce(import_matches(package), F.lit(False)))
    return rows.orderBy("ord", "fact_id").limit(limit).select("fact_id", F.col("s_display").alias("module"), F.col("o_display").alias("package"), "category", "ord")


def top_dependencies(graph: Graph, limit: int = 25, exclude_stdlib: bool = True, exclude_unknown: bool = True) -> DataFrame:
    """External packages by number of import facts: name, category of the first fact, importer_count."""
    rows = graph.edges("IMPORTS").where(F.col("o_kind") == "ExternalPackage")
    category = F.coalesce(F.col("category"), F.lit(""))
    if exclude_stdlib:
        rows = rows.where(~category.isin(*STANDARD))
    if exclude_unknown:
        rows = rows.where(category != "unknown")
    counts = rows.groupBy(F.col("o_name").alias("name")).agg(F.min_by("category", F.struct("ord", "fact_id")).alias("category"), F.count(F.lit(1)).alias("importer_count"))
    return counts.orderBy(F.desc("importer_count"), "name").limit(limit)


def dependency_info(graph: Graph, package: str) -> DataFrame:
    """Names that match, with the category of the last fact: name, category, import_root."""
    rows = graph.edges("IMPORTS").where(F.coalesce(import_matches(package), F.lit(False)) & (F.col("o_kind") == "ExternalPackage"))
    last = F.max_by(F.struct("category", "import_root"), F.struct("ord", "fact_id"))
    return rows.groupBy(F.col("o_name").alias("name")).agg(last.alias("l")).select("name", "l.*")


def resolve_import_target(graph: Graph, query: str) -> DataFrame:
    """One row: status not_found, resolved or ambiguous, how many targets, and the target if there is one."""
    rows = graph.edges("IMPORTS", only_canonical=True).where(F.coalesce(import_matches(query), F.lit(False)))
    found = rows.groupBy("o_entity_id").agg(F.first("o_kind").alias("kind"))
    one = found.agg(F.count(F.lit(1)).alias("candidates"), F.min("o_entity_id").alias("entity_id"))
    status = F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return one.select(status.alias("status"), "candidates", F.when(F.col("candidates") == 1, F.col("entity_id")).alias("entity_id"))


def _importers(graph: Graph, query: str, limit: int) -> DataFrame:
    target = resolve_import_target(graph, query).where("status = 'resolved'").select(F.col("entity_id").alias("t"))
    rows = graph.edges("IMPORTS", only_canonical=True).join(F.broadcast(target), F.col("object_id") == F.col("t"))  # one row at most
    return rows.orderBy("s_display", "ord", "fact_id").limit(limit)


def who_imports(graph: Graph, query: str, limit: int = 25) -> DataFrame:
    """Importers of a target that the query names without doubt, by module: module, fact_id."""
    return _importers(graph, query, limit).select(F.col("s_display").alias("module"), "fact_id")


def who_imports_groups(graph: Graph, query: str, depth: int = 2, limit: int = 25) -> DataFrame:
    """The returned importers grouped by the first dotted parts of their names: prefix, n."""
    return _importers(graph, query, limit).groupBy(dotted_prefix(F.col("s_display"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(rows: DataFrame, key: str, limit: int, count: str) -> DataFrame:
    """Targets by distinct callers or importers; samples are the five first names."""
    people = rows.groupBy("object_id", "o_display", "o_kind", "s_display").agg(F.count(F.lit(1)).alias("facts"))
    grouped = people.groupBy("object_id", "o_display", "o_kind").agg(F.count(F.lit(1)).alias(count), F.sum("facts").alias("fact_count"), F.min("s_display").alias("first_sample"))
    return grouped.orderBy(F.desc(count), "o_display", "object_id").limit(limit).select(F.col("o_display").alias(key), "object_id", F.col("o_kind").alias("kind"), count, "fact_count", "first_sample")


def top_internal_dependencies(graph: Graph, relative_only: bool = False, limit: int = 25) -> DataFrame:
    """Modules of the code itself by distinct importers: module, object_id, kind, importer_count, fact_count, first_sample."""
    kinds = ("relative_internal_module",) if relative_only else INTERNAL
    rows = graph.edges("IMPORTS", only_canonical=True).where(F.col("category").isin(*kinds) & (F.col("o_kind") == "CodeModule"))
    return _ranked(rows, "module", limit, "importer_count")


def top_fan_in_symbols(graph: Graph, include_external: bool = False, limit: int = 25) -> DataFrame:
    """Called symbols by distinct callers: symbol, object_id, kind, caller_count, fact_count, first_sample."""
    rows = graph.edges("CALLS", only_canonical=True)
    if not include_external:
        rows = rows.where("o_kind = 'CodeSymbol'")
    return _ranked(rows, "symbol", limit, "caller_count")


def modules_importing_both(graph: Graph, left: str, right: str, limit: int = 25) -> DataFrame:
    """Modules that import both targets, if both are named without doubt: module, subject_id."""
    rows = graph.edges("IMPORTS", only_canonical=True).select("object_id", "subject_id", "s_display")
    sides = [rows.join(F.broadcast(resolve_import_target(graph, q).where("status = 'resolved'").select(F.col("entity_id").alias("t"))), F.col("object_id") == F.col("t")).select("subject_id", "s_display").distinct() for q in (left, right)]
    return sides[0].join(sides[1].select("subject_id"), "subject_id").orderBy("s_display", "subject_id").limit(limit).select(F.col("s_display").alias("module"), "subject_id")
