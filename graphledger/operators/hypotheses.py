"""What a change may break: one row for each review and family of risk whose trigger holds.

Many reviews are judged at once. Every input is first reduced to counts of a
review, so what is joined has one row a review; edges meet changed symbols by
the last part of their names within a review.

Inputs, all with a `review` column:
reviews (low_coverage), files (path), symbols (symbol, path), edges (side: caller or callee, subject, object, call),
signals (family, symbol, path), sections (section, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphledger.functions.exprs import is_test_path, strict_path
from graphledger.operators.review import CONFIDENCE_RANK, SPECIFICITY_RANK

# Fixed values that results depend on.
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".ini", ".env")
CONFIG_NAMES = ("Dockerfile",)
STYLESHEET_EXTENSIONS = (".css", ".scss", ".sass", ".less")
COMPONENT_EXTENSIONS = (".tsx", ".jsx")
HOOK_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
FRAMEWORK_SECTIONS = ("changed_models", "model_fields", "model_relations", "serializers", "views", "tasks")
RUNTIME_SECTIONS = ("endpoints", "endpoint_consumers", "event_channels", "deploy_mappings")
APPLICATION_SECTIONS = ("same_repo_surfaces", "runtime_facts")
ASYNC_SIGNALS = ("async_callback_in_iteration", "unawaited_async_call")
DESTRUCTIVE_CALLS = ("delete", "deletemany", "deleteone", "destroy")
MOST = 5


def _extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "[/\\\\]"), -1)
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def is_config(path: Column) -> Column:
    return _extension(path).isin(*CONFIG_EXTENSIONS) | F.element_at(F.split(path, "[/\\\\]"), -1).isin(*CONFIG_NAMES)


def is_component(name: Column) -> Column:
    return _last(name).rlike(r"^\p{Lu}")


def is_hook(name: Column) -> Column:
    return _last(name).rlike(r"^use\p{Lu}")


def _count(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def _symbols(symbols: DataFrame) -> DataFrame:
    path = F.coalesce("path", F.lit(""))
    rows = symbols.where("symbol IS NOT NULL").select("review", "symbol", path.alias("path"))
    return rows.select(
        "*",
        _last(F.col("symbol")).alias("name"),
        (~is_test_path(path)).alias("code"),
        (is_component(F.col("symbol")) & _extension(path).isin(*COMPONENT_EXTENSIONS)).alias("component"),
        (is_hook(F.col("symbol")) & _extension(path).isin(*HOOK_EXTENSIONS)).alias("hook"),
    )


def _edge_counts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each review how many edges there are, and how many touch changed symbols of some kinds."""
    names = symbols.groupBy("review", "name").agg(*(F.max(c).alias(c) for c in ("code", "component", "hook")))
    rows = edges.select("review", "side", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("object", F.lit("")).alias("object"), F.coalesce("call", F.lit("")).alias("call"))
    rows = rows.withColumn("s_name", _last(F.col("subject"))).withColumn("o_name", _last(F.col("object")))
    for end in "so":
        rows = rows.join(names.select("review", F.col("name").alias(f"{end}_name"), *(F.col(c).alias(f"{end}_{c}") for c in ("code", "component", "hook"))), ["review", f"{end}_name"], "left")
    touches = lambda kind: F.coalesce(F.col(f"s_{kind}"), F.lit(False)) | F.coalesce(F.col(f"o_{kind}"), F.lit(False))
    consumer = lambda a, b: F.coalesce(F.col(f"{a}_hook"), F.lit(False)) & (is_component(F.col(f"{b}_name")) | is_hook(F.col(f"{b}_name")))
    destructive = (F.col("side") == "callee") & F.col("s_code").isNotNull() & _last(F.lower("call")).isin(*DESTRUCTIVE_CALLS)
    return rows.groupBy("review").agg(F.count(F.lit(1)).alias("edges"), _count(touches("code"), "code_edges"), _count(touches("component"), "component_edges"), _count(consumer("s", "o") | consumer("o", "s"), "hook_edges"), _count(destructive, "destructive"))


def _signal_counts(signals: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Signals on a changed symbol, or on a changed path."""
    changed = symbols.select("review", "symbol").distinct().withColumn("direct", F.lit(True))
    paths = files.select("review", strict_path(F.col("path")).alias("path")).unionByName(symbols.select("review", strict_path(F.col("path")).alias("path")))
    paths = paths.where("path <> ''").distinct().withColumn("near", F.lit(True))
    rows = signals.select("review", "family", "symbol", strict_path(F.col("path")).alias("path")).join(changed, ["review", "symbol"], "left").join(paths, ["review", "path"], "left")
    direct, any_ = F.coalesce("direct", F.lit(False)), F.coalesce("direct", "near", F.lit(False))
    family = {"async": F.col("family").isin(*ASYNC_SIGNALS), "swallowed": F.col("family") == "swallowed_exception", "identity": F.col("family") == "call_result_identity_comparison"}
    return rows.groupBy("review").agg(*(_count(is_it & any_, name) for name, is_it in family.items()), _count(family["async"] & direct, "async_direct"))


def hypotheses(reviews: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, signals: DataFrame, sections: DataFrame) -> DataFrame:
    """review, risk_type, specificity, confidence, leads (all of them) and place, at most five a review.

    Order is by specificity, leads, confidence and name. A review with low coverage has the stylesheet family alone.
    Nulls count as absent; a review without inputs has no row.
    """
    files = files.where("path IS NOT NULL")
    changed = _symbols(symbols)
    is_test = is_test_path(F.col("path"))
    per_file = files.groupBy("review").agg(_count(is_test, "tests"), _count(is_test | is_config(F.col("path")), "tests_or_configs"), _count(_extension(F.col("path")).isin(*STYLESHEET_EXTENSIONS), "styles"))
    per_symbol = changed.groupBy("review").agg(F.count(F.lit(1)).alias("symbols"), *(_count(F.col(c), f"{c}_symbols") for c in ("code", "component", "hook")))
    part = lambda names, out: F.sum(F.when(F.col("section").isin(*names), F.col("n")).otherwise(0)).alias(out)
    per_section = sections.groupBy("review").agg(part(FRAMEWORK_SECTIONS, "framework"), part(RUNTIME_SECTIONS, "runtime"), part(APPLICATION_SECTIONS, "application"))
    rows = reviews.select("review", F.coalesce("low_coverage", F.lit(False)).alias("low")).distinct()
    for counts in (per_file, per_symbol, _edge_counts(edges, changed), _signal_counts(signals, changed, files), per_section):
        rows = rows.join(counts, "review", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    surface = n("framework") + n("runtime") + n("application") > 0
    strength = lambda condition, yes="medium", no="weak": F.when(condition, yes).otherwise(no)
    signalled = strength((n("symbols") > 0) & (n("edges") > 0))
    led = strength(n("symbols") > 0)
    families = [  # name, specificity, trigger, confidence, leads
        ("direct_call_contract_drift", "low", (n("symbols") > 0) & (n("edges") > 0), strength(surface, "strong", "medium"), n("edges")),
        ("framework_contract_drift", "low", n("framework") > 0, led, n("symbols")),
        ("runtime_endpoint_or_event_contract_drift", "low", n("runtime") > 0, led, n("symbols")),
        ("application_surface_contract_drift", "low", n("application") > 0, led, n("symbols")),
        ("test_or_config_masks_runtime_change", "low", (n("tests_or_configs") > 0) & (n("symbols") + n("edges") > 0), F.lit("weak"), n("symbols")),
        ("test_locks_in_regression", "low", (n("tests") > 0) & (n("code_edges") > 0), F.lit("weak"), n("code_symbols") + n("code_edges")),
        ("component_list_render_identity_drift", "medium", n("component_edges") > 0, F.lit("medium"), n("component_symbols") + n("component_edges")),
        ("hook_gate_render_mismatch", "medium", n("hook_symbols") > 0, strength(n("hook_edges") > 0), n("hook_symbols") + n("hook_edges")),
        ("destructive_mutation_test_gap", "medium", (n("destructive") > 0) & (n("tests") == 0), led, n("destructive")),
        ("async_side_effect_lifecycle_drift", strength(n("async_direct") > 0, "high", "medium"), n("async") > 0, signalled, n("async")),
        ("swallowed_exception_state_drift", "high", n("swallowed") > 0, signalled, n("swallowed")),
        ("call_result_identity_comparison_semantics", "high", n("identity") > 0, signalled, n("identity")),
    ]
    families = [(name, specificity, ~F.col("low") & trigger, confidence, leads) for name, specificity, trigger, confidence, leads in families]
    families.append(("low_coverage_stylesheet_gap", "low", F.col("low") & (n("styles") > 0), F.lit("weak"), n("symbols")))
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    one = lambda name, specificity, trigger, confidence, leads: F.when(trigger, F.struct(F.lit(name).alias("risk_type"), as_column(specificity).alias("specificity"), confidence.alias("confidence"), leads.cast("long").alias("leads")))
    found = rows.select("review", F.explode(F.array_compact(F.array(*(one(*f) for f in families)))).alias("h")).select("review", "h.*")
    rank = lambda column, ranks: F.element_at(F.create_map(*(F.lit(v) for pair in ranks.items() for v in pair)), F.col(column))
    order = Window.partitionBy("review").orderBy(rank("specificity", SPECIFICITY_RANK), F.desc("leads"), F.desc(rank("confidence", CONFIDENCE_RANK)), "risk_type")  # 13 rows a review at most
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)
