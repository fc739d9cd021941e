"""Families of risk: what sets each off and what does not, review by review."""

from __future__ import annotations

from graphledger.operators import hypotheses

INPUTS = {
    "reviews": "review string, low_coverage boolean",
    "files": "review string, path string",
    "symbols": "review string, symbol string, path string",
    "edges": "review string, side string, subject string, object string, call string",
    "signals": "review string, family string, symbol string, path string",
    "sections": "review string, section string, n int",
}


def judged(spark, **given):
    rows = {name: spark.createDataFrame(given.get(name, []), schema) for name, schema in INPUTS.items()}
    return {(r["review"], r["risk_type"]): r for r in hypotheses.hypotheses(**rows).collect()}


def test_frontend_families(spark):
    got = judged(
        spark,
        reviews=[("a", False), ("b", None), ("c", False)],
        symbols=[("a", "m.List", "ui/List.tsx"), ("a", "m.useOrders", "ui/hooks.ts"), ("b", "m.List", "ui/List.py"), ("b", "m.user", "ui/u.ts"), ("c", "m.useIt", None), (None, "x", "y")],
        edges=[("a", "caller", "n.Page", "m.useOrders", None), ("a", "caller", "n.App", "m.List", None), ("b", "caller", "n.App", "m.List", None), ("c", "caller", None, None, None)],
    )
    assert {k: (r["specificity"], r["confidence"], r["leads"]) for k, r in got.items()} == {
        ("a", "component_list_render_identity_drift"): ("medium", "medium", 2),
        ("a", "hook_gate_render_mismatch"): ("medium", "medium", 2),
        ("a", "direct_call_contract_drift"): ("low", "medium", 2),
        ("b", "direct_call_contract_drift"): ("low", "medium", 1),
        ("c", "direct_call_contract_drift"): ("low", "medium", 1),
    }


def test_signals_on_symbols_and_on_paths(spark):
    got = judged(
        spark,
        reviews=[("a", False), ("b", False), ("c", False)],
        files=[("b", "src/x.ts"), ("c", "src/z.ts"), ("c", None)],
        symbols=[("a", "m.f", "src/x.ts")],
        signals=[("a", "unawaited_async_call", "m.f", None), ("b", "unawaited_async_call", "m.g", "./src/x.ts"), ("b", "call_result_identity_comparison", "m.g", "src/x.ts"), ("c", "swallowed_exception", "m.h", "src/y.ts"), ("c", None, None, None)],
    )
    assert {k: (r["specificity"], r["confidence"]) for k, r in got.items()} == {
        ("a", "async_side_effect_lifecycle_drift"): ("high", "weak"),
        ("b", "async_side_effect_lifecycle_drift"): ("medium", "weak"),
        ("b", "call_result_identity_comparison_semantics"): ("high", "weak"),
    }


def test_low_coverage_sections_and_destruction(spark):
    got = judged(
        spark,
        reviews=[("low", True), ("s", False), ("d", False), ("t", False)],
        files=[("low", "a.scss"), ("low", "tests/a.py"), ("t", "tests/a.py"), ("d", "Dockerfile")],
        symbols=[("low", "m.f", "a.py"), ("d", "m.f", "a.py"), ("t", "m.f", "a.py")],
        edges=[(r, "callee", "m.f", "db.x", "Model.deleteMany") for r in ("low", "d", "t")] + [("s", "callee", "m.g", "db.x", "delete")],
        sections=[("s", "views", 2), ("s", "runtime_facts", 1), ("s", "other", 9), ("low", "views", 1)],
    )
    assert {k[1] for k in got if k[0] == "low"} == {"low_coverage_stylesheet_gap"}
    assert {k[1]: r["confidence"] for k, r in got.items() if k[0] == "s"} == {"framework_contract_drift": "weak", "application_surface_contract_drift": "weak"}
    assert {k[1] for k in got if k[0] == "d"} == {"destructive_mutation_test_gap", "direct_call_contract_drift", "test_or_config_masks_runtime_change"}
    assert {k[1] for k in got if k[0] == "t"} == {"test_locks_in_regression", "direct_call_contract_drift", "test_or_config_masks_runtime_change"}
    assert got["d", "destructive_mutation_test_gap"]["place"] == 1


def test_all_leads_count(spark):
    got = judged(
        spark,
        reviews=[("a", False)],
        files=[("a", "tests/a.py")],
        symbols=[("a", "m.f", "src/m.py")] * 3,
        edges=[("a", "caller", "n.g", "m.f", None)] * 11,
    )
    # Eleven and fourteen leads: more of them go first, although the name and the confidence say otherwise.
    assert {k[1]: (r["leads"], r["place"]) for k, r in got.items()} == {"test_locks_in_regression": (14, 1), "direct_call_contract_drift": (11, 2), "test_or_config_masks_runtime_change": (3, 3)}


def test_no_inputs(spark):
    assert judged(spark) == {}
