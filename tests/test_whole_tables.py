"""Answers that must not depend on a prefix, a cap or the size of the input."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest

from premia.functions.special import LARGE_SHAPE, gamma_cdf, gamma_ppf
from premia.operators import diagnostics as dg
from premia.operators import governance as gv
from premia.operators import grouping, ingest, monitor, perils, prepare, splits
from premia.operators import profile as prof
from premia.operators import rate_tables as rt
from premia.operators import reference as ref
from premia.operators import regression as rg
from premia.operators.glm import Glm, GlmError, Spec, Variant, fit_variants, type_three


def test_large_gamma_shapes():
    for n in (1e3, 1e5, 1e7, 1e9, 1e12):
        # the expansion of P(n, n) in powers of 1 / n
        expected = 0.5 + (1 / 3 + 1 / (540 * n)) / math.sqrt(2 * math.pi * n)
        assert gamma_cdf(n, n) == pytest.approx(expected, abs=1e-10)
    shapes = np.array([5.0, 900.0, 999.9, LARGE_SHAPE, 1e6, 1e8, 1e11])
    for p in (0.005, 0.025, 0.5, 0.975):
        x = gamma_ppf(p, shapes)
        assert np.allclose(gamma_cdf(shapes, x), p, atol=1e-9)
        assert np.all(np.diff(x) > 0)
    low = (gamma_ppf(0.025, np.array([1e9]))[0] - 1e9) / math.sqrt(1e9)
    assert low == pytest.approx(-1.95996, abs=1e-3)
    assert gamma_cdf(999.999, 1010.0) == pytest.approx(gamma_cdf(1000.0, 1010.001), abs=1e-5)


def test_a_date_format_must_fit_every_row(spark):
    df = spark.range(600).selectExpr("CASE WHEN id < 500 THEN '2024-01-05' ELSE 'not a date' END AS d")
    assert ingest.sniff_date_format(df, "d") is None
    assert ingest.sniff_date_format(df.where("d <> 'not a date'"), "d") == "%Y-%m-%d"


def test_profiles_are_compared_over_all_levels(spark):
    now = spark.range(3000).selectExpr("CAST(id % 60 AS STRING) AS k", "CAST(id AS DOUBLE) AS v", "CAST(NULL AS STRING) AS e")
    before = spark.range(1500).selectExpr("CAST(id % 50 AS STRING) AS k", "CAST(id AS DOUBLE) + 1 AS v", "CAST(NULL AS STRING) AS e")
    found = {r["column"]: r for r in prof.compare_profiles(now, before, ["k", "v", "e"]).collect()}
    assert (found["k"]["new_levels"], found["k"]["vanished_levels"]) == (10, 0)
    a, b = 1 / 60, 1 / 50
    assert found["k"]["psi"] == pytest.approx(50 * (a - b) * math.log(a / b) + 10 * (a - 1e-6) * math.log(a / 1e-6))
    assert found["v"]["mean_shift"] == pytest.approx(1499.5 - 750.5)
    assert found["k"]["mean_shift"] is None and found["k"]["row_count_ratio"] == 2
    assert found["e"]["psi"] is None and found["e"]["null_rate_shift"] == 0 and found["e"]["new_levels"] == 0
    plan = prof.compare_profiles(now, before, ["k", "v", "e"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") <= 4


def test_one_index_for_several_weights(spark):
    cur = spark.createDataFrame([("c", "x", 3, 1.0), ("c", "y", 1, 2.0), ("c", None, 9, 9.0), ("d", "x", 1, 1.0)], "column string, level string, n long, w double")
    old = spark.createDataFrame([("c", "x", 1, 1.0), ("c", "z", 1, 0.0)], "column string, level string, n long, w double")
    both = {r["column"]: r for r in prof.psi_by(cur, old, ["column"], {"p": "n", "q": "w"}).collect()}
    share = lambda a, b: (max(a, 1e-6) - max(b, 1e-6)) * math.log(max(a, 1e-6) / max(b, 1e-6))
    assert both["c"]["p"] == pytest.approx(share(0.75, 0.5) + share(0.25, 0) + share(0, 0.5))
    assert both["c"]["q"] == pytest.approx(share(1 / 3, 1) + share(2 / 3, 0) + share(0, 0))
    assert both["d"]["p"] is None


def test_percentiles_are_exact_above_ten_thousand_values(spark):
    df = spark.range(1, 40_001).selectExpr("id AS ms", "'ok' AS outcome", "1 AS p")
    r = monitor.operational(df, df["p"], [], latency="ms", outcome="outcome").first()
    assert (r["p50"], r["p95"], r["p99"]) == (20_000, 38_000, 39_600)


def test_one_overlap_rule_for_both_sizes(spark, monkeypatch):
    day = dt.date
    rows = [("k", day(2020, 1, 1), day(2021, 1, 1)), ("k", day(2020, 6, 1), day(2020, 6, 1)), ("m", day(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "key string, effective_from date, effective_to date")
    torn = df.unionAll(spark.createDataFrame([("m", day(2022, 1, 1), None)], df.schema))
    for limit in (50_000, 1):
        monkeypatch.setattr(ref, "BROADCAST_ROWS", limit)
        ref.refuse_overlaps(df, ["key"])
        with pytest.raises(ref.ReferenceError):
            ref.refuse_overlaps(torn, ["key"])


def test_a_recipe_keeps_claims_it_cannot_link(spark):
    day = dt.date
    exposure = spark.createDataFrame(
        [(1, "p", day(2020, 1, 1), day(2020, 7, 1)), (2, "p", day(2020, 6, 1), day(2021, 1, 1))],
        "period_id int, policy_id string, exposure_start date, exposure_end date",
    )
    claims = spark.createDataFrame(
        [(1, "p", "2020-02-01"), (2, "p", "2020-06-15"), (3, "p", "2023-01-01"), (4, "p", "soon"), (5, None, "2020-02-01")],
        "claim int, policy_id string, date_of_loss string",
    )
    steps = [
        {"step": "cast", "table": "claims", "params": {"columns": {"date_of_loss": "date"}}},
        {"step": "attach_claims", "table": "claims", "params": {"exposure": "exposure"}},
    ]
    done = prepare.apply_recipe({"exposure": exposure, "claims": claims}, steps, row_keys={"claims": "claim"})
    ids = lambda df: sorted(r["claim"] for r in df.collect())
    assert ids(done.tables["claims"]) == [1]
    assert ids(done.tables["claims_multi_linked"]) == [2]
    assert ids(done.tables["claims_unlinked"]) == [3, 5]
    assert [r["claim"] for r in done.rejected["claims"].collect()] == ["4"]


def test_lineage_has_no_depth_limit(spark, monkeypatch):
    monkeypatch.setattr(gv, "cut_lineage", lambda df: spark.createDataFrame(df.collect(), df.schema))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(9, 1)], "parent int, child int")
    assert sorted(r["node"] for r in gv.lineage(edges, [9]).collect()) == list(range(1, 9))


@pytest.mark.parametrize("kind", ["long", "double", "date"])
def test_folds_put_missing_times_first(spark, kind):
    times = {"long": "id * 3", "double": "id / 7D", "date": "date_add(DATE '2020-01-01', CAST(id AS INT))"}[kind]
    df = spark.range(50).selectExpr("id", f"CASE WHEN id % 3 <> 0 THEN {times} END AS t")
    found = {r["id"]: r["fold"] for r in splits.assign_folds(df, method="temporal", folds=4, time="t", tie="id").collect()}
    order = sorted(range(50), key=lambda i: (i % 3 != 0, i))
    assert found == {i: rank * 4 // 50 for rank, i in enumerate(order)}


def test_repeated_edits_change_nothing(spark):
    cells = spark.createDataFrame([("a", Decimal("1.0")), ("b", Decimal("2.0"))], "k string, relativity decimal(18,6)")
    edits = spark.createDataFrame([("a", "3"), ("a", "4"), ("b", "5")], "k string, relativity string")
    out, issues = rt.apply_edits(cells, edits, ["k"])
    assert sorted((r["k"], float(r["relativity"])) for r in out.collect()) == [("a", 1.0), ("b", 5.0)]
    assert sorted((r["issue"], r["detail"]) for r in issues.collect()) == [("repeated_key", "3"), ("repeated_key", "4")]


def test_a_level_has_one_parent(spark):
    df = spark.createDataFrame([("x",), ("y",)], "k string")
    tree = spark.createDataFrame([("x", "A"), ("x", "A"), ("y", "B")], "l string, p string")
    up = grouping.group_by_hierarchy(df, "k", tree, level="l", parent="p", name="g")
    assert sorted(tuple(r) for r in up.collect()) == [("x", "A"), ("y", "B")]
    with pytest.raises(grouping.GroupingError):
        grouping.group_by_hierarchy(df, "k", tree.unionAll(spark.createDataFrame([("x", "C")], tree.schema)), level="l", parent="p", name="g")


@pytest.mark.parametrize("link", ["log", "identity", "logit"])
def test_partial_dependence_for_every_link(spark, link):
    rng = np.random.default_rng(4)
    level, x = rng.integers(0, 3, 400), rng.normal(size=400)
    df = spark.createDataFrame([("abc"[a], float(b), 1.0) for a, b in zip(level, x)], "f string, x double, exposure_years double")
    model = Glm(Spec("y", "poisson", ("f",), ("x",), link=link), {"f": ["a", "b", "c"]}, np.array([0.4, -0.9, 0.7, 0.8]), np.eye(4), 1, True)
    inverse = {"log": np.exp, "identity": lambda e: e, "logit": lambda e: 1 / (1 + np.exp(-e))}[link]
    found = {r["level"]: r["mean_prediction"] for r in dg.partial_dependence(df, model, "f").collect()}
    for name, b in (("a", 0.0), ("b", -0.9), ("c", 0.7)):
        assert found[name] == pytest.approx(inverse(0.4 + b + 0.8 * x).mean(), rel=1e-9)


def _counts(spark):
    rng = np.random.default_rng(8)
    rows = [("abc"[i % 3], "uvw"[i % 3], float(rng.poisson(1 + i % 3)), 1.0) for i in range(300)]
    return spark.createDataFrame(rows, "f string, g string, y double, e double")


def test_aliased_columns_are_no_degrees_of_freedom(spark):
    found = {r["term"]: r for r in type_three(_counts(spark), Spec("y", "poisson", ("f", "g"), exposure="e"))}
    assert (found["f"]["df"], found["g"]["df"]) == (0, 0) and found["g"]["p_value"] is None


def test_a_fit_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("premia.operators.glm.MAX_ITERATIONS", 2)
    with pytest.raises(GlmError, match="full"):
        fit_variants(_counts(spark), Spec("y", "poisson", ("f",), exposure="e"), [Variant("full")])


def test_grids_are_repeatable_and_keep_their_bounds():
    grid = rg.monotone_grid(0, 1000, integer=True, seed=1, name="x")
    assert grid == sorted(set(grid)) == rg.monotone_grid(0, 1000, integer=True, seed=1, name="x")
    assert (grid[0], grid[-1]) == (0, 1000) and rg.GRID_POINTS <= len(grid) <= rg.GRID_POINTS + rg.SAMPLED_POINTS
    assert rg.monotone_grid(0, 1000, integer=True, seed=2, name="x") != grid
    cents = rg.monotone_grid("0.10", "0.20", integer=False, seed=1, name="x")
    assert (cents[0], cents[-1]) == (Decimal("0.10"), Decimal("0.20")) and len(cents) <= 11


def test_imputed_shares_are_rounded_half_to_even(spark):
    df = spark.createDataFrame([(100.0, 1), (None, 2), (300.0, 3)], "o double, n int")
    filled, told = perils.impute_unknown(df, "o", "n")
    assert told == {"imputed_rows": 1, "imputed_share": Decimal("0.333333")}
    assert sorted(r["o"] for r in filled.collect()) == [100.0, 200.0, 300.0]
