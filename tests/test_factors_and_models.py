"""Bandings, groupings, factors, GLM, diagnostics, shape models, perils, fairness."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.functions import losses
from premia.operators import banding as bd
from premia.operators import boosting as bo
from premia.operators import diagnostics as dg
from premia.operators import factors as fc
from premia.operators import fairness as fa
from premia.operators import glm
from premia.operators import grouping as gr
from premia.operators import perils as pe
from premia.operators.glm import Spec, Variant
from premia.operators.trees import tree_cuts
from tests.conftest import rows


@pytest.fixture(scope="module")
def book(spark):
    draw = random.Random(11)
    data = []
    for i in range(4000):
        area = "abc"[i % 3]
        age = 17 + draw.randrange(60)
        exposure = draw.choice([0.25, 0.5, 1.0])
        rate = 0.1 * (1 + "abc".index(area)) * (2.0 if age < 25 else 1.0)
        n = np.random.default_rng(i).poisson(rate * exposure)
        data.append((i, area, age, exposure, int(n), int(n * draw.randrange(500, 1500))))
    return spark.createDataFrame(data, "row_id long, area string, age int, exposure_years double, claim_count int, claim_amount_minor int").cache()


def test_labels():
    assert bd.band_labels([17, 21, 25, 76, 90]) == ("17-20", "21-24", "25-75", "76+")
    assert bd.band_labels([0.5, 1.0, 2.5]) == ("0.5-1", "1+")
    assert bd.band_labels([0, 10, 20], "right") == ("0-10", "10+")


def test_bands_close_on_the_declared_side(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 15.0, 20.0, 30.0, None, 31.0, -1.0)], "x double")
    left = bd.Banding("b", "x", (0.0, 10.0, 20.0, 30.0), ("A", "B", "C"), null_level="?")
    got = dict(rows(bd.apply_banding(df, left), "x", "b_band"))
    assert got == {0.0: "A", 10.0: "B", 15.0: "B", 20.0: "C", 30.0: "C", None: "?", 31.0: "C", -1.0: "A"}
    right = bd.Banding("b", "x", (0.0, 10.0, 20.0, 30.0), ("A", "B", "C"), closed="right", null_level="?", below="null_level", above="null_level")
    got = dict(rows(bd.apply_banding(df, right), "x", "b_band"))
    assert (got[0.0], got[10.0], got[20.0], got[31.0], got[-1.0]) == ("A", "A", "B", "?", "?")


def test_error_policies_stop_the_job(spark):
    df = spark.createDataFrame([(5.0,), (99.0,)], "x double")
    for b in (bd.Banding("b", "x", (0.0, 10.0), ("A",), above="error"), bd.Banding("b", "x", (0.0, 10.0), ("A",))):
        values = df if b.above == "error" else df.withColumn("x", F.nullif(F.col("x"), F.lit(5.0)))
        with pytest.raises(Exception):
            bd.apply_banding(values, b).collect()
    with pytest.raises(bd.BandingError):
        bd.Banding("b", "x", (0.0, 10.0), ("A",), below="null_level")
    with pytest.raises(bd.BandingError):
        bd.Banding("b", "x", (10.0, 0.0), ("A",))


def test_proposals_that_cannot_be_made(spark, book):
    for how in ({"column": "nope", "method": "quantile"}, {"column": "age", "method": "manual"}, {"column": "age", "method": "exposure_quantile", "exposure": "none"}):
        with pytest.raises(bd.BandingError):
            bd.propose_banding(book, n_bands=4, **how)
    constant = book.withColumn("k", F.lit(3.0))
    for method in ("equal_width", "quantile", "tree"):
        with pytest.raises(bd.BandingError):
            bd.propose_banding(constant, "k", method, 4)


def test_credibility_merges_until_bands_are_thick(book):
    b = bd.propose_banding(book, "age", "credibility", 30, params={"min_claims_per_band": 150})
    counts = [r["claim_count"] for r in bd.band_statistics(book, b).collect()]
    assert len(counts) > 1 and min(counts) >= 150


def test_tree_finds_the_step(book):
    v, w, y = map(np.array, zip(*[(r["age"], r["exposure_years"], r["claim_count"]) for r in book.collect()]))

    def sse(mask):
        m = y[mask].sum() / w[mask].sum()
        return float((w[mask] * (y[mask] / w[mask] - m) ** 2).sum())

    values = sorted(set(v))
    first = min((sse(v <= a) + sse(v > a), a, b) for a, b in zip(values, values[1:]))
    assert tree_cuts(book, "age", weight="exposure_years", target_total="claim_count", leaves=2) == [(first[1] + first[2]) / 2]
    assert 21 < first[1] < 27
    # The second split is the best one within either side of the first.
    low, high = v <= first[1], v > first[1]
    options = []
    for side, other in ((low, high), (high, low)):
        inside = sorted(set(v[side]))
        options += [(sse(side & (v <= a)) + sse(side & (v > a)) + sse(other), a, b) for a, b in zip(inside, inside[1:])]
    second = min(options)
    three = tree_cuts(book, "age", weight="exposure_years", target_total="claim_count", leaves=3)
    assert three == sorted([(first[1] + first[2]) / 2, (second[1] + second[2]) / 2])


def test_an_empty_band_always_fails(book):
    b = bd.Banding("age", "age", (0.0, 10.0, 50.0, 100.0), ("0-9", "10-49", "50+"))
    with pytest.raises(bd.BandingError, match="no row reaches"):
        bd.check_banding(book, b)
    thin = bd.Banding("age", "age", (17.0, 75.0, 100.0), ("17-74", "75+"), min_claims=10**6, on_violation="fail")
    with pytest.raises(bd.BandingError):
        bd.check_banding(book, thin)


def test_full_credibility_standard():
    assert round(gr.full_credibility_claims(0.90, 0.05)) == 1082


def test_grouping_methods_on_known_levels():
    levels = [gr.Level(n, e, c) for n, e, c in [("a", 1000.0, 100), ("b", 1000.0, 102), ("c", 900.0, 270), ("d", 1000.0, 290), ("z", 0.0, 0)]]
    for clusters in (gr._ward(levels, 2), gr._tree(levels, 2, 1)):
        assert sorted(sorted(x.name for x in c) for c in clusters) in ([["a", "b", "z"], ["c", "d"]], [["a", "b"], ["c", "d", "z"]])
    rates = gr.shrunk_rates(levels, "limited_fluctuation")
    assert rates["z"] == pytest.approx(762 / 3900)
    assert 100 / 1000 < rates["a"] < 762 / 3900
    swept = gr._sweep(levels[:4], {"a": 0.100, "b": 0.104, "c": 0.106, "d": 0.30}, 0.05)
    assert [[x.name for x in c] for c in swept] == [["a", "b"], ["c"], ["d"]]  # c is beyond 5 % of the anchor a


def test_ward_against_pairwise_search():
    draw = random.Random(3)
    levels = [gr.Level(f"l{i}", draw.uniform(1, 40), draw.randrange(1, 60)) for i in range(12)]
    got = sorted(sorted(x.name for x in c) for c in gr._ward(levels, 4))
    total = sum(x.exposure for x in levels)
    groups = [([x.name], max(1, round(100 * x.exposure / total)), x.rate) for x in levels]
    while len(groups) > 4:
        pairs = [(a[1] * b[1] / (a[1] + b[1]) * (a[2] - b[2]) ** 2, i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        a, b = groups[i], groups[j]
        merged = (a[0] + b[0], a[1] + b[1], (a[1] * a[2] + b[1] * b[2]) / (a[1] + b[1]))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
    assert got == sorted(sorted(g[0]) for g in groups)


def test_credibility_that_cannot_be_estimated():
    level = gr.Level
    for bad in ([level("a", 1.0, 1)], [level("a", 10.0, 0), level("b", 10.0, 0)], [level("a", 100.0, 10), level("b", 100.0, 11)]):
        with pytest.raises(gr.GroupingError):
            gr.buhlmann_straub(bad)


def test_unseen_and_null_levels_of_a_grouping(spark):
    df = spark.createDataFrame([("a",), ("new",)], "x string")
    g = gr.Grouping("g", "x", {"a": "G1"})
    with pytest.raises(Exception):
        gr.apply_grouping(df, g).collect()
    d = gr.Grouping("g", "x", {"a": "G1"}, "map_to_default", "G9")
    assert dict(rows(gr.apply_grouping(df, d), "x", "g_group")) == {"a": "G1", "new": "G9"}
    with pytest.raises(Exception):
        gr.apply_grouping(df.withColumn("x", F.lit(None).cast("string")), d).collect()
    with pytest.raises(gr.GroupingError):
        gr.apply_grouping(df, gr.Grouping("g", "x", {"a": "G1"}, "map_to_base"))


@pytest.mark.parametrize(
    "factors",
    [
        (fc.Factor("a", "identity", "area", intent="control"),), (fc.Factor("a", "identity", "nope"),), (fc.Factor("a", "expression", expression="age * 2"),), (fc.Factor("i", "interaction", operands=("x",)),),
        (fc.Factor("a", "identity", "age", continuous=True), fc.Factor("i", "interaction", operands=("a",))),
        (fc.Factor("a", "identity", "area"), fc.Factor("i", "interaction", operands=("a",)), fc.Factor("j", "interaction", operands=("i",))),
    ],
)
def test_factors_that_are_refused(book, factors):
    with pytest.raises(fc.FactorError):
        fc.resolve_factors(book, factors)


def test_unseen_cells_are_exact(spark):
    fitted = spark.createDataFrame([("a", "x"), ("b", "y"), ("zz", "x")], "p string, q string")
    n, names = fc.unseen_cells({"p": ["a", "b", "c"], "q": ["x", "y"]}, fitted, ["p", "q"], names=2)
    assert n == 4 and names == [("a", "y"), ("b", "x")]


def _design(book, with_age=True):
    data = book.select("area", "age", "exposure_years", "claim_count").collect()
    x = np.array([[1.0, r["area"] == "b", r["area"] == "c", r["age"] if with_age else 0.0] for r in data], float)
    return (x if with_age else x[:, :3]), np.array([r["claim_count"] for r in data], float), np.array([r["exposure_years"] for r in data])


def test_poisson_glm_against_numpy(book):
    m = glm.fit_glm(book, Spec("claim_count", "poisson", ("area",), ("age",), exposure="exposure_years"))
    x, y, e = _design(book)
    beta = np.array([math.log(y.sum() / e.sum()), 0, 0, 0])
    for _ in range(30):
        mu = e * np.exp(x @ beta)
        beta = beta + np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
    got = m.coefficient("area", "b") - m.coefficient("area", "a"), m.coefficient("area", "c") - m.coefficient("area", "a"), m.coefficient("age")
    assert got == pytest.approx((beta[1], beta[2], beta[3]), abs=1e-7)
    assert m.converged
    mu = e * np.exp(x @ beta)
    se = np.sqrt(np.linalg.inv((x * mu[:, None]).T @ x)[3, 3])
    assert math.sqrt(m.covariance()[m.index[("age", "")], m.index[("age", "")]]) == pytest.approx(se, rel=1e-5)


def test_glm_agrees_with_spark_ml(book):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    positive = book.where("claim_amount_minor > 0").withColumns({"b": (F.col("area") == "b").cast("double"), "c": (F.col("area") == "c").cast("double")})
    data = VectorAssembler(inputCols=["b", "c", "age"], outputCol="features").transform(positive)
    theirs = GeneralizedLinearRegression(family="gamma", link="log", labelCol="claim_amount_minor", weightCol="exposure_years", maxIter=100, tol=1e-10).fit(data)
    m = glm.fit_glm(positive, Spec("claim_amount_minor", "gamma", ("area",), ("age",), weight="exposure_years"))
    ours = [m.coefficient("area", k) - m.coefficient("area", "a") for k in "bc"] + [m.coefficient("age")]
    assert ours == pytest.approx(list(theirs.coefficients), abs=1e-6)


def test_variants_fit_together_as_alone(book):
    spec = Spec("claim_count", "poisson", ("area",), exposure="exposure_years")
    together = glm.fit_variants(book, spec, [Variant("plain"), Variant("ridge", penalty=100.0), Variant("none", drop="area")])
    alone = glm.fit_glm(book, spec)
    assert together[0].beta == pytest.approx(alone.beta, abs=1e-9)
    assert abs(together[1].beta[1]) < abs(alone.beta[1])
    y, e = (sum(r[c] for r in book.select(c).collect()) for c in ("claim_count", "exposure_years"))
    assert together[2].beta[0] == pytest.approx(math.log(y / e), abs=1e-8)


def test_weights_that_are_refused(spark, book):
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(glm.GlmError):
            glm.check_weights(book.withColumn("w", F.lit(bad).cast("double")), "w")
    with pytest.raises(glm.GlmError):
        glm.check_weights(book.withColumn("w", F.lit(0.0)), "w")
    kept, counts = glm.check_weights(book.withColumn("w", (F.col("row_id") % 2).cast("double")), "w")
    assert kept.count() == 2000 and counts == {"zero_weight": 2000}


def test_unseen_levels_are_not_priced(spark, book):
    m = glm.fit_glm(book, Spec("claim_count", "poisson", ("area",), exposure="exposure_years"))
    got = m.predict_interval(spark.createDataFrame([("a", 1.0), ("q", 1.0)], "area string, exposure_years double")).orderBy("area").collect()
    assert got[0]["prediction_low"] < got[0]["prediction"] < got[0]["prediction_high"] and got[0]["prediction_reason"] is None
    assert got[1]["prediction"] is None and got[1]["prediction_reason"] == "a level the fit has not seen"


def test_aliased_terms_are_named(book):
    m = glm.fit_glm(book.withColumn("twice", F.col("age") * 2), Spec("claim_count", "poisson", ("area",), ("age", "twice"), exposure="exposure_years"))
    assert glm.aliased(m) == [("twice", "")]


def test_type_three_sees_signal_and_noise(book):
    noisy = book.withColumn("coin", (F.col("row_id") % 2).cast("string"))
    got = {r["term"]: r for r in glm.type_three(noisy, Spec("claim_count", "poisson", ("area", "coin"), exposure="exposure_years"))}
    assert got["area"]["p_value"] < 1e-6 < got["coin"]["p_value"]
    assert (got["area"]["df"], got["coin"]["df"]) == (2, 1)


@pytest.mark.parametrize("phi, power", [(1.3, 1.2), (0.7, 1.5), (2.0, 1.8)])
def test_the_density_integrates_to_one(spark, phi, power):
    grid = spark.range(45000).select((F.col("id") / 1000.0 - 40.0).alias("u")).select(F.exp("u").alias("y"), F.lit(2.0).alias("mu"))
    f = losses.tweedie_log_density(phi, power)  # on a log scale, since the density may have a pole at zero
    inside = grid.agg(F.sum(F.exp(f("y", "mu")) * F.col("y") / 1000.0).alias("m")).first()["m"]
    zero = math.exp(-(2.0 ** (2 - power)) / (phi * (2 - power)))
    assert inside + zero == pytest.approx(1.0, abs=1e-3)


def test_the_power_is_found_and_an_edge_refused(spark):
    draw = np.random.default_rng(2)
    phi, p, mu = 1.0, 1.5, 2.0
    lam, tau = mu ** (2 - p) / (phi * (2 - p)), phi * (p - 1) * mu ** (p - 1)
    y = [float(draw.gamma((2 - p) / (p - 1) * n, tau)) if n else 0.0 for n in draw.poisson(lam, 4000)]
    df = spark.createDataFrame([(v, "k") for v in y], "y double, g string")
    best, _ = glm.tweedie_power(df, Spec("y", "tweedie", ()), [1.2, 1.35, 1.5, 1.65, 1.8])
    assert best == 1.5
    with pytest.raises(glm.GlmError):
        glm.tweedie_power(df, Spec("y", "tweedie", ()), [1.6, 1.7, 1.8])


def test_losses_check_their_parameters(spark):
    one = spark.createDataFrame([(2.0, 0.5)], "y double, f double")
    value = lambda n, p=None: one.select(losses.template_loss(n, "y", "f", p).alias("x")).first()["x"]
    assert value("quantile", {"tau": 0.8}) == pytest.approx(0.8 * 1.5)
    assert value("poisson") == pytest.approx(math.exp(0.5) - 1.0)
    for bad in (("quantile", None), ("nope", None), ("poisson", {"tau": 1})):
        with pytest.raises(ValueError):
            value(*bad)
    assert one.select(losses.ln_factorial(F.lit(25)).alias("x")).first()["x"] == pytest.approx(math.lgamma(26), rel=1e-12)


def test_gini_of_a_perfect_and_a_flat_order(spark):
    df = spark.createDataFrame([(float(i), float(i), 1.0, 7.0) for i in range(1, 11)], "p double, a double, e double, k double")
    own, normal = dg.normalised_gini(df, actual="a", predicted="p", exposure="e")
    assert normal == pytest.approx(1.0) and own == pytest.approx(0.3)
    assert dg.gini(df, actual="a", order="k", exposure="e") == pytest.approx(0.0)
    assert dg.gini(df.withColumn("a", F.lit(0.0)), actual="a", order="p", exposure="e") is None


def test_leaders_and_ties():
    assert dg.leader({"a": 0.2, "b": 0.3}, "higher") == "b"
    assert dg.leader({"a": 0.2, "b": 0.2}, "lower") is None
    assert dg.leader({"a": 0.9, "b": 1.05}, "closer_to_one") == "b"
    assert dg.leader({"a": None, "b": None}, "higher") is None
    assert dg.leader({"a": 1.0}, "none") is None


def test_comparisons_share_their_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, 0.4), (0, 1.0, 0.2, None), (1, 1.0, 0.9, 0.8)], "a int, e double, p double, q double")
    got = dg.compare_models(df, {"p": "p", "q": "q"}, actual="a", exposure="e")
    assert {r["value"] for r in got.where("metric = 'rows'").collect()} == {2.0}
    with pytest.raises(dg.DiagnosticsError):
        dg.compare_models(df, {"p": "p"}, actual="a", exposure="e")
    with pytest.raises(dg.DiagnosticsError):
        dg.backtest(df, None, actual="a", exposure="e", factors=[], trained_on="v1", version="v1", tie="a")


def test_a_permutation_keeps_the_values(book):
    moved = dg.permuted(book.select("row_id", "age"), "age", "row_id", 3, rows_per_block=500)
    before, after = dict(rows(book, "row_id", "age")), dict(rows(moved, "row_id", "age"))
    assert sorted(before.values()) == sorted(after.values())
    assert sum(before[k] != after[k] for k in before) > 3000
    assert after == dict(rows(dg.permuted(book.select("row_id", "age").repartition(3), "age", "row_id", 3, rows_per_block=500), "row_id", "age"))


def test_shape_models_learn_and_refuse(spark, book):
    features = bo.make_features(book, ["area"], ["age"], 8)
    m = bo.fit_shapes(book, features, response="claim_count", exposure="exposure_years", rounds=8)
    assert all(b <= a + 1e-9 for a, b in zip(m.curve, m.curve[1:]))
    table = dict(zip(features["area"].levels, m.shapes["area"]))
    assert table["a"] < table["b"] < table["c"]
    with pytest.raises(Exception):
        m.score(spark.createDataFrame([("q", 30)], "area string, age int"), "s").collect()
    with pytest.raises(bo.BoostingError):
        bo.fit_shapes(book.withColumn("area", F.lit("q")), features, response="claim_count")


def test_a_user_loss_can_be_boosted(book):
    features = bo.make_features(book, ["area"], [], 8)
    same = bo.fit_shapes(book, features, response="claim_count", exposure="exposure_years", gradient=bo.GRADIENTS["poisson"], rounds=3)
    own = bo.fit_shapes(book, features, response="claim_count", exposure="exposure_years", rounds=3)
    assert same.shapes["area"] == pytest.approx(own.shapes["area"], abs=1e-9)


def test_perils(spark):
    df = spark.createDataFrame([(0.1, 1000.0, 50.0, 140.0, 1.0, 1), (0.2, 1000.0, 30.0, None, 1.0, 2), (0.1, 500.0, 20.0, 100.0, 1.0, 1)], "f double, s double, b double, o double, e double, n int")
    perils = [pe.Peril("fire", "frequency_severity", "f", "s", large_loss="capped", loading=1.1), pe.Peril("theft", "burning_cost", burning_cost="b")]
    out = pe.assemble_risk_premium(df, perils)
    assert [round(r[0], 6) for r in out.select("risk_premium").collect()] == [160.0, 250.0, 75.0]
    r = pe.reconcile(out, {"fire": "capped", "theft": "none"}, observed="o", exposure="e", tolerance="0.5", claims="n")
    assert r["imputed_rows"] == 1 and r["observed_burning_cost"] == 160 and r["modelled_burning_cost"] == 128 + 33
    for bad in ([], perils[:1] * 2, [pe.Peril("x", "frequency_severity", "f")], [pe.Peril("x", "burning_cost", burning_cost="b", large_loss="separate_model")]):
        with pytest.raises(pe.PerilError):
            pe.assemble_risk_premium(df, bad)
    with pytest.raises(Exception):
        pe.assemble_risk_premium(df.withColumn("b", F.lit(-1.0)), perils).collect()
    for how in ({"tolerance": "0"}, {"tolerance": "0.1", "claims": None}):
        with pytest.raises(pe.PerilError):
            pe.reconcile(out, {"fire": "capped", "theft": "none"}, observed="o", exposure="e", **{"claims": "n", **how})
    with pytest.raises(pe.PerilError):
        pe.reconcile(out, {"fire": "capped"}, observed="o", exposure="e", tolerance="0.1", claims="n")


def test_proxies_against_a_replicated_frame(spark):
    df = spark.createDataFrame([("k1", "u", 1.0), ("k1", "v", 2.0), ("k2", "u", 3.0), ("k9", "u", 4.0)], "k string, level string, exposure_years double")
    shares = spark.createDataFrame([("k1", 0.75, 0.25), ("k2", 0.25, 0.75)], "k string, a double, b double")
    got, coverage = fa.assess_proxies(df, ["level"], shares, key="k", reference_key="k", classes=["a", "b"])
    joint = np.array([[1 * 0.75 + 3 * 0.25, 1 * 0.25 + 3 * 0.75], [2 * 0.75, 2 * 0.25]])  # u, v
    p = joint / joint.sum()
    mi = float((p * np.log2(p / np.outer(p.sum(1), p.sum(0)))).sum())
    row = {r["class"]: r for r in got.collect()}
    assert row["a"]["mutual_information_bits"] == pytest.approx(mi)
    pos, neg = joint[:, 0], joint[:, 1]  # v scores above u for class a
    auc = (pos[1] * neg[0] + 0.5 * (pos * neg).sum()) / (pos.sum() * neg.sum())
    assert row["a"]["auc"] == pytest.approx(auc)
    assert coverage.first()["coverage"] == pytest.approx(0.6)


@pytest.mark.parametrize("data", [[("k", 0.5, 0.4)], [("k", -0.1, 1.1)], [("k", None, 1.0)], [("k", 0.5, 0.5), ("k", 0.5, 0.5)]])
def test_shares_that_are_refused(spark, data):
    df = spark.createDataFrame([("k", "u", 1.0)], "k string, level string, exposure_years double")
    with pytest.raises(fa.ProxyError):
        fa.assess_proxies(df, ["level"], spark.createDataFrame(data, "k string, a double, b double"), key="k", reference_key="k", classes=["a", "b"])
