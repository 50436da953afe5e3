"""Sums by partition: models with numbers and offsets, shapes, and proxies, against NumPy."""

import math

import numpy as np
import pytest

from premia.operators import fairness as fa
from premia.operators import glm
from premia.operators.glm import GlmError, Spec, Variant
from premia.operators.partials import FAN, tree_sum


def test_tree_sum_merges_many_partitions(spark, monkeypatch):
    df = spark.range(1000).repartition(FAN * 2 + 3)
    add = lambda batch: np.array([batch.num_rows, int(sum(batch.column(0).to_pylist()))])
    assert tree_sum(df, add, np.int64).tolist() == [1000, 499500]
    assert tree_sum(df, add, np.int64, size=1 << 30).tolist() == [1000, 499500]  # two at a time
    assert tree_sum(df.where("id < 0"), add) is None


def _irls(x, y, w, offset, rounds=60):
    """Poisson coefficients by weighted least squares."""
    b = np.zeros(x.shape[1])
    b[0] = math.log((w * y).sum() / (w * np.exp(offset)).sum())
    for _ in range(rounds):
        eta = x @ b + offset
        mu = np.exp(eta)
        z = eta - offset + (y - mu) / mu
        b = np.linalg.solve((x * (w * mu)[:, None]).T @ x, (x * (w * mu)[:, None]).T @ z)
    return b


def _rows(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    area, age, power = rng.integers(0, 3, n), rng.normal(40, 10, n), rng.normal(0, 1, n)
    exposure = rng.uniform(0.2, 1, n)
    mu = exposure * np.exp(-1 + 0.3 * (area == 1) - 0.4 * (area == 2) + 0.01 * (age - 40) + 0.2 * power)
    return area, age, power, exposure, rng.poisson(mu), mu


def test_numbers_and_offsets_match_numpy(spark):
    area, age, power, exposure, y, _ = _rows()
    base = 0.1 * power
    df = spark.createDataFrame([(f"a{a}", float(g), float(p), float(e), int(c), float(o)) for a, g, p, e, c, o in zip(area, age, power, exposure, y, base, strict=True)],
                               "area string, age double, power double, exposure_years double, claims int, base double").repartition(7)
    m = glm.fit_glm(df, Spec("claims", "poisson", ("area",), ("age", "power"), exposure="exposure_years", offset="base"))
    first = m.levels["area"][0]
    others = m.levels["area"][1:]
    x = np.column_stack([np.ones(len(y)), *[np.array([f"a{a}" == level for a in area], float) for level in others], age, power])
    want = _irls(x, y, np.ones(len(y)), np.log(exposure) + base)
    got = [m.coefficient("area", first) + m.beta[0], *[m.coefficient("area", level) for level in others], m.coefficient("age"), m.coefficient("power")]
    assert np.allclose(got, want, atol=1e-7)
    mu = np.exp(x @ want + np.log(exposure) + base)
    assert np.allclose(m.gram, (x * mu[:, None]).T @ x, rtol=1e-5)


def test_an_iteration_keeps_one_array_for_each_partition(spark, monkeypatch):
    area, age, power, exposure, y, _ = _rows(500)
    df = spark.createDataFrame([(float(g), int(c)) for g, c in zip(age, y, strict=True)], "age double, claims int").repartition(5)
    seen = []
    real = glm.tree_sum
    monkeypatch.setattr(glm, "tree_sum", lambda df, part, **more: seen.append((df._jdf.queryExecution().executedPlan().toString(), more["size"])) or real(df, part, **more))
    glm.fit_glm(df, Spec("claims", "poisson", (), ("age",)))
    assert seen and all("Aggregate" not in plan and "Exchange" not in plan for plan, _ in seen)
    assert {size for _, size in seen} == {8 * (2 * 2 + 2 + 1)}  # p columns: p * p products, p responses, a deviance


def test_too_many_columns_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(f"l{k}", 1) for k in range(40)], "area string, claims int")
    monkeypatch.setattr(glm, "MAX_SUMS", 1000)
    with pytest.raises(GlmError, match="sums"):
        glm.fit_glm(df, Spec("claims", "poisson", ("area",)))
    monkeypatch.setattr(glm, "MAX_COLUMNS", 30)
    with pytest.raises(GlmError, match="levels"):
        glm.fit_glm(df, Spec("claims", "poisson", ("area",)))


def _score(theta, y, mu):
    """Score and information of the shape, term by term."""
    s = sum(sum(1 / (theta + k) for k in range(int(c))) for c in y) + (1 - np.log((theta + mu) / theta) - (y + theta) / (theta + mu)).sum()
    h = (1 / theta - 2 / (theta + mu) + (y + theta) / (theta + mu) ** 2).sum() - sum(sum(1 / (theta + k) ** 2 for k in range(int(c))) for c in y)
    return s, h


def test_theta_solves_its_score(spark):
    rng = np.random.default_rng(3)
    _, age, _, exposure, _, mu = _rows(2500)
    y = rng.poisson(4 * mu * rng.gamma(1.7, 1 / 1.7, len(mu)))
    df = spark.createDataFrame([(float(g), float(e), int(c)) for g, e, c in zip(age, exposure, y, strict=True)], "age double, exposure_years double, claims int")
    found = glm.estimate_theta(df, Spec("claims", "negative_binomial", (), ("age",), exposure="exposure_years"))
    fitted = exposure * np.exp(found.model.beta[0] + found.model.coefficient("age") * age)
    score, slope = _score(found.value, y, fitted)
    assert abs(score / slope) < 1e-5 * found.value and abs(found.standard_error - 1 / math.sqrt(-slope)) < 1e-6
    assert 1.0 < found.value < 2.6
    # at the optimum the coefficients' score vanishes too
    assert abs(((y - fitted) / (1 + fitted / found.value)).sum()) < 1e-3


@pytest.mark.parametrize("claims", [[0.5, 1.0, 2.0], [-1.0, 2.0, 3.0], [2.0] * 50])
def test_no_theta_without_overdispersed_counts(spark, claims):
    with pytest.raises(GlmError):
        glm.estimate_theta(spark.createDataFrame([(c,) for c in claims], "claims double"), Spec("claims", "negative_binomial"))


def test_proxies_read_the_book_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"k{k}", None if rng.random() < 0.1 else f"l{(k + int(rng.integers(0, 2))) % 3}", float(rng.uniform(0.1, 1))) for k in rng.integers(0, 5, 400)]
    path = str(tmp_path / "book")
    spark.createDataFrame(rows, "k string, level string, exposure_years double").write.parquet(path)
    reference = spark.createDataFrame([(f"k{k}", k / 10, 1 - k / 10) for k in range(4)], "r string, a double, b double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    measures, coverage = fa.assess_proxies(spark.read.parquet(path), ["level", "k"], reference, key="k", reference_key="r", classes=["a", "b"])
    for df in (measures, coverage):  # what is read again is the table of totals
        assert "book" not in df._jdf.queryExecution().optimizedPlan().toString() and not df.inputFiles()
    assert before is not None
    joint, known = {}, {f"k{k}": (k / 10, 1 - k / 10) for k in range(4)}
    for k, level, w in rows:
        for c, share in enumerate(known.get(k, ())):
            joint[level or "(null)", c] = joint.get((level or "(null)", c), 0) + w * share
    total = sum(joint.values())
    levels = {}
    classes = {}
    for (level, c), v in joint.items():
        levels[level] = levels.get(level, 0) + v
        classes[c] = classes.get(c, 0) + v
    bits = sum(v / total * math.log2(v * total / (levels[level] * classes[c])) for (level, c), v in joint.items() if v)
    got = {(r["factor"], r["class"]): r for r in measures.collect()}
    assert set(got) == {(f, c) for f in ("level", "k") for c in ("a", "b")}
    assert got["level", "a"]["mutual_information_bits"] == pytest.approx(bits)
    row = coverage.first()
    assert row["matched_rows"] == sum(k in known for k, _, _ in rows) and row["coverage"] == pytest.approx(sum(w for k, _, w in rows if k in known) / sum(w for _, _, w in rows))
    with pytest.raises(fa.ProxyError):
        fa.assess_proxies(spark.createDataFrame([("k1", "l", -1.0)], "k string, level string, exposure_years double"), ["level"], reference, key="k", reference_key="r", classes=["a", "b"])
