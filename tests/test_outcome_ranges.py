"""Outcome ranges over draws: equal to the plain sums, without a row for each risk and draw."""

import numpy as np
import pytest

from premia.operators import optimise


def _risks(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 3}" if i % 7 else None, float(rng.normal()), float(rng.uniform(50, 500)), float(rng.uniform(20, 300))) for i in range(400)]
    rows += [("s0", None, 10.0, 1.0), ("s0", 0.1, None, 1.0), ("s1", 0.2, -5.0, 1.0), ("s2", 0.3, 20.0, None), ("gone", None, 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "seg string, base double, price double, cost double").repartition(9)


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_ranges_equal_plain_sums(spark, monkeypatch, held):
    monkeypatch.setattr(optimise, "_HELD", held)
    monkeypatch.setattr(optimise, "_BLOCK", 200)
    rows, df = _risks(spark)
    demand = optimise.Demand("base", -0.8, 0.05)
    got = {r.seg: (r.volume, r.profit) for r in optimise.outcome_ranges(df, demand, segment="seg", price="price", cost="cost", draws=25, seed=3).collect()}
    sampled = np.random.default_rng(3).normal(-0.8, 0.05, 25)
    assert set(got) == {"s0", "s1", "s2", None, "gone"} and got["gone"] == (None, None)
    for seg in ("s0", "s1", "s2", None):
        volume, profit = np.zeros(25), np.zeros(25)
        for name, base, price, cost in rows:
            if name == seg and base is not None and price is not None and price > 0:
                p = 1 / (1 + np.exp(-(base + sampled * np.log(price))))
                volume += p
                profit += p * (price - cost) if cost is not None else 0
        assert np.allclose(got[seg][0], np.percentile(volume, [5, 50, 95])) and np.allclose(got[seg][1], np.percentile(profit, [5, 50, 95]))
    none = optimise.outcome_ranges(df.where("false"), demand, segment="seg", price="price", cost="cost", draws=5, seed=3)
    assert none.columns == ["seg", "volume", "profit"] and none.count() == 0
    with pytest.raises(optimise.OptimiseError):
        optimise.outcome_ranges(df, demand, segment="seg", price="price", cost="cost", draws=0, seed=3)


def test_plan_does_not_depend_on_draws(spark):
    _, df = _risks(spark)
    demand = optimise.Demand("base", -0.8, 0.05)
    plans = [
        optimise.outcome_ranges(df, demand, segment="seg", price="price", cost="cost", draws=n, seed=3)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 500)
    ]
    assert all("Generate" not in p for p in plans) and plans[0].count("\n") == plans[1].count("\n")
