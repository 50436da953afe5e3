"""Exact order statistics and running totals against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.operators import ordering as od


@pytest.fixture(scope="module")
def numbers(spark):
    draw = random.Random(4)
    # A third of all rows share one value, and some are null.
    values = [(i, 7.0 if i % 3 == 0 else None if i % 17 == 0 else round(draw.uniform(-50, 50), 2), i % 4) for i in range(3000)]
    return spark.createDataFrame(values, "id long, x double, g int").cache(), values


def test_running_totals_pool_equal_values(numbers):
    df, values = numbers
    got = {(r["g"], r["x"]): (r["n"], r["n_before"]) for r in od.running_totals(df, "x", {"n": F.lit(1)}, within=["g"]).collect()}
    for g in range(4):
        mine = sorted((v for _, v, h in values if h == g), key=lambda v: (v is not None, v or 0.0))
        for x in set(mine):
            before = sum(1 for v in mine if (v is None and x is not None) or (v is not None and x is not None and v < x))
            assert got[(g, x)] == (mine.count(x), before)


def test_running_maximum_before(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 5, 4), ("b", 1, 2)], "k string, t int, e int")
    got = {(r["k"], r["t"]): r["m_before"] for r in od.running_totals(df, "t", {}, within=["k"], maxima={"m": F.col("e")}).collect()}
    assert got == {("a", 1): None, ("a", 2): 9, ("a", 5): 9, ("b", 1): None}


def test_linear_quantiles_are_exact(numbers):
    df, values = numbers
    known = np.array([v for _, v, _ in values if v is not None])
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    assert od.linear_quantiles(df, ["x"], probs)["x"] == pytest.approx(np.quantile(known, probs).tolist())


def test_nearest_rank_quantiles(numbers):
    df, values = numbers
    known = sorted(v for _, v, _ in values if v is not None)
    found = od.nearest_rank_quantiles(df, "x", ["0.5", "0.999", "1"])
    for q, v in found.items():
        assert v == known[max(1, math.ceil(float(q) * len(known))) - 1]
    assert od.nearest_rank_quantiles(df.where("x > 1000"), "x", ["0.5"]) == {"0.5": None}


def test_weighted_first_reaching(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (3.0, 4), (4.0, 10)], "x double, w int")
    values, totals = od.first_reaching(df, {"x": lambda t: [t * k / 4 for k in (1, 2, 3)]}, weight=F.col("w"))
    assert int(totals["x"]) == 20
    assert values["x"] == [1.0, 3.0, 4.0]


def test_equal_count_bins_with_a_hot_value(numbers):
    df, values = numbers
    known = sorted((v, i) for i, v, _ in values if v is not None)
    n, want = len(known), {}
    base, extra = divmod(n, 10)
    for rank, (_, i) in enumerate(known):
        big = extra * (base + 1)
        want[i] = rank // (base + 1) + 1 if rank < big else extra + (rank - big) // base + 1
    got = {r["id"]: r["bin"] for r in od.equal_count_bins(df, "x", "id", 10).collect()}
    assert {i: b for i, b in got.items() if b is not None} == want


def test_fewer_rows_than_bins(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, x double")
    assert {r["id"]: r["bin"] for r in od.equal_count_bins(df, "x", "id", 5).collect()} == {2: 1, 1: 2}


def test_first_rows_breaks_ties(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "id long, x double")
    assert sorted(r["id"] for r in od.first_rows(df, "x", "id", 7).collect()) == [0, 1, 2, 3, 4, 6, 8]
    assert od.first_rows(df, "x", "id", 0).count() == 0


def test_text_has_no_numeric_order(spark):
    with pytest.raises(TypeError):
        od.running_totals(spark.createDataFrame([("a",)], "x string"), "x", {"n": F.lit(1)})
