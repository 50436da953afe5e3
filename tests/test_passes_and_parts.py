"""Joined tables are read once, parts stay bounded, swept rows stay where they are."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from premia.functions import losses
from premia.operators import boosting, governance, regression
from premia.operators.glm import Spec, Variant, fit_variants
from premia.plans import catalogue, views
from premia.sources import files


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A folder of small given tables: 900 lines of 300 orders."""
    folder = tmp_path_factory.mktemp("given")
    i = F.col("id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    day = F.to_timestamp(F.date_add(F.lit("1996-01-01").cast("date"), ((i * 7) % 1500).cast("int")))
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    tables = {
        "orders": spark.range(300).select(i.alias("o_orderkey"), (i % 40).alias("o_custkey"), (i * 1000.0).alias("o_totalprice"), day.alias("o_orderdate"), pick(priorities, i).alias("o_orderpriority")),
        "customer": spark.range(40).select(i.alias("c_custkey"), pick(["BUILDING", "MACHINERY", "AUTOMOBILE"], i).alias("c_mktsegment"), (i % 5).alias("c_nationkey")),
        "nation": spark.range(5).select(i.alias("n_nationkey"), F.concat(F.lit("N"), i.cast("string")).alias("n_name"), (i % 2).alias("n_regionkey")),
        "part": spark.range(30).select(i.alias("p_partkey"), F.concat(F.lit("B"), (i % 4).cast("string")).alias("p_brand"), pick(["ECONOMY", "PROMO", "SMALL"], i).alias("p_type"), (i % 11 + 1).cast("int").alias("p_size")),
        "lineitem": spark.range(900).select(
            (i % 300).alias("l_orderkey"), F.floor(i / 300).cast("int").alias("l_linenumber"), ((i * 13) % 30).alias("l_partkey"), (i % 7).alias("l_suppkey"),
            ((i * 17) % 50 + 1).cast("double").alias("l_quantity"), (1000.0 + (i * 37) % 900).alias("l_extendedprice"), ((i % 9 + 1) / 100.0).alias("l_discount"), ((i % 8) / 100.0).alias("l_tax"),
            pick(["R", "A", "N", "R", "N"], F.floor(i / 3)).alias("l_returnflag"), pick(["O", "F"], i).alias("l_linestatus"), day.alias("l_shipdate"),
        ),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    ("query", "most"),
    [
        ("validation_against_version", 1), ("backtest", 1), ("glm_tweedie_fit", 1), ("glm_tweedie_power", 1), ("shape_model_interactions", 1), ("shape_model_fit", 1),
        ("shape_model_export", 1), ("glm_collinearity", 1), ("boosted_trees", 1), ("validation_report", 2),
    ],
)
def test_lines_are_read_once(spark, given, monkeypatch, query, most):
    """The report reads them twice, as its book and as its claims."""
    seen = spark.sparkContext.accumulator(0)
    lines = spark.read.parquet(f"{given}/lineitem.parquet")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setitem(views._TABLES, (spark.sparkContext.applicationId, f"{given}/lineitem.parquet"), lines.mapInArrow(count, lines.schema))
    assert catalogue.REGISTRY[query].build(spark, given).collect()
    assert 1 <= seen.value / 900 <= most


def test_book_keeps_its_rows_when_dimensions_meet_the_orders_first(spark, given):
    b = views.book(spark, given, "part", "nation")
    plain = spark.read.parquet(f"{given}/lineitem.parquet")
    for name, left, right in (("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey")):
        plain = plain.join(spark.read.parquet(f"{given}/{name}.parquet"), F.col(left) == F.col(right))
    columns = ["l_orderkey", "l_linenumber", "p_type", "c_mktsegment", "n_name"]
    assert sorted(map(tuple, b.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_a_larger_table_is_dealt_out_into_more_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_SPLIT", 10)
    monkeypatch.setattr(files, "ROWS_PER_PART", 100)
    assert files.spread(spark.range(0, 9_999, 1, 1).toDF("x")).rdd.getNumPartitions() == 100


def test_boosted_trees_keep_bounded_parts(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    class Seen(Exception):
        pass

    def fit(self, rows):
        raise Seen(rows.rdd.getNumPartitions())

    monkeypatch.setattr(boosting, "ROWS_PER_PART", 50)
    monkeypatch.setattr(GBTRegressor, "fit", fit)
    df = spark.range(0, 1_000, 1, 2).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(Seen) as found:
        boosting.boosted_trees(df, response="y", features=["x"])
    assert found.value.args[0] == 20


def _above(plan: str, node: str) -> str:
    return plan[: plan.index(node)]


def test_swept_rows_are_not_shuffled(spark, monkeypatch):
    contexts = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("b", 1, 3), (None, 1, 4)], "quote_id string, x int, f int")
    rate = lambda df: df.withColumns({"premium_minor": (F.col("x") % 3 * F.col("f")).cast("long"), "outcome": F.when(F.col("x") == 2, "declined").otherwise("quoted")})
    out = regression.monotone_sweep(contexts, "x", [1, 2, 3, 4], rate)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in _above(physical, "Generate")
    # x = 2 is declined; 1 -> 3 falls to nothing; 3 -> 4 rises. Of a quote that is there twice, equal premiums do not break.
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 3, 1, "1", "3"), ("b", 6, 1, "1", "3"), (None, 3, 1, "1", "3")]


def test_many_nodes_of_a_lineage_are_not_broadcast(spark, monkeypatch):
    plans = []
    cut = governance.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(governance, "cut_lineage", kept)
    monkeypatch.setattr(governance, "BROADCAST_ROWS", 2)
    edges = spark.range(1, 60).select(F.col("id").alias("child"), F.floor(F.col("id") / 3).alias("parent"))
    found = {r["node"]: r["distance"] for r in governance.lineage(edges, [2], up=False).collect()}
    assert found == {n: 1 for n in (6, 7, 8)} | {n: 2 for n in range(18, 27)} | {n: 3 for n in range(54, 60)}
    assert "BroadcastHashJoin" in plans[0]
    assert not any("BroadcastHashJoin" in p for p in plans[2:])


def test_density_series_leaves_out_nothing_that_counts(spark):
    y = [1e-6, 0.3, 2.0, 40.0, 3000.0]
    df = spark.createDataFrame([(v, 1.5) for v in y], "y double, mu double")
    for phi, power in ((1.0, 1.1), (1.0, 1.7), (0.2, 1.5), (5.0, 1.95)):
        found = [r[0] for r in df.orderBy("y").select(losses.tweedie_log_density(phi, power)("y", "mu")).collect()]
        shape = (2 - power) / (power - 1)
        for v, got in zip(y, found, strict=True):
            step = shape * math.log(v / (power - 1)) - (1 + shape) * math.log(phi) - math.log(2 - power)
            terms = np.array([j * step - math.lgamma(j + 1) - math.lgamma(shape * j) for j in range(1, 20_000)])
            whole = terms.max() + math.log(np.exp(terms - terms.max()).sum())
            whole += -(1.5 ** (2 - power)) / (phi * (2 - power)) - v / (phi * (power - 1) * 1.5 ** (power - 1)) - math.log(v)
            assert got == pytest.approx(whole, rel=1e-9, abs=1e-8)


def test_sums_of_an_iteration_with_numbers_and_variants(spark):
    """Weighted least squares with a factor, two numbers and two folds left out, against NumPy."""
    r = np.random.default_rng(3)
    rows = [(int(k % 3), float(a), float(b), float(2 + (k % 3) + a - 2 * b + e), int(k % 2)) for k, (a, b, e) in enumerate(r.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double, fold int")
    fits = fit_variants(df, Spec("y", "gaussian", ("g",), ("a", "b"), link="identity"), [Variant("0", leave_out_fold=0), Variant("1", leave_out_fold=1)], fold="fold")
    for out, fit in enumerate(fits):
        mine = [x for x in rows if x[4] != out]
        levels = [int(v) for v in fit.levels["g"]]
        x = np.array([[1.0, *[float(q[0] == v) for v in levels[1:]], q[1], q[2]] for q in mine])
        best = np.linalg.lstsq(x, np.array([q[3] for q in mine]), rcond=None)[0]
        assert fit.beta == pytest.approx(best, abs=1e-8)
        assert fit.gram == pytest.approx(x.T @ x, abs=1e-8)
