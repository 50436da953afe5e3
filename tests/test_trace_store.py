"""A trace store in folders: what is read, and what is found."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from premia.operators import rating as ra
from premia.sources import sinks


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(f"q{k}", date(2024, 1, 1) + timedelta(days=k % 366), f"motor@{k % 3}", "production" if k % 2 else "staging", k) for k in range(2000)]
    return rows, spark.createDataFrame([*rows, ("odd", None, "motor@1", "production", -1)], "quote_id string, scored_on date, version string, environment string, premium int")


@pytest.fixture(scope="module")
def store(spark, traces, tmp_path_factory):
    return spark.read.parquet(sinks.write_traces(traces[1], str(tmp_path_factory.mktemp("traces") / "store"), pieces=2))


def _files(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


def test_a_question_reads_its_folders_only(store, traces):
    asked = ra.query_traces(store, version="motor@1", since="2024-03-10", until="2024-05-05")
    want = {q for q, d, v, e, _ in traces[0] if v == "motor@1" and e == "production" and date(2024, 3, 10) <= d < date(2024, 5, 5)}
    assert {r.quote_id for r in asked.collect()} == want
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "scored_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # at most two files for each of three months; the store has six folders for each month
    assert _files(asked) <= 6 < _files(store.select("premium")) / 10
    assert _files(ra.query_traces(store, version="motor@9", since="2024-01-01", until="2025-01-01")) == 0


def test_releases_prune_folders_once_they_are_known(spark, store, traces):
    spans = [("a", "motor@1", "production", date(2024, 2, 10), date(2024, 3, 2)), ("b", "motor@2", "staging", date(2024, 2, 20), date(2024, 2, 29)),
             ("c", "motor@1", "production", date(2024, 2, 25), date(2024, 2, 27)), ("empty", "motor@1", "production", date(2024, 2, 1), date(2024, 2, 1))]
    releases = spark.createDataFrame(spans, "release string, version string, environment string, since date, until date")
    found = ra.traces_of_releases(store, releases)
    want = sorted((r, q) for r, v, e, a, b in spans for q, d, tv, te, _ in traces[0] if (v, e) == (tv, te) and a <= d < b)
    assert sorted((r.release, r.quote_id) for r in found.collect()) == want and len({r for r, _ in want}) == 3
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_a_store_grows_and_keeps_rows_without_a_time(spark, traces, tmp_path):
    path = sinks.write_traces(traces[1], str(tmp_path / "s"))
    sinks.write_traces(traces[1].where(F.col("premium") < 5), path, append=True)
    assert spark.read.parquet(path).count() == 2001 + 6
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_traces(traces[1], path)
