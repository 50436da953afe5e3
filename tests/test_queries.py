"""A few registered queries against their SQL on the smallest tables; `tools/check.py` runs all."""

import decimal

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import SF  # noqa: E402

SAMPLE = ("one_way", "recipe_clean_rows", "attach_claims", "explode_period", "temporal_folds", "score_portfolio", "dislocation_bands", "lift", "banding_exposure_quantile", "glm_poisson_fit", "input_drift")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(float(r[i]) if isinstance(r[i], (decimal.Decimal, float)) else r[i] for i in order) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    cursor = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _plain(df.collect(), df.columns) == _plain(cursor.fetchall(), columns)


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "frequency" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
