"""The adaptive scan with a known first limit: no row as near as the last of the nearest is lost beyond what the tests allow."""

import numpy as np
import pytest

from premia.llm import vectors


@pytest.mark.parametrize("few", [0.0, 0.05, 1.0])
@pytest.mark.parametrize("size", [8, 16, 65])
def test_known_limits_keep_the_nearest(monkeypatch, few, size):
    monkeypatch.setattr(vectors, "FEW", few)
    rng = np.random.default_rng(size)
    x = rng.standard_normal((1300, size))
    x[7:40] = x[6]
    query = np.concatenate([x[:20], rng.standard_normal((20, size))])
    whole = ((query[:, None] - x[None]) ** 2).sum(axis=2)
    last = np.sort(whole, axis=1)[:, 9]
    kept = 0
    for known in (None, last, last * 1.5, np.full(len(query), np.inf)):
        q, r = vectors.scan(query, x, 10, known)
        got = np.zeros(whole.shape, bool)
        got[q, r] = True
        assert len(q) == got.sum()
        near = whole <= last[:, None] * (1 + 1e-12)
        kept = got[near].mean()
        assert kept > 0.9  # a hypothesis test may abandon one now and then
        if size <= vectors.COLUMNS:
            assert kept == 1.0
        if known is not None:
            assert (whole[got] <= (known[:, None] + 1e-6 * whole.max() + 0 * whole)[got]).all()


def test_first_limits_lose_nothing_to_small_tables(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((60, 6)), 1)  # many ties
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(None, [1.0] * 6), (100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [None] * 6), (0, (x[0] + 5).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    first = min(x[0].tolist(), (x[0] + 5).tolist())
    x[0] = first
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.nearest(df, "key % 20 = 0", k=70).collect()}
    assert {q for q, _ in got} == {0, 20, 40}
    for q in (0, 20, 40):
        own = [(r, *got[q, r]) for r in sorted(r for p, r in got if p == q)]
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and q not in {v for _, v, _ in own}
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(own, own[1:], strict=False))
        assert np.allclose([s for _, _, s in own], [x[v] @ x[q] for _, v, _ in own])
        assert len(own) == 59
