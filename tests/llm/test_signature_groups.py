"""Near copies that share most of their signatures without all being similar: groups, their parts, and brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from premia.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, sig long, component long"


def _drift(seed, steps, size=120, changed=3):
    """Texts of which each differs a little from one before it, so that far ones are not similar."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{i}" for i in rng.integers(0, 5000, size)]]
    for k in range(1, steps):
        own = list(texts[rng.integers(max(0, k - 6), k)])
        for at in rng.integers(0, size, changed):
            own[at] = f"n{rng.integers(0, 40)}"
        texts.append(own)
    return [" ".join(t) for t in texts]


def _brute(rows):
    """(number of shingles, smallest linked id) by all pairs; rows of one id are one document with each of their sets."""
    sets = []
    for k, t in rows:
        w = WORDS.findall((t or "").lower())
        sets.append((k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = {k: k for k, _ in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                a_, b_ = sorted((top(a), top(b)))
                root[b_] = a_
    return sorted((k, len(s), top(k)) for k, s in sets)


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_drifting_copies_match_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(jaccard, "PART_ROWS", part_rows)
    texts = _drift(1, 60) + _drift(2, 40, size=90, changed=4) + ["", None, "a b", "a  b", "x " * 50] * 2
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[75]), (5, texts[5])]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows] + [(None, texts[0], 1, 2)], SCHEMA).repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()]
    assert got.count((None, None, None)) == 1
    want = _brute(rows)
    assert sorted(g for g in got if g[0] is not None) == want
    assert 1 < len({c for _, _, c in want}) < len(texts) - 10  # the fixture has links and groups apart


def test_rows_of_a_cell_meet_over_batches():
    rng = np.random.default_rng(5)
    cells = np.sort(rng.integers(0, 6, 400))
    table = {
        "sig": cells // 2, "one": cells % 2 * 0, "two": cells % 2, "mine": rng.integers(0, 2, 400) * (cells % 2), "doc": np.arange(400) * 7 % 401,
        "n": rng.integers(20, 40, 400), "component": rng.integers(0, 3, 400),
    }
    on = rng.random((400, jaccard.BITS)) < 0.01
    table["s"] = np.minimum(table["n"], on.sum(axis=1) + rng.integers(0, 3, 400))
    on &= np.cumsum(on, axis=1) <= table["s"][:, None]
    batch = pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in table.items()}, "bits": pa.array([np.packbits(b).tobytes() for b in on], pa.binary())})
    want = set()
    for i in range(400):
        for j in range(i):
            same = cells[i] == cells[j] and table["component"][i] != table["component"][j] and (cells[i] % 2 == 0 or table["mine"][i] != table["mine"][j])
            lost = max((on[i] & ~on[j]).sum() - table["s"][i], (on[j] & ~on[i]).sum() - table["s"][j])
            if same and 100 * -lost >= 80 * (table["n"][i] + table["n"][j] + lost):
                want.add(tuple(sorted((int(table["doc"][i]), int(table["doc"][j])))))
    for size in (400, 37, 1):
        got = [p for b in jaccard._near(batch.slice(k, size) for k in range(0, 400, size)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert set(got) == want
    assert list(jaccard._near(iter([]))) == [] and list(jaccard._near([batch.slice(0, 0)])) == []
