"""Embedding whitening: principal components by Golub-Kahan-Lanczos bidiagonalisation, and whitened coordinates.

Entries c become whole numbers x = floor(scale * c) + shift, so that sums and deviations are exact. Rows whose vector is null,
has a null or non-finite entry, an entry beyond LARGEST after scaling, or another length than most vectors (of equally
frequent lengths the longest) take no part and have no result. Repeated rows and keys all count. Components without variance
are left out, so constant vectors, one row or an empty table give no rows. Other columns of the table come back in a struct,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import written
from premia.llm.vectors import matrix
from premia.operators.partials import partitions, tree_sum

#: Size of an entry after scaling up to which all whole numbers are doubles.
LARGEST = 2.0**52
#: Rows of a batch whose centred block is held at once.
ROWS = 4096
#: A residual below this share of the largest singular value counts as none.
CONVERGED = 1e-15
_EPS = np.finfo(float).eps


@dataclass
class Fit:
    """Sums of the fit list, and its components as columns of falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    steps: int
    identity_error: float = 0.0


def whole(vectors: DataFrame, vector: str, scale: float, shift: int) -> DataFrame:
    """(row, x) of the rows that take part: the other columns as a struct, and the vector's whole numbers."""
    others = [F.col(f"`{c}`") for c in vectors.columns if c != vector]
    kept = F.struct(*others) if others else F.lit(None).cast("string")
    c = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < LARGEST))
    rows = vectors.where(F.col(f"`{vector}`").isNotNull()).where(fine)
    return rows.select(kept.alias("row"), F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long")).alias("x"))


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of x, the longest of several; 0 without rows."""
    found = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return found[0]["size"] if found else 0


def _long(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as 64-bit numbers where they fit, else as Python's."""
    if int(np.abs(x).max(initial=0)) * n < 2**62 and max((abs(s) for s in sums), default=0) < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return scaled(x, n, sums).astype(float) / n


def _sums(rows: DataFrame, parts: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums, of high and low halves of the entries."""

    def part(batch):
        x = _long(batch.column(0))
        return np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)]).astype(np.int64)

    got = [int(v) for v in tree_sum(rows.select("x"), part, np.int64, parts)]
    size = (len(got) - 1) // 2
    return got[0], [(high << 26) + low for high, low in zip(got[1 : 1 + size], got[1 + size :], strict=True)]


def bidiagonalise(products: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], size: int, total: float, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B, B upper bidiagonal, for the rows X that `products` multiplies.

    products(W, w) gives (U'p, p'p, X'p) for U = X W and p = X w, where left vectors are held as the combinations W of
    columns that make them, so that no row keeps them. Both sides are orthogonalised in full, twice. A vanished residual is
    followed by a new random direction. It ends when V spans the space, or when the wanted triplets have no residual and
    all that is outside of V has less variance than the last wanted one, so that no direction is missed.
    """
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # combinations W
    back: list[np.ndarray] = []  # X'u
    alpha: list[float] = []
    beta: list[float] = []

    def fresh(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for q in right:
                v = v - q * (q @ v)
        return v

    floor = size * _EPS * np.sqrt(total)
    v, coupling, held = rng.standard_normal(size), 0.0, 0.0
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        w = v - coupling * left[-1] if coupling else v
        done = np.array(left).T if left else np.zeros((size, 0))
        for _ in range(2):
            along, square, z = products(done, w)
            if len(left):
                w, z = w - done @ along, z - np.array(back).T @ along
        a = float(np.sqrt(max(0.0, square - along @ along)))
        if a > floor:
            left.append(w / a)
            back.append(z / a)
            r = fresh(back[-1] - a * v)
        else:
            a = 0.0
            left.append(np.zeros(size))
            back.append(np.zeros(size))
            r = np.zeros(size)
        alpha.append(a)
        coupling = float(np.linalg.norm(r))
        held += a * a + (beta[-1] ** 2 if beta else 0.0)
        b = np.diag(alpha) + np.diag(beta, 1)
        if len(right) == size:
            break
        p, sigma, _ = np.linalg.svd(b)
        if len(sigma) >= wanted and (coupling * np.abs(p[-1, :wanted]) <= CONVERGED * sigma[0]).all() and total - held < sigma[wanted - 1] ** 2:
            break
        if coupling <= floor:
            coupling, r = 0.0, fresh(rng.standard_normal(size))
            r /= np.linalg.norm(r)
            v = r
        else:
            v = r / coupling
        beta.append(coupling)
    return np.array(right).T, b


def fit(rows: DataFrame, components: int) -> Fit | None:
    """Components of a written table (row, x) of vectors of one length; each product is one pass over x."""
    x = rows.select("x")
    parts = partitions(x)
    if not x.head(1):
        return None
    n, sums = _sums(x, parts)
    size = len(sums)
    if not size:
        return None

    def over(work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return tree_sum(x, lambda batch: sum(work(centred(_long(b.column(0)), n, sums)) for b in _blocks(batch)), parts=parts)

    total = float(over(lambda c: np.array([(c * c).sum()]))[0])
    if not total:
        return None

    def products(done, w):
        def work(c):
            p = c @ w
            return np.concatenate([(c @ done).T @ p, [p @ p], c.T @ p])

        got = over(work)
        return got[: done.shape[1]], float(got[done.shape[1]]), got[done.shape[1] + 1 :]

    right, b = bidiagonalise(products, size, total, min(components, size))
    _, sigma, q = np.linalg.svd(b)
    keep = min(components, int((sigma > max(n, size) * _EPS * sigma[0]).sum()), n)
    found = Fit(n, sums, right @ q.T[:, :keep], sigma[:keep] ** 2 / n, total / n, len(b))
    turn = found.components / np.sqrt(found.values)
    mean = over(lambda c: (c @ turn).sum(axis=0)) / n
    gram = over(lambda c: ((z := c @ turn - mean).T @ z).ravel()).reshape(keep, keep) / n
    found.identity_error = float(np.abs(gram - np.eye(keep)).max())
    return found


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    `deviation` is the sum over dimensions of (n * x - S)^2, null where it is beyond a long.
    """
    rows = whole(vectors, vector, scale, shift)
    kind = rows.schema["row"].dataType.simpleString()
    rows = written(rows)
    size = usual_length(rows)
    rows = rows.where(F.size("x") == size)
    model = fit(rows, components) if size else None
    shape = f"row {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], shape)
    turn, explained = model.components / np.sqrt(model.values), model.values / model.trace
    k = len(explained)

    def run(batches):
        for batch in batches:
            for b in _blocks(batch):
                x = _long(b.column("x"))
                d = scaled(x, model.n, model.sums)
                if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2**62:
                    deviation = pa.array((d * d).sum(axis=1), pa.int64())
                else:
                    deviation = pa.array([v if v < 2**63 else None for v in (d.astype(object) ** 2).sum(axis=1)], pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("row").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, model.n)),
                        deviation.take(each),
                        pa.array((d.astype(float) / model.n @ turn).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(x) * k, model.identity_error)),
                    ],
                    names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, shape)
