"""Text quality by a regularised quadratic discriminant over transformed document statistics.

Each document becomes a fixed vector of statistics of its whole text (lengths, character classes, repetition, lines), put
on scales where classes are closer to normal (logarithms, logits). Per class, the mean and a covariance shrunk first
towards the pooled one, then towards its diagonal, are learnt from sums that Spark adds up; a score is the logistic of the
Mahalanobis log-density difference, from Cholesky factors computed once, under a slope and offset fitted to the training
rows' own differences.

Defined results: a null text is the empty text. Documents with no label, or with labels that disagree, teach nothing;
repeated labels that agree count once. With labels of one class only, every score is that class; without any, 0.5.
Scores lie in [0, 1] for every text, and repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import flat, mix, joined, rows_of, slices, words

#: Share of the pooled covariance in each class's, and of the diagonal in the result.
POOLED, DIAGONAL = 0.1, 0.02
#: Least variance of a statistic, so that a constant one has no infinite weight.
FLOOR = 1e-3
_WORK_BYTES = 512 << 10

NAMES = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digit", "mark", "odd_mark", "bar", "space", "beyond_ascii",
    "log_lines", "line_words", "distinct_words", "top_word", "distinct_pairs", "distinct_fours", "repeated_lines", "caps_words", "marked_words", "sentence_ends", "alike_bytes",
)
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 mark, 4 odd mark, 5 bar, 6 space, 7 beyond ASCII
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in ".,;:!?'\"()-":
    _CLASS[ord(_c)] = 3
for _c in "#$%&*+/<=>@[\\]^_`{}~":
    _CLASS[ord(_c)] = 4
_CLASS[ord("|")] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, with half a case added to both sides."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=n).astype(float), top


def statistics(text: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    w = words(text)
    n, data = len(text), w.data
    _, bounds = flat(text)
    size = np.diff(bounds).astype(float)
    row = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(row * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8).astype(float)
    count = np.diff(w.first).astype(float)
    length = (w.end - w.start).astype(float)
    per_word = lambda x: np.bincount(w.doc, weights=x, minlength=n)
    safe = np.maximum(count, 1)
    mean = per_word(length) / safe
    spread = np.sqrt(np.maximum(per_word(length**2) / safe - mean**2, 0))
    distinct, top = _distinct(w.doc, w.hash, n)

    def parts(k: int) -> tuple[np.ndarray, np.ndarray]:
        h = joined(w.hash, k)
        inside = w.doc[: len(h)] == w.doc[k - 1 :] if len(h) else np.zeros(0, bool)
        return _distinct(w.doc[: len(h)][inside], h[inside], n)[0], np.maximum(count - k + 1, 0)

    pairs, n_pairs = parts(2)
    fours, n_fours = parts(4)
    # lines: split at new lines; a line's hash is the sum of its scattered word hashes and their places
    line = np.cumsum(data == 10) if len(data) else np.zeros(0, np.int64)
    word_line = line[w.start] if len(w.start) else np.zeros(0, np.int64)
    key = (w.doc.astype(np.int64) << 32) | word_line
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    if len(at):
        place = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        line_hash = np.add.reduceat(mix(w.hash + place.astype(np.uint64)), at)
        line_row = w.doc[at]
    else:
        line_hash, line_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lines = np.bincount(line_row, minlength=n).astype(float)
    distinct_lines, _ = _distinct(line_row, line_hash, n)
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    second = data[np.minimum(w.start + 1, max(len(data) - 1, 0))] if len(w.start) else last
    opens = data[w.start] if len(w.start) else last
    caps = per_word((_CLASS[opens] == 1) & (_CLASS[second] == 1) & (length > 1))
    marked = per_word((_CLASS[last] == 4) | (last == 33))
    ends = per_word((last == 46) | (last == 63))
    alike = np.zeros(len(data), bool)
    alike[1:] = (data[1:] == data[:-1]) & (row[1:] == row[:-1])
    out = [
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), _logit(kinds[:, 1], size), _logit(kinds[:, 2], size), _logit(kinds[:, 3], size), _logit(kinds[:, 4], size),
        _logit(kinds[:, 5], size), _logit(kinds[:, 6], size), _logit(kinds[:, 7], size), np.log1p(lines), np.log1p(count / np.maximum(lines, 1)), _logit(distinct, count), _logit(top, count),
        _logit(pairs, n_pairs), _logit(fours, n_fours), _logit(lines - distinct_lines, lines), _logit(caps, count), _logit(marked, count), _logit(ends, count),
        _logit(np.bincount(row[alike], minlength=n).astype(float), size),
    ]
    return np.stack(out, axis=1)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _WORK_BYTES):
                x = statistics(part.column("text"))
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["key", "x"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, x array<double>").withColumnRenamed("key", key)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log determinants by class (0, 1); slope and offset of the difference."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    offset: float
    slope: float
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        out = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            out.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        t = np.clip(self.offset + self.slope * self.difference(x), -500, 500)
        return 1 / (1 + np.exp(-t))


def _sums(rows: DataFrame, p: int) -> dict[int, np.ndarray]:
    """Count, sums and cross products by class: p * p + p + 1 numbers each, added up by Spark."""
    schema = pa.schema([("label", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, label = _matrix(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                y = np.hstack([np.ones((int((label == k).sum()), 1)), x[label == k]])
                total[k] = total.get(k, 0) + y.T @ y
        for k, m in total.items():
            yield rows_of(schema, label=np.full(m.size, k), at=np.arange(m.size), value=m.ravel())

    got = rows.mapInArrow(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    out = {k: np.zeros((p + 1) ** 2) for k in (0, 1)}
    for r in got:
        out[r.label][r["at"]] = r.value
    return {k: m.reshape(p + 1, p + 1) for k, m in out.items()}


def fit(rows: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """`rows`: x and label (0 or 1). Two jobs: sums of the classes, then a histogram of differences for the slope."""
    p = len(NAMES)
    sums = _sums(rows, p)
    n = {k: m[0, 0] for k, m in sums.items()}
    if not n[0] or not n[1]:
        return Discriminant((), (), 0.0, 1.0, 0.5 if n[0] == n[1] else float(n[1] > 0))
    means = {k: m[0, 1:] / n[k] for k, m in sums.items()}
    cov = {k: m[1:, 1:] / n[k] - np.outer(means[k], means[k]) for k, m in sums.items()}
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    factors = []
    for k in (0, 1):
        s = (1 - pooled) * cov[k] + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + FLOOR * np.eye(p)
        factors.append(np.linalg.cholesky(s))
    raw = Discriminant((means[0], means[1]), tuple(factors), 0.0, 1.0)
    schema = pa.schema([("label", pa.int32()), ("bin", pa.int32())])

    def bins(batches):
        for batch in batches:
            d = np.arcsinh(raw.difference(_matrix(batch.column("x"))))
            yield rows_of(schema, label=batch.column("label"), bin=np.clip(np.rint(d * 50), -1000, 1000).astype(np.int32))

    found = rows.mapInArrow(bins, "label int, bin int").groupBy("label", "bin").count().collect()
    d = np.sinh(np.array([r.bin for r in found]) / 50)
    y, weight = np.array([r.label for r in found], float), np.array([r["count"] for r in found], float)
    scale = max(1e-9, np.sqrt((weight * d * d).sum() / weight.sum()))
    z, beta = np.stack([np.ones_like(d), d / scale], axis=1), np.zeros(2)
    for _ in range(100):
        prob = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - prob)) - 1e-3 * beta
        step = np.linalg.solve((z * (weight * prob * (1 - prob))[:, None]).T @ z + 1e-3 * np.eye(2), gradient)
        beta = beta + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return Discriminant(raw.means, raw.factors, float(beta[0]), float(beta[1] / scale))


def labelled(x: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of the documents with one agreed label."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    return x.join(known.select(key, F.col("label").cast("int").alias("label")), key).select("x", "label")


def score(x: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of `features`."""
    kind = x.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(_matrix(batch.column("x"))))], names=["key", "score"])

    return x.select(F.col(key).alias("key"), "x").mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Discriminant, least: float, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores `least` or more, with all of their columns."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, _WORK_BYTES):
                yield part.filter(pa.array(model.score(statistics(part.column(text))) >= least))

    return docs.mapInArrow(run, docs.schema)
