"""What the corpus operators share: folds, written tables, batches of bounded size, words of a batch, heavy items, components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import checkpoint_dir

#: Text bytes that one numpy pass works on; it bounds a Python worker's memory whatever the row sizes are.
SLICE_BYTES = 2 << 20
#: Heavy items kept by `heavy_items`: each holds over one part in this many of all items, so there are no more of them.
HEAVY_PARTS = 200_000


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's decimal text, modulo `parts`."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet into the shared checkpoint folder and read back; removed when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/premia-llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, total_bytes: int, each: int) -> int:
    """How many groups of about `each` bytes hold `total_bytes`."""
    return max(1, -(-int(total_bytes) // each))


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`work` on one group, giving its memory back afterwards."""

    @functools.wraps(work)
    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return run


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, cut so that their texts hold about `limit` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
        give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and each row's bounds; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; a worker keeps the longest it has needed."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 8, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that scatters them."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a slice: maximal runs of bytes outside 0x20 and 0x09-0x0D."""

    data: np.ndarray  #: bytes, lower-cased (A-Z) if asked for
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  #: row in the slice
    first: np.ndarray  #: first word of each row, and the number of words at the end
    hash: np.ndarray  #: 64 bits of each word's bytes

    def text(self, words: np.ndarray | slice = slice(None)) -> pa.Array:
        """The chosen words as a string column."""
        start, end = self.start[words], self.end[words]
        size = end - start
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        data = self.data[ranges(start, size)]
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for `size[0]` numbers, then the next range."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.cumsum(size) - size
    return np.arange(total, dtype=np.int64) + np.repeat(start - offsets, size)


def words(column: pa.Array, lower: bool = False) -> Words:
    data, bounds = flat(column)
    n = len(data)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    if n:
        power, inverse = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        value = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    else:
        value = np.zeros(0, np.uint64)
    return Words(data, start, end, doc, first, value)


def joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive values (those that cross a row's end too)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        out += h[k : k + n] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    return mix(out)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def heavy_items(docs: DataFrame, items: Callable[[pa.Array], np.ndarray], text: str = "text") -> np.ndarray:
    """Sorted hashes of the items that hold over 1 / HEAVY_PARTS of all items: at most HEAVY_PARTS of them.

    `items` gives the hashes of a text column's items. An item that is over the share in all texts is over it in some
    slice, so a slice reports only items at its own share or more (and twice at least); totals are of those reports.
    """
    schema = pa.schema([("item", pa.int64()), ("n", pa.int64())])

    def report(batches):
        for batch in batches:
            for part in slices(batch, text):
                h = items(part.column(0))
                if not len(h):
                    continue
                value, n = np.unique(h, return_counts=True)
                much = n >= max(2, len(h) / HEAVY_PARTS)
                yield rows_of(schema, item=np.append(as_long(value[much]), 0), n=np.append(n[much], -len(h)))

    # the row with a negative count carries the number of items in the slice
    found = docs.select(F.col(text)).mapInArrow(report, "item long, n long")
    sums = written(found.groupBy("item", (F.col("n") < 0).alias("total")).agg(F.sum(F.abs("n")).alias("n")))
    total = sums.where("total").agg(F.sum("n")).first()[0] or 0
    heavy = sums.where(~F.col("total") & (F.col("n") * HEAVY_PARTS > total) & (F.col("n") > 64)).select("item")
    got = np.array([r.item for r in heavy.toLocalIterator()], np.int64).view(np.uint64)
    return np.sort(got)


def contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of `x` are among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b): the smallest id that links lead to.

    Alternates two star contractions until the links no longer change; each round is a grouped minimum and a join that
    adaptive execution splits on a hot id, written to the shared folder.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: of each id, its smaller neighbours and itself go to the least of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = written(small.where("a < b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
