"""Removal of repeated word windows, by super-k-mer partitioning.

A window is `WINDOW` consecutive words of one document. Its minimiser is the least hash of its word triples; triples that
are heavy in the corpus come last in that order, so that the windows around a passage many documents share are dealt by
what is their own. Consecutive windows with one minimiser are one run. Minimisers are counted first: a run whose
minimiser stands at one place only holds no repeat and stays where it is. Each other run travels as one packed string to
its minimiser's bucket. Equal strings of one slice of documents travel once, as their first occurrence; the others are
repeats already. In a bucket, windows are sorted by hash, equal hashes are compared byte by byte, and every occurrence but the first (smaller document,
then earlier start) is a repeat. A document loses each word that a repeat covers.

Defined results: a null text has no words. Rows without a key neither lose words nor cause others to. Rows that repeat a
key are one document read twice: an occurrence at the same start is the same occurrence. Documents with fewer than
`WINDOW` words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.common import SLICE_BYTES, Words, as_long, contains, heavy_items, joined, lean, mix, pieces, ranges, rows_of, slices, text_size, words

WINDOW, TRIPLE = 20, 3
#: Windows in one packed string, so that a document of one repeated word has strings of bounded length.
MOST = 64
#: Packed bytes of a bucket.
BUCKET_BYTES = 4 << 20
#: Orders from here on are those of heavy triples.
_HEAVY = np.uint64(1 << 63)
_REPEATS = "doc long, start long, n long"
_SENT = "bucket int, doc long, start long, n long, packed binary"


def _triples(text: pa.Array) -> np.ndarray:
    w = words(text)
    h = joined(w.hash, TRIPLE)
    return h[w.doc[: len(h)] == w.doc[TRIPLE - 1 :]] if len(h) else h


def _slide(v: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """`best` (minimum or maximum) of every `size` consecutive values."""
    span = 1
    while span * 2 <= size:
        v = best(v[:-span], v[span:])
        span *= 2
    rest = size - span
    return best(v[: len(v) - rest], v[rest:]) if rest else v


def _canon(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words joined by one space, and where each begins (and one past the end)."""
    size = w.end - w.start + 1
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    data = np.append(w.data, np.uint8(32))[ranges(w.start, size)]
    data[at[1:] - 1] = 32
    return data, at


def _binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(start, size)]))])


def _minimisers(w: Words, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of each triple, and the least order in each window, 0 for windows that cross a document's end."""
    n = len(w.hash) - WINDOW + 1
    triple = joined(w.hash, TRIPLE)
    order = (triple >> np.uint64(1)) | np.where(contains(heavy, triple), _HEAVY, np.uint64(0)) | np.uint64(1)
    least = _slide(order, WINDOW - TRIPLE + 1, np.minimum)
    return order, np.where(w.doc[:n] == w.doc[WINDOW - 1 :], least, np.uint64(0))


def _strings(w: Words, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, windows and minimiser of each run of windows with one minimiser."""
    if len(w.hash) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, least = _minimisers(w, heavy)
    at = np.flatnonzero(least)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % MOST == 0)
    return at[first], np.diff(np.append(first, len(at))), value[first]


def _runs(heavy: np.ndarray):
    """(least, doc, n): each document's minimisers that are not heavy, and at how many places it has them.

    A document with a window of heavy triples only has one more row, under a key of its own, that counts as shared.
    """
    schema = pa.schema([("least", pa.int64()), ("doc", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(1))
                if len(w.hash) < WINDOW:
                    continue
                order, windows = _minimisers(w, heavy)
                # a triple is a minimiser if it is the least of some window that holds it
                span = WINDOW - TRIPLE + 1
                edge = np.zeros(span - 1, np.uint64)
                at = np.flatnonzero((_slide(np.concatenate([edge, windows, edge]), span, np.maximum) == order) & (order < _HEAVY))
                row, least = w.doc[at], order[at]
                order = np.lexsort((least, row))
                row, least = row[order], least[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                first = np.flatnonzero(new)
                docs = part.column(0).to_numpy(zero_copy_only=False)
                yield rows_of(schema, least=as_long(least[first]), doc=docs[row[first]], n=np.diff(np.append(first, len(row))))
                always = docs[np.unique(w.doc[: len(windows)][windows >= _HEAVY])]
                own = -1 - as_long(mix(always.astype(np.uint64)) >> np.uint64(1))
                yield rows_of(schema, least=own, doc=always, n=np.full(len(always), 2))

    return run


def _send(heavy: np.ndarray, buckets: int, key: str, text: str):
    """Packed strings of the runs whose minimiser is shared (or heavy), to their buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("_shared")), pc.is_valid(batch.column(key))))
            for part in slices(batch, text):
                w = words(part.column(text))
                at, n, least = _strings(w, heavy)
                shared = np.unique(part.column("_shared").flatten().to_numpy().view(np.uint64))
                sent = (least >= _HEAVY) | contains(shared, least)
                at, n, least = at[sent], n[sent], least[sent]
                if not len(at):
                    continue
                data, begin = _canon(w)
                packed = _binaries(data, begin[at], begin[at + n + WINDOW - 1] - 1 - begin[at])
                doc = part.column(key).cast(pa.int64()).to_numpy()[w.doc[at]]
                start = at - w.first[w.doc[at]]
                code = packed.dictionary_encode().indices.to_numpy()
                order = np.lexsort((start, doc, code))
                c, d, s = code[order], doc[order], start[order]
                head = np.ones(len(c), bool)
                head[1:] = c[1:] != c[:-1]
                lead = np.flatnonzero(head)[np.cumsum(head) - 1]
                later = (d != d[lead]) | (s != s[lead])
                first, rest = order[head], order[later]
                yield rows_of(schema, bucket=(least[first] % np.uint64(buckets)).astype(np.int32), doc=doc[first], start=start[first], n=n[first], packed=packed.take(pa.array(first)))
                yield rows_of(schema, bucket=(doc[rest] % buckets).astype(np.int32), doc=doc[rest], start=start[rest], n=n[rest], packed=pa.nulls(len(rest), pa.binary()))

    return run


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes from `a` equal those from `b`, in blocks of bounded memory."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        s = size[at:to]
        differ = data[ranges(a[at:to], s)] != data[ranges(b[at:to], s)]
        if differ.any():
            out[at + np.searchsorted(np.cumsum(s), np.flatnonzero(differ), side="right")] = False
        at = to
    return out


@lean
def _repeats(table: pa.Table) -> pa.Table:
    """(doc, start, n) of the runs of windows in a bucket that have an earlier equal one."""
    known = table.filter(pc.is_null(table["packed"])).select(["doc", "start", "n"])
    sent = table.filter(pc.is_valid(table["packed"]))
    if not sent.num_rows:
        return known
    w = words(sent["packed"].combine_chunks() if sent["packed"].num_chunks != 1 else sent["packed"].chunk(0))
    doc, start, n = (sent[c].to_numpy() for c in ("doc", "start", "n"))
    row = np.repeat(np.arange(len(n)), n)
    offset = ranges(np.zeros(len(n), np.int64), n)
    at = w.first[row] + offset
    h = joined(w.hash, WINDOW)[at]
    order = np.argsort(h, kind="stable")
    g = h[order]
    same = g[1:] == g[:-1]
    twice = np.zeros(len(g), bool)
    twice[1:] = same
    twice[:-1] |= same
    of = order[twice]  # windows whose hash occurs again
    if not len(of):
        return known
    begin, size = w.start[at[of]], w.end[at[of] + WINDOW - 1] - w.start[at[of]]
    place = start[row[of]] + offset[of]
    group = np.cumsum(np.append(True, h[of][1:] != h[of][:-1])) - 1
    inside = np.flatnonzero(group[1:] == group[:-1]) + 1
    alike = size[inside] == size[inside - 1]
    alike[alike] = _equal_bytes(w.data, begin[inside][alike], begin[inside - 1][alike], size[inside][alike])
    for k in np.unique(group[inside[~alike]]):  # texts that share a hash: told apart by their bytes
        own = np.flatnonzero(group == k)
        names: dict[bytes, int] = {}
        for x in own:
            name = w.data[begin[x] : begin[x] + size[x]].tobytes()
            group[x] = names.setdefault(name, int(group.max()) + 1)
    order = np.lexsort((place, doc[row[of]], group))
    c, d, s = group[order], doc[row[of]][order], place[order]
    head = np.ones(len(c), bool)
    head[1:] = c[1:] != c[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = np.sort(of[order[(d != d[lead]) | (s != s[lead])]])
    if not len(later):
        return known
    new = np.ones(len(later), bool)
    new[1:] = (np.diff(later) != 1) | (row[later][1:] != row[later][:-1])
    first = np.flatnonzero(new)
    got = pa.table({"doc": doc[row[later[first]]], "start": start[row[later[first]]] + offset[later[first]], "n": np.diff(np.append(first, len(later)))})
    return pa.concat_tables([known, got.cast(known.schema)])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, n): `n` windows from word `start` of a document that also start earlier.

    A window without any triple but heavy ones is always sent: there are few such strings, and a slice sends each once.
    """
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    heavy = heavy_items(own, _triples)
    buckets = pieces(docs.sparkSession, text_size(own), BUCKET_BYTES)
    # no minimiser that is not heavy has over 1 / HEAVY_PARTS of all rows, so they are dealt by it once, for count and join
    runs = own.mapInArrow(_runs(heavy), "least long, doc long, n int").repartition("least")
    shared = runs.join(runs.groupBy("least").agg(F.sum("n").alias("all")).where("all > 1"), "least", "left_semi")
    lists = shared.groupBy("doc").agg(F.collect_list("least").alias("_shared")).withColumnRenamed("doc", "_doc")
    return _beside(docs, lists, key).mapInArrow(_send(heavy, buckets, key, text), _SENT).groupBy("bucket").applyInArrow(_repeats, _REPEATS)


def _beside(docs: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Every document with its list. Both uses have the same left side, so its shuffle is done once."""
    return docs.join(lists, F.col(f"`{key}`").cast("long") == F.col("_doc"), "left").drop("_doc")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with kept (words left, joined by one space), n_words and n_removed; the integer `key` tells documents apart.

    Columns of `docs` named like those three, or `_doc`, `_repeats` and `_shared`, are replaced.
    """
    added = ("kept", "n_words", "n_removed")
    rest = [f for f in docs.schema.fields if f.name not in (*added, "_doc", "_repeats", "_shared")]
    schema = T.StructType([*rest, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = to_arrow_schema(schema)
    docs = docs.select(*[F.col(f"`{f.name}`") for f in rest])
    runs = repeats(docs, key, text).groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    runs = runs.select(F.col("doc").alias("_doc"), F.struct("starts", "ns").alias("_repeats"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                w = words(part.column(text))
                found = part.column("_repeats")
                starts, ns = found.field("starts"), found.field("ns")
                gone = np.zeros(len(w.hash) + 1, np.int64)
                lists = np.where(np.asarray(found.is_valid()), np.asarray(starts.value_lengths().fill_null(0)), 0)
                if lists.sum():
                    valid = np.asarray(found.is_valid()) & np.asarray(starts.is_valid())
                    picked = pa.array(np.flatnonzero(valid))
                    row = np.repeat(np.flatnonzero(valid), lists[valid])
                    begin = w.first[row] + starts.take(picked).flatten().to_numpy()
                    end = begin + ns.take(picked).flatten().to_numpy() + WINDOW - 1
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, end, -1)
                keep = np.cumsum(gone)[:-1] == 0
                data, at = _canon(w)
                kept = np.flatnonzero(keep)
                count = np.bincount(w.doc[kept], minlength=part.num_rows)
                size = np.bincount(w.doc[kept], weights=(at[1:] - at[:-1])[kept], minlength=part.num_rows).astype(np.int64)
                body = data[ranges(at[:-1][kept], (at[1:] - at[:-1])[kept])]
                ends = np.cumsum(size)
                strings = _binaries(body, ends - size, np.maximum(size - 1, 0)).cast(pa.binary()).cast(pa.string())
                n = np.diff(w.first)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), strings, pa.array(n), pa.array(n - count)], schema=arrow)

    return _beside(docs, runs, key).mapInArrow(run, schema)
