"""Lexical retrieval packing: documents that share rare words fill the same training windows.

Documents are dealt to shards of bounded size by a hash of their key. A shard builds an inverted index with BM25 weights,
takes its first unused document as the seed of a window, scores all documents of the shard against the seed's terms and
appends unused ones, best first, until the window is full. A document that does not fit is cut, and its rest seeds the
next window. Only the last window of a shard can be short, so padding is at most one window per shard.

Every document is tokenised whole. Words are tokenised once per worker and slice: the tokenizer drops white space and
never joins across it, so the ids of a text are those of its words one after another.

Defined results: a null text is empty, and an empty text is the end id alone. Documents without common terms follow in
order of their key, as do ties. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from premia.llm.common import flat, lean, pieces, ranges, text_size

WINDOW, END = 4096, 2
#: Text bytes of a shard.
SHARD_BYTES = 4 << 20
#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: Parts of words whose ids a worker remembers.
REMEMBERED = 800_000
#: Words encoded at once: the tokenizer's results for them take some 2 KB each until they are read.
_ENCODED = 8192
#: ASCII characters that are neither letters, digits nor white space.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: A digit, or a Latin or Cyrillic letter that is one letter in lower case and composed, at the end.
_PLAIN = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{410}-\x{44F}]\z"
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would take all of the machine's
    return Tokenizer.from_file(path)


class _Memory:
    """Words as one Arrow column, and their ids end to end; some 40 bytes a word."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)


_MEMORY: dict[str, _Memory] = {}


def _encode(path: str, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each string end to end, and the number of each."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(found), _ENCODED):
        ids = [x.ids for x in tokenizer(path).encode_batch_fast(found[at : at + _ENCODED], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        parts.append(np.fromiter((y for x in ids for y in x), np.int32, int(size.sum())))
        sizes.append(size)
    return np.concatenate(parts), np.concatenate(sizes)


def _strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(start, size)])))


@lru_cache(maxsize=2)
def _added(path: str) -> list[str]:
    """Texts that the tokenizer looks for before all else."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def _marks_apart(path: str, found: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct parts of words, and each word's two parts: what it is without ASCII marks at its end, and these marks.

    The tokenizer never joins letters or digits with marks, so the ids of a word whose marks follow one are those of its
    parts. Any other word is one part, and its marks are empty; so is one whose last letter may change when it is normalised.
    """
    stem = pc.utf8_rtrim(found, characters=_MARKS)
    apart = np.asarray(pc.match_substring_regex(stem, _PLAIN).to_numpy(zero_copy_only=False), bool)
    for text in _added(path):
        apart &= ~np.asarray(pc.match_substring(found, text).to_numpy(zero_copy_only=False), bool)
    data, bounds = flat(found)
    whole = np.diff(bounds)
    size = np.where(apart, np.asarray(pc.binary_length(stem), np.int64), whole)
    both = pa.concat_arrays([_strings(data, bounds[:-1], size), _strings(data, bounds[:-1] + size, whole - size)]).dictionary_encode()
    code = both.indices.to_numpy(zero_copy_only=False)
    return both.dictionary, code[: len(found)], code[len(found) :]


def word_ids(path: str, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct words: a pool of ids, and each word's start and size in it."""
    parts, stem, marks = _marks_apart(path, found)
    pool, start, size = _part_ids(path, parts)
    count = size[stem] + size[marks]
    begin = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), np.int32)
    ids[ranges(begin, size[stem])] = pool[ranges(start[stem], size[stem])]
    ids[ranges(begin + size[stem], size[marks])] = pool[ranges(start[marks], size[marks])]
    return ids, begin, count


def _part_ids(path: str, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of distinct parts; a worker remembers them."""
    memory = _MEMORY.setdefault(path, _Memory())
    place = pc.fill_null(pc.index_in(found, value_set=memory.words), -1).to_numpy(zero_copy_only=False)
    old, new = place >= 0, np.flatnonzero(place < 0)
    unknown = found.take(pa.array(new))
    ids, size = _encode(path, unknown.to_pylist())
    pool = np.concatenate([memory.ids, ids])
    start, sizes = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    start[old], sizes[old] = memory.bounds[place[old]], np.diff(memory.bounds)[place[old]]
    start[new], sizes[new] = len(memory.ids) + np.cumsum(size) - size, size
    more = min(len(new), REMEMBERED - len(memory.words))
    if more > 0:
        memory.words = pa.concat_arrays([memory.words, unknown.slice(0, more)])
        memory.bounds = np.concatenate([memory.bounds, memory.bounds[-1] + np.cumsum(size[:more])])
        memory.ids = pool[: memory.bounds[-1]].copy()
    return pool, start, sizes


def _split(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each word of all texts, the distinct words, and the row bounds among the codes."""
    data, bounds = flat(text)
    space = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | edge[1 : len(data)]
    ends[:-1] &= space[1:] | edge[1 : len(data)]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    body = np.ascontiguousarray(data[ranges(start, size)])
    found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary, np.searchsorted(start, bounds)


class Index:
    """Postings of a shard with their BM25 weights; terms in over half of the documents weigh nothing."""

    def __init__(self, code: np.ndarray, row: np.ndarray, n: int) -> None:
        key, tf = np.unique(code.astype(np.int64) * n + row, return_counts=True)
        term, doc = key // n, key % n
        length = np.bincount(row, minlength=n)
        df = np.bincount(term)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        useful = (idf[term] > 0) & (df[term] > 1)
        term, doc, tf = term[useful], doc[useful], tf[useful]
        self.doc = doc
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.first = np.searchsorted(term, np.arange(len(df) + 1))
        order = np.lexsort((term, doc))
        self.terms, self.of = term[order], np.searchsorted(doc[order], np.arange(n + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        at = ranges(self.first[terms], self.first[terms + 1] - self.first[terms])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def _order(index: Index, size: np.ndarray, window: int) -> list[int]:
    """Documents in the order in which they fill the shard's windows."""
    left = np.ones(len(size), bool)
    out: list[int] = []
    seed, free, following = -1, 0, 0  # free: room in the window that is being filled
    while len(out) < len(size):
        if seed < 0:
            while not left[following]:
                following += 1
            seed = following
            left[seed] = False
            out.append(seed)
            free = (free - size[seed]) % window
            if free == 0:
                seed = -1
                continue
        score = index.scores(seed)
        near = np.flatnonzero(left & (score > 0))
        order = near[np.argsort(-score[near], kind="stable")]
        cut = int(np.searchsorted(np.cumsum(size[order]), free, side="left"))
        chosen = order[: cut + 1]
        left[chosen] = False
        out.extend(chosen.tolist())
        total = int(size[chosen].sum())
        if cut < len(order):  # the last one fills the window, and what is left of it seeds the next
            free = (free - total) % window
            seed = int(chosen[-1]) if free else -1
        else:
            free -= total
            seed = -1
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = pieces(docs.sparkSession, text_size(own), shard_bytes)

    @lean
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        n = table.num_rows
        shard = table["shard"][0].as_py()
        texts = pc.fill_null(table["text"].combine_chunks().cast(pa.large_string()), "")
        code, found, first = _split(texts)
        pool, at, count = word_ids(path, found)
        row = np.repeat(np.arange(n), np.diff(first))
        word_size = count[code]
        tokens = np.bincount(row, weights=word_size, minlength=n).astype(np.int64)
        size = tokens + 1
        order = np.array(_order(Index(code, row, n), size, window), np.int64)
        # each document's words, in the order of the windows, and the end id
        ids = pool[ranges(at[code], word_size)]
        begin = np.cumsum(tokens) - tokens
        stream = np.empty(int(size.sum()), np.uint32)
        place = np.cumsum(size[order]) - size[order]
        stream[ranges(place, tokens[order])] = ids[ranges(begin[order], tokens[order])]
        stream[place + tokens[order]] = end
        # pieces end where a document or a window does
        cuts = np.unique(np.concatenate([place, np.arange(0, len(stream), window)]))
        length = np.diff(np.append(cuts, len(stream)))
        which = np.searchsorted(place, cuts, side="right") - 1
        offsets = np.append(cuts, len(stream)) * 4
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(stream.astype("<u4"))])
        return pa.table({
            "doc_id": table["doc_id"].combine_chunks().take(pa.array(order[which])), "start": cuts - place[which], "length": length, "ids": body.cast(pa.binary()),
            "doc_tokens": size[order][which], "sequence_id": (np.int64(shard) << 32) + cuts // window, "offset": cuts % window,
        })

    dealt = own.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, _SCHEMA)
