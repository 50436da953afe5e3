"""Language-model scoring by the subword lattice of an existing vocabulary.

A word, marked at its beginning, can be cut into pieces of the vocabulary in many ways; single bytes are pieces too, so
every word can be cut. The model is a unigram distribution over pieces and one end token, and a text's probability is the
sum over all of its segmentations, by a forward recursion in log space (each step's largest term is taken out). Pieces
never cross words, so a text's log probability is the sum of its words' and the end's.

The vocabulary's own scores order the pieces and give the first distribution; `ROUNDS` passes of expectation-maximisation
over the counts of all training words fit it. Word counts are grouped by Spark and never leave it; per pass, expected
counts of the pieces reach the driver, one number for each piece of the vocabulary.

Texts are scored without moving them: blocks of documents send their distinct words, with who has them how often, to
ranges of the word hash, where each word meets its training count and gets its lattice sum once; partial sums return to
the block. Defined results: a null text is empty and has the end token only. Without training texts N and V are 0 and
nothing is known. Rows that repeat a key are scored each; a null key is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.blobs import block_ids, pack, unpack
from premia.llm.common import as_long, flat, pieces, rows_of, slices, text_size, words, written

ROUNDS = 2
#: Added to the expected count of each piece, so that none is impossible.
SMOOTH = 0.01
#: Longer words (in bytes, with the mark) are cut by the same recursion, over bands of positions, so that memory stays bounded.
LONG = 96
#: Bytes of a block of long words, and places of pieces that are looked up at once for it.
_LONG_BYTES, _BAND = 1 << 16, 1 << 20
MARK = "▁".encode()
_BLOCK_BYTES, _RANGE_BYTES = 4 << 20, 8 << 20
_BASE = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Pieces:
    """Pieces as bytes, in the vocabulary's order, then the 256 bytes; tables that find one by hash."""

    names: tuple[bytes, ...]
    hashes: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]
    longest: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash's piece, or the number of pieces."""
        out = np.full(h.shape, len(self.names), np.int32)
        for table, shift in zip(self.tables, (44, 24), strict=True):
            at = table[((h >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)]
            hit = self.hashes[at] == h
            hit &= at < len(self.names)
            out[hit] = at[hit]
        return out


def _scatter(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hash(piece: bytes) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + c + 1) % (1 << 64)
    return int(_scatter(np.array([h], np.uint64))[0])


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Pieces:
    """Pieces of a vocabulary file; control and unknown pieces are left out, byte pieces are the bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usual = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    names = [model.id_to_piece(k).encode() for k in sorted(usual, key=lambda k: (-model.get_score(k), k))]
    single = {x for x in names if len(x) == 1}
    names += [bytes([c]) for c in range(256) if bytes([c]) not in single]
    hashes = np.array([_hash(x) for x in names] + [0], np.uint64)
    tables = (np.full(1 << 20, len(names), np.int32), np.full(1 << 20, len(names), np.int32))
    for k, h in enumerate(hashes[:-1].tolist()):
        for table, shift in zip(tables, (44, 24), strict=True):
            slot = (h >> shift) & ((1 << 20) - 1)
            if table[slot] == len(names):
                table[slot] = k
                break
        else:
            raise ValueError("two pieces cannot be told apart by their hashes")
    return Pieces(tuple(names), hashes, tables, max(map(len, names)))


def first_scores(vocab: Pieces) -> np.ndarray:
    """Log probabilities that fall with the rank of the vocabulary's score."""
    p = 1 / (np.arange(len(vocab.names)) + 10.0)
    return np.log(p / p.sum())


def _spans(vocab: Pieces, data: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Piece of every (from, to) of words of one length (rows of `data`), where any word has one."""
    n, size = data.shape
    out = {}
    for a in range(size):
        h = np.zeros(n, np.uint64)
        for b in range(a + 1, min(size, a + vocab.longest) + 1):
            h = h * _BASE + (data[:, b - 1].astype(np.uint64) + np.uint64(1))
            at = vocab.find(_scatter(h))
            if b == a + 1 or (at < len(vocab.names)).any():
                out[a, b] = at
    return out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _forward(spans: dict, n: int, size: int, score: np.ndarray) -> list[np.ndarray]:
    """Log sums over the cuts of each prefix; `score` has -inf for no piece at its end."""
    alpha = [np.zeros(n)] + [np.full(n, -np.inf) for _ in range(size)]
    for a, b in sorted(spans, key=lambda x: (x[1], x[0])):
        alpha[b] = _add(alpha[b], alpha[a] + score[spans[a, b]])
    return alpha


def _found(vocab: Pieces, data: np.ndarray, sizes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, from, to, piece) of all pieces that begin at `first` or later and before `last`, in order of where they begin."""
    n, size = data.shape
    h = np.zeros((last - first, n), np.uint64)
    at = np.full((last - first, vocab.longest, n), len(vocab.names), np.int32)
    for k in range(vocab.longest):
        m = min(last, size - k) - first
        if m <= 0:
            break
        h[:m] = h[:m] * _BASE + (data[:, first + k : first + k + m].T.astype(np.uint64) + np.uint64(1))
        at[:m, k] = vocab.find(_scatter(h[:m]))
    a, k, word = np.nonzero(at < len(vocab.names))
    piece, a = at[a, k, word], a + first
    to = a + k + 1
    inside = to <= sizes[word]
    return word[inside], a[inside], to[inside], piece[inside]


def _push(into: np.ndarray, start: np.ndarray, word: np.ndarray, source: np.ndarray, target: np.ndarray, value: np.ndarray) -> None:
    """Adds `value` and what has reached its source to each target (in log space); rows are grouped by source at `start`."""
    for x, y in zip(start[:-1], start[1:], strict=True):
        w, t = word[x:y], target[x:y]
        into[w, t] = _add(into[w, t], into[w, source[x:y]] + value[x:y])


def _cuts(x: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.diff(x, prepend=x[:1] - 1)), len(x)) if len(x) else np.zeros(1, np.int64)


def _banded(vocab: Pieces, data: np.ndarray, sizes: np.ndarray, score: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log sums of long words (rows of `data`, filled up behind their `sizes`), and the expected number of each piece in
    `weight` copies: the recursions of `_forward` and `expected`, with the pieces of a band of positions at a time."""
    n, size = data.shape
    step = max(1, min(size, _BAND // (n * vocab.longest)))
    alpha = np.full((n, size + 1), -np.inf)
    alpha[:, 0] = 0
    for first in range(0, size, step):
        word, a, b, piece = _found(vocab, data, sizes, first, min(size, first + step))
        _push(alpha, _cuts(a), word, a, b, score[piece])
    whole, total = alpha[np.arange(n), sizes], np.zeros(len(score))
    if weight is None:
        return whole, total
    beta = np.full((n, size + 1), -np.inf)
    beta[np.arange(n), sizes] = 0
    # pieces that end in a band, from the last band to the first; those that end later have all been pushed
    for last in range(size, 0, -step):
        first = max(0, last - step)
        word, a, b, piece = _found(vocab, data, sizes, max(0, first + 1 - vocab.longest), last)
        order = np.flatnonzero((first < b) & (b <= last))
        order = order[np.argsort(-b[order], kind="stable")]
        word, a, b, piece = word[order], a[order], b[order], piece[order]
        value = score[piece]
        _push(beta, _cuts(-b), word, b, a, value)
        total += np.bincount(piece, weights=weight[word] * np.exp(alpha[word, a] + value + beta[word, b] - whole[word]), minlength=len(total))
    return whole, total


def _blocks_of_long(found: pa.Array, rows: np.ndarray):
    """Blocks of marked long words of like length: their rows, bytes (zeros behind the shorter ones) and sizes."""
    data, bounds = flat(found)
    size = np.diff(bounds)
    rows = rows[np.argsort(size[rows], kind="stable")]
    mark, at = np.frombuffer(MARK, np.uint8), 0
    while at < len(rows):
        some = rows[at : at + 256]
        # as many as stay within the bytes of a block; one word always does
        some = some[: max(1, int((np.arange(1, len(some) + 1) * (size[some] + len(mark)) <= _LONG_BYTES).sum()))]
        block = np.zeros((len(some), int(size[some].max()) + len(mark)), np.uint8)
        block[:, : len(mark)] = mark
        for k, r in enumerate(some):
            block[k, len(mark) : len(mark) + size[r]] = data[bounds[r] : bounds[r + 1]]
        yield some, block, size[some] + len(mark)
        at += len(some)


def _by_length(found: pa.Array, rows: np.ndarray, most: int = 1 << 14):
    """Blocks of marked words of one length: their rows and bytes."""
    data, bounds = flat(found)
    size = np.diff(bounds)
    order = rows[np.argsort(size[rows], kind="stable")]
    cuts = _cuts(size[order])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(size[order[a]])
        for at in range(a, b, most):
            rows = order[at : min(b, at + most)]
            body = data[bounds[rows][:, None] + np.arange(n)]
            yield rows, np.hstack([np.broadcast_to(np.frombuffer(MARK, np.uint8), (len(rows), len(MARK))), body])


def _by_size(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of LONG bytes at most, with the mark, and of longer ones."""
    long = np.diff(flat(found)[1]) + len(MARK) > LONG
    return np.flatnonzero(~long), np.flatnonzero(long)


def word_scores(vocab: Pieces, score: np.ndarray, found: pa.Array) -> np.ndarray:
    """Natural log of each word's probability, summed over its segmentations."""
    out, score = np.zeros(len(found)), np.append(score, -np.inf)
    short, long = _by_size(found)
    for rows, data in _by_length(found, short):
        out[rows] = _forward(_spans(vocab, data), len(rows), data.shape[1], score)[-1]
    for rows, data, sizes in _blocks_of_long(found, long):
        out[rows] = _banded(vocab, data, sizes, score)[0]
    return out


def expected(vocab: Pieces, score: np.ndarray, found: pa.Array, count: np.ndarray) -> np.ndarray:
    """Expected number of each piece in `count` copies of each word."""
    total, score = np.zeros(len(vocab.names) + 1), np.append(score, -np.inf)
    short, long = _by_size(found)
    for rows, data in _by_length(found, short, 1 << 12):
        n, size = data.shape
        weight = count[rows].astype(float)
        spans = _spans(vocab, data)
        alpha = _forward(spans, n, size, score)
        beta = [np.full(n, -np.inf) for _ in range(size)] + [np.zeros(n)]
        for a, b in sorted(spans, key=lambda x: (-x[0], x[1])):
            beta[a] = _add(beta[a], beta[b] + score[spans[a, b]])
        for (a, b), at in spans.items():
            total += np.bincount(at, weights=weight * np.exp(alpha[a] + score[at] + beta[b] - alpha[-1]), minlength=len(total))
    for rows, data, sizes in _blocks_of_long(found, long):
        total += _banded(vocab, data, sizes, score, count[rows].astype(float))[1]
    return total[:-1]


@dataclass(frozen=True)
class Model:
    """Log probabilities of pieces and of the end; training words, all tokens (N), distinct ones (V), ends."""

    model_file: str
    score: np.ndarray
    end: float
    counts: DataFrame
    total: int
    distinct: int
    ends: int


def fit(docs: DataFrame, model_file: str, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Learns from all rows of `docs`."""
    schema = pa.schema([("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            for part in slices(batch, text, _BLOCK_BYTES):
                w = words(part.column(text), lower=True)
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                yield rows_of(schema, word=w.text(first).cast(pa.string()), h=as_long(h), n=n)

    found = docs.select(text).mapInArrow(count, "word string, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n"))
    counts = written(found)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.count()
    vocab = vocabulary(model_file)
    score, value = first_scores(vocab), np.ones(len(vocab.names))
    sums = pa.schema([("piece", pa.int32()), ("value", pa.float64())])
    for _ in range(rounds):

        def expect(batches, score=score):
            own, all_ = vocabulary(model_file), np.zeros(len(score))
            for batch in batches:
                for at in range(0, batch.num_rows, 1 << 16):
                    part = batch.slice(at, 1 << 16)
                    all_ += expected(own, score, part.column("word"), part.column("n").to_numpy())
            used = np.flatnonzero(all_)
            yield rows_of(sums, piece=used.astype(np.int32), value=all_[used])

        value = np.full(len(score), SMOOTH)
        for r in counts.select("word", "n").mapInArrow(expect, "piece int, value double").groupBy("piece").agg(F.sum("value").alias("value")).collect():
            value[r.piece] += r.value
        score = np.log(value / (value.sum() + ends + SMOOTH))
    end = float(np.log((ends + SMOOTH) / (value.sum() + ends + SMOOTH)))
    return Model(model_file, score, end, counts, int(total) + ends, int(distinct) + (ends > 0), ends)


_SENT = "part int, block long, kind int, payload binary"


def _send(parts: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        ids = block_ids()
        for batch in batches:
            for some in slices(batch, "text", _BLOCK_BYTES):
                block = next(ids)
                w = words(some.column("text"), lower=True)
                key = some.column("key")
                known = key.is_valid().to_numpy(zero_copy_only=False)
                payload = [pack(key.fill_null(0).to_numpy(), known.astype(np.uint8), np.diff(w.first).astype(np.int64))]
                h, first, code = np.unique(w.hash, return_index=True, return_inverse=True)
                pair, n = np.unique(code.astype(np.int64) * some.num_rows + w.doc, return_counts=True)
                part = (as_long(h) % parts).astype(np.int32)
                order = np.argsort(part, kind="stable")
                place = np.empty(len(h), np.int64)
                place[order] = np.arange(len(h))
                where, row = place[pair // max(1, some.num_rows)], pair % max(1, some.num_rows)
                by = np.argsort(where, kind="stable")
                where, row, n = where[by], row[by], n[by]
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cuts))
                text = w.text(first[order])
                size = pc.binary_length(text).to_numpy().astype(np.uint32)
                ends = np.append(0, np.cumsum(size.astype(np.int64)))
                body, _ = flat(text)
                for p in used:
                    a, b = cuts[p], cuts[p + 1]
                    x, y = np.searchsorted(where, [a, b])
                    payload.append(pack(size[a:b], body[ends[a] : ends[b]], np.diff(where[x:y], prepend=a).astype(np.uint32), row[x:y].astype(np.uint32), n[x:y].astype(np.uint32)))
                yield rows_of(schema, part=np.append(block % parts, used), block=np.full(len(payload), block), kind=np.append(0, np.ones(len(used), int)), payload=payload)

    return run


def _strings(size: np.ndarray, body: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(size.astype(np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def _meet(model_file: str, score: np.ndarray):
    """Of one range of words: partial sums of each block's documents."""

    def run(sent: pa.Table, counts: pa.Table) -> pa.Table:
        kind, block, payload = sent["kind"].to_numpy(), sent["block"].to_numpy(), sent["payload"].to_pylist()
        out_block, out_kind, out = [*block[kind == 0]], [0] * int((kind == 0).sum()), [p for p, k in zip(payload, kind, strict=True) if k == 0]
        here = np.flatnonzero(kind == 1)
        if len(here):
            found = [unpack(payload[k]) for k in here]
            coded = pa.chunked_array([_strings(f[0], f[1]) for f in found]).combine_chunks().dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy()
            c = np.zeros(len(names), np.int64)
            if counts.num_rows:
                at = pc.index_in(names, value_set=counts["word"].combine_chunks().cast(pa.large_binary())).fill_null(-1).to_numpy()
                c[at >= 0] = counts["n"].to_numpy()[at[at >= 0]]
            log = word_scores(vocabulary(model_file), score, names) / np.log(10)
            base = np.log10(c + 1.0)
            first = 0
            for k, (size, _, step, row, n) in zip(here, found, strict=True):
                word = code[first + np.cumsum(step.astype(np.int64))]
                first += len(size)
                sums = [np.bincount(row, weights=n * x[word]) for x in (c > 0, base, log)]
                used = np.flatnonzero(np.bincount(row))
                out_block.append(block[k])
                out_kind.append(1)
                out.append(pack(used.astype(np.uint32), np.rint(sums[0][used]).astype(np.uint32), sums[1][used], sums[2][used]))
        return pa.table({"block": pa.array(out_block, pa.int64()), "kind": pa.array(out_kind, pa.int32()), "payload": pa.array(out, pa.binary())})

    return run


def _gather(table: pa.Table) -> pa.Table:
    kind, payload = table["kind"].to_numpy(), table["payload"].to_pylist()
    key, known, n = unpack(payload[int(np.flatnonzero(kind == 0)[0])])
    sums = np.zeros((3, len(key)))
    parts = sorted(payload[k] for k in np.flatnonzero(kind == 1))  # a fixed order, so that sums repeat exactly
    for blob in parts:
        row, *value = unpack(blob)
        for s, v in zip(sums, value, strict=True):
            s[row] += v
    return pa.table({"key": pa.array(key, mask=known == 0), "words": n, "known": np.rint(sums[0]).astype(np.int64), "base": sums[1], "log": sums[2]})


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row, logs to base 10."""
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = pieces(docs.sparkSession, text_size(own), _RANGE_BYTES)
    sent = own.mapInArrow(_send(parts), _SENT)
    counts = model.counts.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), "word", "n")
    met = sent.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_meet(model.model_file, model.score), "block long, kind int, payload binary")
    sums = met.groupBy("block").applyInArrow(_gather, "key long, words long, known long, base double, log double")
    n = F.col("words") + 1
    whole = float(np.log10(model.total + model.distinct + 1))
    return sums.select(
        F.col("key").alias(key),
        n.alias("n_tokens"),
        (F.col("known") + int(model.ends > 0)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(model.ends + 1)) - n * whole).alias("base_score"),
        (F.col("log") + model.end / float(np.log(10))).alias("score"),
    )
