"""Near-duplicate documents by the Jaccard similarity of their word shingles, with token-combination prefixes.

A token is the hash of a shingle. Every token's document frequency is counted over all documents: blocks of documents send
their tokens, packed, to ranges of the token space, which return those that occur in several documents. A document's
tokens are ordered from rare to frequent; two similar documents must share tokens among the first of that order. With
prefixes extended by `m` tokens they share `m + 1` there: either a rare token, which is indexed alone, or `m + 1` frequent
ones, two of which fall into the same one of `m` token classes, so that pairs of frequent tokens of a class are indexed.

Documents with equal token sets form one class, represented by its smallest id. Candidates that share a signature are
verified on their exact token sets: first all with the smallest of their group, then, in groups that are not yet one
component, the pairs across components. Pairs inside a component cannot change the result and are never made; of the
others, sizes and bitmaps of the tokens tell which cannot be similar, block by block inside a task, and those do not become
rows either. Signatures that the same documents have (by number, smallest id and a 64-bit sum) are one group, and a group
over PART_ROWS documents is split, each pair of its parts being a block of its own.

Tokens are 56 bits of a hash: a false match inside one pair of documents has odds of about 1 in 10^12 for usual texts.

Defined results: texts are lower-cased in A-Z; a document's set is its distinct shingles, with fewer words than a shingle
the whole sequence as one, without words empty. Empty sets link with nothing. A null text is empty. Rows without a key
take no part and have null results. Rows that repeat a key are one document that has each of their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.blobs import block_ids, pack, unpack
from premia.llm.common import as_long, components, contains, heavy_items, joined, lean, mix, pieces, ranges, rows_of, slices, text_size, words, written

SHINGLE, PERCENT = 5, 80
#: Documents that a rare token occurs in at most.
RARE = 16
#: Bits of the map that bounds two documents' common tokens from above.
BITS = 2048
#: Rows of a signature's group that one task compares with each other; larger groups are split, and every pair of parts compared.
PART_ROWS = 4096
_BLOCK_BYTES, _RANGE_BYTES = 2 << 20, 6 << 20
_WORK_BYTES = 512 << 10
_PAIRS = 1 << 15
_MOST = np.uint32(1 << 31)
_SENT = "part int, block long, kind int, payload binary"
_SETS = "doc long, n int, d1 long, d2 long, rare int, tokens binary"


def tokens(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each distinct token, in order; worked out for a few rows at a time."""
    rows, found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for some in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text", _WORK_BYTES):
        r, t = _tokens(some.column(0), size)
        rows.append(r + at)
        found.append(t)
        at += some.num_rows
    return np.concatenate(rows), np.concatenate(found)


def _tokens(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    w = words(text, lower=True)
    count = np.diff(w.first)
    h = joined(w.hash, size)
    whole = w.doc[: len(h)] == w.doc[size - 1 :] if len(h) else np.zeros(0, bool)
    row, token = [w.doc[: len(h)][whole]], [h[whole]]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        place = np.arange(len(w.hash)) - w.first[w.doc]
        own = (count < size)[w.doc]
        value = np.zeros(len(text), np.uint64)
        np.add.at(value, w.doc[own], mix(w.hash[own] + place[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        row.append(short)
        token.append(mix(value[short] + count[short].astype(np.uint64)))
    r, t = np.concatenate(row), np.concatenate(token) >> np.uint64(8)
    order = np.lexsort((t, r))
    r, t = r[order], t[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    return r[new], t[new]


def _send(heavy: np.ndarray, parts: int, size: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        ids = block_ids()
        for batch in batches:
            for some in slices(batch, "text", _BLOCK_BYTES):
                block, n = next(ids), some.num_rows
                row, token = tokens(some.column("text"), size)
                count = np.bincount(row, minlength=n).astype(np.int32)
                d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(d1, row, mix(token))
                np.add.at(d2, row, mix(token ^ np.uint64(0x5DEECE66D)))
                often = contains(heavy, token)
                head = pack(some.column("doc").to_numpy(zero_copy_only=False), count, as_long(d1), as_long(d2), row[often].astype(np.uint32), token[often])
                row, token = row[~often].astype(np.uint32), token[~often]
                order = np.argsort(token, kind="stable")
                row, token = row[order], token[order]
                part = (token >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)
                cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cuts))
                payload = [head, *(pack(np.diff(token[a:b], prepend=np.uint64(0)), row[a:b]) for a, b in zip(cuts[used], cuts[used + 1], strict=True))]
                yield rows_of(schema, part=np.append(block % parts, used), block=np.full(len(payload), block), kind=np.append(0, np.ones(len(used), int)), payload=payload)

    return run


@lean
def _count(table: pa.Table) -> pa.Table:
    """Of one range of tokens: those in several documents with their frequency, by block; heads pass through."""
    kind, block, payload = table["kind"].to_numpy(), table["block"].to_numpy(), table["payload"].to_pylist()
    out_block, out_kind, out = [*block[kind == 0]], [0] * int((kind == 0).sum()), [p for p, k in zip(payload, kind, strict=True) if k == 0]
    sent = np.flatnonzero(kind == 1)
    if len(sent):
        found = [unpack(payload[k]) for k in sent]
        token = np.concatenate([np.cumsum(t, dtype=np.uint64) for t, _ in found])
        size = np.array([len(t) for t, _ in found])
        order = np.argsort(token, kind="stable")
        t = token[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        df = np.empty(len(t), np.uint32)
        df[order] = np.repeat(np.diff(np.append(first, len(t))), np.diff(np.append(first, len(t)))).astype(np.uint32)
        at = 0
        for k, (_, row), n in zip(sent, found, size, strict=True):
            shared = df[at : at + n] > 1
            if shared.any():
                out_block.append(block[k])
                out_kind.append(1)
                out.append(pack(np.diff(token[at : at + n][shared], prepend=np.uint64(0)), row[shared], df[at : at + n][shared]))
            at += n
    return pa.table({"block": pa.array(out_block, pa.int64()), "kind": pa.array(out_kind, pa.int32()), "payload": pa.array(out, pa.binary())})


@lean
def _gather(table: pa.Table) -> pa.Table:
    """One row per document of a block; tokens (rare first) only where enough are shared for any link."""
    kind, payload = table["kind"].to_numpy(), table["payload"].to_pylist()
    doc, n, d1, d2, row, token = unpack(payload[int(np.flatnonzero(kind == 0)[0])])
    rows, toks, dfs = [row], [token], [np.full(len(row), _MOST)]
    for k in np.flatnonzero(kind == 1):
        t, r, f = unpack(payload[k])
        rows.append(r)
        toks.append(np.cumsum(t, dtype=np.uint64))
        dfs.append(f)
    r, t, f = np.concatenate(rows), np.concatenate(toks), np.concatenate(dfs)
    shared = np.bincount(r, minlength=len(doc))
    enough = (n > 0) & (100 * shared >= PERCENT * n.astype(np.int64))
    own = enough[r]
    r, t, f = r[own], t[own], f[own]
    order = np.lexsort((t, f, r))
    r, t, f = r[order], t[order], f[order]
    cuts = np.searchsorted(r, np.arange(len(doc) + 1))
    rare = np.bincount(r[f <= RARE], minlength=len(doc))
    blobs = [pack(t[cuts[k] : cuts[k + 1]]) if enough[k] else None for k in range(len(doc))]
    return pa.table({"doc": doc, "n": pa.array(n, pa.int32()), "d1": d1, "d2": d2, "rare": pa.array(rare, pa.int32()), "tokens": pa.array(blobs, pa.binary())})


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Every document's number of tokens and a digest of its set; its shared tokens where it can have a link."""
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    heavy = heavy_items(own.select("text"), lambda column: tokens(column, size)[1])
    parts = pieces(docs.sparkSession, text_size(own), _RANGE_BYTES)
    sent = own.mapInArrow(_send(heavy, parts, size), _SENT)
    counted = sent.groupBy("part").applyInArrow(_count, "block long, kind int, payload binary")
    return written(counted.groupBy("block").applyInArrow(_gather, _SETS))


def _classes(level: np.ndarray | int):
    """Token classes of documents with 2^level to 2^(level+1) tokens; none for small ones, where all tokens count as rare."""
    return np.where(np.asarray(level) >= 5, 1 << np.maximum(np.asarray(level) - 3, 0), 0)


def _signatures(batches):
    schema = pa.schema([("sig", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("s", pa.int32())])
    for batch in batches:
        sig, which = [], []
        doc, size, rares = (batch.column(c).to_numpy() for c in ("doc", "n", "rare"))
        shared = np.zeros(batch.num_rows, np.int64)
        for k, blob in enumerate(batch.column("tokens").to_pylist()):
            (t,) = unpack(blob)
            n, rare, shared[k] = int(size[k]), int(rares[k]), len(t)
            base = n - -(-PERCENT * n // 100)  # tokens a similar document may lack
            alone, found = 0, []
            for level in {n.bit_length() - 1, (100 * n // PERCENT).bit_length() - 1}:
                m = int(_classes(level))
                prefix = t[: max(0, base + m + 1 - (n - len(t)))]
                if not m:
                    alone = max(alone, len(prefix))
                    continue
                alone = max(alone, min(rare, len(prefix)))
                often = prefix[rare:]
                if len(often) > 1:
                    kind = mix(often) % np.uint64(m)
                    order = np.argsort(kind, kind="stable")
                    often, kind = often[order], kind[order]
                    for step in range(1, len(often)):  # pairs `step` apart in the same class
                        same = kind[step:] == kind[:-step]
                        if not same.any():
                            break
                        a, b = often[step:][same], often[:-step][same]
                        found.append(mix(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + mix(np.maximum(a, b)) + np.uint64(level)))
            found.append(t[:alone] << np.uint64(8))
            both = np.unique(np.concatenate(found))
            sig.append(both)
            which.append(np.full(len(both), k))
        if sig:
            w = np.concatenate(which)
            yield rows_of(schema, sig=as_long(np.concatenate(sig)), doc=doc[w], n=size[w], s=shared[w])


def _bitmaps(batches):
    """A bitmap of each document's tokens: a bit that only one of two documents has is a token that only it has."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("s", pa.int32()), ("bits", pa.binary())])
    for batch in batches:
        size, bits = [], []
        for blob in batch.column("tokens").to_pylist():
            (t,) = unpack(blob)
            on = np.zeros(BITS, bool)
            on[(mix(t) % np.uint64(BITS)).astype(np.int64)] = True
            size.append(len(t))
            bits.append(np.packbits(on).tobytes())
        yield rows_of(schema, doc=batch.column("doc"), n=batch.column("n"), s=size, bits=pa.array(bits, pa.binary()))


def _near(batches):
    """(a, b) of each cell's rows that may be similar, from rows in the order of their cells.

    A cell holds a group's rows, or two parts of a large group, of which only rows of different parts meet.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cell = _cells(rows)
        done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        yield from (rows_of(schema, a=a, b=b) for a, b in _pairs(rows.slice(0, done), cell[:done]))
        held = rows.slice(done).combine_chunks()
    if held is not None:
        yield from (rows_of(schema, a=a, b=b) for a, b in _pairs(held, _cells(held)))


def _cells(rows: pa.Table) -> np.ndarray:
    """Number of each row's cell, from 0."""
    sig, one, two = (rows[c].to_numpy() for c in ("sig", "one", "two"))
    return np.cumsum((np.diff(sig, prepend=sig[:1]) != 0) | (np.diff(one, prepend=one[:1]) != 0) | (np.diff(two, prepend=two[:1]) != 0))


def _pairs(rows: pa.Table, cell: np.ndarray):
    if not rows.num_rows:
        return
    doc, n, s, part, mine, one, two = (rows[c].to_numpy() for c in ("doc", "n", "s", "component", "mine", "one", "two"))
    n, s = n.astype(np.int64), s.astype(np.int64)
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
    on = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    after = np.searchsorted(cell, cell, side="right") - np.arange(len(cell)) - 1  # rows of the cell that follow
    total = np.cumsum(after)
    at = 0
    while at < len(cell):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
        left = np.repeat(np.arange(at, to), after[at:to])
        right = ranges(np.arange(at, to) + 1, after[at:to])
        at = to
        meet = (part[left] != part[right]) & ((one[left] == two[left]) | (mine[left] != mine[right])) & (doc[left] != doc[right])
        left, right = left[meet], right[meet]
        most = np.minimum(s[left], s[right])  # common tokens are at most that many, and no more than a set has
        sizes = n[left] + n[right]
        fits = 100 * most >= PERCENT * (sizes - most)
        left, right, sizes = left[fits], right[fits], sizes[fits]
        # of each side's tokens, those whose bit the other lacks are not common
        common = np.bitwise_count(bits[left] & bits[right]).sum(axis=1, dtype=np.int64)
        most = np.minimum(s[left] - on[left], s[right] - on[right]) + common
        keep = 100 * most >= PERCENT * (sizes - most)
        if keep.any():
            x, y = doc[left[keep]], doc[right[keep]]
            yield np.minimum(x, y), np.maximum(x, y)


def _verify(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
        ta, tb = batch.column("ta"), batch.column("tb")
        keep = np.zeros(len(a), bool)
        last, x = None, None
        for k in range(len(a)):
            own = ta[k].as_py()
            if last != own:
                last, x = own, np.sort(unpack(own)[0])
            (y,) = unpack(tb[k].as_py())
            both = int(contains(x, y).sum())
            keep[k] = 100 * both >= PERCENT * (int(na[k]) + int(nb[k]) - both)
        yield rows_of(schema, a=a[keep], b=b[keep])


def _links(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the (a, b) that are similar."""
    side = own.select("doc", "n", "tokens")
    both = pairs.select("a", "b").join(side.toDF("b", "nb", "tb"), "b").join(side.toDF("a", "na", "ta"), "a")
    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify, "a long, b long").distinct()


def _possible(na: str, nb: str, sa: str, sb: str) -> str:
    """Sizes and shared tokens that allow a link."""
    return f"100 * least({na}, {nb}, {sa}, {sb}) >= {PERCENT} * ({na} + {nb} - least({na}, {nb}, {sa}, {sb}))"


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) of every row; the component is the smallest id that links lead to."""
    every = sets(docs, key, text, size)
    able = every.where("tokens IS NOT NULL")
    classes = able.groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"))
    member = written(able.select("doc", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).groupBy("doc").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")))
    own = able.join(classes.select(F.col("rep").alias("doc"), "n", "d1", "d2"), ["doc", "n", "d1", "d2"], "left_semi").dropDuplicates(["doc", "n", "d1", "d2"])
    signed = own.select("doc", "n", "rare", "tokens").mapInArrow(_signatures, "sig long, doc long, n int, s int")
    members = F.sum(F.xxhash64("doc", "n", "s").cast("decimal(38,0)"))
    groups = signed.groupBy("sig").agg(F.min("doc").alias("lead"), F.count("*").alias("size"), members.alias("members")).where("size > 1")
    groups = groups.groupBy("lead", "size", "members").agg(F.min("sig").alias("sig"))  # signatures of the same documents are one
    rows = written(signed.join(groups, "sig").select("sig", "doc", "n", "s", "lead"))
    sizes = rows.select("doc", "n", "s").distinct()
    star = rows.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")).distinct()
    star = star.join(sizes.toDF("a", "na", "sa"), "a").where(_possible("na", "nb", "sa", "sb")).select("a", "b").distinct()
    twice = member.where("rep <> other")
    same = twice.select(F.col("rep").alias("a"), F.col("other").alias("b"))
    first = written(_links(star, own).unionByName(same))
    part = components(first)
    labelled = rows.join(part.toDF("doc", "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = labelled.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    open_rows = written(labelled.join(open_.where("low < high"), "sig").select("sig", "doc", "n", "s", "component", "parts"))
    maps = own.join(open_rows.select("doc").distinct(), "doc", "left_semi").select("doc", "n", "tokens").mapInArrow(_bitmaps, "doc long, n int, s int, bits binary")
    dealt = open_rows.withColumn("mine", F.pmod(F.xxhash64("doc"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other"))
    left = dealt.join(maps, ["doc", "n", "s"]).select("sig", "one", "two", "mine", "doc", "n", "s", "component", "bits")
    cell = ["sig", "one", "two"]
    across = left.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_near, "a long, b long").distinct()
    second = _links(across.join(star, ["a", "b"], "left_anti"), own)
    found = components(first.unionByName(second)).toDF("rep", "component")
    placed = member.select("doc", "rep").join(found, "rep", "left").select(F.col("doc").alias("_doc"), F.coalesce("component", "rep").alias("_component"))
    result = every.select("doc", "n").join(placed, F.col("doc") == F.col("_doc"), "left")
    result = result.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("_component", "doc").alias("component_id"))
    nameless = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(nameless)
