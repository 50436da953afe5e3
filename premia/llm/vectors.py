"""Near-duplicate vectors by randomised-rotation binary codes, and nearest neighbours by an adaptive dimension scan.

Both take integer keys and numeric arrays. Vectors that are null, zero, or hold a null or non-finite component take no part.
Vectors of different dimensions are never compared.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.common import components, rows_of

#: Share of pairs at the threshold itself that no code prefix may miss.
MISSED = 0.0005
#: Vectors that share a prefix, on average over evenly spread ones.
BUCKET = 1024
#: Vectors of a bucket that are compared in one task; larger buckets are split, and every pair of splits is compared.
CHUNK = 2048
#: Standard deviations of the inner-product estimate that decide whether a pair is recomputed.
BOUNDS = 4.0


def usable(vectors: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(key, x, more) of the rows that take part, in double precision."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(fine).where(square > 0).select(F.col(key).cast("long").alias("key"), x.alias("x"), *more)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


@lru_cache(maxsize=64)
def rotation(size: int, seed: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([size, seed]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors (0 or 1), and how far each code lies along its vector."""
    turned = _unit(x) @ rotation(x.shape[1], 0)
    return turned > 0, np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])


def prefixes(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Numbers of `bits` code bits of further rotations, one for each band."""
    unit, size = _unit(x), x.shape[1]
    need, out = bits * bands, []
    for seed in range(1, 1 + -(-need // size)):
        out.append(unit @ rotation(size, seed) > 0)
    sign = np.hstack(out)[:, :need].reshape(len(x), bands, bits)
    return sign @ (1 << np.arange(bits))


def _compare(threshold: float):
    """Links among the vectors of one bucket (or between two of its splits) that no earlier band has found."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x, key, weight = matrix(table["x"]), table["key"].to_numpy(), table["weight"].to_numpy()
        band, mine, one, two = table["band"][0].as_py(), table["mine"].to_numpy(), table["one"][0].as_py(), table["two"][0].as_py()
        bands = matrix(table["bands"]).astype(np.int64)
        sign = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in table["code"].to_pylist()]), axis=1)[:, : x.shape[1]] * 2.0 - 1
        along = table["along"].to_numpy()
        norm, size = np.linalg.norm(x, axis=1), x.shape[1]
        turned = _unit(x) @ rotation(size, 0)
        width = BOUNDS * np.sqrt(np.maximum(1 - along**2, 0) / (along**2 * max(1, size - 1)))
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            estimate = turned[rows] @ sign[right].T / (math.sqrt(size) * along[right])
            a, b = np.nonzero(estimate + width[right] >= threshold)
            a, b = rows[a], right[b]
            if one == two:
                a, b = a[a < b], b[a < b]
            for c in range(0, len(a), 1 << 16):
                p, q = a[c : c + (1 << 16)], b[c : c + (1 << 16)]
                linked = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
                p, q = p[linked], q[linked]
                new = (bands[p] == bands[q]).argmax(axis=1) == band
                p, q = p[new], q[new]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                while len(p):  # the smallest row that links lead to
                    low = np.minimum(root[p], root[q])
                    before = root.copy()
                    for side in (p, q):
                        np.minimum.at(root, root[side], low)
                        np.minimum.at(root, side, low)
                    root = root[root]
                    if (before == root).all():
                        break
        has = np.flatnonzero(links)
        return pa.table({"key": key[has], "links": links[has], "root": key[root[has]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row; rows link when labels are equal and cosine reaches `threshold`.

    Equal vectors of a label are one, with a weight. Candidates share a prefix of a binary code in some band; the number
    of bands keeps what a pair at the threshold may miss under MISSED. In a bucket, a code's unbiased estimate of the
    inner product with its confidence bound drops most pairs; the rest are computed exactly on the original vectors, and
    only those count. Buckets over CHUNK vectors are split and all pairs of splits compared, so a bucket has no cap.

    Defined results: rows that take no part, or have no label, link with nothing. A null key is kept with no component.
    Repeated rows are copies of each other. An empty table gives an empty result.
    """
    own = usable(vectors, key, vector, F.col(label).alias("label")).where("label IS NOT NULL")
    single = own.groupBy("label", "x").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    n = max(1, single.count())
    bits = max(4, math.ceil(math.log2(max(2, n / BUCKET))))
    same = 1 - math.acos(threshold) / math.pi
    bands = math.ceil(math.log(MISSED) / math.log(1 - same**bits))
    label_type = single.schema["label"].dataType

    def code(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sizes = part.column("x").value_lengths().to_numpy()
                for size in np.unique(sizes):
                    some = part.filter(pa.array(sizes == size))
                    x = matrix(some.column("x"))
                    sign, along = codes(x)
                    keys = prefixes(x, bits, bands)
                    packed = np.packbits(sign, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("label"), some.column("x"), some.column("key"), some.column("weight"), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(along), pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))],
                        names=["label", "x", "key", "weight", "code", "along", "bands"],
                    )

    coded = single.select("label", "x", "key", "weight").mapInArrow(code, f"label {label_type.simpleString()}, x array<double>, key long, weight long, code binary, along double, bands array<int>")
    group = ["label", "dim", "band", "bucket"]
    dealt = coded.withColumn("dim", F.size("x")).select("*", F.posexplode("bands").alias("band", "bucket"))
    large = dealt.groupBy(*group).agg(F.count("*").alias("rows")).where("rows > 1").withColumn("splits", F.ceil(F.col("rows") / CHUNK).cast("int")).drop("rows")
    split = dealt.join(large, group).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("splits")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    split = split.withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other")).drop("other", "splits")
    found = split.groupBy(*group, "one", "two").applyInArrow(_compare(threshold), "key long, links long, root long")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    classes = single.join(counts, "key", "left").join(part.toDF("key", "component"), "key", "left")
    classes = classes.select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    placed = own.join(classes, ["label", "x"]).select("key", "n_links", "component").groupBy("key").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    every = vectors.select(F.col(key).cast("long").alias("_key")).join(placed, F.col("_key") == F.col("key"), "left")
    component = F.coalesce("component", "_key")
    return every.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"))


#: Rows that centroids and the number of probed lists are fitted on, queries among them, and the recall aimed at there.
SAMPLE, TRIAL, RECALL = 1 << 15, 200, 0.95
#: Columns of a block, and how far beyond its expectation a partial distance must lie to abandon a candidate.
COLUMNS, DOUBT = 16, 2.1
#: Share of a block's candidates below which columns are added for the candidates alone.
FEW = 0.05
#: Sample rows that a query's first limit is taken from, as a multiple of the square root of all rows: they grow as the lists do.
LIMIT_ROWS = 8
#: Sample rows for each list at least, so there are no more than SAMPLE / LIST_SAMPLE lists.
LIST_SAMPLE = 8
#: Rows of a list that one task scans; longer lists are split.
LIST_ROWS = 8192
#: Queries of a list that one task answers; more are split, and the list's rows go to each part.
ASK_ROWS = 4096
#: Slack of a limit as a share of the squared norms: far more than rounding does to a distance in any form, so equal rows stay together.
SLACK = 1e-9


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more component, which gives all vectors the norm `most`: nearest by distance is then largest by inner product."""
    return np.hstack([x, np.sqrt(np.maximum(most**2 - (x * x).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0)


def fit_lists(sample: np.ndarray, lists: int, k: int) -> tuple[np.ndarray, int]:
    """Centroids of `lists` lists, and how many a query probes for RECALL of its k nearest in the sample."""
    rng = np.random.default_rng(7)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(6):
        near = np.concatenate([_distances(sample[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    near = np.concatenate([_distances(sample[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
    trial = sample[:TRIAL].copy()
    trial[:, -1] = 0  # as a query
    best = np.argsort(_distances(trial, sample), axis=1)[:, :k]
    place = np.argsort(np.argsort(_distances(trial, centres), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1


def scan(query: np.ndarray, x: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row of `x`) that may be among a (rotated) query's k nearest: others are abandoned by partial distances.

    `known` is a distance (squared) that a query's k nearest of all rows are known to keep to. Blocks of columns are added
    for whole blocks of rows while many candidates go on, and for the candidates alone once they are few.
    """
    out_q, out_r = [], []
    size = x.shape[1]
    best = np.full((len(query), k), np.inf)
    slack = SLACK * ((query * query).sum(axis=1) + (x * x).sum(axis=1).max(initial=0))

    def allowed(limit: np.ndarray, seen: int) -> np.ndarray:
        """The largest partial distance over `seen` columns that may still end within the limit."""
        return limit * (seen / size) * ((1 + DOUBT / math.sqrt(seen)) ** 2 if seen < size else 1)

    for at in range(0, len(x), 512):
        block = x[at : at + 512]
        limit = best.max(axis=1)
        partial = _distances(query[:, :COLUMNS], block[:, :COLUMNS])
        seen = min(COLUMNS, size)
        if known is None and not at and len(block) > k:  # a first limit: the whole distances of the k that look nearest so far
            near = np.argpartition(partial, k - 1, axis=1)[:, :k]
            for c in range(0, len(query), 64):
                step = query[c : c + 64, None] - block[near[c : c + 64]]
                limit[c : c + 64] = (step * step).sum(axis=2).max(axis=1)
        if known is not None:
            limit = np.minimum(limit, known)
        limit = limit + slack
        going = partial <= allowed(limit, seen)[:, None]
        while seen < size and going.sum() > FEW * going.size:
            to = min(seen + COLUMNS, size)
            partial += _distances(query[:, seen:to], block[:, seen:to])
            seen = to
            going &= partial <= allowed(limit, seen)[:, None]
        q, r = np.nonzero(going)
        value = partial[q, r]
        while seen < size and len(q):
            to = min(seen + COLUMNS, size)
            for c in range(0, len(q), 1 << 16):
                s = slice(c, c + (1 << 16))
                step = query[q[s], seen:to] - block[r[s], seen:to]
                value[s] += (step * step).sum(axis=1)
            seen = to
            on = value <= allowed(limit, seen)[q]
            q, r, value = q[on], r[on], value[on]
        out_q.append(q)
        out_r.append(r + at)
        if at + 512 < len(x):
            cuts = np.searchsorted(q, np.arange(len(query) + 1))
            for i in np.unique(q):
                best[i] = np.sort(np.concatenate([best[i], value[cuts[i] : cuts[i + 1]]]))[:k]
    return np.concatenate(out_q), np.concatenate(out_r)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors of largest inner product, found in its probed lists.

    Lists are fitted on a sample of SAMPLE rows at most; every row is put into one. Rotated vectors are scanned in blocks
    of columns, and a candidate whose partial distance is too large for its query's k nearest so far is abandoned; a query
starts with the limit that its k nearest of some rows of the sample set (LIMIT_ROWS), and these count as found. Lists
    over LIST_ROWS rows are split by a hash, and so are the queries of a list over ASK_ROWS. Scores are inner products of the original vectors in double precision.

    Defined results: a key with several usable rows counts once, with its least vector. A query is no candidate of its
    own; without other candidates it has no rows. Ties go to the smaller key. `is_query` is SQL over `key`.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    own = usable(vectors, key, vector).groupBy("key").agg(F.min("x").alias("x"))
    dims = [r.d for r in own.select(F.size("x").alias("d")).distinct().collect()]
    out = vectors.sparkSession.createDataFrame([], schema)
    for d in sorted(dims):
        some = own.where(F.size("x") == d)
        out = out.unionByName(_nearest(some, d, is_query, k)) if len(dims) > 1 else _nearest(some, d, is_query, k)
    return out


def _dealt(members: DataFrame, asked: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of each list by (split, part): a row is in one split of its list and all parts, a query the other way round."""

    def own(n: str):
        return F.pmod(F.xxhash64("key"), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = members.join(lists, "list").withColumn("split", own("splits")).withColumn("part", every("parts"))
    queries = asked.join(lists, "list").withColumn("part", own("parts")).withColumn("split", every("splits"))
    return rows.drop("splits", "parts"), queries.drop("splits", "parts")


def _nearest(own: DataFrame, size: int, is_query: str, k: int) -> DataFrame:
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    most, n = own.agg(F.max(F.sqrt(square)), F.count("*")).first()
    taken = own.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()
    sample = lifted(np.stack(taken["x"].to_numpy()).astype(float), most)
    lists = max(1, min(len(sample) // LIST_SAMPLE, int(math.sqrt(n))))
    centres, probes = fit_lists(sample, lists, k)
    limits = LIMIT_ROWS * math.ceil(math.sqrt(n))
    some, some_ids = np.ascontiguousarray(sample[:limits, :-1]), taken["key"].to_numpy()[:limits]
    turn = rotation(size + 1, 0)
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = _distances(lifted(matrix(part.column("x")), most), centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), part.column("key"), part.column("x")], names=["list", "key", "x"])

    def probed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(part.column("x"))
        return x, np.argsort(_distances(np.hstack([x, np.zeros((len(x), 1))]), centres), axis=1, kind="stable")[:, :probes]

    def first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """k + 1 rows of the sample (the query may be one of them), and the squared distance of the last: the nearest are no further."""
        product = x @ some.T
        if len(some) <= k:
            return np.tile(np.arange(len(some)), (len(x), 1)), np.full(len(x), np.inf)
        rows = np.argpartition(-product, k, axis=1)[:, : k + 1]
        return rows, (x * x).sum(axis=1) + most**2 - 2 * np.take_along_axis(product, rows, axis=1).min(axis=1)

    def begin(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, asks = matrix(part.column("x")), part.column("key").to_numpy()
                rows, _ = first(x)
                which, rows = np.repeat(np.arange(len(x)), rows.shape[1]), rows.ravel()
                other = some_ids[rows] != asks[which]
                which, rows = which[other], rows[other]
                yield rows_of(found_schema, query_id=asks[which], vec_id=some_ids[rows], score=(some[rows] * x[which]).sum(axis=1))

    def load(batches):
        total = np.zeros(len(centres), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                total += np.bincount(probed(batch.slice(at, 1024))[1].ravel(), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["list", "n"])

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, near = probed(part)
                rows = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                known = pa.array(first(x)[1]).take(rows)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), part.column("key").take(rows), part.column("x").take(rows), known], names=["list", "key", "x", "known"])

    placed = own.mapInArrow(assign, "list int, key long, x array<double>")
    splits = placed.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("splits"))
    parts = own.where(is_query).mapInArrow(load, "list int, n long").groupBy("list").agg(F.ceil(F.sum("n") / ASK_ROWS).cast("int").alias("parts"))
    dealt = splits.join(parts, "list")
    members, asked = _dealt(placed, own.where(is_query).mapInArrow(probe, "list int, key long, x array<double>, known double"), dealt)

    def search(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not questions.num_rows or not rows.num_rows:
            return found_schema.empty_table()
        q, x = matrix(questions["x"]), matrix(rows["x"])
        asks, ids, known = questions["key"].to_numpy(), rows["key"].to_numpy(), questions["known"].to_numpy()
        turned = lifted(x, most) @ turn
        out = []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            # the query itself may be a row, so one more is kept
            which, rows_ = scan(np.hstack([part, np.zeros((len(part), 1))]) @ turn, turned, k + 1, known[at : at + 256])
            other = ids[rows_] != asks[at + which]
            which, rows_ = which[other], rows_[other]
            score = np.empty(len(which))
            for c in range(0, len(which), 1 << 16):
                s = slice(c, c + (1 << 16))
                score[s] = (x[rows_[s]] * part[which[s]]).sum(axis=1)
            order = np.lexsort((ids[rows_], -score, which))
            which, rows_, score = which[order], rows_[order], score[order]
            top = np.arange(len(which)) - np.searchsorted(which, which) < k
            out.append(rows_of(found_schema, query_id=asks[at + which[top]], vec_id=ids[rows_[top]], score=score[top]))
        return pa.Table.from_batches(out, schema=found_schema)

    group = ["list", "split", "part"]
    found = asked.groupBy(*group).cogroup(members.groupBy(*group)).applyInArrow(search, "query_id long, vec_id long, score double")
    # the rows that set a first limit count as found, so a query has k rows whatever its lists hold
    found = found.unionByName(own.where(is_query).mapInArrow(begin, "query_id long, vec_id long, score double")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
