"""Most similar vectors for every vector: block matrix join with int8 product tiles.

The collection is cut into blocks around centroids fitted on a bounded sample. Every vector is a base row of its own
block and a query of the blocks nearest to it. Unit vectors travel as 16-bit fixed point (error of a similarity below
2e-5), half the bytes of floats. Inside a block, tiles of int8 products give each similarity with a rigorous
quantisation error; only pairs whose upper bound reaches the running k-th lower bound are recomputed in float and
merged into the bounded heap of their query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the sample the block centroids are fitted on, at most (documented bound; every row is indexed).
SAMPLE_ROWS = 32768
MAX_BLOCKS = 16384
#: Blocks for n rows: BLOCK_SHARE times the square root of n.
BLOCK_SHARE = 0.25
#: One unit of the 16-bit codes.
CODE = np.float32(32767)
#: More survivors than this many times k a query, and a tile is computed in float as a whole.
CROWDED = 8
#: A block is cut into tiles of about so many base rows.
TILE_ROWS = 8192
#: A block of more tiles than this is split again around centroids of its own, of at least so many sample rows each.
MOST_TILES, SPLIT_SAMPLE = 8, 8


def _units(col: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and their unit vectors as float32."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    off = col.offsets.to_numpy()
    length = np.diff(off)
    ok = (length == dim) & np.asarray(col.is_valid())
    at = np.flatnonzero(ok)
    values = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values[off[:-1][at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    at, x = at[good], x[good]
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)  # no overflow in the square
    return at, (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.column(0)
        at, x = _units(b.column(1), dim)
        keep = np.asarray(rows.is_valid())[at] if len(at) else np.zeros(0, bool)
        at, x = at[keep], x[keep]
        yield pa.record_batch([rows.take(pa.array(at)), _binary(np.rint(x * CODE).astype(np.int16))], names=["row", "unit"])


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column, without a Python object for each."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * step
    if len(x) and offsets[-1] >= 2**31:
        raise ValueError("batch too large; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a column of 16-bit codes, as float32."""
    parts = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    out = []
    for c in parts:
        if not len(c):
            continue
        # a slice shares its parent's buffers, and Arrow may carry 32- or 64-bit offsets
        wide = pa.types.is_large_binary(c.type)
        off = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.int16, count=len(c) * dim, offset=int(off[0])).reshape(len(c), dim))
    x = np.concatenate(out).astype(np.float32) if out else np.zeros((0, dim), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means on the sample: unit centroids and each one's share of the sample."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = np.flatnonzero(n)
        s = np.add.reduceat(x[order], start[full], axis=0)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c[full] = np.where(norm > 1e-12, s / np.maximum(norm, 1e-12), c[full])
    return c, np.bincount(near, minlength=k) / len(x)


def split_hot(x: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of more than MOST_TILES tiles are split around centroids of their own, until none can be: centroids, shares.

    Otherwise every query of a hot block would meet all of its tiles, which is the square of its size. What stays whole
    is a block whose sample cannot be told apart any further.
    """
    done: list[np.ndarray] = []
    parts = [(centroids, x)]
    while parts:
        c, own = parts.pop()
        near = np.concatenate([(own[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(own), 4096)]) if len(own) else np.zeros(0, np.int64)
        for j in range(len(c)):
            mine = own[near == j]
            tiles = len(mine) / len(x) * n / TILE_ROWS
            k = int(min(-(-tiles // (MOST_TILES / 2)), len(mine) // SPLIT_SAMPLE))
            if tiles <= MOST_TILES or k < 2 or len(mine) == len(own) and len(c) > 1:
                done.append(c[j : j + 1])
                continue
            parts.append((fit_centroids(mine, k)[0], mine))
    c = np.concatenate(done)
    near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
    return c, np.bincount(near, minlength=len(c)) / len(x)


def _spread(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, tiles: np.ndarray, probes: int, margin: float) -> Iterator[pa.RecordBatch]:
    """Sends each vector to its own block, and as query to near blocks whose centroid is almost as similar.

    ``base`` marks the one place where a vector also counts as a base row.
    """
    dim, k = centroids.shape[1], len(centroids)
    first = np.concatenate([[0], np.cumsum(tiles)[:-1]])
    p = min(probes, k)
    for b in batches:
        x = _matrix(b.column(2), dim)
        if not len(x):
            continue
        gid = b.column(0).to_numpy()
        s = x @ centroids.T
        near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < k else np.tile(np.arange(k), (len(x), 1))
        sn = np.take_along_axis(s, near, 1)
        order = np.argsort(-sn, axis=1, kind="stable")
        near, sn = np.take_along_axis(near, order, 1), np.take_along_axis(sn, order, 1)
        who, which = np.nonzero(sn >= sn[:, :1] - margin)
        own = near[:, 0]
        mine = (gid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % tiles[own]
        block = near[who, which]
        reps = tiles[block]
        who = np.repeat(who, reps)
        t = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        base = np.repeat(which == 0, reps) & (t == mine[who])
        tile = np.repeat(first[block], reps) + t
        idx = pa.array(who)
        yield pa.record_batch([pa.array(tile.astype(np.int32)), pa.array(base), b.column(0).take(idx), b.column(1).take(idx), b.column(2).take(idx)], names=["tile", "base", "gid", "rows", "unit"])


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32: their products stay exact integers below 2**24), scales and residual norms."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8).astype(np.float32)
    return q, scale.astype(np.float32), np.linalg.norm(x - q * scale[:, None], axis=1).astype(np.float32)


def tile_top(query: np.ndarray, base: np.ndarray, qid: np.ndarray, bid: np.ndarray, brow: np.ndarray, k: int, step: int = 1024, width: int = 4096, group: int = 16):
    """The k nearest base rows of each query by (similarity desc, row): arrays (query place, base place, similarity).

    The int8 product bounds every similarity; |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|. The (k + 1)-th largest
    maximum over groups of columns is a safe floor (a query may meet itself once); pairs that cannot reach it are
    dropped, the rest recomputed in float64 and kept in a bounded heap per query.
    """
    qq, qs, qe = _quantise(query)
    bq, bs, be = _quantise(base)
    heap_q, heap_b, heap_s = [], [], []
    for i in range(0, len(query), step):
        rows = slice(i, min(i + step, len(query)))
        n = rows.stop - rows.start
        keep_q, keep_b, keep_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(n, -np.inf, np.float32)
        for j in range(0, len(base), width):
            cols = slice(j, min(j + width, len(base)))
            m = cols.stop - j
            dot = qq[rows] @ bq[cols].T
            dot *= bs[None, cols]
            err = qe[rows] + (1 + qe[rows]) * be[cols].max() + np.float32(1e-6)
            if m >= group * (k + 1):
                peak = np.maximum.reduceat(dot, np.arange(0, m, group), axis=1)
                high = np.partition(peak, peak.shape[1] - k - 1, axis=1)[:, -k - 1]
                floor = np.maximum(floor, high * qs[rows] - err)
                least = (floor - err) / qs[rows]
                a, g = np.nonzero(peak >= least[:, None])
                a, b = np.repeat(a, group), (g[:, None] * group + np.arange(group)).ravel()
                inside = b < m
                a, b = a[inside], b[inside]
                hit = dot[a, b] >= least[a]
                a, b = a[hit], b[hit]
            else:
                if m > k:
                    floor = np.maximum(floor, np.partition(dot, m - k - 1, axis=1)[:, -k - 1] * qs[rows] - err)
                a, b = np.nonzero(dot >= ((floor - err) / qs[rows])[:, None])
            if len(a) > CROWDED * k * n:
                # vectors so alike that int8 cannot tell them apart: the whole tile in float
                dense = query[rows].astype(np.float64) @ base[cols].astype(np.float64).T
                dense[qid[rows, None] == bid[None, cols]] = -3
                kth = np.partition(dense, max(m - k, 0), axis=1)[:, max(m - k, 0)]
                a, b = np.nonzero((dense >= kth[:, None] - 1e-12) & (dense > -2.5))
                exact = dense[a, b]
            else:
                other = qid[i + a] != bid[j + b]
                a, b = a[other], b[other]
                exact = np.einsum("ij,ij->i", query[i + a].astype(np.float64), base[j + b].astype(np.float64))
            keep_q, keep_b, keep_s = np.concatenate([keep_q, a]), np.concatenate([keep_b, b + j]), np.concatenate([keep_s, exact])
            order = np.lexsort((brow[keep_b], -keep_s, keep_q))
            keep_q, keep_b, keep_s = keep_q[order], keep_b[order], keep_s[order]
            top = np.arange(len(keep_q)) - np.searchsorted(keep_q, keep_q) < k
            keep_q, keep_b, keep_s = keep_q[top], keep_b[top], keep_s[top]
        heap_q.append(keep_q + i), heap_b.append(keep_b), heap_s.append(keep_s)
    return np.concatenate(heap_q), np.concatenate(heap_b), np.concatenate(heap_s)


def _block(table: pa.Table, k: int, dim: int) -> pa.Table:
    """One tile of the join: (gid, near) with the k nearest rows of each query as (-sim, row)."""
    shape = pa.list_(pa.struct([("d", pa.float32()), ("row", pa.int64())]))
    table = table.combine_chunks()
    x = _matrix(table.column("unit"), dim)
    gid = table.column("gid").to_numpy()
    base = np.flatnonzero(table.column("base").to_numpy(zero_copy_only=False))
    if not len(base):
        return pa.table({"gid": pa.array([], pa.int64()), "near": pa.array([], shape)})
    rows = table.column("rows").take(pa.array(base)).combine_chunks()
    off = rows.offsets.to_numpy().astype(np.int64)
    flat = rows.values.to_numpy()
    q, b, s = tile_top(x, x[base], gid, gid[base], flat[off[:-1]], k)
    # a neighbour stands for the lowest rows of its group of equal vectors
    size = np.diff(off)[b]
    q, s = np.repeat(q, size), np.repeat(s, size)
    row = flat[np.repeat(off[b], size) + np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)]
    order = np.lexsort((row, -s, q))
    q, s, row = q[order], s[order], row[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, s, row = q[top], s[top], row[top]
    cnt = np.bincount(q, minlength=len(gid))
    has = np.flatnonzero(cnt)
    ends = pa.array(np.concatenate([[0], np.cumsum(cnt[has])]).astype(np.int32))
    near = pa.StructArray.from_arrays([pa.array((-s).astype(np.float32)), pa.array(row)], ["d", "row"])
    return pa.table({"gid": pa.array(gid[has]), "near": pa.ListArray.from_arrays(ends, near)})


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, row: str = "row", embedding: str = "embedding", blocks: int | None = None, probes: int = 8, margin: float = 0.08) -> DataFrame:
    """For every usable row its k nearest other rows: (row_a, row_b, sim, rank_no).

    Usable: exactly ``dim`` values, all finite, not all zero, and a row number; other rows give no result. Cosine
    similarity; equals go by lower row. Repeated rows count once. Equal vectors are one representative in the join
    and come back afterwards, so a huge group of copies costs one vector. With one block, or ``probes`` and ``margin``
    that reach every block, the result is exact but for the 16-bit codes. Groups are told apart by a 64-bit hash of the
    codes. An empty table, or one usable row, gives no rows. Columns of other names are ignored.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(row).cast("bigint").alias("row"), F.col(embedding).cast("array<float>").alias("embedding"))
    n = src.count()
    k_blocks = blocks or int(min(MAX_BLOCKS, max(1, round(BLOCK_SHARE * n**0.5))))
    m = max(1, -(-n // SAMPLE_ROWS))
    # about SAMPLE_ROWS rows, the same ones for every layout of the table; of repeated row numbers one
    picked = src.where(F.pmod(F.xxhash64("row"), F.lit(m)) == 0).dropDuplicates(["row"]) if m > 1 else src
    sample = picked.mapInArrow(partial(_pack, dim=dim), "row bigint, unit binary").select("unit").toArrow()
    x = _matrix(sample.column(0), dim)
    if not len(x):
        return spark.createDataFrame([], "row_a bigint, row_b bigint, sim double, rank_no int")
    x = x[np.lexsort(x.T[:4])]  # the same centroids whatever order the sample came in
    centroids, share = fit_centroids(x, k_blocks)
    if (share * n > MOST_TILES * TILE_ROWS).any() and k_blocks > 1:
        centroids, share = split_hot(x, centroids, n)
    tiles = np.maximum(1, np.ceil(share * n / TILE_ROWS)).astype(np.int64)

    packed = src.mapInArrow(partial(_pack, dim=dim), "row bigint, unit binary").withColumn("gid", F.xxhash64("unit"))
    # of a group of equal vectors only the k + 1 lowest rows can ever be neighbours
    members = packed.select("gid", "row").distinct()
    w = Window.partitionBy("gid").orderBy("row")
    low = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("gid").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # everything below is partitioned by gid once: representatives, lowest rows, merged heaps, members
    reps = packed.groupBy("gid").agg(F.first("unit").alias("unit")).join(low, "gid").select("gid", "rows", "unit")
    sent = reps.mapInArrow(partial(_spread, centroids=centroids, tiles=tiles, probes=probes, margin=margin), "tile int, base boolean, gid bigint, rows array<bigint>, unit binary")

    def join_block(table: pa.Table) -> pa.Table:
        return _block(table, k, dim)

    parts = int(min(max(tiles.sum() // 2, 1), 1 << 15))  # about two tiles a task, however few shuffle partitions are set
    near = sent.repartition(parts, "tile").groupBy("tile").applyInArrow(join_block, "gid bigint, near array<struct<d: float, row: bigint>>")
    heaps = near.groupBy("gid").agg(F.flatten(F.collect_list("near")).alias("near"))
    own = F.transform("rows", lambda r: F.struct(F.lit(-1.0).cast("float").alias("d"), r.alias("row")))
    # rows of the own group of copies come first; a row itself may be among them, hence one more than k
    best = low.join(heaps, "gid", "left").select("gid", F.slice(F.sort_array(F.concat(F.when(F.size("rows") > 1, own).otherwise(F.slice(own, 1, 0)), F.coalesce("near", F.slice(own, 1, 0)))), 1, k + 1).alias("best"))
    joined = members.join(best, "gid").select(F.col("row").alias("row_a"), F.slice(F.filter("best", lambda z: z["row"] != F.col("row")), 1, k).alias("top"))
    return joined.select("row_a", F.posexplode("top").alias("pos", "z")).select("row_a", F.col("z.row").alias("row_b"), (-F.col("z.d")).cast("double").alias("sim"), (F.col("pos") + 1).cast("int").alias("rank_no"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """p6_found: pairs where at least one row is among the other's five nearest."""
    near = nearest(spark.read.parquet(f"{sf}/subdoc_vectors.parquet").select("row", "embedding"))
    return near.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b")).distinct()


QUERIES = {"p6_found": found}
SQL: dict[str, str] = {}
