"""Exact top-k retrieval by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.functions.text import CORPUS_PREFIX, QUERY_PREFIX

#: Query vectors that may travel to every task, in bytes; more are cut into blocks of that size and joined by block.
CLOSURE_BYTES = 32 << 20
#: Queries and documents of one matrix product.
BLOCK_QUERIES = 1024
BLOCK_DOCUMENTS = 2048
#: Documents after which a task forgets those that no query keeps.
CHUNK_DOCUMENTS = 65536
#: Documents of one tile of the blocked join, about.
TILE_DOCUMENTS = 262144


def _dense(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(col) else np.zeros((0, dim))


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up element by element as the column expression does."""
    s = np.zeros(len(a))
    for i in range(a.shape[1]):
        s = s + a[:, i] * b[:, i]
    return s


def _norms(a: np.ndarray) -> np.ndarray:
    most = np.abs(a).max(1, initial=0.0)  # squares may leave the range of numbers
    part = a / most[:, None]
    return most * np.sqrt((part * part).sum(1))


def _exact(q: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """Scores of the pairs (a, b), added up element by element as the column expression does."""
    s = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(d.T)):
        s += x[a] * y[b]
    return s / np.sqrt(_ordered_dot(q, q)[a] * _ordered_dot(d, d)[b]) if cosine else s


def _pairs(qid: np.ndarray, q: np.ndarray, did: np.ndarray, d: np.ndarray, cosine: bool) -> pa.RecordBatch:
    """Scores of all pairs of one block."""
    a, b = np.divmod(np.arange(len(q) * len(d)), max(1, len(d)))
    return pa.record_batch([pa.array(qid[a]), pa.array(did[b]), pa.array(_exact(q, d, a, b, cosine))], names=["qid", "did", "score"])


class Best:
    """The ``k`` best (score, did) of every query among the documents added so far, equals by larger id, each pair once.

    Keeps k numbers a query, and ids of kept documents and of one chunk only, however many documents are added.
    """

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, cosine: bool):
        self.qid, self.q, self.k, self.cosine = qid, q, k, cosine
        self.names = pa.array([], pa.string())  # ids of kept documents in ascending order; elsewhere their places stand for them
        none = np.zeros(0, np.int64)
        self.kept = [(none, none, np.zeros(0)) for _ in range(0, len(q), BLOCK_QUERIES)]  # place of query, of id, score
        self.kth = np.full(len(q), -np.inf)
        self.waiting: list[tuple[pa.Array, np.ndarray]] = []
        self.count = 0

    def add(self, did: pa.Array, d: np.ndarray) -> None:
        for i in range(0, len(did), CHUNK_DOCUMENTS):
            part = did.slice(i, CHUNK_DOCUMENTS)
            self.waiting.append((part, d[i : i + CHUNK_DOCUMENTS]))
            self.count += len(part)
            if self.count >= CHUNK_DOCUMENTS:
                self._chunk()

    def _chunk(self) -> None:
        if not self.count:
            return
        d = np.concatenate([x for _, x in self.waiting])
        self._rename(pa.concat_arrays([x for x, _ in self.waiting]))
        code, self.waiting, self.count = self.code, [], 0
        size = _norms(d)
        if not self.cosine:  # the longest first, so that each block has its own scale
            order = np.argsort(-size)
            d, size, code = d[order], size[order], code[order]
        # single precision decides what can't be among the best; by so much it may be off for vectors of length 1
        off = (d.shape[1] + 8) * 2.0**-24
        for n, i in enumerate(range(0, len(self.q), BLOCK_QUERIES)):
            q, kth = self.q[i : i + BLOCK_QUERIES], self.kth[i : i + BLOCK_QUERIES]
            long = _norms(q)
            unit = (q / long[:, None]).astype(np.float32)
            found, more = [], 0
            for j in range(0, len(d), BLOCK_DOCUMENTS):
                e = slice(j, j + BLOCK_DOCUMENTS)
                scale = size[e] if self.cosine else size[e].max()
                score = unit @ (d[e] / np.reshape(scale, (-1, 1))).astype(np.float32).T
                least = kth if self.cosine else kth / (long * scale)
                least = np.where(np.isnan(least), -np.inf, least)
                # rows of an id that is repeated here may turn out to be one pair
                need = self.k + score.shape[1] - len(np.unique(code[e]))
                if score.shape[1] > need and np.isneginf(kth).any():
                    least = np.maximum(least, np.partition(score, score.shape[1] - need, axis=1)[:, -need] - off)
                at = np.flatnonzero(score >= np.nextafter((least - off).astype(np.float32), np.float32(-np.inf))[:, None])
                a, b = np.divmod(at, score.shape[1])
                found.append((a, code[e][b], _exact(q, d[e], a, b, self.cosine)))
                more += len(a)
                if more * 2 >= self.k * len(q) or j + BLOCK_DOCUMENTS >= len(d):
                    self.kept[n] = self._merge(found, self.kept[n], kth)
                    found, more = [], 0

    def _rename(self, new: pa.Array) -> None:
        """Places for the kept ids and those of a chunk (``code``); ids that no query keeps any more are dropped."""
        live = np.unique(np.concatenate([c for _, c, _ in self.kept]))
        every = pa.concat_arrays([self.names.take(pa.array(live)), new])
        rank = pc.rank(every, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        first = np.unique(rank, return_index=True)[1]
        self.names, self.code = every.take(pa.array(first)), rank[len(live) :]
        self.kept = [(a, rank[np.searchsorted(live, c)], s) for a, c, s in self.kept]

    def _merge(self, found: list[tuple[np.ndarray, ...]], kept: tuple[np.ndarray, ...], kth: np.ndarray) -> tuple[np.ndarray, ...]:
        a, c, s = (np.concatenate(x) for x in zip(kept, *found))
        good = s >= kth[a]
        a, c, s = a[good], c[good], s[good]
        order = np.argsort(-s)
        order = order[np.argsort(a[order].astype(np.int16), kind="stable")]
        level = np.cumsum(np.append(False, (a[order][1:] != a[order][:-1]) | (s[order][1:] != s[order][:-1]))[: len(a)])
        order = order[np.argsort(level * len(self.names) - c[order])]  # equals by larger id
        a, c, s = a[order], c[order], s[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        a, c, s = a[new], c[new], s[new]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        kth[a[place == self.k - 1]] = s[place == self.k - 1]
        return a[place < self.k], c[place < self.k], s[place < self.k]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._chunk()
        for n, (a, c, s) in enumerate(self.kept):
            yield pa.record_batch([pa.array(self.qid[n * BLOCK_QUERIES + a], pa.string()), self.names.take(pa.array(c)), pa.array(s)], names=["qid", "did", "score"])


def _score(batches: Iterator[pa.RecordBatch], queries: Broadcast, k: int | None, cosine: bool) -> Iterator[pa.RecordBatch]:
    qid, q = queries.value
    best = Best(qid, q, k, cosine) if k else None
    for b in batches:
        d = _dense(b.column(1), q.shape[1])
        if best:
            best.add(b.column(0), d)
        elif len(d):
            for i in range(0, len(q), BLOCK_QUERIES):
                yield _pairs(qid[i : i + BLOCK_QUERIES], q[i : i + BLOCK_QUERIES], b.column(0).to_numpy(zero_copy_only=False), d, cosine)
    if best:
        yield from best.rows()


def retrieve(queries: DataFrame, corpus: DataFrame, k: int | None = 100, dim: int = 64, cosine: bool = False, tiles: int | None = None, closure_bytes: int = CLOSURE_BYTES) -> DataFrame:
    """(qid, did, score, rank): the ``k`` documents of highest inner product for every query, equals by larger id.

    Both inputs are (id string, embedding array). Vectors that are not usable take no part; neither do null ids. Exact;
    ``cosine`` divides by the norms. A small query set is sent to the tasks that scan the corpus, as many as there are
    cores, each of which gives k rows for each query; a larger one (measured against ``closure_bytes``) is cut into
    blocks that meet tiles of the corpus in an equi-join on (block, tile), both of bounded size: there are as many
    tiles as the corpus needs, or ``tiles``.
    Without ``k`` every pair comes back, and no rank.
    """
    spark = queries.sparkSession
    good = lambda df: df.where(F.col("id").isNotNull() & V.usable(F.col("embedding"), dim)).select("id", "embedding")
    q, d = good(queries), good(corpus)
    room = closure_bytes // (8 * dim)
    head = q.limit(room + 1).toArrow()
    shape = "qid string, did string, score double"
    if head.num_rows <= room:
        if not head.num_rows:
            return spark.createDataFrame([], shape + (", rank int" if k else ""))
        queries_ = spark.sparkContext.broadcast((head.column(0).to_numpy(), _dense(head.column(1), dim)))
        tasks = d.coalesce(spark.sparkContext.defaultParallelism) if k else d  # each gives k rows for each query
        found = tasks.mapInArrow(partial(_score, queries=queries_, k=k, cosine=cosine), shape)
    else:
        blocks = max(1, -(-q.count() // max(1, room)))
        tiles = tiles or max(1, -(-d.count() // TILE_DOCUMENTS))
        qb = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        db = d.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def join(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"qid": pa.array([], pa.string()), "did": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return empty
            qid, q0 = left.column("id").to_numpy(), _dense(left.column("embedding"), dim)
            parts = right.select(["id", "embedding"]).to_batches(max_chunksize=8192)
            if k is None:
                return pa.Table.from_batches([_pairs(qid[i : i + BLOCK_QUERIES], q0[i : i + BLOCK_QUERIES], b.column(0).to_numpy(zero_copy_only=False), _dense(b.column(1), dim), cosine) for b in parts for i in range(0, len(qid), BLOCK_QUERIES)])
            best = Best(qid, q0, k, cosine)
            for b in parts:
                best.add(b.column(0), _dense(b.column(1), dim))
            return pa.Table.from_batches(best.rows())

        found = qb.groupBy("block", "tile").cogroup(db.groupBy("block", "tile")).applyInArrow(join, shape)
    if k is None:
        return found.distinct()
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("did").desc())
    # one shuffle for both: tasks have pruned already, and repeated documents are folded after it
    return found.repartition("qid").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- the run used by the query catalogue
TOP_K, DIM = 100, 64


def vectors(spark: SparkSession, sf: str, of: str = "true") -> DataFrame:
    """(row, embedding) of the usable sub-document vectors, each row once; ``of`` (a condition on row) goes first."""
    d = spark.read.parquet(f"{sf}/subdoc_vectors.parquet").select("row", "embedding").where(of)
    return d.where(F.col("row").isNotNull() & V.usable(F.col("embedding"), DIM)).dropDuplicates(["row"])


def run(spark: SparkSession, sf: str, k: int = TOP_K) -> DataFrame:
    """Rows divisible by 100 as queries against all rows."""
    q = vectors(spark, sf, "row % 100 = 0").select(F.concat(F.lit(QUERY_PREFIX), "row").alias("id"), "embedding")
    return retrieve(q, vectors(spark, sf).select(F.concat(F.lit(CORPUS_PREFIX), "row").alias("id"), "embedding"), k)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """qrels (qid, did, rel): all sub-documents of the query's document, grade 2 if of its modality too.

    A hot document gives each of its queries as many judgements as it has rows.
    """
    m = spark.read.parquet(f"{sf}/meta.parquet").select("row", "corpus_id", "modality").distinct()
    q = m.where("row % 100 = 0").select(F.concat(F.lit(QUERY_PREFIX), "row").alias("qid"), "corpus_id", F.col("modality").alias("qm"))
    found = q.join(m, "corpus_id").select("qid", F.concat(F.lit(CORPUS_PREFIX), "row").alias("did"), F.when(F.col("modality") == F.col("qm"), 2).otherwise(1).alias("rel"))
    return found.groupBy("qid", "did").agg(F.max("rel").alias("rel"))


def documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(qid, doc) of the queries and (did, doc) of all sub-documents: who shares a document is judged (see ``judged``)."""
    m = spark.read.parquet(f"{sf}/meta.parquet").where("corpus_id IS NOT NULL").select("row", F.col("corpus_id").alias("doc")).distinct()
    return m.where("row % 100 = 0").select(F.concat(F.lit(QUERY_PREFIX), "row").alias("qid"), "doc"), m.select(F.concat(F.lit(CORPUS_PREFIX), "row").alias("did"), "doc")


def query_meta(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, coarse, fine, has_image) of the queries."""
    m = spark.read.parquet(f"{sf}/meta.parquet").where("row % 100 = 0").select("row", "modality", "source", "has_image").distinct()
    return m.select(F.concat(F.lit(QUERY_PREFIX), "row").alias("qid"), F.coalesce("modality", F.lit("Unknown")).alias("coarse"), F.coalesce("source", F.lit("Unknown")).alias("fine"), F.coalesce("has_image", F.lit(False)).alias("has_image"))


VEC_SQL = """
vec AS (
  SELECT "row" AS r, any_value(embedding::DOUBLE[]) AS e FROM subdoc_vectors
  WHERE "row" IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY "row"
)"""
RUN_SQL = (
    VEC_SQL
    + """, scored AS (
  SELECT 'query-test-' || q.r AS qid, 'corpus-test-' || d.r AS did, list_inner_product(q.e, d.e) AS score FROM vec q, vec d WHERE q.r % 100 = 0
), run AS (
  SELECT qid, did, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, did DESC))::INT AS rank FROM scored QUALIFY rank <= 100
), m AS (SELECT DISTINCT "row" AS r, corpus_id, modality FROM meta
), qrels_ AS (
  SELECT 'query-test-' || q.r AS qid, 'corpus-test-' || d.r AS did, max(CASE WHEN q.modality = d.modality THEN 2 ELSE 1 END) AS rel
  FROM m q JOIN m d USING (corpus_id) WHERE q.r % 100 = 0 GROUP BY 1, 2
), qmeta AS (
  SELECT DISTINCT 'query-test-' || "row" AS qid, coalesce(modality, 'Unknown') AS coarse, coalesce(source, 'Unknown') AS fine, coalesce(has_image, false) AS has_image FROM meta WHERE "row" % 100 = 0
)"""
)


def _inner(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.concat(F.lit(QUERY_PREFIX), "vec_id").alias("id"), "embedding")
    c = e.select(F.concat(F.lit(CORPUS_PREFIX), "vec_id").alias("id"), "embedding")
    return retrieve(q, c, None).select("qid", "did", "score")


QUERIES = {
    "v1_inner_product": _inner,
    "w1_topk_per_query": lambda spark, sf: run(spark, sf).select("qid", "did", "score", "rank"),
    "v4_l2_normalize": lambda spark, sf: vectors(spark, sf).select("row", F.element_at(V.l2_normalised(F.col("embedding")), 1).alias("x0"), V.norm(F.col("embedding")).alias("n")),
    "v6_sigmoid": lambda spark, sf: run(spark, sf).select("qid", "did", V.rounded(V.sigmoid(F.col("score"))).alias("p")),
}
SQL = {
    "v1_inner_product": "SELECT 'query-test-' || q.vec_id AS qid, 'corpus-test-' || d.vec_id AS did, list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0",
    "w1_topk_per_query": f"WITH {RUN_SQL} SELECT qid, did, score, rank FROM run",
    "v4_l2_normalize": f"WITH {VEC_SQL} SELECT r AS \"row\", e[1] / sqrt(list_inner_product(e, e)) AS x0, sqrt(list_inner_product(e, e)) AS n FROM vec",
    "v6_sigmoid": f"WITH {RUN_SQL} SELECT qid, did, floor(1 / (1 + exp(-score)) * 1.0e5 + 0.5e0) / 1.0e5 AS p FROM run",
}
