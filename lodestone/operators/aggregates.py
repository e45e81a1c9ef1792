"""Counts, grouped statistics and order-based picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import inner_product, rounded
from lodestone.plans.ranking import numbered, running

from .retrieval import RUN_SQL, run, vectors


def frequencies(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def first_by(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group by ``order``; the rank filter becomes a group limit before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def grouped_stats(per_query: DataFrame, group: str) -> DataFrame:
    """(group, n, mean_ndcg, zeros, misses): score statistics of a group; null and NaN scores stay out of the mean."""
    s = F.nanvl(F.col("ndcg_at_10"), F.lit(None).cast("double"))
    return per_query.groupBy(group).agg(F.count("*").alias("n"), F.avg(s).alias("mean_ndcg"), F.count_if(s == 0).alias("zeros"), F.count_if(F.col("rank_bucket") == "miss").alias("misses"))


def stratified_sample(df: DataFrame, group: str, score: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of each group: zero scores in an order drawn by a seeded hash, topped up with the lowest others."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    order = [(F.col(score) == 0).desc(), F.when(F.col(score) == 0, drawn).asc_nulls_last(), F.col(score).asc(), F.col(key).asc()]
    return first_by(df, [group], order, n)


def minmax(df: DataFrame, group: str, value: str, out: str = "scaled") -> DataFrame:
    """Values scaled to [0, 1] within a group; a range below 1e-6 gives zeros. Bounds by aggregate, not by window."""
    b = df.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    return df.join(b, group).withColumn(out, F.when(width < 1e-6, F.lit(0.0)).otherwise((F.col(value) - F.col("__lo")) / width)).drop("__lo", "__hi")


def consistency(run_: DataFrame, vectors_: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(pairs, mismatches, max_abs_diff): stored scores against recomputed ones; pairs without vectors don't count."""
    q, d = vectors_.select(F.col("id").alias("qid"), F.col("embedding").alias("qe")), vectors_.select(F.col("id").alias("did"), F.col("embedding").alias("de"))
    diff = F.abs(inner_product(F.col("qe"), F.col("de")) - F.col("score"))
    return run_.join(q, "qid").join(d, "did").agg(F.count("*").alias("pairs"), F.count_if(diff > tolerance).alias("mismatches"), F.max(diff).alias("max_abs_diff"))


def sorted_units(props: DataFrame, width: int = 1024) -> DataFrame:
    """(corpus_id, pos, prop_id): the propositions of every document in order, also of documents with millions."""
    p = props.select("corpus_id", "prop_id", "prop_idx").where("corpus_id IS NOT NULL AND prop_idx IS NOT NULL").distinct()
    return numbered(p, ["corpus_id"], F.struct("prop_idx", "prop_id"), F.floor(F.col("prop_idx") / width))


def finalise(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest and shard rows -> rows with one global number.

    ``chunks`` (chunk_idx, line_no, n): of several lines of a chunk the last counts; ``rows`` (chunk_idx, pos, ...).
    A chunk whose shard is missing or holds another number of rows is left out. Offsets come from a prefix sum over
    chunks, so no task sees all rows.
    """
    last = first_by(chunks, ["chunk_idx"], [F.col("line_no").desc()])
    held = rows.groupBy("chunk_idx").agg(F.count("*").alias("held"))
    good = last.join(held, "chunk_idx").where("n = held")
    offset = running(good.select("chunk_idx", "n"), "n", "chunk_idx", out="__begin").select("chunk_idx", "__begin")
    return rows.join(offset, "chunk_idx").withColumn("global_row", F.col("__begin") + F.col("pos")).drop("__begin")


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, step): the path with the highest number before its extension."""
    step = F.try_to_number(F.regexp_extract(path, r"(\d+)\.[^.]+$", 1), F.lit("999999999999")).cast("bigint")
    return paths.select(F.col(path).alias("path"), step.alias("step")).where("step IS NOT NULL").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pq(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "per_query").distinct()


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "meta").distinct()


def _consistency(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    both = v.select(F.concat(F.lit("query-test-"), "row").alias("id"), "embedding").union(v.select(F.concat(F.lit("corpus-test-"), "row").alias("id"), "embedding"))
    return consistency(run(spark, sf), both).select("pairs", "mismatches", rounded(F.col("max_abs_diff")).alias("max_abs_diff"))


def _minmax(spark: SparkSession, sf: str) -> DataFrame:
    return minmax(run(spark, sf).select("qid", "did", "score"), "qid", "score").select("qid", "did", rounded(F.col("scaled")).alias("scaled"))


def max_chunk(chunks: DataFrame) -> DataFrame:
    """(chunk_idx): the highest chunk so far; null where there is none."""
    return chunks.agg(F.max("chunk_idx").alias("chunk_idx"))


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Shards of 500 rows and a manifest with every fault: older lines with other counts, lost shards, wrong counts."""
    rows = _meta(spark, sf).groupBy("row").agg(F.min("prop_id").alias("prop_id")).select(F.floor(F.col("row") / 500).alias("chunk_idx"), (F.col("row") % 500).alias("p"), "prop_id")
    rows = numbered(rows, ["chunk_idx"], F.col("p"), F.lit(0))
    said = rows.groupBy("chunk_idx").agg(F.count("*").alias("n"))
    last = said.select("chunk_idx", (F.col("chunk_idx") * 2 + 1).alias("line_no"), F.when(F.col("chunk_idx") % 7 == 3, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    older = said.select("chunk_idx", (F.col("chunk_idx") * 2).alias("line_no"), (F.col("n") - 1).alias("n"))
    return last.unionByName(older).unionByName(last), rows.where("chunk_idx % 11 <> 5")


def _finalise(spark: SparkSession, sf: str) -> DataFrame:
    return finalise(*_manifest(spark, sf)).select("chunk_idx", "pos", "prop_id", "global_row")


_PQ = "pq AS (SELECT DISTINCT * FROM per_query)"
_S = "CASE WHEN isnan(ndcg_at_10) THEN NULL ELSE ndcg_at_10 END"
_FIVE = lambda c: f"floor({c} * 1.0e5 + 0.5e0) / 1.0e5"

QUERIES = {
    "a3_bucket_counts": lambda spark, sf: frequencies(_pq(spark, sf), "rank_bucket"),
    "a4_domain_bucket": lambda spark, sf: frequencies(_pq(spark, sf), "coarse_domain", "rank_bucket"),
    "a5_grouped_stats": lambda spark, sf: grouped_stats(_pq(spark, sf), "coarse_domain").withColumn("mean_ndcg", rounded(F.col("mean_ndcg"))),
    "a5_image_stats": lambda spark, sf: grouped_stats(_pq(spark, sf), "has_image").withColumn("mean_ndcg", rounded(F.col("mean_ndcg"))),
    "a6_best_per_document": lambda spark, sf: run(spark, sf).groupBy("did").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best")),
    "a7_argmax": lambda spark, sf: first_by(_meta(spark, sf).where("best_score IS NOT NULL AND NOT isnan(best_score)"), ["corpus_id"], [F.col("best_score").desc(), F.col("row").asc()]).select("corpus_id", "row", "prop_id", "best_score"),
    "a8_counters": lambda spark, sf: _t(spark, sf, "doc_propositions").agg(F.count("*").alias("lines"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("grounded")).alias("grounded"), F.count_if(F.col("grounded").isNull()).alias("undecided")),
    "a9_keep_first": lambda spark, sf: first_by(_t(spark, sf, "doc_propositions").where("prop_id IS NOT NULL").select("prop_id", "line_no"), ["prop_id"], [F.col("line_no").asc()]),
    "a10_keep_last": lambda spark, sf: first_by(_t(spark, sf, "doc_propositions").where("prop_id IS NOT NULL").select("prop_id", "line_no"), ["prop_id"], [F.col("line_no").desc()]),
    "a11_source_counts": lambda spark, sf: frequencies(_meta(spark, sf), "source"),
    "a12_units_per_document": lambda spark, sf: _t(spark, sf, "doc_propositions").select("corpus_id", "prop_idx").distinct().groupBy("corpus_id").agg(F.count("prop_idx").alias("u")).agg(F.sum("u").cast("bigint").alias("units"), rounded(F.avg("u")).alias("mean_units")),
    "a13_sorted_units": lambda spark, sf: sorted_units(_meta(spark, sf)),
    "a17_describe": lambda spark, sf: _meta(spark, sf).where("best_score IS NOT NULL AND NOT isnan(best_score)").agg(F.min("best_score").alias("lo"), F.max("best_score").alias("hi"), rounded(F.avg("best_score")).alias("mean"), rounded(F.stddev_pop("best_score")).alias("sd")),
    "w3_top_negatives": lambda spark, sf: _meta(spark, sf).where("best_score IS NOT NULL AND NOT isnan(best_score)").orderBy(F.col("best_score").desc(), F.col("row")).limit(100).select("row", "best_score"),
    "w5_badcase_sample": lambda spark, sf: stratified_sample(first_by(_pq(spark, sf).where("ndcg_at_10 IS NOT NULL AND NOT isnan(ndcg_at_10)"), ["qid"], [F.col("written_at").desc(), F.col("run_id").asc()]), "coarse_domain", "ndcg_at_10", "qid", 5).select("coarse_domain", "qid", "ndcg_at_10"),
    "w6_first_per_class": lambda spark, sf: first_by(_pq(spark, sf), ["rank_bucket"], [F.col("qid"), F.col("run_id"), F.col("written_at")], 10).select("rank_bucket", "qid", "run_id", "written_at"),
    "w10_latest_checkpoint": lambda spark, sf: latest_checkpoint(_t(spark, sf, "corpus").select("image.path")).select("step"),
    "v7_minmax": _minmax,
    "v9_cache_consistency": _consistency,
    "k7_finalize": _finalise,
    "w11_max_chunk": lambda spark, sf: max_chunk(_manifest(spark, sf)[0]),
}
SQL = {
    "a3_bucket_counts": f"WITH {_PQ} SELECT rank_bucket, count(*) AS n FROM pq GROUP BY 1",
    "a4_domain_bucket": f"WITH {_PQ} SELECT coarse_domain, rank_bucket, count(*) AS n FROM pq GROUP BY 1, 2",
    "a5_grouped_stats": f"WITH {_PQ} SELECT coarse_domain, count(*) AS n, {_FIVE(f'avg({_S})')} AS mean_ndcg, count_if({_S} = 0)::BIGINT AS zeros, count_if(rank_bucket = 'miss')::BIGINT AS misses FROM pq GROUP BY 1",
    "a5_image_stats": f"WITH {_PQ} SELECT has_image, count(*) AS n, {_FIVE(f'avg({_S})')} AS mean_ndcg, count_if({_S} = 0)::BIGINT AS zeros, count_if(rank_bucket = 'miss')::BIGINT AS misses FROM pq GROUP BY 1",
    "a6_best_per_document": f"WITH {RUN_SQL} SELECT did, greatest(max(score), 0e0) AS best FROM run GROUP BY did",
    "a7_argmax": 'SELECT corpus_id, "row", prop_id, best_score FROM (SELECT DISTINCT * FROM meta) WHERE best_score IS NOT NULL AND NOT isnan(best_score) QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY best_score DESC, "row") = 1',
    "a8_counters": "SELECT count(*) AS lines, count_if(error IS NOT NULL)::BIGINT AS errors, count_if(grounded)::BIGINT AS grounded, count_if(grounded IS NULL)::BIGINT AS undecided FROM doc_propositions",
    "a9_keep_first": "SELECT prop_id, min(line_no) AS line_no FROM doc_propositions WHERE prop_id IS NOT NULL GROUP BY 1",
    "a10_keep_last": "SELECT prop_id, max(line_no) AS line_no FROM doc_propositions WHERE prop_id IS NOT NULL GROUP BY 1",
    "a11_source_counts": "SELECT source, count(*) AS n FROM (SELECT DISTINCT * FROM meta) GROUP BY 1",
    "a12_units_per_document": f"SELECT sum(u)::BIGINT AS units, {_FIVE('avg(u)')} AS mean_units FROM (SELECT corpus_id, count(prop_idx) AS u FROM (SELECT DISTINCT corpus_id, prop_idx FROM doc_propositions) GROUP BY 1)",
    "a13_sorted_units": "SELECT corpus_id, prop_id, prop_idx, row_number() OVER (PARTITION BY corpus_id ORDER BY prop_idx, prop_id) - 1 AS pos FROM (SELECT DISTINCT corpus_id, prop_id, prop_idx FROM meta WHERE corpus_id IS NOT NULL AND prop_idx IS NOT NULL)",
    "a17_describe": f"SELECT min(best_score) AS lo, max(best_score) AS hi, {_FIVE('avg(best_score)')} AS mean, {_FIVE('stddev_pop(best_score)')} AS sd FROM (SELECT DISTINCT * FROM meta) WHERE best_score IS NOT NULL AND NOT isnan(best_score)",
    "w3_top_negatives": 'SELECT "row", best_score FROM (SELECT DISTINCT * FROM meta) WHERE best_score IS NOT NULL AND NOT isnan(best_score) ORDER BY best_score DESC, "row" LIMIT 100',
    "w5_badcase_sample": f"""WITH {_PQ}, one AS (SELECT * FROM pq WHERE ndcg_at_10 IS NOT NULL AND NOT isnan(ndcg_at_10) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY written_at DESC, run_id) = 1)
SELECT coarse_domain, qid, ndcg_at_10 FROM one QUALIFY row_number() OVER (PARTITION BY coarse_domain ORDER BY ndcg_at_10 = 0 DESC, CASE WHEN ndcg_at_10 = 0 THEN md5('7:' || qid) END ASC NULLS LAST, ndcg_at_10, qid) <= 5""",
    "w6_first_per_class": f"WITH {_PQ} SELECT rank_bucket, qid, run_id, written_at FROM pq QUALIFY row_number() OVER (PARTITION BY rank_bucket ORDER BY qid, run_id, written_at) <= 10",
    "w10_latest_checkpoint": r"SELECT max(try_cast(regexp_extract(image.path, '(\d+)\.[^.]+$', 1) AS BIGINT)) AS step FROM corpus",
    "v7_minmax": f"WITH {RUN_SQL}, b AS (SELECT qid, min(score) AS lo, max(score) AS hi FROM run GROUP BY qid) SELECT qid, did, {_FIVE('CASE WHEN hi - lo < 1e-6 THEN 0e0 ELSE (score - lo) / (hi - lo) END')} AS scaled FROM run JOIN b USING (qid)",
    "v9_cache_consistency": f"WITH {RUN_SQL}, x AS (SELECT abs(list_inner_product(q.e, d.e) - score) AS diff FROM run JOIN vec q ON 'query-test-' || q.r = qid JOIN vec d ON 'corpus-test-' || d.r = did) SELECT count(*) AS pairs, count_if(diff > 1e-3)::BIGINT AS mismatches, {_FIVE('max(diff)')} AS max_abs_diff FROM x",
    "k7_finalize": """WITH r AS (SELECT "row" AS r, min(prop_id) AS prop_id FROM meta GROUP BY 1), good AS (SELECT * FROM r WHERE (r // 500) % 11 <> 5 AND (r // 500) % 7 <> 3)
SELECT (r // 500)::BIGINT AS chunk_idx, row_number() OVER (PARTITION BY r // 500 ORDER BY r) - 1 AS pos, prop_id, row_number() OVER (ORDER BY r) - 1 AS global_row FROM good""",
    "w11_max_chunk": 'SELECT max("row" // 500)::BIGINT AS chunk_idx FROM meta',
}
