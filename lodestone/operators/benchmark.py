"""Benchmark subset with hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import RUN_SQL, judged, run


def build_subset(run_: DataFrame, qrels: DataFrame, documents: DataFrame, target: int, seed: int = 7) -> DataFrame:
    """(did, reason): gold, then hard negatives, then fill, ``target`` documents in all.

    ``run_`` (qid, did, score), ``qrels`` (qid, did, rel), ``documents`` (did, has_image). Gold: rel >= 1 and present,
    always whole, even beyond the target. Hard negatives: other retrieved documents by their best score over all
    queries, not below 0, equals by id. Fill: remaining documents, those with an image first, then by a seeded hash.
    Repeated documents count once. Only the two counts reach the driver; the picks are top-n, not sorts.
    """
    docs = documents.where("did IS NOT NULL").groupBy("did").agg(F.max(F.coalesce("has_image", F.lit(False))).alias("has_image"))
    gold = qrels.where("rel >= 1").select("did").distinct().join(docs, "did", "left_semi")
    need = max(0, target - gold.count())
    pool = run_.join(docs, "did", "left_semi").join(gold, "did", "left_anti").groupBy("did").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    hard = pool.orderBy(F.col("best").desc(), F.col("did")).limit(need).select("did")
    gap = max(0, need - hard.count())
    rest = docs.join(gold, "did", "left_anti").join(hard, "did", "left_anti")
    fill = rest.orderBy(F.col("has_image").desc(), F.md5(F.concat(F.lit(f"{seed}:"), "did")), "did").limit(gap).select("did")
    tag = lambda d, r: d.select("did", F.lit(r).alias("reason"))
    return tag(gold, "gold").union(tag(hard, "hard_negative")).union(tag(fill, "fill"))


def build_stats(subset: DataFrame, qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: sizes by reason, share with image, judgements kept and dropped, queries that lost all gold."""
    docs = documents.groupBy("did").agg(F.max(F.coalesce("has_image", F.lit(False))).alias("has_image"))
    s = subset.join(docs, "did").agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("gold", "hard_negative", "fill")], F.count_if("has_image").alias("with_image"))
    mark = qrels.join(subset.select("did", F.lit(1).alias("kept")), "did", "left")
    q = mark.groupBy("qid").agg(F.count("kept").alias("kept"), F.count_if(F.col("kept").isNull()).alias("dropped"))
    t = q.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("qrels_kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("qrels_dropped"), F.count_if(F.col("kept") == 0).alias("queries_lost"))
    return s.crossJoin(F.broadcast(t))  # one row each


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/meta.parquet").select(F.concat(F.lit("corpus-test-"), "row").alias("did"), "has_image")


TARGET = 1500


def _subset(spark: SparkSession, sf: str) -> DataFrame:
    return build_subset(run(spark, sf), judged(spark, sf), _documents(spark, sf), TARGET)


SUBSET_SQL = (
    RUN_SQL
    + f""", docs AS (SELECT 'corpus-test-' || "row" AS did, bool_or(coalesce(has_image, false)) AS has_image FROM meta WHERE "row" IS NOT NULL GROUP BY 1
), gold AS (SELECT DISTINCT did FROM qrels_ WHERE rel >= 1 AND did IN (SELECT did FROM docs)
), need AS (SELECT greatest(0, {TARGET} - count(*)) AS n FROM gold
), hard AS (
  SELECT did FROM (SELECT did, row_number() OVER (ORDER BY best DESC, did) AS i FROM (SELECT did, greatest(max(score), 0e0) AS best FROM run WHERE did IN (SELECT did FROM docs) AND did NOT IN (SELECT did FROM gold) GROUP BY did)), need WHERE i <= n
), gap AS (SELECT greatest(0, n - (SELECT count(*) FROM hard)) AS n FROM need
), fill AS (
  SELECT did FROM (SELECT did, row_number() OVER (ORDER BY has_image DESC, md5('7:' || did), did) AS i FROM docs WHERE did NOT IN (SELECT did FROM gold) AND did NOT IN (SELECT did FROM hard)), gap WHERE i <= n
), subset AS (SELECT did, 'gold' AS reason FROM gold UNION ALL SELECT did, 'hard_negative' FROM hard UNION ALL SELECT did, 'fill' FROM fill)"""
)

QUERIES = {
    "q11_benchmark_subset": _subset,
    "a14_build_stats": lambda spark, sf: build_stats(_subset(spark, sf), judged(spark, sf), _documents(spark, sf)),
}
SQL = {
    "q11_benchmark_subset": f"WITH {SUBSET_SQL} SELECT did, reason FROM subset",
    "a14_build_stats": f"""WITH {SUBSET_SQL}, k AS (SELECT qid, count(s.did) AS kept, count_if(s.did IS NULL) AS dropped FROM qrels_ LEFT JOIN subset s USING (did) GROUP BY qid)
SELECT count_if(reason = 'gold')::BIGINT AS n_gold, count_if(reason = 'hard_negative')::BIGINT AS n_hard_negative, count_if(reason = 'fill')::BIGINT AS n_fill, count_if(has_image)::BIGINT AS with_image,
  (SELECT sum(kept)::BIGINT FROM k) AS qrels_kept, (SELECT sum(dropped)::BIGINT FROM k) AS qrels_dropped, (SELECT count_if(kept = 0)::BIGINT FROM k) AS queries_lost FROM subset JOIN docs USING (did)""",
}
