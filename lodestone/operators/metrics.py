"""Retrieval metrics (M1-M7) and their three-level report (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import rounded

from .retrieval import RUN_SQL, documents, judged, query_meta, run

#: Metric cut-offs.
CUTS = (1, 3, 5, 10, 20, 100)
#: Rank buckets of a diagnosis, upper ends inclusive.
BUCKETS = ((1, "1"), (5, "2-5"), (10, "6-10"), (50, "11-50"))


def last_judgement(qrels: DataFrame, position: str | None = None) -> DataFrame:
    """One grade for each (qid, did): the row of highest ``position``, or the highest grade where there is none."""
    by = F.max_by("rel", position) if position else F.max("rel")
    return qrels.groupBy("qid", "did").agg(by.alias("rel"))


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / (F.log(rank + F.lit(1.0)) / F.log(F.lit(2.0)))


def per_query(run_: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(qid, k, ndcg, map, recall, precision) for every judged query; a query without results scores 0.

    ``run_`` is (qid, did, rank) with ranks from 1; ``qrels`` (qid, did, rel), unique pairs. Unjudged documents have
    grade 0; grade >= 1 is relevant. Metrics are 0 where nothing is relevant. Only the first max(cuts) ranks are read.
    """
    top = max(cuts)
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), "did"))).where(F.col("i") <= top)
    gain = lambda place, k: F.sum(F.when((F.col(place) <= k) & (F.col("rel") > 0), F.col("rel") * _discount(F.col(place))))
    best = ideal.groupBy("qid").agg(*[gain("i", k).alias(f"idcg{k}") for k in cuts])
    total = qrels.groupBy("qid").agg(F.sum((F.col("rel") >= 1).cast("int")).alias("n_rel"))
    hits = run_.where(F.col("rank") <= top).join(qrels, ["qid", "did"])
    so_far = F.sum((F.col("rel") >= 1).cast("int")).over(Window.partitionBy("qid").orderBy("rank"))
    relevant = F.col("rel") >= 1
    got = hits.withColumn("so_far", so_far).groupBy("qid").agg(
        *[gain("rank", k).alias(f"dcg{k}") for k in cuts],
        *[F.sum(F.when(relevant & (F.col("rank") <= k), F.col("so_far") / F.col("rank"))).alias(f"ap{k}") for k in cuts],
        *[F.sum(F.when(relevant & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit{k}") for k in cuts],
    )
    all_ = total.join(best, "qid", "left").join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                zero(F.try_divide(F.col(f"dcg{k}"), F.col(f"idcg{k}"))).alias("ndcg"),
                zero(F.try_divide(F.col(f"ap{k}"), F.col("n_rel"))).alias("map"),
                zero(F.try_divide(F.col(f"hit{k}").cast("double"), F.col("n_rel"))).alias("recall"),
                (zero(F.col(f"hit{k}").cast("double")) / k).alias("precision"),
            )
            for k in cuts
        ]
    )
    return all_.select("qid", F.explode(rows).alias("m")).select("qid", "m.*")


def report(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """(level, grp, k, num_queries, ndcg, map, recall, precision): means overall, by coarse and by fine group.

    One pass: grouping sets over (coarse, fine). Queries missing from ``groups`` fall under Unknown.
    """
    d = metrics.join(groups.select("qid", "coarse", "fine"), "qid", "left").fillna("Unknown", ["coarse", "fine"])
    names = ["ndcg", "map", "recall", "precision"]
    return d.sparkSession.sql(
        "SELECT CASE grouping_id() WHEN 3 THEN 'overall' WHEN 1 THEN 'coarse' ELSE 'fine' END AS level, coalesce(coarse, fine, 'all') AS grp, k, count(*) AS num_queries, "
        + ", ".join(f"avg({n}) AS {n}" for n in names)
        + " FROM (SELECT k, coarse, fine, ndcg, map, recall, precision FROM {d}) GROUP BY k, GROUPING SETS ((), (coarse), (fine))",
        d=d,
    )


def rank_bucket(rank: Column) -> Column:
    """Bucket of a best rank; null or -1 is a miss."""
    out = F.when(rank.isNull() | (rank < 1), F.lit("miss"))
    for upper, name in BUCKETS:
        out = out.when(rank <= upper, F.lit(name))
    return out.otherwise(F.lit("51+"))


def diagnose(run_: DataFrame, qrels: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, coarse, fine, has_image, n_gold, ndcg_at_10, best_gold_rank, rank_bucket): one row for each judged query.

    Gold is any judged document, whatever its grade.
    """
    ndcg = per_query(run_, qrels, (10,)).select("qid", rounded(F.col("ndcg")).alias("ndcg_at_10"))
    gold = qrels.groupBy("qid").agg(F.count("*").alias("n_gold"))
    best = run_.join(qrels.select("qid", "did"), ["qid", "did"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r"))
    d = gold.join(ndcg, "qid", "left").join(best, "qid", "left").join(groups, "qid", "left")
    return d.select("qid", F.coalesce("coarse", F.lit("Unknown")).alias("coarse"), F.coalesce("fine", F.lit("Unknown")).alias("fine"), F.coalesce("has_image", F.lit(False)).alias("has_image"), "n_gold", "ndcg_at_10", F.coalesce("r", F.lit(-1)).alias("best_gold_rank"), rank_bucket(F.col("r")).alias("rank_bucket"))


def gold_ranks(run_: DataFrame, questions: DataFrame, places: DataFrame) -> DataFrame:
    """(qid, n_gold, best_gold_rank, rank_bucket) as ``diagnose`` has it, where all rows of a query's documents are gold.

    ``questions`` is (qid, doc), ``places`` (did, doc), both without repeated rows. Judgements are never listed pair by
    pair, as a hot document has rows times queries of them: they are counted by document, and what belongs to several
    documents of one query counts once. Documents of the run are looked up among ``places``.
    """
    of_doc = questions.join(places.groupBy("doc").agg(F.count("*").alias("n")), "doc")
    many = lambda df, key: df.groupBy(key).agg(F.collect_list("doc").alias("docs")).where(F.size("docs") > 1).select(key, F.explode("docs").alias("doc"))
    again = many(questions, "qid").join(many(places, "did"), "doc").groupBy("qid", "did").agg((1 - F.count("*")).alias("n"))
    gold = of_doc.select("qid", "n").unionByName(again.select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("n_gold"))
    best = run_.join(questions, "qid").join(places, ["did", "doc"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r"))
    return gold.join(best, "qid", "left").select("qid", "n_gold", F.coalesce("r", F.lit(-1)).alias("best_gold_rank"), rank_bucket(F.col("r")).alias("rank_bucket"))


def _pq(spark: SparkSession, sf: str) -> DataFrame:
    return per_query(run(spark, sf), judged(spark, sf))


def _one(metric: str):
    return lambda spark, sf: _pq(spark, sf).select("qid", "k", rounded(F.col(metric)).alias(metric))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    r = report(_pq(spark, sf), query_meta(spark, sf))
    return r.select("level", "grp", "k", "num_queries", *[rounded(F.col(c)).alias(c) for c in ("ndcg", "map", "recall", "precision")])


def _diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return diagnose(run(spark, sf), judged(spark, sf), query_meta(spark, sf))


def _gold_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return gold_ranks(run(spark, sf), *documents(spark, sf))


METRIC_SQL = (
    RUN_SQL
    + """, ks AS (SELECT unnest([1, 3, 5, 10, 20, 100])::INT AS k
), ideal AS (
  SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS i FROM qrels_
), tot AS (SELECT qid, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS n_rel FROM qrels_ GROUP BY qid
), hits AS (
  SELECT run.qid, rank, rel, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run.qid ORDER BY rank) AS so_far FROM run JOIN qrels_ USING (qid, did)
), idcg AS (SELECT qid, k, sum(rel * (1.0e0 / (ln(i + 1.0e0) / ln(2.0e0)))) AS v FROM ideal, ks WHERE i <= k GROUP BY qid, k
), got AS (
  SELECT qid, k, sum(rel * (1.0e0 / (ln(rank + 1.0e0) / ln(2.0e0)))) AS dcg, sum(CASE WHEN rel >= 1 THEN so_far * 1.0e0 / rank ELSE 0e0 END) AS ap, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS hit
  FROM hits, ks WHERE rank <= k GROUP BY qid, k
), pq AS (
  SELECT tot.qid, ks.k, coalesce(dcg / v, 0e0) AS ndcg, coalesce(ap / n_rel, 0e0) AS map, coalesce(hit * 1.0e0 / n_rel, 0e0) AS recall, coalesce(hit, 0) * 1.0e0 / ks.k AS precision
  FROM tot CROSS JOIN ks LEFT JOIN idcg ON idcg.qid = tot.qid AND idcg.k = ks.k LEFT JOIN got ON got.qid = tot.qid AND got.k = ks.k
)"""
)
DIAG_SQL = (
    METRIC_SQL
    + """, best AS (SELECT run.qid, min(rank) AS r FROM run JOIN qrels_ USING (qid, did) GROUP BY run.qid
), diag AS (
  SELECT g.qid, coalesce(coarse, 'Unknown') AS coarse, coalesce(fine, 'Unknown') AS fine, coalesce(has_image, false) AS has_image, g.n AS n_gold, floor(pq.ndcg * 1.0e5 + 0.5e0) / 1.0e5 AS ndcg_at_10, coalesce(r, -1)::INT AS best_gold_rank,
    CASE WHEN r IS NULL THEN 'miss' WHEN r <= 1 THEN '1' WHEN r <= 5 THEN '2-5' WHEN r <= 10 THEN '6-10' WHEN r <= 50 THEN '11-50' ELSE '51+' END AS rank_bucket
  FROM (SELECT qid, count(*) AS n FROM qrels_ GROUP BY qid) g LEFT JOIN pq ON pq.qid = g.qid AND pq.k = 10 LEFT JOIN best ON best.qid = g.qid LEFT JOIN qmeta ON qmeta.qid = g.qid
)"""
)
_R = lambda c: f"floor({c} * 1.0e5 + 0.5e0) / 1.0e5 AS {c.split('(')[-1].rstrip(')')}"
_AVG = ", ".join(_R(f"avg({c})") for c in ("ndcg", "map", "recall", "precision"))

QUERIES = {
    "m1_ndcg": _one("ndcg"),
    "m2_map": _one("map"),
    "m3_recall": _one("recall"),
    "m4_precision": _one("precision"),
    "m6_zero_fill": lambda spark, sf: _pq(spark, sf).where("k = 10").groupBy((F.col("ndcg") == 0).alias("zero")).agg(F.count("*").alias("n")),
    "m7_rank_bucket": _gold_ranks,
    "a2_metric_report": _report,
    "m5_per_query": _diagnosis,
}
SQL = {
    **{k: f"WITH {METRIC_SQL} SELECT qid, k, floor({c} * 1.0e5 + 0.5e0) / 1.0e5 AS {c} FROM pq" for k, c in (("m1_ndcg", "ndcg"), ("m2_map", "map"), ("m3_recall", "recall"), ("m4_precision", "precision"))},
    "m6_zero_fill": f"WITH {METRIC_SQL} SELECT ndcg = 0 AS zero, count(*) AS n FROM pq WHERE k = 10 GROUP BY 1",
    "m7_rank_bucket": f"WITH {DIAG_SQL} SELECT qid, n_gold, best_gold_rank, rank_bucket FROM diag",
    "a2_metric_report": f"""WITH {METRIC_SQL}, j AS (SELECT pq.*, coalesce(coarse, 'Unknown') AS coarse, coalesce(fine, 'Unknown') AS fine FROM pq LEFT JOIN qmeta USING (qid))
SELECT 'overall' AS level, 'all' AS grp, k, count(*) AS num_queries, {_AVG} FROM j GROUP BY k
UNION ALL SELECT 'coarse', coarse, k, count(*), {_AVG} FROM j GROUP BY coarse, k
UNION ALL SELECT 'fine', fine, k, count(*), {_AVG} FROM j GROUP BY fine, k""",
    "m5_per_query": f"WITH {DIAG_SQL} SELECT * FROM diag",
}
