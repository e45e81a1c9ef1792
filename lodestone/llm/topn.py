"""Top N items within every group: ``row_number`` over (score, identifier) with a rank filter.

Written in SQL so that the optimiser turns the rank filters into group limits on both sides of each shuffle. The first
limit is by dense rank, which copies of a row share: each map task sends of a group its N best different rows, and of
these the copies it has; these go to SALTS places, so no task gets all copies of a row. There copies are folded, and the
second limit, by row number, sees at most N rows of a group from each place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that the map tasks' shares of a group are spread over.
SALTS = 64


def top_n(items: DataFrame, group: str, item: str, score: str, n: int = 3) -> DataFrame:
    """(group_key, item_key, score, rank_no): the ``n`` best items of every group, equals by smaller item.

    Rows with a null group, null item or a null or NaN score are never returned. Repeated rows count once; they are
    spread and folded in between the two limits, so copies of one row cannot crowd a task. One item with several
    scores keeps each of them. Other columns are ignored; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    view = items.select(F.col(group).alias("group_key"), F.col(item).alias("item_key"), F.col(score).cast("double").alias("score"), salt)
    return view.sparkSession.sql(
        """
        SELECT group_key, item_key, score, rank_no FROM (
          SELECT group_key, item_key, score, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, item_key ASC) AS rank_no
          FROM (
            SELECT DISTINCT group_key, item_key, score FROM (
              SELECT group_key, item_key, score, dense_rank() OVER (PARTITION BY group_key, salt ORDER BY score DESC, item_key ASC) AS place
              FROM {items} WHERE group_key IS NOT NULL AND item_key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
            WHERE place <= {n}))
        WHERE rank_no <= {n}
        """,
        items=view,
        n=n,
    )


def standing_runs(per_query: DataFrame) -> DataFrame:
    """The row of each (qid, run_id) with the latest written_at; a null time is the oldest.

    Equals (other than repeated rows) go to the higher score. An aggregate with a partial step: no sort of the groups.
    """
    s = F.struct(F.col("written_at"), F.nanvl(F.col("ndcg_at_10"), F.lit(None).cast("double")).alias("s"))
    return per_query.groupBy("qid", "run_id").agg(F.max(s).alias("m")).select("qid", "run_id", F.col("m.s").alias("ndcg_at_10"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """p2_found: three best sub-documents of every corpus_id and three best runs of every query."""
    meta = top_n(spark.read.parquet(f"{sf}/meta.parquet"), "corpus_id", "row", "best_score", 3)
    runs = top_n(standing_runs(spark.read.parquet(f"{sf}/per_query.parquet")), "qid", "run_id", "ndcg_at_10", 3)
    shape = lambda df, g: df.select(F.lit(g).alias("grp"), "group_key", F.col("item_key").cast("string").alias("item_key"), F.col("rank_no").cast("int").alias("rank_no"))
    return shape(meta, "meta").unionByName(shape(runs, "per_query"))


QUERIES = {"p2_found": found}
SQL = {
    "p2_found": """
WITH m AS (
  SELECT DISTINCT corpus_id, "row" AS item, best_score AS score FROM meta WHERE corpus_id IS NOT NULL AND best_score IS NOT NULL AND NOT isnan(best_score)
), mr AS (
  SELECT 'meta' AS grp, corpus_id AS group_key, item::VARCHAR AS item_key, (row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, item))::INT AS rank_no FROM m
), s AS (
  SELECT qid, run_id, ndcg_at_10 FROM per_query
  QUALIFY row_number() OVER (PARTITION BY qid, run_id ORDER BY written_at DESC NULLS LAST, CASE WHEN isnan(ndcg_at_10) THEN NULL ELSE ndcg_at_10 END DESC NULLS LAST) = 1
), q AS (
  SELECT 'per_query' AS grp, qid AS group_key, run_id AS item_key, (row_number() OVER (PARTITION BY qid ORDER BY ndcg_at_10 DESC, run_id))::INT AS rank_no
  FROM s WHERE qid IS NOT NULL AND run_id IS NOT NULL AND ndcg_at_10 IS NOT NULL AND NOT isnan(ndcg_at_10)
)
SELECT * FROM mr WHERE rank_no <= 3 UNION ALL SELECT * FROM q WHERE rank_no <= 3
"""
}
