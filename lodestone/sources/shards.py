"""Sharded vector sink with a manifest, and resuming by shard.

A vector table is written in chunks of consecutive rows, one folder for each chunk, and a manifest of JSON lines says
how many rows each has. A chunk is done if the manifest's last line about it and its folder agree; all others are
written again by the next run. Reading numbers the rows of good chunks through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.aggregates import finalise
from lodestone.session import cut

from . import io

MANIFEST = "chunk_idx bigint, line_no bigint, n bigint"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_idx, line_no, n); broken lines are skipped, no manifest is an empty one."""
    path = f"{folder}/manifest"
    return io.read_jsonl(spark, path, MANIFEST).where("chunk_idx IS NOT NULL") if io.exists(spark, path) else spark.createDataFrame([], MANIFEST)


def shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all shards: ``schema`` and chunk_idx."""
    path = f"{folder}/shards"
    full = f"{schema}, chunk_idx bigint"
    return spark.read.schema(full).option("basePath", path).parquet(path) if io.exists(spark, path) else spark.createDataFrame([], full)


def done_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(chunk_idx) of the chunks whose shard still has the rows that the last line about it says."""
    held = shards(spark, folder, schema).groupBy("chunk_idx").agg(F.count("*").alias("held"))
    last = manifest(spark, folder).groupBy("chunk_idx").agg(F.max_by("n", "line_no").alias("n"))
    return last.join(held, "chunk_idx").where("n = held").select("chunk_idx")


def write_shards(rows: DataFrame, folder: str, schema: str, place: str = "pos", chunk_rows: int = 4096) -> int:
    """Writes the chunks that are not done; how many were written.

    ``rows`` have ``place``, their number from 0, and the columns of ``schema``. Chunks already begun are replaced as a
    whole (dynamic partition overwrite); the manifest gets its lines after the rows are there, so a run that dies in
    between leaves chunks that count as not done.
    """
    spark = rows.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    chunked = rows.withColumn("chunk_idx", F.floor(F.col(place) / chunk_rows))
    todo = cut(chunked.join(done_chunks(spark, folder, schema), "chunk_idx", "left_anti").select(*names, "chunk_idx"))
    said = cut(todo.groupBy("chunk_idx").agg(F.count("*").alias("n")))
    number = said.count()
    if number:
        todo.repartition("chunk_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_idx").parquet(f"{folder}/shards")
        next_line = (manifest(spark, folder).agg(F.max("line_no")).collect()[0][0] or 0) + 1
        io.append_jsonl(said.select("chunk_idx", F.lit(next_line).cast("bigint").alias("line_no"), "n"), f"{folder}/manifest")
    return number


def read_shards(spark: SparkSession, folder: str, schema: str, place: str = "pos") -> DataFrame:
    """Rows of the good chunks with ``global_row``, their number over all of them in the order of chunks and places."""
    rows = shards(spark, folder, schema)
    least = rows.groupBy("chunk_idx").agg(F.min(place).alias("__first"))
    local = rows.join(least, "chunk_idx").withColumn("pos", F.col(place) - F.col("__first")).drop("__first")
    return finalise(manifest(spark, folder), local)


def _sharded(spark: SparkSession, sf: str) -> DataFrame:
    """Written in two runs; in between a shard is lost, and the second run writes it again and nothing else."""
    folder, schema = io.scratch(spark, "sharded"), "pos bigint, prop_id string"
    m = spark.read.parquet(f"{sf}/meta.parquet").groupBy("row").agg(F.min("prop_id").alias("prop_id")).select(F.col("row").alias("pos"), "prop_id")
    write_shards(m, folder, schema, chunk_rows=512)
    io.drop(spark, f"{folder}/shards/chunk_idx=1")
    again = write_shards(m, folder, schema, chunk_rows=512)
    return read_shards(spark, folder, schema).select("chunk_idx", "prop_id", "global_row", F.lit(again).cast("bigint").alias("written_again"))


QUERIES = {"k6_sharded_sink": _sharded}
SQL = {
    "k6_sharded_sink": """WITH r AS (SELECT "row" AS r, min(prop_id) AS prop_id FROM meta GROUP BY 1)
SELECT (r // 512)::BIGINT AS chunk_idx, prop_id, row_number() OVER (ORDER BY r) - 1 AS global_row, (SELECT count(*) FROM (SELECT 1 FROM r WHERE r // 512 = 1 LIMIT 1))::BIGINT AS written_again FROM r""",
}
