"""Resumable ingest (I1-I6) with Structured Streaming: file source, ``availableNow``, checkpointed progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.io import exists, is_directory, scratch


def file_stream(spark: SparkSession, path: str, schema: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream over the parquet files under ``path``; files seen before a restart are not read again."""
    r = spark.readStream.schema(spark.read.parquet(path).schema if schema is None else schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if not is_directory(spark, path):  # a stream watches a folder; a single file is picked by name
        folder, _, name = path.rpartition("/")
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def ingest(stream: DataFrame, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run what is available now through ``transform`` into a parquet sink, exactly once; a second call resumes."""
    out = transform(stream) if transform else stream
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def ingest_new(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """As ``ingest``, but only rows whose keys the sink does not hold yet are worked on.

    The done set is the sink itself: an anti-join by key, so reordered or rewritten inputs do no harm. A batch
    repeated after a failure finds its rows done.
    """

    def step(batch: DataFrame, _: int) -> None:
        todo = batch.dropDuplicates(keys)
        if exists(spark, sink):
            todo = todo.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        work(todo).write.mode("append").parquet(sink)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts with a watermark; rows later than ``late`` are left out."""
    t = stream.withWatermark(time, late)
    return t.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    sink, mark = scratch(spark, "events"), scratch(spark, "events-progress")
    s = file_stream(spark, f"{sf}/events.parquet")
    ingest(s, sink, mark)
    ingest(file_stream(spark, f"{sf}/events.parquet"), sink, mark)  # a resumed run adds nothing
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _grounding(spark: SparkSession, sf: str) -> DataFrame:
    sink, mark = scratch(spark, "lines"), scratch(spark, "lines-progress")
    work = lambda d: d.select("corpus_id", "prop_idx", F.length("text").alias("n"))
    for m in (mark, mark + "-lost"):  # even with its progress lost, a second run finds the work done
        ingest_new(spark, file_stream(spark, f"{sf}/doc_propositions.parquet"), sink, m, ["corpus_id", "prop_idx"], work)
    return spark.read.parquet(sink).select("corpus_id", "prop_idx")


QUERIES = {"i1_incremental_ingest": _events, "i4_resume_by_key": _grounding}
SQL = {
    "i1_incremental_ingest": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "i4_resume_by_key": "SELECT DISTINCT corpus_id, prop_idx FROM doc_propositions",
}
