"""Readers and writers (S1-S14, K1-K8, K13-K15): runs, vectors, tables and logs, all as Spark sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ensure_checkpoint_dir

#: Columns of the vector, run, result and grounding files.
VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
PER_QUERY = "qid string, run_id string, coarse_domain string, category string, has_image boolean, n_gold int, ndcg_at_10 double, best_gold_rank int, rank_bucket string, written_at timestamp_ntz"
GROUNDING = "line_no bigint, corpus_id string, prop_id string, prop_idx int, text string, grounded boolean, regions array<struct<key_visual_entity: string, bbox_norm: string>>, confidence double, reason string, error string"


_CSV = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "nullValue": "\\N", "emptyValue": ""}


def is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """First of several possible places (an old and a new layout) that exists."""
    return next((p for p in paths if exists(spark, p)), None)


def read_split(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """A saved data set: its ``test`` split if there is one, else its first."""
    return spark.read.parquet(f"{path}/{'test' if 'test' in splits else splits[0]}")


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors at ``path``, or None where nothing was written yet."""
    return spark.read.schema(VECTORS).parquet(path) if exists(spark, path) else None


def write_run(run: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A run as JSON lines {"qid": .., "results": {did: score}}, one line for each query, best first."""
    rows = run.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "did", "score"))).alias("r"))
    rows.select("qid", F.map_from_entries(F.transform("r", lambda x: F.struct(x["did"], x["score"]))).alias("results")).write.mode(mode).json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, did, score, rank) of a run written by ``write_run``."""
    d = spark.read.schema("qid string, results map<string, double>").json(path)
    d = d.select("qid", F.posexplode("results").alias("pos", "did", "score"))
    return d.select("qid", "did", "score", (F.col("pos") + 1).alias("rank"))


def read_run_document(spark: SparkSession, path: str) -> DataFrame:
    """(qid, did, score) of one JSON document {qid: {did: score}}."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return d.select(F.explode("m").alias("qid", "r")).select("qid", F.explode("r").alias("did", "score"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are skipped. Nested JSON in a string column stays raw text."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


UNITS = "key string, units array<string>"


def write_units(units: DataFrame, path: str) -> None:
    """Adds (key, units) to a cache of text units, a JSON line for each key."""
    append_jsonl(units.select("key", "units"), path)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(key, units) of the cache, of several lines of a key one; empty where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], UNITS)
    return read_jsonl(spark, path, UNITS).where("key IS NOT NULL").groupBy("key").agg(F.max("units").alias("units"))


def units_of(texts: DataFrame, units: DataFrame, task: str = "document", text: str = "text", clean: bool = False) -> DataFrame:
    """``texts`` with their cached ``units`` (null where there are none); ``clean`` strips them and drops empty ones, [] for none."""
    from lodestone.functions.text import text_key

    found = texts.withColumn("key", text_key(F.lit(task), F.col(text))).join(units.select("key", "units"), "key", "left").drop("key")
    if not clean:
        return found
    stripped = F.filter(F.transform("units", lambda u: F.regexp_replace(u, r"(?U)^\s+|\s+$", "")), lambda u: u.isNotNull() & (u != ""))
    return found.withColumn("units", F.coalesce(stripped, F.array().cast("array<string>")))


def write_subset(kept: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """A benchmark subset as three tables: kept corpus rows, the judgements that still point at one, their queries.

    ``kept`` (corpus_id); ``corpus`` (id, ..), ``queries`` (id, ..), ``qrels`` (query_id, corpus_id, score).
    """
    ids = kept.select("corpus_id").distinct()
    judged = qrels.join(ids, "corpus_id", "left_semi")
    corpus.join(ids.withColumnRenamed("corpus_id", "id"), "id", "left_semi").write.mode(mode).parquet(f"{folder}/corpus.parquet")
    judged.write.mode(mode).parquet(f"{folder}/qrels.parquet")
    queries.join(judged.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").write.mode(mode).parquet(f"{folder}/queries.parquet")


def write_document(document: dict, path: str) -> None:
    """A small JSON document on the driver's file system."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a run's cache; True if there was one. Only ever called with a path the caller named."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- catalogue: write, read back
def _roundtrip_run(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.retrieval import run

    p = scratch(spark, "run")
    write_run(run(spark, sf), p)
    return read_run(spark, p).select("qid", "did", "score", "rank")


def _roundtrip_csv(spark: SparkSession, sf: str) -> DataFrame:
    p = scratch(spark, "csv")
    d = spark.read.parquet(f"{sf}/per_query.parquet")
    names = [x.split()[0] for x in PER_QUERY.split(", ")]
    write_csv(d.select(*[F.col(n).cast("timestamp_ntz").alias(n) if n == "written_at" else F.col(n) for n in names]), p)
    return read_csv(spark, p, PER_QUERY).select("qid", "run_id", "has_image", "n_gold", F.nanvl("ndcg_at_10", F.lit(-1.0)).alias("ndcg_at_10"), "rank_bucket")


def _roundtrip_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    p = scratch(spark, "jsonl")
    append_jsonl(spark.read.parquet(f"{sf}/doc_propositions.parquet").drop("written_at"), p)
    return read_jsonl(spark, p, GROUNDING).select("line_no", "prop_id", "grounded", F.try_element_at(F.col("regions"), F.lit(1))["bbox_norm"].alias("raw"))


def _roundtrip_vectors(spark: SparkSession, sf: str) -> DataFrame:
    p = scratch(spark, "vectors")
    d = spark.read.parquet(f"{sf}/subdoc_vectors.parquet")
    write_vectors(d.select(F.col("row").cast("string").alias("id"), "embedding"), p)
    return read_vectors(spark, p).select("id", F.try_element_at("embedding", F.lit(1)).cast("double").alias("x0")).where("NOT isnan(x0) OR x0 IS NULL")


def _subset_tables(spark: SparkSession, sf: str) -> DataFrame:
    p = scratch(spark, "subset")
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("corpus", "queries", "qrels")}
    write_subset(t["qrels"].where("score >= 1").select("corpus_id"), t["corpus"], t["queries"], t["qrels"], p)
    back = {n: spark.read.parquet(f"{p}/{n}.parquet") for n in t}
    part = lambda n, c: back[n].select(F.lit(n).alias("tbl"), F.col(c).alias("id"))
    return part("corpus", "id").unionByName(part("queries", "id")).unionByName(part("qrels", "corpus_id"))


def _unit_cache(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.functions.text import sentences, text_key

    p = scratch(spark, "units")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = d.where("text IS NOT NULL AND doc_id % 3 <> 0")
    write_units(known.select(text_key(F.lit("document"), F.col("text")).alias("key"), sentences(F.col("text")).alias("units")), p)
    return units_of(d, read_units(spark, p)).select("doc_id", F.size("units").cast("bigint").alias("n"))


def _broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the log with torn ones in between."""
    p = scratch(spark, "broken")
    d = spark.read.parquet(f"{sf}/doc_propositions.parquet").select("line_no", "prop_id")
    line = F.to_json(F.struct("line_no", "prop_id"))
    d.select(F.when(F.col("line_no") % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(p)
    return read_jsonl(spark, p, "line_no bigint, prop_id string").where("line_no IS NOT NULL")


QUERIES = {
    "k5_subset_tables": _subset_tables,
    "s10_unit_cache": _unit_cache,
    "s9_broken_lines": _broken_lines,
    "s7_read_run": _roundtrip_run,
    "s8_read_csv": _roundtrip_csv,
    "s9_read_jsonl": _roundtrip_jsonl,
    "s6_read_vectors": _roundtrip_vectors,
}


def _sql() -> dict[str, str]:
    from lodestone.operators.dilution import _WS
    from lodestone.operators.retrieval import RUN_SQL

    return {
        "k5_subset_tables": """WITH k AS (SELECT DISTINCT corpus_id FROM qrels WHERE score >= 1), j AS (SELECT * FROM qrels WHERE corpus_id IN (SELECT corpus_id FROM k))
SELECT 'corpus' AS tbl, id FROM corpus WHERE id IN (SELECT corpus_id FROM k) UNION ALL SELECT 'queries', id FROM queries WHERE id IN (SELECT query_id FROM j) UNION ALL SELECT 'qrels', corpus_id FROM j""",
        "s10_unit_cache": f"""WITH k AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN k.text IS NOT NULL THEN len(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(d.text, chr(13), ''), '([.!?]){_WS}+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s, ' ' || chr(9) || '-#*>')), lambda s: length(s) >= 15)) END AS n
FROM documents d LEFT JOIN k ON k.text = d.text""",
        "s9_broken_lines": "SELECT line_no, prop_id FROM doc_propositions WHERE line_no % 5 <> 0",
        "s7_read_run": f"WITH {RUN_SQL} SELECT qid, did, score, rank FROM run",
        "s8_read_csv": "SELECT qid, run_id, has_image, n_gold, CASE WHEN isnan(ndcg_at_10) THEN -1e0 ELSE ndcg_at_10 END AS ndcg_at_10, rank_bucket FROM per_query",
        "s9_read_jsonl": "SELECT line_no, prop_id, grounded, regions[1].bbox_norm AS raw FROM doc_propositions",
        "s6_read_vectors": 'SELECT "row"::VARCHAR AS id, embedding[1]::DOUBLE AS x0 FROM subdoc_vectors WHERE embedding[1] IS NULL OR NOT isnan(embedding[1])',
    }


SQL = _sql()
