"""Token and relevance-map operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vector import rounded


def find_subsequence(ids: Column, needle: Column) -> Column:
    """0-based place of the first occurrence of ``needle`` in ``ids``; null if there is none or the needle is empty."""
    m = F.size(needle)
    places = F.when((m > 0) & (F.size(ids) >= m), F.sequence(F.lit(1), F.size(ids) - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(places, lambda i: F.slice(ids, i, m) == needle), F.lit(1)) - 1


def find_first(ids: Column, needles: Column) -> Column:
    """Place and length of the first of several needles that occurs, in their order; null if none does.

    A word has one token sequence at the start of a text and another after a space: both are given as needles.
    """
    found = F.filter(F.transform(needles, lambda n: F.struct(find_subsequence(ids, n).alias("at"), F.size(n).alias("size"))), lambda f: f["at"].isNotNull())
    return F.try_element_at(found, F.lit(1))


def positions_of(ids: Column, token: Column) -> Column:
    """0-based places of a token."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())


def scaled(values: Column) -> Column:
    """Values scaled to [0, 1]; all zeros where their range is below 1e-6."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(hi - lo < 1e-6, F.lit(0.0)).otherwise((v - lo) / (hi - lo)))


def product_map(maps: Column) -> Column:
    """Element-wise product of scaled maps; a flat map makes the whole product zero."""
    ones = F.transform(F.element_at(maps, 1), lambda v: F.lit(1.0))
    return F.aggregate(maps, ones, lambda acc, m: F.zip_with(acc, scaled(m), lambda a, b: a * b))


def grid_shape(n: Column, t: Column, h: Column, w: Column, merge: int = 2) -> Column:
    """(rows, cols) of a map of ``n`` tokens: the merged grid if its size fits, else the full grid; null if neither."""
    rows, cols = F.floor(h / merge).cast("int"), F.floor(w / merge).cast("int")
    pair = lambda r, c: F.struct(r.alias("rows"), c.alias("cols"))
    square = F.floor(F.sqrt(n.cast("double"))).cast("int")
    return F.when(h.isNull() | w.isNull(), pair(square, square)).when(t * rows * cols == n, pair(rows, cols)).when(t * h * w == n, pair(h, w))


def cells(df: DataFrame, key: str, values: str, shape: str) -> DataFrame:
    """(key, row, col, value) of the first frame; maps without a shape give nothing."""
    e = df.where(F.col(shape).isNotNull()).select(key, F.col(shape).alias("s"), F.posexplode(values).alias("i", "value"))
    return e.where(F.col("i") < F.col("s.rows") * F.col("s.cols")).select(key, F.floor(F.col("i") / F.col("s.cols")).cast("int").alias("row"), (F.col("i") % F.col("s.cols")).alias("col"), "value")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths of every document as token ids."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    return d.select("doc_id", F.transform(F.split("text", " "), F.length).alias("ids"))


def _maps(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", product_map(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("m"))


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").withColumn("s", grid_shape(F.size("embedding"), F.lit(1), F.lit(16), F.lit(16)))
    return cells(e, "vec_id", "embedding", "s").select("vec_id", "row", "col", F.col("value").cast("double").alias("value"))


_MAP_SQL = """a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT vec_id, v[1:32] AS p, v[33:64] AS q FROM a),
n AS (SELECT vec_id, list_transform(p, lambda x: CASE WHEN list_max(p) - list_min(p) < 1e-6 THEN 0e0 ELSE (x - list_min(p)) / (list_max(p) - list_min(p)) END) AS p, list_transform(q, lambda x: CASE WHEN list_max(q) - list_min(q) < 1e-6 THEN 0e0 ELSE (x - list_min(q)) / (list_max(q) - list_min(q)) END) AS q FROM h),
m AS (SELECT vec_id, i - 1 AS pos, p[i] * q[i] AS value FROM n, LATERAL (SELECT unnest(range(1, 33)) AS i))"""

QUERIES = {
    "v11_grid": _grid,
    "v12_either_needle": lambda spark, sf: _words(spark, sf).select("doc_id", find_first(F.col("ids"), F.array(F.array(F.lit(7), F.lit(7), F.lit(7)), F.array(F.lit(4), F.lit(2)))).alias("f")).select("doc_id", "f.at", "f.size"),
    "v12_subsequence": lambda spark, sf: _words(spark, sf).select("doc_id", find_subsequence(F.col("ids"), F.array(F.lit(3), F.lit(3))).alias("at")),
    "v13_positions": lambda spark, sf: _words(spark, sf).select("doc_id", F.size(positions_of(F.col("ids"), F.lit(3))).cast("bigint").alias("n"), F.try_element_at(positions_of(F.col("ids"), F.lit(3)), F.lit(1)).alias("first")),
    "a16_relevance_map": lambda spark, sf: _maps(spark, sf).select("vec_id", F.posexplode("m").alias("pos", "value")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("value")).alias("value")),
    "a17_map_stats": lambda spark, sf: _maps(spark, sf).select("vec_id", F.explode("m").alias("x")).groupBy("vec_id").agg(*[rounded(f("x")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"), (F.stddev_pop, "sd"))]),
}
SQL = {
    "v12_either_needle": """WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda s: length(s)) AS ids FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(range(1, len(ids) - 1), lambda i: ids[i] = 7 AND ids[i + 1] = 7 AND ids[i + 2] = 7)[1] AS a, list_filter(range(1, len(ids)), lambda i: ids[i] = 4 AND ids[i + 1] = 2)[1] AS b FROM w)
SELECT doc_id, (coalesce(a, b) - 1)::INT AS at, CASE WHEN a IS NOT NULL THEN 3 WHEN b IS NOT NULL THEN 2 END AS size FROM p""",
    "v11_grid": "SELECT vec_id, ((i - 1) // 8)::INT AS \"row\", ((i - 1) % 8)::INT AS col, embedding[i]::DOUBLE AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)",
    "v12_subsequence": "WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda s: length(s)) AS ids FROM documents WHERE text IS NOT NULL) SELECT doc_id, (list_filter(range(1, len(ids)), lambda i: ids[i] = 3 AND ids[i + 1] = 3)[1] - 1)::INT AS at FROM w",
    "v13_positions": "WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda s: length(s)) AS ids FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(ids, lambda x: x = 3)) AS n, (list_position(ids, 3) - 1)::INT AS \"first\" FROM w",
    "a16_relevance_map": f"WITH {_MAP_SQL} SELECT vec_id, pos, floor(value * 1.0e5 + 0.5e0) / 1.0e5 AS value FROM m",
    "a17_map_stats": f"WITH {_MAP_SQL} SELECT vec_id, " + ", ".join(f"floor({f}(value) * 1.0e5 + 0.5e0) / 1.0e5 AS {n}" for f, n in (("min", "lo"), ("max", "hi"), ("avg", "mean"), ("stddev_pop", "sd"))) + " FROM m GROUP BY 1",
}
