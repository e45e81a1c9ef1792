"""Pipelines around pluggable models (Q9, Q10, Q12, Q13, Q15, Q16, V5, V8): propositions, grounding, segmentation, matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import text as T
from lodestone.functions.vector import inner_product, rounded, sigmoid

from .dilution import _WS, cosine
from .encoders import Encoder, HashEncoder, encode
from .regions import VIEWS, best_match, distinct_boxes, views


def _call(batches: Iterator[pa.RecordBatch], model: Callable[[list[str]], list[str]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array(model(b.column(1).to_pylist()), pa.string())], names=["key", "raw"])


def propositions(texts: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]], task: str = "document") -> DataFrame:
    """(key, units) of every different text: from ``cache`` (key, units), else from the model's answer.

    ``texts`` (title, section, text); the key covers task and text only, so equal texts under different titles share
    one answer (that of the smallest title). Answers that hold no list fall back to the raw answer, then the text.
    """
    keyed = texts.where("text IS NOT NULL").withColumn("key", T.text_key(F.lit(task), F.col("text")))
    one = keyed.groupBy("key").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("section", F.lit("")).alias("section"), "text")).alias("t")).select("key", "t.*")
    known = cache.select("key", "units").dropDuplicates(["key"])
    new = one.join(known, "key", "left_anti")
    asked = new.select("key", T.proposition_prompt(F.col("title"), F.col("section"), F.col("text")).alias("prompt")).mapInArrow(partial(_call, model=model), "key string, raw string")
    made = new.join(asked, "key").select("key", T.propositions_or_text(F.col("raw"), F.col("text"), F.col("text")).alias("units"))
    return known.join(one, "key", "left_semi").unionByName(made)


def units_report(units: DataFrame) -> DataFrame:
    """(texts, units, mean_units)."""
    return units.agg(F.count("*").alias("texts"), F.sum(F.size("units")).cast("bigint").alias("units"), F.avg(F.size("units")).alias("mean_units"))


def _ground(batches: Iterator[pa.RecordBatch], model: Callable[[str, bytes | None], str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = [x.to_pylist() for x in b.columns]
        raw, error = [], []
        for text, image in zip(c[3], c[4]):
            try:
                raw.append(model(text, image))
                error.append(None)
            except Exception as e:  # noqa: BLE001 - the error is the result
                raw.append(None)
                error.append(str(e)[:300])
        yield pa.record_batch([*b.columns[:4], pa.array(raw, pa.string()), pa.array(error, pa.string())], names=["corpus_id", "prop_id", "prop_idx", "text", "raw", "error"])


ANSWER = "grounded boolean, regions array<struct<key_visual_entity: string, bbox_norm: string>>, confidence double, reason string"


def ground(documents: DataFrame, units: DataFrame, done: DataFrame, model: Callable[[str, bytes | None], str]) -> DataFrame:
    """Grounding records of propositions not in ``done`` (corpus_id, prop_idx).

    ``documents`` (corpus_id, text, image bytes), ``units`` (key, units). A failed call gives a record with its error
    and null grounded; like any record it counts as done afterwards.
    """
    d = documents.withColumn("key", T.text_key(F.lit("document"), F.col("text"))).join(units, "key")
    todo = d.select("corpus_id", "image", F.posexplode("units").alias("prop_idx", "prop")).join(done.select("corpus_id", "prop_idx").distinct(), ["corpus_id", "prop_idx"], "left_anti")
    rows = todo.select("corpus_id", F.concat("corpus_id", F.lit("_p"), "prop_idx").alias("prop_id"), "prop_idx", F.col("prop").alias("text"), "image")
    got = rows.mapInArrow(partial(_ground, model=model), "corpus_id string, prop_id string, prop_idx int, text string, raw string, error string")
    a = got.withColumn("a", F.from_json("raw", ANSWER))
    bad = F.when(F.col("raw").isNotNull() & F.col("a.grounded").isNull(), F.lit("unreadable answer"))
    return a.select("corpus_id", "prop_id", "prop_idx", "text", "a.grounded", F.coalesce("a.regions", F.array()).alias("regions"), "a.confidence", "a.reason", F.coalesce("error", bad).alias("error"))


def _segment(batches: Iterator[pa.RecordBatch], segmenter: Callable[[bytes], list[dict]]) -> Iterator[pa.RecordBatch]:
    names = ["x", "y", "w", "h", "area", "score"]
    for b in batches:
        rows = []
        for image, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                found = segmenter(raw) if raw is not None else []
            except Exception:  # noqa: BLE001 - a broken image has no segments
                found = []
            rows += [(image, i, *(float(s[n]) for n in names)) for i, s in enumerate(found)]
        cols = list(zip(*rows)) or [[]] * 8
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["image", "ordinal", *names])


def segment(images: DataFrame, segmenter: Callable[[bytes], list[dict]]) -> DataFrame:
    """Annotations (image, ordinal, x, y, w, h, area, score) of images (image, bytes) by a plugged-in segmenter."""
    return images.select("image", "bytes").mapInArrow(partial(_segment, segmenter=segmenter), "image string, ordinal int, x double, y double, w double, h double, area double, score double")


def region_experiment(images: DataFrame, texts: DataFrame, segmenter: Callable[[bytes], list[dict]], crop: Callable[[bytes, tuple, bool], bytes], encoder: Encoder, width: int, height: int, logits: bool = False) -> DataFrame:
    """Best text of every region, from segmentation to match: (item, region_id, view, text_idx, text, score, raw_score).

    ``images`` (image, bytes), ``texts`` (item, text_idx, text) with item = image; ``crop`` cuts a view out of an image.
    """
    found = candidates(segment(images, segmenter), width, height)
    seen = views(found.select("image", "region_id", "x1", "y1", "x2", "y2"), width, height).join(images.select("image", "bytes"), "image")

    def cropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            pixels = [crop(raw, box, masked) for raw, *box, masked in zip(c[1], c[2], c[3], c[4], c[5], c[6])]
            yield pa.record_batch([b.column(0), pa.array([None] * len(pixels), pa.string()), pa.array(pixels, pa.binary())], names=["id", "text", "image"])

    key = F.concat_ws("|", "image", F.col("region_id").cast("string"), "view")
    items = seen.select(key.alias("id"), "bytes", "x1", "y1", "x2", "y2", "masked").mapInArrow(cropped, "id string, text string, image binary")
    r = encode(items, encoder)
    part = lambda i: F.regexp_extract("id", r"^(.*)\|(\d+)\|(\w+)$", i)
    regions = r.select(part(1).alias("item"), part(2).cast("int").alias("region_id"), part(3).alias("view"), "embedding")
    t = encode(texts.select(F.concat_ws("|", "item", F.col("text_idx").cast("string")).alias("id"), "text", F.lit(None).cast("binary").alias("image")), encoder)
    t = texts.withColumn("id", F.concat_ws("|", "item", F.col("text_idx").cast("string"))).join(t, "id").drop("id")
    return match(regions, t, logits=logits)


def candidates(annotations: DataFrame, width: int, height: int, min_area: int = 100, max_share: float = 0.7) -> DataFrame:
    """(image, region_id, x1..y2, area, score) of segments (image, ordinal, x, y, w, h, area, score).

    Segments too small or too large go, corners are truncated to whole pixels, of identical boxes the first stays;
    region_id counts what is left in order.
    """
    from pyspark.sql import Window

    d = annotations.where((F.col("area") >= min_area) & (F.col("area") <= max_share * width * height))
    d = d.withColumn("b", G.clip_xywh(*[F.col(c) for c in "xywh"], width, height, "truncate")).where("b.x2 > b.x1 AND b.y2 > b.y1")
    d = distinct_boxes(d.select("image", "ordinal", "b.*", "area", "score"), "image", "ordinal")
    return d.withColumn("region_id", F.row_number().over(Window.partitionBy("image").orderBy("ordinal")) - 1).drop("ordinal")


def match(regions: DataFrame, texts: DataFrame, views: tuple[str, ...] = VIEWS, logits: bool = False) -> DataFrame:
    """Best text of every region from (item, region_id, view, embedding) and (item, text_idx, text, embedding).

    Regions and texts of one item meet in an equi-join; scores are inner products, through a sigmoid for ``logits``.
    """
    t = texts.select("item", "text_idx", "text", F.col("embedding").alias("te"))
    raw = inner_product(F.col("embedding"), F.col("te"))
    s = regions.join(t, "item").withColumn("raw_score", raw).withColumn("score", sigmoid(F.col("raw_score")) if logits else F.col("raw_score"))
    return best_match(s, ["item", "region_id"], views).select("item", "region_id", "view", "text_idx", "text", "score", "raw_score")


def prefix_probe(pairs: DataFrame, encoder: Encoder, marker: str) -> DataFrame:
    """(id, sim_full, sim_prefix, delta): a query against a text and against its part before ``marker``."""
    none = F.lit(None).cast("binary").alias("image")
    enc = lambda text, name: encode(pairs.select("id", text.alias("text"), none), encoder).withColumnRenamed("embedding", name)
    j = enc(F.col("query"), "q").join(enc(F.col("text"), "f"), "id").join(enc(T.before_marker(F.col("text"), marker), "p"), "id")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    full, prefix = z(cosine(F.col("q"), F.col("f"))), z(cosine(F.col("q"), F.col("p")))
    return j.select("id", full.alias("sim_full"), prefix.alias("sim_prefix"), (prefix - full).alias("delta"))


def path_probe(pairs: DataFrame, one: Encoder, other: Encoder) -> DataFrame:
    """(id, sim_one, sim_other, diff): the same pair encoded in two ways."""
    none = F.lit(None).cast("binary").alias("image")

    def sim(e: Encoder, name: str) -> DataFrame:
        q = encode(pairs.select("id", F.col("query").alias("text"), none), e).withColumnRenamed("embedding", "q")
        d = encode(pairs.select("id", "text", none), e).withColumnRenamed("embedding", "d")
        return q.join(d, "id").select("id", F.coalesce(cosine(F.col("q"), F.col("d")), F.lit(0.0)).alias(name))

    j = sim(one, "sim_one").join(sim(other, "sim_other"), "id")
    return j.withColumn("diff", F.abs(F.col("sim_one") - F.col("sim_other")))


def _echo(prompts: list[str]) -> list[str]:
    """Stand-in for a propositionizer: the content's lines as a JSON list."""
    import json

    return [json.dumps([x for x in p.split(". Content: ", 1)[-1].split("\n") if x.strip()], ensure_ascii=False) for p in prompts]


def _agree(text: str, image: bytes | None) -> str:
    """Stand-in for a grounding model."""
    import json

    return json.dumps({"grounded": image is not None, "regions": [], "confidence": 0.5, "reason": None}, ensure_ascii=False)


def _probe(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("category", F.lit("")).alias("query"), "text")
    r = prefix_probe(d, HashEncoder(), "\n")
    return r.select("id", *[rounded(F.col(c), 4).alias(c) for c in ("sim_full", "sim_prefix")])


def _units(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("title"), F.col("category").alias("section"), "text")
    return propositions(d, spark.createDataFrame([], "key string, units array<string>"), _echo)


def _match(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a label as regions of an item, those divisible by 100 as its texts."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("item"), "vec_id", "embedding")
    regions = e.select("item", F.col("vec_id").alias("region_id"), F.element_at(F.array(*[F.lit(v) for v in VIEWS]), (F.col("vec_id") % 3 + 1).cast("int")).alias("view"), "embedding")
    texts = e.where("vec_id % 100 = 0").select("item", F.col("vec_id").alias("text_idx"), F.col("vec_id").cast("string").alias("text"), "embedding")
    return match(regions, texts).select("item", "region_id", "view", "text_idx", "score")


QUERIES = {
    "q9_prefix_probe": _probe,
    "q12_propositions": lambda spark, sf: _units(spark, sf).select("key", F.size("units").cast("bigint").alias("n")),
    "q16_region_text_match": _match,
}
SQL = {
    "q9_prefix_probe": rf"""WITH d AS (
  SELECT doc_id::VARCHAR AS id, coalesce(category, '') AS q, text AS f, CASE WHEN instr(text, chr(10)) > 0 THEN regexp_replace(substr(text, 1, instr(text, chr(10)) - 1), '{_WS}+$', '') ELSE text END AS p FROM documents WHERE text IS NOT NULL
), unit AS (SELECT id, 'q' AS k, q AS t FROM d UNION ALL SELECT id, 'f', f FROM d UNION ALL SELECT id, 'p', p FROM d
), tok AS (SELECT id, k, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS w FROM unit
), slot AS (
  SELECT id, k, b, sum(v)::BIGINT AS v FROM (SELECT id, k, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS v FROM tok) GROUP BY id, k, b HAVING sum(v) <> 0
), n2 AS (SELECT id, k, sum(v * v)::DOUBLE AS n FROM slot GROUP BY id, k
), dot AS (SELECT y.id, y.k, sum(x.v * y.v)::DOUBLE AS s FROM slot x JOIN slot y ON x.id = y.id AND x.b = y.b WHERE x.k = 'q' AND y.k <> 'q' GROUP BY y.id, y.k
), sim AS (SELECT a.id, b.k, coalesce(s, 0e0) / sqrt(a.n * b.n) AS c FROM n2 a JOIN n2 b ON a.id = b.id AND a.k = 'q' AND b.k <> 'q' LEFT JOIN dot ON dot.id = b.id AND dot.k = b.k)
SELECT d.id, floor(coalesce(f.c, 0e0) * 1.0e4 + 0.5e0) / 1.0e4 AS sim_full, floor(coalesce(p.c, 0e0) * 1.0e4 + 0.5e0) / 1.0e4 AS sim_prefix
FROM d LEFT JOIN sim f ON f.id = d.id AND f.k = 'f' LEFT JOIN sim p ON p.id = d.id AND p.k = 'p'""",
    "q12_propositions": r"""WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), p AS (SELECT text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g'))), lambda s: s <> '') AS u FROM d)
SELECT md5('document:' || text) AS key, CASE WHEN len(u) = 0 THEN 1 ELSE len(u) END AS n FROM p""",
    "q16_region_text_match": """WITH e AS (SELECT label AS item, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT r.item, r.vec_id AS region_id, (['masked', 'box', 'context'])[r.vec_id % 3 + 1] AS view, t.vec_id AS text_idx, list_inner_product(r.v, t.v) AS score FROM e r JOIN e t ON t.item = r.item AND t.vec_id % 100 = 0)
SELECT item, region_id, view, text_idx, score FROM s QUALIFY row_number() OVER (PARTITION BY item, region_id ORDER BY score DESC, text_idx) = 1""",
}
