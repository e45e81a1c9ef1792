"""Sub-document items out of documents and grounding records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import text as T

from .dilution import _WS
from .flatten import BOXES_SQL, flat_boxes, standing
from .items import effective_modality

FOCUS_MODES = ("crop", "context_crop", "brb")


def source_label(grounded: Column, has_regions: Column, has_image: Column, has_box: Column, focus: str, whole_image: bool) -> Column:
    """Where a grounded record's item comes from. A null ``grounded`` counts as false."""
    yes, image = F.coalesce(grounded, F.lit(False)), has_image
    whole = image & F.lit(whole_image)
    return (
        F.when(yes & has_regions & image & has_box, F.lit(f"grounded_{focus}"))
        .when(yes & has_regions & image, F.lit("grounded_box_invalid"))
        .when(yes & whole, F.lit("grounded_no_region_wholeimg"))
        .when(yes, F.lit("grounded_degraded_text"))
        .when(whole, F.lit("ungrounded_wholeimg"))
        .otherwise(F.lit("ungrounded_text"))
    )


def build_items(documents: DataFrame, log: DataFrame, units: DataFrame, focus: str = "crop", ungrounded: str = "text", width: int = 1000, height: int = 1000) -> DataFrame:
    """(prop_id, corpus_id, prop_idx, text, modality, grounded, has_image, source).

    ``documents`` (corpus_id, text, has_image), each once; ``log``: grounding lines, of which the last of a
    proposition stands; ``units`` (key, units): cached propositions by text key, for documents without any line.
    A document without either becomes one item with prop_idx -1. Items without text and image are left out.
    """
    if focus not in FOCUS_MODES or ungrounded not in ("text", "wholeimage"):
        raise ValueError("unknown focus or ungrounded mode")
    docs = documents.select("corpus_id", "text", F.coalesce("has_image", F.lit(False)).alias("image"))
    lines = standing(log.select("line_no", "corpus_id", "prop_id", "prop_idx", "text", "grounded", "regions"))
    px = G.norm_to_pixels(G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), width, height)
    boxed = flat_boxes(log).where("box_idx >= 0").withColumn("px", px).where("px IS NOT NULL").select("prop_id").distinct().withColumn("box", F.lit(True))
    d = lines.join(docs.select("corpus_id", "image"), "corpus_id", "left").join(boxed, "prop_id", "left")
    image, box = F.coalesce("image", F.lit(False)), F.coalesce("box", F.lit(False))
    label = source_label(F.col("grounded"), F.coalesce(F.size("regions") > 0, F.lit(False)), image, box, focus, ungrounded == "wholeimage")
    with_image = F.col("source").isin(f"grounded_{focus}", "grounded_no_region_wholeimg", "ungrounded_wholeimg")
    grounded = d.withColumn("source", label).select("prop_id", "corpus_id", "prop_idx", "text", F.coalesce("grounded", F.lit(False)).alias("grounded"), with_image.alias("has_image"), "source")

    rest = docs.join(log.select("corpus_id").distinct(), "corpus_id", "left_anti").withColumn("key", T.text_key(F.lit("document"), F.col("text"))).join(units.select("key", "units"), "key", "left")
    none = F.lit(None).cast("boolean")
    cached = rest.where(F.size("units") > 0).select("corpus_id", F.posexplode("units").alias("prop_idx", "text"))
    cached = cached.select(F.concat("corpus_id", F.lit("_p"), "prop_idx").alias("prop_id"), "corpus_id", "prop_idx", "text", none.alias("grounded"), F.lit(False).alias("has_image"), F.lit("textdoc_prop").alias("source"))
    whole = rest.where(F.coalesce(F.size("units"), F.lit(0)) <= 0)
    whole = whole.select(F.concat("corpus_id", F.lit("_pwhole")).alias("prop_id"), "corpus_id", F.lit(-1).alias("prop_idx"), "text", none.alias("grounded"), F.col("image").alias("has_image"), F.lit("wholedoc_fallback").alias("source"))
    out = grounded.unionByName(cached).unionByName(whole).withColumn("modality", effective_modality(F.col("text"), F.col("has_image")))
    return out.where("modality IS NOT NULL").select("prop_id", "corpus_id", "prop_idx", "text", "modality", "grounded", "has_image", "source")


def _build(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/corpus.parquet").where("id IS NOT NULL")
    docs = c.groupBy(F.col("id").alias("corpus_id")).agg(F.min("text").alias("text"), F.max(F.col("image.bytes").isNotNull() | F.col("image.path").isNotNull()).alias("has_image"))
    units = docs.where("text IS NOT NULL").select(T.text_key(F.lit("document"), F.col("text")).alias("key"), T.sentences(F.col("text")).alias("units")).dropDuplicates(["key"])
    return build_items(docs, spark.read.parquet(f"{sf}/doc_propositions.parquet"), units)


QUERIES = {
    "q14_subdoc_items": _build,
    "q14_source_counts": lambda spark, sf: _build(spark, sf).groupBy("source").agg(F.count("*").alias("n")),
}
_PX = lambda f, a, b: f"round_even(greatest(0e0, least(1000e0, {f}({a}, {b}))), 0)::INT"
_ITEMS_SQL = rf"""WITH RECURSIVE {BOXES_SQL}, docs AS (
  SELECT id AS corpus_id, min(text) AS text, bool_or(image.bytes IS NOT NULL OR image.path IS NOT NULL) AS image FROM corpus WHERE id IS NOT NULL GROUP BY id
), corner AS (
  SELECT prop_id, {_PX('least', 'v[1]', 'v[3]')} AS x1, {_PX('greatest', 'v[1]', 'v[3]')} AS x2, {_PX('least', 'v[2]', 'v[4]')} AS y1, {_PX('greatest', 'v[2]', 'v[4]')} AS y2 FROM boxes
), boxed AS (SELECT DISTINCT prop_id FROM corner WHERE (x2 > x1 OR x1 < 1000) AND (y2 > y1 OR y1 < 1000)
), line AS (
  SELECT pid AS prop_id, s.corpus_id, s.prop_idx, s.text, coalesce(s.grounded, false) AS grounded, coalesce(len(s.regions) > 0, false) AS has_regions, coalesce(d.image, false) AS image, b.prop_id IS NOT NULL AS box
  FROM standing s LEFT JOIN docs d ON d.corpus_id = s.corpus_id LEFT JOIN boxed b ON b.prop_id = s.pid
), rest AS (
  SELECT corpus_id, text, image, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13), ''), '([.!?]){_WS}+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ' || chr(9) || '-#*>')), lambda s: length(s) >= 15) AS units
  FROM docs WHERE corpus_id NOT IN (SELECT corpus_id FROM doc_propositions WHERE corpus_id IS NOT NULL)
), items AS (
  SELECT prop_id, corpus_id, prop_idx, text, grounded, grounded AND has_regions AND image AND box AS has_image,
    CASE WHEN grounded AND has_regions AND image AND box THEN 'grounded_crop' WHEN grounded AND has_regions AND image THEN 'grounded_box_invalid' WHEN grounded THEN 'grounded_degraded_text' ELSE 'ungrounded_text' END AS source FROM line
  UNION ALL SELECT corpus_id || '_p' || (i - 1), corpus_id, (i - 1)::INT, units[i], NULL, false, 'textdoc_prop' FROM rest, LATERAL (SELECT unnest(range(1, len(units) + 1)) AS i)
  UNION ALL SELECT corpus_id || '_pwhole', corpus_id, -1, text, NULL, image, 'wholedoc_fallback' FROM rest WHERE coalesce(len(units), 0) = 0
), typed AS (SELECT *, regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') <> '' AS filled FROM items
), built AS (SELECT prop_id, corpus_id, prop_idx, text, CASE WHEN filled AND has_image THEN 'image,text' WHEN filled THEN 'text' WHEN has_image THEN 'image' END AS modality, grounded, has_image, source FROM typed WHERE filled OR has_image)"""
SQL = {
    "q14_subdoc_items": f"{_ITEMS_SQL} SELECT * FROM built",
    "q14_source_counts": f"{_ITEMS_SQL} SELECT source, count(*) AS n FROM built GROUP BY 1",
}
