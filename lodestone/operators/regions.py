"""Region post-processing (R1-R13, P17, P18, A8): filters, greedy suppression, views and best matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions.vector import rounded

from .aggregates import first_by
from .flatten import BOXES_SQL, flat_boxes
from .retrieval import RUN_SQL, run


@dataclass(frozen=True)
class RegionConfig:
    """Thresholds of the region filter."""

    min_width: int = 12
    min_height: int = 12
    min_box_area: int = 180
    min_mask_area: int = 120
    max_aspect_ratio: float = 10.0
    box_iou: float = 0.65
    max_regions: int = 30


#: Views of a region in order of precedence among equal scores.
VIEWS = ("masked", "box", "context")


def verdict(b: Column, mask_area: Column, c: RegionConfig = RegionConfig()) -> Column:
    """small, slender or null (kept)."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    small = (w < c.min_width) | (h < c.min_height) | (w * h < c.min_box_area) | (mask_area < c.min_mask_area)
    one = F.lit(1)
    slender = F.greatest(w / F.greatest(h, one), h / F.greatest(w, one)) > c.max_aspect_ratio
    return F.when(small, "small").when(slender, "slender")


def suppress(regions: Column, iou: float = 0.65, cap: int = 30) -> Column:
    """Greedy suppression over an array of structs (s, ordinal, x1, y1, x2, y2): (kept, duplicates).

    Best score first, earlier ordinal among equals; a region goes if it overlaps a kept one by ``iou`` or more; once
    ``cap`` are kept the rest is not looked at, nor counted. One image's regions make one array, folded in its row.
    """
    ordered = F.array_sort(regions, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0))
    start = F.struct(F.slice(regions, 1, 0).alias("kept"), F.lit(0).alias("duplicates"))

    def step(acc: Column, r: Column) -> Column:
        hit = F.exists(acc["kept"], lambda k: G.iou(k, r) >= iou)
        return (
            F.when(F.size(acc["kept"]) >= cap, acc)
            .when(hit, F.struct(acc["kept"].alias("kept"), (acc["duplicates"] + 1).alias("duplicates")))
            .otherwise(F.struct(F.concat(acc["kept"], F.array(r)).alias("kept"), acc["duplicates"].alias("duplicates")))
        )

    return F.aggregate(ordered, start, step)


def postprocess(annotations: DataFrame, config: RegionConfig = RegionConfig()) -> DataFrame:
    """(image, kept, removed_small, removed_slender, removed_duplicate) of annotations (image, ordinal, x1..y2, mask_area, s)."""
    b = G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    d = annotations.withColumn("v", verdict(b, F.col("mask_area"), config))
    region = F.struct("s", "ordinal", "x1", "y1", "x2", "y2")
    per = d.groupBy("image").agg(F.count_if(F.col("v") == "small").alias("removed_small"), F.count_if(F.col("v") == "slender").alias("removed_slender"), F.collect_list(F.when(F.col("v").isNull(), region)).alias("r"))
    out = per.withColumn("n", suppress(F.col("r"), config.box_iou, config.max_regions))
    return out.select("image", "n.kept", "removed_small", "removed_slender", F.col("n.duplicates").alias("removed_duplicate"))


def views(regions: DataFrame, width: int, height: int, share: float = 0.25) -> DataFrame:
    """Rows (.., view, x1..y2, masked) of regions (.., x1..y2): the box with all outside the mask blanked, the box, its context."""
    b = G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    wide = G.widened(b, share, width, height)
    each = F.array(*[F.struct(F.lit(v).alias("view"), (wide if v == "context" else b).alias("b"), F.lit(v == "masked").alias("masked")) for v in VIEWS])
    keep = [c for c in regions.columns if c not in ("x1", "y1", "x2", "y2")]
    return regions.select(*keep, F.explode(each).alias("v")).select(*keep, "v.view", "v.b.*", "v.masked")


def focus_view(mode: str, b: Column, width: int, height: int, margin: float = 0.25) -> Column:
    """What of an image is shown for a focus box: the crop, the crop with its context, or all with the rest blurred."""
    whole = G.box(F.lit(0), F.lit(0), F.lit(width), F.lit(height))
    shown = {"crop": b, "context_crop": G.widened(b, margin, width, height), "brb": whole}[mode]
    return F.struct(shown.alias("shown"), F.when(F.lit(mode == "brb"), b).alias("sharp"))


def distinct_boxes(boxes: DataFrame, group: str, order: str) -> DataFrame:
    """First of every identical box of a group."""
    return first_by(boxes, [group, "x1", "y1", "x2", "y2"], [F.col(order)])


def best_match(scores: DataFrame, keys: list[str], views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Best row of each key from (.., region_id, view, text_idx, score): score, then view order, text, region."""
    place = F.array_position(F.array(*[F.lit(v) for v in views]), F.col("view"))
    return first_by(scores, keys, [F.col("score").desc(), place.asc(), F.col("text_idx").asc(), F.col("region_id").asc()])


# ---------------------------------------------------------------- catalogue: the boxes of the grounding log
W, H = 640, 480


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """(prop_id, region_idx, box_idx, x1..y2): every box of every standing line."""
    return flat_boxes(spark.read.parquet(f"{sf}/doc_propositions.parquet")).where("box_idx >= 0").select("prop_id", "region_idx", "box_idx", "x1", "y1", "x2", "y2")


def _clipped(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).withColumn("b", G.clip_xywh(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 800, 600)).select("prop_id", "region_idx", "box_idx", "b.*")


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    b = _boxes(spark, sf).withColumn("b", G.norm_to_pixels(G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), W, H))
    return b.where("b IS NOT NULL").select("prop_id", "region_idx", "box_idx", "b.x1", "b.y1", "b.x2", "b.y2")


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as annotations of their proposition; the ordinal is the pair of places, in whose order boxes stand."""
    a = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    place = F.struct("region_idx", "box_idx")
    return _pixels(spark, sf).select(F.col("prop_id").alias("image"), place.alias("ordinal"), "x1", "y1", "x2", "y2", a.alias("mask_area"), G.quality(F.lit(0.5), F.lit(0.25), a).alias("s"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of every two boxes of a proposition, the one that stands first on the left."""
    p = _pixels(spark, sf).select("prop_id", F.struct("region_idx", "box_idx").alias("at"), G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("b"))
    pairs = p.join(p.select("prop_id", F.col("at").alias("at2"), F.col("b").alias("b2")), "prop_id").where(F.col("at") < F.col("at2"))
    return pairs.select("prop_id", "at.*", F.col("at2.region_idx").alias("other_region_idx"), F.col("at2.box_idx").alias("other_box_idx"), rounded(G.iou(F.col("b"), F.col("b2"))).alias("iou"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _annotations(spark, sf).select(F.col("image").alias("prop_id"), "ordinal.*", rounded(F.col("s")).alias("s"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return postprocess(_annotations(spark, sf)).select("image", F.size("kept").cast("bigint").alias("kept"), "removed_small", "removed_slender", F.col("removed_duplicate").cast("bigint").alias("removed_duplicate"))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return postprocess(_annotations(spark, sf)).select("image", F.explode("kept").alias("k")).select("image", "k.ordinal.*")


def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    places = _pixels(spark, sf).withColumn("at", F.struct("region_idx", "box_idx"))
    return distinct_boxes(places, "prop_id", "at").select("prop_id", "at.*")


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _annotations(spark, sf).withColumn("v", verdict(G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), F.col("mask_area"))).groupBy("v").agg(F.count("*").alias("n"))


def _focus(spark: SparkSession, sf: str) -> DataFrame:
    p = _pixels(spark, sf).groupBy("prop_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    b = G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), focus_view(m, b, W, H).alias("f")) for m in ("crop", "context_crop", "brb")])
    return p.select("prop_id", F.explode(modes).alias("m")).select("prop_id", "m.mode", "m.f.shown.*", F.col("m.f.sharp.x1").alias("sharp_x1"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    s = run(spark, sf).select(F.col("qid").alias("item"), F.col("did").alias("region_id"), F.element_at(F.array(*[F.lit(v) for v in VIEWS]), (F.col("rank") % 3 + 1)).alias("view"), (F.col("rank") % 4).alias("text_idx"), F.floor(F.col("score") * 4).alias("score"))
    return best_match(s, ["item"]).select("item", "region_id", "view", "text_idx", "score")


def _union(spark: SparkSession, sf: str) -> DataFrame:
    p = _pixels(spark, sf).groupBy("prop_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    w = G.widened(G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), 0.25, W, H)
    return p.withColumn("w", w).select("prop_id", "x1", "y1", "x2", "y2", F.col("w.x1").alias("wx1"), F.col("w.y1").alias("wy1"), F.col("w.x2").alias("wx2"), F.col("w.y2").alias("wy2"))


_P = lambda c, lo_hi, size: f"round_even(greatest(0e0, least({size}::DOUBLE, {lo_hi}({c}1, {c}2) / 1000.0e0 * {size})), 0)::INT"
BOX_SQL = f"""{BOXES_SQL}, b0 AS (SELECT prop_id, region_idx, box_idx, v[1] AS x1, v[2] AS y1, v[3] AS x2, v[4] AS y2 FROM boxes
), b1 AS (SELECT prop_id, region_idx, box_idx, {_P("x", "least", W)} AS a, {_P("x", "greatest", W)} AS c, {_P("y", "least", H)} AS b, {_P("y", "greatest", H)} AS d FROM b0
), px AS (SELECT * FROM (SELECT prop_id, region_idx, box_idx, a AS x1, b AS y1, CASE WHEN c <= a THEN least({W}, a + 1) ELSE c END AS x2, CASE WHEN d <= b THEN least({H}, b + 1) ELSE d END AS y2 FROM b1) WHERE x2 > x1 AND y2 > y1
), ann AS (SELECT *, (x2 - x1) * (y2 - y1) AS ar, greatest((x2 - x1) * 1e0 / greatest(y2 - y1, 1), (y2 - y1) * 1e0 / greatest(x2 - x1, 1)) AS aspect FROM px
), vd AS (SELECT *, CASE WHEN x2 - x1 < 12 OR y2 - y1 < 12 OR ar < 180 THEN 'small' WHEN aspect > 10 THEN 'slender' END AS v, 0.5e0 + 0.25e0 + ln(ar + 1e0) * 0.01e0 AS s FROM ann)"""
_IOU = "coalesce(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0) * 1.0e0 / nullif(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0), 0), 0e0)"
_NMS_SQL = (
    BOX_SQL
    + f""", lists AS (
  SELECT prop_id, list({{'s': s, 'ordinal': {{'region_idx': region_idx, 'box_idx': box_idx}}, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY s DESC, region_idx, box_idx) FILTER (v IS NULL) AS r, (count(*) FILTER (v = 'small'))::BIGINT AS removed_small, (count(*) FILTER (v = 'slender'))::BIGINT AS removed_slender FROM vd GROUP BY prop_id
), kept AS (
  SELECT prop_id, removed_small, removed_slender, len(coalesce(r, [])) AS n, CASE WHEN r IS NULL THEN [] ELSE list_reduce(list_prepend(r[1:0], list_transform(r, lambda e: [e])), lambda acc, e: CASE WHEN len(acc) >= 30 OR len(list_filter(acc, lambda k: {_IOU.format(a="k", b="e[1]")} >= 0.65)) > 0 THEN acc ELSE list_concat(acc, e) END) END AS k FROM lists
)"""
)

QUERIES = {
    "r1_clip_box": _clipped,
    "r2_box_iou": _pairs,
    "r4_quality": _scores,
    "r5_postprocess": _counts,
    "r3_greedy_nms": _kept,
    "r6_dedup_boxes": _dedup,
    "r8_norm_to_px": _pixels,
    "r10_union_box": _union,
    "r7_views": lambda spark, sf: views(_pixels(spark, sf), W, H),
    "r12_focus": _focus,
    "r13_best_match": _matches,
    "r17_region_filter": _filtered,
}
SQL = {
    "r1_clip_box": f"WITH RECURSIVE {BOX_SQL} SELECT prop_id, region_idx, box_idx, greatest(0, least(800, round_even(x1, 0)::INT)) AS x1, greatest(0, least(600, round_even(y1, 0)::INT)) AS y1, greatest(0, least(800, round_even(x1 + x2, 0)::INT)) AS x2, greatest(0, least(600, round_even(y1 + y2, 0)::INT)) AS y2 FROM b0",
    "r2_box_iou": f"WITH RECURSIVE {BOX_SQL} SELECT p.prop_id, p.region_idx, p.box_idx, n.region_idx AS other_region_idx, n.box_idx AS other_box_idx, floor({_IOU.format(a='p', b='n')} * 1.0e5 + 0.5e0) / 1.0e5 AS iou FROM px p JOIN px n ON n.prop_id = p.prop_id AND (p.region_idx < n.region_idx OR (p.region_idx = n.region_idx AND p.box_idx < n.box_idx))",
    "r4_quality": f"WITH RECURSIVE {BOX_SQL} SELECT prop_id, region_idx, box_idx, floor(s * 1.0e5 + 0.5e0) / 1.0e5 AS s FROM vd",
    "r5_postprocess": f"WITH RECURSIVE {_NMS_SQL} SELECT prop_id AS image, len(k) AS kept, removed_small, removed_slender, (CASE WHEN len(k) < 30 THEN n - len(k) ELSE 0 END)::BIGINT AS removed_duplicate FROM kept",
    "r3_greedy_nms": f"WITH RECURSIVE {_NMS_SQL} SELECT image, o.region_idx AS region_idx, o.box_idx AS box_idx FROM (SELECT prop_id AS image, unnest(k).ordinal AS o FROM kept)",
    "r6_dedup_boxes": f"WITH RECURSIVE {BOX_SQL} SELECT prop_id, place.region_idx AS region_idx, place.box_idx AS box_idx FROM (SELECT prop_id, min({{'region_idx': region_idx, 'box_idx': box_idx}}) AS place FROM px GROUP BY prop_id, x1, y1, x2, y2)",
    "r8_norm_to_px": f"WITH RECURSIVE {BOX_SQL} SELECT prop_id, region_idx, box_idx, x1, y1, x2, y2 FROM px",
    "r10_union_box": f"""WITH RECURSIVE {BOX_SQL}, u AS (SELECT prop_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM px GROUP BY 1), d AS (SELECT *, trunc((x2 - x1) * 0.25e0)::INT AS dx, trunc((y2 - y1) * 0.25e0)::INT AS dy FROM u)
SELECT prop_id, x1, y1, x2, y2, greatest(0, x1 - dx) AS wx1, greatest(0, y1 - dy) AS wy1, least({W}, x2 + dx) AS wx2, least({H}, y2 + dy) AS wy2 FROM d""",
    "r7_views": f"""WITH RECURSIVE {BOX_SQL}, d AS (SELECT *, trunc((x2 - x1) * 0.25e0)::INT AS dx, trunc((y2 - y1) * 0.25e0)::INT AS dy FROM px)
SELECT prop_id, region_idx, box_idx, 'masked' AS view, x1, y1, x2, y2, true AS masked FROM px UNION ALL SELECT prop_id, region_idx, box_idx, 'box', x1, y1, x2, y2, false FROM px
UNION ALL SELECT prop_id, region_idx, box_idx, 'context', greatest(0, x1 - dx), greatest(0, y1 - dy), least({W}, x2 + dx), least({H}, y2 + dy), false FROM d""",
    "r12_focus": f"""WITH RECURSIVE {BOX_SQL}, u AS (SELECT prop_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM px GROUP BY 1), d AS (SELECT *, trunc((x2 - x1) * 0.25e0)::INT AS dx, trunc((y2 - y1) * 0.25e0)::INT AS dy FROM u)
SELECT prop_id, 'crop' AS mode, x1, y1, x2, y2, NULL::INT AS sharp_x1 FROM u UNION ALL SELECT prop_id, 'brb', 0, 0, {W}, {H}, x1 FROM u
UNION ALL SELECT prop_id, 'context_crop', greatest(0, x1 - dx), greatest(0, y1 - dy), least({W}, x2 + dx), least({H}, y2 + dy), NULL FROM d""",
    "r13_best_match": f"""WITH {RUN_SQL}, s AS (SELECT qid AS item, did AS region_id, (['masked', 'box', 'context'])[rank % 3 + 1] AS view, rank % 3 AS vo, (rank % 4)::INT AS text_idx, floor(score * 4)::BIGINT AS score FROM run)
SELECT item, region_id, view, text_idx, score FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, vo, text_idx, region_id) = 1""",
    "r17_region_filter": f"WITH RECURSIVE {BOX_SQL} SELECT v, count(*) AS n FROM vd GROUP BY 1",
}
