"""Box arithmetic as column expressions; boxes are four columns or a struct (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def clip_xywh(x: Column, y: Column, w: Column, h: Column, width: int, height: int, whole: str = "round") -> Column:
    """(x, y, w, h) -> corners inside the image; ``whole`` is "round" (half to even) or "truncate"."""
    i = (lambda c: F.bround(c).cast("int")) if whole == "round" else (lambda c: c.cast("int"))
    # limited before it is made whole: exponents give numbers beyond any int
    inside = lambda c, top: i(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), c)))
    return box(inside(x, width), inside(y, height), inside(x + w, width), inside(y + h, height))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0.0 where the boxes are disjoint or both are empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    inter = w * h
    return F.coalesce(F.try_divide(inter.cast("double"), (area(a) + area(b) - inter).cast("double")), F.lit(0.0))


def mask_iou(a: Column, b: Column) -> Column:
    """The same of two boolean masks of equal length."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: (x & y).cast("int")), F.lit(0), lambda s, v: s + v)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: (x | y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(both.cast("double"), any_.cast("double")), F.lit(0.0))


def norm_to_pixels(b: Column, width: int, height: int) -> Column:
    """Box on a 0-1000 scale -> pixel box: corners ordered, clipped, rounded half to even, at least one pixel; null if impossible."""

    def ends(lo: Column, hi: Column, size: int) -> tuple[Column, Column]:
        px = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(float(size)), v / 1000.0 * size))).cast("int")
        a, z = px(F.least(lo, hi)), px(F.greatest(lo, hi))
        return a, F.when(z <= a, F.least(F.lit(size), a + 1)).otherwise(z)

    x1, x2 = ends(b["x1"], b["x2"], width)
    y1, y2 = ends(b["y1"], b["y2"], height)
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def widened(b: Column, share: float, width: int, height: int) -> Column:
    """Context view: the box with int(side * share) more on each side, clipped."""
    dx, dy = ((b["x2"] - b["x1"]) * share).cast("int"), ((b["y2"] - b["y1"]) * share).cast("int")
    return box(F.greatest(F.lit(0), b["x1"] - dx), F.greatest(F.lit(0), b["y1"] - dy), F.least(F.lit(width), b["x2"] + dx), F.least(F.lit(height), b["y2"] + dy))


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of boxes; null for none."""
    side = lambda f, n: f(F.transform(boxes, lambda b: b[n]))
    return F.when(F.size(boxes) > 0, box(side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2")))


def quality(pred_iou: Column, stability: Column, area_: Column) -> Column:
    """Sorting score of a region: its two model scores and a small bonus for area."""
    return F.coalesce(pred_iou, F.lit(0.0)) + F.coalesce(stability, F.lit(0.0)) + F.log(F.greatest(area_, F.lit(0)) + 1.0) * 0.01
