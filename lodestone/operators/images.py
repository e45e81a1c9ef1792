"""Image columns (S11, S12, F19, F20, R7, R11, R12): choice and sizes as expressions; pixels behind an optional codec."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest sides of an item, of a model call and of a thumbnail; least blur radius.
ITEM_SIDE, CALL_SIDE, THUMB_SIDE, MIN_BLUR = 2000, 1280, 400, 6.0
#: Image columns of a multi-image row, in order.
IMAGE_COLUMNS = ("image", "image 1", "image 2", "image 3", "image 4", "vision")


def first_image(df: DataFrame) -> Column:
    """The first non-null image of a row; null if it has none. Columns that do not exist are passed over."""
    have = [F.col(f"`{c}`") for c in IMAGE_COLUMNS if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def all_images(df: DataFrame) -> Column:
    """Array of a row's images in fixed order, nulls left out."""
    return F.array_compact(F.array(*[F.col(f"`{c}`") for c in IMAGE_COLUMNS if c in df.columns]))


def resized(width: Column, height: Column, side: int = ITEM_SIDE, whole: str = "truncate") -> Column:
    """(width, height) after shrinking the longest side to ``side``; smaller images stay. At least one pixel."""
    longest = F.greatest(width, height)
    scale = F.lit(float(side)) / longest
    i = (lambda c: F.bround(c)) if whole == "round" else (lambda c: c)
    fit = lambda c: F.when(longest <= side, c).otherwise(F.greatest(i(c * scale).cast("int"), F.lit(1)))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def blur_radius(width: Column, height: Column, sigma: float, ratio: float = 0.0) -> Column:
    """Radius around a focus box: a share of the longest side if a ratio is given, else sigma; never below the least."""
    return F.greatest(F.lit(MIN_BLUR), F.greatest(width, height) * ratio if ratio > 0 else F.lit(float(sigma)))


def _decode(batches: Iterator[pa.RecordBatch], decode: Callable[[bytes], tuple[int, int, bytes] | None]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for raw in b.column(1).to_pylist():
            try:
                out.append(None if raw is None else decode(raw))
            except Exception:  # noqa: BLE001 - a broken image is a missing one
                out.append(None)
        get = lambda i: [None if x is None else x[i] for x in out]
        yield pa.record_batch([b.column(0), pa.array(get(0), pa.int32()), pa.array(get(1), pa.int32()), pa.array(get(2), pa.binary())], names=["id", "width", "height", "pixels"])


def decoded(images: DataFrame, decode: Callable[[bytes], tuple[int, int, bytes] | None]) -> DataFrame:
    """(id, width, height, pixels) of (id, bytes) by a codec; broken images come out null. Apply after filters and limits."""
    return images.select("id", "bytes").mapInArrow(partial(_decode, decode=decode), "id string, width int, height int, pixels binary")
