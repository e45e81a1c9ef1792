"""Encoders behind one interface (E1-E6, X1-X5): items in, vectors out, in Arrow batches.

Models are plugged in as objects with ``load()`` and ``encode(texts, images)``. The built-in one hashes words, needs
no model and has an exact SQL twin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"[\p{L}\p{N}]+")


class Encoder(Protocol):
    dim: int

    def load(self) -> None:
        """Prepare once for each worker process."""

    def encode(self, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
        """(n, dim) vectors of a batch; raises MemoryError where the batch is too large."""


@lru_cache(1 << 16)
def _slot(word: str, dim: int) -> tuple[int, int]:
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:8], 16) % dim, 1 if int(h[8], 16) % 2 else -1


class HashEncoder:
    """Signed feature hashing of lower-case words; whole-number vectors, compare by cosine. Images are ignored."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def load(self) -> None:
        pass

    def encode(self, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                slot, sign = _slot(w, self.dim)
                out[i, slot] += sign
        return out


def backing_off(encoder: Encoder, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
    """Encode, halving a batch that does not fit; a single item that does not fit goes without its image."""
    try:
        return encoder.encode(texts, images)
    except MemoryError:
        if len(texts) > 1:
            m = len(texts) // 2
            return np.concatenate([backing_off(encoder, texts[:m], images[:m]), backing_off(encoder, texts[m:], images[m:])])
        if images[0] is None:
            raise
        return encoder.encode(texts, [None])


class DualEncoder:
    """One encoder for texts and one for images, each with batches of its own; an item with both takes the mean of unit vectors."""

    def __init__(self, text: Encoder, image: Encoder, text_batch: int = 8, image_batch: int = 4) -> None:
        if text.dim != image.dim:
            raise ValueError("encoders of different sizes")
        self.dim, self.text, self.image, self.text_batch, self.image_batch = text.dim, text, image, text_batch, image_batch

    def load(self) -> None:
        self.text.load()
        self.image.load()

    def encode(self, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for of, size, has in ((self.text, self.text_batch, [t is not None for t in texts]), (self.image, self.image_batch, [i is not None for i in images])):
            at = np.flatnonzero(has)
            for lo in range(0, len(at), size):
                mine = at[lo : lo + size]
                one = of is self.text
                v = backing_off(of, [texts[i] if one else None for i in mine], [None if one else images[i] for i in mine])
                out[mine] += v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return out


def kind(text: Column, image: Column) -> Column:
    """How an item is encoded: fused, image, text or none."""
    return F.when(text.isNotNull() & image.isNotNull(), "fused").when(image.isNotNull(), "image").when(text.isNotNull(), "text").otherwise("none")


def _runs(texts: list[str | None], images: list[bytes | None], size: int) -> Iterator[list[int]]:
    """Places of the items of one model call: of one kind, at most ``size``, in their order within a kind."""
    of: dict[tuple[bool, bool], list[int]] = {}
    for i, (t, m) in enumerate(zip(texts, images)):
        of.setdefault((t is not None, m is not None), []).append(i)
    for _, at in sorted(of.items()):
        yield from (at[i : i + size] for i in range(0, len(at), size))


def _run(batches: Iterator[pa.RecordBatch], encoder: Encoder, instruction: str, batch_size: int) -> Iterator[pa.RecordBatch]:
    ready = False
    for b in batches:
        if not ready:
            encoder.load()
            ready = True
        texts, images = b.column(1).to_pylist(), b.column(2).to_pylist()
        # an image alone takes no instruction
        texts = [instruction + t if t is not None and instruction else t for t in texts]
        v = np.zeros((len(texts), encoder.dim))
        for at in _runs(texts, images, batch_size):
            v[at] = backing_off(encoder, [texts[i] for i in at], [images[i] for i in at])
        off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * encoder.dim)
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(off, pa.array(v.ravel()))], names=["id", "embedding"])
    if ready and hasattr(encoder, "unload"):
        encoder.unload()


def _states(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model.load()
    for b in batches:
        rows = [(i, layer, place, v) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for layer, states in model.states(text).items() for place, v in enumerate(states)]
        cols = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["id", "layer", "place", "state"])


def hidden_states(items: DataFrame, model) -> DataFrame:
    """(id, layer, place, state) of items (id, text): what a model with ``load`` and ``states(text) -> {layer: vectors}`` captures."""
    return items.where("text IS NOT NULL").select("id", "text").mapInArrow(partial(_states, model=model), "id string, layer int, place int, state array<double>")


def encode(self, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
        """(n, dim) vectors of a batch; raises MemoryError where the batch is too large."""


@lru_cache(1 << 16)
def _slot(word: str, dim: int) -> tuple[int, int]:
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:8], 16) % dim, 1 if int(h[8], 16) % 2 else -1


class HashEncoder:
    """Signed feature hashing of lower-case words; whole-number vectors, compare by cosine. Images are ignored."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def load(self) -> None:
        pass

    def encode(self, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                slot, sign = _slot(w, self.dim)
                out[i, slot] += sign
        return out


def backing_off(encoder: Encoder, texts: list[str | None], images: list[bytes | None]) -> np.ndarray:
    """Encode, halving a batch that does not fit; a single item that does not fit goes without its image."""
    try:
        return encoder.encode(texts, images)
    except MemoryError:
        if len(texts) > 1:
            m = len(texts) // 2
            return np.concatenate([backing_off(encoder, texts[:m], images[:m]), backing_off(encoder, texts[m:], images[m:])])
        if images[0] is None:
            raise
        return encoder.encode(texts, [None])


def _run(batches: Iterator[pa.RecordBatch], encoder: Encoder, instruction: str, batch_size: int) -> Iterator[pa.RecordBatch]:
    ready = False
    for b in batches:
        if not ready:
            encoder.load()
            ready = True
        texts, images = b.column(1).to_pylist(), b.column(2).to_pylist()
        # an image alone takes no instruction
        texts = [instruction + t if t is not None and instruction else t for t in texts]
        parts = [backing_off(encoder, texts[i : i + batch_size], images[i : i + batch_size]) for i in range(0, len(texts), batch_size)]
        v = np.concatenate(parts) if parts else np.zeros((0, encoder.dim))
        off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * encoder.dim)
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(off, pa.array(v.ravel()))], names=["id", "embedding"])


def encode(items: DataFrame, encoder: Encoder, instruction: str = "", batch_size: int = 256) -> DataFrame:
    """(id, embedding) for items (id, text, image); the encoder is loaded once in each task, order is kept.

    A call of the encoder has items of one kind (text and image, image, text), at most ``batch_size``. An encoder with
    ``unload`` is unloaded at the end of its task.
    """
    return items.select("id", "text", "image").mapInArrow(partial(_run, encoder=encoder, instruction=instruction, batch_size=batch_size), "id string, embedding array<double>")


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus rows by the way they would be encoded."""
    c = spark.read.parquet(f"{sf}/corpus.parquet").where("id IS NOT NULL")
    return c.groupBy(kind(F.col("text"), F.coalesce(F.col("image.bytes"), F.col("image.path").cast("binary"))).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {"e3_kinds": _kinds}
SQL = {"e3_kinds": "SELECT CASE WHEN text IS NOT NULL AND i THEN 'fused' WHEN i THEN 'image' WHEN text IS NOT NULL THEN 'text' ELSE 'none' END AS kind, count(*) AS n FROM (SELECT text, image.bytes IS NOT NULL OR image.path IS NOT NULL AS i FROM corpus WHERE id IS NOT NULL) GROUP BY 1"}
