"""Deeply nested grounding records -> flat proposition, region and box tables (problem 3).

Arrow-buffer flattening: list offsets and parent indices give the child arrays, keys follow by one vectorised take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NUM = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_WS = r"[ \t\r\n]*"
#: Stands for a member that is neither a list nor a number; no JSON text can hold it.
_ELSE = "\x01"
_TOKEN = rf"^{_WS}(?:{_NUM}|{_ELSE}){_WS}$"
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_VALUE = rf"(?:{_ELSE}|{_NUM}|\[[\[\]0-9eE+.,\- \t\r\n{_ELSE}]*\])"
_PAIR = rf"{_WS}{_ELSE}{_WS}:{_WS}{_VALUE}{_WS}"
_OBJECT = rf"\{{(?:{_PAIR}(?:,{_PAIR})*|{_WS})\}}"
_OPEN, _CLOSE, _COMMA = (ord(c) for c in "[],")


def _lists_only(raw: pa.Array) -> pa.Array:
    """The texts with strings, objects and words replaced by a mark; null where other characters are left."""
    plain = r"^[\[\]0-9eE+.,\- \t\r\n]*$"
    odd = pc.invert(pc.fill_null(pc.match_substring_regex(raw, plain), True))
    if pc.any(odd).as_py():
        at = pa.array(np.flatnonzero(odd.to_numpy(zero_copy_only=False)))
        t = raw.take(at)
        t = pc.if_else(pc.match_substring(t, _ELSE), pa.scalar(None, t.type), t)
        t = pc.replace_substring_regex(pc.replace_substring_regex(t, _STRING, _ELSE), r"true|false|null|NaN|-?Infinity", _ELSE)
        while True:  # innermost objects first
            new = pc.replace_substring_regex(t, _OBJECT, _ELSE)
            if new.equals(t):
                break
            t = new
        t = pc.if_else(pc.match_substring_regex(t, rf"^[\[\]0-9eE+.,\- \t\r\n{_ELSE}]*$"), t, pa.scalar(None, t.type))
        raw = pc.replace_with_mask(raw, odd, t)
    return raw


def _stretches(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The byte stretches [lo, hi) as strings."""
    size = hi - lo
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = np.repeat(lo - off[:-1], size) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(c[flat].tobytes())])


def _scan(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts that are one JSON list; places of their brackets and commas; depth and text of each sign."""
    raw = raw.cast(pa.large_string())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    c = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    at = np.flatnonzero((c == _OPEN) | (c == _CLOSE) | (c == _COMMA))
    if not len(at):
        return c, at, at, at
    kind = c[at]
    text = np.searchsorted(off, at, "right") - 1
    first = np.concatenate([[True], text[1:] != text[:-1]])
    last = np.concatenate([first[1:], [True]])
    run = np.cumsum((kind == _OPEN).astype(np.int64) - (kind == _CLOSE))
    start = (run - (kind == _OPEN) + (kind == _CLOSE))[first]
    depth = run - np.repeat(start, np.diff(np.append(np.flatnonzero(first), len(at))))
    # between two signs lies white space, or a member where one is due
    after = np.where(last, off[text + 1], np.append(at[1:], 0))
    between = _stretches(c, at + 1, after)
    blank = pc.match_substring_regex(between, rf"^{_WS}$").to_numpy(zero_copy_only=False)
    token = pc.match_substring_regex(between, _TOKEN).to_numpy(zero_copy_only=False)
    nxt = np.append(kind[1:], 0)
    due = (kind != _CLOSE) & (nxt != _OPEN)
    good = np.where(due, token | (blank & (kind == _OPEN) & (nxt == _CLOSE)), blank)
    good &= (kind != _CLOSE) | (nxt != _OPEN) | last
    good &= np.where(last, (depth == 0) & (kind == _CLOSE) & blank, depth > 0)
    lead = pc.match_substring_regex(_stretches(c, off[text[first]], at[first]), rf"^{_WS}$").to_numpy(zero_copy_only=False)
    good[first] &= lead & (kind[first] == _OPEN)
    bad = np.zeros(len(raw), bool)
    bad[text[~good]] = True
    keep = ~bad[text]
    return c, at[keep], (depth + (kind == _CLOSE))[keep], text[keep]


def _parse(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of a column of raw ``bbox_norm`` texts: (count per text, all boxes one after another as rows of four).

    A list of exactly four members, not all of them lists, each a JSON number or a number wrapped in lists of one member,
    is a box; a non-empty list whose members are all lists is searched member by member, to any depth; anything else
    holds none, nor does a text that is no JSON.

    All texts are scanned at once in their Arrow buffer: depths are running sums over brackets, the members of a list lie
    between its commas, and what is searched follows by pointer doubling from each list to its parent. No text becomes
    an object, and depth costs only logarithmically.
    """
    n = len(raw)
    none = np.zeros(n, np.int64), np.zeros((0, 4))
    if not n:
        return none
    c, at, depth, text = _scan(_lists_only(raw))
    if not len(at):
        return none
    # sorted by depth, the signs of a list follow each other: opening, commas, closing
    order = np.argsort(depth, kind="stable")
    kind = c[at[order]]
    first, last = np.flatnonzero(kind == _OPEN), np.flatnonzero(kind == _CLOSE)
    by = np.argsort(at[order][first])
    first, last = first[by], last[by]
    begin, level, owner = at[order][first], depth[order][first], text[order][first]
    commas = last - first - 1
    # the parent is the latest list of one level less; lists are in the order of their openings
    key = level * (len(c) + 1) + begin
    rank = np.argsort(key, kind="stable")
    parent = np.arange(len(begin))
    inner = level > 1
    parent[inner] = rank[np.searchsorted(key[rank], key[inner] - (len(c) + 1)) - 1]
    lists = np.bincount(parent[inner], minlength=len(begin))
    short = np.flatnonzero((commas == 0) & (lists == 0))
    empty = np.zeros(len(begin), bool)
    empty[short] = pc.match_substring_regex(_stretches(c, begin[short] + 1, at[order][last[short]]), rf"^{_WS}$").to_numpy(zero_copy_only=False)
    members = np.where(empty, 0, commas + 1)
    only = (members > 0) & (lists == members)
    reached = np.where(inner, only[parent], True)
    up = parent
    while True:
        reached = reached & reached[up]
        further = up[up]
        if np.array_equal(further, up):
            break
        up = further
    cand = np.flatnonzero(reached & (members == 4) & (lists < 4))
    if not len(cand):
        return none
    signs = at[order][first[cand][:, None] + np.arange(5)]
    member = _stretches(c, signs[:, :-1].ravel() + 1, signs[:, 1:].ravel())
    number = pc.match_substring_regex(member, rf"^[\[ \t\r\n]*{_NUM}[\] \t\r\n]*$")
    value = pc.cast(pc.replace_substring_regex(pc.if_else(number, member, pa.scalar("0", pa.large_string())), r"[\[\] \t\r\n]", ""), pa.float64()).to_numpy(zero_copy_only=False)
    good = number.to_numpy(zero_copy_only=False).reshape(-1, 4).all(1)
    return np.bincount(owner[cand][good], minlength=n), value.reshape(-1, 4)[good]


def boxes_of(raw: str | None) -> list[tuple[float, float, float, float]]:
    """Boxes of one raw ``bbox_norm`` text in reading order."""
    return [tuple(b) for b in _parse(pa.array([raw], pa.string()))[1].tolist()]


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prop_id, regions) -> one row per region and box; box_idx -1 where a region has none."""
    for b in batches:
        lists = _column(b, "regions")
        parent = pc.list_parent_indices(lists)
        child = pc.list_flatten(lists)
        p = parent.to_numpy().astype(np.int64)
        first = np.searchsorted(p, p, side="left") if len(p) else p
        place = np.arange(len(p)) - first
        keep = np.flatnonzero(np.asarray(child.is_valid())) if len(child) else np.zeros(0, np.int64)
        child, p, place = child.take(pa.array(keep)), p[keep], place[keep]
        names = pc.struct_field(child, "key_visual_entity") if len(child) else pa.array([], pa.string())
        raw = pc.struct_field(child, "bbox_norm") if len(child) else pa.array([], pa.string())
        count, box = _parse(raw)
        reps = np.maximum(count, 1)
        who = np.repeat(np.arange(len(count)), reps)
        idx = np.arange(len(who)) - np.repeat(np.cumsum(reps) - reps, reps)
        none = np.repeat(count == 0, reps)
        at = np.where(none, 0, np.cumsum(~none) - 1)
        cols = [pa.array(box[at, i] if len(box) else np.zeros(len(who)), mask=none) for i in range(4)]
        take = pa.array(who)
        yield pa.record_batch(
            [_column(b, "prop_id").take(pa.array(p[who])), pa.array(place[who].astype(np.int32)), pa.array(np.where(none, -1, idx).astype(np.int32)), names.take(take), raw.take(take), *cols],
            names=["prop_id", "region_idx", "box_idx", "key_visual_entity", "bbox_norm", "x1", "y1", "x2", "y2"],
        )


def _rebuilt_id() -> F.Column:
    given = F.when(F.trim("prop_id") != "", F.col("prop_id"))
    return F.coalesce(given, F.concat(F.col("corpus_id"), F.lit("_p"), F.col("prop_idx").cast("string")))


def standing(log: DataFrame) -> DataFrame:
    """The line of each proposition with the highest line_no; a missing or blank prop_id is rebuilt.

    Repeated rows stand once. Rows from which no id can be rebuilt, or without line_no, are left out. The group limit
    keeps one row per proposition and map task before the shuffle, so a hot proposition costs no more than others.
    """
    w = Window.partitionBy("prop_id").orderBy(F.col("line_no").desc())
    return log.withColumn("prop_id", _rebuilt_id()).where(F.col("prop_id").isNotNull() & F.col("line_no").isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def flat_boxes(log: DataFrame) -> DataFrame:
    """Region and box rows of the standing lines: (prop_id, region_idx, box_idx, key_visual_entity, bbox_norm, x1..y2).

    Null and empty region lists and null elements give no row (null elements keep their place); a region without any
    box gives one row with box_idx -1 and null corners. Extra columns of the log are ignored. Empty in, empty out.
    """
    rows = standing(log.select("line_no", "corpus_id", "prop_id", "prop_idx", "regions")).select("prop_id", "regions")
    return rows.mapInArrow(_regions, "prop_id string, region_idx int, box_idx int, key_visual_entity string, bbox_norm string, x1 double, y1 double, x2 double, y2 double")


def flat_propositions(log: DataFrame) -> DataFrame:
    """One row per proposition: its standing line without the nested part."""
    return standing(log.select("line_no", "corpus_id", "prop_id", "prop_idx", "text", "grounded", "regions", "confidence", "reason", "error")).select(
        "prop_id", "corpus_id", "prop_idx", "text", "grounded", "confidence", "reason", "error", "line_no", F.coalesce(F.size(F.filter("regions", lambda r: r.isNotNull())), F.lit(0)).alias("n_regions")
    )


def flat_regions(log: DataFrame) -> DataFrame:
    """One row per region (parent prop_id, place region_idx)."""
    b = flat_boxes(log)
    return b.where(F.col("box_idx") <= 0).select("prop_id", "region_idx", "key_visual_entity", "bbox_norm", (F.col("box_idx") == 0).alias("has_box"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/doc_propositions.parquet")


_STANDING = """
WITH rebuilt AS (
  SELECT *, coalesce(CASE WHEN trim(prop_id) <> '' THEN prop_id END, corpus_id || '_p' || prop_idx) AS pid FROM doc_propositions
), standing AS (
  SELECT * FROM rebuilt WHERE pid IS NOT NULL AND line_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pid ORDER BY line_no DESC) = 1
), region AS (
  SELECT pid, (u.i - 1)::INT AS region_idx, regions[u.i] AS r FROM standing, LATERAL (SELECT unnest(range(1, len(regions) + 1)) AS i) u
  WHERE regions[u.i] IS NOT NULL
)
"""

QUERIES = {
    "p3_found": lambda spark, sf: flat_boxes(_log(spark, sf)).select("prop_id", "region_idx", "box_idx"),
    "p3_boxes": lambda spark, sf: flat_boxes(_log(spark, sf)).where("box_idx >= 0").select("prop_id", "region_idx", "box_idx", "x1", "y1", "x2", "y2"),
    "p3_regions": lambda spark, sf: flat_regions(_log(spark, sf)).select("prop_id", "region_idx", "key_visual_entity", "bbox_norm"),
    "p3_propositions": lambda spark, sf: flat_propositions(_log(spark, sf)).select("prop_id", "corpus_id", "prop_idx", "text", "grounded", "confidence", "line_no", F.col("n_regions").cast("bigint").alias("n_regions")),
}
#: Tables region (pid, region_idx, r), box (pid, region_idx, path, v: four numbers) and boxes (prop_id, region_idx, box_idx, v).
BOXES_SQL = (
    _STANDING.strip().removeprefix("WITH ")
    + r""", node AS (
  SELECT pid, region_idx, CASE WHEN json_valid(r.bbox_norm) THEN r.bbox_norm::JSON END AS j, []::BIGINT[] AS path FROM region
  UNION ALL
  SELECT pid, region_idx, json_extract(j, '$[*]')[i + 1], list_append(path, i) FROM node, LATERAL (SELECT unnest(range(json_array_length(j)::BIGINT)) AS i)
  WHERE json_type(j) = 'ARRAY' AND json_array_length(j) > 0 AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) <> 'ARRAY')) = 0
), box AS (
  SELECT pid, region_idx, path, list_transform(json_extract(j, '$[*]'), lambda x: regexp_replace(x::VARCHAR, '[\[\]\s]', '', 'g')) AS v FROM node
  WHERE json_type(j) = 'ARRAY' AND json_array_length(j) = 4 AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) <> 'ARRAY')) > 0
    AND len(list_filter(json_extract(j, '$[*]'), lambda x: NOT regexp_full_match(x::VARCHAR, '[\[\s]*-?\d+(\.\d+)?([eE][+-]?\d+)?[\]\s]*'))) = 0
), boxes AS (
  SELECT pid AS prop_id, region_idx, (row_number() OVER (PARTITION BY pid, region_idx ORDER BY path) - 1)::INT AS box_idx, v::DOUBLE[] AS v FROM box
)"""
)
SQL = {
    "p3_found": f"WITH RECURSIVE {BOXES_SQL} SELECT pid AS prop_id, r.region_idx, coalesce(box_idx, -1)::INT AS box_idx FROM region r LEFT JOIN boxes b ON b.prop_id = r.pid AND b.region_idx = r.region_idx",
    "p3_boxes": f"WITH RECURSIVE {BOXES_SQL} SELECT prop_id, region_idx, box_idx, v[1] AS x1, v[2] AS y1, v[3] AS x2, v[4] AS y2 FROM boxes",
    "p3_regions": _STANDING + "SELECT pid AS prop_id, region_idx, r.key_visual_entity AS key_visual_entity, r.bbox_norm AS bbox_norm FROM region",
    "p3_propositions": _STANDING + "SELECT pid AS prop_id, corpus_id, prop_idx, text, grounded, confidence, line_no, coalesce(len(list_filter(regions, lambda r: r IS NOT NULL)), 0)::BIGINT AS n_regions FROM standing",
}
