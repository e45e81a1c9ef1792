"""Cutting oversized texts at natural boundaries, with overlap, by pointer doubling.

Every boundary of a text points at its farthest legal successor. Squaring the successor table answers "which boundaries
does the greedy cutter visit" for all boundaries of a batch of texts at once, in a logarithmic number of steps, instead
of walking the pieces one by one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in windows of so many characters, which bounds memory however long one is.
WINDOW = 1 << 20

#: Strength of a cut after these characters. 4 paragraph, 3 line, 2 sentence, 1 space or clause.
_SENTENCE_END = ".!?。！？।؟…"
_CLOSERS = "\"'”’»)]」』）】》"
_CLAUSE = ",;:，、；：،؛"


def _table(chars: str) -> np.ndarray:
    return np.array(sorted(map(ord, chars)), np.uint32)


def cut_strengths(codes: np.ndarray) -> np.ndarray:
    """Strength of a cut before each position 0..n of one text: 0 inside a word, up to 4 at a paragraph."""
    n = len(codes)
    s = np.zeros(n + 1, np.int8)
    if not n:
        return s
    space = np.isin(codes, _table(" \t\n\r\x0b\x0c\x85\xa0                　"))
    line = np.isin(codes, _table("\n\r\x0b\x0c\x85  "))
    end, close = np.isin(codes, _table(_SENTENCE_END)), np.isin(codes, _table(_CLOSERS))
    wide = np.isin(codes, _table("。！？।؟"))
    starts = np.ones(n, bool)  # a position where something other than white space follows
    starts[:] = ~space
    s[1:n][space[:-1] & starts[1:]] = 1
    s[1:n][np.isin(codes, _table(_CLAUSE))[:-1] & (codes[:-1] > 0x2FF) & starts[1:]] = 1
    # the last mark before a run of closers and white space decides
    kind = np.zeros(n, np.int8)  # 1 sentence end, 2 line break, 3 two line breaks
    idx = np.arange(n, dtype=np.int32)
    plain = ~(space | end | close)
    run = np.maximum.accumulate(np.where(plain, idx, np.int32(-1)))
    last_end = np.maximum.accumulate(np.where(end, idx, np.int32(-1)))
    last_wide = np.maximum.accumulate(np.where(wide, idx, np.int32(-1)))
    last_space = np.maximum.accumulate(np.where(space, idx, np.int32(-1)))
    breaks = np.cumsum(line & ~((codes == 10) & np.concatenate([[False], codes[:-1] == 13])))
    run_breaks = breaks - np.where(run >= 0, breaks[run], 0)
    kind[(last_end > run) & ((last_space > last_end) | (last_wide == last_end))] = 1
    kind[run_breaks == 1], kind[run_breaks > 1] = 2, 3
    after = kind[:-1] > 0
    s[1:n] = np.where(after & starts[1:] & ~close[1:] & ~end[1:], np.maximum(s[1:n], kind[:-1] + 1), s[1:n])
    return s


@lru_cache(1)
def _extending() -> np.ndarray:
    """Characters below 0x20000 that never begin a grapheme: marks, joiners, selectors, modifiers, Hangul vowels and finals."""
    table = np.zeros(0x20000, bool)
    table[[i for i in range(0x300, 0x20000) if unicodedata.category(chr(i))[0] == "M"]] = True
    table[0x200C:0x200E] = table[0x1160:0x1200] = table[0x1F3FB:0x1F400] = True
    return table


def whole_graphemes(codes: np.ndarray) -> np.ndarray:
    """Whether a cut before each position 0..n keeps graphemes whole."""
    safe = np.ones(len(codes) + 1, bool)
    if len(codes) > 1:
        here, left = codes[1:], codes[:-1]
        extends = _extending()[np.minimum(here, 0x1FFFF)] & (here < 0x20000) | (here >= 0xE0100) & (here < 0xE01F0)
        flag = (codes >= 0x1F1E6) & (codes < 0x1F200)
        safe[1:-1] = ~(extends | (left == 0x200D) | (left == 13) & (here == 10) | flag[1:] & flag[:-1])
    return safe


def _visited(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Nodes reachable from the roots along ``successor`` (terminal nodes point at themselves), by squaring."""
    seen = np.zeros(len(successor), bool)
    seen[roots] = True
    jump = successor
    while True:
        seen[jump[seen]] = True
        nxt = jump[jump]
        if np.array_equal(nxt, jump):
            return seen
        jump = nxt


def pieces(texts: list[str], limit: int, overlap: int, anywhere: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text place, start, end) of the pieces of texts longer than ``limit``, in order.

    A piece [start, end) has at most ``limit`` characters and the next one starts ``overlap`` characters before its
    end, so consecutive pieces share exactly that many. It ends at the strongest boundary in its last two fifths,
    latest among equals, else wherever the limit falls; with ``anywhere`` at the latest boundary before those two fifths,
    and wherever the limit falls only where a piece has no boundary at all that lets the next one advance; there too
    between graphemes, unless a single one is as long as a piece. Nodes are positions of cuts; the successor of a cut is the
    cut that the piece starting ``overlap`` before it ends at.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be non-negative and below half the limit")
    out = [(np.zeros(0, np.int64),) * 3]
    for place, t in enumerate(texts):
        if len(t) <= limit:
            continue
        begins, ends, at = [], [], 0
        window = max(WINDOW, 8 * limit)
        while True:
            b, e = _window(t[at : at + window], limit, overlap, anywhere)
            last = at + window >= len(t)
            keep = len(b) if last else len(b) - 1  # the window's last piece is cut again with what follows
            begins.append(b[:keep] + at)
            ends.append(e[:keep] + at)
            if last:
                break
            at += int(b[keep])
        begins, ends = np.concatenate(begins), np.concatenate(ends)
        out.append((np.full(len(ends), place), begins, ends))
    return tuple(np.concatenate(x) for x in zip(*out))


def _window(text: str, limit: int, overlap: int, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the greedy pieces of one stretch; nodes are all its positions."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    if n <= limit:
        return np.zeros(1, np.int64), np.array([n])
    safe = whole_graphemes(c)
    strength = np.where(safe, cut_strengths(c), 0)
    node = np.arange(n + 1, dtype=np.int32)
    # successor of a cut: where the piece that starts ``overlap`` before it ends
    start = np.maximum(node - overlap, 0)
    last = np.minimum(start + limit, n)
    least = np.maximum(node, start + overlap) + 1
    first = np.minimum(np.maximum(start + limit - 2 * limit // 5, least), last)
    successor = _strongest(strength, first, last)
    if anywhere:
        latest = np.maximum.accumulate(np.where(strength > 0, np.arange(n + 1, dtype=np.int32), np.int32(-1)))[last]
        successor = np.where((strength[successor] == 0) & (latest >= least), latest, successor)
    # inside a word: the last place that keeps graphemes whole, unless one grapheme is as long as a piece
    whole = np.maximum.accumulate(np.where(safe, node, np.int32(-1)))[successor]
    successor = np.where((strength[successor] == 0) & (whole >= least), whole, successor)
    successor[last == n] = n
    ends = np.flatnonzero(_visited(successor, np.array([0])))
    ends = ends[ends > 0]
    return np.concatenate([[0], ends[:-1] - overlap]), ends


def _strongest(strength: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each window [first, last] the place of its strongest cut, latest among equals; ``last`` where none is."""
    n = len(strength)
    out = last.copy()
    undecided = np.ones(len(first), bool)
    for level in (4, 3, 2, 1):
        at = np.maximum.accumulate(np.where(strength >= level, np.arange(n, dtype=np.int32), np.int32(-1)))[last]
        hit = undecided & (at >= first)
        out[hit] = at[hit]
        undecided &= ~hit
    return out


def _cut(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, step: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, step):
            keys, texts = b.column(0).slice(lo, step), b.column(1).slice(lo, step).to_pylist()
            who, begin, end = pieces(texts, limit, overlap, anywhere=True)
            no = np.arange(len(who)) - np.searchsorted(who, who)
            cut = [texts[w][s:e] for w, s, e in zip(who.tolist(), begin.tolist(), end.tolist())]
            yield pa.record_batch([keys.take(pa.array(who)), pa.array(no.astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(cut, pa.string())], names=["item_key", "piece_no", "start_pos", "end_pos", "piece"])


def split_oversized(items: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """Pieces (item_key, piece_no, start_pos, end_pos, piece) of every text of more than ``limit`` characters.

    Characters are Unicode code points, white space included; end_pos is exclusive. Dropping the first ``overlap``
    characters of every piece but the first and joining the rest gives the text back. Null keys, null texts and texts
    within the limit give nothing; repeated (key, text) rows count once. Texts are read whole. Extra columns are
    ignored; an empty table gives no rows.
    """
    long = items.select(F.col(key).cast("string").alias("item_key"), F.col(text).alias("text")).where(F.col("item_key").isNotNull() & (F.length("text") > limit)).distinct()
    return long.mapInArrow(partial(_cut, limit=limit, overlap=overlap), "item_key string, piece_no int, start_pos int, end_pos int, piece string")


def _both(spark: SparkSession, sf: str) -> DataFrame:
    corpus = split_oversized(spark.read.parquet(f"{sf}/corpus.parquet"), "id", "text", 2000, 100)
    props = spark.read.parquet(f"{sf}/doc_propositions.parquet").select("corpus_id", "prop_id", "prop_idx", "text")
    given = F.when(F.trim("prop_id") != "", F.col("prop_id"))
    props = props.withColumn("key", F.coalesce(given, F.concat("corpus_id", F.lit("_p"), F.col("prop_idx").cast("string"))))
    cut = split_oversized(props, "key", "text", 300, 30)
    return corpus.withColumn("tbl", F.lit("corpus")).unionByName(cut.withColumn("tbl", F.lit("doc_propositions")))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """p5_found: the items that had to be cut, each once, read off their pieces."""
    return _both(spark, sf).select("tbl", "item_key").distinct()


_ITEMS = """
SELECT DISTINCT 'corpus' AS tbl, id AS item_key FROM corpus WHERE length(text) > 2000
UNION ALL
SELECT DISTINCT 'doc_propositions', coalesce(CASE WHEN trim(prop_id) <> '' THEN prop_id END, corpus_id || '_p' || prop_idx) FROM doc_propositions WHERE length(text) > 300
"""

QUERIES = {
    "p5_found": found,
    "p5_pieces": lambda spark, sf: _both(spark, sf).select("tbl", "item_key", "piece_no", "start_pos", "end_pos", "piece"),
}
SQL = {"p5_found": _ITEMS}
