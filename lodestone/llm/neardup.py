"""Near-duplicate texts by Golay-code fuzzy hashing.

A text's fingerprint is a row of segments. A segment has 23 one-bit minhashes, decoded with the perfect (23, 12, 7)
Golay code, and two full minhashes that anchor it. A 23-bit word yields the index of its own codeword and of every
codeword its 23 one-bit neighbours decode to: one key where it lies within two bits of a codeword, six where it lies at
three. Two words at most two bits apart always share an index. A key is an index together with the anchors of its
segment, so two texts meet in a segment if the anchors agree and its bits have few errors; by pigeonhole the errors of
similar texts cannot be many in all segments. Pairs that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import cut

#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GOLAY_POLYNOMIAL = 0xC75
BITS = 23

SEGMENTS = 32
ANCHORS = 2
#: Minhashes drawn on by the segments (a power of two); each segment takes its own selection of them.
HASHES = 256
SHINGLE = 8
MIN_CHARS = 80
THRESHOLD = 0.6
#: Standard deviations that the sketches of a pair at the bar may lie apart; None compares all pairs that meet.
SIGMAS = 5.0
#: Texts under one key that are compared in one cell; a key with more is cut into blocks.
BLOCK = 256
#: Fingerprints are computed for so many texts or characters at once.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 512, 1 << 20
#: Low bits of a shingle's hash that give way to the place of its text when many texts are sorted at once.
_PLACE_BITS = 10


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome: remainder of each word's polynomial by the generator."""
    r = words.astype(np.int64).copy()
    for top in range(BITS - 1, 10, -1):
        r ^= ((r >> top) & 1) * (GOLAY_POLYNOMIAL << (top - 11))
    return r


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each of the 2048 syndromes: the differences to its nearby codewords (six, or one repeated), and how many."""
    patterns = np.array([sum(1 << i for i in c) for w in range(4) for c in combinations(range(BITS), w)], np.int64)
    error = np.zeros(2048, np.int64)
    error[_remainder(patterns)] = patterns
    flips = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.int64)
    near = flips ^ error[np.arange(2048)[:, None] ^ _remainder(flips)]
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s in range(2048):
        own = np.array(list(dict.fromkeys(near[s].tolist())))
        table[s, : len(own)], table[s, len(own) :], count[s] = own, own[0], len(own)
    return table, count


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word: six, or one repeated; the own codeword comes first."""
    return (words[..., None] ^ _tables()[0][_remainder(words)]) >> 11


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(text: str, n: int) -> np.ndarray:
    """Hash of every run of ``n`` characters of one text (or of several, put together)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        h *= np.uint64(0x100000001B3)
        h += c[i : len(c) - n + 1 + i]
    return _mix(h)


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """Different 64-bit hashes of all runs of ``n`` characters, sorted."""
    return np.unique(_rolled(text, n))


@lru_cache(4)
def _plan(segments: int, anchors: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Detours of empty bins; of each segment its minhashes for bits, the bit of each, its anchors."""
    rng = np.random.default_rng(20231)
    detour = rng.integers(0, hashes, (128, hashes))
    pick = np.stack([rng.permutation(hashes)[: BITS + anchors] for _ in range(segments)])
    return detour, pick[:, :BITS], rng.integers(0, 16, (segments, BITS)), pick[:, BITS:]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that are fingerprinted together; a very long text is a run of its own."""
    lo = chars = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= TEXTS_AT_ONCE or chars + len(t) > CHARS_AT_ONCE):
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def minhashes(texts: list[str], hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, hashes) one-permutation minhashes, and the number of different shingles of each text.

    The least hash of each of 2^k equal ranges counts. All hashes of all texts are sorted at once, by text and value,
    so a range is a run. An empty range takes the value of the first filled one on its own fixed detour ("optimal
    densification"), which keeps the chance of a match equal to the similarity. Texts have at least SHINGLE characters.
    """
    place = np.uint64(64 - _PLACE_BITS)
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    h = _rolled("".join(texts), SHINGLE)
    whole = left[: len(h)] >= SHINGLE  # the others run over into the next text
    h = np.sort((owner[: len(h)][whole] << place) | (h[whole] >> np.uint64(_PLACE_BITS)))
    h = h[np.concatenate([[True], h[1:] != h[:-1]])]
    steps = np.arange(len(texts) * hashes + 1, dtype=np.uint64)
    width = np.uint64(64 - _PLACE_BITS - (hashes.bit_length() - 1))
    at = np.searchsorted(h, steps[:-1] << width)
    filled = (np.diff(np.append(at, len(h))) > 0).reshape(len(texts), hashes)
    source = np.tile(np.arange(hashes), (len(texts), 1))
    t, e = np.nonzero(~filled)
    for step in _plan(1, 0, hashes)[0]:
        if not len(t):
            break
        ok = filled[t, step[e]]
        source[t[ok], e[ok]] = step[e[ok]]
        t, e = t[~ok], e[~ok]
    if len(t):
        source[t, e] = filled.argmax(1)[t]
    m = h[np.take_along_axis(at.reshape(filled.shape), source, 1)]
    number = np.diff(np.append(at[::hashes], len(h)))
    return _mix(m << np.uint64(_PLACE_BITS)), number


def _keys(batches: Iterator[pa.RecordBatch], segments: int, anchors: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """(h, norm) -> (key, h), several keys for each segment."""
    _, bit_of, bit_at, anchor_of = _plan(segments, anchors, hashes)
    weight = (1 << np.arange(BITS)).astype(np.int64)
    count = _tables()[1]
    for batch in batches:
        uid, every = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for lo, hi in _groups(every):
            m, _ = minhashes(every[lo:hi], hashes)
            words = (((m[:, bit_of] >> (bit_at + 20).astype(np.uint64)) & np.uint64(1)).astype(np.int64) * weight).sum(2)
            index = golay_keys(words)
            anchor = np.zeros(words.shape, np.uint64)
            for i in range(anchors):
                anchor = _mix(anchor * np.uint64(31) + m[:, anchor_of[:, i]])
            anchor = _mix(anchor + np.arange(segments, dtype=np.uint64))
            doc, seg, slot = np.nonzero(np.arange(6) < count[_remainder(words)][..., None])
            key = _mix(anchor[doc, seg] ^ (index[doc, seg, slot].astype(np.uint64) << np.uint64(40)))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(uid[lo + doc])], names=["key", "h"])


def _sketches(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[pa.RecordBatch]:
    """(h, norm) -> (h, number of different shingles, one bit of each minhash in words of 64)."""
    for b in batches:
        every = b.column(1).to_pylist()
        for lo, hi in _groups(every):
            m, n = minhashes(every[lo:hi], hashes)
            bits = np.packbits((m & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int32)), *(pa.array(c) for c in bits.T)], names=["h", "n", *(f"b{i}" for i in range(hashes // 64))])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(uid_a, uid_b, x, y): exact Jaccard similarity of the runs of characters of both texts."""
    for b in batches:
        first, xs, ys = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
        sim = np.zeros(len(xs))
        last, sx = None, np.zeros(0, np.uint64)
        for i, (uid, x, y) in enumerate(zip(first, xs, ys)):
            if uid != last:
                last, sx = uid, shingle_hashes(x)
            sy = shingle_hashes(y)
            both = len(np.intersect1d(sx, sy, assume_unique=True))
            sim[i] = both / max(1, len(sx) + len(sy) - both)
        keep = pa.array(sim >= threshold)
        yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(sim).filter(keep)], names=["uid_a", "uid_b", "sim"])


def normalised(texts: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, norm) of the texts that take part: lower case, letters and digits only, at least ``min_chars``."""
    norm = F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{Nd}]+", "")
    # a generator, because a filter would be pushed below and normalise every text twice
    one = F.array(F.struct(F.col(id_col).alias("id"), norm.alias("norm")))
    return texts.where(F.col(id_col).isNotNull()).select(F.inline(F.filter(one, lambda z: F.length(z["norm"]) >= min_chars)))


def _sides(df: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Two renamings of a table for a join with itself: every column but ``on`` gets the suffix _a or _b."""
    return tuple(df.select(on, *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != on]) for x in "ab")


def _alike(threshold: float, hashes: int, sigmas: float | None) -> F.Column:
    """Whether a pair (n_a, n_b, b0_a, ...) can still be similar: by the exact bound of sizes, and by sketches.

    A pair at the bar differs in (1 - threshold) / 2 of the bits; ``sigmas`` standard deviations more are let pass. A
    text of few shingles has no more independent bits than shingles.
    """
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sizes = small + 1 >= F.lit(threshold) * large
    if sigmas is None:
        return sizes
    p = (1 - threshold) / 2
    apart = sum((F.bit_count(F.col(f"b{i}_a").bitwiseXOR(F.col(f"b{i}_b"))) for i in range(hashes // 64)), F.lit(0))
    return sizes & (apart <= hashes * (p + F.lit(sigmas * (p * (1 - p)) ** 0.5) / F.sqrt(F.least(small, F.lit(hashes)))))


def near_duplicates(texts: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, segments: int = SEGMENTS, anchors: int = ANCHORS, hashes: int = HASHES, sigmas: float | None = SIGMAS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of different normalised texts with similarity >= ``threshold``, and who has which text.

    links (uid_a, uid_b, sim) are between representatives, uid_a < uid_b; members (uid, id) has each id once per text.
    Equal texts share a uid (a 128-bit digest), so a group of copies costs one fingerprint and no pair. Null texts, null
    ids and texts shorter than ``min_chars`` after normalisation take no part; repeated rows count once; an empty table
    gives empty results. Texts are read whole, whatever their length.

    Keys that only one text has leave after one sort. A key of more than ``block`` texts is cut into blocks that meet
    in cells of their own, where only pairs that sizes and sketches let pass come out. Candidates are joined by a
    64-bit hash h; texts that collide in it both come along and are told apart by the exact comparison (two similar
    texts that collide would not be compared). No join may broadcast: the optimiser takes the keys of a text for one row.
    """
    if min_chars < SHINGLE or hashes % 64 or hashes & (hashes - 1):
        raise ValueError(f"min_chars must be at least {SHINGLE}, hashes a power of two from 64")
    norm = normalised(texts, id_col, text_col, min_chars)
    members = norm.select(F.md5("norm").alias("uid"), "id").distinct()
    reps = norm.select("norm").distinct().select(F.xxhash64("norm").alias("h"), "norm")
    keys = reps.mapInArrow(partial(_keys, segments=segments, anchors=anchors, hashes=hashes), "key bigint, h bigint")
    under = Window.partitionBy("key").orderBy("h")
    placed = keys.select("key", "h", F.row_number().over(under).alias("place"), F.lead("h").over(under).alias("next"))
    shared = cut(placed.where("place > 1 OR next IS NOT NULL").select("key", "h", F.floor((F.col("place") - 1) / block).cast("int").alias("blk")))

    hot = shared.groupBy("key").agg(F.max("blk").alias("top")).where("top > 0")
    left, right = _sides(shared.select("key", "h"), "key")
    sketched = lambda some: some.mapInArrow(partial(_sketches, hashes=hashes), "h bigint, n int, " + ", ".join(f"b{i} bigint" for i in range(hashes // 64)))
    split = bool(hot.take(1))
    if split:
        cold = shared.join(hot.hint("merge"), "key", "left_anti")
        left, right = _sides(cold.select("key", "h"), "key")
    met = left.join(right.hint("merge"), "key").where("h_a < h_b").select("h_a", "h_b")
    if split:
        crowd = shared.join(hot.hint("merge"), "key").join(sketched(reps).hint("merge"), "h")
        rest = [c for c in crowd.columns if c not in ("key", "blk", "top")]
        one = crowd.select("key", F.col("blk").alias("i"), F.explode(F.sequence("blk", "top")).alias("j"), *[F.col(c).alias(f"{c}_a") for c in rest])
        two = crowd.select("key", F.explode(F.sequence(F.lit(0), "blk")).alias("i"), F.col("blk").alias("j"), *[F.col(c).alias(f"{c}_b") for c in rest])
        ordered = (F.col("h_a") < F.col("h_b")) | (F.col("i") < F.col("j"))
        dense = one.join(two.hint("merge"), ["key", "i", "j"]).where(ordered & (F.col("h_a") != F.col("h_b")) & _alike(threshold, hashes, sigmas))
        met = met.unionByName(dense.select(F.least("h_a", "h_b").alias("h_a"), F.greatest("h_a", "h_b").alias("h_b")))
    met = cut(met.distinct())

    involved = met.select(F.explode(F.array("h_a", "h_b")).alias("h")).distinct()
    some = reps.join(involved.hint("merge"), "h", "left_semi")
    sa, sb = (sketched(some).select(*[F.col(c).alias(f"{c}_{x}") for c in ("h", "n", *(f"b{i}" for i in range(hashes // 64)))]) for x in "ab")
    near = met.join(sa.hint("merge"), "h_a").join(sb.hint("merge"), "h_b").where(_alike(threshold, hashes, sigmas)).select("h_a", "h_b")
    x, y = some.toDF("h_a", "x"), some.toDF("h_b", "y")
    both = near.join(y.hint("merge"), "h_b").join(x.hint("merge"), "h_a")
    # texts in the order of their uids, as the links are
    ua, ub = F.md5("x"), F.md5("y")
    both = both.select(F.least(ua, ub).alias("uid_a"), F.greatest(ua, ub).alias("uid_b"), F.when(ua < ub, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(ua < ub, F.col("y")).otherwise(F.col("x")).alias("y"))
    return both.mapInArrow(partial(_verify, threshold=threshold), "uid_a string, uid_b string, sim double"), members


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(uid, root): every end of a link with the least uid it is connected to.

    Each round takes the least root among the neighbours and then follows roots of roots, so paths halve. Every round
    is cut; nothing but the number of changes reaches the driver. More than ``rounds`` rounds are an error.
    """
    ends = cut(links.select("uid_a", "uid_b").unionByName(links.select(F.col("uid_b").alias("uid_a"), F.col("uid_a").alias("uid_b"))).distinct())
    label = cut(ends.groupBy(F.col("uid_a").alias("uid")).agg(F.min(F.least("uid_a", "uid_b")).alias("root")))
    for _ in range(rounds):
        near = ends.join(label.toDF("uid_b", "r").hint("merge"), "uid_b").groupBy(F.col("uid_a").alias("uid")).agg(F.min("r").alias("r"))
        least = label.join(near.hint("merge"), "uid").select("uid", F.col("root").alias("before"), F.least("root", "r").alias("mid"))
        roots = label.select(F.col("uid").alias("mid"), F.col("root").alias("far"))
        label = cut(least.join(roots.hint("merge"), "mid", "left").select("uid", "before", F.least("mid", "far").alias("root")))
        if not label.where("root <> before").take(1):
            return label.select("uid", "root")
        label = label.select("uid", "root")
    raise ValueError(f"components did not settle in {rounds} rounds")


def groups(texts: DataFrame, id_col: str = "id", text_col: str = "text", **settings) -> DataFrame:
    """(id, group_id, n_links): every id whose text takes part, with the least id of its group and its text's links.

    Groups are the connected components of the links; copies belong to the group of their text. n_links counts the
    different other texts that are similar. An id with two different texts has a row for each group it is in.
    """
    links, members = near_duplicates(texts, id_col, text_col, **settings)
    links = cut(links)
    degree = links.select(F.explode(F.array("uid_a", "uid_b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    of_text = components(links).join(degree.hint("merge"), "uid")
    who = members.join(of_text.hint("merge"), "uid", "left").select("id", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = who.groupBy("root").agg(F.min("id").alias("group_id"))
    return who.join(least.hint("merge"), "root").groupBy("id", "group_id").agg(F.max("n_links").alias("n_links"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """p1_found: direct pairs of corpus ids with similarity >= 0.6, id_a < id_b.

    The result is defined on ids, so copies are expanded here: links join the members of both ends, and the members
    of one text join one another.
    """
    links, members = near_duplicates(spark.read.parquet(f"{sf}/corpus.parquet").select("id", "text"))
    a, b = members.select(F.col("uid").alias("uid_a"), F.col("id").alias("i")), members.select(F.col("uid").alias("uid_b"), F.col("id").alias("j"))
    across = links.join(a.hint("merge"), "uid_a").join(b.hint("merge"), "uid_b").where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    same = a.join(b.hint("merge"), a.uid_a == b.uid_b).where("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    return across.unionByName(same).distinct()


QUERIES = {
    "p1_found": found,
    "p1_groups": lambda spark, sf: groups(spark.read.parquet(f"{sf}/corpus.parquet").select("id", "text")),
}
#: Brute force: all runs of all texts joined with each other.
_PAIRS_SQL = r"""norm AS (
  SELECT DISTINCT id, regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', '', 'g') AS t FROM corpus WHERE id IS NOT NULL AND text IS NOT NULL
), part AS (SELECT * FROM norm WHERE length(t) >= 80
), rep AS (SELECT t, row_number() OVER (ORDER BY t) AS u FROM (SELECT DISTINCT t FROM part)
), run AS (SELECT u, list_distinct(list_transform(range(1, length(t) - 6), lambda i: hash(t[i : i + 7]))) AS s FROM rep
), flat AS (SELECT u, unnest(s) AS h FROM run
), met AS (SELECT a.u AS x, b.u AS y, count(*) AS n FROM flat a JOIN flat b ON a.h = b.h AND a.u < b.u GROUP BY 1, 2
), link AS (SELECT x, y FROM met JOIN run a ON a.u = x JOIN run b ON b.u = y WHERE n >= 0.6 * (len(a.s) + len(b.s) - n)
), mem AS (SELECT DISTINCT id, u FROM part JOIN rep USING (t))"""
SQL = {
    "p1_found": f"""WITH {_PAIRS_SQL}, every AS (
  SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM link JOIN mem a ON a.u = x JOIN mem b ON b.u = y WHERE a.id <> b.id
  UNION SELECT a.id, b.id FROM mem a JOIN mem b ON a.u = b.u AND a.id < b.id)
SELECT * FROM every""",
    "p1_groups": f"""WITH RECURSIVE {_PAIRS_SQL}, side AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), walk AS (SELECT u AS node, u AS seen FROM rep UNION SELECT walk.node, side.y FROM walk JOIN side ON side.x = walk.seen
), root AS (SELECT node AS u, min(seen) AS r FROM walk GROUP BY 1
), deg AS (SELECT x AS u, count(*) AS n FROM side GROUP BY 1
), who AS (SELECT id, r, coalesce(n, 0) AS n FROM mem JOIN root USING (u) LEFT JOIN deg USING (u)
), first_id AS (SELECT r, min(id) AS group_id FROM who GROUP BY 1)
SELECT id, group_id, max(n)::BIGINT AS n_links FROM who JOIN first_id USING (r) GROUP BY 1, 2""",
}
