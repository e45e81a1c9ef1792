"""Mixing sources to target weights by soft membership.

A multinomial classifier, fitted on a bounded sample of the labelled rows, gives every document posteriors over the wanted
sources. Projected gradient descent on least squares fits one nonnegative rate for each document, so that the expected
token totals of the sources match the targets: each step is one aggregate over all documents, of which a row for each
source comes back. Rates become whole repeats by draws from each source, large documents first, so that token totals come
out and not just counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut

from .tokens import VOCABULARY, count_tokens

#: Hashed features of the classifier; its table has FEATURES x sources counts, whatever the number of documents.
FEATURES = 4096
#: Labelled documents of each source that the classifier is fitted on, about.
SAMPLE_ROWS = 2048
#: Part of a labelled document's membership that the classifier decides; its label has the rest.
DOUBT = 0.02
#: Steps of the gradient descent, at most, and the error of every share (of the whole) at which it ends.
STEPS, CLOSE = 60, 1e-4
MAX_SOURCES = 1024
_UNIT = 1_000_000
_CELLS = 4096
_SHARES = "source string, target_share double, actual_share double, expected_share double, tokens double, n_docs bigint, max_repeats int, held_by_cap boolean"


def _features(text: str) -> np.ndarray:
    """Buckets of the runs of four characters of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 4:
        c = np.concatenate([c, np.zeros(4 - len(c), np.uint64)])
    h = c[:-3] * np.uint64(0x9E3779B1) ^ c[1:-2] * np.uint64(0x85EBCA77) ^ c[2:-1] * np.uint64(0xC2B2AE3D) ^ c[3:] * np.uint64(0x27D4EB2F)
    return ((h ^ (h >> np.uint64(17))) % np.uint64(FEATURES)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, bucket, n), added up within each batch."""
    for b in batches:
        labels = b.column(0).dictionary_encode()
        names, code = labels.dictionary, labels.indices.to_numpy()
        total = np.zeros((len(names), FEATURES), np.int64)
        for i, t in zip(code, b.column(1).to_pylist()):
            total[i] += np.bincount(_features(t), minlength=FEATURES)
        i, j = np.nonzero(total)
        yield pa.record_batch([names.take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["label", "bucket", "n"])


def posteriors(texts: list[str], log_prior: np.ndarray, log_like: np.ndarray) -> np.ndarray:
    """Class posteriors; the evidence of a long text is tempered to its square root, as its runs are not independent."""
    out = np.zeros((len(texts), len(log_prior)))
    for i, t in enumerate(texts):
        f = _features(t)
        out[i] = log_prior + log_like[:, f].sum(1) / np.sqrt(len(f))
    out = np.exp(out - out.max(1, keepdims=True)) if len(texts) else out
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def _membership(batches: Iterator[pa.RecordBatch], path: str, sources: list[str], log_prior: np.ndarray, log_like: np.ndarray, doubt: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, h, text) -> (doc_id, label, h, n_tokens, p): tokens and full posteriors of each document."""
    place = {s: i for i, s in enumerate(sources)}
    k = len(sources)
    for b in batches:
        texts = b.column(3).to_pylist()
        known = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
        p = posteriors(texts, log_prior, log_like)
        at = np.flatnonzero(known >= 0)
        p[at] *= doubt
        p[at, known[at]] += 1 - doubt
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k), pa.array(p.astype(np.float32).ravel()))
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(count_tokens(texts, path)), flat], names=["doc_id", "label", "h", "n_tokens", "p"])


def step_rates(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given gradient steps, and the point at which the next gradient is taken (accelerated descent).

    A gradient has a value for each source, its missing or surplus tokens over all its tokens; a document moves by the
    mean of them over its membership and is held between 0 and its cap. In this metric no curvature exceeds one, so a
    step of length one never overshoots.
    """
    rate = ahead = np.zeros(len(p))
    t = 1.0
    for g in history:
        new = np.clip(ahead - p @ g, 0, cap)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - rate)
        rate, t = new, t2
    return rate, ahead


def _arrays(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Membership, cap and tokens of a batch (n_tokens, cap, p, ...)."""
    p = b.column(2)
    off = p.offsets.to_numpy()
    return p.values.to_numpy()[off[0] : off[-1]].reshape(b.num_rows, k).astype(np.float64), b.column(1).to_numpy(), b.column(0).to_numpy().astype(np.float64)


def _totals(batches: Iterator[pa.RecordBatch], k: int, history: list[np.ndarray], ahead: bool) -> Iterator[pa.RecordBatch]:
    """Expected tokens of each source under the rates so far, added up within each batch."""
    for b in batches:
        p, cap, n = _arrays(b, k)
        at = step_rates(p, cap, history)[int(ahead)]
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(p.T @ (at * n))], names=["s", "tokens"])


def _rated(batches: Iterator[pa.RecordBatch], k: int, history: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(n_tokens, cap, p, doc_id, source, h) -> (doc_id, source, h, n_tokens, p, low, part): rates in whole and millionth repeats."""
    for b in batches:
        p, cap, _ = _arrays(b, k)
        rate = np.rint(step_rates(p, cap, history)[0] * _UNIT).astype(np.int64)
        yield pa.record_batch([b.column(3), b.column(4), b.column(5), b.column(0), b.column(2), pa.array((rate // _UNIT).astype(np.int32)), pa.array(rate % _UNIT)], names=["doc_id", "source", "h", "n_tokens", "p", "low", "part"])


def fit_rates(docs: DataFrame, supply: np.ndarray, target: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> list[np.ndarray]:
    """Gradients of the descent that brings the expected totals of ``docs`` (n_tokens, cap, p) to ``target``.

    Minimises the squared error of each source over its tokens. Every step is an aggregate over all documents, which
    replay the few steps so far; so no state is kept between steps, and a lost task costs only itself.
    """
    k, whole = len(supply), max(target.sum(), 1.0)
    history: list[np.ndarray] = []
    last = np.full(k, np.inf)
    for _ in range(steps):
        run = partial(_totals, k=k, history=history, ahead=True)
        rows = docs.select("n_tokens", "cap", "p").mapInArrow(run, "s int, tokens double").groupBy("s").agg(F.sum("tokens").alias("tokens")).collect()
        total = np.zeros(k)
        for r in rows:
            total[r["s"]] = r["tokens"]
        if history and (np.abs(total - target).max() <= close * whole or np.abs(total - last).max() <= close / 10 * whole):
            break  # there, or held by caps
        last = total
        history.append((total - target) / np.maximum(supply, 1.0))
    return history


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which cells of one source get one more copy: at most octaves x _CELLS rows, whatever the source holds.

    Sizes go from the largest octave down; each octave is to give the tokens of its rates' parts, and what it leaves over
    because documents are whole goes to the next smaller one, so the smallest documents even out the total.
    """
    pdf = pdf.sort_values(["octave", "cell"], ascending=[False, True], kind="stable")
    t, want, octave = pdf["t"].to_numpy(), pdf["want"].to_numpy(), pdf["octave"].to_numpy()
    more = np.zeros(len(pdf), np.int32)
    left = 0.0
    for o in np.unique(octave)[::-1]:
        at = np.flatnonzero(octave == o)
        left += want[at].sum() / _UNIT
        for i in at:
            if t[i] <= left + 0.5:
                more[i], left = 1, left - t[i]
    return pdf[["source", "octave", "cell"]].assign(more=more)


def rounded(rated: DataFrame) -> DataFrame:
    """Adds ``repeats``: the whole part of the rate, and one more for documents drawn by the part that is left.

    A document's turn comes by a hash over its part, so one with twice the part is twice as likely to have its turn
    before another. Turns fall into _CELLS cells for each octave of sizes; a cell is taken as a whole.
    """
    key = ["source", "octave", "cell"]
    u = (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    turn = u * _UNIT / F.greatest("part", F.lit(1))
    d = rated.withColumn("octave", F.floor(F.log2("n_tokens")).cast("int")).withColumn("cell", F.when(F.col("part") > 0, F.floor(_CELLS * turn / (1 + turn)).cast("int")))
    per = d.where("part > 0").groupBy(*key).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("part") * F.col("n_tokens")).cast("double").alias("want"))
    more = per.groupBy("source").applyInPandas(lambda pdf: _choose(pdf), "source string, octave int, cell int, more int").where("more > 0")
    return d.join(more.hint("merge"), key, "left").withColumn("repeats", F.col("low") + F.coalesce("more", F.lit(0))).drop("octave", "cell", "more")


def read_targets(targets: DataFrame) -> dict[str, tuple[float, float]]:
    """source -> (weight, cap), spellings folded. No weight, or one that isn't positive, asks for nothing.

    Of several rows of a source the highest weight and the lowest cap hold; a null cap sets none.
    """
    s = F.lower(F.trim("source"))
    rows = targets.where(F.col("source").isNotNull()).groupBy(s.alias("s")).agg(F.max(F.nanvl(F.col("weight").cast("double"), F.lit(0.0))).alias("w"), F.min("max_repeats").alias("c")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["s"]: (max(r["w"] or 0.0, 0.0), np.inf if r["c"] is None else float(max(r["c"], 0))) for r in rows}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | str = "epoch", vocabulary: str = VOCABULARY, doubt: float = DOUBT) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture (doc_id, source, n_tokens, repeats): each text once, under its smallest doc_id, with the number of times it
    enters. shares (source, target_share, actual_share, expected_share, tokens, n_docs, max_repeats, held_by_cap): what was
    really reached, by the documents' sources and by their memberships; held_by_cap: all the source has, at its cap, is
    less than its share. A source that asks for nothing or has no documents is listed too. Target shares are the positive
    weights of sources that have documents, made to add up to one (others are reported with target 0).

    Membership: a document without a usable label belongs to the wanted sources as the classifier finds; of a labelled one
    the classifier decides the part ``doubt``. An unlabelled document counts under its strongest source, whose cap holds.

    Size: ``total_tokens``, a number, or "epoch" (default): the tokens of all different texts of the wanted sources,
    so that the mixture grows with the data; sources too small for their share at their cap fall short, and the report
    says so. "reachable" takes the largest size at which every share can be reached within its cap, which a tiny
    source can make a tiny part of the data. Texts that are null, empty or without tokens take no part. Equal texts under
    different ids are one text; it belongs to a wanted source if any copy does. Empty tables give empty results.
    """
    spark = documents.sparkSession
    wanted = read_targets(targets)
    label = F.when(F.trim("source") != "", F.lower(F.trim("source")))
    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.alias("label"), F.md5("text").alias("h"), F.col("text").alias("text")).where(F.length("text") > 0)
    prior = {r["label"]: r["n"] for r in src.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(prior) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = sorted(set(prior) | set(wanted))
    sources = sorted(s for s in prior if wanted.get(s, (0.0, 0.0))[0] > 0)
    k = len(sources)
    mixture_of = "doc_id bigint, source string, n_tokens bigint, repeats int"
    if not k:
        shares = spark.createDataFrame([(s, 0.0, 0.0, 0.0, 0.0, 0, 0, False) for s in listed], _SHARES)
        return spark.createDataFrame([], mixture_of), shares

    every = F.create_map(*[x for s in sources for x in (F.lit(s), F.lit(max(1, prior[s] // SAMPLE_ROWS)))])
    sample = src.where(F.col("label").isin(sources)).where(F.pmod(F.xxhash64("h"), F.element_at(every, F.col("label"))) == 0)
    table = sample.select("label", "text").mapInArrow(_counts, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.full((k, FEATURES), 0.5)
    place = {s: i for i, s in enumerate(sources)}
    names = table.column("label").combine_chunks().dictionary_encode()
    if len(names):
        rows = np.array([place[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        np.add.at(count, (rows, table.column("bucket").to_numpy()), table.column("n").to_numpy())
    log_prior = np.log(np.array([prior[s] for s in sources], float))
    log_like = np.log(count / count.sum(1, keepdims=True))

    # labelled documents of sources that ask for nothing can never enter
    usable = src.where(F.col("label").isNull() | F.col("label").isin(sources))
    member = partial(_membership, path=vocabulary, sources=sources, log_prior=log_prior, log_like=log_like, doubt=doubt)
    scanned = usable.mapInArrow(member, "doc_id bigint, label string, h string, n_tokens bigint, p array<float>").where("n_tokens > 0")
    # one row for each text: a labelled one if there is one, then the smallest id
    first = F.min(F.struct(F.col("label").isNull().alias("r"), "doc_id", "label", "n_tokens", "p")).alias("m")
    texts = scanned.groupBy("h").agg(first).select("m.doc_id", "m.label", "h", "m.n_tokens", "m.p")
    strongest = F.element_at(F.array(*[F.lit(s) for s in sources]), F.array_position("p", F.array_max("p")).cast("int"))
    docs = cut(texts.withColumn("source", F.coalesce("label", strongest)).drop("label"))

    held = {r["source"]: float(r["tokens"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    has = np.array([held.get(s, 0.0) for s in sources])
    top = np.array([wanted[s][1] for s in sources])
    weight = np.where(has > 0, np.array([wanted[s][0] for s in sources]), 0)
    share = weight / max(weight.sum(), 1e-300)
    on = share > 0
    size = float(has[on].sum()) if isinstance(total_tokens, str) else float(total_tokens)
    reach = np.where(has > 0, np.where(has > 0, has, 1) * top, 0)
    if total_tokens == "reachable":
        size = min(size, float((reach[on] / share[on]).min(initial=np.inf)))
    # a source without a cap may need any number of repeats, but never more than give the whole size
    caps = np.where(np.isfinite(top), top, np.ceil(size / np.maximum(has, 1)) + 1)
    cap = F.element_at(F.array(*[F.lit(float(c)) for c in caps]), F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")).cast("int"))
    docs = docs.withColumn("cap", cap)
    soft = docs.select(F.posexplode("p").alias("s", "p"), "n_tokens").groupBy("s").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("n")).collect()
    supply = np.zeros(k)
    for r in soft:
        supply[r["s"]] = r["n"]
    # what a source cannot reach at its cap is no goal: documents of others that resemble it would be repeated for it
    history = fit_rates(docs, supply, np.minimum(share * size, reach))

    whole = "doc_id bigint, source string, h string, n_tokens bigint, p array<float>, low int, part bigint"
    rated = docs.select("n_tokens", "cap", "p", "doc_id", "source", "h").mapInArrow(partial(_rated, k=k, history=history), whole)
    chosen = cut(rounded(rated).where("repeats > 0"))

    weighed = F.col("n_tokens") * F.col("repeats")
    got = {r["source"]: r for r in chosen.groupBy("source").agg(F.sum(weighed).alias("tokens"), F.count("*").alias("n"), F.max("repeats").alias("most")).collect()}
    expected = dict(chosen.select(F.posexplode("p").alias("s", "p"), weighed.alias("t")).groupBy("s").agg(F.sum(F.col("p") * F.col("t"))).collect())
    total = max(sum(r["tokens"] for r in got.values()), 1)
    rows = []
    for s in listed:
        i, r = place.get(s, -1), got.get(s)
        of = (float(share[i]), float(expected.get(i, 0.0)) / total, bool(share[i] * size > reach[i] * (1 + 1e-9))) if i >= 0 else (0.0, 0.0, False)
        rows.append((s, of[0], r["tokens"] / total if r else 0.0, of[1], float(r["tokens"]) if r else 0.0, r["n"] if r else 0, r["most"] if r else 0, of[2]))
    return chosen.select("doc_id", "source", "n_tokens", "repeats"), spark.createDataFrame(rows, _SHARES)


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The largest mixture in which every source has its share."""
    return mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"), spark.read.parquet(f"{sf}/mix_targets.parquet"), total_tokens="reachable")


QUERIES = {
    "p8_mixture": lambda spark, sf: _mix(spark, sf)[0],
    "p8_shares": lambda spark, sf: _mix(spark, sf)[1],
}
SQL: dict[str, str] = {}
