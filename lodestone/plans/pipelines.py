"""Composite pipelines (Q1-Q8, Q11): items in, run and report out. Everything stays a plan until written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import RunConfig
from lodestone.functions import text as T
from lodestone.operators.aggregates import consistency, stratified_sample
from lodestone.operators.benchmark import build_stats, build_subset
from lodestone.operators.dilution import dilution
from lodestone.operators.encoders import Encoder, encode
from lodestone.operators.items import corpus_items, first_items, judgements, query_items
from lodestone.operators.metrics import diagnose, per_query, report
from lodestone.operators.retrieval import retrieve


@dataclass
class Baseline:
    """Frames of one run."""

    query_vectors: DataFrame
    corpus_vectors: DataFrame
    run: DataFrame
    metrics: DataFrame
    report: DataFrame
    diagnosis: DataFrame


def baseline(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, domains: DataFrame, encoder: Encoder, config: RunConfig = RunConfig(), query_vectors: DataFrame | None = None, corpus_vectors: DataFrame | None = None) -> Baseline:
    """Whole-document retrieval and its evaluation.

    Order of the filters: domain, then max_queries, then having judgements, so fewer than max_queries can remain. A
    limit takes the first ids in order. Vectors that exist already (a cache) are used as they are. Queries are encoded
    with the instruction, documents without.
    """
    d = config.data
    q = query_items(queries, domains, config.model.instruction)
    if d.domains:
        q = q.where(F.col("coarse_domain").isin(*d.domains))
    q = first_items(q, d.max_queries)
    rels = judgements(qrels, queries).join(q.select(F.col("id").alias("qid")), "qid", "left_semi")
    q = q.join(rels.select(F.col("qid").alias("id")).distinct(), "id", "left_semi")
    c = first_items(corpus_items(corpus), d.max_corpus)
    image = lambda t: t.where("id IS NOT NULL").groupBy("id").agg(F.max("image.bytes").alias("image"))
    with_image = lambda items, raw: items.groupBy("id", "source_id").agg(F.min("text").alias("text")).join(image(raw).withColumnRenamed("id", "source_id"), "source_id", "left").select("id", "text", "image")
    qv = query_vectors if query_vectors is not None else encode(with_image(q, queries), encoder, config.model.instruction, config.model.batch_size)
    cv = corpus_vectors if corpus_vectors is not None else encode(with_image(c, corpus), encoder, "", config.model.batch_size)
    run = retrieve(qv, cv, config.retrieval.top_k, dim=encoder.dim, cosine=config.retrieval.cosine)
    groups = q.groupBy(F.col("id").alias("qid")).agg(F.min("coarse_domain").alias("coarse"), F.coalesce(F.min("category"), F.lit("Unknown")).alias("fine"), F.max(F.col("modality").contains("image")).alias("has_image"))
    m = per_query(run, rels, config.eval.cuts)
    return Baseline(qv, cv, run, m, report(m, groups), diagnose(run, rels, groups))


def subset_baseline(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, domains: DataFrame, encoder: Encoder, top_k: int = 100) -> Baseline:
    """The same on a benchmark subset: no cache, no filter by domain, no limits."""
    plain = RunConfig(task="subset")
    return baseline(queries, corpus, qrels, domains, encoder, RunConfig(task="subset", retrieval=type(plain.retrieval)(top_k=top_k, cosine=plain.retrieval.cosine)))


def rebuild(query_vectors: DataFrame, corpus_vectors: DataFrame, queries: DataFrame, qrels: DataFrame, domains: DataFrame, dim: int, config: RunConfig = RunConfig()) -> Baseline:
    """Run, metrics and diagnosis out of cached vectors alone; nothing is encoded. Queries without a vector score 0."""
    q = query_items(queries, domains)
    rels = judgements(qrels, queries)
    run = retrieve(query_vectors, corpus_vectors, config.retrieval.top_k, dim=dim, cosine=config.retrieval.cosine)
    groups = q.groupBy(F.col("id").alias("qid")).agg(F.min("coarse_domain").alias("coarse"), F.coalesce(F.min("category"), F.lit("Unknown")).alias("fine"), F.max(F.col("modality").contains("image")).alias("has_image"))
    m = per_query(run, rels, config.eval.cuts)
    return Baseline(query_vectors, corpus_vectors, run, m, report(m, groups), diagnose(run, rels, groups))


def check_cache(run: DataFrame, query_vectors: DataFrame, corpus_vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(pairs, mismatches, max_abs_diff): a stored run against the vectors it should have come from."""
    return consistency(run, query_vectors.unionByName(corpus_vectors), tolerance)


def bad_cases(diagnosis: DataFrame, queries: DataFrame, run: DataFrame, corpus: DataFrame, n: int = 10, seed: int = 7, top: int = 5) -> DataFrame:
    """(title, text, tag, image, coarse) for ``case_pages``: of every domain ``n`` queries, zero scores first, and what they found."""
    picked = stratified_sample(diagnosis, "coarse", "ndcg_at_10", "qid", n, seed)
    of = lambda t, prefix: t.where("id IS NOT NULL").groupBy(F.concat(F.lit(prefix), "id").alias("id")).agg(F.min("text").alias("text"), F.max("image.bytes").alias("image"))
    q, c = of(queries, T.QUERY_PREFIX), of(corpus, T.CORPUS_PREFIX)
    asked = picked.join(q, picked.qid == q.id, "left").select(F.concat_ws(" ", "qid", F.lit("query")).alias("title"), "text", "rank_bucket", "image", "coarse")
    hits = run.where(F.col("rank") <= top).join(picked.select("qid", "coarse"), "qid")
    found = hits.join(c, hits.did == c.id, "left").select(F.concat_ws(" ", "qid", F.format_string("%02d", "rank"), "did").alias("title"), "text", F.format_string("%.4f", "score").alias("tag"), "image", "coarse")
    return asked.withColumnRenamed("rank_bucket", "tag").unionByName(found)


def dilution_of(b: Baseline, queries: DataFrame, qrels: DataFrame, corpus: DataFrame, encoder: Encoder, top: int = 5, max_queries: int | None = None) -> DataFrame:
    """Both dilution classes of the queries of a run that score 0."""
    zero = first_items(b.metrics.where("k = 10 AND ndcg = 0").select(F.col("qid").alias("id")), max_queries).select(F.col("id").alias("qid"))
    texts = corpus_items(corpus).groupBy(F.col("id").alias("did")).agg(F.min("text").alias("text"))
    return dilution(zero, b.run, judgements(qrels, queries), texts, b.query_vectors.toDF("qid", "qe"), b.corpus_vectors.toDF("did", "de"), encoder, top)


def subset(b: Baseline, queries: DataFrame, qrels: DataFrame, corpus: DataFrame, target: int = 3000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(did, reason) of a benchmark subset with the hard negatives of a run, and its statistics."""
    rels = judgements(qrels, queries)
    docs = corpus.where("id IS NOT NULL").groupBy(F.concat(F.lit(T.CORPUS_PREFIX), "id").alias("did")).agg(F.max(F.col("image.bytes").isNotNull() | F.col("image.path").isNotNull()).alias("has_image"))
    kept = build_subset(b.run, rels, docs, target, seed)
    return kept, build_stats(kept, rels, docs)
