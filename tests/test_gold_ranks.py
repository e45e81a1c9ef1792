"""Rank buckets without a row for each judgement, and top-k retrieval that keeps k rows a query."""

import numpy as np
import pytest

from lodestone import catalogue
from lodestone.operators import retrieval
from lodestone.operators.metrics import diagnose, gold_ranks
from lodestone.operators.retrieval import retrieve


def shuffled(spark, run) -> int:
    """Rows that all stages of ``run()`` write for other stages."""
    sc = spark.sparkContext
    group = f"rows-{id(run)}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setJobGroup("", "")
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_hot_document_is_not_paired(spark, tmp_path):
    n = 5000
    spark.range(n).selectExpr("id AS row", "'hot' AS corpus_id", "'text' AS modality", "'s' AS source", "false AS has_image").write.parquet(f"{tmp_path}/meta.parquet")
    x = np.random.default_rng(0).normal(size=(n, 64))
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row long, embedding array<float>").write.parquet(f"{tmp_path}/subdoc_vectors.parquet")
    got = []
    rows = shuffled(spark, lambda: got.extend(catalogue.queries()["m7_rank_bucket"](spark, str(tmp_path)).collect()))
    assert {(r["n_gold"], r["best_gold_rank"], r["rank_bucket"]) for r in got} == {(n, 1, "1")} and len(got) == n // 100
    assert rows < n * n // 100 // 2  # there are n * n / 100 judgements


def test_same_as_from_pairs(spark):
    rng = np.random.default_rng(1)
    doc = sorted({(int(r), f"c{rng.integers(9)}") for r in rng.integers(0, 60, 200)} | {(7, "c1"), (7, "c2"), (8, "c1"), (8, "c2")})
    places = spark.createDataFrame([(f"d{r}", c) for r, c in doc] + [(None, "c1"), (None, "c2")], "did string, doc string")
    questions = spark.createDataFrame([(f"q{r}", c) for r, c in doc if r % 3 == 1], "qid string, doc string")
    run = spark.createDataFrame([(f"q{q}", f"d{d}", i + 1) for q in range(50) for i, d in enumerate(rng.permutation(60)[:3])], "qid string, did string, rank int")
    qrels = questions.join(places, "doc").selectExpr("qid", "did", "1 AS rel").distinct()
    groups = spark.createDataFrame([], "qid string, coarse string, fine string, has_image boolean")
    names = ["qid", "n_gold", "best_gold_rank", "rank_bucket"]
    want = diagnose(run, qrels, groups).select(*names)
    got = gold_ranks(run, questions, places)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["rank_bucket"] for r in got.collect()} >= {"miss", "1", "2-5"}


@pytest.mark.parametrize("way", [{}, {"tiles": 2, "closure_bytes": 64}])
def test_copies_do_not_displace(spark, way):
    d = spark.createDataFrame([("a", [9.0, 0.0])] * 8 + [(f"b{i}", [float(i), 1.0]) for i in range(4)], "id string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "id string, embedding array<double>")
    got = sorted((r["qid"], r["rank"], r["did"]) for r in retrieve(q, d, 3, dim=2, **way).collect())
    assert got == [("q", 1, "a"), ("q", 2, "b3"), ("q", 3, "b2"), ("r", 1, "b3"), ("r", 2, "b2"), ("r", 3, "b1")]


@pytest.mark.parametrize("cosine", [False, True])
def test_best_however_cut(monkeypatch, cosine):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for name, size in (("BLOCK_QUERIES", 3), ("BLOCK_DOCUMENTS", 5), ("CHUNK_DOCUMENTS", 11)):
        monkeypatch.setattr(retrieval, name, size)
    d = np.round(rng.normal(size=(120, 4)), 1)
    d[60:] = d[rng.integers(0, 60, 60)]  # ties
    d *= 10.0 ** rng.integers(-6, 6, (120, 1))  # lengths far apart
    ids, q = [f"d{i % 90}" for i in range(120)], rng.normal(size=(7, 4))
    best = retrieval.Best(np.array([f"q{i}" for i in range(7)], object), q, 6, cosine)
    for i in range(0, 120, 17):
        best.add(pa.array(ids[i : i + 17]), d[i : i + 17])
    got = [tuple(r.values()) for b in best.rows() for r in b.to_pylist()]
    a, b = np.divmod(np.arange(7 * 120), 120)
    score = retrieval._ordered_dot(q[a], d[b])
    if cosine:
        score = score / np.sqrt(retrieval._ordered_dot(q, q)[a] * retrieval._ordered_dot(d, d)[b])
    score = score.reshape(7, 120).tolist()
    assert got == [(f"q{i}", x, s) for i in range(7) for s, x in sorted(set(zip(score[i], ids)), reverse=True)[:6]]
