"""Metrics against values worked out by hand, and invariants."""

import math

import pytest

from lodestone.operators.metrics import diagnose, per_query, report

RUN = [("q1", "d3", 1), ("q1", "d1", 2), ("q1", "d9", 3), ("q2", "d2", 1)]
QRELS = [("q1", "d1", 2), ("q1", "d3", 1), ("q1", "d5", 1), ("q2", "d7", 1), ("q3", "d1", 1)]


@pytest.fixture()
def tables(spark):
    run = spark.createDataFrame(RUN, "qid string, did string, rank int")
    qrels = spark.createDataFrame(QRELS, "qid string, did string, rel int")
    groups = spark.createDataFrame([("q1", "A", "a", True), ("q2", "A", "b", False)], "qid string, coarse string, fine string, has_image boolean")
    return run, qrels, groups


def test_by_hand(tables):
    run, qrels, _ = tables
    m = {(r["qid"], r["k"]): r for r in per_query(run, qrels, (1, 3)).collect()}
    dcg, ideal = 1 + 2 / math.log2(3), 2 + 1 / math.log2(3) + 1 / 2
    assert m["q1", 3]["ndcg"] == pytest.approx(dcg / ideal)
    assert m["q1", 1]["ndcg"] == pytest.approx(1 / 2)
    assert m["q1", 3]["map"] == pytest.approx((1 + 1) / 3)
    assert m["q1", 3]["recall"] == pytest.approx(2 / 3)
    assert m["q1", 3]["precision"] == pytest.approx(2 / 3)
    assert m["q2", 3]["ndcg"] == m["q3", 3]["ndcg"] == 0  # retrieved nothing relevant; retrieved nothing


def test_ideal_run_is_one(spark, tables):
    _, qrels, _ = tables
    ideal = spark.createDataFrame([("q1", "d1", 1), ("q1", "d3", 2), ("q1", "d5", 3), ("q2", "d7", 1), ("q3", "d1", 1)], "qid string, did string, rank int")
    for r in per_query(ideal, qrels).collect():
        assert r["ndcg"] == pytest.approx(1)
        assert 0 <= r["precision"] <= 1


def test_report_levels(tables):
    run, qrels, groups = tables
    r = {(x["level"], x["grp"]): x for x in report(per_query(run, qrels, (3,)), groups).collect()}
    assert r["overall", "all"]["num_queries"] == 3
    assert r["coarse", "A"]["num_queries"] == 2
    assert r["fine", "Unknown"]["num_queries"] == 1


def test_diagnosis(tables):
    run, qrels, groups = tables
    d = {r["qid"]: r for r in diagnose(run, qrels, groups).collect()}
    assert (d["q1"]["rank_bucket"], d["q1"]["best_gold_rank"], d["q1"]["n_gold"]) == ("1", 1, 3)
    assert (d["q3"]["rank_bucket"], d["q3"]["best_gold_rank"], d["q3"]["coarse"]) == ("miss", -1, "Unknown")


def test_empty(spark, tables):
    _, qrels, _ = tables
    none = spark.createDataFrame([], "qid string, did string, rank int")
    assert {r["ndcg"] for r in per_query(none, qrels).collect()} == {0.0}
    assert per_query(none, qrels.limit(0)).count() == 0


def test_whole_document_is_judged(spark, tmp_path):
    from lodestone import catalogue

    rows = [(i, "hot", i, "text" if i % 2 else "image", "s", False) for i in range(201)]
    spark.createDataFrame(rows, "row long, corpus_id string, prop_idx int, modality string, source string, has_image boolean").write.parquet(f"{tmp_path}/meta.parquet")
    spark.createDataFrame([(i, [1.0 + i] + [1.0] * 63) for i in range(201)], "row long, embedding array<float>").write.parquet(f"{tmp_path}/subdoc_vectors.parquet")
    assert {r["n_gold"] for r in catalogue.queries()["m5_per_query"](spark, str(tmp_path)).collect()} == {201}
    recall = catalogue.queries()["m3_recall"](spark, str(tmp_path)).where("k = 20").collect()
    assert {round(r["recall"], 5) for r in recall} == {round(20 / 201, 5)}
