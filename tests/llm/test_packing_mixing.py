"""Packing and mixing."""

import os
import random
from bisect import bisect_left, insort

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M
from lodestone.llm import packing as P
from lodestone.llm.tokens import VOCABULARY, count_tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")




def brute(sizes, capacity):
    gaps, count = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(gaps, s)
        count += i == len(gaps)
        left = (gaps.pop(i) if i < len(gaps) else capacity) - s
        if left:
            insort(gaps, left)
    return count


def test_sweeps_against_one_by_one(spark):
    r = random.Random(1)
    caps = [(0, 10), (1, 64), (2, 100)]
    rows = [(p, c, i, 0, 0, r.randint(1, c) if i % 3 else r.randint(1, max(1, c // 8))) for p, c in caps for i in range(400)]
    items = spark.createDataFrame(rows, "pack_no int, capacity long, doc_id long, h long, piece_no int, n_tokens long")
    placed, opened = P._fill(items, [(str(p), c) for p, c in caps], 3)
    got = placed.collect()
    assert sorted((x["pack_no"], x["doc_id"]) for x in got) == sorted((x[0], x[2]) for x in rows)
    for p, c in caps:
        load = {}
        for x in got:
            if x["pack_no"] == p:
                load[x["container_id"]] = load.get(x["container_id"], 0) + x["n_tokens"]
        sizes = [x[5] for x in rows if x[0] == p]
        assert max(load.values()) <= c and set(load) <= set(range(opened[p]))
        assert len(load) <= 1.03 * brute(sizes, c) + 1
        assert brute(sizes, c) == P.best_fit({s: sizes.count(s) for s in set(sizes)}, c)


def test_sweep_matches_successors(spark):
    docs = spark.createDataFrame([(0, 100, i, 0, 0, n) for i, n in enumerate([30, 30, 40, 50])], "pack_no int, capacity long, doc_id long, h long, piece_no int, n_tokens long")
    gaps = spark.createDataFrame([(0, 7, 29, 100), (0, 1, 31, 100), (0, 2, 45, 100), (0, 3, 99, 100)], "pack_no int, container_id long, room long, capacity long")
    out = {x["doc_id"]: x["container_id"] for x in P.sweep(docs, gaps, F.lit(30), F.lit(50)).collect()}
    assert out[2] == 2 and out[3] == 3 and sorted([out[0] or 0, out[1] or 0]) == [0, 1]


@needs_vocabulary
def test_pack(spark):
    texts = [(i, "word " * n) for i, n in enumerate([1, 3, 3, 7, 15, 40, 0])] + [(7, None), (7, None), (8, "a b c d e f g " * 30)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, n_tokens int")
    limits = spark.createDataFrame([("s", 16), ("l", 64), ("s", 16), (None, 9), ("x", None), ("y", 0)], "pack_name string, capacity_tokens int")
    rows = P.pack(docs, limits).collect()
    size = dict(zip([i for i, _ in texts], count_tokens([t for _, t in texts])))
    for name, cap in (("s", 16), ("l", 64)):
        mine = [r for r in rows if r["pack_name"] == name]
        load, total = {}, {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            assert size[r["doc_id"]] > cap or r["piece_no"] == 0
        assert total == size and max(load.values()) <= cap
    assert {r["pack_name"] for r in rows} == {"s", "l"}
    report = {r["pack_name"]: r for r in P.fill_report(P.pack(docs, limits), limits).collect()}
    assert report["l"]["used_tokens"] == sum(size.values())
    assert P.pack(docs.limit(0), limits).count() == 0 and P.pack(docs, limits.limit(0)).count() == 0


@needs_vocabulary
def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same size").alias("text"))
    limits = spark.createDataFrame([("s", 5)], "pack_name string, capacity_tokens int")
    n = count_tokens(["same size"])[0]
    load = P.pack(docs, limits).groupBy("container_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in load) == sorted([5 // n] * (100 // (5 // n)))


@needs_vocabulary
def test_mix(spark):
    r = random.Random(3)
    words = {"a": "red green blue", "b": "one two three four", "c": "up down left right"}
    rows = [(i, s, " ".join(r.choice(words[s.strip().lower()].split()) for _ in range(r.randint(5, 60))) + f" {i}") for i, s in enumerate(["a"] * 300 + ["b"] * 150 + [" B "] * 50 + ["c"] * 10 + ["C"] * 5)]
    rows += [(1000, "a", rows[0][2]), (1001, None, "one two three two one"), (1002, "a", None), (1003, "a", ""), (1004, "other", "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 3.0, 1), ("B", 3.0, 2), ("c ", 1.0, 4), ("c", 1.0, 4), ("none", 1.0, 1), ("other", 0.0, 1), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    mixture, shares = M.mix(docs, targets, total_tokens="reachable")
    got = {x["source"]: x for x in shares.collect()}
    for s, share in (("a", 3 / 7), ("b", 3 / 7), ("c", 1 / 7)):
        assert got[s]["target_share"] == pytest.approx(share) and got[s]["actual_share"] == pytest.approx(share, abs=0.03)
    assert got["none"]["tokens"] == got["other"]["tokens"] == 0
    assert got["c"]["max_repeats"] <= 4 and got["b"]["max_repeats"] <= 2 and got["a"]["max_repeats"] <= 1
    m = mixture.collect()
    assert len({x["doc_id"] for x in m}) == len(m) and 1000 not in {x["doc_id"] for x in m}
    _, epoch = M.mix(docs, targets)
    e = {x["source"]: x for x in epoch.collect()}
    assert e["c"]["max_repeats"] == 4 and e["c"]["actual_share"] < 1 / 7  # too small for its share, and said so
    a, b = M.mix(docs.limit(0), targets)
    assert a.count() == 0 and all(x["tokens"] == 0 for x in b.collect())


@needs_vocabulary
def test_registered_mixture_has_its_shares(spark, tmp_path):
    docs = [(i, "big", f"red green blue {i} " * 9) for i in range(600)] + [(1000 + i, "tiny", f"one two three {i} " * 9) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 1.0, 2), ("tiny", 1.0, 2)], "source string, weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    for x in M.QUERIES["p8_shares"](spark, str(tmp_path)).collect():
        assert x["actual_share"] == pytest.approx(x["target_share"], abs=0.02)


def test_projected_gradient(spark):
    import numpy as np

    rows = [(100, 2.0, [1.0, 0.0]), (1000, 1.0, [0.0, 1.0]), (50, 1.0, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "n_tokens long, cap double, p array<float>")
    p, cap, n = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([float(r[0]) for r in rows])
    supply = p.T @ n

    def fitted(target):
        x = M.step_rates(p, cap, M.fit_rates(docs, supply, np.array(target), steps=200, close=1e-6))[0]
        assert (x >= 0).all() and (x <= cap).all()
        return x

    assert p.T @ (fitted([150.0, 300.0]) * n) == pytest.approx([150, 300], rel=1e-3)
    x = fitted([5000.0, 300.0])
    assert x[0] == pytest.approx(2) and x[2] == pytest.approx(1)


@needs_vocabulary
def test_held_sources_and_unlabelled_documents(spark):
    rows = [(i, "a", f"red green blue {i} " * 5) for i in range(200)] + [(500 + i, None, f"red green {i} blue " * 5) for i in range(20)] + [(900, "b", "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 3)], "source string, weight double, max_repeats int")
    mixture, shares = M.mix(docs, targets)
    got = {x["source"]: x for x in shares.collect()}
    assert got["b"]["held_by_cap"] and got["b"]["max_repeats"] == 3 and not got["a"]["held_by_cap"]
    m = mixture.collect()
    assert {x["source"] for x in m if x["doc_id"] >= 500 and x["doc_id"] < 900} == {"a"}
    assert max(x["repeats"] for x in m if x["source"] == "a") <= 2
