"""Top N in groups; cutting oversized texts."""

import random

import numpy as np
import pytest

from lodestone.llm import chunks as C
from lodestone.llm.topn import standing_runs, top_n


def test_top_n_ties_nulls_copies(spark):
    rows = [("a", i, float(i % 3)) for i in range(9)] * 3 + [("a", 100, None), ("a", 101, float("nan")), (None, 1, 1.0), ("a", None, 9.0), ("b", 1, -1.0)]
    df = spark.createDataFrame([(g, i, s, "x") for g, i, s in rows], "g string, i int, s double, score string")
    got = [tuple(r) for r in top_n(df, "g", "i", "s", 4).orderBy("group_key", "rank_no").collect()]
    assert got == [("a", 2, 2.0, 1), ("a", 5, 2.0, 2), ("a", 8, 2.0, 3), ("a", 1, 1.0, 4), ("b", 1, -1.0, 1)]
    assert top_n(df.limit(0), "g", "i", "s").count() == 0
    with pytest.raises(ValueError):
        top_n(df, "g", "i", "s", 0)


def test_group_limit_on_both_sides(spark):
    df = spark.range(1000).selectExpr("id % 7 AS g", "id AS i", "double(id % 50) AS s")
    plan = top_n(df, "g", "i", "s", 3)._jdf.queryExecution().executedPlan().toString()
    # one limit before copies are folded and one after, each in the map task and behind the shuffle
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") >= 2 and plan.count("Final") >= 2
    assert plan.index("HashAggregate") < plan.rindex("WindowGroupLimit")


def test_standing_runs(spark):
    rows = [("q", "r", 0.1, "2024-01-01 00:00:00"), ("q", "r", 0.9, "2023-01-01 00:00:00"), ("q", "s", float("nan"), "2024-01-01 00:00:00"), ("q", "t", 0.3, None), ("q", "u", 0.2, "2024-01-01 00:00:00"), ("q", "u", 0.4, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "qid string, run_id string, ndcg_at_10 double, written_at string")
    assert {r["run_id"]: r["ndcg_at_10"] for r in standing_runs(df).collect()} == {"r": 0.1, "s": None, "t": 0.3, "u": 0.4}


def walk(text, limit, overlap):
    """The same greedy cutter, one piece after another."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    safe = C.whole_graphemes(codes)
    s = np.where(safe, C.cut_strengths(codes), 0)
    out, start, end = [], 0, 0
    while True:
        if start + limit >= len(text):
            return out + [(start, len(text))]
        first = max(start + limit - 2 * limit // 5, max(end, start + overlap) + 1)
        best = max(range(first, start + limit + 1), key=lambda p: (s[p], p)) if any(s[first : start + limit + 1]) else max((p for p in range(max(end, start + overlap) + 1, start + limit + 1) if safe[p]), default=start + limit)
        out.append((start, best))
        start, end = best - overlap, best


@pytest.mark.parametrize("limit, overlap", [(50, 10), (60, 0), (300, 30)])
def test_pieces(limit, overlap):
    r = random.Random(limit)
    pool = ["word", "longerword", ". ", "! ", "\n", "\n\n", ", ", "。", "猫", " ", "\r\n", "x" * 70, "»", "😀", "e\u0301", "\U0001F468\u200d\U0001F469", "\U0001F1E9\U0001F1EA"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 400))) for _ in range(60)] + ["", "y" * 1000, " " * 500, "a" * limit, "a" * (limit + 1)]
    who, begin, end = C.pieces(texts, limit, overlap)
    for i, t in enumerate(texts):
        got = [(int(b), int(e)) for w, b, e in zip(who, begin, end) if w == i]
        if len(t) <= limit:
            assert not got
            continue
        assert got == walk(t, limit, overlap)
        assert "".join(t[b + (overlap if k else 0) : e] for k, (b, e) in enumerate(got)) == t
        assert all(0 < e - b <= limit for b, e in got)


def test_windows_change_nothing(monkeypatch):
    r = random.Random(9)
    t = "".join(r.choice(["some words here. ", "more\n", "x", " y, "]) for _ in range(3000))
    whole = C.pieces([t], 60, 7)
    monkeypatch.setattr(C, "WINDOW", 500)
    assert all((a == b).all() for a, b in zip(whole, C.pieces([t], 60, 7)))


def test_cuts_at_natural_places():
    t = "First sentence is here. Second one follows it. " * 5
    _, _, end = C.pieces([t], 60, 5)
    assert all(t[e - 2 : e] == ". " for e in end[:-1])


def test_operator(spark):
    df = spark.createDataFrame([("a", "w " * 200, 1), ("a", "w " * 200, 1), ("b", "short", 1), ("c", None, 1), (None, "z" * 900, 1)], "k string, t string, piece int")
    rows = C.split_oversized(df, "k", "t", 100, 10).orderBy("piece_no").collect()
    assert {r["item_key"] for r in rows} == {"a"} and [r["piece_no"] for r in rows] == list(range(len(rows)))
    assert C.split_oversized(df.limit(0), "k", "t", 100, 10).count() == 0
    with pytest.raises(ValueError):
        C.pieces(["x" * 50], 10, 5)


def test_no_cut_inside_a_run_that_has_a_boundary_before_it(spark, monkeypatch):
    r = random.Random(5)
    t = "".join(r.choice(["word ", "two words. ", "x" * 70 + " ", "\n", "y" * 130 + " "]) for _ in range(400))
    df = spark.createDataFrame([("a", t)], "k string, t string")
    rows = C.split_oversized(df, "k", "t", 100, 10).orderBy("piece_no").collect()
    strength = C.cut_strengths(np.frombuffer(t.encode("utf-32-le"), np.uint32))
    assert "".join(x["piece"][10 if k else 0 :] for k, x in enumerate(rows)) == t
    ends, last = [x["end_pos"] for x in rows], 0
    for x in rows[:-1]:
        least = max(last, x["start_pos"] + 10) + 1
        assert strength[x["end_pos"]] or not strength[least : x["start_pos"] + 101].any()
        assert len(x["piece"]) <= 100
        last = x["end_pos"]
    monkeypatch.setattr(C, "WINDOW", 800)
    assert [int(e) for e in C.pieces([t], 100, 10, anywhere=True)[2]] == ends


def test_graphemes_stay_whole():
    unit = "e\u0301\u0323"
    t = unit * 100
    _, begin, end = C.pieces([t], 50, 0)
    assert all(e % 3 == 0 for e in end[:-1]) and len(end) == 7  # 48 characters and a rest
    _, _, end = C.pieces(["a" + "\u0301" * 200], 50, 0)  # one grapheme, longer than a piece
    assert list(end) == [50, 100, 150, 200, 201] or list(end)[:1] == [1]
