"""Small fixtures for operators whose twins don't cover every edge."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators.aggregates import finalise, first_by, minmax, sorted_units, stratified_sample
from lodestone.operators.benchmark import build_stats, build_subset
from lodestone.operators.dilution import classify_v1, classify_v2
from lodestone.operators.encoders import HashEncoder, backing_off, encode
from lodestone.operators.metrics import rank_bucket
from lodestone.operators.regions import best_match, suppress
from lodestone.operators.relevance import find_subsequence, grid_shape, positions_of, product_map
from lodestone.operators.retrieval import retrieve
from lodestone.operators.subdocs import build_items
from lodestone.plans.ranking import numbered


def one(spark, col, **values):
    d = spark.range(1)
    for k, v in values.items():
        d = d.withColumn(k, v)
    return d.select(col.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("rank, name", [(1, "1"), (2, "2-5"), (5, "2-5"), (6, "6-10"), (10, "6-10"), (11, "11-50"), (50, "11-50"), (51, "51+"), (None, "miss"), (-1, "miss")])
def test_rank_bucket(spark, rank, name):
    assert one(spark, rank_bucket(F.lit(rank).cast("int"))) == name


@pytest.mark.parametrize(
    "raw, want",
    [
        ('["a", " b "]', ["a", "b"]),
        ('["a", "b"', ["a", "b"]),
        ('["a", "b",', ["a", "b"]),
        ('["a", ""]', ["a"]),
        ("[]", []),
        ("nothing", []),
        ("", []),
        (None, []),
    ],
)
def test_parse_propositions(spark, raw, want):
    assert one(spark, T.parse_propositions(F.lit(raw).cast("string"))) == want


def test_fallback_chain(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, T.propositions_or_text(s('["a"]'), s("c"), s("t"))) == ["a"]
    assert one(spark, T.propositions_or_text(s("raw"), s("c"), s("t"))) == ["raw"]
    assert one(spark, T.propositions_or_text(s(" "), s("c"), s("t"))) == ["c"]
    assert one(spark, T.propositions_or_text(s(None), s(""), s("t"))) == ["t"]
    assert one(spark, T.propositions_or_text(s(None), s(None), s(None))) == []


def test_sentences(spark):
    text = "First sentence here. Second one is here!\r\n\n- # A heading line\nshort.\n> fourteen chars\n"
    assert one(spark, T.sentences(F.lit(text))) == ["First sentence here.", "Second one is here!", "A heading line"][:2] + [x for x in ["A heading line", "fourteen chars"] if len(x) >= 15]


def test_marker_and_ids(spark):
    assert one(spark, T.before_marker(F.lit("ab  \nXX c XX"), "XX")) == "ab"
    assert one(spark, T.before_marker(F.lit("ab"), "XX")) == "ab"
    assert one(spark, T.source_id(F.lit("query-test-a-b"))) == "a-b"
    assert one(spark, T.source_id(F.lit("plain"))) is None
    assert one(spark, T.slug(F.lit("--A/B c__D!"))) == "a-b-c__d"


@pytest.mark.parametrize("args, name", [((0.5, 0.6, 0.3, 0.9), "C_noise"), ((0.5, 0.6, 0.8, 0.7), "A_dilution"), ((0.5, 0.6, 0.5, 0.7), "B_misalign"), ((0.7, 0.6, 0.8, 0.7), "other"), ((-1.0, 0.6, -1.0, 0.7), "C_noise"), ((0.5, 0.6, 0.35, 0.35), "other")])
def test_classes_v1(spark, args, name):
    assert one(spark, classify_v1(*map(F.lit, args))) == name


@pytest.mark.parametrize("args, name", [((0.5, 0.8, 0.7), "dilution_winning"), ((0.5, 0.6, 0.7), "dilution_partial"), ((0.5, 0.5, 0.1), "no_dilution"), ((-1.0, -1.0, 0.7), "no_dilution")])
def test_classes_v2(spark, args, name):
    assert one(spark, classify_v2(*map(F.lit, args))) == name


def py_iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u else 0.0


def test_suppress_against_a_loop(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        boxes = []
        for o in range(25):
            x, y = rng.integers(0, 40, 2)
            boxes.append((float(rng.integers(0, 5)), o, int(x), int(y), int(x + rng.integers(5, 40)), int(y + rng.integers(5, 40))))
        kept, dup = [], 0
        for b in sorted(boxes, key=lambda b: (-b[0], b[1])):
            if len(kept) >= 10:
                break
            if any(py_iou(k[2:], b[2:]) >= 0.4 for k in kept):
                dup += 1
            else:
                kept.append(b)
        d = spark.createDataFrame([(boxes,)], "r array<struct<s: double, ordinal: int, x1: int, y1: int, x2: int, y2: int>>")
        n = d.select(suppress(F.col("r"), 0.4, 10).alias("n")).collect()[0]["n"]
        assert [tuple(k) for k in n["kept"]] == kept and n["duplicates"] == dup
    assert d.select(suppress(F.slice("r", 1, 0)).alias("n")).collect()[0]["n"]["kept"] == []


def test_geometry(spark):
    b = lambda *v: G.box(*map(F.lit, v))
    assert tuple(one(spark, G.norm_to_pixels(b(500.0, 0.0, 100.0, 1200.0), 100, 50))) == (10, 0, 50, 50)
    assert tuple(one(spark, G.norm_to_pixels(b(1000.0, 10.0, 1000.0, 10.0), 100, 100))) if False else one(spark, G.norm_to_pixels(b(1000.0, 10.0, 1000.0, 10.0), 100, 100)) is None
    assert tuple(one(spark, G.norm_to_pixels(b(10.0, 10.0, 10.0, 10.0), 100, 100))) == (1, 1, 2, 2)
    assert tuple(one(spark, G.clip_xywh(*map(F.lit, (2.5, -3.0, 10.0, 400.0)), 10, 20))) == (2, 0, 10, 20)
    assert tuple(one(spark, G.clip_xywh(*map(F.lit, (2.9, 0.0, 1.0, 1.0)), 10, 20, "truncate"))) == (2, 0, 3, 1)
    assert one(spark, G.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    m = lambda v: F.array(*map(F.lit, v))
    assert one(spark, G.mask_iou(m([True, True, False]), m([True, False, False]))) == 0.5
    assert tuple(one(spark, G.union_box(F.array(b(1, 2, 3, 4), b(0, 3, 2, 9))))) == (0, 2, 3, 9)
    assert tuple(one(spark, G.widened(b(10, 10, 20, 20), 0.25, 21, 100))) == (8, 8, 21, 22)


def test_tokens_and_maps(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, find_subsequence(a(1, 2, 3, 2, 3), a(2, 3))) == 1
    assert one(spark, find_subsequence(a(1, 2), a(3))) is None
    assert one(spark, find_subsequence(a(1), a(1, 2))) is None
    assert one(spark, find_subsequence(a(1, 2), F.array().cast("array<int>"))) is None
    assert one(spark, positions_of(a(5, 1, 5), F.lit(5))) == [0, 2]
    assert one(spark, product_map(F.array(a(0.0, 1.0, 2.0), a(4.0, 4.0, 4.0)))) == [0.0, 0.0, 0.0]
    assert one(spark, product_map(F.array(a(0.0, 1.0, 2.0), a(0.0, 4.0, 2.0)))) == [0.0, 0.5, 0.5]
    i = F.lit
    assert tuple(one(spark, grid_shape(i(6), i(1), i(4), i(6)))) == (2, 3)
    assert tuple(one(spark, grid_shape(i(24), i(1), i(4), i(6)))) == (4, 6)
    assert one(spark, grid_shape(i(7), i(1), i(4), i(6))) is None
    assert tuple(one(spark, grid_shape(i(17), i(None).cast("int"), i(None).cast("int"), i(None).cast("int")))) == (4, 4)


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(x).cast("float") for x in v])
    assert one(spark, V.l2_normalised(a(3, 4))) == [0.6, 0.8]
    assert one(spark, V.l2_normalised(a(0, 0))) is None
    assert [one(spark, V.usable(x, 2)) for x in (a(1, 2), a(1), a(0, 0), a(float("nan"), 1), a(float("inf"), 1), a(None, 1), F.lit(None).cast("array<float>"))] == [True, False, False, False, False, False, False]


def test_retrieve_both_ways(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(200, 8)), 1)
    x[7] = x[3]  # a tie
    d = spark.createDataFrame([(f"d{i:03d}", [float(v) for v in r], 1) for i, r in enumerate(x)] + [("bad", [1.0], 1), (None, [1.0] * 8, 1), ("nan", [float("nan")] * 8, 1)], "id string, embedding array<double>, score int")
    q = d.where("id < 'd020'")
    small = {(r["qid"], r["rank"]): r["did"] for r in retrieve(q, d, 5, dim=8).collect()}
    blocks = {(r["qid"], r["rank"]): r["did"] for r in retrieve(q, d, 5, dim=8, tiles=4, closure_bytes=64).collect()}
    want = {}
    for i in range(20):
        s = [sum(float(a) * float(b) for a, b in zip(x[i], r)) for r in x]
        for k, j in enumerate(sorted(range(200), key=lambda j: (s[j], f"d{j:03d}"), reverse=True)[:5]):
            want[f"d{i:03d}", k + 1] = f"d{j:03d}"
    assert small == want and blocks == want
    assert retrieve(q.limit(0), d, 5, dim=8).count() == 0
    assert retrieve(q, d.limit(0), 5, dim=8).count() == 0


def test_numbered_and_finalise(spark):
    d = spark.createDataFrame([("a", i, f"x{i}") for i in range(50)] + [("b", 5, "y"), (None, 1, "z")], "g string, i int, v string")
    got = {(r["g"], r["v"]): r["pos"] for r in numbered(d, ["g"], F.col("i"), F.floor(F.col("i") / 7)).collect()}
    assert got == {**{("a", f"x{i}"): i for i in range(50)}, ("b", "y"): 0, (None, "z"): 0}
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (2, 0, "c"), (3, 0, "d")], "chunk_idx int, pos int, v string")
    chunks = spark.createDataFrame([(0, 1, 9), (0, 2, 2), (1, 3, 1), (2, 4, 1), (3, 5, 2)], "chunk_idx int, line_no int, n int")
    assert {(r["v"], r["global_row"]) for r in finalise(chunks, rows).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    s = spark.createDataFrame([("c", "c_p1", 1), ("c", "c_p0", 0), ("c", "c_p0", 0), (None, "n", 1)], "corpus_id string, prop_id string, prop_idx int")
    assert {(r["prop_id"], r["pos"]) for r in sorted_units(s).collect()} == {("c_p0", 0), ("c_p1", 1)}


def test_samples_and_minmax(spark):
    d = spark.createDataFrame([("A", f"q{i}", 0.0) for i in range(3)] + [("A", "q8", 0.5), ("A", "q9", 0.2), ("B", "q7", 0.9)], "g string, k string, s double")
    got = stratified_sample(d, "g", "s", "k", 4).collect()
    assert {r["k"] for r in got} == {"q0", "q1", "q2", "q9", "q7"}
    m = {r["k"]: r["scaled"] for r in minmax(d, "g", "s").collect()}
    assert m["q8"] == 1.0 and m["q0"] == 0.0 and m["q7"] == 0.0
    assert first_by(d, ["g"], [F.col("s").desc()]).count() == 2


def test_benchmark(spark):
    run = spark.createDataFrame([("q", "d1", 0.9), ("q", "d2", -0.4), ("q", "d3", 0.5), ("p", "d3", 0.7), ("q", "gone", 1.0)], "qid string, did string, score double")
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d9", 0), ("p", "gone", 1)], "qid string, did string, rel int")
    docs = spark.createDataFrame([(f"d{i}", i == 6) for i in range(1, 10)] + [("d1", False)], "did string, has_image boolean")
    s = build_subset(run, qrels, docs, 4)
    assert {(r["did"], r["reason"]) for r in s.collect()} == {("d1", "gold"), ("d3", "hard_negative"), ("d2", "hard_negative"), ("d6", "fill")}
    st = build_stats(s, qrels, docs).collect()[0]
    assert (st["n_gold"], st["n_hard_negative"], st["n_fill"], st["with_image"], st["qrels_kept"], st["qrels_dropped"], st["queries_lost"]) == (1, 2, 1, 1, 1, 2, 1)
    assert {r["reason"] for r in build_subset(run, qrels, docs, 0).collect()} == {"gold"}


class Tight(HashEncoder):
    def encode(self, texts, images):
        if len(texts) > 2 or images[0] is not None:
            raise MemoryError
        return super().encode(texts, images)


def test_encoder_backs_off(spark):
    v = backing_off(Tight(16), ["a b", "c", "a b", None, "d"], [None, None, None, None, b"x"])
    assert v.shape == (5, 16) and (v[0] == v[2]).all() and not v[3].any()
    d = spark.createDataFrame([("1", "Ab ab", None), ("2", None, None)], "id string, text string, image binary")
    got = {r["id"]: r["embedding"] for r in encode(d, HashEncoder(8)).collect()}
    assert sum(abs(x) for x in got["1"]) == 2 and not any(got["2"])


def test_subdoc_labels(spark):
    docs = spark.createDataFrame([("img", "t", True), ("txt", "some text", False), ("cached", "c", False), ("blank", " ", False)], "corpus_id string, text string, has_image boolean")
    box, bad = [("e", "[1,2,300,400]")], [("e", "junk")]
    log = spark.createDataFrame(
        [(1, "img", "img_p0", 0, "a", True, box), (2, "img", "img_p1", 1, "b", True, bad), (3, "img", "img_p2", 2, "c", True, []), (4, "img", "img_p3", 3, "d", None, box), (5, "img", "img_p4", 4, " ", False, None)],
        "line_no long, corpus_id string, prop_id string, prop_idx int, text string, grounded boolean, regions array<struct<key_visual_entity: string, bbox_norm: string>>",
    )
    units = docs.where("corpus_id = 'cached'").select(T.text_key(F.lit("document"), F.col("text")).alias("key"), F.array(F.lit("u0"), F.lit("u1")).alias("units"))
    for mode, labels in (("text", ["grounded_crop", "grounded_box_invalid", "grounded_degraded_text", "ungrounded_text"]), ("wholeimage", ["grounded_crop", "grounded_box_invalid", "grounded_no_region_wholeimg", "ungrounded_wholeimg"])):
        got = {r["prop_id"]: r for r in build_items(docs, log, units, ungrounded=mode).collect()}
        assert [got[f"img_p{i}"]["source"] for i in range(4)] == labels
        assert got["img_p0"]["modality"] == "image,text" and got["img_p1"]["modality"] == "text"
        assert ("img_p4" in got) == (mode == "wholeimage")
        assert got["cached_p1"]["source"] == "textdoc_prop" and got["txt_pwhole"]["prop_idx"] == -1
        assert "blank_pwhole" not in got


def test_best_match(spark):
    d = spark.createDataFrame([("i", "r1", "context", 0, 0.9), ("i", "r2", "masked", 1, 0.9), ("i", "r0", "masked", 0, 0.8)], "item string, region_id string, view string, text_idx int, score double")
    assert best_match(d, ["item"]).collect()[0]["region_id"] == "r2"
    assert math.isclose(best_match(d, ["item", "region_id"]).count(), 3)
