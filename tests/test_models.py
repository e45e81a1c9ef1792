"""Pipelines around pluggable models, with stand-ins."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import decompose as D
from lodestone.operators import images as I
from lodestone.operators.encoders import HashEncoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import tests


def answers(prompts):
    return ['["one", "two"' if "cut" in p else "no list" if "odd" in p else "" if "blank" in p else json.dumps([p[-3:]]) for p in prompts]


def test_propositions(spark):
    t = spark.createDataFrame([("b", None, "cut text"), ("a", None, "cut text"), (None, None, "odd text"), (None, None, "blank text"), (None, None, "known"), (None, None, None)], "title string, section string, text string")
    cache = spark.createDataFrame([("known",), ("unused",)], "text string").select(T.text_key(F.lit("document"), F.col("text")).alias("key"), F.array(F.lit("cached")).alias("units"))
    key = {x: r["k"] for x in ("cut text", "odd text", "blank text", "known") for r in spark.range(1).select(T.text_key(F.lit("document"), F.lit(x)).alias("k")).collect()}
    got = {r["key"]: r["units"] for r in D.propositions(t, cache, answers).collect()}
    assert got == {key["cut text"]: ["one", "two"], key["odd text"]: ["no list"], key["blank text"]: ["blank text"], key["known"]: ["cached"]}
    r = D.units_report(D.propositions(t, cache, answers)).collect()[0]
    assert (r["texts"], r["units"]) == (4, 5)


def see(text, image):
    if text == "fail":
        raise RuntimeError("no answer")
    if text == "junk":
        return "not json"
    return json.dumps({"grounded": image is not None, "regions": [{"key_visual_entity": text, "bbox_norm": [[1, 2, 3, 4]]}], "confidence": 0.5})


def test_grounding_resumes_and_records_errors(spark):
    docs = spark.createDataFrame([("c", "t", bytearray(b"x")), ("d", "u", None)], "corpus_id string, text string, image binary")
    units = spark.createDataFrame([("t", ["cat", "fail", "junk", "done"]), ("u", ["dog"])], "text string, units array<string>").select(T.text_key(F.lit("document"), F.col("text")).alias("key"), "units")
    done = spark.createDataFrame([("c", 3)], "corpus_id string, prop_idx int")
    got = {r["prop_id"]: r for r in D.ground(docs, units, done, see).collect()}
    assert set(got) == {"c_p0", "c_p1", "c_p2", "d_p0"}
    assert got["c_p0"]["grounded"] is True and json.loads(got["c_p0"]["regions"][0]["bbox_norm"]) == [[1, 2, 3, 4]]
    assert got["c_p1"]["error"] == "no answer" and got["c_p1"]["grounded"] is None and got["c_p2"]["error"] == "unreadable answer"
    assert got["d_p0"]["grounded"] is False


def test_candidates(spark):
    rows = [("i", 0, 1.9, 0.0, 20.0, 20.0, 400, 0.9), ("i", 1, 1.2, 0.5, 20.0, 20.0, 390, 0.8), ("i", 2, 0.0, 0.0, 5.0, 5.0, 25, 0.9), ("i", 3, 0.0, 0.0, 100.0, 100.0, 9000, 0.9), ("i", 4, 50.0, 50.0, 99.0, 20.0, 500, 0.7)]
    d = spark.createDataFrame(rows, "image string, ordinal int, x double, y double, w double, h double, area int, score double")
    got = [(r["region_id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in D.candidates(d, 100, 100).orderBy("region_id").collect()]
    assert got == [(0, 1, 0, 21, 20), (1, 50, 50, 100, 70)]


def test_match(spark):
    r = spark.createDataFrame([("i", 0, "box", [1.0, 0.0]), ("i", 0, "masked", [1.0, 0.0]), ("j", 0, "box", [0.0, 1.0])], "item string, region_id int, view string, embedding array<double>")
    t = spark.createDataFrame([("i", 0, "a", [0.5, 0.0]), ("i", 1, "b", [0.5, 9.0]), ("j", 0, "c", [0.0, -2.0])], "item string, text_idx int, text string, embedding array<double>")
    got = {x["item"]: x for x in D.match(r, t, logits=True).collect()}
    assert (got["i"]["view"], got["i"]["text"]) == ("masked", "a")
    assert got["j"]["raw_score"] == -2 and got["j"]["score"] == pytest.approx(0.1192, abs=1e-4)


def test_probes(spark):
    p = spark.createDataFrame([("1", "red fox", "red fox\nXX blue sea")], "id string, query string, text string")
    r = D.prefix_probe(p, HashEncoder(512), "XX").collect()[0]
    assert r["sim_prefix"] == pytest.approx(1) and r["sim_full"] == pytest.approx(2 / (2 * 5) ** 0.5) and r["delta"] > 0
    q = D.path_probe(p, HashEncoder(512), HashEncoder(512)).collect()[0]
    assert q["diff"] == 0


def decode(raw):
    if raw == b"bad":
        raise ValueError
    return 3, 4, raw


def test_images(spark):
    d = spark.createDataFrame([("a", None, b"2", b"1"), ("b", None, None, None)], "id string, image binary, `image 2` binary, `image 1` binary")
    got = {r["id"]: r for r in d.select("id", I.first_image(d).alias("f"), F.size(I.all_images(d)).alias("n")).collect()}
    assert bytes(got["a"]["f"]) == b"1" and got["a"]["n"] == 2 and got["b"]["f"] is None and got["b"]["n"] == 0
    e = spark.createDataFrame([("a", b"ok"), ("b", b"bad"), ("c", None)], "id string, bytes binary")
    assert {r["id"]: r["width"] for r in I.decoded(e, decode).collect()} == {"a": 3, "b": None, "c": None}
    size = lambda w, h, *a: tuple(spark.range(1).select(I.resized(F.lit(w), F.lit(h), *a).alias("s")).collect()[0]["s"])
    assert size(4000, 3000) == (2000, 1500) and size(100, 50) == (100, 50) and size(1281, 3, 1280, "round") == (1280, 3) and size(5000, 1, 400) == (400, 1)
    r = spark.range(1).select(I.blur_radius(F.lit(100), F.lit(50), 3.0).alias("a"), I.blur_radius(F.lit(100), F.lit(50), 3.0, 0.2).alias("b")).collect()[0]
    assert (r["a"], r["b"]) == (6.0, 20.0)
