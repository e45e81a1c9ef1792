"""Boxes and nested records."""

import json

import pytest

from lodestone.operators.flatten import boxes_of, flat_boxes, flat_propositions, flat_regions

LOG = "line_no long, corpus_id string, prop_id string, prop_idx int, text string, grounded boolean, regions array<struct<key_visual_entity: string, bbox_norm: string>>, confidence double, reason string, error string, region_idx int"


@pytest.mark.parametrize(
    "raw, n",
    [
        ("[1,2,3,4]", 1),
        (" [1.5, -2, 3e2, 4] ", 1),
        ("[[1,2,3,4],[5,6,7,8]]", 2),
        ("[[[1,2,3,4]],[[5,6,7,8],[1,2,3,4]]]", 3),
        ("[[1],2,[[3]],4]", 1),
        ("[[1],[2],[3],[4]]", 0),  # all lists: a collection of lists without boxes
        ("[1,2,3]", 0),
        ("[]", 0),
        ("[true,2,3,4]", 0),
        ('["1","2","3","4"]', 0),
        ("[NaN,2,3,4]", 0),
        ("[1,2,3,null]", 0),
        ("{}", 0),
        ("box", 0),
        ("", 0),
        (None, 0),
        ("[900,900,1,1]", 1),
        ("[01,2,3,4]", 0),
        ("[" * 2000 + "]" * 2000, 0),
        ("[" * 100_000 + "[1,2,3,4]" + "]" * 100_000, 1),
        ("[[1,2,3,4],[1,2,3,4]", 0),
        ("[1,2,3,4] [1,2,3,4]", 0),
        ("[1,2,3,4,]", 0),
        ("[[1,2,3,4]5]", 0),
        ('[["a]", 1, 2, 3], [1, 2, 3, 4]]', 1),
        ('[[{"x": [1, 2], "y": {}}, 1, 2, 3], [1, 2, 3, 4]]', 1),
        ('[[{"x"}, 1, 2, 3], [1, 2, 3, 4]]', 0),
    ],
)
def test_boxes(spark, raw, n):
    assert len(boxes_of(raw)) == n
    rows = spark.createDataFrame([(1, "c", "p", 0, None, None, [("e", raw)], None, None, None, 7)], LOG)
    got = flat_boxes(rows).collect()
    assert len([r for r in got if r["box_idx"] >= 0]) == n
    assert len(got) == max(n, 1)


def test_flat_equals_reader(spark):
    for raw in ("[1, 2.5,3,  4]", "[-1,0,1e3,4]"):
        want = json.loads(raw)
        r = flat_boxes(spark.createDataFrame([(1, "c", "p", 0, None, None, [("e", raw)], None, None, None, 7)], LOG)).collect()[0]
        assert [r["x1"], r["y1"], r["x2"], r["y2"]] == want


def test_standing_places_and_links(spark):
    rows = [
        (5, "c", None, 3, "new", True, [None, ("a", "[1,2,3,4]"), ("b", None)], 0.5, None, None, 1),
        (5, "c", None, 3, "new", True, [None, ("a", "[1,2,3,4]"), ("b", None)], 0.5, None, None, 1),  # repeated row
        (4, "c", "c_p3", 3, "old", True, [("z", "[1,2,3,4]")], 0.5, None, None, 1),
        (6, "c", "  ", 4, "none", None, None, None, None, None, 1),
        (7, None, None, None, "lost", None, [("z", "[1,2,3,4]")], None, None, None, 1),
        (8, "d", "d_p0", 0, "empty", True, [], None, None, None, 1),
    ]
    log = spark.createDataFrame(rows, LOG)
    got = {(r["prop_id"], r["region_idx"], r["box_idx"]) for r in flat_boxes(log).collect()}
    assert got == {("c_p3", 1, 0), ("c_p3", 2, -1)}
    props = {r["prop_id"]: (r["text"], r["n_regions"]) for r in flat_propositions(log).collect()}
    assert props == {"c_p3": ("new", 2), "c_p4": ("none", 0), "d_p0": ("empty", 0)}
    assert {(r["region_idx"], r["has_box"]) for r in flat_regions(log).collect()} == {(1, True), (2, False)}


def test_empty(spark):
    assert flat_boxes(spark.createDataFrame([], LOG)).count() == 0
