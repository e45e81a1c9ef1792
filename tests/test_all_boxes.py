"""The region queries over every box of a region, however it is written."""

import pytest

from lodestone import catalogue

LOG = "line_no long, corpus_id string, prop_id string, prop_idx int, regions array<struct<key_visual_entity: string, bbox_norm: string>>"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("boxes"))
    texts = ["[100, 100, 500, 500]", "[[100, 100, 500, 500], [600, 600, 900, 900]]", None, "[[[100], [100], 500, 5e2]]", "[0, 0, 1e30, 10]", "no box"]
    spark.createDataFrame([(1, "c", "c_p0", 0, [None if t is None else ("e", t) for t in texts])], LOG).write.parquet(f"{d}/doc_propositions.parquet")
    return d


def rows(spark, sf, name, *cols):
    return sorted(tuple(r[c] for c in cols) for r in catalogue.queries()[name](spark, sf).collect())


ALL = [(0, 0), (1, 0), (1, 1), (3, 0), (4, 0)]


@pytest.mark.parametrize("name", ["r1_clip_box", "r4_quality", "r8_norm_to_px"])
def test_every_box_enters(spark, sf, name):
    assert rows(spark, sf, name, "region_idx", "box_idx") == ALL


def test_every_pair(spark, sf):
    got = rows(spark, sf, "r2_box_iou", "region_idx", "box_idx", "other_region_idx", "other_box_idx", "iou")
    assert [g[:4] for g in got] == [(*a, *b) for i, a in enumerate(ALL) for b in ALL[i + 1 :]]
    assert {g[:4] for g in got if g[4] == 1} == {(0, 0, 1, 0), (0, 0, 3, 0), (1, 0, 3, 0)}


def test_suppression_filter_union(spark, sf):
    assert rows(spark, sf, "r6_dedup_boxes", "region_idx", "box_idx") == [(0, 0), (1, 1), (4, 0)]
    assert rows(spark, sf, "r3_greedy_nms", "region_idx", "box_idx") == [(0, 0), (1, 1)]
    assert rows(spark, sf, "r5_postprocess", "kept", "removed_small", "removed_slender", "removed_duplicate") == [(2, 1, 0, 2)]
    assert {(r["v"], r["n"]) for r in catalogue.queries()["r17_region_filter"](spark, sf).collect()} == {(None, 4), ("small", 1)}
    assert rows(spark, sf, "r10_union_box", "x1", "y1", "x2", "y2") == [(0, 0, 640, 432)]


def test_clip_beyond_int(spark, sf):
    assert (4, 0, 800) in rows(spark, sf, "r1_clip_box", "region_idx", "box_idx", "x2")
