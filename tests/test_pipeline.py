"""End to end: baseline run, caches, reports, sources, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.config import DataConfig, ModelConfig, RunConfig
from lodestone.operators.encoders import HashEncoder
from lodestone.plans.pipelines import baseline
from lodestone.sources import io, reports
from lodestone.streaming.ingest import counts_by_window, file_stream, ingest, ingest_new

IMG = "id string, modality string, text string, image struct<bytes: binary, path: string>"


@pytest.fixture(scope="module")
def tables(spark):
    q = spark.createDataFrame([("1", None, "red fox jumps", None, "Art"), ("2", "text", "blue whale", None, "Biology"), ("3", "text", "nothing", None, None), ("3", "text", "nothing", None, None)], IMG + ", category string")
    c = spark.createDataFrame([("a", None, "a red fox jumps high", None), ("b", "text", "the blue whale", None), ("c", "text", "other things", None), ("c", "text", "other things", None), ("d", "text", None, None)], IMG)
    r = spark.createDataFrame([("1", "a", 1), ("2", "b", None), ("2", "zz", 1), ("9", "a", 1)], "query_id string, corpus_id string, score int")
    d = spark.createDataFrame([("Art", "Art"), ("Biology", "Science")], "category string, coarse_domain string")
    return q, c, r, d


def test_baseline(spark, tables):
    b = baseline(*tables, HashEncoder(256), RunConfig())
    m = {(r["qid"], r["k"]): r for r in b.metrics.collect()}
    assert set(q for q, _ in m) == {"query-test-1", "query-test-2"}
    assert m["query-test-1", 1]["ndcg"] == 1 and m["query-test-2", 10]["recall"] == 0.5
    rep = json.loads(reports.json_report(b.report))
    assert rep["overall"]["all"]["10"]["num_queries"] == 2 and set(rep["coarse"]) == {"Art", "Science"}
    assert "nDCG@10" in reports.console_summary(b.report)
    none = baseline(*tables, HashEncoder(16), RunConfig(data=DataConfig(domains=("Medicine",))))
    assert none.metrics.count() == 0 and none.run.count() == 0


def test_run_id():
    a = RunConfig()
    assert a.run_id() == RunConfig(model=ModelConfig(batch_size=1, instruction="x")).run_id()
    assert a.run_id() != RunConfig(data=DataConfig(max_corpus=5)).run_id()
    assert a.run_id().startswith("baseline-")
    assert RunConfig(data=DataConfig(domains=("B", "a"))).run_id() == RunConfig(data=DataConfig(domains=("a", "B"))).run_id() != a.run_id()


def test_html(spark):
    d = spark.createDataFrame([("t<1>", "x & y" * 200, "A"), ("u", None, None)], "title string, text string, tag string")
    page = reports.html_cases(d, "cases")
    assert "t&lt;1&gt;" in page and "(no text)" in page and len(page) < 2000


def test_sources(spark, tmp_path):
    run = spark.createDataFrame([("q", "d2", 0.5, 2), ("q", "d1", 0.9, 1)], "qid string, did string, score double, rank int")
    io.write_run(run, f"{tmp_path}/run")
    assert {tuple(r) for r in io.read_run(spark, f"{tmp_path}/run").collect()} == {("q", "d1", 0.9, 1), ("q", "d2", 0.5, 2)}
    assert io.read_vectors(spark, f"{tmp_path}/none") is None
    v = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    io.write_vectors(v, f"{tmp_path}/v")
    assert io.read_vectors(spark, f"{tmp_path}/v").collect()[0]["embedding"] == [1.0, 2.0]
    (tmp_path / "log.jsonl").write_text('{"prop_id": "p", "regions": [{"bbox_norm": [[1, 2], 3]}]}\nbroken{\n{"prop_id": "q"}\n')
    rows = {r["prop_id"]: r["regions"] for r in io.read_jsonl(spark, f"{tmp_path}/log.jsonl", io.GROUNDING).collect()}
    assert rows["p"][0]["bbox_norm"].replace(" ", "") == "[[1,2],3]" and rows["q"] is None
    (tmp_path / "run.json").write_text('{"q": {"d1": 0.5, "d2": 1}}')
    assert io.read_run_document(spark, f"{tmp_path}/run.json").count() == 2
    assert io.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/v"]).endswith("/v")
    assert io.drop(spark, f"{tmp_path}/v") and not io.exists(spark, f"{tmp_path}/v")


def test_resume(spark, tmp_path):
    src, sink, mark = (f"{tmp_path}/{n}" for n in ("src", "sink", "mark"))
    spark.range(10).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(src)
    ingest(file_stream(spark, src), sink, mark)
    spark.range(8, 15).withColumn("v", F.col("id") * 2).coalesce(1).write.mode("append").parquet(src)
    ingest(file_stream(spark, src), sink, mark)
    ingest(file_stream(spark, src), sink, mark)
    assert spark.read.parquet(sink).count() == 17  # each source row once
    keyed = f"{tmp_path}/keyed"
    for m in ("m1", "m2"):
        ingest_new(spark, file_stream(spark, src), keyed, f"{tmp_path}/{m}", ["id"], lambda d: d.select("id"))
    assert spark.read.parquet(keyed).count() == 15


def test_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:04:00"), (3, "2024-01-01 00:07:00")], "id int, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(f"{tmp_path}/e")
    out = counts_by_window(file_stream(spark, f"{tmp_path}/e"), "t", "5 minutes", "1 minute")
    q = out.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("wins").collect()) == [1, 2]


def test_cli(spark, tables, tmp_path, capsys):
    from lodestone import cli

    for name, t in zip(("queries", "corpus", "qrels", "domain_map"), tables):
        t.write.parquet(f"{tmp_path}/t/{name}.parquet")
    for extra in ([], [], ["--clear-cache"]):
        cli.main(["baseline", "--tables", f"{tmp_path}/t", "--out", f"{tmp_path}/o", "--top-k", "3", *extra])
    (run,) = os.listdir(f"{tmp_path}/o")
    assert json.load(open(f"{tmp_path}/o/{run}/metrics.json"))["overall"]["all"]["1"]["num_queries"] == 2
    assert "overall" in capsys.readouterr().out


def test_cli_commands(spark, tables, tmp_path, capsys):
    from lodestone import cli

    for name, t in zip(("queries", "corpus", "qrels", "domain_map"), tables):
        t.write.parquet(f"{tmp_path}/t/{name}.parquet")
    spark.createDataFrame([(1, "a", "a_p0", 0, "red fox", True, None, None, None, None)], io.GROUNDING).write.parquet(f"{tmp_path}/t/doc_propositions.parquet")
    t, o = f"{tmp_path}/t", f"{tmp_path}/o"
    cli.main(["baseline", "--tables", t, "--out", o, "--top-k", "3"])
    run = f"{o}/{os.listdir(o)[0]}"
    before = json.load(open(f"{run}/metrics.json"))
    cli.main(["rebuild", "--tables", t, "--run-dir", run, "--top-k", "3"])
    assert json.load(open(f"{run}/metrics.json")) == before
    capsys.readouterr()
    cli.main(["check-cache", "--tables", t, "--run-dir", run, "--top-k", "3"])
    assert "|         0|" in capsys.readouterr().out  # mismatches
    cli.main(["badcases", "--tables", t, "--run-dir", run, "--per-domain", "2"])
    assert "page=" in open(f"{run}/badcases.html").read()
    cli.main(["dilution", "--tables", t, "--run-dir", run])
    cli.main(["build-benchmark", "--tables", t, "--run-dir", run, "--out", f"{tmp_path}/s", "--target", "2"])
    assert json.load(open(f"{tmp_path}/s/stats.json"))["n_gold"] == 2
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/s/corpus.parquet").collect()} == {"a", "b"}
    tables[3].write.parquet(f"{tmp_path}/s/domain_map.parquet")
    cli.main(["subset-baseline", "--tables", f"{tmp_path}/s", "--out", f"{tmp_path}/so"])
    assert "overall" in capsys.readouterr().out
    u = f"{tmp_path}/u"
    for _ in range(2):
        cli.main(["propositions", "--tables", t, "--out", u, "--model", "lodestone.operators.decompose:_echo"])
        cli.main(["ground", "--tables", t, "--out", u, "--model", "lodestone.operators.decompose:_agree"])
    log = io.read_jsonl(spark, f"{u}/grounding", io.GROUNDING)
    assert log.count() == log.select("corpus_id", "prop_idx").distinct().count() == 3
    cli.main(["encode-subdocs", "--tables", t, "--out", u, "--chunk-rows", "2"])
    cli.main(["encode-subdocs", "--tables", t, "--out", u, "--chunk-rows", "2"])
    assert "chunks written: 0" in capsys.readouterr().out
    v = spark.read.parquet(f"{u}/vectors").collect()
    assert sorted(r["global_row"] for r in v) == list(range(len(v))) and len(v) >= 3


def test_pages_and_limits(spark, tmp_path):
    d = spark.createDataFrame([(f"t{i}", "x < y", "A", b"png" if i else None, "g") for i in range(30)], "title string, text string, tag string, image binary, g string")
    index = reports.case_pages(d, f"{tmp_path}/pages", "cases", "g", per_page=10)
    assert index.agg(F.sum("cases")).collect()[0][0] == 30 and index.count() > 1
    page = "".join(r[0] for r in spark.read.text(f"{tmp_path}/pages").collect())
    assert "x &lt; y" in page and page.count("<section>") == 30 and page.count("base64,") == 29
    with pytest.raises(ValueError):
        reports.html_cases(d, "cases", limit=5)
