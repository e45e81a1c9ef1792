"""Report sinks (K2, K8, K9, K12): a few rows rendered on the driver. Rows are limited before they are collected."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CASES = 1000
MAX_TEXT = 300


def few(rows: DataFrame, limit: int) -> list:
    """The rows of a report, or an error where there are more than the driver is to hold."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; write them with Spark, or report fewer groups")
    return found


def json_report(metrics: DataFrame, limit: int = 100_000, digits: int = 5) -> str:
    """The metric report as one JSON document {level: {group: {k: {metric: value}}}}, rounded half to even."""
    out: dict = {}
    for r in few(metrics, limit):
        d = {n: round(v, digits) if isinstance(v, float) else v for n, v in r.asDict().items()}
        level, grp, k = d.pop("level"), d.pop("grp"), d.pop("k")
        out.setdefault(level, {}).setdefault(grp, {})[str(k)] = d
    return json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True)


def _block(title: str, text: str | None, tag: str = "") -> str:
    mark = f' <span class="tag">{html.escape(tag)}</span>' if tag else ""
    return f"<section><h2>{html.escape(title)}{mark}</h2><p>{html.escape(text) if text else '(no text)'}</p></section>"


def html_cases(cases: DataFrame, title: str, limit: int = MAX_CASES) -> str:
    """A page of cases (title, text, tag), ordered by title, texts cut to MAX_TEXT characters before the collect.

    More than ``limit`` cases are an error; ``case_pages`` writes any number.
    """
    rows = few(cases.select("title", F.substring("text", 1, MAX_TEXT).alias("text"), "tag").orderBy("title"), limit)
    body = "\n".join(_block(r["title"] or "", r["text"], r["tag"] or "") for r in rows)
    return f'<!doctype html>\n<meta charset="utf-8">\n<title>{html.escape(title)}</title>\n<h1>{html.escape(title)}</h1>\n{body}\n'


def case_pages(cases: DataFrame, path: str, title: str, by: str, per_page: int = 200) -> DataFrame:
    """Pages of any number of cases (title, text, tag, image and the column ``by``), and their index.

    Each value of ``by`` has pages of about ``per_page`` cases, in no fixed order between pages; an image (bytes) becomes
    a picture inside the page. Pages are written as one text file each under path/page=...; the index (page, cases) comes
    back and is written as path/index.html by the caller's ``index_page``.
    """
    n = cases.groupBy(by).agg(F.count("*").alias("n"))
    pages = F.greatest(F.ceil(F.col("n") / per_page), F.lit(1))
    d = cases.join(n, by).withColumn("page", F.concat_ws("-", F.coalesce(F.col(by).cast("string"), F.lit("none")), F.pmod(F.xxhash64("title", "text"), pages).cast("string")))
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    picture = F.when(F.col("image").isNotNull(), F.concat(F.lit('<img width="160" src="data:image;base64,'), F.base64("image"), F.lit('">'))).otherwise("")
    block = F.concat(F.lit("<section><h2>"), esc(F.col("title")), F.lit(' <span class="tag">'), esc(F.col("tag")), F.lit("</span></h2>"), picture, F.lit("<p>"), esc(F.substring("text", 1, MAX_TEXT)), F.lit("</p></section>"))
    body = d.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("title", block.alias("b")))).alias("r"), F.count("*").alias("cases"))  # about per_page cases
    head = F.concat(F.lit(f'<!doctype html>\n<meta charset="utf-8">\n<title>{html.escape(title)} '), esc(F.col("page")), F.lit("</title>\n"))
    body.select(F.concat(head, F.concat_ws("\n", F.transform("r", lambda x: x["b"]))).alias("value"), "page").write.mode("overwrite").partitionBy("page").text(path)
    return body.select("page", "cases")


def index_page(index: DataFrame, title: str, limit: int = 100_000) -> str:
    """Links to the pages of ``case_pages``."""
    rows = few(index.orderBy("page"), limit)
    links = "\n".join(f'<li><a href="page={html.escape(r["page"])}/">{html.escape(r["page"])}</a> ({r["cases"]})</li>' for r in rows)
    return f'<!doctype html>\n<meta charset="utf-8">\n<title>{html.escape(title)}</title>\n<ul>\n{links}\n</ul>\n'


def console_summary(metrics: DataFrame, k: int = 10) -> str:
    """Lines of the overall and coarse means at one cut-off."""
    rows = metrics.where((F.col("k") == k) & F.col("level").isin("overall", "coarse")).orderBy(F.col("level").desc(), "grp")
    rows = few(rows, MAX_CASES)
    return "\n".join(f"{r['level']:8} {r['grp']:20} n={r['num_queries']:<6} nDCG@{k}={r['ndcg']:.4f} MAP={r['map']:.4f} recall={r['recall']:.4f} P={r['precision']:.4f}" for r in rows)
