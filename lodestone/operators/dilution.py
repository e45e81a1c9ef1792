"""Why a query failed: sentence-level dilution of zero-score queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vector import inner_product, rounded
from lodestone.session import cut

from .encoders import Encoder, HashEncoder, encode
from .items import judgements
from .metrics import per_query
from .retrieval import retrieve

#: Fixed value: a best gold sentence below this is hardly related.
LOW_SIM = 0.35
TOP = 5


def cosine(a: Column, b: Column) -> Column:
    """Cosine as dot / sqrt(|a|^2 |b|^2); null for a zero vector."""
    return F.try_divide(inner_product(a, b), F.sqrt(inner_product(a, a) * inner_product(b, b)))


#: The labels of both classifications and their conditions.
def classify_v1(gold_doc: Column, top_doc: Column, gold_sent: Column, top_sent: Column) -> Column:
    return F.when(gold_sent < LOW_SIM, "C_noise").when((gold_sent > top_sent) & (gold_doc < top_doc), "A_dilution").when(gold_sent < top_sent, "B_misalign").otherwise("other")


def classify_v2(full: Column, sent: Column, top: Column) -> Column:
    return F.when((sent > full) & (sent > top), "dilution_winning").when(sent > full, "dilution_partial").otherwise("no_dilution")


def dilution(zero: DataFrame, run: DataFrame, qrels: DataFrame, corpus: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame, encoder: Encoder, top: int = TOP) -> DataFrame:
    """One row for each zero-score query with both classifications.

    ``zero`` (qid), ``run`` (qid, did, score, rank), ``qrels`` (qid, did), ``corpus`` (did, text), ``query_vecs``
    (qid, qe), ``doc_vecs`` (did, de). Similarities that do not exist are -1. Equal similarities keep the document of
    smaller id and its earlier sentence.
    """
    gold = qrels.join(zero, "qid", "left_semi").select("qid", "did", F.lit(True).alias("gold"), F.lit(None).cast("double").alias("score"))
    ranked = run.join(zero, "qid", "left_semi").where(F.col("rank") <= top).select("qid", "did", F.lit(False).alias("gold"), "score")
    # one row for each pair that is gold, on top or both: everything below is scored once
    pairs = gold.unionByName(ranked).groupBy("qid", "did").agg(F.max("gold").alias("gold"), F.max("score").alias("score"), F.bool_or(~F.col("gold")).alias("top"))
    docs = corpus.join(pairs.select("did").distinct(), "did", "left_semi")
    sents = docs.select("did", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    texts = F.concat_ws("__s", "did", F.col("pos").cast("string"))
    vecs = encode(sents.select(texts.alias("id"), F.col("sentence").alias("text"), F.lit(None).cast("binary").alias("image")), encoder)
    at = F.substring_index("id", "__s", -1)
    parts = vecs.select(F.expr("left(id, length(id) - length(substring_index(id, '__s', -1)) - 3)").alias("did"), at.cast("int").alias("pos"), "embedding")
    asked = pairs.join(query_vecs, "qid")
    scored = asked.join(parts, "did").withColumn("sim", F.coalesce(cosine(F.col("qe"), F.col("embedding")), F.lit(-1.0)))
    # of equal similarities the earlier sentence
    per = scored.groupBy("qid", "did").agg(F.count("*").alias("n"), F.max(F.struct("sim", (-F.col("pos")).alias("p"))).alias("m"))
    whole = asked.join(doc_vecs, "did", "left").select("qid", "did", "gold", "top", "score", F.when(F.col("gold"), cosine(F.col("qe"), F.col("de"))).alias("full"))
    both = whole.join(per, ["qid", "did"], "left").withColumn("sim", F.col("m.sim"))
    best = F.min(F.when(F.col("gold") & F.col("sim").isNotNull(), F.struct((-F.col("sim")).alias("s"), "did", (-F.col("m.p")).alias("pos"))))
    d = both.groupBy("qid").agg(
        F.max("full").alias("gold_doc"), F.max(F.when(F.col("top"), F.col("score"))).alias("top_doc"), F.max(F.when(F.col("gold"), F.col("sim"))).alias("gold_sent"), F.max(F.when(F.col("top"), F.col("sim"))).alias("top_sent"),
        F.sum(F.when(F.col("gold"), F.col("n"))).alias("n_gold_sents"), F.sum(F.when(F.col("top"), F.col("n"))).alias("n_top_sents"), best.alias("b"),
    )
    said = sents.select(F.col("did").alias("best_sent_did"), F.col("pos").alias("best_pos"), F.substring("sentence", 1, 300).alias("best_sent_text"))
    d = zero.select("qid").join(d, "qid", "left").withColumn("best_sent_did", F.col("b.did")).withColumn("best_pos", F.col("b.pos")).drop("b").join(said, ["best_sent_did", "best_pos"], "left").drop("best_pos")
    d = d.fillna(-1.0, ["gold_doc", "gold_sent", "top_doc", "top_sent"]).fillna(0, ["n_gold_sents", "n_top_sents"])
    c = {n: F.col(n) for n in ("gold_doc", "top_doc", "gold_sent", "top_sent")}
    return d.withColumn("class_v1", classify_v1(c["gold_doc"], c["top_doc"], c["gold_sent"], c["top_sent"])).withColumn("class_v2", classify_v2(c["gold_doc"], c["gold_sent"], c["top_doc"]))


# ---------------------------------------------------------------- catalogue: text retrieval with the hash encoder
def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    one = lambda df, p: df.where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text")).select(F.concat(F.lit(p), "id").alias("id"), "text", F.lit(None).cast("binary").alias("image"))
    queries, corpus = spark.read.parquet(f"{sf}/queries.parquet"), spark.read.parquet(f"{sf}/corpus.parquet")
    return one(queries, T.QUERY_PREFIX), one(corpus, T.CORPUS_PREFIX), judgements(spark.read.parquet(f"{sf}/qrels.parquet"), queries)


def _text_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    q, c, rels = _items(spark, sf)
    e = HashEncoder()
    qv, cv = cut(encode(q, e)), cut(encode(c, e))
    return cut(retrieve(qv, cv, 10, cosine=True)), rels, c, qv, cv


def _dilution(spark: SparkSession, sf: str) -> DataFrame:
    run, rels, c, qv, cv = _text_run(spark, sf)
    zero = cut(per_query(run, rels, (10,)).where("ndcg = 0").select("qid"))
    return dilution(zero, run, rels, c.select(F.col("id").alias("did"), "text"), qv.select(F.col("id").alias("qid"), F.col("embedding").alias("qe")), cv.select(F.col("id").alias("did"), F.col("embedding").alias("de")), HashEncoder())


def _four(c: str) -> Column:
    return rounded(F.col(c), 4).alias(c)


_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TEXT_SQL = rf"""
q AS (SELECT 'query-test-' || id AS qid, min(text) AS text FROM queries WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id
), c AS (SELECT 'corpus-test-' || id AS did, min(text) AS text FROM corpus WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id
), s0 AS (
  SELECT did, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13), ''), '([.!?]){_WS}+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ' || chr(9) || '-#*>')), lambda s: length(s) >= 15) AS parts FROM c
), s AS (SELECT did, i - 1 AS pos, parts[i] AS sentence FROM s0, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), unit AS (
  SELECT qid AS id, text FROM q UNION ALL SELECT did, text FROM c UNION ALL SELECT did || '__s' || pos, sentence FROM s
), tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM unit
), slot AS (
  SELECT id, b, sum(v)::BIGINT AS v FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS v FROM tok) GROUP BY id, b HAVING sum(v) <> 0
), n2 AS (SELECT id, sum(v * v)::DOUBLE AS n FROM slot GROUP BY id
), dot AS (
  SELECT x.id AS qid, y.id AS did, sum(x.v * y.v)::DOUBLE AS d FROM slot x JOIN slot y ON x.b = y.b WHERE starts_with(x.id, 'query-') AND starts_with(y.id, 'corpus-') AND NOT contains(y.id, '__s') GROUP BY 1, 2
), sim AS (
  SELECT a.id AS qid, b.id AS did, coalesce(d, 0e0) / sqrt(a.n * b.n) AS score
  FROM n2 a JOIN n2 b ON starts_with(a.id, 'query-') AND starts_with(b.id, 'corpus-') AND NOT contains(b.id, '__s') LEFT JOIN dot ON dot.qid = a.id AND dot.did = b.id
), run AS (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did DESC) AS rank FROM sim QUALIFY rank <= 10
), qrels_ AS (
  SELECT 'query-test-' || query_id AS qid, 'corpus-test-' || corpus_id AS did, max(coalesce(score, 1))::INT AS rel FROM qrels WHERE query_id IN (SELECT id FROM queries WHERE id IS NOT NULL) GROUP BY 1, 2
), zero AS (
  SELECT qid FROM qrels_ LEFT JOIN run USING (qid, did) GROUP BY qid HAVING sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) = 0
), gold AS (SELECT qid, did FROM qrels_ WHERE qid IN (SELECT qid FROM zero)
), need AS (SELECT 'g' AS k, qid, did FROM gold UNION ALL SELECT 't', qid, did FROM run WHERE rank <= 5 AND qid IN (SELECT qid FROM zero)
), sd AS (
  SELECT need.k, need.qid, need.did, s.pos, s.sentence, sum(x.v * y.v)::DOUBLE AS d, any_value(nx.n) AS nq, any_value(ny.n) AS ns
  FROM need JOIN s ON s.did = need.did JOIN n2 nx ON nx.id = need.qid LEFT JOIN n2 ny ON ny.id = s.did || '__s' || s.pos
  LEFT JOIN slot x ON x.id = need.qid LEFT JOIN slot y ON y.id = s.did || '__s' || s.pos AND y.b = x.b GROUP BY ALL
), ss AS (SELECT *, CASE WHEN ns IS NULL THEN -1e0 ELSE coalesce(d, 0e0) / sqrt(nq * ns) END AS sim FROM sd
), gs AS (SELECT qid, max(sim) AS gold_sent, count(*) AS n FROM ss WHERE k = 'g' GROUP BY qid
), ts AS (SELECT qid, max(sim) AS top_sent, count(*) AS n FROM ss WHERE k = 't' GROUP BY qid
), gd AS (SELECT qid, max(score) AS gold_doc FROM gold JOIN sim USING (qid, did) GROUP BY qid
), td AS (SELECT qid, max(score) AS top_doc FROM run WHERE rank <= 5 GROUP BY qid
), bs AS (SELECT qid, did, substring(sentence, 1, 300) AS sentence FROM ss WHERE k = 'g' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did, pos) = 1
), dil AS (
  SELECT z.qid, coalesce(gold_doc, -1e0) AS gold_doc, coalesce(top_doc, -1e0) AS top_doc, coalesce(gold_sent, -1e0) AS gold_sent, coalesce(top_sent, -1e0) AS top_sent, coalesce(gs.n, 0) AS n_gold_sents, coalesce(ts.n, 0) AS n_top_sents, bs.did AS best_sent_did, bs.sentence AS best_sent_text
  FROM zero z LEFT JOIN gs USING (qid) LEFT JOIN ts USING (qid) LEFT JOIN gd USING (qid) LEFT JOIN td USING (qid) LEFT JOIN bs USING (qid)
), cls AS (
  SELECT *, CASE WHEN gold_sent < 0.35 THEN 'C_noise' WHEN gold_sent > top_sent AND gold_doc < top_doc THEN 'A_dilution' WHEN gold_sent < top_sent THEN 'B_misalign' ELSE 'other' END AS class_v1,
    CASE WHEN gold_sent > gold_doc AND gold_sent > top_doc THEN 'dilution_winning' WHEN gold_sent > gold_doc THEN 'dilution_partial' ELSE 'no_dilution' END AS class_v2 FROM dil
)"""
_R4 = lambda c: f"floor({c} * 1.0e4 + 0.5e0) / 1.0e4 AS {c}"

QUERIES = {
    "e1_text_retrieval": lambda spark, sf: _text_run(spark, sf)[0].select("qid", "did", "rank"),
    "q7_dilution_v1": lambda spark, sf: _dilution(spark, sf).select("qid", "class_v1", _four("gold_doc"), _four("top_doc"), _four("gold_sent"), _four("top_sent"), "n_gold_sents", "n_top_sents"),
    "q8_dilution_v2": lambda spark, sf: _dilution(spark, sf).select("qid", "class_v2", _four("gold_doc"), _four("gold_sent"), _four("top_doc"), "best_sent_did", "best_sent_text"),
    "q7_class_counts": lambda spark, sf: _dilution(spark, sf).groupBy("class_v1", "class_v2").agg(F.count("*").alias("n")),
}
SQL = {
    "e1_text_retrieval": f"WITH {TEXT_SQL} SELECT qid, did, rank::INT AS rank FROM run",
    "q7_dilution_v1": f"WITH {TEXT_SQL} SELECT qid, class_v1, {_R4('gold_doc')}, {_R4('top_doc')}, {_R4('gold_sent')}, {_R4('top_sent')}, n_gold_sents, n_top_sents FROM cls",
    "q8_dilution_v2": f"WITH {TEXT_SQL} SELECT qid, class_v2, {_R4('gold_doc')}, {_R4('gold_sent')}, {_R4('top_doc')}, best_sent_did, best_sent_text FROM cls",
    "q7_class_counts": f"WITH {TEXT_SQL} SELECT class_v1, class_v2, count(*) AS n FROM cls GROUP BY 1, 2",
}
