"""Projections and predicates over queries, corpus and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.ranking import picked

#: Instruction constant and default modality of items.
DEFAULT_MODALITY = "image,text"
#: Domains by parts of an id or column, in order of precedence.
DOMAIN_PARTS = {
    "Medicine": ["Clinical_Medicine", "Basic_Medical_Science", "Diagnostics_and_Laboratory_Medicine", "Pharmacy"],
    "Science": ["Biology", "Chemistry", "Agriculture", "Geography", "Physics", "Math", "Materials"],
    "Art": ["Art_Theory", "Design", "Music", "Art"],
    "Humanities": ["History", "Psychology", "Sociology", "Literature"],
}
#: Id parts that stand for a domain in a search by domain.
SEARCH_PARTS = {
    "Science": ["Agriculture", "Geography", "Chemistry", "Biology"],
    "Medicine": ["Diagnostics", "Clinical_Medicine", "Basic_Medical", "Pharmacy", "Diagnostics_and_Laboratory"],
}


def with_domain(items: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds coarse_domain by category; Unknown where the category is null or not listed. The optimiser sizes the join."""
    known = domains.select("category", F.col("coarse_domain").alias("__d")).dropDuplicates(["category"])
    return items.join(known, "category", "left").withColumn("coarse_domain", F.coalesce("__d", F.lit("Unknown"))).drop("__d")


def query_items(queries: DataFrame, domains: DataFrame, instruction: str = "") -> DataFrame:
    """Query rows as items: prefixed id, default modality, coarse domain; repeated rows once. The image stays a column."""
    q = with_domain(queries.select("id", "modality", "text", "category").where(F.col("id").isNotNull()).distinct(), domains)
    return q.select(F.concat(F.lit(T.QUERY_PREFIX), "id").alias("id"), F.col("id").alias("source_id"), "text", F.coalesce("modality", F.lit(DEFAULT_MODALITY)).alias("modality"), "category", "coarse_domain", F.lit(instruction).alias("instruction"))


def corpus_items(corpus: DataFrame) -> DataFrame:
    """Corpus rows as items."""
    c = corpus.select("id", "modality", "text").where(F.col("id").isNotNull()).distinct()
    return c.select(F.concat(F.lit(T.CORPUS_PREFIX), "id").alias("id"), F.col("id").alias("source_id"), "text", F.coalesce("modality", F.lit(DEFAULT_MODALITY)).alias("modality"))


def judgements(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, did, rel) of known queries, ids prefixed, missing grade 1, one row for each pair (the highest grade)."""
    known = qrels.join(queries.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_semi")
    rel = F.coalesce(F.col("score").cast("int"), F.lit(1))
    return known.groupBy(F.concat(F.lit(T.QUERY_PREFIX), "query_id").alias("qid"), F.concat(F.lit(T.CORPUS_PREFIX), "corpus_id").alias("did")).agg(F.max(rel).alias("rel"))


def modality_pair(modality: Column, text: Column, image: Column) -> tuple[Column, Column]:
    """(text, image) that an encoder gets: an image item has no text, a text item no image."""
    return F.when(modality == "image", None).otherwise(text), F.when(modality == "text", None).otherwise(image)


def effective_modality(text: Column, has_image: Column) -> Column:
    """Modality by content; null where there is neither text nor image."""
    some = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "") != ""
    return F.when(some & has_image, F.lit("image,text")).when(some, F.lit("text")).when(has_image, F.lit("image"))


def has_any(columns: list[Column]) -> Column:
    return F.coalesce(*columns).isNotNull()


def domain_by_parts(item_id: Column) -> Column:
    """First domain one of whose parts occurs in the id, else Other. Case counts."""
    body = F.replace(F.replace(item_id, F.lit("test_"), F.lit("")), F.lit("validation_"), F.lit(""))
    out = None
    for domain, parts in DOMAIN_PARTS.items():
        hit = body.contains(parts[0])
        for p in parts[1:]:
            hit = hit | body.contains(p)
        out = F.when(hit, F.lit(domain)) if out is None else out.when(hit, F.lit(domain))
    return out.otherwise(F.lit("Other"))


def matches_domain(item_id: Column, domain: Column, wanted: list[str]) -> Column:
    """Domain column contains a wanted domain, or the id one of its parts; case does not count."""
    parts = [p for d in wanted for p in SEARCH_PARTS.get(d, [d])]
    hit = F.lit(False)
    for d in wanted:
        hit = hit | F.lower(F.coalesce(domain, F.lit(""))).contains(d.lower())
    for p in parts:
        hit = hit | F.lower(item_id).contains(p.lower())
    return hit


def at_positions(items: DataFrame, order: list[Column], wanted: list[int]) -> DataFrame:
    """Rows at the wanted 0-based positions of the ordered items; positions out of range are skipped."""
    return picked(items, order, wanted)


def corpus_row(corpus: DataFrame, item_id: str) -> DataFrame:
    """The corpus row of an id, or an error where there is none or it has no image."""
    row = corpus.where(F.col("id") == item_id).orderBy(F.col("image").isNull()).limit(1)
    found = row.select((F.col("image.bytes").isNotNull() | F.col("image.path").isNotNull()).alias("image")).collect()
    if not found:
        raise LookupError(f"no corpus row {item_id!r}")
    if not found[0]["image"]:
        raise LookupError(f"corpus row {item_id!r} has no image")
    return row


def count_corpus(corpus: DataFrame) -> int:
    """Number of different corpus ids."""
    return corpus.select("id").where("id IS NOT NULL").distinct().count()


def first_items(items: DataFrame, n: int | None, order: str = "id") -> DataFrame:
    """The first ``n`` items by ``order`` (all without a number): a top-n, not a sort."""
    return items if n is None else items.orderBy(order).limit(n)


def judged_items(qrels: DataFrame, predicted: DataFrame) -> DataFrame:
    """Judgements of the queries that have predictions."""
    return qrels.join(predicted.select("qid").distinct(), "qid", "left_semi")


def id_prefix(ids: DataFrame, candidates: list[str], col: str = "id") -> str:
    """The prefix that the ids of a table carry: the first of ``candidates`` that its least id starts with, or none.

    One row decides, as all ids of a table are written alike; the least one, so that every layout gives the same.
    """
    least = ids.agg(F.min(col)).collect()[0][0]
    return next((p for p in candidates if least is not None and least.startswith(p)), "")


def gold_set(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """corpus ids judged relevant (score >= 1) that exist."""
    return qrels.where("score >= 1").select("corpus_id").distinct().join(corpus.select(F.col("id").alias("corpus_id")).distinct(), "corpus_id", "left_semi")


def orphans(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements of documents that do not exist."""
    return qrels.distinct().join(corpus.select(F.col("id").alias("corpus_id")).distinct(), "corpus_id", "left_anti")


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work left after a resume, by key."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _corpus_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "corpus").select("id", "modality", "text", (F.col("image.bytes").isNotNull() | F.col("image.path").isNotNull()).alias("has_image")).distinct()


_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_C = "c AS (SELECT DISTINCT id, modality, text, (image.bytes IS NOT NULL OR image.path IS NOT NULL) AS has_image FROM corpus)"
_DOMAIN_CASE = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(b, '{p}')" for p in parts)} THEN '{d}'" for d, parts in DOMAIN_PARTS.items()) + " ELSE 'Other' END"

_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Options of a query as a list: read as JSON, else closed after the last quote; tables o (all columns, parsed).
_PARSED = f"""c AS (
  SELECT *, CASE WHEN starts_with(options, '[') THEN regexp_replace(regexp_replace(options, '\\s+$', ''), ',$', '') END AS cut FROM queries
), r AS (
  SELECT *, CASE WHEN ends_with(cut, ']') THEN cut WHEN instr(cut, '"') > 1 THEN substr(cut, 1, length(cut) - instr(reverse(cut), '"') + 1) || ']' ELSE cut || '"]' END AS closed FROM c
), j AS (
  SELECT *, CASE WHEN json_valid(options) AND json_type(CASE WHEN json_valid(options) THEN options::JSON END) = 'ARRAY' THEN options::JSON WHEN json_valid(closed) THEN closed::JSON END AS doc FROM r
), o AS (
  SELECT *, coalesce(list_filter(list_transform(doc ->> '$[*]', lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''), []) AS parsed FROM j
)"""
_BLANK = lambda c: f"CASE WHEN regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g') <> '' THEN {c} END"

QUERIES = {
    "s5_count_corpus": lambda spark, sf: spark.createDataFrame([(count_corpus(_t(spark, sf, "corpus")),)], "n bigint"),
    "s16_corpus_row": lambda spark, sf: corpus_row(_t(spark, sf, "corpus"), _t(spark, sf, "corpus").where("image.path IS NOT NULL").agg(F.min("id")).collect()[0][0]).select("id"),
    "f7_id_prefix": lambda spark, sf: spark.createDataFrame([(id_prefix(_t(spark, sf, "per_query"), [T.CORPUS_PREFIX, T.QUERY_PREFIX], "qid"),)], "prefix string"),
    "sel7_predicted_qrels": lambda spark, sf: judged_items(judgements(_t(spark, sf, "qrels"), _t(spark, sf, "queries")), _t(spark, sf, "per_query")).select("qid", "did", "rel"),
    "w7_first_items": lambda spark, sf: first_items(_t(spark, sf, "corpus").where("id IS NOT NULL").select("id").distinct(), 50),
    "sel1_query_items": lambda spark, sf: query_items(_t(spark, sf, "queries"), _t(spark, sf, "domain_map")).drop("instruction"),
    "sel2_corpus_items": lambda spark, sf: corpus_items(_t(spark, sf, "corpus")),
    "sel3_domain_filter": lambda spark, sf: query_items(_t(spark, sf, "queries"), _t(spark, sf, "domain_map")).where(F.col("coarse_domain").isin("Art", "Medicine")).select("id", "coarse_domain"),
    "sel4_coarse_domain": lambda spark, sf: with_domain(_t(spark, sf, "documents").select("doc_id", "category"), _t(spark, sf, "domain_map")).groupBy("coarse_domain").agg(F.count("*").alias("n")),
    "sel5_qrels": lambda spark, sf: judgements(_t(spark, sf, "qrels"), _t(spark, sf, "queries")),
    "sel6_queries_with_qrels": lambda spark, sf: _t(spark, sf, "queries").select("id").distinct().join(_t(spark, sf, "qrels").select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"),
    "sel8_zero_score": lambda spark, sf: _t(spark, sf, "per_query").where("ndcg_at_10 = 0").select("qid", "run_id", "written_at").distinct(),
    "sel9_modality_pair": lambda spark, sf: _corpus_text(spark, sf).select("id", *(c.alias(n) for c, n in zip(modality_pair(F.coalesce("modality", F.lit(DEFAULT_MODALITY)), F.col("text"), F.col("has_image")), ("enc_text", "enc_image")))),
    "sel10_effective_modality": lambda spark, sf: _corpus_text(spark, sf).select("id", effective_modality(F.col("text"), F.col("has_image")).alias("eff")).where("eff IS NOT NULL"),
    "sel11_has_image": lambda spark, sf: _corpus_text(spark, sf).select("id", F.coalesce("modality", F.lit("")).contains("image").alias("says"), F.col("has_image").alias("has")),
    "sel13_domain_match": lambda spark, sf: _t(spark, sf, "meta").select("row", "corpus_id").distinct().where(matches_domain(F.col("corpus_id"), F.lit(None).cast("string"), ["Science", "Medicine"])).select("row", "corpus_id"),
    "sel14_positional_pick": lambda spark, sf: at_positions(_t(spark, sf, "corpus").select("id").distinct(), [F.col("id")], [0, 3, 17, 10_000_000]).select("id", F.col("pos").cast("bigint").alias("pos")),
    "sel19_truncated_text": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", F.substring("text", 1, 300).alias("head")),
    "sel20_marker_prefix": lambda spark, sf: _t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.before_marker(F.col("text"), "\n\n").alias("head")),
    "sel21_orphan_qrels": lambda spark, sf: orphans(_t(spark, sf, "qrels"), _t(spark, sf, "corpus")).select("query_id", "corpus_id", "score"),
    "sel22_gold_set": lambda spark, sf: gold_set(_t(spark, sf, "qrels"), _t(spark, sf, "corpus")),
    "sel23_not_done": lambda spark, sf: not_done(_t(spark, sf, "meta").select("prop_id").where("prop_id IS NOT NULL").distinct(), _t(spark, sf, "doc_propositions").where("grounded"), ["prop_id"]),
    "j7_docs_grounding": lambda spark, sf: _t(spark, sf, "corpus").select(F.col("id").alias("corpus_id")).distinct().join(_t(spark, sf, "doc_propositions").select("corpus_id", "line_no").distinct().groupBy("corpus_id").agg(F.count("*").alias("lines")), "corpus_id", "left").select("corpus_id", F.coalesce("lines", F.lit(0)).alias("lines")),
    "u1_union": lambda spark, sf: _t(spark, sf, "qrels").select("corpus_id").union(_t(spark, sf, "meta").select("corpus_id")).distinct(),
    "u2_intersect": lambda spark, sf: _t(spark, sf, "qrels").select("corpus_id").intersect(_t(spark, sf, "corpus").select("id")),
    "u3_except": lambda spark, sf: _t(spark, sf, "qrels").select("corpus_id").subtract(_t(spark, sf, "corpus").select("id")),
    "f1_split_sentences": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")),
    "f2_slugify": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", T.slug(F.col("source")).alias("slug")),
    "f4_md5_key": lambda spark, sf: _t(spark, sf, "corpus").select("id", T.text_key(F.lit("document"), F.col("text")).alias("key")).distinct(),
    "f5_source_id": lambda spark, sf: _t(spark, sf, "per_query").select("qid", T.source_id(F.col("qid")).alias("src")).distinct(),
    "f6_strip_prefix": lambda spark, sf: _t(spark, sf, "per_query").select("qid", T.bare_id(F.col("qid")).alias("bare")).distinct(),
    "f10_prompt": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", T.proposition_prompt(F.col("source"), F.col("category"), F.col("text")).alias("prompt")),
    "f11_taxonomy": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", domain_by_parts(F.coalesce("category", F.lit(""))).alias("domain")),
    "f15_html_escape": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", T.html_escape(F.col("text")).alias("html")),
    "f22_base64": lambda spark, sf: _t(spark, sf, "corpus").select("id", F.base64("image.bytes").alias("b64")).distinct(),
    "f8_parse_propositions": lambda spark, sf: _t(spark, sf, "queries").select("id", F.posexplode(T.parse_propositions(F.col("options"))).alias("pos", "option")).distinct(),
    "f9_fallback_chain": lambda spark, sf: _t(spark, sf, "queries").select("id", F.posexplode(T.propositions_or_text(F.col("options"), F.col("answer"), F.col("text"))).alias("pos", "unit")).distinct(),
}
SQL = {
    "f8_parse_propositions": f"WITH {_PARSED} SELECT DISTINCT id, (i - 1)::INT AS pos, parsed[i] AS option FROM o, LATERAL (SELECT unnest(range(1, len(parsed) + 1)) AS i)",
    "f9_fallback_chain": f"""WITH {_PARSED}, u AS (SELECT id, CASE WHEN len(parsed) > 0 THEN parsed ELSE [coalesce({_BLANK('options')}, {_BLANK('answer')}, text)] END AS units FROM o)
SELECT DISTINCT id, (i - 1)::INT AS pos, units[i] AS unit FROM u, LATERAL (SELECT unnest(range(1, len(units) + 1)) AS i) WHERE units[i] IS NOT NULL""",
    "s5_count_corpus": "SELECT count(DISTINCT id) AS n FROM corpus",
    "s16_corpus_row": "SELECT min(id) AS id FROM corpus WHERE image.path IS NOT NULL",
    "f7_id_prefix": "SELECT CASE WHEN starts_with(min(qid), 'corpus-test-') THEN 'corpus-test-' WHEN starts_with(min(qid), 'query-test-') THEN 'query-test-' ELSE '' END AS prefix FROM per_query",
    "sel7_predicted_qrels": """SELECT 'query-test-' || query_id AS qid, 'corpus-test-' || corpus_id AS did, max(coalesce(score, 1))::INT AS rel FROM qrels
WHERE query_id IN (SELECT id FROM queries WHERE id IS NOT NULL) AND 'query-test-' || query_id IN (SELECT qid FROM per_query) GROUP BY 1, 2""",
    "w7_first_items": "SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL ORDER BY id LIMIT 50",
    "sel1_query_items": """SELECT DISTINCT 'query-test-' || id AS id, id AS source_id, text, coalesce(modality, 'image,text') AS modality, q.category, coalesce(coarse_domain, 'Unknown') AS coarse_domain FROM queries q LEFT JOIN domain_map d ON q.category = d.category WHERE id IS NOT NULL""",
    "sel2_corpus_items": "SELECT DISTINCT 'corpus-test-' || id AS id, id AS source_id, text, coalesce(modality, 'image,text') AS modality FROM corpus WHERE id IS NOT NULL",
    "sel3_domain_filter": "SELECT DISTINCT ON (id, text, modality, q.category) 'query-test-' || id AS id, coarse_domain FROM queries q JOIN domain_map d ON q.category = d.category WHERE coarse_domain IN ('Art', 'Medicine') AND id IS NOT NULL",
    "sel4_coarse_domain": "SELECT coalesce(coarse_domain, 'Unknown') AS coarse_domain, count(*) AS n FROM documents q LEFT JOIN domain_map d ON q.category = d.category GROUP BY 1",
    "sel5_qrels": "SELECT 'query-test-' || query_id AS qid, 'corpus-test-' || corpus_id AS did, max(coalesce(score, 1))::INT AS rel FROM qrels WHERE query_id IN (SELECT id FROM queries WHERE id IS NOT NULL) GROUP BY 1, 2",
    "sel6_queries_with_qrels": "SELECT DISTINCT id FROM queries WHERE id IN (SELECT query_id FROM qrels WHERE query_id IS NOT NULL)",
    "sel8_zero_score": "SELECT DISTINCT qid, run_id, written_at FROM per_query WHERE ndcg_at_10 = 0",
    "sel9_modality_pair": f"WITH {_C}, d AS (SELECT id, coalesce(modality, 'image,text') AS modality, text, has_image FROM c) SELECT id, CASE WHEN modality = 'image' THEN NULL ELSE text END AS enc_text, CASE WHEN modality = 'text' THEN NULL ELSE has_image END AS enc_image FROM d",
    "sel10_effective_modality": rf"WITH {_C}, d AS (SELECT id, has_image, regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') <> '' AS nonblank FROM c) SELECT id, CASE WHEN nonblank AND has_image THEN 'image,text' WHEN nonblank THEN 'text' WHEN has_image THEN 'image' END AS eff FROM d WHERE nonblank OR has_image",
    "sel11_has_image": f"WITH {_C} SELECT id, contains(coalesce(modality, ''), 'image') AS says, has_image AS has FROM c",
    "sel13_domain_match": "SELECT DISTINCT \"row\", corpus_id FROM meta WHERE " + " OR ".join(f"contains(lower(corpus_id), '{p.lower()}')" for d in ("Science", "Medicine") for p in SEARCH_PARTS[d]),
    "sel14_positional_pick": "SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT id FROM corpus)) WHERE pos IN (0, 3, 17, 10000000)",
    "sel19_truncated_text": "SELECT doc_id, substring(text, 1, 300) AS head FROM documents",
    "sel20_marker_prefix": rf"SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN regexp_replace(substring(text, 1, strpos(text, chr(10) || chr(10)) - 1), '{_WS}+$', '') ELSE text END AS head FROM documents WHERE text IS NOT NULL",
    "sel21_orphan_qrels": "SELECT DISTINCT query_id, corpus_id, score FROM qrels WHERE corpus_id IS NULL OR corpus_id NOT IN (SELECT id FROM corpus WHERE id IS NOT NULL)",
    "sel22_gold_set": "SELECT DISTINCT corpus_id FROM qrels WHERE score >= 1 AND corpus_id IN (SELECT id FROM corpus WHERE id IS NOT NULL)",
    "sel23_not_done": "SELECT DISTINCT prop_id FROM meta WHERE prop_id IS NOT NULL AND prop_id NOT IN (SELECT prop_id FROM doc_propositions WHERE grounded AND prop_id IS NOT NULL)",
    "j7_docs_grounding": "SELECT c.id AS corpus_id, count(l.line_no) AS lines FROM (SELECT DISTINCT id FROM corpus) c LEFT JOIN (SELECT DISTINCT corpus_id, line_no FROM doc_propositions) l ON l.corpus_id = c.id GROUP BY 1",
    "u1_union": "SELECT corpus_id FROM qrels UNION SELECT corpus_id FROM meta",
    "u2_intersect": "SELECT corpus_id FROM qrels INTERSECT SELECT id FROM corpus",
    "u3_except": "SELECT corpus_id FROM qrels EXCEPT SELECT id FROM corpus",
    "f1_split_sentences": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13), ''), '([.!?]){_WS}+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ' || chr(9) || '-#*>')), lambda s: length(s) >= 15) AS parts FROM documents)
SELECT doc_id, (i - 1)::INT AS pos, parts[i] AS sentence FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""",
    "f2_slugify": "SELECT doc_id, trim(regexp_replace(replace(lower(source), '/', '-'), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug FROM documents",
    "f4_md5_key": "SELECT DISTINCT id, md5('document:' || text) AS key FROM corpus",
    "f5_source_id": "SELECT DISTINCT qid, CASE WHEN len(string_split(qid, '-')) >= 3 THEN substring(qid, length(string_split(qid, '-')[1]) + length(string_split(qid, '-')[2]) + 3) END AS src FROM per_query",
    "f6_strip_prefix": "SELECT DISTINCT qid, regexp_replace(qid, '^(query-test-|corpus-test-)', '') AS bare FROM per_query",
    "f10_prompt": "SELECT doc_id, 'Title: ' || coalesce(source, '') || '. Section: ' || coalesce(category, '') || '. Content: ' || coalesce(text, '') AS prompt FROM documents",
    "f11_taxonomy": f"SELECT doc_id, {_DOMAIN_CASE} AS domain FROM (SELECT doc_id, replace(replace(coalesce(category, ''), 'test_', ''), 'validation_', '') AS b FROM documents)",
    "f15_html_escape": "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html FROM documents",
    "f22_base64": "SELECT DISTINCT id, to_base64(image.bytes) AS b64 FROM corpus",
}
