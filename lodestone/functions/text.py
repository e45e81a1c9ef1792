"""String functions as column expressions (JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters stripped from sentence ends, and the least length of a sentence.
STRIPPED, MIN_SENTENCE = " \t-#*>", 15
QUERY_PREFIX, CORPUS_PREFIX = "query-test-", "corpus-test-"


#: Fixed value: where a text is cut into sentence-like parts.
SPLIT = r"(?U)(?<=[.!?])\s+|\n+"


def sentences(text: Column) -> Column:
    """Array of sentence-like parts: cut at white space after ``.!?`` and at line feeds, ends stripped, short ones dropped.

    Carriage returns are removed first. Null for null.
    """
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("")), SPLIT)
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(STRIPPED))), lambda p: F.length(p) >= MIN_SENTENCE)


def slug(text: Column) -> Column:
    """Lower case, ``/`` to ``-``, every other run outside ``[a-z0-9._-]`` to one ``-``, outer dashes gone."""
    return F.btrim(F.regexp_replace(F.replace(F.lower(text), F.lit("/"), F.lit("-")), "[^a-z0-9._-]+", "-"), F.lit("-"))


def text_key(task: Column, text: Column) -> Column:
    """Cache key of a text under a task."""
    return F.md5(F.concat(task, F.lit(":"), text))


def source_id(item_id: Column) -> Column:
    """What follows the second dash of a prefixed id; null if there is none."""
    return F.try_element_at(F.split(item_id, "-", 3), F.lit(3))


def bare_id(item_id: Column) -> Column:
    """The id without its query or corpus prefix."""
    return F.regexp_replace(item_id, f"^({QUERY_PREFIX}|{CORPUS_PREFIX})", "")


def before_marker(text: Column, marker: str) -> Column:
    """Text before the first ``marker``, right-trimmed; the whole text if it does not occur."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"(?U)\s+$", "")).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def proposition_prompt(title: Column, section: Column, content: Column) -> Column:
    """Fixed value: the form of the prompt, as the model expects it."""
    e = F.lit("")
    return F.concat(F.lit("Title: "), F.coalesce(title, e), F.lit(". Section: "), F.coalesce(section, e), F.lit(". Content: "), F.coalesce(content, e))


def _clean(items: Column) -> Column:
    """Elements without outer white space, empty and null ones dropped."""
    return F.filter(F.transform(items, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p.isNotNull() & (p != ""))


def parse_propositions(text: Column) -> Column:
    """String list out of model output; a list cut short is closed after its last quote. Empty array if hopeless."""
    cut = F.when(F.startswith(text, F.lit("[")), F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), ",$", ""))
    closed = (
        F.when(F.endswith(cut, F.lit("]")), cut)
        .when(F.instr(cut, '"') > 1, F.concat(F.substring(cut, F.lit(1), F.length(cut) - F.instr(F.reverse(cut), '"') + 1), F.lit("]")))
        .otherwise(F.concat(cut, F.lit('"]')))
    )
    return F.coalesce(_clean(F.from_json(text, "array<string>")), _clean(F.from_json(closed, "array<string>")), F.array().cast("array<string>"))


def propositions_or_text(raw: Column, content: Column, original: Column) -> Column:
    """Parsed propositions, else the raw output, the content, the original text as the only one."""
    parsed = parse_propositions(raw)
    blank = lambda c: F.when(F.regexp_replace(c, r"(?U)^\s+|\s+$", "") != "", c)
    return F.when(F.size(parsed) > 0, parsed).otherwise(F.array_compact(F.array(F.coalesce(blank(raw), blank(content), original))))
