"""Sentence units across languages and scripts.

Abbreviations, collocations and sentence starters are learned without supervision, for each language, by log-likelihood
ratios over the counts of all documents (after Kiss and Strunk, "Unsupervised multilingual sentence boundary
detection", 2006). Every period is then classified by these statistics; quotations, brackets, list marks, ellipses and
scripts without periods have rules of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex as re
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut

#: Frequent function words that tell the languages in Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and in to was is with by that from for as",
    "fr": "le la les des et dans du un une est furent sous sur pour au par de",
    "de": "der die das und im von den dem ein eine zu war mit auf ist",
    "es": "el la los las del y en un una que fueron por con de unas",
}
_FUNCTION = {k: v.split() for k, v in FUNCTION_WORDS.items()}
_ANY_FUNCTION = {w for v in _FUNCTION.values() for w in v}
#: Uses that a learned entry needs, however large the table is; the ratios decide the rest.
LEAST = 3
#: Entries that may be learned, as they travel to every task; more are an error.
MOST_LEARNED = 1 << 20
#: A word before a period is looked at no further back than this; a longer one is no abbreviation.
LOOK_BACK = 64
#: Thresholds of the ratios as published.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: An abbreviation goes on in mid-sentence in at least this share of its uses.
GOES_ON = 0.6

_LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_MARK = re.compile(r"\s*(?:(?:#+|>+)\s*|[-*]+\s+)+")
_NUMBERED = re.compile(r"\s*\(?\d{1,4}[.)](?=\s)")
_RUN = re.compile(r"[.!?…。！？｡।॥؟]+(?:\s?[.!?…]+)*")
_TOKEN = re.compile(r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}'’.\-]*[\p{L}\p{M}\p{N}])?")
_BEFORE = re.compile(r"[\p{L}\p{M}\p{N}.'’\-]*$")
_AFTER = re.compile(r"[^\p{L}\p{N}]*?([\p{L}\p{N}](?:[\p{L}\p{M}\p{N}'’\-]*))")
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])[  　\t]+(?=[ก-ฺเ-๎])")
_FINAL = re.compile(r"(?<=[\p{L}\p{M}\p{N}])[!?。！？।؟]")
_PERIOD = re.compile(r"(?<=[\p{L}\p{M}\p{N}])\.(?![.\p{L}\p{N}])")
_NUMBER = re.compile(r"[\p{Nd}.,\-]+$")
#: Quotes and brackets, closing by opening.
PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›"}
_CLOSING = set(PAIRS.values()) | {'"'}
_QUOTE = re.compile("[" + re.escape("".join(sorted(_CLOSING | set(PAIRS)))) + "]")
_SOLID = re.compile(r"\S")
_GAP = re.compile("[ \t\xa0　]*")
_BRACKETS = set("(（[【")
_STRONG = set("!?。！？｡।॥؟")
_FULL = set("。！？｡।॥؟")


def language(text: str) -> str:
    """Language of a text: by script, within Latin by function words, ``xx`` where nothing tells."""
    if text.isascii():
        kana = han = thai = deva = arab = latin = 0
    else:
        block = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) >> 6, minlength=0x280)  # runs of 64 characters
        kana, han, thai, deva, arab, latin = (int(block[lo:hi].sum()) for lo, hi in ((0xC1, 0xC4), (0x138, 0x280), (0x38, 0x3A), (0x24, 0x26), (0x18, 0x1C), (0x01, 0x0A)))
    best = max((kana + han, "ja" if kana * 20 > han else "zh"), (thai, "th"), (deva, "hi"), (arab, "ar"))
    if best[0] * 4 > latin:
        return best[1] if best[0] else "xx"
    words = Counter(w for w in text.lower().split() if w in _ANY_FUNCTION)
    votes = {k: sum(words[w] for w in v) for k, v in _FUNCTION.items()}
    top = max(votes, key=lambda k: votes[k])
    return top if votes[top] else "xx"


def _kind(ch: str) -> str:
    """Case of the first letter of what follows: upper, lower, digit or letter without case."""
    if ch.isdigit():
        return "digit"
    if ch.islower():
        return "lower"
    return "upper" if ch.isupper() or ch.istitle() else "plain"


def _starts_upper(word: str) -> bool:
    """A word that may open a sentence: capital first, or a lower-case first letter with a capital later (pH, mRNA)."""
    k = _kind(word[0])
    return k in ("upper", "plain") or (k == "lower" and any(ch.isupper() for ch in word[1:4]))


def _type(word: str) -> str:
    return "##" if not word[0].isalpha() and _NUMBER.match(word) else word.lower()


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of types and of (type with period, next type), added up within each batch.

    All words are counted in bulk; only periods and sure starts (of a line, after a final mark) are looked at one by one.
    """
    for b in batches:
        words: dict[str, Counter] = {}
        types: dict[tuple, list[int]] = {}
        pairs: Counter = Counter()
        for text in b.column(0).to_pylist():
            lang = language(text)
            words.setdefault(lang, Counter()).update(_TOKEN.findall(text))
            for line in _LINE.finditer(text):
                s = line.group()
                at = m.end() if (m := _MARK.match(s)) else 0
                if numbered := _NUMBERED.match(s, at):
                    at = numbered.end()
                for place in (at, *(m.end() for m in _FINAL.finditer(s, at))):
                    if (t := _TOKEN.search(s, place)) and _starts_upper(t.group()):
                        types.setdefault((lang, _type(t.group())), [0, 0, 0, 0])[3] += 1
                for m in _PERIOD.finditer(s, at):
                    i = m.start()
                    before = _BEFORE.search(s[max(at, i - LOOK_BACK) : i]).group().lstrip("'’-.")
                    if not before:
                        continue
                    typ = _type(before)
                    row = types.setdefault((lang, typ), [0, 0, 0, 0])
                    row[1] += 1
                    gap = _GAP.match(s, i + 1).end()
                    rest = s[gap : gap + 4]
                    row[2] += bool(rest) and (rest[0] in ",;:" or rest[0].isdigit() or (rest[0].islower() and not _starts_upper(rest)))
                    if (t := _TOKEN.search(s, i + 1)) and not t.group()[0].isdigit() and _starts_upper(t.group()):
                        pairs[(lang, typ, _type(t.group()))] += 1
        for lang, count in words.items():
            for w, n in count.items():
                types.setdefault((lang, _type(w)), [0, 0, 0, 0])[0] += n
        rows = [(k[0], k[1], None, *v) for k, v in types.items()] + [(k[0], k[1], k[2], n, 0, 0, 0) for k, n in pairs.items()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.string()] * 3 + [pa.int64()] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "a", "b", "total", "period", "mid", "start"])


def _bernoulli(k: F.Column, n: F.Column, p: F.Column) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _share(a: str | F.Column, b: str | F.Column) -> F.Column:
    """a / b, null where b is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def _ratio(a: F.Column, b: F.Column, ab: F.Column, n: F.Column) -> F.Column:
    """Log-likelihood ratio that ``ab`` joint uses of an item used ``a`` times with one used ``b`` of ``n`` times are no chance."""
    p, p1, p2 = _share(b, n), _share(ab, a), _share(b - ab, F.greatest(n - a, F.lit(1)))
    return -2 * (_bernoulli(ab, a, p) + _bernoulli(b - ab, n - a, p) - _bernoulli(ab, a, p1) - _bernoulli(b - ab, n - a, p2))


@dataclass
class Model:
    """What is learned of one language."""

    abbreviations: set = field(default_factory=set)
    starters: set = field(default_factory=set)
    collocations: set = field(default_factory=set)


def learn(texts: DataFrame, text: str = "text") -> dict[str, Model]:
    """Abbreviations, starters and collocations of each language from all documents.

    Counts are added up in the tasks before the shuffle. An entry needs LEAST uses and the ratios, whatever the size of
    the table; more than MOST_LEARNED entries are an error.
    """
    counts = texts.select(text).where(F.col(text).isNotNull()).mapInArrow(_observe, "lang string, a string, b string, total bigint, period bigint, mid bigint, start bigint")
    counts = cut(counts.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("total", "period", "mid", "start")]))
    types = counts.where("b IS NULL").drop("b")
    whole = F.broadcast(types.groupBy("lang").agg(F.sum("total").alias("N"), F.sum("period").alias("P"), F.sum("start").alias("S")))  # a row for each language
    t = types.join(whole, "lang")
    enough = lambda c: F.col(c) >= LEAST
    starters = t.where(enough("start") & (F.col("a") != "##")).where((_ratio(F.col("total"), F.col("S"), F.col("start"), F.col("N")) >= STARTER) & (_share("start", "total") > _share("S", "N")) & (_share("start", "total") > 0.02)).select("lang", "a")
    pairs = counts.where("b IS NOT NULL").select("lang", "a", "b", F.col("total").alias("ab"))
    # followers in upper case that do not open sentences
    other = pairs.join(starters.withColumnRenamed("a", "b"), ["lang", "b"], "left_anti").groupBy("lang", "a").agg(F.sum("ab").alias("other"), F.count("*").alias("kinds"))
    size, dots = F.length(F.replace(F.col("a"), F.lit("."))), F.length("a") - F.length(F.replace(F.col("a"), F.lit(".")))
    p = _share("P", "N")
    ll = -2 * (_bernoulli(F.col("period"), F.col("total"), p) - _bernoulli(F.col("period"), F.col("total"), F.lit(0.99)))
    score = ll * F.exp(-size) * (dots + 1) * F.pow(F.greatest(size, F.lit(1)).cast("double"), -F.least(F.col("total") - F.col("period"), F.lit(300)).cast("double"))
    short = t.join(other, ["lang", "a"], "left").where(enough("period") & (F.col("a") != "##") & ~F.col("a").rlike(r"^[0-9.,\-]+$") & (score >= ABBREVIATION))
    short = short.where(_share(F.col("mid") + F.coalesce("other", F.lit(0)), "period") >= GOES_ON)
    # a long word that only ever meets one or two followers is the end of a set phrase
    short = short.where((size <= 3) | (_share("mid", "period") >= GOES_ON) | (F.coalesce("kinds", F.lit(0)) >= 3)).select("lang", "a")
    # words that are also common without a period (No. 7): their period goes with a continuation beyond chance
    goes = types.groupBy("lang").agg(F.sum("mid").alias("M"))
    also = t.join(F.broadcast(goes), "lang").where(enough("mid") & ~F.col("a").rlike(r"^[0-9.,\-]+$") & (F.col("a") != "##") & (_share("mid", "period") >= 0.8) & (_share("mid", "period") > _share("M", "P")))
    short = short.unionByName(also.where(_ratio(F.col("period"), F.col("M"), F.col("mid"), F.col("P")) >= COLLOCATION).select("lang", "a")).distinct()
    first = types.select("lang", "a", F.col("period").alias("ca"))
    second = types.select("lang", F.col("a").alias("b"), F.col("total").alias("cb"))
    keyed = pairs.join(short.unionByName(types.where("a = '##'").select("lang", "a")), ["lang", "a"], "left_semi")
    coll = keyed.join(first, ["lang", "a"]).join(second, ["lang", "b"]).join(whole, "lang").where(enough("ab") & (_ratio(F.col("ca"), F.col("cb"), F.col("ab"), F.col("N")) >= COLLOCATION) & (_share("ab", "ca") > _share("cb", "N")) & (F.col("ab") * 2 > F.col("cb")))
    model: dict[str, Model] = {}
    found = short.select("lang", F.lit("a").alias("k"), "a", F.lit("").alias("b")).unionByName(starters.select("lang", F.lit("s").alias("k"), "a", F.lit("").alias("b"))).unionByName(coll.select("lang", F.lit("c").alias("k"), "a", "b"))
    entries = found.limit(MOST_LEARNED + 1).collect()
    if len(entries) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED} entries learned")
    for lang, k, a, b in entries:
        m = model.setdefault(lang, Model())
        if k == "c":
            m.collocations.add((a, b))
        else:
            (m.abbreviations if k == "a" else m.starters).add(a)
    return model


def _spans(s: str) -> dict[int, int]:
    """Matched quotes and brackets of a line: place of the opening by that of the closing. Linear in the line."""
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # closers that something on the stack waits for
    opened: dict[int, int] = {}
    for m in _QUOTE.finditer(s):
        ch, i = m.group(), m.start()
        if waiting[ch]:
            while True:
                c, j = stack.pop()
                waiting[PAIRS.get(c, c)] -= 1
                if PAIRS.get(c, c) == ch:
                    opened[i] = j
                    break
        elif ch == '"' or ch in PAIRS:
            stack.append((ch, i))
            waiting[PAIRS.get(ch, ch)] += 1
    return opened


def _outer(opened: dict[int, int]) -> tuple[list[int], list[int]]:
    """Starts and ends of the outermost matched stretches, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for c in sorted(opened, reverse=True):
        if not starts or opened[c] < starts[-1]:
            if starts and c > starts[-1]:
                continue
            starts.append(opened[c])
            ends.append(c)
    return starts[::-1], ends[::-1]


def _ends(s: str, at: int, m: Model, no_case: bool, capitals: bool) -> Iterator[int]:
    """Places in the line ``s``, from ``at``, where a unit ends before the line does.

    ``no_case``: the text has no capitals; ``capitals``: it has hardly anything else, so a capital tells nothing and
    only learned starters open sentences after marks that are not final for sure.
    """
    opened = _spans(s)
    starts, stops = _outer(opened)
    begin = at
    numbered = _NUMBERED.match(s, at)
    for r in _RUN.finditer(s, numbered.end() if numbered else at):
        i, e = r.start(), r.end()
        if i < begin:
            continue
        # closers that belong to the run, also after a space (« ... ? »)
        first_open = None
        while e < len(s):
            j = e
            if s[j] in " \xa0 " and j + 1 < len(s) and s[j + 1] in "»›":
                j += 1
            if s[j] in _CLOSING and j in opened and opened[j] < i:
                first_open = opened[j]
                e = j + 1
                while e < len(s) and s[e] in ".!?…。！？" and first_open is not None and s[e] in _FULL:
                    e += 1
            else:
                break
        k = bisect_left(starts, i) - 1
        if k >= 0 and stops[k] >= e:
            continue  # still inside a quotation or bracket
        solid = _SOLID.search(s, e)
        if not solid:
            continue
        sign = solid.group()
        spaced = s[e].isspace()
        run = r.group()
        strong = any(ch in _STRONG for ch in run)
        if sign in ",;:、，；：،؛)）" or (sign in "-–—" and not spaced):
            continue
        word = _AFTER.match(s, e)
        nxt = word.group(1) if word else ""
        kind = _kind(nxt[0]) if nxt else "none"
        upper = kind == "none" or _starts_upper(nxt) or (no_case and kind == "lower")
        if first_open is not None:
            at_start = not s[begin:first_open].strip()
            if s[first_open] in _BRACKETS and not at_start:
                continue
            if kind == "lower" and not upper:
                continue
            if kind == "plain" and at_start and s[first_open] not in _BRACKETS:
                continue
            if capitals and kind == "upper" and nxt.lower() not in m.starters:
                continue
            yield e
            begin = e
            continue
        if any(ch in _FULL for ch in run):
            yield e
            begin = e
            continue
        if not spaced and (kind in ("digit", "none") or (kind == "lower")):
            continue
        if strong:
            if upper or kind == "digit":
                yield e
                begin = e
            continue
        if "…" in run or len(run.replace(" ", "")) > 1:  # ellipsis
            if kind == "upper" and spaced and (not capitals or nxt.lower() in m.starters):
                yield e
                begin = e
            continue
        before = _BEFORE.search(s[max(begin, i - LOOK_BACK) : i]).group().lstrip("'’-.")
        if before and "ก" <= before[-1] <= "๛":
            continue  # no sentence ends in a period in Thai
        typ = _type(before) if before else ""
        if kind == "lower" and not upper:
            continue
        initial = len(before) == 1 and before.isalpha()
        short = initial or typ in m.abbreviations or ("." in typ and typ != "##")
        follow = nxt.lower()
        if typ == "##" and (typ, follow) in m.collocations and follow not in m.starters:
            continue
        if short:
            if kind == "digit" or (capitals and typ in m.abbreviations) or (typ, follow) in m.collocations or follow not in m.starters:
                continue
        yield e
        begin = e


@lru_cache(1)
def _cases() -> np.ndarray:
    """1 for capitals, 2 for small letters, of all characters below 0x20000; no others have cases."""
    return np.array([1 if chr(i).isupper() else 2 if chr(i).islower() else 0 for i in range(0x20000)], np.int8)


def units(text: str, model: dict[str, Model]) -> list[tuple[int, int]]:
    """(start, end) of the units of one text in code points, in order."""
    lang = language(text)
    m = model.get(lang) or Model()
    out: list[tuple[int, int]] = []
    _, upper, lower = np.bincount(_cases()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x1FFFF)], minlength=3)
    no_case, capitals = not upper and lower > 0, upper > 4 * lower
    for line in _LINE.finditer(text):
        s, base = line.group(), line.start()
        at = mk.end() if (mk := _MARK.match(s)) else 0
        cuts = set(_ends(s, at, m, no_case, capitals)) | {g.start() for g in _THAI_GAP.finditer(s, at)} | {len(s)}
        b = at
        for e in sorted(cuts):
            lo, hi = b, e
            while lo < hi and s[lo].isspace():
                lo += 1
            while hi > lo and s[hi - 1].isspace():
                hi -= 1
            if lo < hi:
                out.append((base + lo, base + hi))
            b = e
    return out


def _split(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [units(t, model.value) for t in b.column(1).to_pylist()]
        n = np.array([len(f) for f in found], np.int64)
        flat = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
        yield pa.record_batch([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["id", "start_pos", "end_pos"])


def sentences(texts: DataFrame, id_col: str = "id", text_col: str = "text", model: dict[str, Model] | None = None) -> DataFrame:
    """(id, start_pos, end_pos): the units of every text, positions in code points, end exclusive.

    Without a ``model`` one is learned from the same texts. Null and blank texts have no units; repeated (id, text)
    rows count once; a null id is kept. Texts are read whole. Empty in, empty out.
    """
    src = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    if model is None:
        model = learn(src)
    return src.mapInArrow(partial(_split, model=src.sparkSession.sparkContext.broadcast(model)), "id string, start_pos int, end_pos int")


QUERIES = {"p4_found": lambda spark, sf: sentences(spark.read.parquet(f"{sf}/corpus.parquet").select("id", "text"))}
SQL: dict[str, str] = {}
