"""Personal information inside free text: find it, place it, replace it.

Detection is offset-preserving: transducers rewrite a text into a plain form (digits of any script and full-width signs,
look-alike letters, runs of spelled digits, at/dot disguises of addresses) while every character of the plain form
remembers the stretch it came from. Identifiers are found in the plain form and their spans mapped back.

Names are found with a lexicon learned from the texts themselves: words that occur in the local parts of e-mail
addresses and after titles and labels, and hardly otherwise.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex as re
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that the learned lexicon may have, as it travels to every task; more are an error.
MOST_NAMES = 1 << 20
#: Least share of a word's uses that are evidence of a name.
EVIDENCE = 0.15
#: A cue is looked for so many characters before an identity number, a phone number or a name in lower case.
ID_BACK, PHONE_BACK, NAME_BACK = 48, 90, 24

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# ---------------------------------------------------------------- fixed values
#: Look-alike letters of other scripts and the Latin letters they pass for.
HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονіⅼ", "ABESIJKMHOPCTYXaesijopcyxdhqwABEZHIKMNOPTYXovil"))
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
SPELLED |= {"zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
PHONE_CUES = "phone telephone tel tél fax call ring rang dial mobile cell reach text telefon rückruf mobil anruf fon téléphone rappeler appeler portable teléfono llame llamar móvil 电话 手机 传真 致电 電話 携帯 फ़ोन फोन दूरभाष मोबाइल هاتف جوال اتصل โทร เบอร์".split()
ID_CUES = (
    "identity number;identity card;id number;id no;id;passport;passport number;social security;social security number;ssn;tax number;tax id;holder of card;card number;patient number;patient no;insurance number;national insurance"
    ";ausweisnummer;personalausweis;steuernummer;reisepass;sozialversicherungsnummer;versichertennummer;patientennummer"
    ";numéro d'identité;numéro de passeport;passeport;numéro de sécurité sociale;numéro fiscal;pasaporte;dni;nif;nie;número de identidad;documento de identidad;seguridad social"
    ";证件号码;证件号;身份证号码;身份证号;身份证;护照号;护照;身分証番号;パスポート番号;パスポート;マイナンバー;पहचान संख्या;पहचान पत्र;पासपोर्ट;आधार;رقم الهوية;هوية;جواز السفر;جواز;เลขบัตรประชาชน;บัตรประชาชน;หนังสือเดินทาง"
).split(";")
NAME_CUES = (
    "Name:;Name :;Nom :;Nombre:;Mr.;Mr;Ms.;Mrs.;Miss;Dr.;Prof.;Frau;Herr;Herrn;Mme;M.;Monsieur;Madame;Sr.;Sra.;Señor;Señora;c/o;Patient;holder:;Inhaber;a nombre de;est celui de;Según;Selon;Laut;said;signed by;Thanks to;sincerely,;regards,;السيد;السيدة;联系人：;担当は;ติดต่อ"
).split(";")
STREETS_EN = "Street St\\.? Road Rd\\.? Lane Ln\\.? Avenue Ave\\.? Close Terrace Drive Court Crescent Square Row Place Boulevard Blvd\\.? Gardens Grove Mews Walk Way".split()
STREETS_EN_PLAIN = [w.rstrip("?.\\") for w in STREETS_EN]
STREETS_FR = "rue avenue boulevard place impasse chemin quai allée cours route".split()
STREETS_DE = "gasse str\\. straße strasse allee weg platz ufer damm ring".split()
STREETS_ES = "Avda\\. Avda Avenida Calle C/ Plaza Pza\\. Paseo".split()
FLATS = "Flat Apt\\.? Apartment Unit Suite Room".split()
PARTICLES = set("von van der den de la le du di da del dos zu zur ter".split())
# ------------------------------------------------------------------------------


@lru_cache(1)
def _plain_chars() -> dict[int, str]:
    """One-to-one part of the transducer: full-width signs, digits of every script, look-alike letters, odd spaces."""
    table = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= {c: str(unicodedata.digit(chr(c))) for c in range(0x80, 0x1FBFA) if unicodedata.category(chr(c)) == "Nd"}
    table |= {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000)}
    table |= {ord(c): "-" for c in "‐‑‒–−"} | {ord("’"): "'", ord("ʼ"): "'"}
    return table


_GLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_BRACKETED_AT = r"[\[({<]\s*(?:at|@|ät|arroba|arobase)\s*[\])}>]"
_BRACKETED_DOT = r"[\[({]\s*(?:dot|punkt|point|punto|\.)\s*[\])}]"
_WORD_DOT = r"(?:dot|punkt|punto)"
_AT = rf"(?:\s*{_BRACKETED_AT}\s*|\s+@\s*|\s*@\s+|@)"
_WORD_AT = r"\s+(?:at|arroba|arobase)\s+"
_DOT = rf"(?:\s*{_BRACKETED_DOT}\s*|\s+{_WORD_DOT}\s+)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_LOCAL = r"(?<![a-z0-9._%+-])[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])?"
#: at least one sign of an address: a real or bracketed at, or words for both at and dot
_DISGUISED = re.compile(rf"{_LOCAL}(?P<at>{_AT})(?:{_LABEL}(?P<dot>{_DOT}|\.))+[a-z]{{2,}}(?![a-z0-9])|{_LOCAL}(?P<at>{_WORD_AT})(?:{_LABEL}(?P<dot>{_DOT}))+[a-z]{{2,}}(?![a-z0-9])", re.I)
#: without any of these a text has no disguised address, and the costly pattern is not tried
_AT_SIGN = re.compile(rf"\s@|@\s|{_BRACKETED_AT}|{_BRACKETED_DOT}|\s{_WORD_DOT}\s", re.I)
#: what every sign has one of, as plain text
_AT_HINTS = ("[", "(", "{", "<", "dot", "punkt", "punto")
_SPELLED = re.compile(r"(?<!\w)(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")(?:[\s-]+(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")){5,}(?!\w)", re.I)
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The plain form and, if lengths differ, the source place of each of its characters (and of its end)."""
    s = text if text.isascii() else text.translate(_plain_chars())
    if not s.isascii() and _GLYPH.search(s):
        # only inside words that also have Latin letters: Cyrillic and Greek words stay as they are
        s = re.sub(r"[\p{L}\p{N}._%+@-]*", lambda m: "".join(HOMOGLYPHS.get(c, c) for c in m.group()) if re.search(r"[a-zA-Z]", m.group()) else m.group(), s)
    edits: list[tuple[int, int, str]] = []
    low = s.lower()
    if ("@" in s or any(x in low for x in _AT_HINTS)) and _AT_SIGN.search(s):
        for m in _DISGUISED.finditer(s):
            edits += [(*m.span("at"), "@")] + [(a, b, ".") for a, b in m.spans("dot")]
    if sum(map(low.count, SPELLED)) > 5:
        for m in _SPELLED.finditer(s):
            edits.append((*m.span(), "".join(SPELLED[w.lower()] for w in re.findall(r"[^\W\d_]+", m.group()))))
    edits = sorted(e for e in edits if s[e[0] : e[1]] != e[2])
    if not edits:
        return s, None
    out, place, at = [], [], 0
    for a, b, new in edits:
        if a < at:
            continue
        out.append(s[at:a])
        place.extend(range(at, a))
        out.append(new)
        place.extend(a + (b - a) * i // len(new) for i in range(len(new)))
        at = b
    out.append(s[at:])
    place.extend(range(at, len(s) + 1))
    return "".join(out), place


_EMAIL = re.compile(rf"{_LOCAL}@(?:{_LABEL}\.)+[a-z]{{2,}}(?![a-z0-9])", re.I)
_PHONE = re.compile(r"(?<![\p{Latin}\p{N}_/.,-])(?:\+\d{1,3}[ .-]?(?:\d(?=[ .-]))?[ .-]?|00\d[ .-])?(?:\(\d{2,5}\)[ .-]?)?\d{2,14}(?:[ .-]\d{2,9}){0,6}(?![\d_]|[/.,-]\d|-?[a-zA-Z])")
_CUE_GAP = r"(?:[^.!?。！？।؟\n]|(?<=(?<!\p{L})\p{Lu})\.|(?<=\bn)\.){0,60}"
_PHONE_CUE = re.compile(r"(?:(?<!\p{L})(?:" + "|".join(c for c in PHONE_CUES if c.isascii() or c[0] in "térf" or "ü" in c or "é" in c or "ó" in c) + r")(?!\p{L})|(?:" + "|".join(c for c in PHONE_CUES if ord(c[0]) > 0x5FF) + r"))\.?" + _CUE_GAP + r"$", re.I)
_JOINED = re.compile(r"¤\s?(?:[,;/&、，]|or|oder|ou|o|y|and|und|et|e|或|या|أو|หรือ)?\s?$")
#: a number with its letters, and a cue right before it
_ID = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,3}[ -]?)?(\d[\dA-Z]*(?:[ ./-]\d[\dA-Z]*)*(?:[ -]?[A-Z](?![A-Za-z0-9]))?)")
_ID_CUE = re.compile(
    r"(?:(?<!\p{L})(?:" + "|".join(map(re.escape, sorted((c for c in ID_CUES if ord(c[0]) < 0x600), key=len, reverse=True))) + r")(?!\p{L})|(?:" + "|".join(map(re.escape, sorted((c for c in ID_CUES if ord(c[0]) >= 0x600), key=len, reverse=True))) + r"))"
    r"(?:\s*(?:no|nr|number|nº|n\.º|番号|号码|号|は|为|是|es|is|est|ist|lautet)(?!\p{L}))?[\s.:#：]*$",
    re.I,
)

_TOWN = r"\p{Lu}[\p{L}'-]+(?:[ ]\p{Lu}[\p{L}'-]+)?"
_POST = r"(?:[A-Z]{1,2}[ -])?\d{4,6}"
_FLAT = r"(?:" + "|".join(FLATS) + r")[ ]\d+[A-Za-z]?"
_TAIL = rf"(?:(?:,[ ](?P<town>{_TOWN})(?:(?:,[ ]|[ ]){_POST}(?!\d))?)|(?:[ ]?\n(?P<lined>{_TOWN})(?:,[ ]|[ ]){_POST}(?!\d))|(?:[ ]?\n(?P<bare>{_TOWN})(?=[,.;]|[ ]?\n|$)))?"
_ADDRESSES = [
    re.compile(rf"(?<![\p{{L}}\d])(?:{_FLAT},[ ])?\d{{1,5}}[A-Za-z]?[ ](?:\p{{Lu}}[\p{{L}}'-]+[ ]){{1,3}}(?:{'|'.join(STREETS_EN)})(?!\p{{L}})(?:,[ ]{_FLAT})?{_TAIL}"),
    re.compile(rf"(?<![\p{{L}}\d])(?:P\.?[ ]?O\.?[ ]?Box|Postfach|Apartado|B\.?P\.?)[ ]\d+{_TAIL}"),
    re.compile(rf"(?<![\p{{L}}\d])\d{{1,5}}(?:[ ](?:bis|ter|quater))?,?[ ](?:{'|'.join(STREETS_FR)})[ ](?:(?:de[ ]la|de|du|des)[ ]|d')?\p{{Lu}}[\p{{L}}'-]+(?:[ ]\p{{Lu}}[\p{{L}}'-]+)?(?:,[ ]\d{{5}}[ ](?P<town>{_TOWN}))?"),
    re.compile(rf"(?<![\p{{L}}\d])\p{{Lu}}[\p{{L}}-]*(?:{'|'.join(STREETS_DE)})[ ]\d{{1,4}}[a-z]?(?!\p{{L}})(?:(?:,|[ ]in)[ ]\d{{5}}[ ](?P<town>{_TOWN}))?", re.I),
    re.compile(rf"(?<![\p{{L}}\d])(?:{'|'.join(STREETS_ES)})[ ](?:de[ ](?:la[ ])?)?\p{{Lu}}[\p{{L}}'-]+(?:[ ]\p{{Lu}}[\p{{L}}'-]+)?,?[ ](?:(?:n\.?º|núm\.)[ ]?)?\d+[A-Za-z]?(?:,[ ]\d+\.?[ºª](?:[ ][A-Z](?!\p{{L}}))?)?(?:,[ ](?:\d{{5}}[ ])?(?P<town>{_TOWN}))?"),
    re.compile(r"(?<=[到往在于至址：:，。、\s])\p{Han}{1,7}?(?:省|市|镇|县|乡|区)\p{Han}{1,14}?(?:路|街|道|巷|胡同)\d{1,5}号(?:\d{1,4}(?:单元|室|栋|楼|号楼|层))*"),
    re.compile(r"(?<!\p{Han})\p{Han}{1,6}?[市区町村郡][\p{Han}ヶ]{1,10}?\d{1,3}丁目\d{1,3}番(?:地)?(?:\d{1,4}号)?"),
    re.compile(r"〒\d{3}-\d{4}\s*[\p{Han}\p{Hiragana}\p{Katakana}ヶー]{2,30}?\d{1,4}(?:-\d{1,4})*(?:番地|号)?"),
]
#: words of which one must occur for the pattern of the same place to be tried
_ADDRESS_SIGNS = [STREETS_EN_PLAIN, ["Box", "Postfach", "Apartado", "BP", "B.P"], STREETS_FR, [w.replace("\\", "") for w in STREETS_DE], ["Av", "Calle", "C/", "Pza", "Plaza", "Paseo"], ["号"], ["丁目"], ["〒"]]
#: with folded words for patterns without regard to case
_FOLDED = [bool(p.flags & re.I) for p in _ADDRESSES]
_ADDRESS_SIGNS = [[w.casefold() for w in signs] if folded else signs for signs, folded in zip(_ADDRESS_SIGNS, _FOLDED)]
_NAME_TOKEN = re.compile(r"\p{Latin}[\p{Latin}\p{M}']*")
_LATIN = re.compile(r"[\p{Latin}\p{M}]+")
_NAME_CUE = re.compile(r"(?<!\p{L})(?:" + "|".join(map(re.escape, sorted(NAME_CUES, key=len, reverse=True))) + r")\s*$")
#: a capitalised word after a title or label
_CUED = re.compile(r"(?<!\p{L})(?:" + "|".join(map(re.escape, sorted(NAME_CUES, key=len, reverse=True))) + r")\s*(\p{Lu}[\p{Latin}\p{M}']{2,})")
_LABELLED = re.compile(r"(?:(?<!\p{L})(?:Name|Nom|Nombre|[Hh]older) ?: ?|联系人：|担当は)((?:\p{Lu}\. ?)*\p{Lu}[\p{Latin}'-]+(?:,? (?:\p{Lu}\.|(?:von|van|der|de|la) |\p{Lu}[\p{Latin}'-]+)){0,3})")
#: personal titles; after the last three of them a capitalised run is a name only if none stands before them (Ada Brill Sr. The)
TITLES = r"Mr\.?|Ms\.?|Mrs\.?|Miss|Dr\.|Prof\.|Frau|Herrn?|Mme\.?|Monsieur|Madame|Señora?|(?<!\p{Lu}[\p{Latin}'-]*[ ]|\p{Lu}\.[ ]?)(?:Sra?\.|M\.)"
_TITLED_WORD = r"(?!(?:Mr|Ms|Mrs|Miss|Dr|Prof|Frau|Herrn?|Mme|Monsieur|Madame|Sra?|Señora?)(?!\p{Latin}))\p{Lu}[\p{Latin}\p{M}'-]+"
_TITLED = re.compile(rf"(?<!\p{{L}})(?P<title>{TITLES})(?:(?<=\.)[ ]?|[ ])(?P<run>(?:\p{{Lu}}\.[ ]?)*(?:(?:{'|'.join(sorted(PARTICLES))})[ ])*{_TITLED_WORD}(?:[ ](?:(?:\p{{Lu}}\.[ ]?|(?:{'|'.join(sorted(PARTICLES))})[ ])*{_TITLED_WORD})){{0,3}})")
_NOT_PERSON = re.compile(r"[ ](?:scale|syndrome|school|hall|quartet|street|prize|institute|college|test|house|museum|Skala|Schule|échelle)s?(?!\p{L})", re.I)


def _roots(word: str) -> list[str]:
    """The word and what is left of it without O' or Mac."""
    w = word.lower()
    if "'" not in w and w[0] != "m":
        return [w]
    return [w] + [w[len(p) :] for p in ("o'", "d'", "mac", "mc") if w.startswith(p) and len(w) > len(p) + 2]


def _preposition(s: str, toks: list, a: int, b: int, comma: bool, words: int) -> bool:
    """Whether a leading particle is no part of the name: one before a given name, after an item, or a bare de.

    A surname that comes first or stands alone keeps its own (von Xander, Ada; Ms. van der Xander).
    """
    word = s[toks[a][1] : toks[a][2]].lower()
    alone = toks[a + 1][0] != "P"
    if toks[a + 1][0] == "I" or not (comma or words == 1) or any(t[0] == "I" for t in toks[a : b + 1] if not comma):
        return True
    if word in ("de", "du", "di", "da", "del", "dos", "la", "le") and (alone or s[toks[a + 1][1] : toks[a + 1][2]].lower() not in ("la", "le")):
        return True
    return word == "von" and s[max(0, toks[a][1] - 2) : toks[a][1]] == "¤ "


def _titled(s: str, lexicon: frozenset) -> set[int]:
    """Starts of the capitalised words right after a personal title, known or not.

    German writes nouns with capitals and M. may be an initial, so after Frau, Herr and M. a run ends at its last known
    word if it has any.
    """
    out: set[int] = set()
    for m in _TITLED.finditer(s):
        a, b = m.span("run")
        if _NOT_PERSON.search(s, a, b):
            continue
        words = [w for w in _NAME_TOKEN.finditer(s, a, b) if w.group()[0].isupper() and len(w.group()) > 1]
        if m.group("title")[:4] in ("Frau", "Herr", "M."):
            known = [i for i, w in enumerate(words) if any(r in lexicon for r in _roots(w.group()))]
            words = words[: known[-1] + 1] if known else words
        out.update(w.start() for w in words)
    return out


def _names(s: str, lexicon: frozenset) -> Iterator[tuple[int, int]]:
    """Maximal runs of lexicon words, words after a title, initials and particles that make up a name."""
    words_ = set(_LATIN.findall(s.lower()))
    titled = _titled(s, lexicon)
    if not titled and lexicon.isdisjoint(words_) and not any(w[:2] in ("ma", "mc") and not lexicon.isdisjoint(_roots(w)) for w in words_):
        return
    toks = []
    for m in _NAME_TOKEN.finditer(s):
        w, a, b = m.group(), m.start(), m.end()
        if len(w) == 1 and w.isupper() and s[b : b + 1] == ".":
            toks.append(("I", a, b + 1))
        elif a in titled or (len(w) > 2 and any(r in lexicon for r in _roots(w))):
            toks.append(("L", a, b))
        elif w.lower() in PARTICLES and (w.islower() or w.isupper()):
            toks.append(("P", a, b))
        else:
            toks.append(("x", a, b))
    i, n = 0, len(toks)
    while i < n:
        if toks[i][0] == "x":
            i += 1
            continue
        j, comma, known = i, False, toks[i][0] == "L"
        words = int(known)
        while j + 1 < n and toks[j + 1][0] != "x":
            gap = s[toks[j][2] : toks[j + 1][1]]
            kind = toks[j + 1][0]
            if gap == " " or (gap == "" and toks[j][0] == "I"):
                pass
            elif gap == "-" and toks[j][0] == "L" and kind == "L":
                words -= 1
            elif gap == ", " and not comma and words == 1 and kind in "LI" and all(t[0] in "LP" for t in toks[i : j + 1]) and s[toks[j + 1][1]].islower() == s[toks[j][1]].islower():
                comma = True
            else:
                break
            j += 1
            words += kind == "L"
            known |= kind == "L"
        a, b = i, j
        while b > a and toks[b][0] == "P":
            b -= 1
        while a < b and toks[a][0] == "P" and _preposition(s, toks, a, b, comma, words):
            a += 1
        if known:
            start, end = toks[a][1], toks[b][2]
            found = s[start:end]
            lone = words == 1 and all(t[0] != "I" for t in toks[a : b + 1])
            lower = not any(c.isupper() for c in found)
            if not _NOT_PERSON.match(s, end) and not (lone and lower and not _NAME_CUE.search(s[max(0, start - NAME_BACK) : start])):
                yield start, end
        i = j + 1


def _may_hold(s: str, i: int) -> bool:
    """Whether ``s`` has a sign of the i-th address pattern; without one the pattern is not tried."""
    if _FOLDED[i]:
        s = s.casefold()
    return any(x in s for x in _ADDRESS_SIGNS[i])


def detect(text: str, lexicon: frozenset) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items of one text, in order, without overlaps; positions in the source text."""
    s, place = plain(text)
    hits: list[tuple[str, int, int]] = []

    taken = 0

    def mask() -> None:
        """Blanks out what was found since the last call, so that later patterns pass over it; once for each pattern."""
        nonlocal s, taken
        if taken < len(hits):
            parts, at = [], 0
            for _, a, b in sorted(hits[taken:], key=lambda h: h[1]):
                parts += [s[at:a], "¤" * (b - a)]
                at = b
            s, taken = "".join(parts) + s[at:], len(hits)

    if "@" in s:
        for m in list(_EMAIL.finditer(s)):
            hits.append(("EMAIL", *m.span()))
        mask()
    digits = _DIGIT.search(s) is not None
    for i, pattern in enumerate(_ADDRESSES if digits else ()):
        if not _may_hold(s, i):
            continue
        for m in list(pattern.finditer(s)):
            a, b = m.span()
            if "¤" in s[a:b]:
                continue
            g = m.groupdict()
            if g.get("bare") and not _is_town(g["bare"], lexicon):
                b = m.start("bare")
                while s[b - 1] in " \n":
                    b -= 1
            town = g.get("town")
            if town and " " in town and m.end("town") == b and not _is_town(town, lexicon):
                b -= len(town) - town.index(" ")  # the next sentence's first word
            if i == 0 and re.match(r"[ ]\p{Ll}", s[b : b + 2]) and not re.search(r"(?:[\p{Ll},:][ ]|[(])$", s[max(0, a - 2) : a]):
                continue  # "94 Long Street scenes were ..."
            hits.append(("ADDRESS", a, b))
        mask()
    if digits:
        for m in _ID.finditer(s):
            if m.end() - m.start() < 5 or sum(map(str.isdigit, m.group())) < 5:
                continue
            for a in dict.fromkeys((m.start(), m.start(1))):  # letters before the number may belong to the cue
                if _ID_CUE.search(s[max(0, a - ID_BACK) : a]):
                    hits.append(("ID_NUMBER", a, m.end()))
                    break
        mask()
        for m in list(_PHONE.finditer(s)):
            a, b = m.span()
            if not 7 <= sum(map(str.isdigit, m.group())) <= 15 or "¤" in m.group():
                continue
            left = max(0, a - PHONE_BACK)
            before = s[left:a]
            for kind, x, y in reversed(hits):  # numbers just found on this stretch
                if kind != "PHONE" or y <= left:
                    break
                x = max(x, left) - left
                before = before[:x] + "¤" * (y - left - x) + before[y - left :]
            cue = None
            for cue in _PHONE_CUE.finditer(before, overlapped=True):
                pass  # the nearest one counts
            # between cue and number another item may only stand before a conjunction
            if m.group()[0] == "+" or (cue and ("¤" not in cue.group() or _JOINED.search(before))):
                hits.append(("PHONE", a, b))
        mask()
    hits += [("NAME", a, b) for a, b in _names(s, lexicon)]
    mask()
    for m in list(_LABELLED.finditer(s)):
        if "¤" not in m.group(1):
            hits.append(("NAME", *m.span(1)))
    if place is not None:
        hits = [(k, place[a], place[b - 1] + 1 if place[b] == place[b - 1] + 1 else place[b]) for k, a, b in hits]
    return sorted(hits, key=lambda h: h[1])


def _is_town(word: str, lexicon: frozenset) -> bool:
    return "\n" + word.lower() in lexicon


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, evidence, uses) of names and (newline + word, ...) of towns, added up within each batch."""
    for batch in batches:
        stat: dict[str, list[int]] = {}
        words, named = Counter(), Counter()

        def note(w: str, evidence: int, uses: int) -> None:
            row = stat.setdefault(w, [0, 0])
            row[0] += evidence
            row[1] += uses

        for text in batch.column(0).to_pylist():
            s, _ = plain(text)
            if "@" in s:
                for m in _EMAIL.finditer(s):
                    for w in re.split(r"[^a-z]+", re.split(r"[@+]", m.group())[0].lower()):
                        if len(w) > 3:
                            note(w, 1, 1)
                s = _EMAIL.sub(lambda m: "¤" * len(m.group()), s)
            for i, p in enumerate(_ADDRESSES):
                for m in p.finditer(s) if _may_hold(s, i) else ():
                    g = m.groupdict()
                    if t := g.get("town") or g.get("lined"):
                        note("\n" + t.lower(), 1, 1)
            words.update(_LATIN.findall(s.lower()))
            for m in _CUED.finditer(s):
                named[_roots(m.group(1))[-1].rpartition("'")[2]] += 1
        for w, n in words.items():
            if len(w) > 2:
                note(w, named.get(w, 0), n)
        for w, n in named.items():
            if len(w) > 2 and w not in words:  # what is left of a name without Mac is no word of this batch
                note(w, n, n)
        cols = list(zip(*((k, *v) for k, v in stat.items()))) or [[], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["word", "evidence", "uses"])


def learn_lexicon(texts: DataFrame, text: str = "text") -> frozenset:
    """Words of personal names (and towns, marked by a leading newline), from all texts.

    Counts are added up in the tasks before the shuffle. An entry needs three pieces of evidence and EVIDENCE of its
    uses, however large the table; more than MOST_NAMES entries are an error.
    """
    counts = texts.select(text).where(F.col(text).isNotNull()).mapInArrow(_evidence, "word string, evidence bigint, uses bigint").groupBy("word").agg(F.sum("evidence").alias("evidence"), F.sum("uses").alias("uses"))
    kept = counts.where((F.col("evidence") >= 3) & (F.col("evidence") >= F.lit(EVIDENCE) * F.col("uses"))).select("word").limit(MOST_NAMES + 1).collect()
    if len(kept) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names learned")
    return frozenset(r[0] for r in kept)


def _spans(batches: Iterator[pa.RecordBatch], lexicon: Broadcast) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        rows = [(i, *h) for i, t in enumerate(texts) for h in detect(t, lexicon.value)]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.record_batch([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "kind", "start_pos", "end_pos"])


def redact_text(text: str, hits: list[tuple[str, int, int]]) -> str:
    """The text with a placeholder of its kind in place of every item."""
    out, at = [], 0
    for kind, a, b in hits:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def _redacted(batches: Iterator[pa.RecordBatch], lexicon: Broadcast) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t is None else redact_text(t, detect(t, lexicon.value)) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lexicon: frozenset | None = None) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of every item of personal information; end exclusive, code points.

    Without a ``lexicon`` one is learned from the same texts. Null and empty texts have no items; repeated
    (id, text) rows count once. Texts are read whole. Empty in, empty out.
    """
    src = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    words = src.sparkSession.sparkContext.broadcast(learn_lexicon(src) if lexicon is None else lexicon)
    return src.mapInArrow(partial(_spans, lexicon=words), "doc_id bigint, kind string, start_pos int, end_pos int")


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lexicon: frozenset | None = None) -> DataFrame:
    """(doc_id, text): every row with items replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    The lexicon is learned as ``find_pii`` does it, so both find the same items. Null texts stay null, rows stay rows.
    """
    src = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    words = src.sparkSession.sparkContext.broadcast(learn_lexicon(src.where(F.length("text") > 0).distinct()) if lexicon is None else lexicon)
    return src.mapInArrow(partial(_redacted, lexicon=words), "doc_id bigint, text string")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


QUERIES = {
    "p9_found": lambda spark, sf: find_pii(_docs(spark, sf)),
    "p9_redacted": lambda spark, sf: redact(_docs(spark, sf)),
}
SQL: dict[str, str] = {}
