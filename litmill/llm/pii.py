"""Personal data: identifiers as they stand, and identifiers in disguise.

Base spans are what four fixed patterns find in the text itself. Then a chain of transducers rewrites the text: look-alike
characters become ASCII and invisible ones go, spelled digits become digits, and written-out at and dot signs become the
signs. Each transducer carries for every character that it emits where the source of it starts and ends, so that what the
patterns find in the rewritten text maps back to a span of source characters. Such spans are added to the base ones.

Offsets are code points, ends exclusive. Texts without any trigger of a transducer are not rewritten. The scans are
linear in the text, also in long runs of digits or of address characters and among many spans; names, hosts and texts of
any length are read whole.

Nulls: a null text counts as empty and has no spans. Repeated rows give repeated results. Spans that start together go by
kind. Columns other than the key and the text are left out, so their names can't clash. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from litmill.llm._base import map_rows, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
# Possessive runs and the look-behind only save attempts that would fail: a dot never belongs to a run of digits.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(t: str) -> list[tuple[int, int]]:
    """A local part is the run of its characters before an @, no further back than the last match."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > free and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
            at = t.find("@", free)
        else:
            free = at + 1  # no local part reaches over an @
            at = t.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) < 4 and int(bare or 0) <= 255


def find(t: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns, in order."""
    out = [(a, 0, b) for a, b in _emails(t)] if "@" in t else []
    if DIGIT.search(t):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(map(_small, m.groups()))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαοινυρΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡıℓ",
        "aeopcyxijshdqwABEKMHOPCTXIJSaoivupABEZHIKMNOPTYXgil",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
HYPHENS = "‐‑‒–−"


@lru_cache(maxsize=1)
def _glyphs() -> dict[str, str]:
    """Every character that stands for one ASCII character: compatibility forms by Unicode's rule, and the lists above."""
    out = {chr(c): d for c in range(0x2070, 0x1FBFA) if len(d := unicodedata.normalize("NFKC", chr(c))) == 1 and "!" <= d <= "~"}
    return out | LOOKALIKES | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(HYPHENS, "-")


@lru_cache(maxsize=1)
def _glyph_search() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, _glyphs())) + "]")


# Words for the digits 0 to 9 in the languages that are read.
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
DIGIT_OF = {w: str(d) for d, words in enumerate(DIGIT_WORDS) for w in words}
_WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_DOT_WORD = r"\b(?:dot|point|punkt|punto)\b"
_NUMBER = rf"(?:\b{_WORD}\b|[0-9]+)"
#: Digit words and numbers in a row, between them white space, signs that phone numbers hold, or dots.
RUN = re.compile(rf"(?:\bplus[\s-]+|\+\s*)?\(?{_NUMBER}(?:(?:[\s-]*(?:{_DOT_WORD}|\.)[\s-]*|[\s,()-]*){_NUMBER})+", re.I)
_PIECE = re.compile(rf"(?P<plus>\bplus[\s-]+)|(?P<dot>[\s-]*{_DOT_WORD}[\s-]*)|(?P<word>\b{_WORD}\b)|(?P<number>[0-9]+)|(?P<gap>[\s,-]+)|(?P<sign>[.()+])", re.I)
#: So many digit words make a run one that is spelled; fewer do if a dot is.
LEAST_SPELLED = 2

_AT = r"(?:at|arroba|ät)"
_DOT = r"(?:dot|punkt|punto|point)"
_NAME = r"[A-Za-z0-9._%+-]++"
_LABEL = r"[A-Za-z0-9-]+"
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_ANY_DOT = rf"(?:{_OPEN}{_DOT}{_CLOSE}|\s+{_DOT}\s+|{_OPEN}\.{_CLOSE}|\.)"
_MARKED_AT = rf"(?:{_OPEN}(?:{_AT}|@){_CLOSE})"
# Endings that make a plain "name at host.ending" an address.
ENDINGS = (".com", ".org", ".net", ".edu", ".gov", ".info", ".io")
_ENDINGS = "(?:" + "|".join(map(re.escape, ENDINGS)) + ")"
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])({_NAME})(?:"
    rf"({_MARKED_AT})({_LABEL}(?:{_ANY_DOT}{_LABEL})+)"
    rf"|(\s*@\s*|\s+{_AT}\s+)({_LABEL}(?:\.{_LABEL})*(?:(?:{_OPEN}{_DOT}{_CLOSE}|\s+{_DOT}\s+){_LABEL}(?:\.{_LABEL})*)+)"
    rf"|(\s+{_AT}\s+)({_LABEL}(?:\.{_LABEL})*{_ENDINGS}(?![A-Za-z0-9-]))"
    rf"|(\s+@\s+)({_LABEL}(?:(?:\s+\.\s+|\.){_LABEL})+)"
    r")",
    re.I,
)
_DOTS = re.compile(rf"{_OPEN}{_DOT}{_CLOSE}|\s+{_DOT}\s+|{_OPEN}\.{_CLOSE}|\s+\.\s+", re.I)
NUMERIC_DOT = re.compile(rf"(?<=[0-9])(?:{_OPEN}(?:{_DOT}|\.){_CLOSE}|\s+{_DOT}\s+)(?=[0-9])", re.I)
SIGN = re.compile(rf"[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]|\s(?:{_AT})(?=\s)|@", re.I)


#: All characters of _glyphs() are among these.
_BEYOND = re.compile("[\xad\u0100-\U0010ffff]")
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_SPELLING = dict.fromkeys(DIGIT_OF, 1) | dict.fromkeys(_DOT_WORDS, 2)
#: A digit word beside another one, a word for the dot, or a number.
_BESIDE = re.compile(b"\x01[\x01\x02\x03]|[\x02\x03]\x01")
_JOINS = "-,.()+"
_AT_GAP = re.compile(r"@\s")


def _may_spell(low: str) -> bool:
    """Whether a digit word stands beside what it can be read with."""
    for c in _JOINS:
        low = low.replace(c, " ")
    words = low.split()
    if not any(map(DIGIT_OF.__contains__, words)):
        return False
    return _BESIDE.search(bytes(_SPELLING.get(w) or 3 * ("0" <= w[0] <= "9") for w in words)) is not None


def _may_hide(t: str, low: str) -> bool:
    """Whether there is what every form of a written-out sign needs: a bracket, a word for the dot, a gap behind an @, or an ending with an at."""
    return any(c in t for c in "[({<") or any(w in low for w in _DOT_WORDS) or "@" in t and _AT_GAP.search(t) is not None or any(w in low for w in ENDINGS) and any(w in low for w in ("at", "arroba", "ät"))


class Tape:
    """A text with, for each of its characters, the span of source characters it comes from. None: the text is the source."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace spans, ordered and apart, by strings; each character of a string comes from its whole span."""
        if not edits:
            return self
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        text, s, e, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            s += starts[at:a] + [starts[a]] * len(new)
            e += ends[at:a] + [ends[b - 1]] * len(new)
            at = b
        out = Tape("".join([*text, self.text[at:]]))
        out.starts, out.ends = s + starts[at:], e + ends[at:]
        return out

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


def _unglyph(t: Tape) -> Tape:
    if t.text.isascii() or not _BEYOND.search(t.text):
        return t
    g = _glyphs()
    return t.rewrite([(m.start(), m.end(), g[m[0]]) for m in _glyph_search().finditer(t.text)])


def _unspell(t: Tape) -> Tape:
    if not _may_spell(t.text.lower()):
        return t
    edits = []
    for m in RUN.finditer(t.text):
        pieces = list(_PIECE.finditer(t.text, m.start(), m.end()))
        spelled = [p.lastgroup == "word" for p in pieces]
        if sum(spelled) < (1 if any(p.lastgroup == "dot" for p in pieces) else LEAST_SPELLED):
            continue
        for i, p in enumerate(pieces):
            if p.lastgroup == "plus":
                edits.append((p.start(), p.end(), "+"))
            elif p.lastgroup == "dot":
                edits.append((p.start(), p.end(), "."))
            elif p.lastgroup == "word":
                edits.append((p.start(), p.end(), DIGIT_OF[p[0].lower()]))
            elif p.lastgroup == "gap" and spelled[i - 1] and spelled[i + 1]:  # a run neither starts nor ends with a gap
                edits.append((p.start(), p.end(), ""))
    return t.rewrite(edits)


def _undot(t: Tape) -> Tape:
    text = t.text
    if not _may_hide(text, text.lower()):
        return t
    edits, free = [], 0
    for sign in SIGN.finditer(text):
        if sign.start() < free:
            continue
        end = sign.start()
        while end > free and text[end - 1].isspace():
            end -= 1
        start = end
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < end and (m := ADDRESS.match(text, start)):
            k = next(k for k in (2, 4, 6, 8) if m[k])
            edits.append((m.start(k), m.end(k), "@"))
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(text, m.start(k + 1), m.end(k + 1))]
            free = m.end()
    taken, at = edits.copy(), 0
    for m in NUMERIC_DOT.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():  # both are in order
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            edits.append((m.start(), m.end(), "."))
    return t.rewrite(sorted(edits))


def disguised(t: str) -> list[tuple[int, int, int]]:
    """What the patterns find after rewriting, as source spans; only if something was rewritten."""
    tape = _undot(_unspell(_unglyph(Tape(t))))
    if tape.starts is None:
        return []
    out = set()
    for a, k, b in find(tape.text):
        s, e = tape.source(a, b)
        out.add((s, k, e))
    return sorted(out)


def scan(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and those in disguise that no base span of the kind contains."""
    base = find(t)
    of_kind: list[list[tuple[int, int, int]]] = [[] for _ in KINDS]
    for x in base:
        of_kind[x[1]].append(x)
    at, more = [0] * len(KINDS), []
    for a, k, b in disguised(t):  # in order, as the base spans of a kind are, which also lie apart
        own = of_kind[k]
        while at[k] < len(own) and own[at[k]][2] <= a:
            at[k] += 1
        if at[k] == len(own) or not (own[at[k]][0] <= a and b <= own[at[k]][2]):
            more.append((a, k, b))
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans: arrays of kind, start, end."""
    kind = "array<struct<kind:string,start:int,end:int>>"

    def start():
        def row(k, t):
            base, spans = scan(t or "")
            yield k, *([{"kind": KINDS[x], "start": a, "end": b} for a, x, b in y] for y in (base, spans))

        return row

    return map_rows(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, base {kind.replace(',', ', ')}, spans {kind.replace(',', ', ')}", start)


def pii_digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a count of base spans for each kind, n_added, the hash of the base spans, all spans as text."""

    def start():
        def row(k, t):
            base, spans = scan(t or "")
            n = [sum(x[1] == i for x in base) for i in range(4)]
            yield k, *n, len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)

        return row

    schema = f"{key} {dict(docs.dtypes)[key]}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string"
    return map_rows(docs.select(key, text), schema, start)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))
