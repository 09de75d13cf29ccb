"""Text, date and list functions over columns. Null texts count as empty unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that name the biopsychosocial model.
BPS_SPELLINGS = ("biopsychosocial", "bio-psycho-social", "bio psycho social")
# Patterns of stated objectives in an abstract, tried in this order.
OBJECTIVE_PATTERNS = (
    r"(objective[s]?:\s.*?)(?:\n[A-Z][A-Z ]+?:|\nCONCLUSION|\nRESULTS|\nMETHODS|$)",
    r"(aim[s]?\s.*?)(?:\n[A-Z][A-Z ]+?:|\nCONCLUSION|\nRESULTS|\nMETHODS|$)",
)
# Headings that may stand before a sentence.
SECTION_PREFIX = (
    r"(?:objectives?|purpose(?:\s+of\s+review)?|aims?|background|introduction|methods?|results?|conclusions?"
    r"|reviewers?'?\s+conclusions?|authors?'?\s+conclusions?)\s*:\s*"
)
# Patterns of stated objectives in a full text, tried in this order.
FULLTEXT_OBJECTIVE_PATTERNS = (
    r"\b(?:objective|objectives|aim|aims|purpose)\s*[:\-]\s*(.{35,260}?\.)",
    r"\bthis\s+(?:systematic|scoping|narrative|umbrella|rapid|integrative|meta-analysis|network meta-analysis|review|study)"
    r"[^.]{0,120}?\b(?:aimed|was designed|sought|examined|evaluated|investigated)\s+to\s+(.{20,220}?\.)",
)
# Openings that a focus phrase loses, one after the other.
FOCUS_OPENINGS = (
    r"^(?:the\s+)?(?:objective|objectives|aim|aims|purpose)(?:\s+of\s+this\s+[^,.;:]{0,80})?\s+(?:was|were|is|are)?\s*(?:to\s+)?",
    r"^this\s+(?:systematic|scoping|narrative|umbrella|rapid|integrative|meta-analysis|network meta-analysis|review|study)"
    r"[^,.;:]{0,100}?\s+(?:aimed|was designed|sought|examined|evaluated|investigated)\s+to\s+",
    r"^to\s+",
)
FULLTEXT_HEAD = 14_000


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blob(title: Column, abstract: Column) -> Column:
    """The lower-case text that rules look at."""
    return F.lower(F.concat(blank(title), F.lit("\n"), blank(abstract)))


def contains_any(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether a term is anywhere in the text, inside words too."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def terms_found(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms that are anywhere in the text, inside words too, in order. Terms are not empty. Null for a null text.

    An automaton of all terms reads the text once, in Arrow batches. ``contains_any`` reads it once for each term, but in
    generated code and only until one is found, which is better for few terms or short texts.
    """
    if not all(terms):
        raise ValueError("a term is empty")
    sought = tuple(terms)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for t in sought:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({t for _, t in automaton.iter(s)}) if isinstance(s, str) else None for s in texts], dtype=object)

    return found(text) if sought else F.when(text.isNotNull(), F.array().cast("array<string>"))


def matches_any(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether a pattern matches, letter case aside and with Unicode word boundaries."""
    return text.rlike("(?iU)(?:" + "|".join(patterns) + ")")


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(title)), "[^a-z0-9]+", " "))


def normal_doi(doi: Column) -> Column:
    bare = F.lower(strip(blank(doi)))
    return F.replace(F.replace(bare, F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))


def normal_pmid(pmid: Column) -> Column:
    """Digits of a positive id, also of one that was stored as a decimal; else empty."""
    n = _try_cast(pmid, "double")
    return blank(F.when(n > 0, n.cast("decimal(20,0)").cast("string")))


def _try_cast(c: Column, kind: str) -> Column:
    return strip(c.cast("string")).try_cast(kind)


def year_of(year: Column) -> Column:
    """An integer year, also of a text like 2025.0; null for what is none."""
    return _try_cast(year, "double").cast("int")


def dedupe_key(doi: Column, title: Column, year: Column) -> Column:
    """The DOI, or else title and year. Records with neither DOI nor title share a key for each year."""
    d = normal_doi(doi)
    return F.when(d != "", d).otherwise(F.concat(normal_title(title), F.lit("::"), blank(year.cast("string"))))


def slug(c: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(made == "", "unnamed").otherwise(made)


def first_match(text: Column, patterns: tuple[str, ...], flags: str = "(?is)") -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.when(text.rlike(flags + p), F.regexp_extract(text, flags + p, 1)) for p in patterns))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def objective(abstract: Column) -> Column:
    """The stated objective or aim, or else the first sentence."""
    text = strip(blank(abstract))
    return F.coalesce(squeeze(first_match(text, OBJECTIVE_PATTERNS)), strip(sentences(text)[0]), F.lit(""))


def bps_location(title: Column, abstract: Column) -> Column:
    t, a = (contains_any(F.lower(blank(c)), BPS_SPELLINGS) for c in (title, abstract))
    return F.when(t & a, "title and abstract").when(t, "title only").when(a, "abstract only").otherwise("unclear")


def doi_url(doi: Column) -> Column:
    d = strip(blank(doi))
    return F.when(d != "", F.concat(F.lit("https://doi.org/"), d)).otherwise("")


def pmid_url(pmid: Column) -> Column:
    p = normal_pmid(pmid)
    return F.when(p != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), p, F.lit("/"))).otherwise("")


def words(text: Column) -> Column:
    return F.filter(F.split(blank(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("int")


def record_date(publication_date: Column, year: Column) -> Column:
    """The day, or else the first of the month, or else of the year that a record states.

    A day that no calendar has falls back to its month. The year's own field goes before a year inside the date's text,
    and if it is there but is no number, there is no date. Names of months are not read.
    """
    text = F.replace(strip(blank(publication_date)), F.lit("/"), F.lit("-"))
    whole = r"\b((?:19|20)\d{2})-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])\b"
    month = r"\b((?:19|20)\d{2})-(0?[1-9]|1[0-2])\b"
    y = strip(blank(year.cast("string")))

    def made(pattern: str, parts: int) -> Column:
        got = [F.regexp_extract(text, pattern, i + 1) for i in range(parts)] + [F.lit("1")] * (3 - parts)
        return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", *got), "y-M-d"))

    first = F.regexp_extract(text, "((?:19|20)[0-9]{2})", 1)
    of_year = F.when(y != "", F.try_to_date(F.lpad(year_of(y).cast("string"), 4, "0"), "yyyy")).when(first != "", F.try_to_date(first, "yyyy"))
    return F.coalesce(made(whole, 3), made(month, 2), of_year)


def normal_list(values: Column) -> Column:
    """Lower-case, squeezed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(squeeze(blank(v)))), lambda v: v != ""))


def packed(values: Column, sep: str = " | ") -> Column:
    return F.array_join(values, sep)


def unpacked(text: Column, sep: str = "|") -> Column:
    """The trimmed parts of a packed cell, without blanks."""
    return F.filter(F.transform(F.split(blank(text), "\\" + sep), strip), lambda v: v != "")


def problem_flags(text: Column) -> Column:
    """Parts of a cell that is a bracketed list of quoted words or a list by commas or bars."""
    bare = F.regexp_replace(blank(text), r"[\[\]']", "")
    return F.filter(F.transform(F.split(bare, r"[,|]"), strip), lambda v: v != "")


def shorten(text: Column, longest: int) -> Column:
    t = strip(blank(text))
    return F.when(F.length(t) <= longest, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, longest - 3)), F.lit("...")))


def compact_pain_label(label: Column) -> Column:
    t = squeeze(F.regexp_replace(blank(label), r"(?i)\b(?:chronic|pain)\b", ""))
    t = F.regexp_replace(t, r"^[ \-,/\t]+|[ \-,/\t]+$", "")
    return F.when(t != "", t).otherwise(strip(blank(label)))


def clean(text: Column) -> Column:
    """Squeezed, without headings before the sentence."""
    return F.regexp_replace(squeeze(blank(text)), f"^(?i:{SECTION_PREFIX})+", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once and named, however often it is used; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), use), 0)


def cut(text: Column, longest: int) -> Column:
    """At the last space that leaves room for an ellipsis, if the text is longer."""

    def shorter(head: Column) -> Column:
        return F.concat(F.when(head.contains(" "), F.rtrim(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1))).otherwise(head), F.lit("..."))

    return let(text, lambda t: F.when(F.length(t) > longest, let(F.substring(t, 1, longest - 3), shorter)).otherwise(t))


def _sentence(cleaned: Column, longest: int) -> Column:
    def shown(s: Column) -> Column:
        ended = F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))
        return let(ended, lambda e: F.concat(F.upper(F.substring(e, 1, 1)), F.substring(e, 2, 1_000_000_000)))

    return F.when(cleaned == "", "").otherwise(cut(let(strip(sentences(cleaned)[0]), shown), longest))


def first_sentence(text: Column, longest: int = 220) -> Column:
    """The first sentence, with a full stop and a capital letter, cut to a length."""
    return let(clean(text), lambda c: _sentence(c, longest))


def fulltext_objective(text: Column, head: int | None = FULLTEXT_HEAD) -> Column:
    """The objective that a full text states in its first ``head`` characters, or anywhere if None; empty if none is."""
    head = squeeze(blank(text) if head is None else F.substring(blank(text), 1, head))
    return first_sentence(blank(let(head, lambda h: first_match(h, FULLTEXT_OBJECTIVE_PATTERNS, "(?i)"))), 190)


def focus(text: Column) -> Column:
    """What an objective is about, without its opening."""
    t = clean(text)
    for opening in FOCUS_OPENINGS:
        t = F.regexp_replace(t, "(?i)" + opening, "")
    return cut(F.regexp_replace(t, "^[ .;:-]+|[ .;:-]+$", ""), 120)


def usable_focus(text: Column) -> Column:
    def test(t: Column) -> Column:
        low = F.lower(t)
        return (
            (word_count(low) >= 4)
            & ~low.rlike("^(?:this|it|there|about) ")
            & ~t.rlike(" (?:a|an|the|of|to|and|or|from|with)$")
            & ~low.rlike(r"\b(?:is|are)\b\s+(?:presented|described|discussed|reported)\b")
        )

    return let(strip(blank(text)), test)


def title_focus(title: Column) -> Column:
    t = F.regexp_replace(clean(title), r"\.+$", "")
    kind = r"(?i)[:,\-]?\s+a\s+(?:systematic\s+review(?:\s+and\s+meta-analysis)?|meta-analysis|scoping\s+review|narrative\s+review|network\s+meta-analysis)$"
    return F.regexp_replace(F.regexp_replace(t, kind, ""), "^[ .;:-]+|[ .;:-]+$", "")


def description(review_type: Column, phrase: Column) -> Column:
    """One sentence of a review's kind and focus."""

    def kind_of(k: Column) -> Column:
        return F.when(strip(k) == "", "review").otherwise(F.concat(F.lower(F.substring(k, 1, 1)), F.substring(k, 2, 1000)))

    def lowered(p: Column) -> Column:
        return F.when(p.rlike(r"^\p{Lu}(?!\p{Lu})"), F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))).otherwise(p)

    def said(p: Column) -> Column:
        verb = p.rlike(r"(?i)^(?:determine|evaluate|assess|examine|investigate|explore|describe|identify|summari(?:s|z)e|map|compare|review)\b")
        lead = F.when(p == "", " was focused on chronic pain evidence").otherwise(F.concat(F.when(verb, " was aimed to ").otherwise(" was focused on "), p))
        return F.concat(F.lit("This "), let(short_type(review_type), kind_of), lead, F.lit("."))

    return first_sentence(let(let(F.regexp_replace(strip(blank(phrase)), r"\.+$", ""), lowered), said), 160)


def describe(review_type: Column, title: Column, objective_text: Column, abstract: Column, fulltext: Column) -> Column:
    """struct of source, focus and description; the first usable of full text, title, objective and abstract."""
    texts = F.struct(
        fulltext_objective(fulltext).alias("full"),
        title_focus(F.when(blank(title) == "", "chronic pain evidence").otherwise(title)).alias("title"),
        first_sentence(objective_text, 180).alias("objective"),
        first_sentence(abstract, 180).alias("abstract"),
    )

    def choose(t: Column) -> Column:
        choices = (("fulltext_cached", t["full"], t["full"] != ""), ("title_fallback", t["title"], F.lit(True)), ("objective_text", t["objective"], F.length(t["objective"]) >= 35), ("abstract_first_sentence", t["abstract"], F.length(t["abstract"]) >= 50))
        ready = F.filter(F.array(*(F.struct(F.lit(s).alias("source"), x.alias("text"), ok.alias("ok")) for s, x, ok in choices)), lambda c: c["ok"])
        made = F.transform(ready, lambda c: F.struct(c["source"].alias("source"), focus(c["text"]).alias("focus")))
        first = F.get(F.filter(made, lambda c: usable_focus(c["focus"])), 0)
        titled = F.get(F.filter(made, lambda c: c["source"] == "title_fallback"), 0)
        return F.coalesce(first, titled)

    def finish(c: Column) -> Column:
        phrase = F.when(c["focus"] == "", "chronic pain evidence").otherwise(c["focus"])
        return F.struct(c["source"].alias("source"), phrase.alias("focus"), description(review_type, phrase).alias("description"))

    return let(let(texts, choose), finish)


def last_name(author: Column) -> Column:
    a = strip(author)
    return F.when(a.contains(","), strip(F.split(a, ",")[0])).otherwise(F.element_at(F.split(a, r"\s+"), -1))


def author_label(authors: Column) -> Column:
    """authors: packed. One or two last names, or the first and et al."""
    parts = unpacked(authors)
    n = F.size(parts)
    one = last_name(F.get(parts, 0))
    return F.when(n == 0, "Anon.").when(n == 1, one).when(n == 2, F.concat(one, F.lit(" & "), last_name(F.get(parts, 1)))).otherwise(F.concat(one, F.lit(" et al.")))


def sort_year(record_id: Column, year: Column, overrides: dict[str, int] | None = None, missing: int = 9999) -> Column:
    own = F.lit(None).cast("int")
    for key, y in (overrides or {}).items():
        own = F.when(record_id == key, F.lit(y)).otherwise(own)
    return F.coalesce(own, year_of(year), F.lit(missing))


def domain_cell(bio: Column, psych: Column, social: Column) -> Column:
    marks = F.array_compact(F.array(*(F.when(F.lower(strip(blank(c))) == "yes", m) for c, m in ((bio, "B"), (psych, "P"), (social, "S")))))
    return F.when(F.size(marks) == 0, "---").otherwise(F.array_join(marks, ", "))


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


# Short forms of labels in tables.
SHORT_TYPES = {
    "narrative or expert review": "Narrative review",
    "systematic review": "Systematic review",
    "meta-analysis": "Meta-analysis",
    "scoping or mapping review": "Scoping review",
    "network meta-analysis": "Network meta-analysis",
}
SHORT_PAIN = {
    "chronic secondary musculoskeletal pain": "Musculoskeletal",
    "mixed or unspecified chronic pain": "Mixed/Unspecified",
    "chronic secondary headache or orofacial pain": "Headache/Orofacial",
    "chronic secondary visceral pain": "Visceral",
    "chronic neuropathic pain": "Neuropathic",
    "chronic primary pain": "Primary",
    "chronic postsurgical or posttraumatic pain": "Postsurgical",
    "chronic cancer-related pain": "Cancer-related",
}
SHORT_TYPOLOGY = {
    "multifactorial signal": "Multifactorial",
    "potential integrative signal": "Integrative",
    "pseudo-bps or partial signal": "Pseudo-BPS",
    "rhetorical label signal": "Rhetorical",
}
SHORT_FUNCTION = {
    "background framing": "background",
    "intervention rationale": "intervention",
    "organizing principle": "organizing",
    "explanatory framework": "explanatory",
    "policy/practice implication": "policy/practice",
    "rhetorical label": "rhetorical",
}
SHORT_LOCATION = {"title and abstract": "title+abstract", "title only": "title", "abstract only": "abstract", "unclear": "unclear"}


def relabel(c: Column, names: dict[str, str], *, fold: bool = True) -> Column:
    """A label's replacement, or the label itself."""
    key = F.lower(strip(blank(c))) if fold else c
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key], c)


def short_type(c: Column) -> Column:
    return relabel(blank(c), SHORT_TYPES)


# What other wordings of a choice stand for.
CHOICE_ALIASES = {
    "scoping review": "scoping or mapping review",
    "mapping review": "scoping or mapping review",
    "narrative review": "narrative or expert review",
    "expert review": "narrative or expert review",
    "systematic literature review": "systematic review",
    "mixed or unclear chronic pain": "mixed or unspecified chronic pain",
    "chronic postsurgical pain": "chronic postsurgical or posttraumatic pain",
    "chronic post-traumatic pain": "chronic postsurgical or posttraumatic pain",
    "background": "background framing",
    "organising principle": "organizing principle",
    "policy implication": "policy/practice implication",
    "practice implication": "policy/practice implication",
    "pseudo-bps or partial signal": "pseudo-bps or partial signal",
    "pseudo bps or partial signal": "pseudo-bps or partial signal",
}


def choice(value: Column, allowed: list[str] | tuple[str, ...], otherwise: Column) -> Column:
    """The allowed label that a value or its alias names, letter case and underscores aside; else ``otherwise``."""
    names = {a.lower().replace("_", " "): a for a in allowed}
    names = {k: v for k, v in CHOICE_ALIASES.items() if v in allowed} | names
    text = squeeze(F.replace(F.lower(blank(value)), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[text], otherwise)


def bare_json(text: Column) -> Column:
    """The JSON inside a model's answer: without code fences, or else from its first brace or bracket to the last of its kind."""
    t = strip(blank(text))
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")).otherwise(t)
    found = [F.regexp_extract(t, p, 0) for p in (r"(?s)[\{\[].*[\}\]]", r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(F.when(F.try_parse_json(t).isNotNull(), t), *(F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in found))


def occurrences(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """How often the terms are in the text, each counted without overlaps."""
    return reduce(lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in terms])


def latex(text: Column) -> Column:
    return F.regexp_replace(blank(text), r"([&%$#_{}])", r"\\$1")


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags."""
    t = F.regexp_replace(blank(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return squeeze(t)
