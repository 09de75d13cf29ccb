import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from litmill.llm import pii


def plain(t):
    """The base patterns as they are written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_agree_with_the_patterns():
    random.seed(4)
    for alphabet in ("ab@@..-+123 0(4", "0123456789 -", "+()1 .-", "a.1@-é"):
        for _ in range(6000):
            s = "".join(random.choice(alphabet) for _ in range(random.randrange(50)))
            assert pii.find(s) == plain(s), s


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john.doe [at] mail4 dot example dot com now", "email", "john.doe [at] mail4 dot example dot com"),
        ("so john at mail.example.com says", "email", "john at mail.example.com"),
        ("mail ann @ mail . example . org. Then", "email", "ann @ mail . example . org"),
        ("mail ann @ mail.example.org. Then", "email", "ann @ mail.example.org"),
        ("J (AT) x (DOT) org", "email", "J (AT) x (DOT) org"),
        ("call plus one two three four five six seven eight nine zero one.", "phone", "plus one two three four five six seven eight nine zero one"),
        ("at one nine two dot one six eight dot one dot two three", "ip", "one nine two dot one six eight dot one dot two three"),
        ("192 dot 168 dot one dot one", "ip", "192 dot 168 dot one dot one"),
        ("192.168.1 dot one", "ip", "192.168.1 dot one"),
        ("call +1 415 555 01 nine nine.", "phone", "+1 415 555 01 nine nine"),
        ("call +1 415 555 five 5 five 0.", "phone", "+1 415 555 five 5 five 0"),
        ("call +1 (four one five) 555-0199.", "phone", "+1 (four one five) 555-0199"),
        ("card four one one one 1111 1111 1111?", "card", "four one one one 1111 1111 1111"),
        ("mail ann @\tmail.example.org", "email", "ann @\tmail.example.org"),
        ("mail " + "n" * 900 + " [at] " + "d" * 700 + " dot com", "email", "n" * 900 + " [at] " + "d" * 700 + " dot com"),
        ("192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
        ("é 192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
        ("my exаmple@mаil.example.com", "email", "exаmple@mаil.example.com"),
        ("４１１１ １１１１ １１１１ １１１１!", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("a@b​.com", "email", "a@b​.com"),
    ],
)
def test_disguises_map_back(text, kind, span):
    base, spans = pii.scan(text)
    assert base == plain(text)
    at = text.index(span)
    assert (at, pii.KINDS.index(kind), at + len(span)) in spans


@pytest.mark.parametrize("text", ["", "we met at noon and at home.Then", "one two three", "one of two, at a dot", "Ünder dem point", "x" * 3000, "1" * 3000, "a@" * 2000, "." * 2000 + "@", "[at] " * 2000])
def test_clean_texts_have_no_spans(text):
    assert pii.scan(text)[1] == plain(text) == []


def test_long_runs_take_linear_time():
    for text in ("1" * 2_000_000, "a" * 2_000_000 + "@", "a@" * 500_000, "+1" * 500_000, "a at " * 200_000 + ".com", "one 1 " + "1" * 1_000_000, "one 1" + " " * 1_000_000 + "x", "plus " * 200_000 + "one 1 x", "a @ " * 200_000, "a (at) b.c" * 100_000):
        assert pii.scan(text)[0] == []


def test_many_spans_take_linear_time():
    import time

    def took(n):
        text = "ann [at] x dot org, 10 [.] 1 [.] 1 [.] 1 and a@b.com, one nine two dot one dot one dot one; " * n
        began = time.perf_counter()
        base, spans = pii.scan(text)
        assert len(base) == n and len(spans) == 4 * n
        return time.perf_counter() - began

    took(10)
    assert took(16_000) < 16 * max(took(2_000), 0.05)


def test_query_agrees_with_a_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op4_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "a@b.c", "x"), (2, "a@b.c", None), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in pii.pii_digest(docs).collect()) == [(0, ""), (1, ""), (2, "email:0:5"), (2, "email:0:5")]
    assert pii.find_pii(docs).where(F.size("base") == 1).count() == 2
    assert pii.pii_digest(docs.where(F.lit(False))).count() == 0
