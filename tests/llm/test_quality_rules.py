import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litmill.llm import quality_rules as qr
from tests import harness

NAMES = ("of", "words", "lines", "spaced", "cores", "windows", "starts", "counts", "chars", "classes", "kept", "ref_words", "row", "n")
SCHEMA = "doc_id bigint, text string, lang string, " + ", ".join(f"{n} string" for n in NAMES)


def base(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def counted(docs):
    return {r["doc_id"]: tuple(r)[1:6] + (r["base_failed"],) for r in qr.measure(docs).collect()}


@pytest.mark.parametrize("few", [0, 3, 10**9])
def test_counts_agree_with_a_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(qr, "FEW", few)
    rnd = random.Random(11)
    bits = ["a", "b", "c d", "#", "|x", "\n", "\t", " ", "é", "😀", "the", "The\x0b", "a b c", "\n\n", "x y z\n", "\x85", "\xa0"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(120))) for _ in range(300)]
    texts += [None, "", "a", "a b", "a b c", "a a a a", "w " * 30_000, " ".join(f"w{i % 9000}" for i in range(30_000)), "v" * 300_000]
    rows = [(i, t, [None, "en", "xx"][i % 3], *NAMES) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert counted(docs) == {i: base(t) for i, t in enumerate(texts)}


def plain_distance(p, q):
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0, kl(p, m) + kl(q, m)) / 2)


def test_distances_agree_with_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    refs = {r["of"]: r for r in qr.references(docs).collect()}
    core = lambda w: re.sub(qr.MARKS, "", w)
    words = {r["doc_id"]: [core(x) for x in re.split("[\x20\x09-\x0d]+", r["text"] or "") if x] for r in rows}
    for lang, ref in refs.items():
        n = Counter(w for r in rows if r["lang"] == lang for w in words[r["doc_id"]])
        total = sum(n.values())
        del n[""]
        top = sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[: qr.COMMON]
        assert ref["common"] == [w for w, _ in top] and ref["ref_words"] == total
        assert ref["ref_common"] == pytest.approx([k / total for _, k in top] + [1 - sum(k for _, k in top) / total])
    for r in qr.measure(docs).collect():
        row = next(x for x in rows if x["doc_id"] == r["doc_id"])
        ref, own = refs[row["lang"]], words[r["doc_id"]]
        assert (r["word_distance"] is None) == (len(own) < qr.MIN_TOKENS) and (r["class_distance"] is None) == (len(row["text"]) < qr.MIN_CHARS)
        if r["word_distance"] is not None:
            n = Counter(own)
            p = [n[w] / len(own) for w in ref["common"]]
            assert r["word_distance"] == pytest.approx(plain_distance([*p, 1 - sum(p)], ref["ref_common"]), abs=1e-9)
        if r["class_distance"] is not None:
            p = [len(re.findall(f"[{c}]", row["text"])) / len(row["text"]) for c in qr.CLASSES]
            assert r["class_distance"] == pytest.approx(plain_distance([*p, 1 - sum(p)], ref["ref_classes"]), abs=1e-9)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_agrees_with_its_sql(spark, sf_dir):
    assert harness.differences(spark, harness.connect(sf_dir), sf_dir, qr.op11_quality, qr.OP11_SQL) == ""


def test_junk_goes_and_clean_texts_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in qr.op11_quality(spark, sf_dir).collect()}
    marked = [(kept[r["doc_id"]], r["quality"], base(r["text"])[-1]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()]
    good = [k for k, q, failed in marked if q == 1 and not failed]
    bad = [k for k, q, _ in marked if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.03 * len(bad)


def test_nulls_repeats_guards_clashing_names_and_empty_tables(spark):
    long = " ".join(f"the word{i} of item{i}" for i in range(600))
    rows = [(1, long, "en"), (1, long, "en"), (None, long + " end.", "en"), (2, None, "en"), (3, "", None), (4, long.upper() + "!!!", "en"), (5, " ".join(f"u{i}" for i in range(60)), "few")]
    docs = spark.createDataFrame([(*r, *NAMES) for r in rows], SCHEMA)
    refs = qr.references(docs.where("doc_id = 1 or lang is null or lang = 'few'"))
    got = {(r["doc_id"], r["kept"], r["class_distance"] is None) for r in qr.measure(docs, refs=refs).collect()}
    assert got == {(1, True, False), (None, True, False), (2, False, True), (3, False, True), (4, False, False), (5, True, True)}
    kept = qr.keep(docs, refs=refs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 5]
    assert all(tuple(r)[3:] == NAMES for r in kept.collect())
    none = docs.where(F.lit(False))
    assert qr.measure(none).count() == 0 == qr.keep(none).count() == qr.references(none).count()
