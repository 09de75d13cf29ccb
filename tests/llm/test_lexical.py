import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litmill.llm import lexical
from tests import harness

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """docs: key, text; items: item, text. All scores of all pairs, sorted."""
    counts = [(key, Counter(split(t))) for key, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    documents, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for (key, c), n in zip(counts, sizes, strict=True):
            m = 10 + 90 * n * documents // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            scored += [(-s, key is None, key or 0)] * (s > 0)
        out += [(i, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


NAMES = ("key", "n", "terms", "tfs", "item", "term", "rank", "score")
EXTRA = ", ".join(f"{n} string" for n in NAMES)


def frame(spark, rows, names):
    return spark.createDataFrame([(*r, *NAMES) for r in rows], f"{names} bigint, text string, {EXTRA}")


@pytest.mark.parametrize(("block", "first", "items_a_pass"), [(2_000_000, 8, 200_000), (40, 1, 30), (500, 2, 7)])
def test_best_documents_agree_with_brute_force(spark, monkeypatch, block, first, items_a_pass):
    for name, value in (("BLOCK_POSTINGS", block), ("FIRST_ROUND", first), ("ITEM_TERMS", items_a_pass)):
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(13)
    words = [f"t{i}" for i in range(60)] + ["É", "é", "ÄB", "x1", "😀"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: "".join(w + rnd.choice([" ", "-", "_.", "\n"]) for w in rnd.choices(words, weights, k=n))
    docs = [(i % 190 if i % 50 else None, text(rnd.randrange(40))) for i in range(400)]
    docs += [(7, "same T1 t2")] * 30 + [(500, None), (501, ""), (502, "!?"), (503, "t3 " * 20_000)]
    items = [(i, text(rnd.randrange(1, 9))) for i in range(25)] + [(None, "t5 t6"), (3, "t59"), (90, None), (91, "..."), (92, "absent"), (93, "T1 t1 t1")]
    got = lexical.search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, lexical.BEST)


def test_stops_before_it_has_met_every_document():
    n, terms = 20_000, 6
    rng = np.random.default_rng(5)
    lengths = np.full(n, terms)
    tf = rng.zipf(2.0, n * terms).clip(1, 500).astype(np.int64)
    block = lexical.Block(pa.array(np.arange(n)), np.full(n, 300), lengths, np.tile(np.arange(terms), n), tf, np.array([9000, 50, 40, 30, 20, 10]), n, 300 * n)
    own = np.arange(terms)
    at, score, met = block.best(own, 10)
    every = block.scores(np.arange(n), np.ones(terms, bool))
    want = np.lexsort((np.arange(n), -every))[:10]
    assert at.tolist() == want.tolist() and score.tolist() == every[want].tolist()
    assert met < n / 10 and not block.met.any()


def test_query_agrees_with_its_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert harness.differences(spark, harness.connect(sf_dir), sf_dir, lexical.op13_lexical, lexical.OP13_SQL) == ""


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")], "doc_id"), frame(spark, [(1, "b")], "item_id")
    none = F.lit(False)
    assert lexical.search(docs.where(none), items).count() == 0
    assert lexical.search(docs, items.where(none)).count() == 0
    assert lexical.search(docs, frame(spark, [(1, "--")], "item_id")).count() == 0
