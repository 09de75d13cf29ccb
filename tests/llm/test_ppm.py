import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import ppm


def plain(texts, order):
    """Scores by walking nested counts, one symbol at a time."""
    trie = defaultdict(Counter)
    for t in texts:
        s = [0] * order + [b + 1 for b in t] + [257]
        for i in range(order, len(s)):
            for j in range(order + 1):
                trie[tuple(s[i - j : i])][s[i]] += 1

    def score(t):
        s = [0] * order + [b + 1 for b in t] + [257]
        total = 0.0
        for i in range(order, len(s)):
            gone = set()
            for j in range(order, -1, -1):
                seen = {x: n for x, n in trie.get(tuple(s[i - j : i]), {}).items() if x not in gone}
                if not seen:
                    continue
                w = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / w)
                    break
                total += math.log10(len(seen) / w)
                gone |= seen.keys()
            else:
                total -= math.log10(max(257 - len(gone), 1))
        return total

    return score


TEXTS = [b"", b"abab", b"abracadabra", b"the cat sat on the mat", bytes(range(256)), b"a" * 300, "é ü ß".encode()]


def lengths(spark, train, more, order):
    """Code lengths of all grams of training texts and of further ones."""
    k, n = np.unique(ppm.grams_of(train, order)[0], return_counts=True)
    counts = dict(zip(k.tolist(), n.tolist(), strict=True))
    rows = [(g, counts.get(g, 0)) for g in counts.keys() | set(more)]
    got = ppm.code_lengths(spark.createDataFrame(rows, "g bigint, c bigint"), order, len(rows)).collect()
    assert len(got) == len(rows)
    return ppm.Lookup(np.array([r["g"] for r in got], np.uint64), np.array([r["cost"] for r in got]))


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_code_lengths_agree_with_nested_counts(spark, order):
    train = [TEXTS[1], TEXTS[2], TEXTS[3], TEXTS[5]]
    got = ppm.log10_scores(lengths(spark, train, ppm.grams_of(TEXTS, order)[0].tolist(), order), TEXTS, order)
    want = [plain(train, order)(t) for t in TEXTS]
    assert got == pytest.approx(want, rel=1e-12)


def test_probabilities_of_all_symbols_sum_to_one(spark):
    contexts = [sum((b + 1) << (9 * (3 - i)) for i, b in enumerate(c)) for c in (b"abr", b"zzz", b"cab", b"xra")]
    grams = np.array([[c | s for s in range(1, 258)] for c in contexts], np.uint64)
    t = lengths(spark, [b"abracadabra", b"abacus"], grams.ravel().tolist(), 3)
    for g in grams:
        assert (10.0 ** -t[g]).sum() == pytest.approx(1, rel=1e-12)


def test_lookup_holds_all_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, 50_000).astype(np.uint64), np.arange(3, dtype=np.uint64)]))
    rng.shuffle(keys)
    values = rng.random(len(keys))
    assert (ppm.Lookup(keys, values)[keys] == values).all()


def test_adaptive_learns_repeats():
    once, twice = ppm.adaptive_log10(b"abcdefgh"), ppm.adaptive_log10(b"abcdefgh" * 20)
    assert once < 0 and twice / 160 > once / 8 / 4
    assert ppm.adaptive_log10(b"") == pytest.approx(-math.log10(257))


def base(rows):
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    c = Counter(w for t in train for w in t.lower().split())
    if train:
        c[None] = len(train)
    n, v = sum(c.values()), len(c)
    out = {}
    for k, t in rows:
        w = [*t.lower().split(), None]
        out[k] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out, train


@pytest.mark.parametrize("options", [{}, {"order": 2}, {"block_bytes": 10_000}])
def test_query_agrees_with_plain_versions(spark, sf, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.where("doc_id < 60") if options else docs
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want, train = base(rows)
    score = plain(train, options.get("order", ppm.ORDER))
    got = {r["doc_id"]: r for r in (ppm.score(docs, **options) if options else ppm.op6_ppm(spark, sf)).collect()}
    assert got.keys() == want.keys()
    for k, t in rows:
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[k][:3]
        assert r["base_score"] == pytest.approx(want[k][3], rel=1e-11)
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0)
        assert r["score"] == pytest.approx(score(t), rel=1e-11)


def test_scores_do_not_depend_on_the_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [sorted(tuple(r) for r in ppm.score(docs, block_bytes=b).collect()) for b in (1 << 30, 20_000)]
    assert got[0] == got[1]


def test_adaptive_scores(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (None, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["score"] for r in ppm.adaptive(docs).collect()} == {1: ppm.adaptive_log10(b"abcabc"), None: ppm.adaptive_log10(b"")}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, 3), (2, "", 4), (3, "a b a", 5), (3, "a b a", 5), (3, "c", 6), (None, "x", 1), (9, "a " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    got = ppm.score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 1), (2, 1), (3, 2), (3, 4), (3, 4), (9, 30_001)]
    assert len({(r["score"], r["base_score"], r["n_known"]) for r in got if r["n_tokens"] == 4}) == 1
    assert ppm.score(docs.where(F.lit(False))).count() == 0
    assert ppm.score(docs.where("doc_id is null")).first()["score"] == pytest.approx(-2 * math.log10(257))


def test_a_row_repeated_very_often_fills_many_blocks(spark):
    docs = spark.range(300_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    sizes = [r["n"] for r in ppm.packs(docs, 12, "doc_id", "text").groupBy("block").agg(F.sum(F.size("keys")).alias("n")).collect()]
    assert len(sizes) == 12 and sum(sizes) == 300_000 and max(sizes) <= 1.1 * 25_000
    some = docs.limit(20_000)
    got = ppm.score(some, block_bytes=20_000).distinct().collect()
    assert len(got) == 1 and got[0]["n_tokens"] == got[0]["n_known"] == 4 and got[0]["train_tokens"] == 4 * 20_000
