import random

import corpus_pipeline
from litmill.llm import similar, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """Each key's smallest near copy, by similarity alone."""
    up = {k: k for k, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    g = {k: grams(t) for k, t in rows}
    for a in g:
        for b in g:
            if a < b and 5 * len(g[a] & g[b]) >= 4 * len(g[a] | g[b]):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {k: root(k) for k in up}


def rows_of(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(12):
        t = rnd.choices(words, k=200)
        for j in range(14):
            u = list(t)
            for _ in range(j % 5):  # one word changed breaks five shingles
                u[rnd.randrange(200)] = rnd.choice(words)
            rows.append((100 * i + j, " ".join(u)))
    return rows


def test_pairs_agree_with_brute_force():
    rows = rows_of(1)
    got = similar.similar_pairs([similar.shingles(similar._words(t)) for _, t in rows])
    forest = similar.Forest(len(rows))
    assert all(forest.join(*x) for x in got)
    want = brute(rows)
    assert {k: rows[forest.root(i)][0] for i, (k, _) in enumerate(rows)} == want


def test_documents_that_are_no_near_copies_stay(spark, sf, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    t = rnd.choices(words, k=300)
    near = [*t[:150], "new", *t[151:]]
    far = [x if i % 17 else f"other{i}" for i, x in enumerate(t)]  # fingerprints are close, most shingles are not shared
    rows = [(1, " ".join(t)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(t).upper()), (5, "")]
    codes = {k: simhash.fingerprint(x, tables=4, distinct=True) for k, x in rows}
    monkeypatch.setattr(similar, "DISTANCE", 90)
    apart = sum(bin(a ^ b).count("1") for a, b in zip(codes[1], codes[3], strict=True))
    assert apart <= 90 and brute(rows[:3])[3] == 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == [1, 3, 5]


def test_stage_agrees_with_brute_force_by_similarity_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set(brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == sorted(want)


def test_texts_that_repeat_themselves_are_found(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(20):
        t = rnd.choices(words, k=200)
        rows += [(10 * i, " ".join(t)), (10 * i + 1, " ".join(t + t[20:25] * 400)), (10 * i + 2, " ".join(t[:190] + t * 3)), (10 * i + 3, " ".join([*t[:100], *(f"new{j}" for j in range(20 * (i % 3))), *t[100:]]))]
    want = brute(rows)
    assert len(set(want.values())) < len(rows) / 2
    found = {r["doc_id"]: r["kept_key"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == want


def linked_pairs(rows):
    """All pairs of unlike texts at LEAST or more, by their distinct shingles."""
    g = [(k, grams(t)) for k, t in rows]
    return {(a, b) for i, (a, x) in enumerate(g) for b, y in g[i + 1 :] if 5 * len(x & y) >= 4 * len(x | y) and x != y}


def test_short_texts_and_tails_are_found_nearly_always(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(1500):
        n = 6 + i % 35
        t = rnd.choices(words, k=n)
        cut = rnd.randrange(1, max(2, n // 8))
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(rnd.choice([t[cut:], t + rnd.choices(words, k=cut), t[:-cut] + rnd.choices(words, k=1)])))]
    want = set()
    for i in range(0, len(rows), 2):
        want |= linked_pairs(rows[i : i + 2])
    found = {r["doc_id"]: r["kept_key"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hit = sum(found[a] == found[b] for a, b in want)
    assert len(want) > 300 and hit >= 0.95 * len(want)


def test_large_classes_are_cut_without_loss(spark, monkeypatch):
    rows = rows_of(5)
    sets = [(b"all", i, len(s), s.tolist()) for i, s in ((k, similar.shingles(similar._words(t))) for k, t in rows)]
    frame = spark.createDataFrame(sets, "class binary, id bigint, size bigint, data array<bigint>")
    place = {k: i for i, (k, _) in enumerate(rows)}
    for limit in (3000, 1 << 20):
        forest = similar.Forest(len(rows))
        for r in similar.class_links(frame, similar.similar_pairs, limit).collect():
            forest.join(place[r["a"]], place[r["b"]])
        assert {k: rows[forest.root(place[k])][0] for k, _ in rows} == brute(rows)


def test_keys_that_repeat_or_are_null(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    rows = [(1, a, "x", 0), (1, b, "y", 1), (1, a, "z", 2), (None, c, "x", 3), (None, c, "x", 4), (None, b, "x", 5), (4, None, None, 6), (5, "", None, 7), (6, "q " * 400_000, None, 8), (7, "q " * 400_000, "th", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, th string, stay_key int")
    got = similar.keep_one(docs)
    assert got.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in got.collect()} if got.count() == 5 else got.collect()
    assert got == {(1, a), (None, c), (None, b), (4, None), (6, "q " * 400_000)}
    assert similar.keep_one(docs.where("false")).count() == 0
