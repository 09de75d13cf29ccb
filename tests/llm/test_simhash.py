import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from litmill.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\x0b\x0c\r":
        low = low.replace(s, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(keys, fps, d):
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= d:
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {k: root(k) for k in keys}


def test_fingerprints_agree_with_a_plain_version_and_with_sparks_hash(spark):
    texts = ["", " ", "a", "A b", "a b c", "É Ä x y z \x1f w", "one two three four five " * 9000, None]
    for t in texts:
        assert simhash.fingerprint(t or "") == [plain_fingerprint(t)]
    h = spark.sql("select xxhash64('a b c') h").first()["h"]
    assert simhash.fingerprint("a b c", tables=3)[0] == h % 2**64


def test_index_finds_all_pairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40, 700):
        base = rng.integers(0, 2**63, size=max(1, n // 10), dtype=np.uint64)
        codes = np.unique(base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
        for words in (1, 3):
            wide = np.stack([codes, *(codes * np.uint64(2 * i + 3) for i in range(1, words))], axis=1)
            order = simhash.gray_order(wide)
            ranks = [sum(int(x) << 64 * (words - 1 - i) for i, x in enumerate(w)) for w in wide]
            for s in range(9):
                ranks = [r ^ r >> (1 << s) for r in ranks]
            assert order.tolist() == sorted(range(len(ranks)), key=ranks.__getitem__)
            for d in (2, 20):
                a, b = simhash.GrayIndex(wide).search(wide, d)
                got = set(zip(a.tolist(), b.tolist(), strict=True))
                far = simhash.distance(wide[:, None], wide[None, :])
                assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= d), strict=True)}


def test_links_join_the_same_classes_whatever_the_group_size(spark):
    random.seed(2)
    centre = random.getrandbits(64)
    codes = {centre}
    for _ in range(400):
        c = random.choice(sorted(codes)) if random.random() < 0.8 else random.getrandbits(64)
        codes.add(c ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) * random.randrange(2))
    codes = sorted(codes)
    want = classes(codes, {c: c for c in codes}, 2)
    nodes = spark.createDataFrame([(i, simhash._signed(c)) for i, c in enumerate(codes)], "id bigint, fp bigint")
    for group in (8, 2048):
        links = [(codes[r["a"]], codes[r["b"]]) for r in simhash.near_links(nodes, 2, group=group).collect()]
        up = {c: c for c in codes}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            r, s = root(a), root(b)
            up[max(r, s)] = min(r, s)
        assert {c: root(c) for c in codes} == want


def test_query_agrees_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    want = classes(sorted(fps), fps, 2)
    got = simhash.op5_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}
    assert len(got) == len(docs)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", None), (7, "a b c d", "y"), (5, "a b c d", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (5, 5), (7, 5)]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def joined(keys, links):
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        r, s = root(a), root(b)
        up[max(r, s)] = min(r, s)
    return {k: root(k) for k in up}


def test_wide_fingerprints_find_near_copies_and_keep_others_apart(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(3000)]
    rows = {}
    for i in range(120):
        base = random.choices(words, k=300)
        for j in range(3):
            t = list(base)
            for _ in range(6 * (j > 0)):
                t[random.randrange(300)] = random.choice(words)
            rows[10 * i + j] = simhash.fingerprint(" ".join(t), tables=4)
    nodes = spark.createDataFrame([(k, [simhash._signed(x) for x in f]) for k, f in rows.items()], "id bigint, fps array<bigint>")
    for per_key in (4, 256):  # keys of 7 bits, of 1
        links = [tuple(r) for r in simhash.wide_links(nodes, 4, 48, 0.883, per_key=per_key).collect()]
        got = joined(rows, links)
        assert all(c // 10 == k // 10 for k, c in got.items())
        assert sum(c == 10 * (k // 10) for k, c in got.items()) >= 0.95 * len(got)


def test_keys_let_the_asked_part_of_pairs_meet():
    rng = np.random.default_rng(1)
    for n in (10, 100_000, 10**9):
        masks = simhash.sampled_masks(n, 4, 0.883, recall=0.95)
        assert all(any(m) for m in masks)
        met = 0
        for _ in range(2000):
            apart = [int(np.packbits(rng.random(64) > 0.883).view(np.uint64)[0]) for _ in range(4)]
            met += any(not any(x & m for x, m in zip(apart, own, strict=True)) for own in masks)
        assert met / 2000 >= 0.93


def test_crowded_keys_lose_no_links(spark):
    random.seed(4)
    rows = []
    for i in range(3):
        far = [random.getrandbits(63) for _ in range(4)]
        for j in range(60):
            rows.append((100 * i + j, [far[0], far[1] ^ (1 << j), far[2] ^ (1 << j % 7), far[3]]))
    nodes = spark.createDataFrame(rows, "id bigint, fps array<bigint>")
    links = [tuple(r) for r in simhash.wide_links(nodes, 4, 4, 0.97, group=8, recall=1 - 1e-9).collect()]
    assert joined([k for k, _ in rows], links) == {k: k // 100 * 100 for k, _ in rows}


def test_components_of_hubs_paths_and_pairs(spark, monkeypatch):
    from litmill.llm import components

    monkeypatch.setattr(components, "HUB_LINKS", 10)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201), (201, 200), (7, 7), (59, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = joined({x for l in links for x in l}, links)
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
