"""Near copies by exact similarity: the share of five-word shingles that two texts have in common, of all that either has.

SimHash fingerprints of four 64-bit words give the candidates: texts that their links join are one class. In a class, texts link
if their similarity is LEAST or more, whatever their fingerprints. Only texts of classes with several are read again.

Fingerprints are votes of the distinct three-word shingles, as the similarity is one of distinct shingles: a phrase that a text
repeats counts once in both. Three words are broken by no more changes than five, so texts at LEAST have as much of
them in common or more: AGREE of their bits agree on average (1 - arccos(8 / 9) / pi for texts of one length, less for those
of a dozen words, where few votes tie). They are that far apart with a spread of 6 bits of 256, and over DISTANCE once in
10,000. Unlike texts differ in half of the bits.

Two texts of LEAST or more share a shingle among the rarest fifth of each (with one more), so an index of those finds all
pairs; a text is compared with those of a set that it is joined to only until one links.

Nulls: a null text counts as empty; rows without a key are told apart by their text. Texts of the same words are one node;
texts without words are copies of each other only. Of near copies the smallest key stays, and of one key's texts the one
with the smallest hash; a null key is the smallest. Very long texts are hashed some shingles at a time, and their own
shingles are one list. Columns other than the key and the text are not read, so their names can't clash. Empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm import simhash
from litmill.llm._base import DOCS_A_FILE, map_rows, materialise
from litmill.llm.cells import Forest, class_links
from litmill.llm.components import components

WORDS = 5
#: Similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Shingles that one search holds, about.
SHINGLES = 1 << 20
#: Words of a fingerprint, bits that candidates differ in at most, and the part of the bits that agree at LEAST.
TABLES, DISTANCE, AGREE = 4, 60, 0.845


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # as fingerprint() does


def _same(w: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(w))


def shingles(w: list[bytes], words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    from xxhash import xxh64_intdigest

    if not w:
        return np.zeros(0, np.int64)
    return np.unique(np.array([xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], np.uint64).view(np.int64))


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of linked sets, as many as a forest has."""
    p, q = LEAST
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    alone = int((count == 1).sum())  # tokens of a lower rank are in one set only
    ends = sizes.cumsum()
    ranked = [np.sort(rank[token[e - n : e]]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    forest, out = Forest(len(sets)), []
    held: dict[int, dict[int, list[int]]] = {}  # of each token, by root: the sets that have it in their prefix
    mark = np.zeros(len(count), bool)
    for x in np.argsort(sizes, kind="stable").tolist():
        n = len(ranked[x])
        if not n:
            continue
        prefix = [r for r in ranked[x][: n - -(-p * n // q) + 1].tolist() if r >= alone]
        near: dict[int, list[list[int]]] = {}
        for r in prefix:
            lists = held.setdefault(r, {})
            for old in [k for k in lists if forest.root(k) != k]:
                lists.setdefault(forest.root(old), []).extend(lists.pop(old))
            for k, members in lists.items():
                near.setdefault(k, []).append(members)
        mark[ranked[x]] = True
        for lists in near.values():
            seen = set()
            for y in (y for members in lists for y in members):
                if y in seen:
                    continue
                seen.add(y)
                m = len(ranked[y])
                if q * m >= p * n and (p + q) * int(mark[ranked[y]].sum()) >= p * (n + m):
                    forest.join(x, y)
                    out.append((x, y))
                    break
        mark[ranked[x]] = False
        for r in prefix:
            held[r].setdefault(forest.root(x), []).append(x)
    return out


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th (Spark's xxhash64 of the text), kept_key, kept_th: a row for each row, with the one of its near copies that stays."""

    def mark():
        def row(k, h, t):
            yield k, h, _same(_words(t)), [simhash._signed(f) for f in simhash.fingerprint(t or "", tables=TABLES, distinct=True)]

        return row

    def cut():
        def row(t, i, c):
            w = _words(t)
            if _same(w) == i:  # of rows that share a key, others may have another text
                s = shingles(w)
                yield c, i, len(s), s.tolist()

        return row

    hashed = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[key]
    n = docs.count()
    marked = materialise(map_rows(hashed, f"key {kind}, th bigint, id binary, fps array<bigint>", mark), n, DOCS_A_FILE)
    texts = marked.groupBy("id", "fps").agg(F.min(F.struct("key", "th")).alias("first"))
    nodes = materialise(texts.groupBy("fps").agg(F.min("id").alias("id"), F.count("*").alias("n")), n)
    joined = components(simhash.wide_links(nodes.select("id", "fps"), TABLES, DISTANCE, AGREE)).withColumnRenamed("node", "id")
    classes = nodes.join(joined, "id", "left").where("component is not null or n > 1").select("fps", F.coalesce("component", "id").alias("class"))
    doubtful = texts.join(classes, "fps").select("id", "class", F.col("first.key").alias("_key"), F.col("first.th").alias("_th"))
    read = hashed.join(doubtful, F.col("key").eqNullSafe(F.col("_key")) & (F.col("th") == F.col("_th"))).select("text", "id", "class")
    sets = materialise(map_rows(read, "class binary, id binary, size bigint, data array<bigint>", cut), n, DOCS_A_FILE)
    alike = components(class_links(sets, similar_pairs, SHINGLES, DOCS_A_FILE)).withColumnRenamed("node", "id")
    least = texts.join(alike, "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    kept = least.groupBy("component").agg(F.min("first").alias("kept"))
    of = least.join(kept, "component").select("id", F.col("kept.key").alias("kept_key"), F.col("kept.th").alias("kept_th"))
    return marked.join(of, "id").select(F.col("key").alias(key), "th", "kept_key", "kept_th")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns. Of rows with one key and text, the one that hashes lowest."""
    found = materialise(near_copies(docs, key=key, text=text), docs.count())
    stay = found.where(F.col(key).eqNullSafe(F.col("kept_key")) & (F.col("th") == F.col("kept_th")))
    stay = stay.groupBy(F.col(key).alias("stay_key"), F.col("th").alias("stay_th")).agg(F.count("*").alias("stay_rows"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("th"))
    same = F.col("row")[key].eqNullSafe(F.col("stay_key")) & (F.col("th") == F.col("stay_th"))
    once = rows.join(stay.where("stay_rows = 1"), same, "left_semi").select("row.*")
    repeated = rows.join(stay.where("stay_rows > 1"), same).groupBy("stay_key", "stay_th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(repeated.select("row.*"))
