"""SimHash near-duplicate detection with a hierarchical index in Gray order.

Fingerprints: a bit is set where over half of a document's shingle hashes have it set. Documents with one fingerprint
are one node from then on, whatever their number. A fingerprint has one 64-bit word, or several, of hashes mixed anew.

Links: fingerprints at distance ``d`` or less. They are dealt to groups, each searched in one task (see near_links() and
wide_links()). In a group they are sorted by Gray rank, in which neighbours differ in few bits. Leaves hold runs of that
order, and each node above factors out the bits that all below it share, with their mask. A search walks down, adding the
differences on the bits that each node newly fixes, and leaves a whole subtree when the sum exceeds ``d``.

A group of over GROUP fingerprints is not searched in one task: its pairs are compared in blocks (see cells). No group is
cut and no link of a group is lost.

Nulls: a null text counts as empty. Texts without words have the fingerprint zero and link as any other. Very long texts
are hashed some shingles at a time. Repeated keys are one node; of rows with one key, each keeps its own fingerprint and
class. Columns other than the key and the text are left out, so their names can't clash. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm._base import DOCS_A_FILE, map_rows, materialise, table
from litmill.llm.cells import Forest, class_links, stars
from litmill.llm.components import components

BITS = 64
#: Fingerprints that one search holds at most.
GROUP = 2048
#: Times that a crowded group of near_links() is dealt again.
ROUNDS = 2
LEAF, FANOUT = 8, 4
#: Queries times fingerprints that are compared at once.
PAIRS_AT_ONCE = 1 << 17
#: Shingles whose bits are summed at a time.
AT_ONCE = 1 << 14
FULL = (1 << BITS) - 1
#: Of wide_links(): fingerprints that share a key, about, and the part of the pairs that are only just alike enough that share one.
PER_KEY, RECALL = 256, 0.95


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """Hashes of another word, by a mixing function; word 0 has the hashes themselves."""
    if not table:
        return h
    g = h ^ np.uint64((0x9E3779B97F4A7C15 * table) & FULL)
    g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return g ^ (g >> np.uint64(31))


def fingerprint(text: str, words: int = 3, seed: int = 42, tables: int = 1, distinct: bool = False) -> list[int]:
    """The SimHash of a text's ``words``-word shingles, hashed by XXH64, in ``tables`` 64-bit words.

    distinct: a shingle votes once, however often it stands in the text; then all hashes of a text are held at a time.
    """
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not w:
        return [0] * tables
    joined = b" ".join(w)
    first, at = [], 0
    for x in w:
        first.append(at)
        at += len(x) + 1
    starts = first[: max(1, len(w) - words + 1)]
    ends = [x - 1 for x in first[words:]] + [len(joined)]
    count, votes = np.zeros((tables, BITS), dtype=np.int64), len(starts)
    hashes = (np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE], strict=True)], dtype="<u8") for k in range(0, votes, AT_ONCE))
    if distinct:
        whole = np.unique(np.concatenate(list(hashes)))
        votes = len(whole)
        hashes = (whole[k : k + AT_ONCE] for k in range(0, votes, AT_ONCE))
    for h in hashes:
        for t in range(tables):
            count[t] += np.unpackbits(_mixed(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > votes, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, *, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp: the fingerprint's bits as a signed number."""

    def start():
        def row(k, t):
            yield k, _signed(fingerprint(t or "", words)[0])

        return row

    return map_rows(docs.select(F.col(key).alias("key"), text), f"key {dict(docs.dtypes)[key]}, fp bigint", start)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the order of the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Places of the rows of ``codes``, numbers of one or more 64-bit words, by Gray rank."""
    ranks, odd = [], np.zeros(len(codes), bool)
    for word in codes.T:
        rank = gray_rank(word)
        ranks.append(np.where(odd, ~rank, rank))  # behind an odd number of set bits the order is reflected
        odd ^= (np.bitwise_count(word) & 1).astype(bool)
    return np.lexsort(ranks[::-1])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """A tree over distinct fingerprints, a row each, in Gray order; see the module's head."""

    def __init__(self, codes: np.ndarray):
        self.order = gray_order(codes)
        self.codes = codes[self.order]
        edges = np.arange(0, len(codes), LEAF)
        both, any_ = np.bitwise_and.reduceat(self.codes, edges), np.bitwise_or.reduceat(self.codes, edges)
        self.levels = [(both, ~(any_ & ~both))]  # of each node: a value, the mask of the bits that all below share
        while len(both) > 1:
            cut = np.arange(0, len(both), FANOUT)
            value, mask = self.levels[-1]
            ones, zeros = np.bitwise_and.reduceat(value & mask, cut), np.bitwise_and.reduceat(~value & mask, cut)
            both = ones
            self.levels.append((ones, ones | zeros))
        self.levels.reverse()

    def search(self, queries: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``queries`` and in ``codes`` of all pairs at distance ``d`` or less."""
        q = np.arange(len(queries))
        node, gone = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        fixed = np.zeros((len(q), queries.shape[1]), np.uint64)
        for depth, (value, mask) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, gone, fixed = np.repeat(q, FANOUT), np.repeat(gone, FANOUT), np.repeat(fixed, FANOUT, axis=0)
                ok = node < len(value)
                q, gone, fixed, node = q[ok], gone[ok], fixed[ok], node[ok]
            new = mask[node] & ~fixed  # what the nodes above have fixed is counted already
            gone = gone + distance(queries[q] & new, value[node] & new)
            ok = gone <= d
            q, gone, node = q[ok], gone[ok], node[ok]
            fixed = mask[node]
        at = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        q = np.repeat(q, LEAF)
        ok = at < len(self.codes)
        q, at = q[ok], at[ok]
        ok = distance(queries[q], self.codes[at]) <= d
        return q[ok], self.order[at[ok]]


def spanning_links(codes: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Links that join what is within reach; as many as a forest has. Each run of queries is searched in the index."""
    index, forest, out = GrayIndex(codes), Forest(len(codes)), []
    most, at, step = max(64, PAIRS_AT_ONCE // len(codes)), 0, 1
    while at < len(codes):
        a, b = index.search(codes[at : at + step], d)
        a = a + at
        root = forest.roots()  # what is joined already needs no look; near copies nearly all are after few queries
        new = (a < b) & (root[a] != root[b])
        out += [(x, y) for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True) if forest.join(x, y)]
        at, step = at + step, min(most, 4 * step)
    return out


def close_pairs(codes: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Links as those of spanning_links(), by comparing rows; as many as a forest has."""
    forest, out = Forest(len(codes)), []
    for k in range(0, len(codes), 64):
        a, b = np.nonzero(distance(codes[k : k + 64, None], codes[None]) <= d)
        a = a + k
        root = forest.roots()
        new = (a < b) & (root[a] != root[b])
        out += [(x, y) for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True) if forest.join(x, y)]
    return out


def blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the free bits into parts of nearly one size."""
    at = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for i in at[k * len(at) // parts : (k + 1) * len(at) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_links(nodes: DataFrame, d: int = 2, *, group: int = GROUP) -> DataFrame:
    """nodes: id, fp, a row for each distinct fp. Result: a, b, ids of links, enough to join all that are within reach.

    Two fingerprints at distance ``d`` or less agree in one of ``d + 1`` blocks of their bits. They are dealt by such a
    block, and within a block's value again by a block of the other bits, so a group shares both exactly. A crowded group
    is dealt again by blocks of the bits that are still free, ROUNDS times; by then it is crowded only if its
    fingerprints are close, and its pairs are compared in blocks of rows.
    """
    parts = d + 1
    masks = blocks(FULL, parts)
    if parts * parts <= 16:  # few enough to deal twice at once
        masks = [m | k for m in masks for k in blocks(FULL & ~m, parts)]
    mask = F.col("mask")
    key = F.xxhash64("mask", F.col("w0").bitwiseAND(mask))
    todo = nodes.select("id", F.col("fp").alias("w0"), F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    links, crowds, n = None, [], len(masks) * nodes.count()
    for round_ in range(ROUNDS + 1):
        found = materialise(_search(todo.withColumn("key", key), 1, d, group), n)
        got, now = found.where("b is not null").select("a", "b"), found.where("b is null").select(F.col("a").alias("id"), "key", "mask", "w0")
        links = got if links is None else links.unionByName(got)
        left = [r["mask"] for r in now.select("mask").distinct().collect()]  # at most the masks of one round
        again = [m for m in left if round_ < ROUNDS and (FULL & ~m).bit_count() >= parts]  # fewer bits can't be cut into blocks
        if len(again) < len(left):
            crowds.append(now.where(~mask.isin(again)))
        if not again:
            break
        # What is still free of each mask is cut once more; the masks of a round depend on the number of bits only.
        cut = F.create_map(*(x for m in again for x in (F.lit(m), F.array(*(F.lit(_signed((m & FULL) | k)) for k in blocks(FULL & ~(m & FULL), parts))))))
        todo, n = now.where(mask.isin(again)).select("id", "w0", F.explode(cut[mask]).alias("mask")), parts * now.count()
    for crowd in crowds:
        links = links.unionByName(_crowded_links(crowd, 1, d, group))
    return links


def sampled_masks(n: int, words: int, agree: float, *, per_key: int = PER_KEY, recall: float = RECALL, seed: int = 1) -> list[list[int]]:
    """Keys over fingerprints of ``words`` words: of each key, the mask of every word; see wide_links()."""
    bits = max(1, math.ceil(math.log2(max(2, n / per_key))))
    all_ = BITS * words
    bits = min(bits, all_)
    # Pairs have more or fewer differing bits by chance; of each number of them, its share and the part that a key lets meet.
    share = [math.comb(all_, x) * (1 - agree) ** x * agree ** (all_ - x) for x in range(all_ + 1)]
    meet = [math.comb(all_ - x, bits) / math.comb(all_, bits) for x in range(all_ + 1)]
    keys = 1
    while sum(s * (1 - m) ** keys for s, m in zip(share, meet, strict=True)) > 1 - recall:
        keys += 1
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(keys):
        masks = [0] * words
        for at in rng.choice(all_, bits, replace=False).tolist():
            masks[at // BITS] |= 1 << at % BITS
        out.append(masks)
    return out


def wide_links(nodes: DataFrame, words: int, d: int, agree: float, *, per_key: int = PER_KEY, recall: float = RECALL, group: int = GROUP) -> DataFrame:
    """nodes: id, fps (array of ``words`` words), a row for each distinct fps, written. Result: a, b, ids of links at distance ``d`` or less.

    For distances that no blocks can bound: fingerprints meet if they agree in all bits of a key. A key has as many bits
    as leave about ``per_key`` unlike fingerprints together, so it grows with the logarithm of their number, and there are
    as many keys, of bits chosen at random, as let the part ``recall`` of all pairs meet whose bits agree with
    probability ``agree``. So the rows to a document grow with a small power of the number of documents, and the part of
    links found does not depend on it.
    """
    w = [F.col("fps")[i] for i in range(words)]
    n = nodes.count()
    masks = sampled_masks(n, words, agree, per_key=per_key, recall=recall)
    keys = F.array(*(F.xxhash64(F.lit(i), *(x.bitwiseAND(F.lit(_signed(m))) for x, m in zip(w, own, strict=True) if m)) for i, own in enumerate(masks)))
    dealt = nodes.select("id", *(x.alias(f"w{i}") for i, x in enumerate(w)), F.lit(0).cast("bigint").alias("mask"), F.explode(keys).alias("key"))
    found = materialise(_search(dealt, words, d, group), n * len(masks))
    links, crowded = found.where("b is not null").select("a", "b"), found.where("b is null").withColumnRenamed("a", "id")
    return links if crowded.isEmpty() else links.unionByName(_crowded_links(crowded, words, d, group))


def _crowded_links(rows: DataFrame, words: int, d: int, group: int) -> DataFrame:
    """rows: key, id, w0.. of groups that are searched in blocks."""

    def pairs(data: list[np.ndarray]) -> list[tuple[int, int]]:
        return close_pairs(np.stack(data).view(np.uint64), d)

    data: Column = F.array(*(F.col(f"w{i}") for i in range(words)))
    return class_links(rows.select(F.col("key").alias("class"), "id", F.lit(1).cast("bigint").alias("size"), data.alias("data")), pairs, group)


def _search(dealt: DataFrame, words: int, d: int, group: int) -> DataFrame:
    """dealt: key, id, mask, w0..; result: a, b, key, mask, w0..: the links within each group as a and b; of groups over ``group``, their rows without b."""
    names = ["key", "id", "mask", *(f"w{i}" for i in range(words))]
    dealt = dealt.select(*names).repartition("key").sortWithinPartitions("key")
    id_type = dict(dealt.dtypes)["id"]
    arrow_id = to_arrow_type(dealt.schema["id"].dataType)
    schema = f"a {id_type}, b {id_type}, key bigint, mask bigint, " + ", ".join(f"w{i} bigint" for i in range(words))
    fields = ["a", "b", "key", "mask", *(f"w{i}" for i in range(words))]

    def crowd(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [part.column(1), pa.nulls(part.num_rows, arrow_id), part.column(0), *(part.column(i) for i in range(2, 3 + words))]
        return pa.RecordBatch.from_arrays(columns, names=fields)

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        size, key, crowded = 0, None, False
        a, b = [], []  # places of links in the ids of a batch's groups
        ids: list[pa.Array] = []
        base = 0

        def close() -> None:
            """The group has all its rows."""
            nonlocal held, size, base
            if not crowded and size > 1:
                columns = [[p.column(i) for p in held] for i in (1, *range(3, 3 + words))]
                codes = np.stack([np.concatenate([x.to_numpy(zero_copy_only=False) for x in c]) for c in columns[1:]], axis=1).view(np.uint64)
                links = spanning_links(codes, d)
                if links:
                    links = stars(links, pa.concat_arrays(columns[0]).to_pylist())
                    a.extend(base + x for x, _ in links)
                    b.extend(base + y for _, y in links)
                    ids.extend(columns[0])
                    base += size
            held, size = [], 0

        def flush():
            nonlocal base
            if a:
                all_ = pa.concat_arrays(ids)
                n = len(a)
                empty = [pa.nulls(n, pa.int64())] * (2 + words)
                yield pa.RecordBatch.from_arrays([all_.take(pa.array(a)), all_.take(pa.array(b)), *empty], names=fields)
                a.clear(), b.clear(), ids.clear()
                base = 0

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if keys[s] != key:
                    close()
                    key, crowded = keys[s], False
                held.append(batch.slice(s, e - s))
                size += e - s
                if crowded or size > group:
                    crowded = True
                    yield from map(crowd, held)
                    held, size = [], 0
            yield from flush()
        close()
        yield from flush()

    return dealt.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, d: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component_id: the smallest key within reach by links, the row's own included."""
    n = docs.count()
    marked = materialise(fingerprints(docs, words=words, key=key, text=text), n, DOCS_A_FILE)
    nodes = materialise(marked.groupBy("fp").agg(F.min("key").alias("id")), n)
    joined = components(near_links(nodes.where("id is not null"), d))
    classed = nodes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(classed, "fp").select(F.col("key").alias(key), "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
