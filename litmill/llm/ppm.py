"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts: for each context of up to ORDER symbols, how often each symbol followed it in the
training texts. A symbol is coded in the longest known context; a context that lacks it first codes an escape, whose
weight is the number of distinct symbols that it has seen, against their total (escape method C), and the next shorter
context then leaves out the symbols of the longer one (symbol exclusion), since they would have been coded there.
Below the empty context all symbols left are equally likely. A text's symbols are its UTF-8 bytes and an end.

Every symbol that a context has seen was seen by its suffixes too. So what a longer context excludes from its suffix
is one sum of counts and one number of symbols, and the code length of a symbol is a sum over the contexts it falls
through. score() uses counts over all training texts; adaptive() learns from each text itself as it goes.

On the cluster, texts are dealt to blocks by a hash of their row, not of its values, so that a row repeated very often
fills many blocks; they are packed and written, and read from there. A block asks once for each distinct gram (a context and its symbol)
and word that it has, with the count of its training texts. The sums of these counts over the blocks are the model; the
trie's levels follow from them by windows over contexts, which have SYMBOLS rows at most, and each distinct gram's code
length is worked out once, whatever the number of its places. The answers go back to the blocks that asked, and a block
is scored with what it was sent. No table of the model is ever whole in one place, and all sizes take this one path.

Nulls: a null text counts as empty; an empty text has one token and one symbol, the end. A null key is in no training
fold. Repeated rows get the same scores; equal counts need no order. A very long text is gathered some symbols at a time. With nothing to train on, all
symbols are equally likely. Columns other than the key and the text are left out, so their names can't clash. An empty
table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm._base import map_rows, small, table, written

ORDER = 5
#: Symbols: 0 before a text, bytes plus 1, the end. In 9 bits each, a gram is the symbol with its context above it.
WIDTH, END, SYMBOLS = 9, 257, 257
#: Bytes of text to a block, and the least if there would be fewer blocks than cores.
BLOCK_BYTES, LEAST_BLOCK = 40 << 20, 4 << 20
#: Bytes of text to a file of what is asked about it.
FILE_BYTES = 16 << 20
#: Bytes of text that a task packs together for a block, and that it holds in all.
PACK, HOLD = 1 << 20, 32 << 20
#: Symbols whose grams are worked on at a time, and rows that a task hands over at a time.
GATHER, ROWS = 1 << 21, 1 << 16
GRAM, WORD, DOCS = 0, 1, 2


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all symbols of the texts in their order, and the number of symbols of each text."""
    a = np.zeros(sum(map(len, texts)) + (order + 1) * len(texts), np.uint64)
    at = 0
    for t in texts:
        at += order
        a[at : at + len(t)] = np.frombuffer(t, np.uint8)
        a[at : at + len(t)] += np.uint64(1)
        at += len(t)
        a[at] = END
        at += 1
    n = len(a) - order
    g = a[:n].copy() if n > 0 else a[:0]
    for i in range(1, order + 1):
        g <<= np.uint64(WIDTH)
        g |= a[i : n + i]
    return g[a[order:] != 0], np.array([len(t) + 1 for t in texts], np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k, c = k[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(k) else c)


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct words, and how often each is there."""
    from xxhash import xxh64_intdigest

    seen = Counter(text.lower().split())
    return np.fromiter(map(xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64), np.fromiter(seen.values(), np.int64, len(seen))


def _in_training(key, folds: int, held: int) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % folds != held


def packs(docs: DataFrame, blocks: int, key: str, text: str) -> DataFrame:
    """block, keys, lengths, body: texts of one block, compressed together, so that moving them costs less."""
    kind = dict(docs.dtypes)[key]
    id_type = to_arrow_type(docs.schema[key].dataType)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(key)), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), body.cast("binary").alias("body"))

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        sizes: Counter = Counter()

        def pack(block: int):
            keys, texts = held.pop(block)
            sizes.pop(block)
            whole = b"".join(texts)
            columns = [pa.array([block], pa.int32()), pa.array([keys], pa.list_(id_type)), pa.array([list(map(len, texts))], pa.list_(pa.int32())), pa.array([codec.compress(whole, asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "keys", "lengths", "body"])

        total = 0
        for batch in batches:
            for b, k, t in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = t.as_py()
                keys, texts = held[b]
                keys.append(k)
                texts.append(t)
                sizes[b] += len(t) + 64
                total += len(t) + 64
                if sizes[b] > PACK or total > HOLD:
                    for own in [b] if total <= HOLD else list(held):
                        total -= sizes[own]
                        yield pack(own)
        for own in list(held):
            yield pack(own)

    return rows.mapInArrow(run, f"block int, keys array<{kind}>, lengths array<int>, body binary")


def _unpacked(part: pa.RecordBatch | pa.Table):
    """Keys and texts of each pack."""
    codec = pa.Codec("zstd")
    for keys, lengths, body in zip(part["keys"].to_pylist(), part["lengths"].to_pylist(), part["body"], strict=True):
        whole = codec.decompress(body.as_buffer(), sum(lengths), asbytes=True)
        ends = np.cumsum(lengths).tolist()
        yield keys, [whole[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def _runs(texts: list[bytes]):
    """The texts in runs of about GATHER symbols."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size > GATHER:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def questions(packed: DataFrame, order: int, folds: int, held: int) -> DataFrame:
    """block, kind, key, n: each distinct gram and word of a block, and how often its training texts have it; their number."""

    def run(batches):
        block = None
        words: dict[bool, Counter] = {}
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        docs = 0

        def rows(kind, keys, n):
            for i in range(0, len(keys), ROWS):
                k = len(keys[i : i + ROWS])
                columns = [pa.array(np.full(k, block, np.int32)), pa.array(np.full(k, kind, np.int32)), pa.array(keys[i : i + ROWS]), pa.array(n[i : i + ROWS])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "key", "n"])

        def close():
            nonlocal grams, docs
            if grams:
                k, n = _summed(*map(list, zip(*grams, strict=True)))
                yield from rows(GRAM, k.view(np.int64), n)
                own = words[True]
                names = list(own.keys() | words[False].keys())
                yield from rows(WORD, np.array([word_hash(w) for w in names], np.int64), np.array([own[w] for w in names], np.int64))
                yield from rows(DOCS, np.array([0], np.int64), np.array([docs], np.int64))
            grams, docs = [], 0
            words.update({True: Counter(), False: Counter()})

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                if (b := part["block"][0].as_py()) != block:
                    yield from close()
                    block = b
                for keys, texts in _unpacked(part):
                    learnt = [_in_training(k, folds, held) for k in keys]
                    docs += sum(learnt)
                    for use in (True, False):
                        own = [t for t, x in zip(texts, learnt, strict=True) if x == use]
                        for t in own:
                            words[use].update(t.lower().split())
                        for some in _runs(own):
                            u, c = np.unique(grams_of(some, order)[0], return_counts=True)
                            grams.append((u, c.astype(np.int64) * use))
                    if sum(len(u) for u, _ in grams) > 2 * len(grams[0][0]) + GATHER:
                        grams = [_summed(*map(list, zip(*grams, strict=True)))]
        yield from close()

    return packed.sortWithinPartitions("block").mapInArrow(run, "block int, kind int, key bigint, n bigint")


def _part(symbols: int) -> Column:
    return F.lit((1 << (WIDTH * symbols)) - 1)


def levels(grams: DataFrame, order: int, n: int) -> list[DataFrame]:
    """grams: g, c of the full order, ``n`` of them; c may be 0. Result: of each order, from 0 on, g and its count c; of its
    context the total t, the distinct symbols d, and e, what these add up to one level below; up, the count of g there."""
    out = []
    for j in range(order, -1, -1):
        below, context = Window.partitionBy(F.col("g").bitwiseAND(_part(j))), Window.partitionBy(F.shiftright("g", WIDTH))
        own = grams.withColumn("up", F.sum("c").over(below) if j else F.lit(0).cast("bigint"))
        own = own.withColumn("t", F.sum("c").over(context)).withColumn("d", F.count_if(F.col("c") > 0).over(context)).withColumn("e", F.sum(F.when(F.col("c") > 0, F.col("up")).otherwise(0)).over(context))
        out.insert(0, written(own, n))
        grams = out[0].groupBy(F.col("g").bitwiseAND(_part(j)).alias("g")).agg(F.max("up").alias("c"))
    return out


def code_lengths(grams: DataFrame, order: int, n: int) -> DataFrame:
    """grams: g, c of the full order, ``n`` of them. Result: g, cost: -log10 of the probability of its symbol in its context."""
    tables = levels(grams, order, n)
    seen = F.col("c") > 0
    total, distinct = F.col("t") - F.col("less"), F.col("d") - F.col("fewer")
    step = F.when(distinct > 0, F.log10(total + distinct) - F.log10(F.when(seen, F.col("c")).otherwise(distinct))).otherwise(0.0)
    zero = F.lit(0).cast("bigint")
    left = tables[order].select("g", F.lit(0.0).alias("cost"), zero.alias("less"), zero.alias("fewer"), "c", "t", "d", "e")
    done = []
    for j in range(order, -1, -1):
        if j < order:
            of = tables[j].select(F.col("g").alias("h"), "c", "t", "d", "e")
            left = left.join(small(of), F.col("g").bitwiseAND(_part(j + 1)) == F.col("h")).drop("h")
        left = left.withColumn("cost", F.col("cost") + step)
        done.append(left.where(seen).select("g", "cost"))
        left = left.where(~seen).select("g", "cost", F.col("e").alias("less"), F.col("d").alias("fewer"))
    symbols = tables[0].agg(F.count_if(seen)).first()[0]
    done.append(left.select("g", (F.col("cost") + F.lit(math.log10(max(SYMBOLS - symbols, 1)))).alias("cost")))
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    return all_


class Lookup:
    """Numbers by key, in an open-addressed table; every key that is asked for is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 1.4).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        free = np.ones(1 << bits, bool)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            into = at[free[at]]
            self.keys[into] = keys[left[free[at]]]  # of several for one slot, the last stays
            free[into] = False
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.wrap

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        left = np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & self.wrap
            out[left] = self.values[at]
            more = self.keys[at] != keys[left]
            left, at = left[more], at[more]
        return out


def log10_scores(costs: Lookup, texts: list[bytes], order: int) -> list[float]:
    out: list[float] = []
    for some in _runs(texts):
        g, n = grams_of(some, order)
        out += (-np.add.reduceat(costs[g], np.concatenate([[0], np.cumsum(n)[:-1]]))).tolist()
    return out


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 of the probability that a trie which starts empty, and learns each symbol after coding it, gives the text."""
    trie: dict[bytes, Counter] = {}
    total = 0.0
    symbols = [*text, 256]
    for i, s in enumerate(symbols):
        gone: set[int] = set()
        coded = False
        contexts = [bytes(text[max(0, i - j) : i]) for j in range(min(order, i), -1, -1)]
        for c in contexts:
            seen = {x: n for x, n in trie.get(c, {}).items() if x not in gone}
            if not seen:
                continue
            weight = sum(seen.values()) + len(seen)
            if s in seen:
                total += math.log10(seen[s] / weight)
                coded = True
                break
            total += math.log10(len(seen) / weight)
            gone |= seen.keys()
        if not coded:
            total -= math.log10(SYMBOLS - len(gone))
        for c in contexts:
            trie.setdefault(c, Counter())[s] += 1
    return total


def adaptive(docs: DataFrame, *, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: adaptive_log10() of each text, a row a document. It walks symbols one by one, and is for short texts."""

    def start():
        def row(k, t):
            yield k, adaptive_log10((t or "").encode("utf-8"), order)

        return row

    return map_rows(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, score double", start)


def score(docs: DataFrame, *, order: int = ORDER, folds: int = 10, held: int = 0, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: a row a document, learnt from the rows not held out."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BLOCK))
    packed = written(packs(docs, blocks, key, text), size, FILE_BYTES)  # a row's place decides, so it is dealt once
    asked = questions(packed.repartitionById(blocks, "block"), order, folds, held).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    asked = written(asked, size, FILE_BYTES)
    sums = {r["kind"]: r for r in asked.groupBy("kind").agg(F.sum("n").alias("s"), F.count_if(F.col("n") > 0).alias("known"), F.count("*").alias("n")).collect()}
    trained = int(sums[DOCS]["s"]) if DOCS in sums else 0
    tokens = (int(sums[WORD]["s"]) if WORD in sums else 0) + trained
    distinct = (int(sums[WORD]["known"]) if WORD in sums else 0) + (trained > 0)
    norm = math.log10(tokens + 0.1 * (distinct + 1))
    end = math.log10(trained + 0.1) - norm

    grams = asked.where(F.col("kind") == GRAM)
    costs = code_lengths(grams.select(F.col("key").alias("g"), F.col("n").alias("c")), order, int(sums[GRAM]["n"]) if GRAM in sums else 0)
    costs = grams.join(costs, grams["key"] == costs["g"]).select("kind", "key", F.col("cost").alias("value"), "blocks")
    words = asked.where(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value"), "blocks")
    replies = costs.unionByName(words).select(F.explode("blocks").alias("block"), "kind", "key", "value")

    id_type = to_arrow_type(docs.schema[key].dataType)

    def work(own: pa.Table, sent: pa.Table) -> pa.Table:
        kinds, keys, values = (sent[c].to_numpy() for c in ("kind", "key", "value"))
        of = kinds == GRAM
        grams = Lookup(keys[of].view(np.uint64), values[of])
        counts = Lookup(keys[~of].view(np.uint64), values[~of])
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for keys, texts in _unpacked(own):
            n, known, base = [], [], []
            for t in texts:
                w, c = words_of(t)
                found = counts[w.view(np.uint64)]
                n.append(int(c.sum()) + 1)
                known.append(int(c[found > 0].sum()) + (trained > 0))
                base.append(float(((np.log10(found + 0.1) - norm) * c).sum()) + end)
            marks = [not _in_training(k, folds, held) for k in keys]
            for column, got in zip(out, (keys, marks, n, known, base, log10_scores(grams, texts, order)), strict=True):
                column += got
        types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = f"key {dict(docs.dtypes)[key]}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    found = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(work, schema)
    return found.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
