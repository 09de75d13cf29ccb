"""Weights of terms by packed arrays: what moves for a document's length is a hash and a count for each term of a batch of documents.

Documents are dealt to batches by their key, so rows of one key are one document. A batch's distinct terms go, as arrays of hashes and of
the number of its documents that have them, to the parts of a hash; each part adds up and answers every batch with the numbers of all
documents, in the order asked. The batch counts its terms again and has all it needs. Hashes have 64 bits, beside the part, which others choose.

Nulls: a null key is a key. A text without tokens has no weights. Tokens hold no blank, or pairs of words could be words. A batch is BATCH_BYTES
of text on average, and is held by one task with its terms.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.settled import settled

BATCH_BYTES = 8 << 20
#: Batches of a table that is large enough to be dealt at all, at least.
BATCHES = 16
#: The largest number that a document and a term make.
MOST = 2**63 - 1


def _joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _counted(rows: pa.Table, bigrams: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The keys, the words, and of each document's terms in order: the place of its key, its code by places of words, its count."""
    keys, lists = _joined(rows["key"]).dictionary_encode(null_encoding="encode"), _joined(rows["t"])
    words = lists.flatten().dictionary_encode()
    if pc.any(pc.match_substring(words.dictionary, " ")).as_py():
        raise ValueError("tokens with blanks")
    at, v = words.indices.to_numpy().astype("i8"), len(words.dictionary)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    doc = keys.indices.to_numpy().astype("i8")[row]
    if bigrams and len(at):
        pair = np.flatnonzero(row[1:] == row[:-1])
        at, doc = np.r_[at, (at[pair] + 1) * v + at[pair + 1]], np.r_[doc, doc[pair]]
    span, codes = v * (v + 1) + 1, None
    if span * len(keys.dictionary) > MOST:
        codes, at = np.unique(at, return_inverse=True)
        span = len(codes)
    each, tf = np.unique(doc * span + at, return_counts=True)
    code = each % span
    return keys.dictionary, words.dictionary, each // span, code if codes is None else codes[code], tf


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _dealt(codes: np.ndarray, words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the terms by part and hash, and both in that order."""
    each = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=16).digest() for w in words.to_pylist()), "u8").reshape(-1, 2)
    first, last = codes // len(words) - 1, codes % len(words)
    h = np.where((first < 0)[:, None], each[last], _mixed(each[first] * np.uint64(0x9E3779B97F4A7C15) + each[last]))
    part = (h[:, 1] % np.uint64(parts)).astype("i8")
    order = np.lexsort((h[:, 0], part))
    return order, part[order], h[order, 0]


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def _answer(rows: pa.Table) -> pa.Table:
    """The number of documents that have each term that a batch has sent to this part."""
    hashes = _unpacked(rows["h"], "u8")
    _, term = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.bincount(term, np.concatenate(_unpacked(rows["n"], "i4"))).astype("i8")[term]
    return pa.table({"batch": rows["batch"], "part": rows["part"], "df": _packed(np.split(df, np.cumsum([len(h) for h in hashes])[:-1]))})


def _places(wanted: list[str], words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in order, of the wanted terms whose words are all there, and which ones they are."""
    two = [t.split(" ") for t in wanted]
    a, b = (pc.index_in(pa.array(x, pa.string()), value_set=words).fill_null(-1).to_numpy().astype("i8") for x in ([t[0] for t in two], [t[-1] for t in two]))
    pair = np.array([len(t) == 2 for t in two], bool)
    code, which = np.where(pair, (a + 1) * len(words) + b, a), np.flatnonzero((a >= 0) & (b >= 0))
    which = which[np.argsort(code[which])]
    return code[which], which


def weights(docs: DataFrame, key: str, text: str, tokens: Column, *, bigrams: bool, wanted: list[str] | None) -> DataFrame:
    """key, term, weight of the wanted terms (None: of all), laid by key. See semantic.tfidf()."""
    total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    n, parts = total[0], max(-(-total[1] // BATCH_BYTES), min(BATCHES, -(-total[1] // (BATCH_BYTES // 16))), 1)
    # Texts move, and tokens are made where they arrive.
    texts = docs.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("batch"), F.col(key).alias("key"), F.col(text)).repartition(parts, "batch")
    texts = texts.select("batch", "key", tokens.alias("t"))
    key_type = docs.schema[key].dataType.simpleString()

    def ask(batch: tuple, rows: pa.Table) -> pa.Table:
        _, words, _, code, _ = _counted(rows, bigrams)
        codes, had = np.unique(code, return_counts=True)
        if not len(codes):
            return pa.table({"batch": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "h": _packed([]), "n": _packed([])})
        order, part, h = _dealt(codes, words, parts)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return pa.table({"batch": pa.array([batch[0].as_py()] * len(first), pa.int32()), "part": pa.array(part[first], pa.int32()), "h": _packed(np.split(h, first[1:])), "n": _packed(np.split(had[order].astype("i4"), first[1:]))})

    def weigh(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, words, doc, code, tf = _counted(rows, bigrams)
        codes, term = np.unique(code, return_inverse=True)
        df = np.empty(len(codes))
        if len(codes):
            df[_dealt(codes, words, parts)[0]] = np.concatenate(_unpacked(answers.sort_by("part")["df"], "i8"))
        weight = tf * (np.log((1 + n) / (1 + df)) + 1)[term]
        weight /= np.sqrt(np.bincount(doc, weight * weight))[doc]
        if wanted is None:
            first, last = codes // max(len(words), 1) - 1, codes % max(len(words), 1)
            names = pc.if_else(pa.array(first < 0), words.take(last), pc.binary_join_element_wise(words.take(np.maximum(first, 0)), words.take(last), " "))
        else:
            places, which = _places(wanted, words)
            at = np.minimum(np.searchsorted(places, codes), max(len(places) - 1, 0))
            found = places[at] == codes if len(places) else np.zeros(len(codes), bool)
            some = found[term]
            doc, weight, term = doc[some], weight[some], which[at[term[some]]]
            names = pa.array(wanted, pa.string())
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.array([], "i8")
        ends = pa.array(np.r_[first, len(doc)].astype("i4"))
        return pa.table({"key": keys.take(doc[first]), "term": pa.ListArray.from_arrays(ends, names.take(term)), "weight": pa.ListArray.from_arrays(ends, weight)})

    asked = texts.groupBy("batch").applyInArrow(ask, "batch int, part int, h binary, n binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "batch int, part int, df binary")
    made = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(weigh, f"key {key_type}, term array<string>, weight array<double>")
    # A document's weights move as one row, and none after that.
    return settled(made).repartition(max(parts, 2), "key").select(F.col("key").alias(key), F.inline(F.arrays_zip("term", "weight")))


#: Sums of documents and anchors that are held at a time.
SUMS = 1_000_000


def cosines(weights: DataFrame, anchors: DataFrame, best: int | None = None, slack: float = 0.0) -> DataFrame:
    """key, anchor, cosine of documents (key, term, weight) and anchors (anchor, term, weight) that share a term.

    The anchors, whose number is checked by the caller, go to the documents; weights that lie by key stay where they are. With ``best`` only cosines
    above 0 that are, but for ``slack``, among so many best of their anchor in some thousand documents."""
    held = anchors.select("anchor", "term", "weight").where("term is not null").toArrow()
    names, terms = (_joined(held[c]).dictionary_encode() for c in ("anchor", "term"))
    by_term = np.argsort(terms.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(terms.indices.to_numpy()[by_term], np.arange(len(terms.dictionary) + 1))
    of, aw, n = names.indices.to_numpy().astype("i8")[by_term], held["weight"].to_numpy()[by_term], max(len(names.dictionary), 1)
    names, terms = names.dictionary, terms.dictionary

    def found(batches):
        step = max(SUMS // n, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                lists, size = some["term"], some.num_rows
                term = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy()
                doc, w = np.repeat(np.arange(size), pc.list_value_length(lists).to_numpy())[term >= 0], some["weight"].flatten().to_numpy()[term >= 0]
                term = term[term >= 0]
                times = starts[term + 1] - starts[term]
                each = np.repeat(np.arange(len(term)), times)
                place = np.arange(len(each)) - np.repeat(np.cumsum(times) - times - starts[term], times)
                code = doc[each] * n + of[place]
                sums = np.bincount(code, w[each] * aw[place], minlength=size * n).astype("f8")  # whole numbers, if there are none
                if best is None:
                    code = np.flatnonzero(np.bincount(code, minlength=size * n))
                else:
                    floor = np.partition(sums.reshape(size, n), size - best, axis=0)[size - best] - slack if size > best else np.zeros(n)
                    code = np.flatnonzero((sums > 0) & (sums.reshape(size, n) >= floor).ravel())
                yield pa.RecordBatch.from_pydict({"key": some["key"].take(pa.array(code // n)), "anchor": names.take(pa.array(code % n)), "cosine": sums[code]})

    lists = weights.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("w")).select("key", "w.term", "w.weight")
    return lists.mapInArrow(found, f"key {weights.schema['key'].dataType.simpleString()}, anchor {anchors.schema['anchor'].dataType.simpleString()}, cosine double")
