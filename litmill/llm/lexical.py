"""Ranked lexical search by Fagin's threshold algorithm, over blocks of documents.

One pass over the documents makes a forward index: of each document the number of its terms, and how often it holds each
term that any item asks for. From it come the number of documents, of all terms, and of the documents that hold a term,
and so each posting's impact: its part of a score, a 64-bit integer.

Then each task takes its part of the forward index in blocks. A block's postings are sorted by impact in a list for each
term. An item goes round its terms' lists, some postings of each at a time, and what it meets is scored at once by a
lookup in the forward index. The sum of the impacts that the lists have come to is the threshold: no document not
yet met scores more. The item stops when the threshold is strictly below its k-th best score, so equal scores are all
met and the smaller ids win. Each block gives k rows an item at most, and the best of those are the item's. A block is
bounded by its postings, so nothing grows with the table but the number of blocks. Items are taken ITEM_TERMS terms at a time,
so what a task knows of them is bounded too.

Terms are stretches of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased.

Nulls: a null text has no terms; a null key is a document like others and comes last among equal scores; a null item is an
item. Rows of one item are one item with the terms of all of them. Repeated documents each have their rank. Equal scores go by
ascending key. A very long text is one row of the forward index, as long as the distinct terms asked for. Other columns
are left out, so their names can't clash. Empty tables, and items without terms, give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm._base import map_rows, table, written

BEST = 10
#: Terms of items, with repeats, that one pass answers, about; postings of a block; postings of each list in the first round.
ITEM_TERMS, BLOCK_POSTINGS, FIRST_ROUND = 200_000, 2_000_000, 8
#: Bytes of a term as they are: 0-9, a-z, those beyond ASCII; A-Z lower-cased; others divide terms.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LOWER).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (terms with repeats), terms (places in the vocabulary, ascending), tfs: a row a document with a term, written."""
    places = {t: i for i, t in enumerate(vocabulary)}

    def start():
        from collections import Counter

        def row(k, t):
            got = terms(t)
            if got:
                count = sorted((places[x], n) for x, n in Counter(got).items() if x in places)
                yield k, len(got), [x for x, _ in count], [n for _, n in count]

        return row

    kind = dict(docs.dtypes)[key]
    return written(map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), f"key {kind}, n bigint, terms array<int>, tfs array<int>", start))


class Block:
    """Documents of a block: their postings by document, and by term in falling impact."""

    def __init__(self, keys: pa.Array, n: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int):
        m = 10 + 90 * n * documents // length
        of = np.repeat(np.arange(len(n)), lengths)
        self.keys, self.term, self.ends = keys, term, np.concatenate([[0], lengths.cumsum()])
        self.impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
        # Of equal scores the smaller key is better; null keys are the last.
        self.place = np.empty(len(n), np.int64)
        self.place[pa.compute.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(n))
        order = np.lexsort((-self.impact, term))
        self.list_doc, self.list_impact = of[order], self.impact[order]
        self.lists = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.met = np.zeros(len(n), bool)

    def scores(self, at: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by the forward index. asked: of each term whether the item has it."""
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = lengths.cumsum()
        postings = np.arange(upto[-1]) + np.repeat(starts - upto + lengths, lengths)
        total = np.concatenate([[0], np.where(asked[self.term[postings]], self.impact[postings], 0).cumsum()])
        return total[upto] - total[upto - lengths]

    def best(self, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of an item's best k documents here, and the number of documents that it met. own: its terms."""
        asked = np.zeros(len(self.lists) - 1, bool)
        asked[own] = True
        starts, ends = self.lists[own], self.lists[own + 1]
        open_ = ends > starts
        starts, ends = starts[open_], ends[open_]
        at, score, every, step = np.zeros(0, np.int64), np.zeros(0, np.int64), [], FIRST_ROUND
        while len(starts):
            upto = np.minimum(starts + step, ends)
            docs = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(starts.tolist(), upto.tolist(), strict=True)]))
            docs = docs[~self.met[docs]]
            if len(docs):
                self.met[docs] = True
                every.append(docs)
                at, score = np.concatenate([at, docs]), np.concatenate([score, self.scores(docs, asked)])
                top = np.lexsort((self.place[at], -score))[:k]
                at, score = at[top], score[top]
            left = upto < ends
            threshold = int(self.list_impact[upto[left] - 1].sum())  # a list at its end adds nothing more
            if len(at) == k and threshold < score[-1]:
                break
            starts, ends, step = upto[left], ends[left], 2 * step
        for docs in every:
            self.met[docs] = False
        return at[score > 0], score[score > 0], sum(map(len, every))


def _search(index: DataFrame, items: list[tuple[object, list[int]]], item_type: str, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    kind = dict(index.dtypes)["key"]
    arrow_key = to_arrow_type(index.schema["key"].dataType)
    arrow_item = to_arrow_type(index.sparkSession.createDataFrame([], f"item {item_type}").schema["item"].dataType)
    asked = [(i, np.array(own, np.int64)) for i, own in items]

    def answer(parts: list[pa.RecordBatch]):
        flat = [np.concatenate([p.column(c).flatten().to_numpy() for p in parts]).astype(np.int64) for c in (2, 3)]
        lengths = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts]).astype(np.int64)
        keys = pa.concat_arrays([p.column(0) for p in parts])
        block = Block(keys, np.concatenate([p.column(1).to_numpy() for p in parts]), lengths, *flat, weight, documents, length)
        ids, at, scores = [], [], []
        for item, own in asked:
            x, s, _ = block.best(own, k)
            ids += [item] * len(x)
            at.append(x)
            scores.append(s)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_item), keys.take(pa.array(np.concatenate(at))).cast(arrow_key), pa.array(np.concatenate(scores))], names=["item", "key", "score"])

    def run(batches):
        held, postings = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                postings += len(batch.column(2).flatten()) + batch.num_rows
            if postings >= BLOCK_POSTINGS:
                yield from answer(held)
                held, postings = [], 0
        if held:
            yield from answer(held)

    return index.mapInArrow(run, f"item {item_type}, key {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, *, k: int = BEST, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """item, rank, key, score: each item's k documents of the highest scores above 0."""
    spark, item_type = docs.sparkSession, dict(items.dtypes)[item]

    def cut():
        def row(i, t):
            for x in dict.fromkeys(terms(t)):
                yield i, x.decode("utf-8")

        return row

    asked = written(map_rows(items.select(F.col(item).alias("item"), F.col(query).alias("text")), f"item {item_type}, term string", cut).distinct())
    passes = -(-asked.count() // ITEM_TERMS)
    found = None
    for p in range(passes):
        own: dict[object, list[str]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).collect():  # ITEM_TERMS rows, about
            own.setdefault(r["item"], []).append(r["term"])
        vocabulary = sorted({t for ts in own.values() for t in ts})
        places = {t: i for i, t in enumerate(vocabulary)}
        index = forward_index(docs, [t.encode("utf-8") for t in vocabulary], key=key, text=text)
        documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row a term of the pass at most
            weight[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        best = _search(index, [(i, sorted(places[t] for t in ts)) for i, ts in own.items()], item_type, weight, documents, length, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], f"item {item_type}, key {dict(docs.dtypes)[key]}, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), totals AS (
  SELECT count(*)::BIGINT AS documents, sum(len(terms))::BIGINT AS length FROM docs WHERE len(terms) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), tfs AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term) CROSS JOIN totals
), impacts AS (
  SELECT t.r, doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms)::BIGINT * documents) // length))) AS impact
  FROM tfs t JOIN docs d ON t.r = d.r JOIN weights v ON t.term = v.term CROSS JOIN totals
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM impacts i JOIN asked a ON i.term = a.term GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= {BEST}
"""
