"""Toxicity scores from a lexicon that is matched through misspellings and weighed by its context.

Learning: over a bounded sample of labelled rows, words and word beginnings are counted in toxic and other documents; those
that a likelihood-ratio test ties to toxic ones, and that stand in several surroundings there, become entries of a lexicon,
beside a short list to start from. An entry is a whole word or a stem. A logistic curve over the evidence is then fitted to the same rows, drawn towards a fixed
prior, so that few or no labels do no harm.

Matching: the entries form a trie. A Levenshtein automaton runs over it: its states are sets of trie nodes with the edits
spent, made as words need them, so a word costs a step a character. Entries of up to 4 letters take no edit, of up to 8
one, longer ones two; digits and signs that look like letters, and letters held down, are free. An entry whose misspelt
forms turn up in other documents too often takes none.

Context: a hit counts less where the window of words around it quotes or reports, and more where it addresses someone.

Each document's evidence is the sum of its hits' weights. Labels, languages, sources and keys are no input of a score.
Nulls: a null text counts as empty; empty texts get the score of no evidence. Rows of labels with nulls are not learnt
from; of several labels of one key the highest counts. Repeated rows get the same scores; of entries that a word ties
between, the first counts. Very long texts are scored whole, a row at a time. score() leaves other columns out, and
reject() keeps them, whatever their names. Without labels the lexicon is the list to start from; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm._base import Remember, fold, map_rows, table

#: Labelled rows that are learnt from at most; of more, those whose keys hash lowest.
SAMPLE_ROWS = 20_000
#: Least tie of an entry, and the documents that must have it; what passes is bounded by the sample.
LEAST_TIE, LEAST_DOCS = 25.0, 4
#: The least share of toxic documents' surroundings among all that an entry is found in.
PRECISION = 0.8
STEMS = (4, 5, 6, 7)
WINDOW = 4
THRESHOLD = 0.7
#: What the curve is drawn towards, offset and slope, with the weight of so many rows.
PRIOR, PRIOR_ROWS = (-3.0, 1.6), 4.0
HEAVIEST, SEED_WEIGHT, MISSPELT = 5.0, 3.0, 0.5
QUOTED, ADDRESSED = 0.3, 1.25

# Words to start from, before any label is seen.
SEEDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "dumbass", "fool", "garbage", "idiot",
    "imbecile", "loser", "lowlife", "moron", "pathetic", "retard", "scum", "scumbag", "stupid", "trash", "vermin",
    "worthless",
)
# Words that report speech or name a word, and words that address someone.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes term word words phrase reported allegedly dit mot sagte wort dijo palabra".split())
ADDRESSING = frozenset("you your you're youre u ur yourself du dich dein tu toi vous tú ti usted eres".split())
OPENING, CLOSING = frozenset("\"'“‘«„`"), frozenset("\"'”’»“`")
# Characters that stand in for letters.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il"}

EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """Lower-case, without signs at either end."""
    w = word.lower()
    return w if w.isalnum() else EDGE.sub("", w)


def edits_of(entry: str) -> int:
    return 0 if len(entry) <= 4 else 1 if len(entry) <= 8 else 2


class FuzzyTrie:
    """A trie of entries and, over it, the automaton of all words within their edits; see the module's head."""

    #: States and transitions that are kept.
    KEEP = 60_000

    def __init__(self, entries: list[tuple[str, bool, int]]):
        """entries: text, whether words may go on behind it, edits."""
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.letter = [""]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # the most edits that any entry below a node takes
        for i, (text, _, edits) in enumerate(entries):
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in text:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.letter.append(c)
                    self.ends.append([])
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append(i)
        self.alphabet = {c for t, _, _ in entries for c in t} | LOOKS.keys()
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[frozenset, int] = {}
        self.stems: list[tuple[int, int] | None] = []
        self.finals: list[tuple[int, int] | None] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.first = self._state({0: 0}, None)

    def _state(self, reached: dict[int, int], stem: tuple[int, int] | None) -> int:
        """reached: node to the fewest edits. Leaving a letter of an entry out is an edit that takes no character."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node]
            for child in self.children[node].values():
                if e < self.reach[child] and reached.get(child, 9) > e + 1:
                    reached[child] = e + 1
                    todo.append(child)
        final = None
        for node, e in reached.items():
            for i in self.ends[node]:
                if e <= self.entries[i][2]:
                    if final is None or (e, i) < (final[1], final[0]):
                        final = (i, e)
                    if self.entries[i][1] and (stem is None or (e, i) < (stem[1], stem[0])):
                        stem = (i, e)
        key = frozenset([*reached.items(), ("stem", stem)])
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(tuple(reached.items()))
            self.stems.append(stem)
            self.finals.append(final)
        return found

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and reached.get(node, 9) > e:
                reached[node] = e

        alike = c + LOOKS.get(c, "")
        for node, e in self.states[state]:
            if node and self.letter[node] in alike:
                put(node, e)  # a letter held down
            put(node, e + 1)  # a character too many
            for letter, child in self.children[node].items():
                put(child, e if letter in alike else e + 1)
        return self._state(reached, self.stems[state])

    def match(self, word: str) -> tuple[int, int] | None:
        """The entry that a word is or starts with, and the edits; of several the fewest edits, then the first entry."""
        state = self.first
        if len(self.steps) > self.KEEP:
            self._reset()
            state = self.first
        steps = self.steps
        for c in word:
            if c not in self.alphabet:
                c = ""
            nxt = steps.get((state, c))
            if nxt is None:
                nxt = steps[state, c] = self._step(state, c)
            state = nxt
            if not self.states[state]:
                break
        else:
            final, stem = self.finals[state], self.stems[state]
            return min((x for x in (final, stem) if x), key=lambda x: (x[1], x[0]), default=None)
        return self.stems[state]


class Lexicon:
    """Entries with weights, matched through misspellings; scores whole texts."""

    #: Words that are remembered, about, and their characters at most; longer ones, as encoded data, are matched anew.
    REMEMBER, LONGEST = 60_000, 64

    def __init__(self, entries: list[tuple[str, bool, float]], exact: frozenset[str] = frozenset(), curve: tuple[float, float] = PRIOR):
        """entries: text, whether a stem, weight; exact: the entries that take no edits."""
        self.list, self.exact, self.curve = sorted(entries), exact, curve
        self._open()

    def _open(self) -> None:
        self.trie = FuzzyTrie([(t, stem, 0 if t in self.exact or stem and len(t) < 6 else edits_of(t)) for t, stem, _ in self.list])
        self.seen = Remember(self._match, self.REMEMBER, keep=lambda word: len(word) <= self.LONGEST)

    def _match(self, word: str) -> tuple[int, int] | None:
        w = bare(word)
        return self.trie.match(w) if w else None

    def __getstate__(self):
        return self.list, self.exact, self.curve

    def __setstate__(self, state):
        self.list, self.exact, self.curve = state
        self._open()

    def hits(self, text: str) -> list[tuple[int, int, int, float]]:
        """Word's place, entry, edits and the factor of its context."""
        words = text.split()
        found = [(i, h) for i, h in enumerate(map(self.seen.__getitem__, words)) if h]
        return [(i, h[0], h[1], _context(words, i)) for i, h in found]

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, number of hits, number of misspelt ones."""
        found = self.hits(text)
        total = sum(self.list[k][2] * (MISSPELT if e else 1.0) * f for _, k, e, f in found)
        return total, len(found), sum(e > 0 for _, _, e, _ in found)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * evidence)))


def _context(words: list[str], at: int) -> float:
    near = words[max(0, at - WINDOW) : at + WINDOW + 1]
    before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
    opened = any(w[0] in OPENING for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after)
    named = [bare(w) for w in near if w is not words[at]]
    if opened and closed or not REPORTING.isdisjoint(named):
        return QUOTED
    return ADDRESSED if not ADDRESSING.isdisjoint(named) else 1.0


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """y, text: at most ``rows`` labelled documents outside the held-out fold. Their keys are few enough to send everywhere.

    Of rows that share a key, the one whose text hashes lowest is the document.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, folds) != held))
    usable = usable.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("y"))
    n = usable.count()
    if n > 2 * rows:  # so that no task sorts more than a few times as many
        usable = usable.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int((1 << 30) * 1.5 * rows / n))
    chosen = usable.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    rows_of = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    return rows_of.groupBy("_key").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")


def _features(sample: DataFrame) -> DataFrame:
    """word, stem, n0, n1: of words and beginnings, the documents that have them, by label; summed in each task first."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        docs = [0, 0]

        def out():
            names = list(counts[0].keys() | counts[1].keys())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in names]), pa.array([s for _, s in names], pa.bool_()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["word", "stem", "n0", "n1"])
            for c in counts:
                c.clear()

        for batch in batches:
            for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = int(y > 0)
                words = {bare(w) for w in (t or "").split()} - {""}
                found = {(w, False) for w in words}
                found |= {(w[:n], True) for w in words for n in STEMS if len(w) >= n}
                counts[y].update(found)
                docs[y] += 1
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield from out()
        yield from out()
        if any(docs):
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([False]), pa.array([docs[0]]), pa.array([docs[1]])], names=["word", "stem", "n0", "n1"])

    return sample.mapInArrow(run, "word string, stem boolean, n0 bigint, n1 bigint").groupBy("word", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _in_contexts(sample: DataFrame, found: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool, int, int]]:
    """Of the candidates, those that toxic documents use in several surroundings and others hardly ever do.

    A document that was copied many times ties all its words to its label; but its copies have them between the same two
    words. So the counts are of distinct pairs of neighbours.
    """
    sent = sample.sparkSession.sparkContext.broadcast(({w for w, s, *_ in found if not s}, {w for w, s, *_ in found if s}))

    def start():
        whole, stems = sent.value

        def row(y, t):
            words = [bare(w) for w in (t or "").split()]
            out = set()
            for i, w in enumerate(words):
                hits = [(w, False)] if w in whole else []
                hits += [(w[:n], True) for n in STEMS if len(w) >= n and w[:n] in stems]
                if hits:
                    near = hash_words(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                    out.update((*h, int(y > 0), near) for h in hits)
            return out

        return row

    rows = map_rows(sample.select("y", "text"), "word string, stem boolean, y int, near bigint", start)
    counted = rows.distinct().groupBy("word", "stem").agg(F.count_if(F.col("y") == 0).alias("m0"), F.count_if(F.col("y") == 1).alias("m1"))
    kept = counted.where((F.col("m1") >= LEAST_DOCS) & (F.col("m1") >= PRECISION * (F.col("m0") + F.col("m1"))))
    names = {(r["word"], r["stem"]) for r in kept.select("word", "stem").collect()}
    return [f for f in found if (f[0], f[1]) in names]


def hash_words(*words: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest("\0".join(words)) >> 1


def _weight(n0: int, n1: int, all0: int, all1: int) -> float:
    return min(HEAVIEST, math.log((n1 + 0.5) / (all1 + 1)) - math.log((n0 + 0.5) / (all0 + 1)))


def _tie(n0, n1, all0: int, all1: int):
    """The likelihood-ratio statistic of a two by two table, as a column."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, rest = n0 + n1, all0 + all1 - n0 - n1
    p0, p1 = all0 / (all0 + all1), all1 / (all0 + all1)
    return 2 * (part(n0, n * p0) + part(n1, n * p1) + part(all0 - n0, rest * p0) + part(all1 - n1, rest * p1))


def _tied(n0: int, n1: int, all0: int, all1: int) -> float:
    """The statistic of _tie() for numbers."""
    out, everyone = 0.0, all0 + all1
    for seen, of in ((n0, all0), (n1, all1)):
        for x, row in ((seen, n0 + n1), (of - seen, everyone - n0 - n1)):
            if x:
                out += 2 * x * math.log(x / (row * of / everyone))
    return out


def _entries(found: list[tuple[str, bool, int, int]], all0: int, all1: int) -> list[tuple[str, bool, float]]:
    """Of nested beginnings, the one that is tied best, a longer one if it is about as good; words that no stem covers."""
    stems = {w: (n0, n1) for w, s, n0, n1 in found if s}
    kept: dict[str, tuple[bool, float]] = {}
    for w in sorted(stems, key=lambda w: (-_tied(*stems[w], all0, all1) * (1 + 0.03 * (len(w) - min(STEMS))), w)):
        if not any(k.startswith(w) or w.startswith(k) for k in kept):
            kept[w] = (True, _weight(*stems[w], all0, all1))
    for w, s, n0, n1 in found:
        if not s:
            covered = next((w[:n] for n in range(len(w), 0, -1) if kept.get(w[:n], (False,))[0]), None)
            if covered is None:
                kept[w] = (False, _weight(n0, n1, all0, all1))
            elif n1 >= 0.5 * stems[covered][1] and len(w) <= len(covered) + 3 and w != covered:
                kept[w] = (False, _weight(n0, n1, all0, all1))  # the word itself, for its misspellings
    return [(w, s, x) for w, (s, x) in kept.items() if x > 1]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve, by Newton's steps, drawn towards PRIOR."""
    b, prior, pull = np.array(PRIOR), np.array(PRIOR), np.array([PRIOR_ROWS, PRIOR_ROWS]) / 4
    a = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * (b - prior))
        size = np.abs(step).max()
        b = b + step / max(1.0, size)
        if size < 1e-9:
            break
    return (float(b[0]), max(float(b[1]), 0.0))


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, rows: int = SAMPLE_ROWS) -> Lexicon:
    sample = _sample(docs, labels, key, text, label, folds, held, rows).persist()
    try:
        counted = _features(sample).persist()
        sizes = counted.where("word = ''").select("n0", "n1").first()
        all0, all1 = (sizes["n0"], sizes["n1"]) if sizes else (0, 0)
        seeds = {w: SEED_WEIGHT for w in SEEDS}
        for w, n0, n1 in counted.where(F.col("word").isin(list(SEEDS)) & ~F.col("stem")).select("word", "n0", "n1").collect():
            if n0 + n1 >= 5:
                seeds[w] = _weight(n0, n1, all0, all1)
        entries = [(w, False, x) for w, x in seeds.items() if x > 1]
        if all0 and all1:
            tie = _tie(F.col("n0"), F.col("n1"), all0, all1)
            toxic = F.col("n1") / all1 > F.col("n0") / all0
            best = counted.where((F.col("word") != "") & (F.col("n1") >= LEAST_DOCS) & toxic).withColumn("tie", tie).where(F.col("tie") >= LEAST_TIE)
            found = sorted(tuple(r) for r in best.select("word", "stem", "n0", "n1").collect())
            learnt = _entries(_in_contexts(sample, found), all0, all1)
            entries = [e for e in entries if e[0] not in {x[0] for x in learnt}] + learnt
        counted.unpersist()
        if not entries:
            return Lexicon([("\0", False, 0.0)])
        exact: frozenset[str] = frozenset()
        while more := _loose(sample, Lexicon(entries, exact), all0):  # a form is counted for one entry at a time, so the next may show only then
            exact |= more
        lexicon = Lexicon(entries, exact)
        points = [(r["e"], r["y"]) for r in _evidence(sample.select("y", "text"), lexicon, "y").select("e", "y").collect()]  # at most ``rows``
        # Toxic rows without any evidence say nothing about how much evidence it takes, and may be labelled by mistake.
        points = [(e, y) for e, y in points if e > 0 or y == 0]
        x, y = np.array([p[0] for p in points], float), np.array([float(p[1] > 0) for p in points])
        lexicon.curve = _fit(x, y) if len(x) else PRIOR
        return lexicon
    finally:
        sample.unpersist()


def _loose(sample: DataFrame, lexicon: Lexicon, clean: int) -> frozenset[str]:
    """Entries whose misspelt forms are in over one in 2,000 of the clean documents, and in more than one."""
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        lex = sent.value
        return lambda t: ((lex.list[k][0],) for k in {h[1] for h in lex.hits(t or "") if h[2]})

    seen = map_rows(sample.where("y = 0").select("text"), "entry string", start).groupBy("entry").agg(F.count("*").alias("n"))
    return frozenset(r["entry"] for r in seen.where(F.col("n") > max(1.0, clean / 2000)).collect())  # at most as many as entries


def _evidence(rows: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """key, e, n_hits, n_misspelt, score"""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        lex = sent.value

        def row(k, t):
            e, n, m = lex.evidence(t or "")
            yield k, e, n, m, lex.score(e)

        return row

    return map_rows(rows, f"{key} {dict(rows.dtypes)[key]}, e double, n_hits bigint, n_misspelt bigint, score double", start)


def score(docs: DataFrame, lexicon: Lexicon, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score, predicted, n_hits, n_misspelt: a row a document."""
    found = _evidence(docs.select(key, text), lexicon, key)
    return found.select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "n_misspelt")


def reject(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not toxic, with all their columns; no row is moved."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            yield batch.filter(pa.array([lex.score(lex.evidence(t.as_py() or "")[0]) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "n_misspelt")
