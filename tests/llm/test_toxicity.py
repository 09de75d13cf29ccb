import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litmill.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_agrees_with_edit_distance():
    random.seed(8)
    words = ["abcde", "abdce", "cab", "abcabcabc", "badab"]
    trie = tox.FuzzyTrie([(w, False, tox.edits_of(w)) for w in words])
    for _ in range(4000):
        w = "".join(random.choice("abcdex") for _ in range(random.randrange(12)))
        if any(x == y for x, y in zip(w, w[1:], strict=False)):
            continue  # letters held down are free, which plain distance doesn't know
        near = [(distance(w, e), i) for i, e in enumerate(words) if distance(w, e) <= tox.edits_of(e)]
        got = trie.match(w)
        assert (got is not None) == bool(near), w
        if near:
            assert got[1] == min(near)[0]


@pytest.mark.parametrize(("word", "hit"), [("idiot", 0), ("1di0t", 0), ("idiooot", 0), ("idot", 1), ("idixot", 1), ("ixiyt", None), ("idiots", 1), ("stemming", 0), ("stem", 0), ("ste", None), ("stme", None), ("", None)])
def test_misspellings_and_stems(word, hit):
    trie = tox.FuzzyTrie([("idiot", False, 1), ("stem", True, 0)])
    got = trie.match(word)
    assert (got and got[1]) == hit


def test_context_separates_quotation_from_abuse():
    lex = tox.Lexicon([("idiot", False, 5.0), ("scum", False, 5.0)])
    plain, quoted, reported, addressed = (lex.evidence(t)[0] for t in ("an idiot here", 'the "idiot" here', "he called them idiot there", "you idiot here"))
    assert quoted < plain and reported < plain < addressed
    assert lex.score(quoted) < tox.THRESHOLD <= lex.score(plain)


def toxic_docs(n, seed):
    random.seed(seed)
    plain = [f"w{i}" for i in range(200)]
    for i in range(n):
        t = random.choices(plain, k=40)
        y = int(i % 5 == 0)
        if y:
            t[3:20:4] = [random.choice(["glorp", "zundry", "zundrie", "zundrox", "moron"]) for _ in t[3:20:4]]
        yield i, " ".join(t), y


def test_learns_words_and_stems_and_holds_out(spark):
    rows = list(toxic_docs(900, 3))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id bigint, quality int, toxic int")
    lexicon = tox.learn(docs, labels)
    names = {w: s for w, s, _ in lexicon.list}
    assert "glorp" in names and any(s and "zundry".startswith(w) or w == "zundr" for w, s in names.items())
    got = {r["doc_id"]: r["predicted"] for r in tox.score(docs, lexicon).collect()}
    assert got == {k: y for k, _, y in rows}
    unseen = spark.createDataFrame([(1, "w1 zundrawak w2 w3 zundreee glorpp w9"), (2, "w1 w2")], "doc_id bigint, text string")
    assert [r["predicted"] for r in tox.score(unseen, lexicon).orderBy("doc_id").collect()] == [1, 0]


def test_held_out_labels_have_no_influence(spark):
    rows = list(toxic_docs(300, 4))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tox.learn(docs, labels), tox.learn(docs, turned)
    assert a.list == b.list and a.curve == b.curve


def plain_bare(word):
    w = word.lower()
    return w if w.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", w)


def plain_distances(word, entry):
    """Of each beginning of the word, the edits from the entry; looks and letters held down are free."""
    row = list(range(len(entry) + 1))
    out = [row[-1]]
    for x in word:
        alike = x + tox.LOOKS.get(x, "")
        new = [row[0] + 1]
        for j, y in enumerate(entry, 1):
            new.append(min(row[j - 1] + (y not in alike), row[j] + (y not in alike), new[-1] + 1))
        row = new
        out.append(row[-1])
    return out


def plain_match(word, entries, exact):
    """The entry with the fewest edits, then the first; a stem may end before the word does."""
    best = None
    for i, (text, stem, _) in enumerate(entries):
        edits = 0 if text in exact or stem and len(text) < 6 or len(text) <= 4 else 1 if len(text) <= 8 else 2
        if not stem and abs(len(word) - len(text)) > edits and not any(a == b for a, b in zip(word, word[1:], strict=False)):
            continue
        found = plain_distances(word, text)
        e = min(found) if stem else found[-1]
        if e <= edits and (best is None or e < best[1]):
            best = (i, e)
    return best


def plain_evidence(text, entries, exact, seen):
    words = text.split()
    total, loose = 0.0, set()
    for i, w in enumerate(words):
        b = plain_bare(w)
        if b not in seen:
            seen[b] = plain_match(b, entries, exact) if b else None
        if seen[b]:
            near = [plain_bare(x) for j, x in enumerate(words[max(0, i - 4) : i + 5], max(0, i - 4)) if j != i]
            opened = any(x[0] in tox.OPENING for x in words[max(0, i - 4) : i + 1])
            closed = any(x.rstrip(".,;:!?")[-1:] in tox.CLOSING for x in words[i : i + 5])
            quoted = opened and closed or any(x in tox.REPORTING for x in near)
            factor = 0.3 if quoted else 1.25 if any(x in tox.ADDRESSING for x in near) else 1.0
            total += entries[seen[b][0]][2] * factor * (0.5 if seen[b][1] else 1)
            if seen[b][1]:
                loose.add(entries[seen[b][0]][0])
    return total, loose


def plain_learn(rows):
    """rows: texts and labels. The entries, those without edits, and the curve, by plain counting."""
    counts = {}
    all_ = [sum(y <= 0 for _, y in rows), sum(y > 0 for _, y in rows)]
    for t, y in rows:
        words = {plain_bare(w) for w in t.split()} - {""}
        for x in {(w, False) for w in words} | {(w[:n], True) for w in words for n in (4, 5, 6, 7) if len(w) >= n}:
            counts.setdefault(x, [0, 0])[y > 0] += 1

    def tie(n0, n1):
        out = 0.0
        for seen, of in ((n0, all_[0]), (n1, all_[1])):
            for x, row in ((seen, n0 + n1), (of - seen, sum(all_) - n0 - n1)):
                out += 2 * x * math.log(x / (row * of / sum(all_))) if x else 0
        return out

    def weight(n0, n1):
        return min(5.0, math.log((n1 + 0.5) / (all_[1] + 1)) - math.log((n0 + 0.5) / (all_[0] + 1)))

    found = {x: n for x, n in counts.items() if n[1] >= 4 and n[1] / all_[1] > n[0] / all_[0] and tie(*n) >= 25}
    near = {x: (set(), set()) for x in found}
    for t, y in rows:
        words = [plain_bare(w) for w in t.split()]
        for i, w in enumerate(words):
            for x in [(w, False), *((w[:n], True) for n in (4, 5, 6, 7) if len(w) >= n)]:
                if x in near:
                    near[x][y > 0].add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    found = {x: n for x, n in found.items() if len(near[x][1]) >= 4 and len(near[x][1]) >= 0.8 * len(near[x][0]) + 0.8 * len(near[x][1])}
    kept = {}
    for w in sorted((w for w, s in found if s), key=lambda w: (-tie(*found[w, True]) * (1 + 0.03 * (len(w) - 4)), w)):
        if not any(k.startswith(w) or w.startswith(k) for k in kept):
            kept[w] = (True, weight(*found[w, True]))
    for w in sorted(w for w, s in found if not s):
        stem = next((w[:n] for n in range(len(w), 0, -1) if kept.get(w[:n], (False,))[0]), None)
        if stem is None or found[w, False][1] >= 0.5 * found[stem, True][1] and len(w) <= len(stem) + 3 and w != stem:
            kept[w] = (False, weight(*found[w, False]))
    seeds = {w: weight(*counts[w, False]) if sum(counts.get((w, False), (0, 0))) >= 5 else 3.0 for w in tox.SEEDS}
    entries = {w: (False, x) for w, x in seeds.items() if x > 1} | {w: e for w, e in kept.items() if e[1] > 1}
    entries = sorted((w, s, x) for w, (s, x) in entries.items())
    exact = set()
    while True:
        seen, hits = {}, Counter()
        for t, y in rows:
            if y <= 0:
                hits.update(plain_evidence(t, entries, exact, seen)[1])
        more = {w for w, n in hits.items() if n > max(1.0, all_[0] / 2000)}
        if not more:
            break
        exact |= more
    points = [(plain_evidence(t, entries, exact, seen)[0], y > 0) for t, y in rows]
    points = [(e, y) for e, y in points if e > 0 or not y]

    def slope(b):  # of the penalised likelihood
        off = [p - 1 / (1 + math.exp(-b[0] - b[1] * e)) for e, p in points]
        return [sum(off) - (b[0] + 3.0), sum(o * e for o, (e, _) in zip(off, points, strict=True)) - (b[1] - 1.6)]

    return entries, exact, slope


def test_query_agrees_with_a_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(docs[k], y) for k, y in labels.items() if k in docs and zlib.crc32(str(k).encode()) % 3 != 1]
    assert 0 < sum(y for _, y in rows) < len(rows)
    entries, exact, slope = plain_learn(rows)
    lexicon = tox.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert [(w, s) for w, s, _ in lexicon.list] == [(w, s) for w, s, _ in entries] and lexicon.exact == exact
    assert [x for *_, x in lexicon.list] == pytest.approx([x for *_, x in entries])
    assert slope(lexicon.curve) == pytest.approx([0, 0], abs=1e-6)  # the curve is at its best
    got = tox.op1_toxicity(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got, seen = got.collect(), {}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        e, _ = plain_evidence(docs[r["doc_id"]], entries, exact, seen)
        want = 1 / (1 + math.exp(-lexicon.curve[0] - lexicon.curve[1] * e))
        assert r["score"] == pytest.approx(want) and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_reject_keeps_columns_of_any_name(spark):
    rows = [(1, "moron scum idiot", "a", 1.0), (2, None, "b", 2.0), (3, "fine", "c", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, e string, score double")
    got = tox.reject(docs, tox.Lexicon([("moron", False, 5.0), ("scum", False, 5.0)]))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == rows[1:]


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, None, 2), (2, "", 2), (3, "moron scum idiot", 2), (3, "moron scum idiot", 2), (None, "a", 1), (5, "x " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id bigint, toxic int")
    for labels in (none, odd):
        got = tox.score(docs, tox.learn(docs, labels)).collect()
        assert sorted((r["doc_id"] or 0, r["predicted"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1), (5, 0)]
    assert tox.score(docs.where(F.lit(False)), tox.learn(docs.where(F.lit(False)), odd)).count() == 0


def test_long_words_are_not_remembered():
    lexicon = tox.Lexicon([("moron", False, 3.0)])
    blobs = [f"{i:05}" + "QUJD" * 500 for i in range(300)]
    assert lexicon.evidence(" ".join([*blobs, "you", "moron"]))[1] == 1
    assert set(lexicon.seen) <= {"you", "moron"}


def test_rows_of_one_key_are_one_document_of_the_sample(spark):
    docs = spark.range(3_000).select(F.when(F.col("id") < 2_900, 4).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    sample = tox._sample(docs, labels, "doc_id", "text", "toxic", 3, 1, 50).collect()
    assert len(sample) == 50
