import hashlib
import math
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

from litmill.llm import mixing, sentencepiece_codec, toxicity
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_mixing import water
from tests.llm.test_similar import brute as near_copies
from tests.llm.test_toxicity import plain_evidence, plain_learn

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_copies(rows):
    """rows: key, text, source. How often each key is taken."""
    size = {k: len([w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]) for k, t, _ in rows}
    draw = {k: int(hashlib.sha256(f"{mixing.SEED}:{k}".encode()).hexdigest()[:12], 16) / 2**48 for k, *_ in rows}
    of = defaultdict(list)
    for k, _, s in rows:
        of[s].append(k)
    targets, out = water({s: sum(size[k] for k in keys) for s, keys in of.items()}), {}
    for s, keys in of.items():
        words = sum(size[k] for k in keys)
        rate = targets[s] / words if words else 0.0
        asked = (rate - int(rate + 1e-12)) * words
        ahead, before = int(hashlib.sha256(f"{mixing.SEED}:{'no source' if s is None else f'source {s}'}".encode()).hexdigest()[:12], 16) / 2**48 * words, 0
        for b in sorted({int(draw[k] * mixing.BINS) for k in keys}):
            here = [k for k in keys if int(draw[k] * mixing.BINS) == b]
            start = before + ahead
            more = (start - words if start >= words else start) < asked
            out |= {k: min(3, int(rate + 1e-12) + more) for k in here}
            before += sum(size[k] for k in here)
    return out


def brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    marked = [(rows[r["doc_id"]]["text"] or "", r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in rows and corpus_fold(r["doc_id"]) != 1]
    entries, exact, slope = plain_learn(marked)
    curve = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet")).curve
    assert slope(curve) == pytest.approx([0, 0], abs=1e-6)
    seen = {}
    rows = {k: r for k, r in rows.items() if 1 / (1 + math.exp(-curve[0] - curve[1] * plain_evidence(r["text"] or "", entries, exact, seen)[0])) < 0.7}
    clean = {k: t for k, t, _ in plain_lines([(k, r["text"], r["source"]) for k, r in rows.items()], 5, True)}
    kept = sorted(set(near_copies(sorted(clean.items())).values()))
    copies = plain_copies([(k, clean[k], rows[k]["source"]) for k in kept])
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = Counter()
    for k in kept:
        ids = [*lib.encode(clean[k]), lib.eos_id()]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids))]
        out[k, len(ids), *sha] += copies[k]
    return +out


def corpus_fold(key):
    import zlib

    return zlib.crc32(str(key).encode()) % 3


def test_run_agrees_with_brute_force(spark, sf):
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == brute(spark, sf)


def test_stages_keep_columns_and_take_odd_tables(spark, sf):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "x y", "en", "b", 3), (5, "moron scum idiot", "en", "b", 9), (7, "w " * 40_000, "de", "c", None)]
    names = ("key", "th", "id", "row", "marks", "clean", "chance", "rate", "copies", "score", "e", "label", "kept", "component", "stay_key")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    for frame in (docs, docs.where(F.lit(False))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf)
            assert frame.schema.names == docs.columns and [t for _, t in frame.dtypes] == [t for _, t in docs.dtypes]
        ids = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()}
        assert 5 not in ids
