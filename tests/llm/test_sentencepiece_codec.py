import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from litmill.llm import sentencepiece_codec as sc


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=sc.default_model())


@pytest.fixture(scope="module")
def own():
    return sc.Codec(sc.default_model())


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def check(lib, own, t):
    ids = [*lib.encode(t), lib.eos_id()]
    assert own.encode(t) == ids, t[:80]
    assert own.decode(ids) == lib.decode(ids)
    assert own.digest(t) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "\n\nx\ty", "▁a▁b", "é́ €😀\x00z", "</s><s><unk>", "<0x41>", "a�b", "ﬁ Ａ", "x" * 20_000, "▁" * 77 + " " * 33, "ab " * 30_000, "\r\n \x85 "])
def test_as_the_library(lib, own, text):
    check(lib, own, text)


def test_random_texts_as_the_library(lib, own):
    random.seed(11)
    for alphabet in ("ab▁ \n\té€😀Ａthe ing<>0x41\x00�你好", "thereinandof ", "ΑαБбжשםあア한"):
        for _ in range(1500):
            check(lib, own, "".join(random.choice(alphabet) for _ in range(random.randrange(50))))


def test_forgetting_changes_nothing(lib, monkeypatch):
    monkeypatch.setattr(sc.Codec, "REMEMBER", 3)
    monkeypatch.setattr(sc.Codec, "PAIRS", 2)
    small = sc.Codec(sc.default_model())
    for t in ("the one and the other thing", "one thing after another", "the one and the other thing"):
        check(lib, small, t)
    assert len(small.known) + len(small.known.old) <= 6


def test_query_as_the_library(spark, sf, lib):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sc.op10_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = [*lib.encode(docs[r["doc_id"]]), lib.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_nulls_repeats_clashing_names_and_empty_tables(spark, lib):
    docs = spark.createDataFrame([(1, None, "x"), (2, "a b", None), (2, "a b", "y"), (None, "", "z")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in sc.encode(docs, sc.default_model()).collect())
    assert got == [(0, [2], ""), (1, [2], ""), (2, [*lib.encode("a b"), 2], "a b"), (2, [*lib.encode("a b"), 2], "a b")]
    assert sc.encode_digest(docs.where(F.lit(False)), sc.default_model()).count() == 0
