import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import chroma as ch


def song(seed, seconds=12):
    rng = np.random.default_rng(seed)
    t = np.arange(int(0.2 * ch.RATE)) / ch.RATE
    return np.concatenate([sum(0.25 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) for p in rng.integers(0, 36, 3)) for _ in range(int(seconds * 5))])


def test_integral_filters_agree_with_sums():
    image = np.random.default_rng(1).random((30, 12))
    packed, sound = ch.items(image)
    assert len(packed) == 15 and sound.all()
    for at in (0, 7, 14):
        want = 0
        for kind, c, height, width in ch.filters():
            h = min(height, 12 - c)
            box = image[at : at + width, c : c + h]
            if kind == 0:
                a, b = box.sum(), (image[at : at + width].sum() - box.sum()) * h / (12 - h)
            elif kind == 1:
                a, b = box[width // 2 :].sum(), box[: width // 2].sum()
            elif kind == 2:
                a, b = box[:, h // 2 :].sum(), box[:, : h // 2].sum()
            else:
                a = box[: width // 2, : h // 2].sum() + box[width // 2 :, h // 2 :].sum()
                b = box.sum() - a
            x = np.log((1 + a) / (1 + b))
            want = want << 2 | [0, 1, 3, 2][int((x > ch.RANGES).sum())]
        assert int(packed[at]) == want


def test_an_excerpt_aligns_at_its_offset_and_other_songs_do_not():
    whole = song(1)
    a = ch.fingerprint(ch.encode(whole))
    noisy = whole + np.random.default_rng(2).normal(0, 0.01, len(whole))
    start = 20 * ch.HOP
    b = ch.fingerprint(ch.encode(0.7 * noisy[start : start + 6 * ch.RATE]))
    offset, common, overlap, errors = ch.align(*a, *b)
    assert offset == 20 and errors / (32 * overlap) < 0.1 and common >= ch.LEAST_COMMON
    assert ch.align(*a, *ch.fingerprint(ch.encode(song(9)))) is None


def test_rates_channels_and_what_cannot_be_read():
    x = song(3, 4)
    low, high = ch.fingerprint(ch.encode(x))[0], ch.fingerprint(ch.encode(np.repeat(x, 2), 2 * ch.RATE))[0]
    assert np.bitwise_count(low[: len(high)] ^ high[: len(low)]).mean() < 3
    for bad in (None, b"", b"RIFF", ch.encode(x)[:50], ch.encode(np.zeros(100))):
        assert len(ch.fingerprint(bad)[0]) == 0
    silent = ch.fingerprint(ch.encode(np.zeros(5 * ch.RATE)))
    assert len(silent[0]) and not silent[1].any() and ch.align(*silent, *silent) is None


def brute(rows, every, best=None):
    """Of each query: match class, its copies, offset, common, overlap, errors."""
    prints = [(k, ch.fingerprint(v)) for k, v in rows if k is not None]
    of = {}
    for k, p in prints:
        if len(p[0]):
            of.setdefault((p[0].tobytes(), p[1].tobytes()), []).append((k, p))
    classes = [(min(k for k, _ in x), len(x), x[0][1]) for x in of.values()]
    out = {}
    for q, a in prints:
        if q % every == 0 and len(a[0]):
            own = min(k for k, _ in of[a[0].tobytes(), a[1].tobytes()])
            got = []
            for c, n, b in classes:
                if (r := ch.align(*a, *b)) and (c != own or n > 1):
                    got.append((r[3] / r[2], -r[2], c, n - (c == own), *r))
            out[q] = [g[2:] for g in sorted(got)[:best]]
    return out


def found(frame, every):
    out = {}
    for r in frame.collect():
        if r["vec_id"] is not None and r["vec_id"] % every == 0 and r["class_id"] is not None:
            own = out.setdefault(r["vec_id"], set())
            if r["rank"] is not None:
                own.add((r["rank"], r["match_class"], r["copies"], r["offset"], r["common"], r["overlap"], round(r["bit_error_rate"] * 32 * r["overlap"])))
        else:
            assert r["rank"] is None and r["match_class"] is None
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("best", [None, 4])
def test_search_agrees_with_brute_force(spark, best):
    names = ("id", "items", "sound", "sha", "class_id", "rank")
    rows = []
    for i in range(40):
        x = song(i % 9, 7)
        rows.append((i, ch.encode(x[(i % 5) * ch.HOP :])))
    rows += [(None, rows[0][1]), (50, None), (51, b"junk"), (55, ch.encode(np.zeros(5 * ch.RATE))), (60, rows[10][1]), (61, rows[10][1])]
    df = spark.createDataFrame([(*r, *names) for r in rows], "vec_id bigint, audio binary, " + ", ".join(f"{n} string" for n in names))
    got = ch.identify(df, lambda v: v, key="vec_id", column="audio", every=5, best=best)
    assert found(got, 5) == brute(rows, 5, best)
    assert got.select("vec_id").distinct().count() == len(rows)
    assert ch.identify(df.where(F.lit(False)), lambda v: v, key="vec_id", column="audio").count() == 0


def test_query_agrees_with_brute_force(spark, sf):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = ch.op9_chroma(spark, sf)
    assert found(got, 50) == brute([(k, ch.tune(v)) for k, v in table.items()], 50)
    rows = got.collect()
    assert {r["vec_id"] for r in rows} == table.keys()
    for r in rows:
        p = ch.fingerprint(ch.tune(table[r["vec_id"]]))[0]
        assert r["n_items"] == len(p) > 10 and r["items_sha256"] == hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest()


def test_copies_are_one_match_with_their_number(spark):
    x, y = ch.encode(song(1, 4)), ch.encode(song(8, 4))
    rows = [(i, x) for i in range(24)] + [(30, y), (50, y)]
    got = ch.identify(spark.createDataFrame(rows, "vec_id bigint, audio binary"), lambda v: v, key="vec_id", column="audio")
    assert [x[:2] for x in found(got, 50)[0]] == [(0, 23)] and [x[:2] for x in found(got, 50)[50]] == [(30, 1)]


def test_a_long_recording(spark):
    x = song(2, 240)
    rows = [(0, ch.encode(x)), (1, ch.encode(x[100 * ch.HOP : 300 * ch.HOP]))]
    got = found(ch.identify(spark.createDataFrame(rows, "vec_id bigint, audio binary"), lambda v: v, key="vec_id", column="audio"), 50)
    assert [x[:3] for x in got[0]] == [(1, 1, 100)]


def test_a_held_chord_is_a_run(spark):
    rng = np.random.default_rng(7)
    held = np.repeat(rng.integers(0, 1 << 31, 6), [300, 1, 40, 700, 1, 5])
    sound = rng.random(len(held)) > 0.01
    prints = [(0, held, sound), (1, held[100:], sound[100:]), (2, np.roll(held, 13), np.roll(sound, 13)), (3, held[::-1].copy(), sound[::-1].copy()), (4, np.full(500, held[0]), np.ones(500, bool)), (5, held[:0], sound[:0])]
    frame = spark.createDataFrame([(k, a.tolist(), s.tolist()) for k, a, s in prints], "id bigint, items array<bigint>, sound array<boolean>")
    made = ch.materialise(ch.classed(frame))
    assert ch._runs(made.withColumn("asked", F.lit(True)).where("class_id is not null")).count() < 150
    got = {(r["query_class"], r["match_class"]): (r["offset"], r["common"], r["overlap"], r["errors"]) for r in ch.search(made, every=1).collect()}
    want = {(x, y): r for x, a, s in prints for y, b, t in prints if x != y and len(a) and len(b) and (r := ch.align(a, s, b, t))}
    assert got == want and len(want) > 6
