"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames; the energy of each frame's spectrum is summed into twelve pitch classes, which
are smoothed over frames and scaled to length one. Box filters over the image of frames and classes, by its integral
image, compare energies of neighbouring areas; each answer is put in one of four ranges, coded in two bits so that
neighbouring ranges differ in one. Sixteen filters make one packed 32-bit item for each position.

Two recordings align at the offset that most equal items agree on (a histogram of offsets); there the bit error rate over
the overlap says whether they are the same. Recordings with one fingerprint are one class, searched once under its smallest
id. The stated queries' items are joined to all items, so what is met are equal items only, and the offsets of each pair
of classes are counted before their fingerprints are compared. Every alignment is kept, unless only the best are asked for.

Nulls: a null recording, one that is no 16-bit PCM WAVE file, or one shorter than the filters has no items and no matches.
Silent positions are in the fingerprint but are no evidence of an offset. Rows with one id are recordings of their own;
null ids have fingerprints and take no part in the search. Of offsets that tie, the one with the fewest errors counts, then
the one nearest to 0. Very long recordings are cut into frames a few at a time. Other columns are left out, so their names
can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm._base import DOCS_A_FILE, map_rows, materialise, table

RATE, FRAME, HOP = 11_025, 4096, 1365
LOWEST, HIGHEST = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH, CLASSES = 16, 12
RANGES = np.array([-0.15, 0.0, 0.15])
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Equal items at one offset that make a candidate, positions that must overlap, and the error rate up to which two align.
LEAST_COMMON, LEAST_OVERLAP, MOST_ERRORS = 3, 8, 0.25


def filters() -> list[tuple[int, int, int, int]]:
    """kind, first class, classes, frames: sixteen boxes by a rule, of all kinds, places and sizes."""
    return [(k % 4, (5 * k) % 9, 2 + k % 3 + (k % 2), (16, 12, 8, 4)[k // 4]) for k in range(16)]


def decode(audio: bytes | None) -> np.ndarray:
    """Samples from -1 to 1 at RATE, channels averaged; empty for what can't be read."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
            x = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1)
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return np.zeros(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_HZ >= LOWEST) & (_HZ <= HIGHEST))
_CLASS = np.round(12 * np.log2(_HZ[_USED] / 440.0)).astype(int) % CLASSES
_TO_CLASS = np.zeros((len(_USED), CLASSES))
_TO_CLASS[np.arange(len(_USED)), _CLASS] = 1
_WINDOW = np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """A row a frame, of twelve classes; all zero where it is silent. Frames are worked on a few at a time."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, CLASSES))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    image = np.concatenate([(np.abs(np.fft.rfft(view[i : i + 64] * _WINDOW, axis=1)[:, _USED]) ** 2) @ _TO_CLASS for i in range(0, n, 64)])
    if n >= len(SMOOTH):
        image = np.stack([np.convolve(image[:, c], SMOOTH, "valid") for c in range(CLASSES)], axis=1)
    size = np.sqrt((image * image).sum(axis=1, keepdims=True))
    return np.where(size > 1e-2, image / np.maximum(size, 1e-12), 0.0)


def items(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed item of each position, and whether its frames hold any sound."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    integral = np.zeros((len(image) + 1, CLASSES + 1))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(f0: int, f1: int, c0: int, c1: int) -> np.ndarray:
        return integral[at + f1, c1] - integral[at + f0, c1] - integral[at + f1, c0] + integral[at + f0, c0]

    packed = np.zeros(n, np.uint32)
    for kind, c, height, width in filters():
        height = min(height, CLASSES - c)
        half, mid = width // 2, height // 2
        whole = area(0, width, c, c + height)
        if kind == 0:  # a box against what is left of all classes
            a, b = whole, (area(0, width, 0, CLASSES) - whole) * height / (CLASSES - height)
        elif kind == 1:  # later against earlier
            a, b = area(half, width, c, c + height), area(0, half, c, c + height)
        elif kind == 2:  # higher classes against lower ones
            a, b = area(0, width, c + mid, c + height), area(0, width, c, c + mid)
        else:  # one diagonal against the other
            a = area(0, half, c, c + mid) + area(half, width, c + mid, c + height)
            b = whole - a
        answer = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        packed = (packed << np.uint32(2)) | GRAY[np.searchsorted(RANGES, answer)]
    sound = (image != 0).any(axis=1).cumsum()
    return packed, sound[WIDTH - 1 :] - np.concatenate([[0], sound[: n - 1]]) > 0


def fingerprint(audio: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return items(chroma(decode(audio)))


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and positions of the overlap when b's position 0 lies at a's ``offset``."""
    start, stop = max(0, offset), min(len(a), offset + len(b))
    if stop <= start:
        return 0, 0
    return int(np.bitwise_count(a[start:stop] ^ b[start - offset : stop - offset]).sum()), stop - start


def align(a: np.ndarray, sound_a: np.ndarray, b: np.ndarray, sound_b: np.ndarray) -> tuple[int, int, int, int] | None:
    """offset, equal items there, positions that overlap, bit errors; None if no offset has enough."""
    i, j = np.nonzero((a[:, None] == b[None, :]) & sound_a[:, None] & sound_b[None, :])
    return _best(np.asarray(i - j), a, b)


def _best(offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int] | None:
    if not len(offsets):
        return None
    low = int(offsets.min())
    histogram = np.bincount(offsets - low)
    common = int(histogram.max())
    if common < LEAST_COMMON:
        return None
    # Of offsets that as many agree on, the one with the fewest errors, then the one nearest to 0.
    errors = [(*bit_errors(a, b, int(o) + low), int(o) + low) for o in np.flatnonzero(histogram == common)]
    e, n, o = min(errors, key=lambda x: (x[0] / max(x[1], 1), abs(x[2]), x[2]))
    return (o, common, n, e) if n >= LEAST_OVERLAP and e <= MOST_ERRORS * 32 * n else None


def fingerprints(rows: DataFrame, audio_of: Callable, *, key: str, column: str) -> DataFrame:
    """id, items array<bigint>, sound array<boolean>; ``audio_of`` gives a file's bytes from the column's value."""

    def start():
        def row(k, v):
            p, s = fingerprint(audio_of(v))
            yield k, p.astype(np.int64).tolist(), s.tolist()

        return row

    return map_rows(rows.select(F.col(key).alias("id"), column), f"id {dict(rows.dtypes)[key]}, items array<bigint>, sound array<boolean>", start)


def classed(prints: DataFrame) -> DataFrame:
    """prints with sha (of the items) and class_id (the smallest id with the same fingerprint; null without items or id)."""
    sha = F.sha2(F.concat_ws(",", F.col("items").cast("array<string>"), F.col("sound").cast("array<string>")), 256)
    rows = prints.withColumn("sha", sha)
    of = rows.where(F.col("id").isNotNull() & (F.size("items") > 0)).groupBy("sha").agg(F.min("id").alias("class_id"))
    rows = rows.join(of, "sha", "left")
    return rows.withColumn("class_id", F.when(F.col("id").isNotNull(), F.col("class_id")))


def _runs(classes: DataFrame) -> DataFrame:
    """class_id, asked, item, start, stop: where a sounding item stays the same, as in a held chord, which is one row whatever its length."""
    n = F.size("items")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def goes_on(i: Column, j: Column) -> Column:
        return F.coalesce(F.get("sound", j) & (F.get("items", i) == F.get("items", j)), F.lit(False))

    starts = F.filter(places, lambda i: F.get("sound", i) & ~goes_on(i, i - 1))
    stops = F.filter(places, lambda i: F.get("sound", i) & ~goes_on(i, i + 1))
    rows = classes.select("class_id", "asked", "items", F.arrays_zip(starts.alias("start"), stops.alias("stop")).alias("runs"))
    return rows.select("class_id", "asked", "items", F.explode("runs").alias("r")).select("class_id", "asked", F.get("items", F.col("r.start")).alias("item"), "r.start", "r.stop")


def search(prints: DataFrame, *, every: int = 50, best: int | None = None) -> DataFrame:
    """prints: as classed() gives them, written. Result: query_class, rank, match_class, copies, offset, common, overlap,
    errors: the alignments of each class with a query, or its ``best`` ones, by error rate, overlap and id; copies: its rows."""
    is_query = F.pmod("id", F.lit(every)) == 0
    rows = prints.where("class_id is not null")
    classes = rows.groupBy("class_id").agg(F.min(F.struct("items", "sound")).alias("p"), F.count("*").alias("copies"), F.max(is_query).alias("asked"))
    classes = materialise(classes.select("class_id", "p.*", "copies", "asked"), prints.count(), DOCS_A_FILE)
    runs = _runs(classes)
    own = runs.where("asked").select(F.col("class_id").alias("query_class"), "item", F.col("start").alias("q_start"), F.col("stop").alias("q_stop"))
    hits = own.join(runs, "item").where(F.col("query_class") != F.col("class_id"))
    # Of two runs of an item, the offsets at which they lie on each other, and at how many positions.
    at = F.explode(F.sequence(F.col("q_start") - F.col("stop"), F.col("q_stop") - F.col("start")))
    hits = hits.select("*", at.alias("offset"))
    meet = F.least(F.col("q_stop"), F.col("stop") + F.col("offset")) - F.greatest(F.col("q_start"), F.col("start") + F.col("offset")) + 1
    offsets = hits.groupBy("query_class", "class_id", "offset").agg(F.sum(meet).cast("bigint").alias("common")).where(F.col("common") >= LEAST_COMMON)
    most = F.max("common").over(Window.partitionBy("query_class", "class_id"))
    offsets = offsets.withColumn("most", most).where("common = most").drop("most")
    queries = classes.select(F.col("class_id").alias("query_class"), F.col("items").alias("a"))
    pairs = offsets.join(classes.select("class_id", F.col("items").alias("b"), "copies"), "class_id").join(queries, "query_class")
    start, stop = F.greatest(F.lit(0), "offset"), F.least(F.size("a"), F.col("offset") + F.size("b"))
    overlap = F.greatest(stop - start, F.lit(0))
    apart = F.zip_with(F.slice("a", start + 1, F.col("overlap")), F.slice("b", start - F.col("offset") + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    pairs = pairs.withColumn("overlap", overlap).withColumn("errors", F.aggregate(apart, F.lit(0), lambda n, x: n + x).cast("bigint"))
    rate = F.col("errors") / F.greatest(F.col("overlap"), F.lit(1))
    pairs = pairs.groupBy("query_class", F.col("class_id").alias("match_class"), "copies").agg(F.min(F.struct(rate.alias("rate"), F.abs("offset").alias("far"), "offset", "common", "overlap", "errors")).alias("x")).select("query_class", "match_class", "copies", "x.offset", "x.common", "x.overlap", "x.errors")
    # A class with several rows also matches itself.
    sounding = F.size(F.filter("sound", lambda x: x)).cast("bigint")
    itself = classes.where("asked and copies > 1").select(F.col("class_id").alias("query_class"), F.col("class_id").alias("match_class"), (F.col("copies") - 1).alias("copies"), F.lit(0).alias("offset"), sounding.alias("common"), F.size("items").alias("overlap"), F.lit(0).cast("bigint").alias("errors"))
    found = pairs.unionByName(itself.where(F.col("common") >= LEAST_COMMON))
    found = found.where((F.col("overlap") >= LEAST_OVERLAP) & (F.col("errors") <= MOST_ERRORS * 32 * F.col("overlap")))
    by = Window.partitionBy("query_class").orderBy(F.col("errors") / F.col("overlap"), F.desc("overlap"), "match_class")
    ranked = found.withColumn("rank", F.row_number().over(by))
    return ranked if best is None else ranked.where(F.col("rank") <= best)


def identify(rows: DataFrame, audio_of: Callable, *, key: str, column: str, every: int = 50, best: int | None = None) -> DataFrame:
    """key, n_items, items_sha256, class_id and, of queries, a row for each alignment: rank, match_class, copies (of the match, without
    the query itself), offset, common, overlap, bit_error_rate; null for other rows and where there is none."""
    n = rows.count()
    made = materialise(fingerprints(rows, audio_of, key=key, column=column), n, DOCS_A_FILE)
    made = materialise(classed(made), n, DOCS_A_FILE)
    rate = F.round(F.col("errors") / (F.col("overlap") * 32), 6)
    found = search(made, every=every, best=best).select(F.col("query_class").alias("class_id"), "rank", "match_class", "copies", "offset", "common", "overlap", rate.alias("bit_error_rate"))
    out = made.select("id", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"), "class_id")
    is_query = F.col("class_id").isNotNull() & (F.pmod("id", F.lit(every)) == 0)
    asked = out.where(is_query).join(found, "class_id", "left")
    rest = out.where(~is_query)
    return asked.unionByName(rest, allowMissingColumns=True).withColumnRenamed("id", key)


#: A tune of a vector: notes of so many samples, one for each two numbers.
NOTE = 1654


def tune(vector: list[float] | None) -> bytes | None:
    """A recording made of a vector: each two numbers are a note of two tones, whose pitches and loudness they set."""
    if not vector or any(v is None or not math.isfinite(v) for v in vector):
        return None
    v = np.array(vector, np.float64)
    scale = np.abs(v).max() or 1.0
    v = np.resize(v / scale, (len(v) + 1) // 2 * 2).reshape(-1, 2)
    pitch = np.round(v * 12)
    hz = 440.0 * 2 ** (pitch / 12)
    t = np.arange(NOTE) / RATE
    low, high = (np.sin(2 * np.pi * hz[:, i, None] * t) for i in (0, 1))
    return encode((0.5 * low + 0.35 * high).ravel())


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each row of ``embeddings`` is played as a tune and read as a WAVE file."""
    return identify(table(spark, sf_dir, "embeddings"), tune, key="vec_id", column="embedding")
