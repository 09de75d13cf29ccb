"""Quality rules by counts and by divergence from a language's reference. DataFrame functions only.

Counts are taken in each row: words, lines that repeat an earlier line, words in three-word windows that repeat. Windows
are compared by a 64-bit hash, sorted within the row, so a text of n words costs n log n.

References are learnt from all documents of a language: the shares of seven classes of characters, and the shares of its
COMMON commonest words, with one more cell for all other words. A document's own histograms are compared with them by the
Jensen-Shannon distance (base 2: 0 to 1). Short texts scatter, so a guard leaves out a comparison if the document
has fewer characters or words than it needs, or the language too few words to be a reference. Only references, a few
numbers and short words a language, are sent to the documents, which are never shuffled.

Nulls: a null text has no words and fails; a null language is a language of its own. Repeated rows are judged alike. Ties
among the commonest words go by code point. A very long text is one row and is counted whole. measure() leaves out other columns
and keep() keeps them, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm._base import SPACES, materialise, table

MIN_WORDS, MOST_REPEATED = 50, 50
#: Classes of characters; what is in none of them, as a letter beyond ASCII, is the last class.
BLANK, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
CLASSES = ("a-z", BLANK, "A-Z", r".,;:!?'\"()\-", "0-9", SYMBOLS)
#: Words of a reference, and what is taken out of words before they are compared.
COMMON, MARKS = 20, r"[.,;:!?\x22\x27()]+"
#: A document is not kept if a distance is over the first number and the second over the root of its characters or words,
#: by which short texts scatter. Characters, words and reference words that a comparison needs.
FAR_CLASSES, FAR_WORDS = (0.18, 2.0), (0.25, 1.2)
MIN_CHARS, MIN_TOKENS, MIN_REFERENCE = 200, 50, 2_000
#: Repeated windows up to which they are looked for one by one.
FEW = 32
#: References, and characters of their names and words, up to which they are sent to every executor.
BROADCAST_LANGUAGES, BROADCAST_CHARS = 10_000, 4_000_000


def _spaced(text: Column) -> Column:
    """The words with one space between."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " "), F.lit(" "))


def _core(words: Column) -> Column:
    """A word, or spaced words, without marks."""
    return F.regexp_replace(words, MARKS, "")


def _classed(rows: DataFrame) -> DataFrame:
    """Adds classes: the counts of the classes' characters, in their order. Each class is cut out of what the ones before left."""
    rows, left = rows.withColumn("left0", F.coalesce("text", F.lit(""))), []
    for i, c in enumerate(CLASSES):
        rows = rows.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", f"[{c}]+", ""))
        left.append(f"left{i + 1}")
    lengths = ["left0", *left]
    counts = [(F.length(x) - F.length(y)).cast("long") for x, y in zip(lengths, left, strict=False)]
    return rows.withColumn("classes", F.array(*counts, F.length(left[-1]).cast("long"))).drop(*lengths)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: int = COMMON) -> DataFrame:
    """of (language), ref_words, ref_classes (shares), common (words), ref_common (shares, one more than words): written, a row a language."""
    rows = docs.select(F.col(lang).cast("string").alias("of"), F.col(text).alias("text"))
    classes = _classed(rows).groupBy("of").agg(F.array(*(F.sum(F.col("classes")[i]) for i in range(len(CLASSES) + 1))).alias("classes"))
    # A task sends each word once, and words are made alike after that.
    counted = rows.select("of", F.explode(F.split(_spaced(F.col("text")), " ")).alias("word")).where("word <> ''").groupBy("of", "word").agg(F.count("*").alias("n"))
    counted = materialise(counted.groupBy("of", _core(F.col("word")).alias("word")).agg(F.sum("n").alias("n")))
    best = Window.partitionBy("of").orderBy(F.col("n").desc(), F.col("word").cast("binary"))
    top = counted.where("word <> ''").withColumn("place", F.row_number().over(best)).where(F.col("place") <= common)
    top = top.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    words = counted.groupBy(F.col("of").alias("w_of")).agg(F.sum("n").alias("ref_words"))
    found = classes.join(words, F.col("of").eqNullSafe(F.col("w_of")), "left").join(top.withColumnRenamed("of", "t_of"), F.col("of").eqNullSafe(F.col("t_of")), "left")
    n = F.coalesce("ref_words", F.lit(0).cast("long"))
    hits = F.coalesce(F.transform("top", lambda t: t["n"]), F.array().cast("array<bigint>"))
    return materialise(
        found.select(
            "of",
            n.alias("ref_words"),
            _shares(F.col("classes"), _total(F.col("classes"))).alias("ref_classes"),
            F.coalesce(F.transform("top", lambda t: t["word"]), F.array().cast("array<string>")).alias("common"),
            _shares(F.concat(hits, F.array(n - _total(hits))), n).alias("ref_common"),
        )
    )


def _judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows: key, text, lang, with any others; adds the counts, class_distance, word_distance (null where a guard leaves them out), base_failed and kept."""
    n, chars = refs.agg(F.count("*"), F.coalesce(F.sum(F.length("of") + F.length(F.array_join("common", ""))), F.lit(0))).first()
    refs = F.broadcast(refs) if n <= BROADCAST_LANGUAGES and chars <= BROADCAST_CHARS else refs
    rows = rows.join(refs, F.col("lang").cast("string").eqNullSafe(F.col("of")), "left")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = _classed(rows).withColumns({"spaced": _spaced(F.col("text")), "lines": lines})
    # Two spaces between words, so that each can be looked for with its own.
    # What is longer than all common words goes first, so that less is searched for each of them.
    cores = _core(F.concat(F.lit(" "), F.replace("spaced", F.lit(" "), F.lit("  ")), F.lit(" ")))
    longer = F.concat(F.lit(" [^ ]{"), (F.array_max(F.transform("common", lambda w: F.length(w))) + 1).cast("string"), F.lit(",} "))
    rows = rows.withColumns({"words": F.array_remove(F.split("spaced", " "), ""), "cores": F.regexp_replace(cores, longer, F.lit(""))})
    last = F.size("words") - 2
    shifted = F.when(last > 0, F.arrays_zip(*(F.slice("words", i + 1, last).alias(f"w{i}") for i in range(3)))).otherwise(F.array())
    rows = rows.withColumns({"windows": F.transform(shifted, lambda w: F.xxhash64(w)), "n_words": F.size("words").cast("long")})
    rows = rows.withColumn("ordered", F.sort_array("windows"))
    beside = F.filter(F.arrays_zip(F.col("ordered").alias("x"), F.slice("ordered", 2, F.greatest(F.size("ordered"), F.lit(1))).alias("y")), lambda z: z["x"] == z["y"])
    rows = rows.withColumn("twice", F.array_distinct(F.transform(beside, lambda z: z["x"])))
    placed = F.arrays_zip(F.col("windows").alias("h"), F.sequence(F.lit(0), F.size("windows") - 1).alias("i"))
    rows = rows.withColumn("placed", F.when(F.size("twice") == 0, None).when(F.size("twice") <= FEW, F.filter(placed, lambda z: F.array_contains("twice", z["h"]))).otherwise(F.sort_array(placed)))
    # Of many repeated windows, those beside one of the same hash; lists of places are short or made by sorting, never quadratic.
    pairs = F.filter(F.arrays_zip(F.col("placed").alias("x"), F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))).alias("y")), lambda z: z["x"]["h"] == z["y"]["h"])
    many = F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z["x"]["i"], z["y"]["i"]))))

    def count(word: Column) -> Column:
        own = F.concat(F.lit(" "), word, F.lit(" "))
        return ((F.octet_length("cores") - F.octet_length(F.replace("cores", own, F.lit("")))) / F.octet_length(own)).cast("long")

    starts = F.when(F.size("twice") <= FEW, F.transform("placed", lambda z: z["i"])).otherwise(F.sort_array(many))
    rows = rows.withColumns({"starts": F.coalesce(starts, F.array().cast("array<int>")), "counts": F.transform("common", count)})
    # Windows that overlap share words; each adds what lies before the next one.
    steps = F.transform("starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - s, F.lit(3))))
    rows = rows.withColumns(
        {
            "chars": _total(F.col("classes")),
            "word_chars": _total(F.col("classes")) - F.col("classes")[CLASSES.index(BLANK)],
            "n_symbols": F.col("classes")[CLASSES.index(SYMBOLS)],
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x),
        }
    )
    whole = F.concat(F.col("counts"), F.array(F.col("n_words") - _total(F.col("counts"))))
    known = F.col("ref_words") >= MIN_REFERENCE
    rows = rows.withColumns(
        {
            "class_distance": F.when(known & (F.col("chars") >= MIN_CHARS), distance(_shares(F.col("classes"), F.col("chars")), F.col("ref_classes"))),
            "word_distance": F.when(known & (F.col("n_words") >= MIN_TOKENS), distance(_shares(whole, F.col("n_words")), F.col("ref_common"))),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        }
    )
    far = [F.col(d) > base + scatter / F.sqrt(n) for d, (base, scatter), n in (("class_distance", FAR_CLASSES, F.col("chars")), ("word_distance", FAR_WORDS, F.col("n_words")))]
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far[0], F.lit(False)) & ~F.coalesce(far[1], F.lit(False)))


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept.

    refs: of references(), if they are learnt from another table.
    """
    refs = references(docs, text=text, lang=lang) if refs is None else refs
    found = _judged(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), refs)
    return found.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def keep(docs: DataFrame, *, text: str = "text", lang: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """The documents that the rules keep; columns as they were."""
    refs = references(docs, text=text, lang=lang) if refs is None else refs
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return _judged(rows, refs).where("kept").select("row.*")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql_distance(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"sqrt(greatest(sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2, 0))"


_CLASS_COLUMNS = ", ".join("length(regexp_replace(coalesce(text, ''), '[^" + c.replace("'", "''").replace(r"\"", '"') + f"]+', '', 'g')) AS c{i}" for i, c in enumerate(CLASSES))

OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, {_CLASS_COLUMNS} FROM documents
), split AS (
  SELECT r, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs
), words AS (
  SELECT r, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split
), cores AS (
  SELECT r, lang, i, w, regexp_replace(w, '{MARKS}', '', 'g') AS core FROM words
), windows AS (
  SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), found AS (
  SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM windows
), covered AS (
  SELECT r, twice OR lag(twice, 1, false) OVER o OR lag(twice, 2, false) OVER o AS hit FROM found WINDOW o AS (PARTITION BY r ORDER BY i)
), repeats AS (
  SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY r
), sizes AS (
  SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM words GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs
), copies AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), classes AS (
  SELECT r, lang, unnest([c0, c1, c2, c3, c4, c5, length(text) - c0 - c1 - c2 - c3 - c4 - c5]) AS n, unnest(range(7)) AS class FROM docs
), class_refs AS (
  SELECT lang, class, sum(n)::DOUBLE / nullif(sum(sum(n)) OVER (PARTITION BY lang), 0) AS q FROM classes GROUP BY lang, class
), class_shares AS (
  SELECT *, n::DOUBLE / nullif(sum(n) OVER (PARTITION BY r), 0) AS p, sum(n) OVER (PARTITION BY r) AS chars FROM classes
), class_distances AS (
  SELECT r, min(chars) AS chars, {_sql_distance("p", "q")} AS d FROM class_shares s JOIN class_refs f ON s.lang IS NOT DISTINCT FROM f.lang AND s.class = f.class GROUP BY r
), counted AS (
  SELECT lang, core, count(*) AS n FROM cores GROUP BY lang, core
), totals AS (
  SELECT lang, sum(n) AS ref_words FROM counted GROUP BY lang
), common AS (
  SELECT lang, core, n FROM counted WHERE core <> '' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, core) <= {COMMON}
), common_refs AS (
  SELECT c.lang, core, n::DOUBLE / ref_words AS q FROM common c JOIN totals t ON c.lang IS NOT DISTINCT FROM t.lang
), hits AS (
  SELECT r, c.core, count(*) AS n FROM cores c JOIN common m ON c.lang IS NOT DISTINCT FROM m.lang AND c.core = m.core GROUP BY r, c.core
), cells AS (
  SELECT d.r, n_words, coalesce(h.n, 0)::DOUBLE / n_words AS p, q
  FROM docs d JOIN sizes z ON d.r = z.r JOIN common_refs f ON d.lang IS NOT DISTINCT FROM f.lang LEFT JOIN hits h ON h.r = d.r AND h.core = f.core
), all_cells AS (
  SELECT r, p, q FROM cells UNION ALL SELECT r, greatest(1 - sum(p), 0), greatest(1 - sum(q), 0) FROM cells GROUP BY r
), word_distances AS (
  SELECT r, {_sql_distance("p", "q")} AS d FROM all_cells GROUP BY r
), judged AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(ref_words, 0) >= {MIN_REFERENCE} AS known, chars, cd.d AS class_d, wd.d AS word_d
  FROM docs d LEFT JOIN sizes USING (r) LEFT JOIN copies USING (r) LEFT JOIN repeats USING (r) LEFT JOIN class_distances cd USING (r) LEFT JOIN word_distances wd USING (r)
  LEFT JOIN totals t ON d.lang IS NOT DISTINCT FROM t.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND NOT (known AND chars >= {MIN_CHARS} AND class_d > {FAR_CLASSES[0]} + {FAR_CLASSES[1]} / sqrt(chars)) AND NOT (known AND n_words >= {MIN_TOKENS} AND word_d > {FAR_WORDS[0]} + {FAR_WORDS[1]} / sqrt(n_words)) AS kept
FROM judged
"""
