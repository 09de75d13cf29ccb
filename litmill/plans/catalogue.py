"""Queries over the test tables, with the SQL that they must agree with.

Each exercises operators of the package on whole tables; the names of their columns are those of the SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.operators import agreement, coding, dedupe, enrich, frequency, fulltext, groups, landscape, sampling, semantic, tsne
from litmill.operators import relations as R
from litmill.operators import vocabulary as V
from litmill.operators.rules import Rule, RuleSet, has, rule_table
from litmill.operators.settled import settled
from litmill.sources import files, services

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bibliographic records."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id", F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("abstract"), (F.lit(1990) + F.col("doc_id") % 37).cast("int").alias("year"), F.col("source").alias("database"), "lang",
    )


#: The same view in SQL.
RECORDS = """records AS (SELECT 'doc_' || doc_id AS record_id, doc_id, string_split(text, chr(10))[1] AS title, text AS abstract,
  CAST(1990 + doc_id % 37 AS INTEGER) AS year, source AS database, lang FROM documents)"""
TITLE = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
#: Rules on function words, which the texts have, in place of those on a field's terms.
OWN_SCREEN = RuleSet(
    (
        Rule("exclude", ~has("text", "the ", " la ", " der ", " le "), ("no known function word", "high")),
        Rule("exclude", has("text", "license", "licensed"), ("licence", "high")),
        Rule("exclude", has("text", "http", "www") & ~has("text", "example"), ("link", "medium")),
        Rule("unclear", has("text", "!!", "%%%", "###"), ("noise", "low")),
    ),
    ("include", "", "medium"),
    ("decision", "reason", "confidence"),
)
SCREEN_SQL = """CASE WHEN NOT (contains(t, 'the ') OR contains(t, ' la ') OR contains(t, ' der ') OR contains(t, ' le ')) THEN {0}
  WHEN contains(t, 'license') OR contains(t, 'licensed') THEN {1} WHEN (contains(t, 'http') OR contains(t, 'www')) AND NOT contains(t, 'example') THEN {2}
  WHEN contains(t, '!!') OR contains(t, '%%%') OR contains(t, '###') THEN {3} ELSE {4} END"""
BLOB = "lower(coalesce(title, '') || chr(10) || coalesce(abstract, ''))"


def screened(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return r.select("record_id", OWN_SCREEN.first({"text": T.blob(F.col("title"), F.col("abstract"))}).alias("d")).select("record_id", "d.*")


SCREENED = f"""screened AS (SELECT record_id,
  {SCREEN_SQL.format("'exclude'", "'exclude'", "'exclude'", "'unclear'", "'include'")} AS decision,
  {SCREEN_SQL.format("'no known function word'", "'licence'", "'link'", "'noise'", "''")} AS reason,
  {SCREEN_SQL.format("'high'", "'high'", "'medium'", "'low'", "'medium'")} AS confidence
  FROM (SELECT record_id, {BLOB} AS t FROM records))"""


@query(f"WITH {RECORDS}, {SCREENED}, k AS (SELECT record_id, row_number() OVER (PARTITION BY {TITLE} || '::' || year ORDER BY database, doc_id) AS n FROM records) "
       "SELECT decision, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM screened JOIN k USING (record_id) WHERE n = 1 GROUP BY decision")  # fmt: skip
def flagship(spark, sf):
    r = dedupe.deduplicate(records(spark, sf).withColumn("doi", F.lit(None).cast("string")), F.col("doc_id"))
    kept = r.select("record_id", OWN_SCREEN.first({"text": T.blob(F.col("title"), F.col("abstract"))})["decision"].alias("decision"))
    return frequency.frequencies(kept, "decision")


@query(f"WITH {RECORDS} SELECT record_id, {TITLE} || '::' || year AS dedupe_key, row_number() OVER (PARTITION BY {TITLE} || '::' || year ORDER BY database, doc_id) AS duplicate_rank FROM records")
def dedupe_rank(spark, sf):
    return dedupe.rank_duplicates(records(spark, sf), F.col("doc_id")).select("record_id", "dedupe_key", F.col("duplicate_rank").cast("bigint").alias("duplicate_rank"))


@query(f"WITH {RECORDS}, k AS (SELECT row_number() OVER (PARTITION BY {TITLE} || '::' || year ORDER BY database, doc_id) AS n FROM records) "
       "SELECT count(*) AS combined_records, count(*) FILTER (n = 1) AS deduplicated_records, count(*) FILTER (n > 1) AS duplicates_removed FROM k")  # fmt: skip
def dedupe_summary(spark, sf):
    return dedupe.audit(dedupe.rank_duplicates(records(spark, sf), F.col("doc_id")))


@query("SELECT page_id, replace(replace(lower(trim(coalesce('https://doi.org/' || url, ''))), 'https://doi.org/', ''), 'http://doi.org/', '') AS norm_doi FROM pages")
def normal_doi(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normal_doi(F.concat(F.lit("https://doi.org/"), F.col("url"))).alias("norm_doi"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unnamed') AS slug FROM pages")
def slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    return R.latest(table(spark, sf, "events"), ("user_id", "event_type"), F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id", "value")


@query("WITH e AS (SELECT *, CAST(event_id % 2 AS INTEGER) AS fresh FROM events) SELECT user_id, event_type, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, event_id DESC) = 1")
def upsert_keep_last(spark, sf):
    e = table(spark, sf, "events")
    return R.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ("user_id", "event_type"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.stack([c, table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))])


@query(f"WITH {RECORDS}, {SCREENED} SELECT * FROM screened")
def screen_first_match(spark, sf):
    return screened(spark, sf)


@query(f"WITH {RECORDS}, {SCREENED} SELECT decision, reason, count(*) AS n FROM screened GROUP BY decision, reason")
def screen_summary(spark, sf):
    return frequency.group_sizes(screened(spark, sf), "decision", "reason")


def _or(terms, c="t"):
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _case(rules: dict, default: str, c="t") -> str:
    return "CASE " + " ".join(f"WHEN {_or(terms, c)} THEN '{label}'" for label, terms in rules.items()) + f" ELSE '{default}' END"


_PAIN = _case(V.PAIN_CATEGORIES | {"mixed or unspecified chronic pain": V.UNSPECIFIED_PAIN}, "unclear")
_DATE = "make_date(1950 + CAST(p_size AS INTEGER) * 2, 1, 1)"
#: Sentences made of a part's words and numbers, so that every rule of the bundled sets meets texts that it holds for.
PHRASES = (
    "A biopsychosocial model of chronic low back pain: a systematic review", "Bio-psycho-social treatment of neuropathic pain in adults, a scoping review",
    "Rats and mice with persistent pain", "Children with headache: biopsychosocial review protocol", "Acute pain after surgery, a biopsychosocial review",
    "Biopsychosocial coping, stress and depression in fibromyalgia: a network meta-analysis", "Editorial: biopsychosocial chronic pain", "Biopsychosocial care in chronic pain, family and work: an integrative review",
    "Risk of bias of biopsychosocial chronic pain reviews", "Biopsychosocial chronic pain cohort",
)


def studies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as records whose titles are made of the phrases."""
    p = table(spark, sf, "part")
    title = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("record_id"), title.alias("title"), F.concat_ws(". ", "p_name", "p_type").alias("abstract"), (F.lit(1950) + F.col("p_size") * 2).cast("int").alias("year"),
                    F.lit("").alias("publication_date"), F.when(F.col("p_partkey") % 7 == 0, "fre").otherwise("eng").alias("language"), F.when(F.col("p_partkey") % 5 == 0, "Letter").otherwise("Journal Article").alias("publication_types"))


_TITLES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
STUDIES = f"""studies AS (SELECT *, lower(title || chr(10) || abstract) AS t FROM (SELECT p_partkey AS record_id, ({_TITLES})[p_partkey % {len(PHRASES)} + 1] AS title, concat_ws('. ', p_name, p_type) AS abstract,
  {_DATE} AS day, CASE WHEN p_partkey % 7 = 0 THEN 'fre' ELSE 'eng' END AS language, CASE WHEN p_partkey % 5 = 0 THEN 'letter' ELSE 'journal article' END AS types FROM part))"""
_BPS = _or(V.BPS_TERMS)
_STEPS = [
    (f"NOT {_BPS}", "exclude", "no biopsychosocial term in title/abstract", "high"), ("day > DATE '2026-03-31' OR day < DATE '1977-01-01'", "exclude", "outside operational search window", "high"),
    ("contains(t, 'protocol') OR contains(types, 'protocol')", "exclude", "protocol", "high"), (f"{_or(V.COMMENTARY_TERMS, 'types')} OR {_or(V.COMMENTARY_TERMS)}", "exclude", "commentary/editorial/letter", "medium"),
    (f"{_or(V.ANIMAL_TERMS)} AND NOT contains(t, 'human')", "exclude", "animal/non-human focus", "medium"), (f"{_or(V.PEDIATRIC_TERMS)} AND NOT {_or(V.ADULT_TERMS)}", "exclude", "pediatric-only focus", "medium"),
    (f"contains(t, 'acute pain') AND NOT {_or(V.UNSPECIFIED_PAIN)}", "exclude", "acute pain focus", "medium"), (f"NOT {_or(V.CHRONIC_PAIN_TERMS)}", "exclude", "chronic pain focus unclear", "medium"),
    ("language <> '' AND NOT contains(language, 'eng')", "exclude", "non-English record", "medium"), (f"NOT (contains(types, 'review') OR {_or(('review', 'meta-analysis', 'scoping'))})", "unclear", "review status unclear", "low"),
]


def _steps(i: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {s[0]} THEN '{s[i]}'" for s in _STEPS) + f" ELSE '{last}' END"


@query(f"WITH {STUDIES} SELECT record_id, {_steps(1, 'include')} AS stage1_decision, {_steps(2, '')} AS stage1_reason, {_steps(3, 'medium')} AS stage1_confidence FROM studies")
def stage1_rules(spark, sf):
    return coding.screen(studies(spark, sf)).select("record_id", "stage1_decision", "stage1_reason", "stage1_confidence")


@query(f"""WITH {STUDIES} SELECT record_id, {_PAIN} AS icd11_pain_category, {_case(V.OBJECTIVES, 'mixed')} AS objective_category, {_case(V.FUNCTIONS, 'unclear')} AS bps_function,
  CASE WHEN {_or(V.BIO_TERMS)} THEN 'yes' ELSE 'no' END AS bio_mentioned, CASE WHEN {_or(V.PSYCH_TERMS)} THEN 'yes' ELSE 'no' END AS psych_mentioned,
  CASE WHEN {_or(V.SOCIAL_TERMS)} THEN 'yes' ELSE 'no' END AS social_mentioned, CASE WHEN {_or(V.QUALITY_TERMS)} THEN 'yes' ELSE 'no' END AS quality_assessment_reported,
  CASE {_PAIN} WHEN 'chronic secondary musculoskeletal pain' THEN 'yes' WHEN 'mixed or unspecified chronic pain' THEN 'unclear' ELSE 'no' END AS musculoskeletal_flag FROM studies""")
def stage2_rules(spark, sf):
    c = coding.code_by_rules(studies(spark, sf))
    return c.select("record_id", "icd11_pain_category", "objective_category", "bps_function", "bio_mentioned", "psych_mentioned", "social_mentioned", "quality_assessment_reported", "musculoskeletal_flag")


_TYPES = "CASE " + " ".join("WHEN regexp_matches(t || ' ' || types, '" + "|".join(p) + f"') THEN '{label}'" for label, p in V.REVIEW_TYPES.items()) + " ELSE 'other evidence synthesis' END"


@query(f"WITH {STUDIES} SELECT record_id, {_TYPES} AS review_type, {_case(V.COLLAPSED_TYPES, 'other synthesis', _TYPES)} AS collapsed FROM studies")
def review_type_cascade(spark, sf):
    return coding.code_by_rules(studies(spark, sf)).select("record_id", "review_type", coding.collapse_review_type(F.col("review_type")).alias("collapsed"))


@query(f"WITH {STUDIES} SELECT concept AS psychological_concept, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM (SELECT unnest(list_filter([{', '.join(f'CASE WHEN {_or(t)} THEN {k!r} END' for k, t in V.CONCEPTS.items())}], lambda x: x IS NOT NULL)) AS concept FROM studies) GROUP BY concept")
def multilabel_concepts(spark, sf):
    return frequency.label_counts(coding.code_by_rules(studies(spark, sf)), F.col("psychological_concepts_detected"), name="psychological_concept")


_SAID = f"lower(trim(regexp_replace(regexp_replace(title || ' ' || abstract, '{V.LEXICAL_ONLY}', ' ', 'gi'), '\\s+', ' ', 'g')))"


@query(f"WITH {STUDIES}, s AS (SELECT record_id, {_SAID} AS s FROM studies) SELECT record_id, " + ", ".join(f"CASE WHEN regexp_matches(s, '{'|'.join(p)}') THEN 'yes' ELSE 'no' END AS {d}_mentioned" for d, p in V.SUBSTANTIVE.items()) + " FROM s")
def regex_domain_recode(spark, sf):
    return coding.recode_domains(coding.code_by_rules(studies(spark, sf))).select("record_id", *(f"{d}_mentioned" for d in V.SUBSTANTIVE))


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'no' END b, CASE WHEN p_partkey % 3 < 2 THEN 'yes' ELSE 'no' END p, CASE WHEN p_partkey % 5 < 4 THEN 'yes' ELSE 'no' END s,
  ['explanatory framework', 'rhetorical label', 'conclusion', 'justification'][p_partkey % 4 + 1] f FROM part)
  SELECT provisional_typology, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM (SELECT CASE WHEN b = 'yes' AND p = 'yes' AND s = 'yes' AND f IN ('explanatory framework', 'organizing principle') THEN 'potential integrative signal'
  WHEN b = 'yes' AND p = 'yes' AND s = 'yes' THEN 'multifactorial signal' WHEN f LIKE '%rhetorical%' OR f IN ('background framing', 'conclusion') THEN 'rhetorical label signal' ELSE 'pseudo-bps or partial signal' END AS provisional_typology FROM c) GROUP BY 1""")
def typology_counts(spark, sf):
    k = F.col("p_partkey")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    f = F.element_at(F.array(*map(F.lit, ("explanatory framework", "rhetorical label", "conclusion", "justification"))), (k % 4 + 1).cast("int"))
    made = table(spark, sf, "part").select(coding.typology(yes(k % 2 == 0), yes(k % 3 < 2), yes(k % 5 < 4), f).alias("provisional_typology"))
    return frequency.frequencies(made, "provisional_typology")


@query("SELECT doc_id, coalesce(regexp_extract(trim(text), '(?s)^(.*?[.!?])(\\s|$)', 1), '') AS sentence FROM documents WHERE regexp_matches(trim(text), '[.!?](\\s|$)')")
def first_sentence(spark, sf):
    t = T.strip(T.blank(F.col("text")))
    return table(spark, sf, "documents").where(t.rlike(r"[.!?](\s|$)")).select("doc_id", T.sentences(t)[0].alias("sentence"))


@query(f"WITH {RECORDS} SELECT record_id, CASE WHEN length(title) <= 26 THEN title ELSE rtrim(substr(title, 1, 23)) || '...' END AS label FROM (SELECT record_id, trim(title) AS title FROM records)")
def shorten_label(spark, sf):
    return records(spark, sf).select("record_id", T.shorten(F.col("title"), 26).alias("label"))


@query("SELECT doc_id, CAST(n AS INTEGER) AS words, CASE WHEN n < 250 THEN 'low_content' ELSE 'ok' END AS status FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def word_count_low_content(spark, sf):
    n = T.word_count(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.alias("words"), F.when(n < 250, "low_content").otherwise("ok").alias("status"))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%b-%d') WHEN 3 THEN '2021-02-30' ELSE '' END AS s, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') || '.0' WHEN 1 THEN '' ELSE 'n.d.' END AS y, o_orderdate AS d FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(d AS DATE) WHEN o_orderkey % 5 = 1 THEN CAST(date_trunc('month', d) AS DATE) WHEN o_orderkey % 5 = 3 THEN DATE '2021-02-01'
  WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 5 = 2) THEN CAST(date_trunc('year', d) AS DATE) END AS day FROM o""")
def date_cascade(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    stated = F.when(k % 5 == 0, F.date_format(d, "yyyy/MM/dd")).when(k % 5 == 1, F.date_format(d, "yyyy-MM")).when(k % 5 == 2, F.date_format(d, "yyyy-MMM-dd")).when(k % 5 == 3, "2021-02-30").otherwise("")
    year = F.when(k % 3 == 0, F.concat(F.date_format(d, "yyyy"), F.lit(".0"))).when(k % 3 == 1, "").otherwise("n.d.")
    return table(spark, sf, "orders").select("o_orderkey", T.record_date(stated, year).alias("day"))


@query("SELECT event_type, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY event_type")
def freq_percent(spark, sf):
    return frequency.frequencies(table(spark, sf, "events"), "event_type")


@query("SELECT l_returnflag, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 1) AS percent FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")
def percent_external_denominator(spark, sf):
    li = table(spark, sf, "lineitem")
    counts = li.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n"), F.count("*").alias("_all"))
    return counts.where("n > 0").select("l_returnflag", "n", frequency.share(F.col("n"), F.sum("_all").over(Window.partitionBy())).alias("percent"))


@query("""WITH a AS (SELECT count(*) t, count(*) FILTER (l_returnflag = 'R') r, count(*) FILTER (l_discount >= 0.05) d, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.05 AND l_quantity > 25) b FROM lineitem)
  SELECT 'returned' AS indicator, r AS n, round_even(r * 100.0 / t, 1) AS percent FROM a UNION ALL SELECT 'discounted', d, round_even(d * 100.0 / t, 1) FROM a UNION ALL SELECT 'all three', b, round_even(b * 100.0 / t, 1) FROM a""")
def conditional_counts_tall(spark, sf):
    r, d = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05
    return frequency.conditional_counts(table(spark, sf, "lineitem"), {"returned": r, "discounted": d, "all three": r & d & (F.col("l_quantity") > 25)})


_EVENTS = ("click", "login", "logout", "purchase", "view")


@query("SELECT CAST(user_id % 10 AS BIGINT) AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS \"{e}\"" for e in _EVENTS) + " FROM events GROUP BY 1")
def crosstab(spark, sf):
    e = table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 10)
    return frequency.crosstab(e, "bucket", "event_type", _EVENTS)


@query("""WITH r AS (SELECT p_brand, count(*) n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8), c AS (SELECT p_size, count(*) n FROM part GROUP BY 1 ORDER BY n DESC, p_size LIMIT 8)
  SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM r) AND p_size IN (SELECT p_size FROM c) GROUP BY 1, 2""")
def crosstab_top8(spark, sf):
    wide = frequency.top_crosstab(table(spark, sf, "part"), "p_brand", "p_size")
    sizes = [c for c in wide.columns if c != "p_brand"]
    cells = F.array(*(F.struct(F.lit(int(c)).alias("p_size"), F.col(f"`{c}`").alias("n")) for c in sizes))
    return wide.select("p_brand", F.explode(cells).alias("x")).select("p_brand", "x.*").where("n > 0")


@query(f"WITH {RECORDS} SELECT period, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM (SELECT (year // 10 * 10) || 's' AS period FROM records) GROUP BY period")
def decade_buckets(spark, sf):
    return frequency.frequencies(records(spark, sf).select(T.decade(F.col("year")).alias("period")), "period")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 6) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(round(p * 100)):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem GROUP BY 1")
def quantile_summary(spark, sf):
    s = frequency.summary(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return s.withColumns({"total": F.round("total", 2), **{c: F.round(c, 6) for c in ("mean", "p05", "p25", "p50", "p75", "p95")}})


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling FROM m")
def rolling_mean_centered(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return frequency.rolling_mean(m, "month", "n").withColumn("rolling", F.round("rolling", 6))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate) DESC NULLS FIRST, o_orderkey) AS catalog_id FROM orders")
def catalog_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return frequency.numbered(o, "catalog_id", F.desc_nulls_first("year"), F.asc("o_orderkey")).select("o_orderkey", "catalog_id")


@query("""WITH m AS (SELECT r_regionkey AS ord, r_name AS region, count(c_custkey) AS mass FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
  s AS (SELECT *, mass / sum(mass) OVER () AS share FROM m) SELECT region, CAST(mass AS BIGINT) AS mass, round(share, 9) AS share, round(90 + (sum(share) OVER (ORDER BY ord) - share) * 360, 6) AS start_angle, round(90 + sum(share) OVER (ORDER BY ord) * 360, 6) AS end_angle FROM s""")
def sunburst_cumulative(spark, sf):
    order = table(spark, sf, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("region"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = frequency.mass_by(c.select(F.col("r_name").alias("region"), F.lit(1).alias("one")), "region", "one", order)
    s = frequency.sweep(m, "ord", "share")
    return s.select("region", F.col("mass").cast("bigint").alias("mass"), F.round("share", 9).alias("share"), F.round("start_angle", 6).alias("start_angle"), F.round("end_angle", 6).alias("end_angle"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_global(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER w AS rank FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) QUALIFY row_number() OVER w <= 5")
def topk_per_group(spark, sf):
    t = frequency.top_per_group(table(spark, sf, "lineitem"), "l_returnflag", 5, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"))
    return t.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_enrich(spark, sf):
    return R.enrich(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id", defaults={"quality": -1, "toxic": -1})


@query("SELECT user_id AS c_custkey, last_type FROM (SELECT user_id, event_type AS last_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) JOIN customer ON user_id = c_custkey")
def lookup_last_wins(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("last_type"), "ts", "event_id")
    return R.enrich(table(spark, sf, "customer").select("c_custkey"), e, "c_custkey", last_by=[F.col("ts"), F.col("event_id")]).where("last_type is not null").select("c_custkey", "last_type")


@query("""WITH c AS (SELECT 'labels have documents' AS checkpoint, (SELECT count(*) FROM labels) AS value, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) AS expected
  UNION ALL SELECT 'documents have labels', (SELECT count(*) FROM documents), (SELECT count(*) FROM labels)) SELECT *, CASE WHEN value = expected THEN 'aligned' ELSE 'check' END AS status FROM c""")
def alignment_checks(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return R.alignment([("labels have documents", lab, R.present(lab, d, "doc_id")), ("documents have labels", d, lab)])


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def unmatched_keys(spark, sf):
    return R.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, 'cached' AS status FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cached_semi_anti(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return R.present(d, lab, "doc_id").withColumn("status", F.lit("cached")).unionByName(R.absent(d, lab, "doc_id").withColumn("status", F.lit("missing")))


_WORDS = {"en": (" the ", " and "), "fr": (" le ", " les "), "de": (" der ", " und "), "es": (" el ", " los "), "list": (" | ",), "noise": ("!!", "%%%")}


@query(f"WITH d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents), l AS (SELECT doc_id, unnest(list_filter([{', '.join(f'CASE WHEN {_or(w)} THEN {k!r} END' for k, w in _WORDS.items())}], lambda x: x IS NOT NULL)) AS c FROM d) SELECT a.c AS src, b.c AS dst, count(*) AS weight FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.c < b.c GROUP BY 1, 2")
def cooccurrence_edges(spark, sf):
    t = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    found = RuleSet(rule_table(_WORDS), ("",)).all({"text": t})
    return R.pairs(table(spark, sf, "documents").select("doc_id", found.alias("labels")), "doc_id", "labels")


@query("""WITH u AS (SELECT CAST(quality AS VARCHAR) a, CAST(toxic AS VARCHAR) b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT count(*) n, count(*) FILTER (a = b) m FROM u),
  e AS (SELECT sum(CAST(x.n AS DOUBLE) * y.n) c FROM (SELECT a l, count(*) n FROM u GROUP BY 1) x JOIN (SELECT b l, count(*) n FROM u GROUP BY 1) y ON x.l = y.l)
  SELECT 'ok' AS status, n, round_even(m / n, 4) AS percent_agreement, round_even((m / n - c / n / n) / (1 - c / n / n), 4) AS cohen_kappa FROM s, e""")
def agreement_kappa(spark, sf):
    return agreement.agreement(table(spark, sf, "labels"), "quality", "toxic")


@query("SELECT CAST(least(50, greatest(1, ceil(count(*) * 0.2))) AS BIGINT) AS n FROM documents")
def seeded_sample_size(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sampling.share_sample(d, 7, key="doc_id").agg(F.count("*").alias("n"))


@query()
def seeded_sample(spark, sf):
    return sampling.sample(table(spark, sf, "documents").select("doc_id", "source"), 10, 42, "doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INTEGER) AS links FROM pages")
def html_extract(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s"), F.lit(0))).alias("links"))


_TAGLESS = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&nbsp;", " "), ("&amp;", "&")):
    _TAGLESS = f"replace({_TAGLESS}, '{_name}', '{_sign}')"


@query(f"SELECT page_id, trim(regexp_replace({_TAGLESS}, '\\s+', ' ', 'g')) AS body FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("SELECT part_key, regexp_replace(name, '([&%$#_{}])', '\\\\\\1', 'g') AS latex FROM (SELECT p_partkey AS part_key, p_name || ' 5% & #' || p_size || '_{x}' AS name FROM part)")
def latex_escape(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), T.latex(F.concat(F.col("p_name"), F.lit(" 5% & #"), F.col("p_size").cast("string"), F.lit("_{x}"))).alias("latex"))


#: Anchors: the mean vector of each label.
_ANCHORS = """e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), p AS (SELECT label, unnest(v) x, unnest(range(len(v))) i FROM e),
  c AS (SELECT label, list(m ORDER BY i) AS a FROM (SELECT label, i, avg(x) m FROM p GROUP BY 1, 2) GROUP BY label), k AS (SELECT vec_id, c.label AS anchor, list_cosine_similarity(v, a) AS cosine FROM e, c)"""
_WIDE = f"{_ANCHORS}, w AS (SELECT vec_id, max(cosine) FILTER (anchor = 0) b, max(cosine) FILTER (anchor = 1) p, max(cosine) FILTER (anchor = 2) s FROM k WHERE anchor < 3 GROUP BY vec_id)"
_SOFT = f"{_WIDE}, f AS (SELECT *, exp(b - greatest(b, p, s)) eb, exp(p - greatest(b, p, s)) ep, exp(s - greatest(b, p, s)) es FROM w), l AS (SELECT vec_id, b, p, s, eb / (eb + ep + es) lb, ep / (eb + ep + es) lp, es / (eb + ep + es) ls FROM f)"
_THREE = ("biological", "psychological", "social")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("anchor_vector"))


def cosines(spark: SparkSession, sf: str) -> DataFrame:
    a = anchors(spark, sf).withColumnRenamed("label", "anchor")
    return semantic.anchor_cosines(table(spark, sf, "embeddings"), a, key="vec_id", vector="embedding")


def domain_cosines(spark: SparkSession, sf: str) -> DataFrame:
    named = cosines(spark, sf).where("anchor < 3").withColumn("domain", F.element_at(F.array(*map(F.lit, _THREE)), F.col("anchor") + 1))
    return semantic.wide(named, "vec_id", "domain", "cosine", _THREE, "cosine_")


def loadings(spark: SparkSession, sf: str, digits: int = 6) -> DataFrame:
    return semantic.domain_loadings(domain_cosines(spark, sf), digits=digits)


@query(f"WITH {_ANCHORS} SELECT vec_id, anchor, round(cosine, 6) AS cosine FROM k")
def dense_cosine_anchors(spark, sf):
    return cosines(spark, sf).select("vec_id", "anchor", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_SOFT} SELECT vec_id, round(lb, 6) AS loading_biological, round(lp, 6) AS loading_psychological, round(ls, 6) AS loading_social, CASE WHEN lb >= lp AND lb >= ls THEN 'biological' WHEN lp >= ls THEN 'psychological' ELSE 'social' END AS dominant_domain FROM l")
def softmax_loadings(spark, sf):
    return loadings(spark, sf).select("vec_id", *(f"loading_{d}" for d in _THREE), "dominant_domain")


@query(f"WITH {_SOFT}, d AS (SELECT *, CASE WHEN lb >= lp AND lb >= ls THEN 0 WHEN lp >= ls THEN 1 ELSE 2 END AS top FROM l) " + " UNION ALL ".join(f"SELECT '{d}' AS domain, round(avg({c}), 5) AS mean_cosine, round(avg(l{c}), 5) AS mean_loading, count(*) FILTER (top = {i}) AS dominance_n FROM d" for i, (d, c) in enumerate(zip(_THREE, "bps", strict=True))))
def domain_summary(spark, sf):
    s = semantic.domain_summary(loadings(spark, sf, 12), digits=12)
    return s.select("domain", F.round("mean_cosine", 5).alias("mean_cosine"), F.round("mean_loading", 5).alias("mean_loading"), "dominance_n")


@query(f"WITH {_SOFT}, d AS (SELECT vec_id, CASE WHEN lb >= lp AND lb >= ls THEN 'biological' WHEN lp >= ls THEN 'psychological' ELSE 'social' END AS top FROM l) SELECT CAST(vec_id % 7 AS BIGINT) AS bucket, " + ", ".join(f"count(*) FILTER (top = '{d}') AS {d}" for d in _THREE) + " FROM d GROUP BY 1")
def dominance_crosstab(spark, sf):
    return frequency.crosstab(loadings(spark, sf).withColumn("bucket", F.col("vec_id") % 7), "bucket", "dominant_domain", _THREE)


@query(f"WITH {_SOFT}, g AS (SELECT vec_id, anchor % 3 AS domain, anchor AS part, exp(cosine - max(cosine) OVER q) / sum(exp(cosine)) OVER q * exp(max(cosine) OVER q) AS share FROM k WINDOW q AS (PARTITION BY vec_id, anchor % 3)), t AS (SELECT g.*, CASE domain WHEN 0 THEN lb WHEN 1 THEN lp ELSE ls END AS parent FROM g JOIN l USING (vec_id)) SELECT domain, part, round(avg(share * parent), 5) AS mean_loading, round(median(share * parent), 5) AS median_loading FROM t GROUP BY 1, 2")
def subdomain_weighted(spark, sf):
    tall = cosines(spark, sf).select("vec_id", (F.col("anchor") % 3).alias("domain"), F.col("anchor").alias("part"), "cosine")
    parents = loadings(spark, sf, 12).select("vec_id", F.explode(F.array(*(F.struct(F.lit(i).alias("domain"), F.col(f"loading_{d}").alias("parent")) for i, d in enumerate(_THREE)))).alias("x")).select("vec_id", "x.*")
    return semantic.part_summary(semantic.part_loadings(tall, parents, key="vec_id"), digits=5)


@query(f"WITH {_SOFT} SELECT vec_id, round(lb * lp, 5) AS bio_psych, round(lb * ls, 5) AS bio_social, round(lp * ls, 5) AS psych_social, round(lb * lp * ls, 5) AS triadic_product FROM l")
def pairwise_products(spark, sf):
    p = semantic.pairwise(loadings(spark, sf, 12), digits=12)
    return p.select("vec_id", *(F.round(c, 5).alias(c) for c in ("bio_psych", "bio_social", "psych_social", "triadic_product")))


@query(f"WITH {_SOFT} SELECT round(avg(lb * lp), 5) AS bio_psych_mean, round(avg(lb * ls), 5) AS bio_social_mean, round(avg(lp * ls), 5) AS psych_social_mean, round(avg(lb * lp * ls), 5) AS triadic_product_mean FROM l")
def pairwise_summary(spark, sf):
    s = semantic.pairwise_summary(semantic.pairwise(loadings(spark, sf, 12), digits=12), digits=12)
    return s.select(*(F.round(c, 5).alias(c) for c in s.columns))


@query(f"WITH {_SOFT} " + " UNION ALL ".join(f"SELECT '{_THREE[i]}' AS \"row\", '{_THREE[j]}' AS \"column\", round(avg({'l' + 'bps'[i] if i == j else 'l' + 'bps'[i] + ' * l' + 'bps'[j]}), 5) AS value FROM l" for i in range(3) for j in range(3)))
def co_loading_matrix(spark, sf):
    return semantic.co_loading(semantic.pairwise(loadings(spark, sf, 12), digits=12)).withColumn("value", F.round("value", 5))


@query(f"WITH {_SOFT} SELECT vec_id, round(lp - lb, 5) AS dev_x, round(ls - 1.0 / 3, 5) AS dev_y, greatest(abs(lb - 1.0 / 3), abs(lp - 1.0 / 3), abs(ls - 1.0 / 3)) <= 0.02 AS within FROM l")
def deviation_field(spark, sf):
    d = semantic.deviation(loadings(spark, sf, 12))
    near = frequency.within_band([F.col(f"loading_{x}") for x in _THREE], 1 / 3, 0.02)
    return d.select("vec_id", F.round("dev_x", 5).alias("dev_x"), F.round("dev_y", 5).alias("dev_y"), near.alias("within"))


_TFIDF = """t AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[a-z]{{2,}}') AS w FROM {table}), u AS (SELECT id, unnest(w) AS term FROM t UNION ALL SELECT id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM t),
  c AS (SELECT id, term, count(*) AS tf FROM u GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM {table}), r AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN d USING (term), n),
  w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM r)"""


@query("WITH " + _TFIDF.format(key="item_id", text="text", table="benchmark") + " SELECT id AS item_id, term, round(weight, 6) AS weight FROM w")
def tfidf_terms(spark, sf):
    w = semantic.tfidf(table(spark, sf, "benchmark"), key="item_id", text="text", pattern="[a-z]{2,}")
    return w.select("item_id", "term", F.round("weight", 6).alias("weight"))


@query("WITH " + _TFIDF.format(key="id", text="text", table="(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark)") + " SELECT a.id AS id, b.id AS anchor, round(sum(a.weight * b.weight), 6) AS cosine FROM w a JOIN w b ON a.term = b.term WHERE a.id LIKE 'd%' AND b.id LIKE 'b%' GROUP BY 1, 2")
def tfidf_cosine(spark, sf):
    """All documents against all benchmark items, weighed over both."""
    named = lambda table_, letter, key: table(spark, sf, table_).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), "text")
    items = named("benchmark", "b", "item_id")
    w = semantic.tfidf(named("documents", "d", "doc_id").unionByName(items), key="id", text="text", pattern="[a-z]{2,}", asked=items)
    a = w.where(F.col("id").startswith("b")).withColumnRenamed("id", "a_id")
    return semantic.tfidf_cosines(w.where(F.col("id").startswith("d")), a, key="id", anchor_key="a_id").select("id", "anchor", F.round("cosine", 6).alias("cosine"))


@query("WITH " + _TFIDF.format(key="id", text="text", table="(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark)") + """, s AS (
  SELECT a.id AS anchor, b.id AS id, round(sum(a.weight * b.weight), 9) AS cosine FROM w a JOIN w b ON a.term = b.term WHERE a.id LIKE 'b%' AND b.id LIKE 'd%' GROUP BY 1, 2)
  SELECT anchor, CAST(row_number() OVER o AS INTEGER) AS rank, id, round(cosine, 6) AS cosine FROM s WHERE cosine > 0 WINDOW o AS (PARTITION BY anchor ORDER BY cosine DESC, id) QUALIFY row_number() OVER o <= 10""")
def tfidf_topk(spark, sf):
    """The ten nearest of all documents for each benchmark item."""
    named = lambda table_, letter, key: table(spark, sf, table_).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), "text")
    items = named("benchmark", "b", "item_id")
    w = semantic.tfidf(named("documents", "d", "doc_id").unionByName(items), key="id", text="text", pattern="[a-z]{2,}", asked=items)
    a = w.where(F.col("id").startswith("b")).withColumnRenamed("id", "anchor")
    return semantic.top_cosines(w.where(F.col("id").startswith("d")), a, 10, key="id", anchor_key="anchor").withColumn("cosine", F.round("cosine", 6))


@query()
def sparse_components(spark, sf):
    """Coordinates of all benchmark items on the first eight components of their TF-IDF vectors."""
    w = semantic.tfidf(table(spark, sf, "benchmark"), key="item_id", text="text", pattern="[a-z]{2,}")
    found, _ = landscape.sparse_components(w, 8, row="item_id", term="term", center=True)
    return found


@query()
def tsne_landscape(spark, sf):
    return tsne.project(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", *(F.round(c, 4).alias(c) for c in ("tsne_x", "tsne_y")))


@query()
def supplier_groups(spark, sf):
    """Suppliers that serve the same orders, by groups of the graph of all lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    return groups.communities(R.pairs(lines, "l_orderkey", "suppliers"))[0].select(F.col("node").alias("s_suppkey"), "community")


@query()
def concept_groups(spark, sf):
    """Groups and places of labels that documents share."""
    edges = settled(cooccurrence_edges(spark, sf))
    return groups.communities(edges)[0].join(groups.layout(edges), "node").select("node", "community", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def pca_landscape(spark, sf):
    return landscape.coordinates(table(spark, sf, "embeddings"), "embedding").select("vec_id", "label", F.round("pca_x", 4).alias("pca_x"), F.round("pca_y", 4).alias("pca_y"))


@query("SELECT vec_id % 20 AS gx, vec_id // 20 % 20 AS gy, round(avg(exp(-((x - (-0.5 + vec_id % 20 / 19.0)) ** 2))), 6) AS v FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def kernel_values(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    at = F.lit(-0.5) + (F.col("vec_id") % 20) / F.lit(19.0)
    return e.groupBy((F.col("vec_id") % 20).alias("gx"), (F.floor(F.col("vec_id") / 20) % 20).alias("gy")).agg(F.round(F.avg(F.exp(-((F.col("x") - at) ** 2))), 6).alias("v"))


def _written(*parts: str) -> Column:
    """Text made of literals and, in braces, expressions."""
    return F.concat(*(F.expr(f"cast({p[1:-1]} AS string)") if re.fullmatch(r"\{[\w +]+\}", p) else F.lit(p) for p in parts))


@query("""SELECT 'manual_' || p_partkey || '_1' AS record_id, p_name || ' that goes on' AS title, CAST(1990 + p_size AS INTEGER) AS year, '10.1/' || p_partkey AS doi, 'Ames, ' || p_brand || ' | Bo, B' AS authors FROM part
  UNION ALL SELECT 'manual_' || p_partkey || '_2', 'Second ' || p_partkey, 2020, '', '' FROM part""")
def ris_parse(spark, sf):
    """A file for each part, with two records and a cut one."""
    text = _written(
        "TY  - JOUR\nTI  - ", "{p_name}", "\n  that goes on\nAU  - Ames, ", "{p_brand}", "\nAU  - Bo, B\nPY  - ", "{1990 + p_size}", "/03/\nDO  - 10.1/", "{p_partkey}",
        "\nER  - \n\nTY  - JOUR\nT1  - Second ", "{p_partkey}", "\nN2  - Text\nY1  - 2020\nER  - \nTY  - LOST\n",
    )
    t = table(spark, sf, "part").select(_written("{p_partkey}", ".ris").alias("file"), _written("{p_partkey}").alias("stem"), text.alias("text"))
    return files.parse_ris(t).select("record_id", "title", "year", "doi", T.packed(F.col("authors")).alias("authors"))


@query("""SELECT 'manual_' || p_partkey || '_1' AS record_id, CAST(p_partkey AS VARCHAR) AS pmid, p_name || ' goes on' AS title, CAST(1990 + p_size AS INTEGER) AS year, p_brand || ' | Care' AS mesh FROM part
  UNION ALL SELECT 'manual_' || p_partkey || '_2', '9' || p_partkey, 'Two', 2017, '' FROM part""")
def nbib_parse(spark, sf):
    text = _written("PMID- ", "{p_partkey}", "\nTI  - ", "{p_name}", "\n      goes on\nAU  - Cole C\nDP  - ", "{1990 + p_size}", " May\nMH  - ", "{p_brand}", "\nMH  - Care\n\nPMID- 9", "{p_partkey}", "\nTI  - Two\nDEP - 20170102\n")
    t = table(spark, sf, "part").select(_written("{p_partkey}", ".nbib").alias("file"), _written("{p_partkey}").alias("stem"), text.alias("text"))
    return files.parse_nbib(t).select("record_id", "pmid", "title", "year", T.packed(F.col("mesh_terms")).alias("mesh"))


@query("""SELECT 'pubmed_' || p_partkey AS record_id, 'Of ' || p_name || ' content' AS title, 'AIM: To see ' || p_brand || '.' || chr(10) || 'More & more.' AS abstract, CAST(1990 + p_size AS INTEGER) AS year, (1990 + p_size) || '-Mar' AS publication_date,
  'Eva Dee | Group' AS authors, '10.2/' || p_partkey AS doi, 'retracted_or_retraction_notice' AS flag FROM part""")
def pubmed_xml(spark, sf):
    """An answer for each part, with mixed content and labels."""
    payload = _written(
        '<Set><PubmedArticle><MedlineCitation><PMID Version="1">', "{p_partkey}", "</PMID><Article><Journal><JournalIssue><PubDate><Year>", "{1990 + p_size}", "</Year><Month>Mar</Month></PubDate></JournalIssue><Title>J</Title></Journal>\n<ArticleTitle>Of <i>",
        "{p_name}", '</i> content</ArticleTitle><Abstract><AbstractText Label="AIM">To see ', "{p_brand}", ".</AbstractText><AbstractText>More &amp; more.</AbstractText></Abstract>\n<AuthorList><Author><LastName>Dee</LastName><ForeName>Eva</ForeName></Author>"
        "<Author><CollectiveName>Group</CollectiveName></Author></AuthorList>\n<PublicationTypeList><PublicationType>Retracted Publication</PublicationType></PublicationTypeList></Article></MedlineCitation>\n"
        '<PubmedData><ArticleIdList><ArticleId IdType="doi">10.2/', "{p_partkey}", "</ArticleId></ArticleIdList></PubmedData></PubmedArticle></Set>",
    )
    p = services.parse_pubmed(services.articles(table(spark, sf, "part").select(payload.alias("payload"))))
    return p.select("record_id", "title", "abstract", "year", "publication_date", T.packed(F.col("authors")).alias("authors"), "doi", F.col("publication_status_flag").alias("flag"))


@query("""WITH a AS (SELECT p_partkey AS k, p_partkey % 7 AS form FROM part) SELECT k, '$' AS path, 'no JSON' AS reason FROM a WHERE form = 1 UNION ALL SELECT k, '$', 'no records' FROM a WHERE form = 2
  UNION ALL SELECT k, '$[0].review_type', 'no string: object<deep: bigint>' FROM a WHERE form = 3 UNION ALL SELECT k, '$[0].extra', 'unknown field' FROM a WHERE form = 3
  UNION ALL SELECT k, '$.records[1]', 'no record_id' FROM a WHERE form = 4 UNION ALL SELECT k, '$.records[0].psychological_concepts', 'no array<string>: string' FROM a WHERE form = 5
  UNION ALL SELECT k, '$.records[0]', 'no object' FROM a WHERE form = 6""")
def answer_quarantine(spark, sf):
    """Answers for each part, cut short, nested otherwise or with fields of other types; the rest of them is typed."""
    one = ('{"record_id": "', "{p_partkey}", '", "review_type": ')
    forms = [
        _written('{"records": [', *one, '"scoping review"}]}'),
        _written('{"records": [', *one, '"scoping'),
        _written('{"answer": ', *one, '"scoping review"}}'),
        _written("[", *one, '{"deep": 1}, "extra": [1]}]'),
        _written("```json\n", '{"records": [', *one, '"other"}, {"review_type": "lost"}]}', "\n```"),
        _written('{"records": [', *one, 'null, "psychological_concepts": "fear"}]}'),
        _written('{"records": ["', "{p_partkey}", '"]}'),
    ]
    answer = F.element_at(F.array(*forms), (F.col("p_partkey") % 7 + 1).cast("int"))
    asked = table(spark, sf, "part").select(answer.alias("answer"), F.lit(None).cast("string").alias("error"), F.array(F.col("p_partkey").cast("string")).alias("keys"))
    return enrich.sorted_answers(asked)[1].select(F.col("keys")[0].cast("bigint").alias("k"), "path", "reason")


@query("SELECT l_returnflag, q, true AS within FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0.01), (0.25), (0.5), (0.75), (0.99)) v(q)")
def quantile_sketch(spark, sf):
    """Whether quantiles of sketches, merged from those of the suppliers, are within a rank of one in a hundred of the exact ones."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", F.col("l_extendedprice").cast("double").alias("x"))
    parts = frequency.quantile_sketches(lines, "x", "l_returnflag", "l_suppkey")
    merged = frequency.merged_sketches(parts, "l_returnflag")
    each = F.array(*(F.struct(F.lit(q).alias("q"), frequency.sketch_quantile(F.col("sketch"), q).alias("got")) for q in (0.01, 0.25, 0.5, 0.75, 0.99)))
    asked = settled(merged.select("l_returnflag", "n", F.explode(each).alias("e")).select("l_returnflag", "n", "e.*"))
    ranks = lines.join(F.broadcast(asked), "l_returnflag").groupBy("l_returnflag", "q", "n").agg(F.count_if(F.col("x") < F.col("got")).alias("below"), F.count_if(F.col("x") <= F.col("got")).alias("upto"))
    return ranks.select("l_returnflag", F.col("q").cast("decimal(3,2)").alias("q"), ((F.col("below") / F.col("n") <= F.col("q") + 0.01) & (F.col("upto") / F.col("n") >= F.col("q") - 0.01)).alias("within"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'scoping or mapping review' WHEN 1 THEN 'systematic review' WHEN 2 THEN 'background framing' ELSE 'unclear' END AS label FROM events""")
def choice_normaliser(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, (" Scoping  Review", "systematic_review", "Background", "something else"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.choice(raw, V.REVIEW_TYPE_OPTIONS + V.FUNCTION_OPTIONS, F.lit("unclear")).alias("label"))


@query("""SELECT flag AS conceptual_problem_flag, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM (SELECT unnest(CASE event_id % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b', 'c'] WHEN 2 THEN ['none'] ELSE ['c'] END) AS flag FROM events) WHERE flag <> 'none' GROUP BY flag""")
def problem_flag_counts(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("['a', 'b']", "b | c", "none", "c,"))), (F.col("event_id") % 4 + 1).cast("int"))
    return frequency.label_counts(table(spark, sf, "events"), T.problem_flags(raw), name="conceptual_problem_flag", without=("none",))


@query("""SELECT record_id, CASE WHEN n >= 4 THEN 'elaborated' WHEN n >= 2 THEN 'mentioned' WHEN n >= 1 THEN 'minimal' ELSE 'absent' END AS coverage FROM (SELECT doc_id AS record_id, (length(t) - length(replace(t, ' the ', ''))) // 5 + (length(t) - length(replace(t, 'scum', ''))) // 4 AS n FROM (SELECT doc_id, lower(text) AS t FROM documents))""")
def coverage_levels(spark, sf):
    n = T.occurrences(F.lower("text"), (" the ", "scum"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), coding.coverage(n).alias("coverage"))


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (p_partkey % 10 = 3) AS BIGINT) AS odd FROM part")
def enrich_repair(spark, sf):
    """Every record is asked about in batches; a fake answer leaves some fields out, and rules fill them in."""
    base = coding.base(studies(spark, sf).withColumn("record_id", F.col("record_id").cast("string")))

    def answer(batch: list[dict]) -> str:
        import json

        return "```json\n" + json.dumps({"records": [{"record_id": r["record_id"], "review_type": "Scoping_Review" if int(r["record_id"]) % 10 == 3 else None} for r in batch]}) + "\n```"

    coded = enrich.repair(base, enrich.answers(enrich.ask(base, answer, ["record_id", "title", "abstract"])))
    odd = F.count_if((F.col("record_id").cast("int") % 10 == 3) & (F.col("review_type") == "scoping or mapping review"))
    return coded.agg(F.count("*").alias("records"), odd.alias("odd"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM (SELECT r_name, n_name, l_extendedprice, l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (r_name, n_name)")
def revenue_rollup(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return li.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


#: A text in plain letters, for building payloads of documents.
PLAIN = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))"


def plain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")).alias("t"))


@query(f"""SELECT doc_id, 'Of ' || doc_id || chr(10) || chr(10) || 'One' || chr(10) || concat_ws(' ', 'One', nullif(t, ''), 'Two', 'é<', nullif(t, ''), 'end') || chr(10) || chr(10) || 'Two' || chr(10) || concat_ws(' ', 'Two', 'é<', nullif(t, ''))
  || chr(10) || chr(10) || 'three' AS body FROM (SELECT doc_id, {PLAIN} AS t FROM documents)""")
def fulltext_sections(spark, sf):
    """Sections inside sections, characters by number, a section without a title."""
    t = F.col("t")
    xml = F.concat(F.lit("<a><front><article-title>Of <b>"), F.col("doc_id").cast("string"), F.lit("</b></article-title></front><body><sec><title>One</title><p>"), t, F.lit("</p><sec><title>Two</title><p>&#233;&lt; <i/>"), t, F.lit("</p></sec><p>end</p></sec><sec><p>three</p></sec></body></a>"))
    xml = F.regexp_replace(xml, "&lt; <i/>", "&lt;<i/>")
    return plain(spark, sf).select("doc_id", fulltext.article_text(xml).alias("body"))


@query(f"""SELECT 'pubmed_' || doc_id AS record_id, concat_ws(' ', nullif(t, ''), 'é & &#65; €') AS title, concat_ws(chr(10), CASE WHEN t <> '' THEN 'BODY: ' || t END, 'End.') AS abstract, CAST(2000 + doc_id % 25 AS INTEGER) AS year, 'Ann Dee | ' || source AS authors
  FROM (SELECT doc_id, source, {PLAIN} AS t FROM documents)""")
def pubmed_articles(spark, sf):
    """An article for each document: empty elements that close themselves, labels, characters by number."""
    def text(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    t = F.col("t")
    xml = text(
        "<Set><PubmedArticle><MedlineCitation><PMID>", F.col("doc_id").cast("string"), "</PMID><Article><Journal><JournalIssue><PubDate><Year>", (2000 + F.col("doc_id") % 25).cast("string"),
        "</Year></PubDate></JournalIssue></Journal><ArticleTitle>", t, " &#xE9; &amp; &amp;#65; &#8364;</ArticleTitle><Abstract><AbstractText Label=\"AIM\"/><AbstractText Label=\"BODY\">", t,
        "</AbstractText><AbstractText>End.</AbstractText></Abstract><AuthorList><Author><LastName>Dee</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>", F.col("source"),
        "</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData/></PubmedArticle></Set>",
    )
    got = services.parse_pubmed(services.articles(plain(spark, sf).select(xml.alias("payload"))))
    return got.select("record_id", "title", "abstract", "year", T.packed(F.col("authors")).alias("authors"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'wos_' || p_partkey || '_1' ELSE 'WOS:' || p_partkey END AS record_id, p_name AS title, p_brand AS journal, CAST(1990 + p_size AS INTEGER) AS year,
  'A, ' || p_brand || ' | B' AS authors, 2 AS author_count, 'A, ' || p_brand AS first_author, '10.1/' || p_partkey AS doi FROM part""")
def wos_parse(spark, sf):
    author = lambda d, w, f: F.struct(d.alias("displayName"), w.alias("wosStandard"), f.alias("fullName"))
    none, empty = F.lit(None).cast("string"), F.lit("")
    title = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("value")))).otherwise(F.col("p_name"))
    hit = F.struct(
        F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("WOS:"), F.col("p_partkey").cast("string"))).alias("uid"), title.alias("title"),
        F.struct(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi")).alias("identifiers"),
        F.struct(F.array(author(F.concat(F.lit("A, "), F.col("p_brand")), none, none), author(empty, F.lit("B"), none), author(empty, empty, none)).alias("authors")).alias("names"),
        F.struct(F.col("p_brand").alias("sourceTitle"), (1990 + F.col("p_size")).cast("string").alias("publishYear")).alias("source"),
    )
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.to_json(F.struct(F.array(hit).alias("hits"))).alias("payload"))
    return services.parse_wos(pages).select("record_id", "title", "journal", "year", T.packed(F.col("authors")).alias("authors"), "author_count", "first_author", "doi")


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'psycinfo_' || p_partkey || '_1' ELSE 'E' || p_partkey END AS record_id, p_name AS title, p_type AS abstract, CAST(1990 + p_size AS INTEGER) AS year, p_brand AS authors FROM part""")
def eds_parse(spark, sf):
    title = lambda kind, t: F.struct(F.lit(kind).alias("Type"), t.alias("TitleFull"))
    bib = F.struct(
        F.when(F.col("p_partkey") % 2 == 0, F.array(title("other", F.lit("x")), title("main", F.col("p_name")))).otherwise(F.array(title("other", F.col("p_name")))).alias("Titles"),
        F.array(F.struct(F.struct(F.lit("").alias("NameFull"), F.col("p_brand").alias("Y1")).alias("Name"))).alias("Authors"), (1990 + F.col("p_size")).cast("string").alias("PublicationYear"),
    )
    info = F.struct(F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("E"), F.col("p_partkey").cast("string"))).alias("RecordID"), F.struct(bib.alias("BibEntity")).alias("BibRecord"))
    item = lambda name, data: F.struct(F.lit(name).alias("Name"), data.alias("Data"))
    record = F.struct(info.alias("RecordInfo"), F.array(item("Title", F.lit("no")), item("Abstract", F.col("p_type"))).alias("Items"))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.to_json(F.struct(F.struct(F.struct(F.array(record).alias("Records")).alias("Data")).alias("SearchResult"))).alias("payload"))
    return services.parse_eds(pages).select("record_id", "title", "abstract", "year", T.packed(F.col("authors")).alias("authors"))


@query("""SELECT fulltext_status, count(*) AS n, round_even(coalesce(avg(n), 0), 1) AS mean_word_count, CAST(count(*) FILTER (fulltext_status IN ('manual_retrieval_required', 'pmc_linked_fetch_failed', 'pmc_fulltext_low_content_manual_check')) AS BIGINT) AS manual_retrieval_n FROM (
  SELECT CASE WHEN doc_id % 5 = 0 THEN 'manual_retrieval_required' WHEN doc_id % 5 = 1 THEN 'pmc_linked_fetch_failed' WHEN n < 250 THEN 'pmc_fulltext_low_content_manual_check' WHEN doc_id % 2 = 0 THEN 'pmc_fulltext_cached' ELSE 'pmc_fulltext_fetched' END AS fulltext_status,
    CASE WHEN doc_id % 5 <= 1 THEN 0 ELSE n END AS n FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)) GROUP BY 1""")
def fulltext_validation(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 5 > 1, F.col("text")))
    pmcid = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("PMC"), F.col("doc_id").cast("string"))).otherwise("")
    made = d.select(fulltext.status(pmcid, F.lit(True), F.col("doc_id") % 2 == 0, F.col("text")).alias("fulltext_status"), F.coalesce(T.word_count(F.col("text")), F.lit(0)).alias("fulltext_word_count"))
    return fulltext.validation(made.withColumn("manual_retrieval_needed", F.when(F.col("fulltext_status").isin(*fulltext.MANUAL), "yes").otherwise("no")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PMC' || c_custkey WHEN 1 THEN 'PMC9' || c_custkey WHEN 2 THEN 'PMC8' || c_custkey ELSE '' END AS pmcid,
  CASE c_custkey % 4 WHEN 0 THEN 'stage2_existing_pmcid' WHEN 1 THEN 'pubmed_elink' WHEN 2 THEN 'europepmc' ELSE 'none' END AS retrieval_source FROM customer""")
def resolve_sources(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("record_id"), F.col("c_custkey").cast("string").alias("pmid"))
    own = c.withColumn("pmcid", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" PMC"), "pmid")).when(F.col("c_custkey") % 4 == 1, "").otherwise(F.lit(None)))
    links = c.where("c_custkey % 4 = 1").select("pmid", F.concat(F.lit("PMC9"), "pmid").alias("linked"))
    searched = c.where("c_custkey % 4 >= 2").select("record_id", F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("PMC8"), "pmid")).otherwise("none").alias("found"))
    return fulltext.resolve(own, links, searched).select("c_custkey", "pmcid", "retrieval_source")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Anon.' WHEN 1 THEN s_name WHEN 2 THEN s_name || ' & Bo' ELSE s_name || ' et al.' END AS label, CASE s_suppkey % 3 WHEN 0 THEN 9999 WHEN 1 THEN 2020 ELSE 1999 END AS year,
  CASE s_suppkey % 4 WHEN 0 THEN '---' WHEN 1 THEN 'B' WHEN 2 THEN 'P, S' ELSE 'B, P, S' END AS cell, CASE WHEN s_suppkey % 2 = 0 THEN 'https://doi.org/10.1/x' ELSE '' END AS doi_url, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey > 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || s_suppkey || '/' ELSE '' END AS pmid_url FROM supplier""")
def citation_labels(spark, sf):
    k, name = F.col("s_suppkey"), F.col("s_name")
    authors = F.when(k % 4 == 0, " | ").when(k % 4 == 1, F.concat(F.lit("Ann B. "), name)).when(k % 4 == 2, F.concat(name, F.lit(", A | Cy  Bo"))).otherwise(F.concat(name, F.lit(", A|B|C")))
    yes = lambda test: F.when(test, " Yes").otherwise("no")
    year = F.when(k % 3 == 1, "2020.0").when(k % 3 == 0, "n.d.").otherwise("x")
    own = table(spark, sf, "supplier").withColumn("year", F.when(k % 3 == 2, "1999").otherwise(year))
    cell = T.domain_cell(yes(k % 2 == 1), yes(k % 4 >= 2), yes(k % 4 >= 2))
    return own.select(
        "s_suppkey", T.author_label(authors).alias("label"), T.sort_year(k.cast("string"), F.col("year")).alias("year"), cell.alias("cell"),
        T.doi_url(F.when(k % 2 == 0, " 10.1/x")).alias("doi_url"), T.pmid_url(F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise("-3")).alias("pmid_url"),
    )


@query("SELECT n_name, n, round(n / max(n) OVER (PARTITION BY r), 9) AS relative, round(90 + 360.0 * coalesce(sum(n) OVER (ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (), 6) AS start_angle FROM (SELECT n_name, n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def profile_angles(spark, sf):
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"))
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    drawn = frequency.sweep(shares.withColumn("relative", frequency.relative_to_largest("n", "r")), "n_name", "share")
    return drawn.select("n_name", "n", F.round("relative", 9).alias("relative"), F.round("start_angle", 6).alias("start_angle"))


@query("SELECT round(sum(n) FILTER (k <= 3) / sum(n), 9) AS share FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1))")
def top_three_share(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return frequency.top_share(n).select(F.round("share", 9).alias("share"))


@query("WITH g AS (SELECT -0.5 + i / 39.0 AS v FROM range(40) t(i)) SELECT round(a.v, 6) AS gx, round(b.v, 6) AS gy, round(avg(exp(-((x - a.v) ** 2 + (y - b.v) ** 2) / 0.18)) / (2 * pi() * 0.09), 6) AS density FROM g a, g b, (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) GROUP BY 1, 2")
def density_grid(spark, sf):
    d = landscape.density(table(spark, sf, "embeddings"), F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), low=-0.5, high=0.5)
    return d.select(*(F.round(c, 6).alias(c) for c in ("gx", "gy", "density")))


@query("""WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL),
  m AS (SELECT label, count(*) AS n, var_samp(x) * 0.09 AS a, covar_samp(x, y) * 0.09 AS b, var_samp(y) * 0.09 AS c FROM p GROUP BY label HAVING count(*) >= 6),
  o AS (SELECT label, n, b / a AS shear, sqrt(a) / 16 AS dx, sqrt(c - b * b / a) / 16 AS dy, a * (1 - 1 / 1536.0) AS a, (c - b * b / a) * (1 - 1 / 1536.0) AS c FROM m WHERE a > 0 AND a * c - b * b > a * c * 1e-12),
  u AS (SELECT p.label, x / dx AS u, (y - shear * x) / dy AS v FROM p JOIN o ON p.label IS NOT DISTINCT FROM o.label),
  k AS (SELECT label, floor(u) + i AS cx, floor(v) + j AS cy, sum((CASE i WHEN 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * (CASE j WHEN 1 THEN v - floor(v) ELSE 1 - v + floor(v) END)) AS w
    FROM u, range(2) AS r(i), range(2) AS q(j) GROUP BY ALL), g AS (SELECT -0.5 + i / 19.0 AS g FROM range(20) t(i)),
  r AS (SELECT k.label, g AS gx, cy, sum(w * exp(-((g - cx * dx) ** 2) / (2 * a))) AS w FROM k JOIN o ON k.label IS NOT DISTINCT FROM o.label, g GROUP BY ALL)
  SELECT r.label, round(gx, 6) AS gx, round(g, 6) AS gy, round(sum(w * exp(-((g - shear * gx - cy * dy) ** 2) / (2 * c)) / (n * 2 * pi() * sqrt(a * c))), 6) AS density FROM r JOIN o ON r.label IS NOT DISTINCT FROM o.label, g GROUP BY r.label, gx, g""")
def density_binned(spark, sf):
    """Densities of the vectors of each label, with the covariance of its own, from cells."""
    x, y = (F.col("embedding")[i] for i in range(2))
    d = landscape.kde(table(spark, sf, "embeddings"), x, y, factor=0.3, xs=(-0.5, 0.5, 20), ys=(-0.5, 0.5, 20), by=("label",))
    return d.select("label", *(F.round(c, 6).alias(c) for c in ("gx", "gy", "density")))


@query("""SELECT vec_id, CASE WHEN top - second < 0.05 THEN 'balanced' WHEN a = top THEN 'bio-dominant' WHEN b = top THEN 'psych-dominant' ELSE 'social-dominant' END AS balance FROM (
  SELECT *, greatest(a, b, c) AS top, a + b + c - greatest(a, b, c) - least(a, b, c) AS second FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings))""")
def domain_balance(spark, sf):
    a, b, c = (F.col("embedding")[i].cast("double") for i in range(3))
    return table(spark, sf, "embeddings").select("vec_id", coding.balance(a, b, c).alias("balance"))


@query("""SELECT doc_id, CASE WHEN t AND a THEN 'title and abstract' WHEN t THEN 'title only' WHEN a THEN 'abstract only' ELSE 'unclear' END AS location, labels FROM (
  SELECT doc_id, doc_id % 3 = 0 AS t, doc_id % 2 = 0 AS a, CASE WHEN doc_id % 2 = 0 THEN 'a b | c' ELSE 'c' END AS labels FROM documents)""")
def mention_location(spark, sf):
    d, named = table(spark, sf, "documents"), F.lit(" A BioPsychoSocial view")
    put = lambda test: F.when(test, F.concat("source", named)).otherwise(F.col("source"))
    lists = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" A  b"), F.lit("C"), F.lit(""), F.lit("a b"))).otherwise(F.array(F.lit("c "), F.lit("C")))
    return d.select("doc_id", T.bps_location(put(F.col("doc_id") % 3 == 0), put(F.col("doc_id") % 2 == 0)).alias("location"), T.packed(T.normal_list(lists)).alias("labels"))


_YES = {d: f"CASE WHEN {_or(terms)} THEN 'yes' ELSE 'no' END" for d, terms in (("bio", V.BIO_TERMS), ("psych", V.PSYCH_TERMS), ("social", V.SOCIAL_TERMS))}
_FLAG = f"CASE {_PAIN} WHEN 'chronic secondary musculoskeletal pain' THEN 'yes' WHEN 'mixed or unspecified chronic pain' THEN 'unclear' ELSE 'no' END"


@query(f"""WITH {STUDIES}, c AS (SELECT record_id, {_FLAG} AS flag, {" AND ".join(f"{y} = 'yes'" for y in _YES.values())} AS whole FROM studies)
  SELECT record_id, CASE WHEN flag = 'no' THEN 'no' ELSE 'yes' END AS candidate, CASE WHEN flag = 'no' THEN 'low' ELSE 'medium' END AS priority, '' AS typology, 'rule_based_fallback' AS method,
  CASE flag WHEN 'yes' THEN 'high' WHEN 'unclear' THEN 'medium' ELSE 'low' END AS batch_priority, CASE WHEN whole THEN 'multifactorial signal' ELSE 'pseudo-bps or partial signal' END AS batch_typology, 'llm_batch_fallback' AS batch_method FROM c""")
def rules_only(spark, sf):
    """Coding by rules alone, and as for records that an answer leaves out."""
    s = studies(spark, sf)
    alone = coding.code_by_rules(s).select("record_id", F.col("stage3_candidate").alias("candidate"), F.col("stage3_priority").alias("priority"), F.col("provisional_typology").alias("typology"), F.col("coding_method").alias("method"))
    left_out = coding.code_by_rules(s, batch_fallback=True).select("record_id", *(F.col(c).alias(n) for c, n in (("stage3_priority", "batch_priority"), ("provisional_typology", "batch_typology"), ("coding_method", "batch_method"))))
    return alone.join(left_out, "record_id")


def _relevance_sql(chronic: str, *more: tuple[str, str]) -> str:
    tests = [("contains(t, 'withdrawn') OR contains(t, 'retracted')", "withdrawn_or_retracted_signal"), ("NOT contains(t, 'pain')", "pain_focus_not_explicit"), (f"NOT {chronic}", "chronicity_not_explicit"), *more]
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for test, label in tests) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {STUDIES}, s AS (SELECT record_id, lower(title || chr(10) || CASE record_id % 4 WHEN 0 THEN 'RETRACTED' WHEN 1 THEN 'unpersistented' ELSE abstract END) AS t, {_TYPES} AS type, {_PAIN} AS pain, {_FLAG} AS flag,
    CASE record_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'manual_retrieval_required' ELSE 'pmc_fulltext_cached' END AS status FROM studies),
  f AS (SELECT record_id, {_relevance_sql("(contains(t, 'chronic') OR contains(t, 'persistent') OR contains(t, 'long-term'))", ("type = 'other evidence synthesis'", "review_design_unclear"))} AS fulltext,
    {_relevance_sql("regexp_matches(t, '(^|[^a-z0-9_])(chronic|persistent|long-term)($|[^a-z0-9_])')", ("pain = 'unclear'", "pain_category_unclear"), ("flag <> 'no' AND status <> 'pmc_fulltext_cached'", "stage3_fulltext_manual_check_pending"))} AS audit FROM s)
  SELECT record_id, array_to_string(fulltext, '|') AS fulltext_flags, array_to_string(audit, '|') AS audit_flags,
    CASE WHEN list_has_any(fulltext, ['withdrawn_or_retracted_signal', 'pain_focus_not_explicit']) THEN 'high' WHEN len(fulltext) > 0 THEN 'medium' ELSE 'low' END AS fulltext_priority,
    CASE WHEN list_has_any(audit, ['withdrawn_or_retracted_signal', 'pain_focus_not_explicit']) THEN 'high' WHEN len(audit) > 0 THEN 'medium' ELSE 'low' END AS audit_priority FROM f""")
def relevance_flags(spark, sf):
    """What people have to look at: of full texts by what is anywhere in the text, of the audit by whole words."""
    c = coding.code_by_rules(studies(spark, sf))
    k = F.col("record_id")
    abstract = F.when(k % 4 == 0, "RETRACTED").when(k % 4 == 1, "unpersistented").otherwise(F.col("abstract"))
    status = F.when(k % 3 == 1, "manual_retrieval_required").when(k % 3 == 2, "pmc_fulltext_cached")
    full = coding.fulltext_relevance(F.col("title"), abstract, F.col("review_type"))
    audit = coding.audit_relevance(F.col("title"), abstract, F.col("icd11_pain_category"), F.col("stage3_candidate"), status)
    both = c.select("record_id", full.alias("f"), audit.alias("a"))
    return both.select("record_id", F.array_join("f.flags", "|").alias("fulltext_flags"), F.array_join("a.flags", "|").alias("audit_flags"), F.col("f.priority").alias("fulltext_priority"), F.col("a.priority").alias("audit_priority"))


@query("""WITH c AS (SELECT event_id AS k, ['rhetorical label signal', 'multifactorial signal', 'pseudo-bps or partial signal', 'potential integrative signal'][event_id % 4 + 1] AS kind,
    ['unclear', 'rhetorical label', 'explanatory framework'][event_id % 3 + 1] AS f, event_id % 5 > 0 AS bio, event_id % 7 > 0 AS social FROM events), l AS (SELECT k, list_filter([CASE WHEN k % 2 = 0 THEN 'own' END,
    CASE WHEN contains(kind, 'rhetorical') OR f = 'rhetorical label' THEN 'tokenistic_bps' END, CASE WHEN contains(kind, 'rhetorical') OR f = 'rhetorical label' THEN 'vague_definition' END,
    CASE WHEN kind IN ('multifactorial signal', 'pseudo-bps or partial signal') AND f = 'unclear' THEN 'parallel_listing_without_integration' END, CASE WHEN kind IN ('multifactorial signal', 'pseudo-bps or partial signal') AND f = 'unclear' THEN 'mechanistic_absence' END,
    CASE WHEN NOT bio THEN 'missing_biology' END, CASE WHEN NOT social THEN 'missing_social' END], lambda x: x IS NOT NULL) AS l FROM c)
  SELECT CASE WHEN len(l) = 0 THEN 'none' ELSE array_to_string(l, '|') END AS flags, count(*) AS n FROM l GROUP BY 1""")
def implied_flags(spark, sf):
    k = F.col("event_id")
    one = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    own = F.when(k % 2 == 0, F.array(F.lit("none"), F.lit(" Own"), F.lit("own"))).otherwise(F.array(F.lit("none")))
    kind = one("rhetorical label signal", "multifactorial signal", "pseudo-bps or partial signal", "potential integrative signal")
    flags = coding.problem_flags(own, kind, one("unclear", "rhetorical label", "explanatory framework"), F.when(k % 5 > 0, "yes").otherwise("no"), F.when(k % 7 > 0, "yes").otherwise("unclear"))
    return table(spark, sf, "events").select(F.array_join(flags, "|").alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS record_id, field, value FROM part, (VALUES ('review_type', 'odd', 4), ('stage3_priority', 'urgent', 6), ('bio_mentioned', NULL, 9), ('conceptual_problem_flags', 'none | made up', 10)) v(field, value, every) WHERE p_partkey % every = 0""")
def answer_violations(spark, sf):
    """Spoilt fields are found, and none of those that rules code."""
    k = F.col("record_id")
    flags = F.when(k % 10 == 0, F.array(F.lit("none"), F.lit("made up"))).otherwise(F.col("conceptual_problem_flags"))
    spoilt = coding.code_by_rules(studies(spark, sf), batch_fallback=True).withColumns({
        "review_type": F.when(k % 4 == 0, "odd").otherwise(F.col("review_type")), "stage3_priority": F.when(k % 6 == 0, "urgent").otherwise(F.col("stage3_priority")),
        "bio_mentioned": F.when(k % 9 > 0, F.col("bio_mentioned")), "conceptual_problem_flags": flags,
    })
    return enrich.violations(spoilt)


@query(ORACLE_SQL["agreement_kappa"].replace("SELECT 'ok' AS status", "SELECT 'stage1' AS stage, 'ok' AS status") + " UNION ALL SELECT 'stage2', 'not_ready', 0, NULL, NULL UNION ALL SELECT 'stage3', 'empty', 0, NULL, NULL")
def reliability_stages(spark, sf):
    """A stage that is coded twice, one whose second rater is missing, one without rows."""
    own = table(spark, sf, "labels")
    return agreement.report({"stage1": (own, "quality", "toxic"), "stage2": (own, "quality", "second"), "stage3": (own.where("false"), "quality", "toxic")})


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'The ' || lower(c_mktsegment) || ' of ' || c_name || '!'
  ELSE regexp_extract(substr(s, 1, 217), '^(.*) [^ ]*$', 1) || '...' END AS sentence FROM (SELECT c_custkey, c_mktsegment, c_name, 'A ' || repeat(c_name || ' and ', 20) || 'no more.' AS s FROM customer)""")
def opening_sentence(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    one = F.concat(F.lit(" OBJECTIVE:  aim : the "), F.lower("c_mktsegment"), F.lit("\n of "), name, F.lit("! And a second one."))
    text = F.when(k % 3 == 0, " Background: ").when(k % 3 == 1, one).otherwise(F.concat(F.lit("a "), F.repeat(F.concat(name, F.lit(" and ")), 20), F.lit("no more")))
    return table(spark, sf, "customer").select("c_custkey", T.first_sentence(text).alias("sentence"))


@query(f"""WITH {RECORDS}, {STUDIES}, k AS (SELECT row_number() OVER (PARTITION BY {TITLE} || '::' || year ORDER BY database, doc_id) AS n FROM records), s AS (SELECT {_steps(1, 'include')} AS d, {_FLAG} AS flag FROM studies),
  m AS (SELECT doc_id % 5 = 0 AS manual, doc_id % 5 > 0 AND len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 250 AS open FROM documents), v AS (
  SELECT 'combined_records' AS node, count(*) AS n FROM k UNION ALL SELECT 'deduplicated_records', count(*) FILTER (n = 1) FROM k UNION ALL SELECT 'duplicates_removed', count(*) FILTER (n > 1) FROM k
  UNION ALL SELECT 'included_records', count(*) FILTER (d = 'include') FROM s UNION ALL SELECT 'excluded_records', count(*) FILTER (d = 'exclude') FROM s UNION ALL SELECT 'unclear_records', count(*) FILTER (d = 'unclear') FROM s
  UNION ALL SELECT 'stage2_records', count(*) FROM s UNION ALL SELECT 'stage3_expected', count(*) FILTER (flag <> 'no') FROM s UNION ALL SELECT 'stage3_candidates', count(*) FROM m
  UNION ALL SELECT 'stage3_pmc_open_fulltexts', count(*) FILTER (open) FROM m UNION ALL SELECT 'stage3_manual_retrieval_required', count(*) FILTER (NOT open) FROM m),
  u AS (SELECT node, replace(node, '_', ' ') AS label, n FROM v UNION ALL SELECT 'database:' || database, database, count(*) FROM records WHERE database IS NOT NULL GROUP BY database)
  SELECT node, label, n, format('{{:,}}', n) AS shown FROM u""")
def flow_values(spark, sf):
    r = dedupe.rank_duplicates(records(spark, sf), F.col("doc_id"))
    d = table(spark, sf, "documents")
    pmcid = F.when(F.col("doc_id") % 5 > 0, "PMC1").otherwise("")
    made = d.select(fulltext.status(pmcid, F.lit(True), F.col("doc_id") % 2 == 0, F.col("text")).alias("fulltext_status"))
    made = made.withColumn("manual_retrieval_needed", F.when(F.col("fulltext_status").isin(*fulltext.MANUAL), "yes").otherwise("no"))
    counts = frequency.pipeline_counts(r, coding.screen(studies(spark, sf)), coding.code_by_rules(studies(spark, sf)), made)
    return frequency.flow_nodes(counts, frequency.value_counts(r, "database"))
