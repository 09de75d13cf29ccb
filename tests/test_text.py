import datetime as dt

import pytest
from pyspark.sql import functions as F

from litmill.functions import text as T


def value(spark, make, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(texts)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "texts", "want"),
    [
        (T.normal_title, ("  The *Été* of: pain!! ",), "the t of pain"),
        (T.normal_title, (None,), ""),
        (T.normal_doi, (" https://doi.org/10.1/AbC ",), "10.1/abc"),
        (T.normal_doi, ("http://dx.doi.org/10.1/x",), "http://dx.doi.org/10.1/x"),
        (T.dedupe_key, ("", "A title", "2020"), "a title::2020"),
        (T.dedupe_key, ("10.1/X", "A title", "2020"), "10.1/x"),
        (T.dedupe_key, (None, None, None), "::"),
        (T.slug, ("Ünder the -- Bridge!",), "ünder-the-bridge"),
        (T.slug, ("--",), "unnamed"),
        (T.normal_pmid, ("12720511.0",), "12720511"),
        (T.normal_pmid, ("0",), ""),
        (T.year_of, ("2025.0",), 2025),
        (T.year_of, ("n.d.",), None),
        (T.objective, ("BACKGROUND: x.\nOBJECTIVE: To see\n all.\nMETHODS: y",), "OBJECTIVE: To see all."),
        (T.objective, ("We aim to do so. And more.",), "aim to do so. And more."),
        (T.objective, ("First one. Second.",), "First one."),
        (T.objective, (None,), ""),
        (T.bps_location, ("Biopsychosocial", "none"), "title only"),
        (T.bps_location, ("none", "a bio-psycho-social view"), "abstract only"),
        (T.bps_location, (None, None), "unclear"),
        (T.word_count, (" a  b\nc ",), 3),
        (T.word_count, (None,), 0),
        (lambda c: T.shorten(c, 10), ("abcdefghijkl",), "abcdefg..."),
        (T.compact_pain_label, ("chronic primary pain",), "primary"),
        (T.compact_pain_label, ("chronic pain",), "chronic pain"),
        (T.clean, ("Objective: Purpose of review : to see",), "to see"),
        (T.first_sentence, ("aims: to see it. Then.",), "To see it."),
        (lambda c: T.first_sentence(c, 20), ("one two three four five six seven",), "One two three..."),
        (T.focus, ("The aim was to map coping.",), "map coping"),
        (T.title_focus, ("Coping with pain: a systematic review",), "Coping with pain"),
        (T.author_label, ("Ames, A | B Cole",), "Ames & Cole"),
        (T.author_label, ("Ames, A | B | C",), "Ames et al."),
        (T.author_label, ("",), "Anon."),
        (T.domain_cell, ("yes", "no", "Yes"), "B, S"),
        (T.domain_cell, ("no", None, ""), "---"),
        (T.bare_json, ('```json\n{"a": 1}\n```',), '{"a": 1}'),
        (T.bare_json, ('Sure: {"a": [1]} done',), '{"a": [1]}'),
        (T.bare_json, ("nothing",), None),
        (lambda c: T.occurrences(c, ("ab", "b")), ("ababb",), 5),
        (T.html_text, ("<p>A &amp; <script>x<y</script><b>b</b></p>",), "A & b"),
    ],
)
def test_functions(spark, make, texts, want):
    assert value(spark, make, *texts) == want


@pytest.mark.parametrize(
    ("stated", "year", "want"),
    [
        ("2021-03-09", "", dt.date(2021, 3, 9)),
        ("2021/3/9", "1999", dt.date(2021, 3, 9)),
        ("2025-02-30", "", dt.date(2025, 2, 1)),
        ("2021-07", "2020", dt.date(2021, 7, 1)),
        ("2026-Mar-20", "2026.0", dt.date(2026, 1, 1)),
        ("2026-Mar-20", "soon", None),
        ("Spring 2019", "", dt.date(2019, 1, 1)),
        (None, None, None),
    ],
)
def test_record_date(spark, stated, year, want):
    assert value(spark, T.record_date, stated, year) == want


def test_lists(spark):
    df = spark.createDataFrame([([" A b", "a  B", "", None, "c"], "['x', 'y'] ", " p | q||")], "l array<string>, f string, p string")
    r = df.select(T.normal_list(F.col("l")).alias("a"), T.problem_flags(F.col("f")).alias("b"), T.unpacked(F.col("p")).alias("c"), T.choice(F.col("f"), ("x",), F.lit("none")).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (["a b", "c"], ["x", "y"], ["p", "q"], "none")


def test_descriptions(spark):
    def said(*texts):
        return value(spark, T.describe, *texts).asDict()

    named = said("systematic review", "Coping skills in chronic low back pain: a systematic review", "", "", "")
    assert named == {"source": "title_fallback", "focus": "Coping skills in chronic low back pain", "description": "This systematic review was focused on coping skills in chronic low back pain."}
    full = said("meta-analysis", "Short", "", "", "Objective: to evaluate the effect of exercise on neck pain in adults.")
    assert full["source"] == "fulltext_cached" and full["description"] == "This meta-analysis was aimed to evaluate the effect of exercise on neck pain in adults."
    assert said("", "", None, None, None)["description"] == "This review was focused on chronic pain evidence."
