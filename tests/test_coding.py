import json

import pytest
from pyspark.sql import functions as F

from litmill.operators import coding, enrich
from litmill.functions import text as T
from litmill.operators.rules import Rule, RuleSet, equals, has, like, one_scan

GOOD = "Biopsychosocial review of chronic pain"


def screened(spark, **fields):
    base = {"record_id": "1", "title": GOOD, "abstract": "", "publication_types": "Review", "language": "eng", "publication_date": "2020", "year": "2020"} | fields
    r = coding.screen(spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))).first()
    return r["stage1_decision"], r["stage1_reason"], r["stage1_confidence"]


@pytest.mark.parametrize(
    ("fields", "want"),
    [
        ({}, ("include", "", "medium")),
        ({"title": "Review of chronic pain"}, ("exclude", "no biopsychosocial term in title/abstract", "high")),
        ({"year": "1950", "publication_date": ""}, ("exclude", "outside operational search window", "high")),
        ({"publication_date": "2026-04-01"}, ("exclude", "outside operational search window", "high")),
        ({"publication_date": None, "year": None}, ("include", "", "medium")),
        ({"abstract": "A protocol."}, ("exclude", "protocol", "high")),
        ({"publication_types": "Letter"}, ("exclude", "commentary/editorial/letter", "medium")),
        ({"abstract": "integration of care"}, ("exclude", "animal/non-human focus", "medium")),
        ({"abstract": "integration of human care"}, ("include", "", "medium")),
        ({"abstract": "in children"}, ("exclude", "pediatric-only focus", "medium")),
        ({"abstract": "in children and adults"}, ("include", "", "medium")),
        ({"title": "Biopsychosocial review of acute pain"}, ("exclude", "acute pain focus", "medium")),
        ({"title": "Biopsychosocial review"}, ("exclude", "chronic pain focus unclear", "medium")),
        ({"language": "fre"}, ("exclude", "non-English record", "medium")),
        ({"language": None}, ("include", "", "medium")),
        ({"title": "Biopsychosocial chronic pain", "publication_types": None}, ("unclear", "review status unclear", "low")),
    ],
)
def test_screening_rules(spark, fields, want):
    assert screened(spark, **fields) == want


def test_words_in_place_of_substrings(spark):
    df = spark.createDataFrame([(GOOD, "integration of care")], "title string, abstract string")
    assert coding.screen(df, match="word").first()["stage1_decision"] == "include"


def test_rule_sets(spark):
    rules = RuleSet((Rule("a", has("t", "x", "y.")), Rule("b", like("t", r"\bz+\b") & ~equals("u", "no"))), ("none",))
    df = spark.createDataFrame([("x z", ""), ("y", ""), ("zz", "no"), ("Zz", "yes"), (None, None)], "t string, u string")
    c = {"t": F.col("t"), "u": F.coalesce("u", F.lit(""))}
    assert [tuple(r) for r in df.select(rules.first(c), rules.all(c)).collect()] == [("a", ["a", "b"]), ("none", []), ("none", []), ("b", ["b"]), ("none", [])]


def one(spark, title, **more):
    fields = {"record_id": "1", "title": title, "abstract": "", "publication_types": ""} | more
    return coding.code_by_rules(spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))).first()


@pytest.mark.parametrize(
    ("title", "field", "want"),
    [
        ("A network meta-analysis and systematic review", "review_type", "network meta-analysis"),
        ("A meta-analytic view", "review_type", "meta-analysis"),
        ("An overview of reviews", "review_type", "umbrella review"),
        ("Evidence map", "review_type", "scoping or mapping review"),
        ("Rapid review", "review_type", "rapid review"),
        ("Realist review", "review_type", "realist review"),
        ("Integrative review", "review_type", "integrative review"),
        ("Systematic review", "review_type", "systematic review"),
        ("State of the art", "review_type", "narrative or expert review"),
        ("Cohort", "review_type", "other evidence synthesis"),
        ("A theory", "objective_category", "conceptual"),
        ("Rehabilitation", "objective_category", "clinical"),
        ("An instrument", "objective_category", "methodological"),
        ("Incidence", "objective_category", "epidemiological"),
        ("Other", "objective_category", "mixed"),
        ("Important to consider", "bps_function", "justification"),
        ("Multidisciplinary", "bps_function", "organizing principle"),
        ("Future research", "bps_function", "conclusion"),
        ("CRPS", "icd11_pain_category", "chronic neuropathic pain"),
        ("Oncology", "icd11_pain_category", "chronic cancer-related pain"),
        ("Postoperative", "icd11_pain_category", "chronic postsurgical or posttraumatic pain"),
        ("Migraine", "icd11_pain_category", "chronic secondary headache or orofacial pain"),
        ("Endometriosis", "icd11_pain_category", "chronic secondary visceral pain"),
        ("Chronic primary pain", "icd11_pain_category", "chronic primary pain"),
        ("Persistent pain", "icd11_pain_category", "mixed or unspecified chronic pain"),
        ("Persistent pain", "musculoskeletal_flag", "unclear"),
        ("Low back pain", "stage3_priority", "medium"),
        ("Nothing", "stage3_candidate", "no"),
        ("AMSTAR", "quality_assessment_reported", "yes"),
        ("Kinesiophobia, depressed", "psychological_concepts_detected", ["fear-avoidance", "depression"]),
    ],
)
def test_coding_rules(spark, title, field, want):
    assert one(spark, title)[field] == want


def test_domains_are_recoded_from_what_is_said(spark):
    df = spark.createDataFrame([("1", "Biopsychosocial psychosocial", "", "", "yes", "yes", "yes"), ("2", "Genetic stressors in families", "", None, "no", "no", "no")], "record_id string, title string, objective_text string, abstract string, bio_mentioned string, psych_mentioned string, social_mentioned string")
    got = {r["record_id"]: r for r in coding.recode_domains(df).collect()}
    assert [got["1"][c] for c in ("bio_mentioned", "psych_mentioned", "social_mentioned", "triadic_llm", "triadic_substantive")] == ["no", "no", "no", "yes", "no"]
    assert [got["2"][c] for c in ("bio_mentioned", "psych_mentioned", "social_mentioned", "bio_mentioned_llm", "triadic_substantive")] == ["yes", "yes", "yes", "no", "yes"]


def test_problem_flags_follow_from_other_fields(spark):
    rows = [(["none"], "rhetorical label signal", "unclear", "yes", "yes"), (["Construct_overlap", "none"], "multifactorial signal", "organizing principle", "no", "yes"), ([], "potential integrative signal", "explanatory framework", "yes", "yes"), (None, "x", "y", "yes", "no")]
    df = spark.createDataFrame(rows, "f array<string>, t string, u string, b string, s string")
    got = [r[0] for r in df.select(coding.problem_flags(*(F.col(c) for c in "ftubs"))).collect()]
    assert got == [["tokenistic_bps", "vague_definition"], ["construct_overlap", "parallel_listing_without_integration", "mechanistic_absence", "missing_biology"], ["none"], ["missing_social"]]


def test_relevance(spark):
    df = spark.createDataFrame([("Withdrawn: pain", "", "systematic review"), ("Pain", "", ""), ("Chronic pain", "", "systematic review")], "t string, a string, r string")
    got = [(r["x"]["priority"], r["x"]["flags"]) for r in df.select(coding.fulltext_relevance(F.col("t"), F.col("a"), F.col("r")).alias("x")).collect()]
    assert got == [("high", ["withdrawn_or_retracted_signal", "chronicity_not_explicit"]), ("medium", ["chronicity_not_explicit", "review_design_unclear"]), ("low", [])]
    r = df.select(coding.audit_relevance(F.col("t"), F.col("a"), F.lit("unclear"), F.lit("yes"), F.lit(None).cast("string")).alias("x")).collect()[2]["x"]
    assert (r["priority"], r["flags"]) == ("medium", ["pain_category_unclear", "stage3_fulltext_manual_check_pending"])


def test_earlier_scheme(spark):
    df = spark.createDataFrame([("Scoping review of work and family stigma culture", "neuro. fear. coping. Lifestyle")], "title string, abstract string")
    r = coding.code_v1(df).first()
    assert (r["review_type"], r["domain_social"], r["domain_psych"], r["domain_bio"], r["domain_lifestyle"]) == ("scoping review", "elaborated", "mentioned", "minimal", "mentioned")
    b = spark.range(1).select(*(coding.balance(*map(F.lit, v)) for v in ((0.3, 0.32, 0.1), (0.5, 0.2, 0.2), (0.1, 0.2, 0.9)))).first()
    assert tuple(b) == ("balanced", "bio-dominant", "social-dominant")


BASE = "record_id string, title string, abstract string, publication_types string"


def answer(records):
    import json

    out = []
    for r in records:
        if r["record_id"] == "bad":
            raise TimeoutError
        if r["record_id"] != "left out":
            out.append({"record_id": r["record_id"], "icd11": "Chronic Primary Pain", "musculoskeletal_flag": "YES", "psychological_concepts": ["Hope ", "coping"], "review_type": "guess", "conceptual_problem_flags": None})
            out.append({"record_id": r["record_id"], "icd11": "unclear", "review_type": "scoping review", "psychological_concepts": ["Hope ", "coping"], "musculoskeletal_flag": "yes"})
    return "Here: " + json.dumps(out)


def test_answers_are_repaired_and_failures_fall_back(spark):
    base = spark.createDataFrame([("1", "Coping with low back pain", "", ""), ("left out", "Migraine", "", ""), ("bad", "x", "", "")], BASE)
    coded, log = enrich.code(base, answer, batch=1, workers=2)
    got = {r["record_id"]: r for r in coded.collect()}
    assert got["1"]["icd11_pain_category"] == "unclear" and got["1"]["review_type"] == "scoping or mapping review"
    assert got["1"]["psychological_concepts_detected"] == ["coping", "hope"] and got["1"]["stage3_priority"] == "high" and got["1"]["coding_method"] == "llm_structured"
    assert got["left out"]["coding_method"] == got["bad"]["coding_method"] == "llm_batch_fallback" and got["left out"]["icd11_pain_category"].endswith("orofacial pain")
    assert sorted(r["status"] for r in log.collect()) == ["failed", "ok", "ok"]
    assert enrich.violations(coded).count() == 0
    assert enrich.code(base)[0].first()["coding_method"] == "rule_based_fallback"


def test_model_choice():
    assert enrich.pick_model(["a/mini", "g/gemini-1-flash", "g/gemini-2-flash"], None, "d") == "g/gemini-2-flash"
    assert enrich.pick_model(["a/mini"], None, "d") == "a/mini" and enrich.pick_model([], None, "d") == "d" and enrich.pick_model(["x"], "own", "d") == "own"


def test_answers_of_another_form_go_to_the_quarantine(spark):
    good = {"record_id": " a ", "review_type": "scoping review", "psychological_concepts": ["fear"], "icd11": None}
    answers = [
        json.dumps({"records": [good, {**good, "record_id": "b", "bio_mentioned": {"deep": [1]}, "theoretical_frameworks": "one", "extra": 5}]}),
        json.dumps([{**good, "record_id": "a", "review_type": "later"}, 7, {"review_type": "x"}, {"record_id": 3}]),
        json.dumps({"records": [good]})[:-20], "```json\n" + json.dumps([{"record_id": "c", "conceptual_problem_flags": [1]}]) + "\n```", json.dumps({"records": "none"}), "", None, "[]",
    ]
    asked = spark.createDataFrame([(a, None, [str(i)]) for i, a in enumerate(answers)], "answer string, error string, keys array<string>").coalesce(1)
    typed, odd = enrich.sorted_answers(asked)
    got = {r["record_id"]: r for r in typed.collect()}
    assert got.keys() == {"a", "b", "c"}
    assert (got["a"]["review_type"], got["a"]["psychological_concepts"], got["a"]["icd11"]) == ("later", ["fear"], None)
    assert (got["b"]["review_type"], got["b"]["bio_mentioned"], got["b"]["theoretical_frameworks"], got["c"]["conceptual_problem_flags"]) == ("scoping review", None, None, None)
    assert {(r["keys"][0], r["path"], r["reason"].split(":")[0], r["value"]) for r in odd.collect()} == {
        ("0", "$.records[1].bio_mentioned", "no string", '{"deep":[1]}'), ("0", "$.records[1].theoretical_frameworks", "no array<string>", '"one"'), ("0", "$.records[1].extra", "unknown field", None),
        ("1", "$[1]", "no object", "7"), ("1", "$[2]", "no record_id", '{"review_type":"x"}'), ("1", "$[3]", "no record_id", '{"record_id":3}'),
        ("2", "$", "no JSON", answers[2]), ("3", "$[0].conceptual_problem_flags", "no array<string>", "[1]"), ("4", "$", "no records", answers[4]), ("5", "$", "no JSON", ""),
    }
    assert typed.columns == enrich.answers(asked).columns


TERMS = ("pain", "pain management", "ain ma", "management", "a-b", "+", "\U0001d51e", "\u00e9t\u00e9")


def test_found_terms_are_those_that_the_text_contains(spark):
    texts = ["", None, "pain management", "painmanagement", "pai n", "x+a-b", "\u00e9t\u00e9 \U0001d51e", "a-" * 50_000 + "a-b", *(a + b for a in TERMS for b in TERMS)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, found, none in df.select("t", T.terms_found(F.col("t"), TERMS), T.terms_found(F.col("t"), ())).collect():
        assert found == (None if t is None else sorted(x for x in TERMS if x in t))
        assert none == (None if t is None else [])
    with pytest.raises(ValueError, match="empty"):
        T.terms_found(F.col("t"), ("a", ""))


def test_rules_give_the_same_from_one_scan(spark):
    sets = (RuleSet((Rule("a", has("t", "pain management")), Rule("b", has("t", "pain") & ~has("u", "x")), Rule("c", ~has("t", "management", "+"))), ("none",)),
            RuleSet((Rule("d", has("t", "ain ma") | has("t", "a-b")), Rule("e", like("t", "p.in"))), ("none",)), RuleSet((Rule("w", has("t", "ain")),), ("none",), match="word"))
    df = spark.createDataFrame([(t, u, 1) for t in (*TERMS, "pain management", "", None, "an ain", "pains + a-b") for u in ("x", None)], "t string, u string, _FOUND int")
    plain = {"t": F.col("t"), "u": F.col("u")}
    scanned, columns, name = one_scan(df, plain, sets, "t")
    assert name == "_found_"

    def rows(frame, c):
        return [tuple(r) for r in frame.select(*(s.first(c) for s in sets), *(s.all(c) for s in sets)).collect()]

    assert rows(df, plain) == rows(scanned, columns)
    with pytest.raises(ValueError, match="not looked for"):
        has("t", "other").build(columns, "substring")


def test_coding_reads_the_text_once(spark, capsys):
    coded = coding.code_by_rules(spark.createDataFrame([("1", GOOD, "b", "Review", 7)], "record_id string, title string, abstract string, publication_types string, _found int"))
    assert coded.columns.count("_found") == 1 and coded.first()["_found"] == 7
    coded.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_answers_come_in_frames_of_many(spark, monkeypatch):
    real = enrich.pd.DataFrame
    records = spark.createDataFrame([(str(i), f"t{i}") for i in range(100)], "record_id string, title string")
    ran = []
    monkeypatch.setattr(enrich, "settled", lambda df: df)
    monkeypatch.setattr(type(records), "mapInPandas", lambda self, run, schema: ran.append(run) or self)
    enrich.ask(records, lambda batch: ",".join(r["record_id"] for r in batch), ["record_id", "title"])
    frames = list(ran[0](iter([real({"record_id": [str(i) for i in range(a, a + 50)], "title": ["t"] * 50}) for a in (0, 50)])))
    assert [len(f) for f in frames] == [8, 8, 1]
    assert [k for f in frames for keys in f["keys"] for k in keys] == [str(i) for i in range(100)]
    assert frames[2]["answer"].tolist() == ["96,97,98,99"]
