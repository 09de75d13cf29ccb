"""Screening and coding of records by rule sets: each stage adds columns to a frame of records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.operators import vocabulary as V
from litmill.operators.rules import Rule, RuleSet, equals, has, like, one_scan, rule_table, test

WINDOW = (dt.date(1977, 1, 1), dt.date(2026, 3, 31))


def screening_rules(window: tuple[dt.date, dt.date] = WINDOW, match: str = "substring") -> RuleSet:
    """Decision, reason and confidence. Records without a date pass the window."""
    outside = test(lambda c: (c["date"] > F.lit(window[1])) | (c["date"] < F.lit(window[0])))

    def drop(reason, when, sure="medium"):
        return Rule("exclude", when, (reason, sure))

    reviewed = has("types", "review") | has("text", "review", "meta-analysis", "scoping")
    return RuleSet(
        (
            drop("no biopsychosocial term in title/abstract", ~has("text", *V.BPS_TERMS), "high"),
            drop("outside operational search window", outside, "high"),
            drop("protocol", has("text", "protocol") | has("types", "protocol"), "high"),
            drop("commentary/editorial/letter", has("types", *V.COMMENTARY_TERMS) | has("text", *V.COMMENTARY_TERMS)),
            drop("animal/non-human focus", has("text", *V.ANIMAL_TERMS) & ~has("text", "human")),
            drop("pediatric-only focus", has("text", *V.PEDIATRIC_TERMS) & ~has("text", *V.ADULT_TERMS)),
            drop("acute pain focus", has("text", "acute pain") & ~has("text", *V.UNSPECIFIED_PAIN)),
            drop("chronic pain focus unclear", ~has("text", *V.CHRONIC_PAIN_TERMS)),
            drop("non-English record", test(lambda c: c["language"] != "") & ~has("language", "eng", "english")),
            Rule("unclear", ~reviewed, ("review status unclear", "low")),
        ),
        ("include", "", "medium"),
        ("decision", "reason", "confidence"),
        match,
    )


def _lists(c: str, df: DataFrame) -> Column:
    """A text of a column that may be an array, packed, or missing."""
    if c not in df.columns:
        return F.lit("")
    return T.packed(F.col(c)) if dict(df.dtypes)[c].startswith("array") else T.blank(F.col(c).cast("string"))


def _col(c: str, df: DataFrame) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def screen(records: DataFrame, *, window: tuple[dt.date, dt.date] = WINDOW, match: str = "substring", by: str = "rules", mode: str = "rule_based_provisional") -> DataFrame:
    """Adds stage1_decision, stage1_reason, stage1_confidence, stage1_screened_by, stage1_screening_mode."""
    columns = {
        "text": T.blob(_col("title", records), _col("abstract", records)),
        "types": F.lower(_lists("publication_types", records)),
        "language": F.lower(_lists("language", records)),
        "date": T.record_date(_col("publication_date", records), _col("year", records).cast("string")),
    }
    d = screening_rules(window, match).first(columns)
    return records.withColumn("_d", d).select(
        *records.columns,
        *(F.col("_d")[x].alias(f"stage1_{x}") for x in ("decision", "reason", "confidence")),
        F.lit(by).alias("stage1_screened_by"),
        F.lit(mode).alias("stage1_screening_mode"),
    )


REVIEW_TYPE = RuleSet(tuple(Rule(label, like("typed", *p)) for label, p in V.REVIEW_TYPES.items()), ("other evidence synthesis",))
COLLAPSED_TYPE = RuleSet(rule_table(V.COLLAPSED_TYPES), ("other synthesis",))
OBJECTIVE = RuleSet(rule_table(V.OBJECTIVES), ("mixed",))
FUNCTION = RuleSet(rule_table(V.FUNCTIONS), ("unclear",))
PAIN = RuleSet((*rule_table(V.PAIN_CATEGORIES), Rule("mixed or unspecified chronic pain", has("text", *V.UNSPECIFIED_PAIN))), ("unclear",))
CONCEPTS = RuleSet(rule_table(V.CONCEPTS), ("",))
QUALITY = RuleSet((Rule("yes", has("text", *V.QUALITY_TERMS)),), ("no",))
MUSCULOSKELETAL = RuleSet(
    (Rule("yes", equals("pain", "chronic secondary musculoskeletal pain")), Rule("unclear", equals("pain", "mixed or unspecified chronic pain"))), ("no",)
)
DOMAINS = {d: RuleSet((Rule("yes", has("text", *terms)),), ("no",)) for d, terms in (("bio", V.BIO_TERMS), ("psych", V.PSYCH_TERMS), ("social", V.SOCIAL_TERMS))}


def collapse_review_type(label: Column) -> Column:
    return COLLAPSED_TYPE.first({"text": F.lower(T.strip(T.blank(label)))})


def base(screened: DataFrame) -> DataFrame:
    """The included records with their stated objective and where the model is named."""
    kept = screened.where(F.col("stage1_decision") == "include") if "stage1_decision" in screened.columns else screened
    return kept.withColumns({"objective_text": T.objective(_col("abstract", kept)), "bps_mention_location": T.bps_location(_col("title", kept), _col("abstract", kept))})


def triadic(bio: Column, psych: Column, social: Column) -> Column:
    return (bio == "yes") & (psych == "yes") & (social == "yes")


def code_by_rules(frame: DataFrame, *, batch_fallback: bool = False) -> DataFrame:
    """All fields of abstract coding by rules alone.

    ``batch_fallback`` codes as for records that an enricher has left out: with a typology, and high priority for
    musculoskeletal records.
    """
    text = T.blob(_col("title", frame), _col("abstract", frame))
    typed = F.lower(F.concat_ws(" ", text, _lists("publication_types", frame)))
    sets = (OBJECTIVE, FUNCTION, PAIN, CONCEPTS, QUALITY, *DOMAINS.values())
    scanned, own, found = one_scan(frame, {"text": text, "typed": typed}, sets)
    out = scanned.withColumns(
        {
            "review_type": REVIEW_TYPE.first(own),
            "objective_category": OBJECTIVE.first(own),
            "icd11_pain_category": PAIN.first(own),
            "bps_function": FUNCTION.first(own),
            "quality_assessment_reported": QUALITY.first(own),
            "psychological_concepts_detected": CONCEPTS.all(own),
            "theoretical_frameworks_detected": F.array().cast("array<string>"),
            "conceptual_problem_flags": F.array(F.lit("none")),
            **{f"{d}_mentioned": rules.first(own) for d, rules in DOMAINS.items()},
        }
    ).drop(found)
    out = out.withColumn("musculoskeletal_flag", MUSCULOSKELETAL.first({"pain": F.col("icd11_pain_category")}))
    flag = F.col("musculoskeletal_flag")
    whole = triadic(F.col("bio_mentioned"), F.col("psych_mentioned"), F.col("social_mentioned"))
    candidate = flag.isin("yes", "unclear")
    if batch_fallback:
        more = {
            "provisional_typology": F.when(whole, "multifactorial signal").otherwise("pseudo-bps or partial signal"),
            "stage3_priority": priority_of(flag),
            "coding_method": F.lit("llm_batch_fallback"),
            "coding_rationale": F.lit("Coded by rules, as the enricher's answer left this record out."),
        }
    else:
        more = {
            "provisional_typology": F.lit(""),
            "stage3_priority": F.when(candidate, "medium").otherwise("low"),
            "coding_method": F.lit("rule_based_fallback"),
            "coding_rationale": F.lit("Coded by rules, as no enricher was available."),
        }
    return out.withColumns({"objective_category_source": F.lit("rule_based_fallback"), "stage3_candidate": F.when(candidate, "yes").otherwise("no"), "llm_model": F.lit(""), **more})


def priority_of(flag: Column) -> Column:
    return F.when(flag == "yes", "high").when(flag == "unclear", "medium").otherwise("low")


def recode_domains(coded: DataFrame) -> DataFrame:
    """Domain mentions from what the text says, not from the model's name; the former ones stay as *_llm."""
    fields = [F.when(T.strip(T.blank(_col(c, coded).cast("string"))) != "", T.strip(_col(c, coded).cast("string"))) for c in ("title", "objective_text", "abstract")]
    said = F.lower(T.squeeze(F.regexp_replace(F.concat_ws(" ", *fields), f"(?iU){V.LEXICAL_ONLY}", " ")))
    out = coded
    for d in V.SUBSTANTIVE:
        out = out.withColumn(f"{d}_mentioned_llm", F.lower(T.strip(T.blank(_col(f"{d}_mentioned", coded)))))
    out = out.withColumns({f"{d}_mentioned": F.when(T.matches_any(said, p), "yes").otherwise("no") for d, p in V.SUBSTANTIVE.items()})

    def flag(suffix: str) -> Column:
        return F.when(triadic(*(F.col(f"{d}_mentioned{suffix}") for d in V.SUBSTANTIVE)), "yes").otherwise("no")

    return out.withColumns({"triadic_llm": flag("_llm"), "triadic_substantive": flag("")})


def typology(bio: Column, psych: Column, social: Column, function: Column) -> Column:
    """The signal that domains and function give together."""
    whole = test(lambda c: triadic(*(F.lower(T.strip(T.blank(c[d]))) for d in ("bio", "psych", "social"))))
    rules = RuleSet(
        (
            Rule("potential integrative signal", whole & equals("f", "explanatory framework", "organizing principle")),
            Rule("multifactorial signal", whole),
            Rule("rhetorical label signal", has("f", "rhetorical") | equals("f", "background framing", "conclusion")),
        ),
        ("pseudo-bps or partial signal",),
    )
    return rules.first({"bio": bio, "psych": psych, "social": social, "f": F.lower(T.strip(T.blank(function)))})


def with_typology(coded: DataFrame) -> DataFrame:
    return coded.withColumn("provisional_typology", typology(*(F.col(f"{d}_mentioned") for d in ("bio", "psych", "social")), F.col("bps_function")))


def problem_flags(flags: Column, kind: Column, function: Column, bio: Column, social: Column) -> Column:
    """Flags of an answer, without none, and those that its other fields imply; none if there are none."""
    kept = F.filter(T.normal_list(flags), lambda f: f != "none")
    weak = function.isin("background framing", "intervention rationale", "organizing principle", "unclear")
    none = F.array().cast("array<string>")

    def implied(when: Column, *names: str) -> Column:
        return F.when(when, F.array(*map(F.lit, names))).otherwise(none)

    found = F.array_distinct(
        F.concat(
            F.coalesce(kept, none),
            implied(kind.contains("rhetorical") | (function == "rhetorical label"), "tokenistic_bps", "vague_definition"),
            implied(kind.isin("multifactorial signal", "pseudo-bps or partial signal") & weak, "parallel_listing_without_integration", "mechanistic_absence"),
            implied(bio != "yes", "missing_biology"),
            implied(social != "yes", "missing_social"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found)


def _relevance(rules: tuple[Rule, ...], columns: dict[str, Column]) -> Column:
    """struct of priority and flags: high for what is withdrawn or not about pain, medium for any other flag."""
    flags = RuleSet(rules, ("",)).all(columns)
    grave = F.exists(flags, lambda f: f.isin("withdrawn_or_retracted_signal", "pain_focus_not_explicit"))
    return F.struct(F.when(grave, "high").when(F.size(flags) > 0, "medium").otherwise("low").alias("priority"), flags.alias("flags"))


_WITHDRAWN = Rule("withdrawn_or_retracted_signal", has("text", "withdrawn", "retracted"))
_NO_PAIN = Rule("pain_focus_not_explicit", ~has("text", "pain"))
FULLTEXT_RELEVANCE = (
    _WITHDRAWN,
    _NO_PAIN,
    Rule("chronicity_not_explicit", ~has("text", "chronic", "persistent", "long-term")),
    Rule("review_design_unclear", equals("type", "", "other evidence synthesis")),
)
AUDIT_RELEVANCE = (
    _WITHDRAWN,
    _NO_PAIN,
    Rule("chronicity_not_explicit", ~like("text", r"\b(?:chronic|persistent|long-term)\b")),
    Rule("pain_category_unclear", equals("pain", "unclear")),
    Rule("stage3_fulltext_manual_check_pending", equals("candidate", "yes") & equals("status", "", "manual_retrieval_required", "pmc_linked_fetch_failed", "pmc_fulltext_low_content_manual_check")),
)


def _low(c: Column) -> Column:
    return F.lower(T.strip(T.blank(c)))


def fulltext_relevance(title: Column, abstract: Column, review_type: Column) -> Column:
    return _relevance(FULLTEXT_RELEVANCE, {"text": T.blob(title, abstract), "type": _low(review_type)})


def audit_relevance(title: Column, abstract: Column, pain: Column, candidate: Column, status: Column) -> Column:
    return _relevance(AUDIT_RELEVANCE, {"text": T.blob(title, abstract), "pain": _low(pain), "candidate": _low(candidate), "status": T.strip(T.blank(status))})


# An earlier scheme, by counts of keywords.

V1_REVIEW_TYPE = RuleSet(rule_table(V.V1_REVIEW_TYPES), ("unclear",))
V1_OBJECTIVE = RuleSet(rule_table(V.V1_OBJECTIVES), ("unclear",))
V1_FUNCTION = RuleSet(rule_table(V.V1_FUNCTIONS), ("background_framing",))
V1_PAIN = RuleSet((*rule_table(V.V1_PAIN), Rule("mixed_or_unclear_chronic_pain", has("text", *V.UNSPECIFIED_PAIN))), ("unclear",))
V1_CONCEPTS = RuleSet(tuple(Rule(k, like("text", p)) for k, p in V.V1_CONCEPTS.items()), ("",))
V1_FRAMEWORKS = RuleSet(tuple(Rule(k, like("text", p)) for k, p in V.V1_FRAMEWORKS.items()), ("",))


def coverage(count: Column) -> Column:
    """How far a domain is covered, by the number of its keywords."""
    return F.when(count >= 4, "elaborated").when(count >= 2, "mentioned").when(count >= 1, "minimal").otherwise("absent")


def balance(bio: Column, psych: Column, social: Column, gap: float = 0.05) -> Column:
    """The leading domain, or balanced if the second is within the gap; the first named wins ties."""
    top, low = F.greatest(bio, psych, social), F.least(bio, psych, social)
    second = bio + psych + social - top - low
    return F.when(top - second < gap, "balanced").when(bio == top, "bio-dominant").when(psych == top, "psych-dominant").otherwise("social-dominant")


def v1_typology(coverages: dict[str, Column], loadings: dict[str, Column], function: Column) -> Column:
    cov = [coverages[d] for d in ("bio", "psych", "social")]
    present = sum(((c != "absent").cast("int") for c in cov), F.lit(0))
    elaborated = sum(((c == "elaborated").cast("int") for c in cov), F.lit(0))
    loaded = (loadings["bio"] > 0.08) & (loadings["psych"] > 0.08) & (loadings["social"] > 0.08)
    partial = (coverages["psych"] != "absent") & ((coverages["bio"] == "absent") | (coverages["social"] == "absent"))
    return (
        F.when(present <= 1, "narrow_despite_label")
        .when((elaborated >= 2) & loaded, "multifactorial")
        .when(function.isin("background_framing", "justification") & (coverages["social"] == "absent"), "rhetorical_bps")
        .when(partial, "pseudo_bps")
        .otherwise("multifactorial")
    )


def code_v1(frame: DataFrame) -> DataFrame:
    text = T.blob(_col("title", frame), _col("abstract", frame))
    own = {"text": text}
    pain = V1_PAIN.first(own)
    return frame.withColumns(
        {
            "review_type": V1_REVIEW_TYPE.first(own),
            "objective_category": V1_OBJECTIVE.first(own),
            "icd11_pain_category": pain,
            "musculoskeletal_flag": F.when(pain == "chronic_secondary_musculoskeletal_pain", "yes").when(pain.isin("unclear", "mixed_or_unclear_chronic_pain"), "unclear").otherwise("no"),
            "bps_function": V1_FUNCTION.first(own),
            "psychological_concepts": V1_CONCEPTS.all(own),
            "theoretical_frameworks": V1_FRAMEWORKS.all(own),
            **{f"domain_{d}": coverage(T.occurrences(text, V.V1_KEYWORDS[d])) for d in V.V1_KEYWORDS},
            "domain_spiritual_existential": F.when(T.contains_any(text, ("spiritual", "existential")), "mentioned").otherwise("absent"),
            "domain_lifestyle": F.when(T.contains_any(text, ("lifestyle", "physical activity")), "mentioned").otherwise("absent"),
        }
    )
