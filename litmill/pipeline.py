"""The stages of a review, each from tables of a workspace to tables of it.

A workspace is a folder in any store that Spark reads. Stages communicate by its tables only, so each can run alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators import agreement, coding, dedupe, enrich, frequency, fulltext, sampling, semantic
from litmill.operators.relations import alignment, project, stack
from litmill.sources import files
from litmill.sources.schema import MANIFEST, RECORD, ddl


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    window: tuple[dt.date, dt.date] = coding.WINDOW
    enricher: enrich.Enricher | None = None
    embed: Callable | None = None
    fetcher: Callable[[str], str] | None = None
    links: Callable[[dict], str] | None = None
    searches: Callable[[dict], str] | None = None
    made: list[str] = field(default_factory=list)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, columns=None) -> DataFrame:
        """A table; one that isn't there is empty if its columns are known."""
        if columns is not None and not files.exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], ddl(columns))
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.made.append(name)
        return self.read(name)


def deduplicate(w: Workspace) -> dict:
    """records/<search> tables that the manifest names as current, and manual imports, to combined and deduplicated records."""
    searches = w.read("search_manifest", MANIFEST)
    frames = [w.spark.read.parquet(w.path(r["output_file"])) for r in files.active_files(searches).collect() if files.exists(w.spark, w.path(r["output_file"]))]
    manual, skipped = files.read_folder(w.spark, w.path("manual_imports"))
    frames.append(manual)
    combined = w.write("combined_records", dedupe.rank_duplicates(stack([project(f, RECORD) for f in frames]), F.col("record_id")))
    w.write("deduplicated_records", combined.where(~F.col("is_duplicate")))
    return {**dedupe.audit(combined).first().asDict(), "skipped": skipped}


def prepare_screening(w: Workspace) -> dict:
    records = w.read("deduplicated_records")
    w.write("screening_queue", records.select("record_id", "title", "abstract", "year", "journal", "authors", "doi", "pmid", "database"))
    n = records.count()
    pilot = w.write("pilot_sample", sampling.sample(records, min(10, n), 42))
    form = w.write("stage1_double_screen", sampling.blank_form(sampling.sample(records, sampling.size(n), 7), ["reviewer_a_decision", "reviewer_b_decision", "reviewer_a_reason", "reviewer_b_reason", "adjudicated_decision", "adjudication_notes"]))
    return {"screening_queue_records": n, "pilot_screening_sample": pilot.count(), "stage1_double_screen_subset": form.count()}


def screen(w: Workspace) -> dict:
    out = w.write("stage1_screening", coding.screen(w.read("deduplicated_records"), window=w.window))
    w.write("stage1_summary", frequency.group_sizes(out, "stage1_decision", "stage1_reason"))
    return {r["stage1_decision"]: r["n"] for r in frequency.value_counts(out, "stage1_decision").collect()}


def extract(w: Workspace) -> dict:
    coded, log = enrich.code(coding.base(w.read("stage1_screening")), w.enricher)
    out = w.write("stage2_coding", coded)
    if log is not None:
        w.write("stage2_requests", log)
    form = ["reviewer_a_objective_category", "reviewer_b_objective_category", "reviewer_a_provisional_typology", "reviewer_b_provisional_typology", "reviewer_a_notes", "reviewer_b_notes", "adjudicated_objective_category", "adjudicated_typology"]
    w.write("stage2_double_code", sampling.blank_form(sampling.share_sample(out, 29, up=False), form))
    return {"stage2_records": out.count(), "violations": enrich.violations(out).count()}


def assist(w: Workspace) -> dict:
    """The enricher's coding by itself, for an audit: coded records, requests, and what is missing or not allowed."""
    if w.enricher is None:
        raise KeyError("enricher")
    coded, log = enrich.code(coding.base(w.read("stage1_screening")), w.enricher)
    out = w.write("stage2_llm_coding", coded.where(F.col("coding_method") == "llm_structured"))
    requests = w.write("stage2_llm_requests", log)
    odd = w.write("stage2_llm_violations", enrich.violations(out))
    return {"stage2_llm_rows": out.count(), "requests": requests.count(), "failed": requests.where(F.col("status") == "failed").count(), "violations": odd.count()}


def prepare_fulltexts(w: Workspace) -> dict:
    wanted = fulltext.resolve_by_requests(w.read("stage2_coding").where(F.col("stage3_candidate") == "yes"), w.links, w.searches)
    cache = w.read("fulltext_cache", (("pmcid", "string"), ("xml", "string")))
    texts = cache.select("pmcid", fulltext.article_text(F.col("xml")).alias("text"), F.lit(True).alias("cached"))
    if w.fetcher is not None:
        got = w.write("fulltext_fetched", fulltext.fetch_missing(wanted, cache, w.fetcher))
        texts = texts.unionByName(got.where("xml is not null").select("pmcid", fulltext.article_text(F.col("xml")).alias("text"), F.lit(False).alias("cached")))
    out = w.write("stage3_manifest", fulltext.manifest(wanted, texts))
    w.write("stage3_manual_queue", out.where(F.col("manual_retrieval_needed") == "yes"))
    w.write("stage3_validation", fulltext.validation(out))
    w.write("stage3_pilot", sampling.sample(out, 5, 13))
    sides = ["domain_coverage_bio", "domain_coverage_psych", "domain_coverage_social", "integration_triadic", "bps_typology", "notes"]
    w.write("stage3_double_code", sampling.blank_form(sampling.share_sample(out, 23, most=20, up=False), [f"reviewer_{r}_{s}" for r in "ab" for s in sides]))
    n = out.count()
    manual = out.where(F.col("manual_retrieval_needed") == "yes").count()
    return {"stage3_candidates": n, "pmc_open_fulltexts": n - manual, "manual_retrieval_required": manual}


def reliability(w: Workspace) -> dict:
    forms = {
        "stage1": ("stage1_double_screen", "reviewer_a_decision", "reviewer_b_decision"),
        "stage2": ("stage2_double_code", "reviewer_a_objective_category", "reviewer_b_objective_category"),
        "stage3": ("stage3_double_code", "reviewer_a_bps_typology", "reviewer_b_bps_typology"),
    }
    out = w.write("reliability_report", agreement.report({k: (w.read(t, (("record_id", "string"),)), a, b) for k, (t, a, b) in forms.items()}))
    return {r["stage"]: r["status"] for r in out.collect()}


def loadings(w: Workspace) -> dict:
    made = semantic.run(w.read("stage2_coding"), w.embed)
    for name in ("records", "parts", "domain_summary", "part_summary", "pairwise", "pairwise_summary", "dominance_by_review_type"):
        w.write(f"semantic_{name}", getattr(made, name))
    return {"method": made.method, "semantic_records": w.read("semantic_records").count()}


def tables(w: Workspace) -> dict:
    """The report's tables, from recoded domains and derived typologies."""
    coded = coding.with_typology(coding.recode_domains(w.read("stage2_coding")))
    coded = w.write("report_records", coded.withColumn("review_type_collapsed", coding.collapse_review_type(F.col("review_type"))))
    stage1, manifest, combined = w.read("stage1_screening"), w.read("stage3_manifest"), w.read("combined_records")
    yes = {d: F.col(f"{d}_mentioned") == "yes" for d in ("bio", "psych", "social")}
    core = {"Biological mention": yes["bio"], "Psychological mention": yes["psych"], "Social mention": yes["social"], "Triadic co-mention": yes["bio"] & yes["psych"] & yes["social"]}
    counts = w.write("pipeline_counts", frequency.pipeline_counts(combined, stage1, coded, manifest))
    made = {
        "database_counts": frequency.value_counts(combined, "database"),
        "review_type_counts": frequency.frequencies(coded, "review_type_collapsed", name="review_type"),
        **{f"{c}_counts": frequency.frequencies(coded, c) for c in ("icd11_pain_category", "bps_mention_location", "bps_function", "objective_category", "provisional_typology")},
        "core_structure": frequency.conditional_counts(coded, core),
        "musculoskeletal_scope": frequency.conditional_counts(coded.where(F.col("musculoskeletal_flag") == "yes"), {"Musculoskeletal reviews": F.lit(True), **core}),
        "concept_counts": frequency.label_counts(coded, F.col("psychological_concepts_detected"), name="psychological_concept"),
        "problem_counts": frequency.label_counts(coded, F.col("conceptual_problem_flags"), name="conceptual_problem_flag", without=("none",)),
        "year_counts": frequency.with_percent(coded.where("year is not null").groupBy("year").agg(F.count("*").alias("n"))).orderBy("year"),
        "triadic_by_review_type": frequency.crosstab(coded, "review_type_collapsed", "triadic_substantive", ["no", "yes"]),
        "fulltext_status": frequency.frequencies(manifest, "fulltext_status"),
        "flow_nodes": frequency.flow_nodes(counts, frequency.value_counts(combined, "database")),
        "alignment": alignment([("Stage 2 has all included records", coded, stage1.where(F.col("stage1_decision") == "include")), ("Stage 3 has all candidates", manifest, coded.where(F.col("stage3_candidate") == "yes"))]),
    }
    for name, df in made.items():
        w.write(name, df)
    return counts.first().asDict()


STAGES: dict[str, Callable[[Workspace], dict]] = {
    "dedupe": deduplicate,
    "prepare-screening": prepare_screening,
    "screen-stage1": screen,
    "extract-stage2": extract,
    "prepare-stage3": prepare_fulltexts,
    "reliability-report": reliability,
    "semantic-loading": loadings,
    "build-assets": tables,
}


def safely(step: Callable[[], dict]) -> dict:
    """A step's result, or why there is none: credentials that are not set are told from other failures."""
    try:
        return {"status": "ok", **(step() or {})}
    except KeyError as e:
        return {"status": "missing_credentials", "detail": str(e)}
    except Exception as e:
        return {"status": "failed", "detail": f"{type(e).__name__}: {e}"}


def run_all(w: Workspace, searches: dict[str, Callable[[], dict]] | None = None) -> dict:
    """Searches, of which some may fail, and then every stage."""
    return {name: safely(s) for name, s in (searches or {}).items()} | {name: stage(w) for name, stage in STAGES.items()}
