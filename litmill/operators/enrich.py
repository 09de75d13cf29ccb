"""Answers of models or services for records: asked in batches in tasks, parsed, checked and repaired by column functions.

An enricher is any picklable callable from a list of records (dicts) to the text of an answer. It is given; with none, or
where it fails, records are coded by rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.operators import coding
from litmill.operators import vocabulary as V
from litmill.operators.relations import latest, require_same_keys
from litmill.operators.settled import settled
from litmill.sources.services import with_retries

Enricher = Callable[[list[dict]], str]
# Records in a request, and requests at a time.
BATCH, WORKERS = 6, 4

ANSWER = (
    "record_id string, review_type string, objective_category string, icd11_pain_category string, icd11 string, musculoskeletal_flag string, "
    "bps_function string, bio_mentioned string, psych_mentioned string, social_mentioned string, quality_assessment_reported string, "
    "psychological_concepts_detected array<string>, psychological_concepts array<string>, theoretical_frameworks_detected array<string>, "
    "theoretical_frameworks array<string>, conceptual_problem_flags array<string>, provisional_typology string, stage3_candidate string, "
    "stage3_priority string, coding_rationale string"
)
CHOICES = {
    "review_type": V.REVIEW_TYPE_OPTIONS,
    "objective_category": V.OBJECTIVE_OPTIONS,
    "icd11_pain_category": V.PAIN_OPTIONS,
    "musculoskeletal_flag": ("yes", "no", "unclear"),
    "bps_function": V.FUNCTION_OPTIONS,
    "bio_mentioned": ("yes", "no"),
    "psych_mentioned": ("yes", "no"),
    "social_mentioned": ("yes", "no"),
    "quality_assessment_reported": ("yes", "no", "unclear"),
    "provisional_typology": V.TYPOLOGY_OPTIONS,
    "stage3_candidate": ("yes", "no"),
}


def ask(records: DataFrame, enricher: Enricher, fields: Sequence[str], *, batch: int = BATCH, workers: int = WORKERS, tries: int = 1) -> DataFrame:
    """answer, error, keys: a row a request, asked now and written, as requests cost and may be answered otherwise the next time.

    ``workers`` tasks ask, so that a service's limits hold.
    """
    fields = list(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []

        def send() -> tuple:
            keys = [r["record_id"] for r in waiting]
            try:
                row = (with_retries(lambda r: enricher(r["records"]), {"records": list(waiting)}, tries=tries), None, keys)
            except Exception as e:
                row = (None, f"{type(e).__name__}: {e}", keys)
            waiting.clear()
            return row

        columns = ["answer", "error", "keys"]
        for f in frames:
            got = []  # a frame of answers for each of records
            for r in zip(*(f[c].tolist() for c in fields), strict=True):
                waiting.append(dict(zip(fields, r, strict=True)))
                if len(waiting) == batch:
                    got.append(send())
            if got:
                yield pd.DataFrame(got, columns=columns)
        if waiting:
            yield pd.DataFrame([send()], columns=columns)

    return settled(records.select(*fields).repartition(workers).mapInPandas(run, "answer string, error string, keys array<string>"))


def answers(asked: DataFrame) -> DataFrame:
    """A row a record that an answer holds, the last of repeated ones; answers are an object with records, or a list."""
    blob = T.bare_json(F.col("answer"))
    listed = F.when(blob.startswith("["), F.from_json(blob, f"array<struct<{_struct(ANSWER)}>>")).otherwise(F.from_json(blob, f"struct<records: array<struct<{_struct(ANSWER)}>>>")["records"])
    each = asked.select(F.posexplode(listed).alias("n", "r")).select("n", "r.*").withColumn("record_id", T.strip(T.blank(F.col("record_id"))))
    return latest(each.where(F.col("record_id") != ""), ("record_id",), F.col("n")).drop("n")


def _read(asked: DataFrame) -> DataFrame:
    """keys, n, path, record (variant), fault: a row a record, or one with a fault for an answer that holds none."""
    whole = F.try_parse_json(T.blank(T.bare_json(F.col("answer"))))
    rows = asked.where("answer is not null").select("keys", "answer", whole.alias("whole"), F.monotonically_increasing_id().alias("at"))
    inner = F.try_variant_get("whole", "$.records", "array<variant>")
    form = F.when(F.col("whole").isNull(), "no JSON").when(F.schema_of_variant("whole").startswith("ARRAY"), "list").when(inner.isNotNull(), "records").otherwise("no records")
    rows = rows.withColumn("form", form)
    held = F.when(F.col("form") == "list", F.try_variant_get("whole", "$", "array<variant>")).when(F.col("form") == "records", inner)
    each = rows.where(F.col("form").isin("list", "records")).select("at", "keys", "form", F.posexplode(held).alias("n", "record"))
    path = F.concat(F.when(F.col("form") == "list", "$[").otherwise("$.records["), F.col("n").cast("string"), F.lit("]"))
    none = rows.where(~F.col("form").isin("list", "records")).select("at", "keys", F.lit(0).alias("n"), F.lit("$").alias("path"), F.lit(None).cast("variant").alias("record"), F.col("form").alias("fault"), F.col("answer").alias("raw"))
    return each.select("at", "keys", "n", path.alias("path"), "record", F.lit(None).cast("string").alias("fault"), F.to_json("record").alias("raw")).unionByName(none)


def sorted_answers(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed records, the last of repeated ones, and the quarantine: keys, path, reason, value of all that has not the form of an answer.

    A field of another type goes to the quarantine with its path, and the rest of its record stays, with null in its place.
    Records that are no objects or have no id, and answers that are no JSON (as those cut short) or hold no records, go as a
    whole. Fields that no answer should have are listed too, and are left out. asked: of ask(), written.
    """
    fields = [x.strip().split(" ", 1) for x in ANSWER.split(", ")]
    rows = settled(_read(asked))
    is_object = F.schema_of_variant("record").startswith("OBJECT")
    given = {name: F.try_variant_get("record", f"$.{name}", "variant") for name, _ in fields}
    empty = {name: v.isNull() | F.is_variant_null(v) for name, v in given.items()}
    typed = {name: F.try_variant_get("record", f"$.{name}", kind) for name, kind in fields}
    kind_of = {name: F.schema_of_variant(v) for name, v in given.items()}
    # A number or object is no text, though it can be cast to one; a list holds texts or nothing.
    right = {name: kind_of[name].isin("ARRAY<STRING>", "ARRAY<VOID>") if kind.startswith("array") else kind_of[name] == "STRING" for name, kind in fields}
    key = F.when(right["record_id"], T.strip(T.blank(typed["record_id"])))
    whole = F.when(F.col("fault").isNotNull(), F.col("fault")).when(~is_object, "no object").when(F.coalesce(key, F.lit("")) == "", "no record_id")
    rows = rows.withColumn("whole", whole)
    good = rows.where("whole is null")
    columns = [F.when(~empty[n] & right[n], typed[n]).alias(n) for n, _ in fields if n != "record_id"]
    made = latest(good.select("at", "n", key.alias("record_id"), *columns), ("record_id",), F.col("at"), F.col("n")).drop("at", "n")
    odd = [F.when(~empty[n] & ~right[n], F.struct(F.concat("path", F.lit(f".{n}")).alias("path"), F.concat(F.lit(f"no {kind}: "), F.lower(kind_of[n])).alias("reason"), F.to_json(given[n]).alias("value"))) for n, kind in fields]
    names = F.map_keys(F.try_variant_get("record", "$", "map<string, variant>"))
    unknown = F.transform(F.array_except(names, F.array(*(F.lit(n) for n, _ in fields))), lambda x: F.struct(F.concat("path", F.lit("."), x).alias("path"), F.lit("unknown field").alias("reason"), F.lit(None).cast("string").alias("value")))
    parts = good.select("keys", F.explode(F.concat(F.array_compact(F.array(*odd)), unknown)).alias("x")).select("keys", "x.*")
    return made, rows.where("whole is not null").select("keys", "path", F.col("whole").alias("reason"), F.col("raw").alias("value")).unionByName(parts)


def _struct(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in ddl.split(", ")))


def repair(base: DataFrame, answered: DataFrame) -> DataFrame:
    """All coded fields of the base's records: the answer's where they are allowed, else those of the rules."""
    ruled = coding.code_by_rules(base, batch_fallback=True)
    a = answered.select("record_id", F.lit(True).alias("_answered"), *(F.col(c).alias(f"_{c}") for c in answered.columns if c != "record_id"))
    j = ruled.join(a, "record_id", "left")
    raw = {c: F.col(f"_{c}") for c in answered.columns if c != "record_id"}
    raw["icd11_pain_category"] = F.coalesce(raw["icd11_pain_category"], raw["icd11"])
    none = F.array().cast("array<string>")
    made: dict[str, Column] = {c: T.choice(F.coalesce(raw[c], F.col(c)), options, F.col(c)) for c, options in CHOICES.items()}
    flag = made["musculoskeletal_flag"]
    wanted = flag.isin("yes", "unclear")
    made["stage3_candidate"] = F.when(wanted, "yes").otherwise(made["stage3_candidate"])
    made["stage3_priority"] = coding.priority_of(flag)
    made["psychological_concepts_detected"] = T.normal_list(F.concat(F.col("psychological_concepts_detected"), F.coalesce(raw["psychological_concepts_detected"], raw["psychological_concepts"], none)))
    made["theoretical_frameworks_detected"] = T.normal_list(F.coalesce(raw["theoretical_frameworks_detected"], raw["theoretical_frameworks"], none))
    stated = F.transform(F.coalesce(raw["conceptual_problem_flags"], none), lambda f: T.choice(f, V.PROBLEM_OPTIONS, F.lit("none")))
    made["conceptual_problem_flags"] = coding.problem_flags(stated, made["provisional_typology"], made["bps_function"], made["bio_mentioned"], made["social_mentioned"])
    made["coding_rationale"] = T.squeeze(F.coalesce(raw["coding_rationale"], F.col("coding_rationale")))
    given = F.coalesce(F.col("_answered"), F.lit(False))
    made["coding_method"] = F.when(given, "llm_structured").otherwise(F.col("coding_method"))
    # A record without an answer keeps the rules' fields as they are.
    return j.select(*(F.when(given, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in ruled.columns))


def violations(coded: DataFrame) -> DataFrame:
    """record_id, field, value: what is missing or not allowed."""
    odd = [F.when(F.col(c).isNull() | ~F.col(c).isin(*o), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, o in CHOICES.items()]
    odd.append(F.when(~F.col("stage3_priority").isin(*V.PRIORITY_OPTIONS), F.struct(F.lit("stage3_priority").alias("field"), F.col("stage3_priority").alias("value"))))
    odd.append(F.when(F.exists("conceptual_problem_flags", lambda f: ~f.isin(*V.PROBLEM_OPTIONS)), F.struct(F.lit("conceptual_problem_flags").alias("field"), T.packed(F.col("conceptual_problem_flags")).alias("value"))))
    return coded.select("record_id", F.explode(F.array_compact(F.array(*odd))).alias("x")).select("record_id", "x.*")


def code(base: DataFrame, enricher: Enricher | None = None, *, batch: int = BATCH, workers: int = WORKERS) -> tuple[DataFrame, DataFrame | None]:
    """Coded records and the log of requests; by rules alone without an enricher."""
    if enricher is None:
        return coding.code_by_rules(base), None
    fields = [c for c in ("record_id", "title", "abstract", "publication_types", "journal", "year") if c in base.columns]
    asked = ask(base, enricher, fields, batch=batch, workers=workers)
    coded = repair(base, answers(asked))
    require_same_keys(base, coded, "record_id")
    log = asked.select(F.size("keys").alias("records"), "keys", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")
    return coded, log


def prompt(records: list[dict], instructions: dict) -> str:
    """What an enricher may send: instructions with the allowed labels, and the records."""
    return json.dumps({**instructions, "options": {k: list(v) for k, v in CHOICES.items()}, "records": records}, ensure_ascii=False, default=str)


def pick_model(available: Sequence[str], named: str | None, default: str) -> str:
    """The named model, or else the first that the service offers of the small fast ones, or the default."""
    if named:
        return named
    fast = sorted((m for m in available if "gemini" in m and "flash" in m), reverse=True)
    return (fast or [m for m in available if "mini" in m] or [default])[0]


def embedder(client: Callable[[list[str]], list[list[float]]], batch: int = 32):
    """A function from a frame of record_id and text to record_id and vector; checks that every text has its vector."""

    def embed(rows: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), batch):
                    part = f.iloc[at : at + batch]
                    got = client(part["text"].tolist())
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    yield pd.DataFrame({"record_id": part["record_id"].tolist(), "vector": got})

        return rows.select("record_id", "text").mapInPandas(run, "record_id string, vector array<double>")

    return embed
