"""Tables, logs and texts that stages leave behind."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.sources.files import write_csv

__all__ = ["append_log", "characteristics", "fragments", "latex_longtable", "latex_table", "write_csv", "write_json", "write_jsonl", "write_vectors"]

# Formats of table columns by name.
ONE_DIGIT, FOUR_DIGITS = ("percent",), ("mean_cosine", "mean_loading", "mean", "median_loading")
#: Rows that a printed table may have; more are an error, as they would all come to the driver.
MOST_ROWS = 10_000


def write_json(df: DataFrame, path: str) -> dict:
    """A one-row summary as an indented object in a local file."""
    row = df.first()
    made = row.asDict(recursive=True) if row else {}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f, ensure_ascii=False, indent=2, default=str)
    return made


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, run_id: str) -> None:
    """Adds rows to a log, with the run and the time."""
    df.withColumns({"run_id": F.lit(run_id), "logged_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}).write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    """Vectors by key; never by position."""
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def _cells(df: DataFrame) -> list[list[str]]:
    def shown(c: str):
        if c in ONE_DIGIT or c.endswith("_percent"):
            return F.format_string("%.1f", F.col(c).cast("double"))
        if c in FOUR_DIGITS:
            return F.format_string("%.4f", F.col(c).cast("double"))
        return F.col(c).cast("bigint").cast("string") if c == "n" else F.col(c).cast("string")

    rows = df.select(*(T.latex(F.when(F.col(c).isNotNull(), shown(c))).alias(c) for c in df.columns)).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a printed table of over {MOST_ROWS} rows")
    return [list(r) for r in rows]


def _escape(s: str) -> str:
    return "".join("\\" + c if c in "&%$#_{}" else c for c in s)


def _grid(df: DataFrame) -> tuple[list[str], list[str]]:
    return [_escape(c) for c in df.columns], [" & ".join(r) + r" \\" for r in _cells(df)]


def latex_table(df: DataFrame, caption: str, label: str, note: str) -> str:
    head, rows = _grid(df)
    body = ["No data available.\\\\"] if not rows else [f"\\begin{{tabular}}{{{'l' * len(head)}}}", r"\toprule", " & ".join(head) + r" \\", r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"]
    return "\n".join([r"\begin{table}[htbp]", r"\raggedright", f"\\caption{{{_escape(caption)}}}", f"\\label{{{label}}}", *body, f"\\caption*{{Note. {_escape(note)}}}", r"\end{table}", ""])


def latex_longtable(df: DataFrame, caption: str, label: str, note: str, colspec: str | None = None) -> str:
    head, rows = _grid(df)
    if not rows:
        return latex_table(df, caption, label, note)
    spec = colspec or "l" * len(head)
    top = [f"\\begin{{longtable}}{{{spec}}}", f"\\caption{{{_escape(caption)}}}\\label{{{label}}}\\\\", r"\toprule", " & ".join(head) + r" \\", r"\midrule", r"\endhead"]
    return "\n".join([*top, *rows, r"\bottomrule", r"\end{longtable}", f"\\par\\footnotesize Note. {_escape(note)}", r"\normalsize", ""])


def characteristics(coded: DataFrame, manifest: DataFrame | None = None, *, overrides: dict[str, int] | None = None) -> DataFrame:
    """A row an included record: label, short forms, domains and a description with where it comes from; oldest first."""
    rows = coded
    if manifest is not None:
        text = "text" if "text" in manifest.columns else None
        kept = manifest.select("record_id", *([F.col(text).alias("_fulltext")] if text else [])).dropDuplicates(["record_id"])
        rows = rows.join(kept, "record_id", "left")
    full = F.col("_fulltext") if "_fulltext" in rows.columns else F.lit("")
    authors = T.packed(F.col("authors")) if dict(rows.dtypes)["authors"].startswith("array") else F.col("authors")
    year = T.sort_year(F.col("record_id"), F.col("year"), overrides)
    said = T.describe(F.col("review_type"), F.col("title"), F.col("objective_text"), F.col("abstract"), full)
    shown = F.concat(T.author_label(authors), F.lit(" ("), F.when(year == 9999, "n.d.").otherwise(year.cast("string")), F.lit(")"))
    link = F.when(T.doi_url(F.col("doi")) != "", T.doi_url(F.col("doi"))).otherwise(T.pmid_url(F.col("pmid")))
    rows = rows.withColumns({"_year": year, "_said": said})
    return rows.select(
        "record_id",
        F.col("_year").alias("year"),
        F.when(link != "", F.concat(F.lit("\\href{"), link, F.lit("}{"), T.latex(shown), F.lit("}"))).otherwise(T.latex(shown)).alias("cite"),
        T.short_type(F.col("review_type")).alias("type"),
        T.relabel(F.col("icd11_pain_category"), T.SHORT_PAIN).alias("pain"),
        F.initcap(F.col("objective_category")).alias("objective"),
        F.concat(F.upper(F.substring("bps_function", 1, 1)), F.substring("bps_function", 2, 100)).alias("function"),
        T.relabel(F.col("provisional_typology"), T.SHORT_TYPOLOGY).alias("typology"),
        T.domain_cell(F.col("bio_mentioned"), F.col("psych_mentioned"), F.col("social_mentioned")).alias("domains"),
        F.col("_said.source").alias("description_source"),
        F.col("_said.description").alias("description"),
    ).orderBy("year", "record_id")


Template = str | Sequence[tuple[Callable[[dict[str, object]], bool] | None, str]]


def fragments(values: dict[str, object], templates: dict[str, Template]) -> dict[str, str]:
    """Text fragments with the values of aggregates put in.

    A template is a text, or texts with their conditions, of which the first that holds is taken (None always does). ``{n:,}`` and
    the like format a value; ``{n|record|records}`` gives the first word if the value is 1, else the second. No condition: an empty text.
    """
    out = {}
    for name, template in templates.items():
        ways = [(None, template)] if isinstance(template, str) else template
        text = next((t for holds, t in ways if holds is None or holds(values)), "")
        text = re.sub(r"\{(\w+)\|([^|{}]*)\|([^|{}]*)\}", lambda m: m[2] if values[m[1]] == 1 else m[3], text)
        out[name] = text.format(**values)
    return out

