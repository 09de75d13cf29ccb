"""Records from files: delimited tables and the tagged formats of reference managers, parsed by column functions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as T
from litmill.operators.relations import project, stack
from litmill.sources import sheets
from litmill.sources.schema import LISTS, RECORD, ddl


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _typed(text: Column, name: str, kind: str) -> Column:
    """A cell's text as a column of records; blank is null, lists are packed by bars."""
    c = F.when(T.strip(text) != "", text)
    if kind.startswith("array"):
        return T.unpacked(c)
    if kind == "int":
        return T.year_of(c)
    if name == "pmid":
        return F.regexp_replace(c, r"\.0$", "")
    return c.try_cast(kind) if kind != "string" else c


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """Columns by name with their types; blank is null, lists are packed by bars. A missing path is an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl(columns))
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)

    return raw.select(*((_typed(F.col(n), n, t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in columns))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; lists are packed by bars."""
    packed = [T.packed(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*packed).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """file, stem, text: a row a file."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return t.select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def tagged_fields(record: Column, tag: str, value_from: Column) -> Column:
    """The tag, value pairs of a record: lines without a tag go on the line before; what is before the first tag is left out."""
    full = F.regexp_replace(record, r"(?m)^[^\S\n]*\n", "")
    joined = F.regexp_replace(F.regexp_replace(full, r"\s+$", ""), rf"\n(?!{tag})[^\S\n]*", " ")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike("^" + tag))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Z0-9]+)", 1).alias("tag"), T.strip(F.regexp_replace(x, "^" + value_from, "")).alias("value")))


def _of(fields: Column, *tags: str) -> Column:
    """Values of the first of the tags that is there."""

    def values(tag: str) -> Column:
        return F.transform(F.filter(fields, lambda f: f["tag"] == tag), lambda f: f["value"])

    lists = list(map(values, tags))
    out = lists[-1]
    for x in reversed(lists[:-1]):
        out = F.when(F.size(x) > 0, x).otherwise(out)
    return out


def _joined(fields: Column, *tags: str) -> Column:
    return F.array_join(_of(fields, *tags), " ")


def _year(c: Column) -> Column:
    return F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1).try_cast("int")


def _records(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    out = rows.select(*(c.alias(n) for n, c in made.items()))
    return project(out, RECORD)


RIS_TAG, NBIB_TAG = r"[A-Z0-9]{2}  - ", r"[A-Z]{2,4}\s*-\s"


def parse_ris(texts: DataFrame) -> DataFrame:
    """texts: file, stem, text. Records end at ER; what has no end is left out."""
    pieces = F.split("text", r"(?m)^ER  - ?.*$")
    rows = texts.select("file", "stem", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("n", "raw"))
    rows = rows.withColumn("f", tagged_fields(F.col("raw"), RIS_TAG, RIS_TAG))
    f = F.col("f")
    date = _joined(f, "PY", "Y1")
    authors = _of(f, "AU")
    return _records(rows, {
        "record_id": F.concat(F.lit("manual_"), "stem", F.lit("_"), (F.col("n") + 1).cast("string")),
        "database": F.col("stem"), "interface": F.lit("manual_import"), "query_key": F.lit("manual_import"), "query_label": F.col("file"),
        "doi": _joined(f, "DO"), "title": _joined(f, "TI", "T1"), "abstract": _joined(f, "AB", "N2"), "journal": _joined(f, "JO", "T2", "JF"),
        "publication_date": date, "year": _year(date), "authors": authors, "author_count": F.size(authors), "first_author": F.coalesce(F.get(authors, 0), F.lit("")),
        "language": _of(f, "LA"), "publication_types": _of(f, "TY"),
    })


def parse_nbib(texts: DataFrame) -> DataFrame:
    """texts: file, stem, text. Records end at a blank line or the file's end."""
    pieces = F.filter(F.split("text", r"\n[^\S\n]*\n\s*"), lambda p: T.strip(p) != "")
    rows = texts.select("file", "stem", F.posexplode(pieces).alias("n", "raw"))
    rows = rows.withColumn("f", tagged_fields(F.col("raw"), NBIB_TAG, r"[A-Z]{2,4}\s*-"))
    f = F.col("f")
    date, pmid, authors = _joined(f, "DP", "DEP"), _joined(f, "PMID"), _of(f, "AU")
    return _records(rows, {
        "record_id": F.concat(F.lit("manual_"), "stem", F.lit("_"), (F.col("n") + 1).cast("string")),
        "database": F.lit("PubMed_manual"), "interface": F.lit("manual_import"), "query_key": F.lit("manual_import"), "query_label": F.col("file"),
        "pmid": pmid, "pmcid": _joined(f, "PMC"), "doi": _joined(f, "AID"), "title": _joined(f, "TI"), "abstract": _joined(f, "AB"), "journal": _joined(f, "JT", "TA"),
        "publication_date": date, "year": _year(date), "authors": authors, "author_count": F.size(authors), "first_author": F.coalesce(F.get(authors, 0), F.lit("")),
        "affiliations": _of(f, "AD"), "language": _of(f, "LA"), "publication_types": _of(f, "PT"), "keywords": _of(f, "OT"), "mesh_terms": _of(f, "MH"),
        "pubmed_url": F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise(""),
    })


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    return parse_ris(_texts(spark, path))


def read_nbib(spark: SparkSession, path: str) -> DataFrame:
    return parse_nbib(_texts(spark, path))


def with_text_blob(records: DataFrame) -> DataFrame:
    """The view for keyword search: lists joined by semicolons, and title and abstract in one lower-case text."""
    out = records.withColumns({c: T.packed(F.col(c), "; ") for c in LISTS if c in records.columns})
    return out.withColumn("text_blob", F.lower(F.concat_ws(" ", T.blank(F.col("title")), T.blank(F.col("abstract")))))


def read_excel(spark: SparkSession, path: str, columns=RECORD) -> DataFrame:
    """A workbook's first sheet, as read_csv() reads a table."""
    kinds = dict(columns)
    return sheets.read_table(spark, path, [(n, "string") for n, _ in columns]).select(*(_typed(F.col(n), n, kinds[n]).alias(n) for n, _ in columns))


READERS = {".csv": lambda s, p: project(read_csv(s, p, RECORD), RECORD), ".ris": read_ris, ".nbib": read_nbib, ".xlsx": lambda s, p: project(read_excel(s, p), RECORD)}


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """All records of a folder's files, by their endings, and the names of files that no reader takes. Hidden files are left out."""
    if not exists(spark, folder):
        return spark.createDataFrame([], ddl(RECORD)), []
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = sorted(str(s.getPath().toString()) for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root))
    frames, skipped = [], []
    for path in listed:
        name = os.path.basename(path)
        reader = READERS.get(os.path.splitext(name)[1].lower())
        if name.startswith("."):
            continue
        if reader is None:
            skipped.append(name)
        else:
            frames.append(reader(spark, path))
    return (stack(frames) if frames else spark.createDataFrame([], ddl(RECORD))), skipped


def active_files(manifest: DataFrame) -> DataFrame:
    """output_file: of each database and query the last search's file, each once, in order."""
    from litmill.operators.relations import latest

    return latest(manifest, ("database", "query_key"), F.col("search_date"), F.col("output_file")).select("output_file").distinct().orderBy("output_file")


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)
