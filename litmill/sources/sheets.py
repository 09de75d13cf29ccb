"""Workbooks (xlsx) read by Spark: a file is a zip of XML parts, and a sheet is one of them.

Files come from any store that Spark reads, as bytes. A first pass takes a workbook apart into its sheets, with the shared
strings and the formats of dates that the cells refer to; then each sheet is a row that one task parses, row by row, as it
streams through the XML. So a folder of workbooks is read in as many tasks as it has sheets.

Cells are tall: path, sheet, sheet_no, row, col, kind, text. kind: text, number, date, boolean or error; a date's text is its ISO
form. A number's text is its shortest decimal form, without a point if it is whole. Empty cells have no row, and no more do
formulas without a kept value. Sheets of charts have no cells. A file that is no workbook is an error that names it.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators.settled import settled

PARTS = "path string, sheet string, sheet_no int, early boolean, xml binary, strings array<string>, dates array<boolean>"
CELLS = "path string, sheet string, sheet_no int, row bigint, col int, kind string, text string"
# Numbers of the built-in formats that are dates or times, and days from which they are counted.
DATE_FORMATS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))
EPOCH_1900, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(parent: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in parent.iter() if _plain(e.tag) == name]


def _said(item: ElementTree.Element) -> str:
    """Text of a string in runs, without readings of its characters."""
    skipped = {t for r in item.iter() if _plain(r.tag) == "rPh" for t in r.iter()}
    return "".join(t.text or "" for t in item.iter() if _plain(t.tag) == "t" and t not in skipped)


def is_date_format(code: str) -> bool:
    """Whether a format shows a part of a date or time, outside quoted text, colours and locales."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
    return bool(re.search("[ymdhs]", bare.replace("general", "")))


def _parts(path: str, content: bytes) -> Iterator[tuple]:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        main = ElementTree.fromstring(book.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"{path} is no workbook: {e}") from e
    read = lambda name: ElementTree.fromstring(book.read(name)) if name in names else ElementTree.Element("none")
    strings = [_said(s) for s in _children(read("xl/sharedStrings.xml"), "si")]
    styles = read("xl/styles.xml")
    own = {int(f.get("numFmtId", 0)): is_date_format(f.get("formatCode", "")) for f in _children(styles, "numFmt")}
    used = next((e for e in styles if _plain(e.tag) == "cellXfs"), ElementTree.Element("none"))
    formats = [int(x.get("numFmtId", 0)) for x in used]
    dates = [own.get(f, f in DATE_FORMATS) for f in formats]
    early = any(p.get("date1904") in ("1", "true") for p in _children(main, "workbookPr"))
    targets = {r.get("Id"): r.get("Target", "") for r in _children(read("xl/_rels/workbook.xml.rels"), "Relationship")}
    for n, sheet in enumerate(_children(main, "sheet")):
        target = targets.get(next((v for k, v in sheet.attrib.items() if _plain(k) == "id"), None), "")
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if name in names and "worksheets" in name:
            yield path, sheet.get("name"), n, early, book.read(name), strings, dates


def column_of(reference: str) -> int:
    """The place, from 0, of a reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def date_text(days: float, early: bool) -> str:
    if early:
        moment = EPOCH_1904 + datetime.timedelta(days=days)
    else:
        moment = EPOCH_1900 + datetime.timedelta(days=days + (days < 60))  # the calendar counts a 29 February 1900
    moment = (moment + datetime.timedelta(microseconds=500_000)).replace(microsecond=0) if moment.microsecond else moment
    if 0 <= days < 1 and not early:
        return moment.time().isoformat()
    return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(sep=" ")


def number_text(value: str) -> str:
    x = float(value)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _cell(cell: ElementTree.Element, strings: list[str], dates: list[bool], early: bool) -> tuple[str, str] | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "text", _said(cell)
    value = next((v.text for v in cell if _plain(v.tag) == "v"), None)
    if value is None or value == "":
        return None
    if kind == "s":
        return "text", strings[int(value)]
    if kind == "str":
        return "text", value
    if kind == "b":
        return "boolean", "true" if value in ("1", "true") else "false"
    if kind == "e":
        return "error", value
    if kind == "d":
        return "date", value.replace("T", " ").removesuffix(" 00:00:00")
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        return "date", date_text(float(value), early)
    return "number", number_text(value)


def _cells(path, sheet, n, early, xml, strings, dates) -> Iterator[tuple]:
    row, col = 0, -1
    for event, e in ElementTree.iterparse(io.BytesIO(xml), events=("start", "end")):
        name = _plain(e.tag)
        if event == "start" and name == "row":
            row, col = int(e.get("r", row + 1)), -1
        elif event == "end" and name == "c":
            col = column_of(e.get("r")) if e.get("r") else col + 1
            found = _cell(e, strings, dates, early)
            if found:
                yield path, sheet, n, row, col, *found
        elif event == "end" and name == "row":
            e.clear()


def _mapped(df: DataFrame, ddl: str, work, most: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        held = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                for made in work(*(c[i].as_py() for c in b.columns)):
                    held.append(made)
                    if len(held) >= most:
                        yield batch()
                        held = []
        if held:
            yield batch()

    return df.mapInArrow(run, ddl)


def sheet_cells(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """path, sheet, sheet_no, row (from 1), col (from 0), kind, text of all workbooks of a path, or of the sheets named."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = _mapped(files, PARTS, _parts, 1)
    if sheets is not None:
        parts = parts.where(F.col("sheet").isin(*sheets))
    return _mapped(parts.repartition("path", "sheet_no"), CELLS, _cells, 4096)


def read_table(spark: SparkSession, path: str, columns: list[tuple[str, str]], *, sheet: str | None = None) -> DataFrame:
    """A sheet's rows as a table of the columns asked for: the first row with a cell names them. The first sheet if none is named.

    columns: names and types; a text that is none of the type is null. Columns that the sheet lacks are null, and so are cells
    that are empty or errors. Rows without a cell are left out. Of two columns of one name the first counts.
    """
    cells = sheet_cells(spark, path, None if sheet is None else [sheet])
    first = cells.groupBy(F.col("path").alias("of")).agg(F.min("sheet_no").alias("first"))  # a row a file
    cells = cells.join(first, (F.col("path") == F.col("of")) & (F.col("sheet_no") == F.col("first"))).drop("of", "first", "sheet_no")
    top = cells.groupBy(F.col("path").alias("of")).agg(F.min("row").alias("top"))
    cells = settled(cells.join(top, F.col("path") == F.col("of")).drop("of"))
    names = cells.where(F.col("row") == F.col("top")).groupBy("path", F.trim("text").alias("name"), "col").agg(F.count("*"))
    names = names.groupBy("path", "name").agg(F.min("col").alias("col"))
    body = cells.where((F.col("row") > F.col("top")) & (F.col("kind") != "error")).join(names, ["path", "col"])
    rows = body.groupBy("path", "row").agg(*(F.max(F.when(F.col("name") == n, F.col("text"))).alias(n) for n, _ in columns))
    return rows.select(*((F.col(f"`{n}`") if kind == "string" else F.col(f"`{n}`").try_cast(kind)).alias(n) for n, kind in columns))
