"""Workbooks, and searches that stop and go on."""

import datetime
import json
import time
import zipfile
from xml.sax.saxutils import escape

import pytest

from litmill.sources import files, sheets
from litmill.streaming import pages

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(ref, value, strings):
    """A cell as workbooks hold it; dates have style 1, times style 2."""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime.datetime):
        days = (value - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
        return f'<c r="{ref}" s="2"><v>{days!r}</v></c>'
    if isinstance(value, datetime.date):
        return f'<c r="{ref}" s="1"><v>{(value - datetime.date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if value.startswith("inline "):
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    if value.startswith("#"):
        return f'<c r="{ref}" t="e"><v>{value}</v></c>'
    if value.startswith("="):
        return f'<c r="{ref}" t="str"><f>1</f><v>{escape(value[1:])}</v></c>'
    strings.setdefault(value, len(strings))
    return f'<c r="{ref}" t="s"><v>{strings[value]}</v></c>'


def letters(n):
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def workbook(path, tables):
    strings, parts = {}, {}
    for i, rows in enumerate(tables.values()):
        body = "".join(f'<row r="{r}">{"".join(cell(f"{letters(c)}{r}", v, strings) for c, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(rows, 2))
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'
    named = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(tables))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{named}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(tables))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>"
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="[Red]0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_cells_of_all_kinds(spark, tmp_path):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2024, 3, 1, 13, 30)
    workbook(tmp_path / "a.xlsx", {"first & one": [["Têtle", 3, 2.5, None, True], [day, moment, "inline  x ", "#N/A", "=said"]], "second": [[None] * 27 + ["far"]]})
    got = sheets.sheet_cells(spark, str(tmp_path))
    assert {(r["sheet"], r["row"], r["col"], r["kind"], r["text"]) for r in got.collect()} == {
        ("first & one", 2, 0, "text", "Têtle"), ("first & one", 2, 1, "number", "3"), ("first & one", 2, 2, "number", "2.5"), ("first & one", 2, 4, "boolean", "true"),
        ("first & one", 3, 0, "date", "2024-02-29"), ("first & one", 3, 1, "date", "2024-03-01 13:30:00"), ("first & one", 3, 2, "text", "inline  x "),
        ("first & one", 3, 3, "error", "#N/A"), ("first & one", 3, 4, "text", "said"), ("second", 2, 27, "text", "far"),
    }
    assert sheets.sheet_cells(spark, str(tmp_path), ["second"]).count() == 1


def test_formats_and_dates():
    assert [sheets.is_date_format(x) for x in ("General", "0.00", "yyyy", '0 "days"', "[Red]0", "[h]:mm", "d-mmm", "@", "[$-409]m/d")] == [False, False, True, False, False, True, True, False, True]
    assert [sheets.date_text(x, False) for x in (1, 59, 61, 45352.5, 0.25)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-03-01 12:00:00", "06:00:00"]
    assert sheets.date_text(0, True) == "1904-01-01"
    assert [sheets.column_of(x) for x in ("A1", "Z9", "AA1", "XFD7")] == [0, 25, 26, 16383]


def test_a_table_comes_back_typed(spark, tmp_path):
    head = ["name", "n", "share", "day", "ok", "name"]
    rows = [[f"row {i}" if i % 7 else None, i, i / 8, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), i % 2 == 0, "later"] for i in range(300)] + [[None] * 6, ["x", "none", "#DIV/0!", None, None, None]]
    workbook(tmp_path / "t.xlsx", {"t": [head, *rows], "u": [["n"], [5]]})
    columns = [("name", "string"), ("n", "bigint"), ("share", "double"), ("day", "date"), ("ok", "boolean"), ("absent", "string")]
    got = sheets.read_table(spark, f"{tmp_path}/t.xlsx", columns)
    assert [(n, t) for n, t in got.dtypes] == columns
    want = [(r[0], r[1], r[2], r[3], r[4], None) for r in rows[:300]] + [("x", None, None, None, None, None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert [tuple(r) for r in sheets.read_table(spark, f"{tmp_path}/t.xlsx", [("n", "int")], sheet="u").collect()] == [(5,)]


def test_workbooks_among_manual_imports(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"s": [["record_id", "title", "year", "pmid", "authors"], ["r1", "On pain", 2021, 12720511, "A B | C D"]]})
    df, skipped = files.read_folder(spark, str(tmp_path))
    r = df.first()
    assert skipped == [] and (r["record_id"], r["title"], r["year"], r["pmid"], r["authors"]) == ("r1", "On pain", 2021, "12720511", ["A B", "C D"])
    (tmp_path / "b.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="is no workbook"):
        sheets.sheet_cells(spark, f"{tmp_path}/b.xlsx").count()


def waited(query, enough, most=90):
    began = time.time()
    while not enough():
        if query.exception():
            raise query.exception()
        assert time.time() - began < most
        time.sleep(0.2)


@pytest.mark.parametrize("kind", ["page", "cursor"])
def test_a_stopped_search_goes_on(spark, tmp_path, kind):
    log, total = tmp_path / "log", 9
    log.mkdir()

    def client(request):
        n = int(request["page"] if kind == "page" else request["cursor"].replace("*", "1"))
        (log / f"{n}-{time.time_ns()}").touch()
        return json.dumps({"n": n, "next": str(n + 1) if n < total else None, "term": request["term"]})

    def start():
        if kind == "page":
            df = pages.page_stream(spark, client, lambda: total, a_batch=2, term="pain", pause=0)
        else:
            df = pages.cursor_stream(spark, client, lambda payload: json.loads(payload)["next"], term="pain", pause=0)
        return df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="100 milliseconds").start(f"{tmp_path}/out")

    def found():
        try:
            return sorted(r["page"] for r in spark.read.schema(pages.SCHEMA).parquet(f"{tmp_path}/out").collect())
        except Exception:  # nothing is written yet
            return []

    query = start()
    waited(query, lambda: len(found()) >= 3)
    query.stop()
    before = found()
    asked = {int(p.name.split("-")[0]) for p in log.iterdir()}
    assert 3 <= len(before) < total or asked == set(range(1, total + 1))
    for p in log.iterdir():
        p.unlink()
    query = start()
    waited(query, lambda: len(found()) >= total)
    time.sleep(1)
    query.stop()
    assert found() == list(range(1, total + 1))
    payloads = {r["page"]: json.loads(r["payload"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert all(p["n"] == n and p["term"] == "pain" for n, p in payloads.items())
    again = {int(p.name.split("-")[0]) for p in log.iterdir()}
    assert len(again & set(before)) <= 1  # what was under way when it stopped
