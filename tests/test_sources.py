import re
import json

import pytest
from pyspark.sql import functions as F

from litmill import sinks
from litmill.functions import text as T
from litmill.operators import fulltext
from litmill.sources import files, places, services
from litmill.sources.schema import MANIFEST, RECORD, ddl


def text(spark, content, name="demo.ris"):
    return spark.createDataFrame([(name, name.split(".")[0], content)], "file string, stem string, text string")


def test_ris(spark):
    content = "stray\nTY  - JOUR\nTI  - A title\n  that goes on\n\nAU  - Ames, A\nAU  - Bo, B\nAB  - \nN2  - second\nPY  - 2019/03/\nLA  - eng\nER  - \nT1  - Only\nY1  - none\nER  - \nTI  - lost"
    a, b = files.parse_ris(text(spark, content)).orderBy("record_id").collect()
    assert (a["record_id"], a["title"], a["abstract"], a["year"], a["authors"], a["author_count"], a["database"]) == ("manual_demo_1", "A title that goes on", "", 2019, ["Ames, A", "Bo, B"], 2, "demo")
    assert (b["title"], b["year"], b["authors"], b["first_author"], b["publication_date"]) == ("Only", None, [], "", "none")
    assert [tuple(f) for f in files.parse_ris(text(spark, "")).collect()] == []


def test_nbib(spark):
    content = "PMID- 11\nTI  - One\n      goes on\nAU  - Cole C\nAID - 10.1/x [doi]\nAID - S1 [pii]\nDP  - 2018 May\nMH  - Pain\nMH  - Care\n   \n\nPMID- 12\nTA  - J\nDEP - 20170102\n"
    a, b = files.parse_nbib(text(spark, content, "demo.nbib")).orderBy("record_id").collect()
    assert (a["pmid"], a["title"], a["doi"], a["year"], a["mesh_terms"], a["pubmed_url"]) == ("11", "One goes on", "10.1/x [doi] S1 [pii]", 2018, ["Pain", "Care"], "https://pubmed.ncbi.nlm.nih.gov/11/")
    assert (b["journal"], b["year"], b["first_author"]) == ("J", 2017, "")


def test_csv_round_trip_and_missing_file(spark, tmp_path):
    row = [("1", 'He said "x",\nand more', ["a b", "c"], 2025, "12720511.0")]
    df = spark.createDataFrame(row, "record_id string, title string, authors array<string>, year int, pmid string")
    files.write_csv(df, f"{tmp_path}/t.csv")
    back = files.read_csv(spark, f"{tmp_path}/t.csv", RECORD).first()
    assert (back["title"], back["authors"], back["year"], back["pmid"], back["doi"]) == ('He said "x",\nand more', ["a b", "c"], 2025, "12720511", None)
    none = files.read_csv(spark, f"{tmp_path}/none.csv", RECORD)
    assert none.count() == 0 and none.columns == [n for n, _ in RECORD]


def test_folder_of_imports(spark, tmp_path):
    (tmp_path / "b.ris").write_text("TY  - JOUR\nTI  - R\nER  - \n")
    (tmp_path / "a.csv").write_text("record_id,title,extra\n9,C,x\n")
    (tmp_path / "c.nbib").write_text("PMID- 1\r\nTI  - N\r\n")
    (tmp_path / "d.docx").write_text("x")
    (tmp_path / ".hidden.csv").write_text("x")
    df, skipped = files.read_folder(spark, str(tmp_path))
    assert skipped == ["d.docx"] and {r["title"] for r in df.collect()} == {"R", "C", "N"} and df.columns == [n for n, _ in RECORD]
    assert files.read_folder(spark, f"{tmp_path}/none")[0].count() == 0
    assert files.with_text_blob(df).where("text_blob = 'c '").count() == 1


def test_manifest(spark):
    m = spark.createDataFrame([], ddl(MANIFEST))
    import datetime as dt

    def entry(day, file, n):
        return spark.createDataFrame([("PubMed", "q", "l", dt.date(2026, 4, day), None, None, n, file)], ddl(MANIFEST))

    for e in (entry(1, "a", 1), entry(7, "b", 2), entry(7, "b", 3)):
        m = services.register(m, e)
    assert m.count() == 2 and [r["output_file"] for r in files.active_files(m).collect()] == ["b"]
    assert m.where("output_file = 'b'").first()["record_count"] == 3


def article(body="", data="", pmid="7"):
    return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article>{body}</Article></MedlineCitation><PubmedData>{data}</PubmedData></PubmedArticle>"


def test_pubmed(spark):
    body = (
        "<Journal><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue><Title>J &amp; K</Title></Journal><ArticleTitle>H<sub>2</sub>O <i>x</i></ArticleTitle>"
        '<Abstract><AbstractText Label="AIM" NlmCategory="X">See.</AbstractText><AbstractText/><AbstractText>More.</AbstractText></Abstract>'
        "<AuthorList><Author><LastName>Dee</LastName><ForeName>Eva</ForeName><AffiliationInfo><Affiliation>Ghent, Belgium</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName><AffiliationInfo><Affiliation>Ghent, Belgium</Affiliation></AffiliationInfo></Author></AuthorList>"
        "<Language>eng</Language><PublicationTypeList><PublicationType>Published Erratum</PublicationType></PublicationTypeList>"
    )
    pages = spark.createDataFrame([(1, f"<S>{article(body, '<ArticleIdList><ArticleId IdType=\"pmc\">PMC1</ArticleId><ArticleId IdType=\"doi\">10.1/z</ArticleId></ArticleIdList>')}{article(pmid='')}</S>")], "page int, payload string")
    a, b = services.parse_pubmed(services.articles(pages), query_key="k").orderBy(F.desc("pmid")).collect()
    assert (a["record_id"], a["title"], a["abstract"], a["journal"], a["publication_date"], a["year"]) == ("pubmed_7", "H 2 O x", "AIM: See.\nMore.", "J & K", "1998 Dec-1999 Jan", 1998)
    assert (a["authors"], a["affiliations"], a["doi"], a["pmcid"], a["publication_status_flag"], a["language"]) == (["Eva Dee", "Group"], ["Ghent, Belgium"], "10.1/z", "PMC1", "correction_or_erratum", ["eng"])
    assert (b["record_id"], b["year"], b["publication_status_flag"], b["pubmed_url"]) == ("pubmed_unnamed", None, "none_detected", "")


def test_json_services(spark):
    wos = {"hits": [{"uid": "W1", "title": {"value": "T"}, "identifiers": {"doi": "d"}, "names": {"authors": [{"displayName": "", "wosStandard": "A, B"}, {"fullName": "C"}, {}]}, "source": {"sourceTitle": "J"}, "publishYear": 2020}, {"title": "Plain"}]}
    a, b = services.parse_wos(spark.createDataFrame([(2, json.dumps(wos))], "page int, payload string")).collect()
    assert (a["record_id"], a["title"], a["doi"], a["authors"], a["journal"], a["year"]) == ("W1", "T", "d", ["A, B", "C"], "J", 2020)
    assert (b["record_id"], b["title"], b["authors"]) == ("wos_2_2", "Plain", [])
    bib = {"Titles": [{"Type": "alt", "TitleFull": "x"}, {"Type": "main", "TitleFull": "Main"}], "Authors": [{"Name": {"NameFull": "N"}}, {"Name": {"Y1": "Y"}}], "PublicationYear": "2019"}
    eds = {"SearchResult": {"Data": {"Records": [{"RecordInfo": {"RecordID": "E", "BibRecord": {"BibEntity": bib}}, "Items": [{"Name": "Other", "Data": "o"}, {"Name": "Abstract", "Data": "Abs"}]}, {"RecordInfo": {"BibRecord": {"BibEntity": {"Titles": [{"Type": "alt", "TitleFull": "only"}]}}}}]}}}
    a, b = services.parse_eds(spark.createDataFrame([(1, json.dumps(eds))], "page int, payload string")).collect()
    assert (a["record_id"], a["title"], a["abstract"], a["authors"], a["year"]) == ("E", "Main", "Abs", ["N", "Y"], 2019)
    assert (b["record_id"], b["title"], b["abstract"]) == ("psycinfo_1_2", "only", None)


def test_paged_source_and_retries(spark):
    requests = services.page_requests(120, 100, most=50, q="x")
    assert [(r["page"], r["start"], r["limit"]) for r in requests] == [(1, 0, 50), (2, 50, 50), (3, 100, 50)]
    got = services.fetch(spark, lambda r: f"page {r['page']} of {r['q']}", requests, name="demo_pages").orderBy("page").collect()
    assert [r["payload"] for r in got] == ["page 1 of x", "page 2 of x", "page 3 of x"]
    tries, slept = [], []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    assert services.with_retries(flaky, {}, sleep=slept.append) == "ok" and slept == [0.8, 1.6]
    with pytest.raises(ZeroDivisionError):
        services.with_retries(lambda _: 1 / 0, {}, sleep=lambda _: None)
    assert services.access({"a": lambda: 1, "b": lambda: {}["key"], "c": lambda: 1 / 0}) == {"a": "ok", "b": "missing_credentials", "c": "failed: ZeroDivisionError"}


def test_countries(spark):
    names = places.country_names(spark)
    assert {"Belgium", "Guinea", "United States"} <= set(names)
    df = spark.createDataFrame([("Univ, Boston, MA USA",), ("Ghent, Belgium.",), ("Malabo, Equatorial Guinea",), ("In the UK now",), ("nowhere",), (None,)], "t string")
    assert [r[0] for r in df.select(places.country(F.col("t"), names)).collect()] == ["United States", "Belgium", "Equatorial Guinea", "United Kingdom", "", ""]
    forms = {"Kingdom of Belgium": "Belgium", "Czechia Republic": "Czechia", "Deutschland": "Germany"}
    one = spark.createDataFrame([("Ghent, Kingdom of Belgium",), ("Berlin, deutschland",), ("Ghent, Belgium",)], "t string")
    assert [r[0] for r in one.select(places.country(F.col("t"), names, forms)).collect()] == ["Belgium", "Germany", "Belgium"]


def test_full_texts(spark):
    c = spark.createDataFrame(
        [("1", "10", "PMC1", "Chronic pain", "medium"), ("2", "20", None, "Chronic pain", "medium"), ("3", "30", "", "Pain", "low"), ("4", None, "", "No match", "low"), ("5", "50", "PMC5", "Chronic pain", "high")],
        "record_id string, pmid string, pmcid string, title string, stage3_priority string",
    ).withColumns({"abstract": F.lit(""), "review_type": F.lit("systematic review"), "musculoskeletal_flag": F.lit("yes"), "year": F.lit(2020)})
    found = fulltext.resolve(c, spark.createDataFrame([("20", "PMC2")], "pmid string, linked string"), spark.createDataFrame([("3", "PMC3"), ("4", "none")], "record_id string, found string"))
    assert {r["record_id"]: (r["pmcid"], r["retrieval_source"]) for r in found.collect()} == {"1": ("PMC1", "stage2_existing_pmcid"), "2": ("PMC2", "pubmed_elink"), "3": ("PMC3", "europepmc"), "4": ("", "none"), "5": ("PMC5", "stage2_existing_pmcid")}
    xml = "<a><front><article-title>The <i>title</i></article-title></front><body><sec><title>Intro</title><p>%s</p></sec></body></a>"
    cache = spark.createDataFrame([("PMC1", xml % ("word " * 300))], "pmcid string, xml string")

    def client(k):
        if k == "PMC5":
            raise OSError("gone")
        return xml % ("word " * (300 if k == "PMC2" else 5))

    got = fulltext.fetch_missing(found, cache, client)
    assert {r["pmcid"]: r["error"] for r in got.collect()} == {"PMC2": None, "PMC3": None, "PMC5": "OSError: gone"}
    texts = cache.select("pmcid", fulltext.article_text(F.col("xml")).alias("text"), F.lit(True).alias("cached")).unionByName(got.where("xml is not null").select("pmcid", fulltext.article_text(F.col("xml")).alias("text"), F.lit(False).alias("cached")))
    assert texts.where("pmcid = 'PMC3'").first()["text"] == "The title\n\nIntro\nIntro word word word word word"
    m = fulltext.manifest(found, texts)
    status = {r["record_id"]: (r["fulltext_status"], r["manual_retrieval_needed"], r["manual_relevance_priority"]) for r in m.collect()}
    assert status == {"1": ("pmc_fulltext_cached", "no", "low"), "2": ("pmc_fulltext_fetched", "no", "low"), "3": ("pmc_fulltext_low_content_manual_check", "yes", "medium"), "4": ("manual_retrieval_required", "yes", "high"), "5": ("pmc_linked_fetch_failed", "yes", "medium")}
    assert [r["record_id"] for r in m.collect()][0] == "5"
    assert {r["fulltext_status"]: (r["n"], r["manual_retrieval_n"]) for r in fulltext.validation(m).collect()}["manual_retrieval_required"] == (1, 1)
    assert fulltext.manifest(found, texts, fetched=False).where("fulltext_status = 'pmc_open_available_not_cached'").count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 3, 33.333, 0.12345), (None, None, None, None)], "label string, n int, percent double, mean_loading double")
    tex = sinks.latex_table(df, "Shares 5%", "tab:x", "A_note")
    assert r"a \& b & 3 & 33.3 & 0.1235" in tex and r"\caption{Shares 5\%}" in tex and "\n &  &  &  \\\\" in tex and "A\\_note" in tex
    assert "No data available." in sinks.latex_table(df.where("false"), "c", "l", "n") and "No data" in sinks.latex_longtable(df.where("false"), "c", "l", "n")
    assert r"\begin{longtable}{llll}" in sinks.latex_longtable(df, "c", "l", "n")
    assert sinks.write_json(df.limit(1), f"{tmp_path}/x/s.json")["n"] == 3 and json.load(open(f"{tmp_path}/x/s.json"))["label"] == "a & b"
    for run in ("r1", "r2"):
        sinks.append_log(df, f"{tmp_path}/log", run)
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    sinks.write_jsonl(df, f"{tmp_path}/l")
    sinks.write_vectors(spark.createDataFrame([("k", [1.0, 2.0])], "k string, v array<double>"), f"{tmp_path}/v", "k", "v")
    assert spark.read.parquet(f"{tmp_path}/v").dtypes[1][1] == "array<float>"
    assert sinks.fragments({"n": 3}, {"a": "{n} records"}) == {"a": "3 records"}
    ways = {"a": [(lambda v: v["n"] == 0, "No records."), (lambda v: v["n"] < 1000, "{n} {n|record|records}."), (None, "{n:,} records.")], "b": [(lambda v: v["n"] > 5, "many")]}
    assert [sinks.fragments({"n": n}, ways) for n in (0, 1, 7, 12000)] == [{"a": a, "b": b} for a, b in (("No records.", ""), ("1 record.", ""), ("7 records.", "many"), ("12,000 records.", "many"))]
    coded = spark.createDataFrame([("1", "2021", "Ames, A | Bo, B", "10.1/x", "", "systematic review", "chronic primary pain", "clinical", "conclusion", "multifactorial signal", "yes", "no", "yes", "Coping skills in chronic pain care", "", ""), ("2", "", "C D", "", "9.0", "x", "y", "mixed", "unclear", "z", "no", "no", "no", "t", "", "")], "record_id string, year string, authors string, doi string, pmid string, review_type string, icd11_pain_category string, objective_category string, bps_function string, provisional_typology string, bio_mentioned string, psych_mentioned string, social_mentioned string, title string, abstract string, objective_text string")
    a, b = sinks.characteristics(coded, overrides={"none": 1}).collect()
    assert a["cite"] == "\\href{https://doi.org/10.1/x}{Ames \\& Bo (2021)}" and (a["type"], a["pain"], a["domains"], a["typology"]) == ("Systematic review", "Primary", "B, S", "Multifactorial")
    assert b["cite"] == "\\href{https://pubmed.ncbi.nlm.nih.gov/9/}{D (n.d.)}" and b["year"] == 9999
    assert T.SHORT_FUNCTION["rhetorical label"] == "rhetorical"


def test_settings_and_vectors(spark, tmp_path):
    import numpy as np

    from litmill.sources import config

    (tmp_path / "a.json").write_text('{"a": [1, "\u00e9"]}', encoding="utf-8")
    assert config.read_json(spark, f"{tmp_path}/a.json") == {"a": [1, "\u00e9"]}
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("paths:\n  out: x\n")
    (tmp_path / "none.yaml").write_text("# nothing\n")
    assert config.read_yaml(spark, f"{tmp_path}/a.yaml") == {"paths": {"out": "x"}} and config.read_yaml(spark, f"{tmp_path}/none.yaml") == {}
    np.save(tmp_path / "v.npy", np.array([[1, 2], [3, 4]], dtype="float32"))
    assert [tuple(r["vector"]) for r in config.read_vectors(spark, f"{tmp_path}/v.npy").orderBy("place").collect()] == [(1.0, 2.0), (3.0, 4.0)]


def test_full_texts_are_looked_for_by_requests(spark):
    import json

    from litmill.operators import fulltext

    def links(request):
        found = {"1": ["77", "78"], "2": []}[request["id"]]
        return json.dumps({"linksets": [{"linksetdbs": [{"linkname": "pubmed_pmc_refs", "links": ["9"]}, {"linkname": "pubmed_pmc", "links": found}]}]})

    def searches(request):
        if "10.1/bad" in request["query"]:
            raise OSError("no answer")
        assert request["query"] in ('EXT_ID:2 AND SRC:MED OR DOI:"10.1/b"', 'DOI:"10.1/d"')
        return json.dumps({"resultList": {"result": [{"id": "x"}, {"pmcid": "PMC5"}, {"pmcid": "PMC6"}]}})

    data = [("a", "1", "10.1/a", ""), ("b", "2", "10.1/b", None), ("c", "3", "", "PMC3"), ("d", "", "10.1/d", ""), ("e", None, "10.1/bad", ""), ("f", None, None, None)]
    c = spark.createDataFrame(data, "record_id string, pmid string, doi string, pmcid string")
    got = {r["record_id"]: (r["pmcid"], r["retrieval_source"]) for r in fulltext.resolve_by_requests(c, links, searches, tries=1).collect()}
    assert got == {"a": ("PMC77", "pubmed_elink"), "b": ("PMC5", "europepmc"), "c": ("PMC3", "stage2_existing_pmcid"), "d": ("PMC5", "europepmc"), "e": ("", "none"), "f": ("", "none")}
    assert fulltext.resolve_by_requests(c, None, None).where("pmcid <> ''").count() == 1


def test_elements_end_at_their_first_end_however_long(spark):
    xml = "<T>open <T a='1'/><T b='>'>x</T> <T>" + "<i>y</i>" * 50_000 + "</T><T\n>z</T><Tx>no</Tx><T>cut"
    one = spark.createDataFrame([(xml,)], "x string").select(services._element(F.col("x"), "T").alias("e"), services._elements(F.col("x"), "T").alias("l"))
    plain = list(re.finditer(r"(?s)<T(?:\s[^>]*)?(?<!/)>(.*?)</T>", xml))
    got = one.first()
    assert got["e"] == plain[0][1] and got["l"] == [m[0] for m in plain] and len(plain) == 3


def test_a_level_of_an_article_is_cut_out_once(spark):
    """Each expression that cuts an article out of its citation, or a citation out of the whole, stands in the plan once."""
    found = services.parse_pubmed(spark.createDataFrame([("<MedlineCitation></MedlineCitation>",)], "article string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<MedlineCitation(") == 1 and plan.count("<Article(") == 1 and plan.count("<AuthorList(") == 1


def test_full_texts_are_parsed_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    xml = [f"<a><front><article-title>T{i}</article-title></front></a>" if i % 3 else None for i in range(200)]
    held = []
    monkeypatch.setattr(fulltext, "PARSED", 16)
    monkeypatch.setattr(fulltext.pa, "array", lambda x, kind, make=pa.array: held.append(len(x)) or make(x, kind))
    assert fulltext._articles(make := pa.array(xml, pa.string())).to_pylist() == [f"T{i}" if i % 3 else None for i in range(200)] and len(make) == 200
    assert max(held[1:]) == 16
    assert fulltext._articles(pa.array([], pa.string())).to_pylist() == []
