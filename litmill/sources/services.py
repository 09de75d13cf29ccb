"""Records from search services: raw pages are fetched in tasks, kept, and parsed by column functions.

A client is any picklable callable from a request (a dict) to a text; it is given, so everything runs without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litmill.functions import text as T
from litmill.operators.relations import project, upsert
from litmill.operators.settled import settled
from litmill.sources.schema import MANIFEST, MANIFEST_KEYS, RECORD

Client = Callable[[dict], str]
# Tries of a request, and the pause after each, in seconds times its number.
TRIES, PAUSE = 4, 0.8


def with_retries(client: Client, request: dict, *, tries: int = TRIES, pause: float = PAUSE, sleep=time.sleep) -> str:
    """The answer of the first try that gives one; the last error otherwise."""
    for n in range(1, tries + 1):
        try:
            return client(request)
        except Exception:
            if n == tries:
                raise
            sleep(pause * n)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, request: dict):
        self.request = request


class _Reader(DataSourceReader):
    def __init__(self, client: Client, requests: Sequence[dict], pause: float):
        self.client, self.requests, self.pause = client, requests, pause

    def partitions(self):
        return [_Page(r) for r in self.requests]

    def read(self, partition):
        yield int(partition.request.get("page", 0)), with_retries(self.client, partition.request, pause=self.pause)


def page_source(client: Client, requests: Sequence[dict], *, name: str = "pages", pause: float = PAUSE) -> type[DataSource]:
    """A batch data source with a partition for each request: page, payload."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, payload string"

        def reader(self, schema):
            return _Reader(client, requests, pause)

    return Pages


def fetch(spark: SparkSession, client: Client, requests: Sequence[dict], *, name: str = "pages", pause: float = PAUSE) -> DataFrame:
    """page, payload of every request, asked now and written."""
    spark.dataSource.register(page_source(client, requests, name=name, pause=pause))
    return settled(spark.read.format(name).load())


def page_requests(total: int, size: int, most: int | None = None, **fixed) -> list[dict]:
    """Requests for all pages of a result; ``most`` is what a service allows for a page."""
    size = min(size, most or size)
    return [{**fixed, "page": i + 1, "start": i * size, "limit": size} for i in range(-(-total // size))]


# PubMed.

# The entities of XML.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _numbered(text: Column) -> Column:
    """Characters in place of their numbers, decimal or hexadecimal."""

    def one(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"^([0-9]{1,7}|x[0-9A-Fa-f]{1,6});", 1)
        number = F.when(code.startswith("x"), F.substring(code, 2, 6)).otherwise(F.hex(code.try_cast("bigint")))
        character = F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")
        return F.when(code == "", F.concat(F.lit("&#"), piece)).otherwise(F.concat(character, piece.substr(F.length(code) + 2, F.length(piece))))

    pieces = F.split(text, "&#")
    return F.when(F.contains(text, F.lit("&#")), F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), one), ""))).otherwise(text)


def inner_text(xml: Column) -> Column:
    """Text of a fragment with its tags gone."""
    t = _numbered(F.regexp_replace(T.blank(xml), r"<[^>]*>", " "))
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return T.squeeze(t)


def _first(name: str) -> str:
    """A pattern of the first element of a name: its inner XML, taken in runs without a tag, up to the first end."""
    return rf"<{name}(?:\s[^>]*)?(?<!/)>([^<]*+(?:<(?!/{name}>)[^<]*+)*+)</{name}>"


def _element(xml: Column, name: str) -> Column:
    """Inner XML of the first element of a name."""
    return F.regexp_extract(xml, _first(name), 1)


def _elements(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(_first(name)), F.lit(0))


def _texts(xml: Column, name: str) -> Column:
    return F.filter(F.transform(_elements(xml, name), inner_text), lambda t: t != "")


def articles(pages: DataFrame, column: str = "payload") -> DataFrame:
    """article: the XML of each article of the pages."""
    return pages.select(F.explode(_elements(F.col(column), "PubmedArticle")).alias("article"))


def parse_pubmed(found: DataFrame, *, query_key: str = "", query_label: str = "", search_date: str | None = None) -> DataFrame:
    """found: article. Records; text of mixed content is joined by spaces, parts of an abstract carry their labels."""
    # Each level is cut out once, as columns of its own that later ones read.
    staged = found.select(_element(F.col("article"), "MedlineCitation").alias("citation"), _element(F.col("article"), "PubmedData").alias("data"))
    staged = staged.withColumn("article", _element(F.col("citation"), "Article"))
    staged = staged.withColumns({"authors_xml": _element(F.col("article"), "AuthorList"), "date_xml": _element(_element(F.col("article"), "JournalIssue"), "PubDate")})
    staged = staged.withColumns({"title": inner_text(_element(F.col("article"), "ArticleTitle")), "pmid": inner_text(_element(F.col("citation"), "PMID"))})
    citation, data, article, author_list, date = (F.col(c) for c in ("citation", "data", "article", "authors_xml", "date_xml"))
    label = lambda e: F.regexp_extract(e, r"^<AbstractText[^>]*\sLabel=\"([^\"]*)\"", 1)
    labelled = F.transform(_elements(_element(article, "Abstract"), "AbstractText"), lambda e: F.struct(label(e).alias("label"), inner_text(e).alias("text")))
    part = lambda e: F.when(e["label"] != "", F.concat(e["label"], F.lit(": "), e["text"])).otherwise(e["text"])
    abstract = F.array_join(F.transform(F.filter(labelled, lambda e: e["text"] != ""), part), "\n")
    authors_xml = _elements(author_list, "Author")

    def name(a: Column) -> Column:
        whole = inner_text(_element(a, "CollectiveName"))
        return F.when(whole != "", whole).otherwise(T.squeeze(F.concat_ws(" ", inner_text(_element(a, "ForeName")), inner_text(_element(a, "LastName")))))

    authors = F.filter(F.transform(authors_xml, name), lambda n: n != "")
    places = F.array_distinct(_texts(author_list, "Affiliation"))
    year, medline = inner_text(_element(date, "Year")), inner_text(_element(date, "MedlineDate"))
    month, day = inner_text(_element(date, "Month")), inner_text(_element(date, "Day"))
    full = F.array_join(F.filter(F.array(year, month, day), lambda p: p != ""), "-")
    stated = F.when(year != "", full).otherwise(medline)
    types = _texts(_element(article, "PublicationTypeList"), "PublicationType")
    ids = _elements(_element(data, "ArticleIdList"), "ArticleId")
    of_kind = lambda k: F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(ids, lambda i: i.contains(f'IdType="{k}"')), inner_text), lambda t: t != ""), F.lit(-1)), F.lit(""))
    pmid, title = F.col("pmid"), F.col("title")
    low = F.transform(types, F.lower)
    flags = F.array_compact(F.array(
        F.when(F.exists(low, lambda t: t.contains("retracted")), "retracted_or_retraction_notice"),
        F.when(F.exists(low, lambda t: t.contains("corrected") | t.contains("erratum")), "correction_or_erratum"),
    ))
    made = {
        "record_id": F.when(pmid != "", F.concat(F.lit("pubmed_"), pmid)).otherwise(F.concat(F.lit("pubmed_"), F.substring(T.slug(title), 1, 40))),
        "database": F.lit("PubMed"), "interface": F.lit("MEDLINE via PubMed"), "query_key": F.lit(query_key), "query_label": F.lit(query_label),
        "search_date": F.lit(search_date), "retrieved_at_utc": F.current_timestamp(), "pmid": pmid, "pmcid": of_kind("pmc"), "doi": of_kind("doi"),
        "title": title, "abstract": abstract, "journal": inner_text(_element(_element(article, "Journal"), "Title")), "publication_date": stated,
        "year": F.when(year != "", year.try_cast("int")).otherwise(F.regexp_extract(medline, "((?:19|20)[0-9]{2})", 1).try_cast("int")),
        "authors": authors, "author_count": F.size(authors), "first_author": F.coalesce(F.get(authors, 0), F.lit("")), "affiliations": places,
        "language": _texts(article, "Language"), "publication_types": types, "keywords": _texts(_element(citation, "KeywordList"), "Keyword"),
        "mesh_terms": _texts(_element(citation, "MeshHeadingList"), "DescriptorName"),
        "publication_status_flag": F.when(F.size(flags) > 0, F.array_join(flags, " | ")).otherwise("none_detected"),
        "pubmed_url": T.pmid_url(pmid),
    }
    return project(staged.select(*(c.alias(n) for n, c in made.items())), RECORD)


# Services that answer in JSON.

WOS = """struct<hits: array<struct<uid: string, title: string, language: string, documentType: string,
  identifiers: struct<doi: string>, names: struct<authors: array<struct<displayName: string, wosStandard: string, fullName: string>>>,
  source: struct<sourceTitle: string, publishYear: string>, publishYear: string>>,
  metadata: struct<totalPages: int, total: int>>""".replace("\n", " ")
EDS = """struct<SearchResult: struct<Statistics: struct<TotalHits: int>, Data: struct<Records: array<struct<
  RecordInfo: struct<RecordID: string, BibRecord: struct<BibEntity: struct<DOI: string, Titles: array<struct<Type: string, TitleFull: string>>,
  Authors: array<struct<Name: struct<NameFull: string, Y1: string>>>, Source: struct<TitleFull: string>, PublicationDate: string, PublicationYear: string,
  Languages: string, DocumentType: string>>>, Items: array<struct<Name: string, Data: string>>>>>>>""".replace("\n", " ")


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _one(c: Column) -> Column:
    return F.when(T.blank(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def parse_wos(pages: DataFrame, *, query_key: str = "", search_date: str | None = None) -> DataFrame:
    """pages: page, payload. A title may be a text or an object with a value."""
    hits = pages.select("page", F.posexplode(F.from_json("payload", WOS)["hits"]).alias("n", "h"))
    h = F.col("h")
    titled = F.coalesce(F.get_json_object(h["title"], "$.value"), F.get_json_object(h["title"], "$.title"), h["title"])
    authors = F.filter(F.transform(F.coalesce(h["names"]["authors"], F.array()), lambda a: F.coalesce(_some(a["displayName"]), _some(a["wosStandard"]), _some(a["fullName"]))), lambda a: a.isNotNull())
    year = F.coalesce(h["publishYear"], h["source"]["publishYear"])
    made = {
        "record_id": F.coalesce(h["uid"], F.concat(F.lit("wos_"), F.col("page").cast("string"), F.lit("_"), (F.col("n") + 1).cast("string"))),
        "database": F.lit("Web of Science"), "interface": F.lit("Web of Science Starter API"), "query_key": F.lit(query_key), "query_label": F.lit(query_key),
        "search_date": F.lit(search_date), "retrieved_at_utc": F.current_timestamp(), "doi": h["identifiers"]["doi"], "title": titled, "journal": h["source"]["sourceTitle"],
        "publication_date": year, "year": T.year_of(year), "authors": authors, "author_count": F.size(authors), "first_author": F.coalesce(F.get(authors, 0), F.lit("")),
        "language": _one(h["language"]), "publication_types": _one(h["documentType"]),
    }
    return project(hits.select(*(c.alias(n) for n, c in made.items())), RECORD)


def parse_eds(pages: DataFrame, *, query_key: str = "", search_date: str | None = None) -> DataFrame:
    """pages: page, payload. The main title or else the first; the item named Abstract."""
    hits = pages.select("page", F.posexplode(F.from_json("payload", EDS)["SearchResult"]["Data"]["Records"]).alias("n", "h"))
    h = F.col("h")
    bib = h["RecordInfo"]["BibRecord"]["BibEntity"]
    main = F.get(F.filter(bib["Titles"], lambda t: t["Type"] == "main"), 0)["TitleFull"]
    title = F.coalesce(_some(main), F.get(bib["Titles"], 0)["TitleFull"], F.lit(""))
    authors = F.filter(F.transform(F.coalesce(bib["Authors"], F.array()), lambda a: F.coalesce(_some(a["Name"]["NameFull"]), _some(a["Name"]["Y1"]))), lambda a: a.isNotNull())
    made = {
        "record_id": F.coalesce(h["RecordInfo"]["RecordID"], F.concat(F.lit("psycinfo_"), F.col("page").cast("string"), F.lit("_"), (F.col("n") + 1).cast("string"))),
        "database": F.lit("PsycINFO"), "interface": F.lit("EBSCO EDS API"), "query_key": F.lit(query_key), "query_label": F.lit(query_key), "search_date": F.lit(search_date),
        "retrieved_at_utc": F.current_timestamp(), "doi": bib["DOI"], "title": title, "abstract": F.get(F.filter(h["Items"], lambda i: i["Name"] == "Abstract"), 0)["Data"],
        "journal": bib["Source"]["TitleFull"], "publication_date": bib["PublicationDate"], "year": T.year_of(bib["PublicationYear"]), "authors": authors,
        "author_count": F.size(authors), "first_author": F.coalesce(F.get(authors, 0), F.lit("")), "language": _one(bib["Languages"]), "publication_types": _one(bib["DocumentType"]),
    }
    return project(hits.select(*(c.alias(n) for n, c in made.items())), RECORD)


def register(manifest: DataFrame, entry: DataFrame) -> DataFrame:
    """The manifest with an entry, which replaces one of the same search and file."""
    return upsert(project(manifest, MANIFEST), project(entry, MANIFEST), MANIFEST_KEYS)


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc_nulls_last("year"), F.asc("title"), "record_id")


def access(probes: dict[str, Callable[[], object]]) -> dict[str, str]:
    """ok, missing_credentials or the error of each service; a probe raises KeyError for credentials that are not set."""
    out = {}
    for name, probe in probes.items():
        try:
            probe()
            out[name] = "ok"
        except KeyError:
            out[name] = "missing_credentials"
        except Exception as e:
            code = getattr(getattr(e, "response", None), "status_code", None)
            out[name] = f"http_{code}" if code else f"failed: {type(e).__name__}"
    return out
