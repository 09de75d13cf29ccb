"""Full texts of candidates: where they are, what came of fetching them, and what people have to look at."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litmill.functions import text as T
from litmill.operators import coding
from litmill.operators.relations import absent
from litmill.operators.settled import settled
from litmill.sources.services import TRIES, with_retries

# Words that a text needs to count as one, and outcomes that need a person.
LEAST_WORDS = 250
MANUAL = ("manual_retrieval_required", "pmc_linked_fetch_failed", "pmc_fulltext_low_content_manual_check")


def _last(rows: DataFrame, key: str, **columns: str) -> DataFrame:
    """A row a key: the last by ``ord`` if the rows have it, and of those the greatest, so that reruns agree."""
    order = [F.col("ord")] if "ord" in rows.columns else []
    best = F.max(F.struct(*order, *(F.col(c) for c in columns))).alias("_best")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"_best.{c}").alias(name) for c, name in columns.items()))


def resolve(candidates: DataFrame, links: DataFrame | None = None, searched: DataFrame | None = None) -> DataFrame:
    """Adds pmcid and retrieval_source: the record's own id, or that of a link by pmid, or of a search by record.

    links: pmid, linked; searched: record_id, found; of several for one key the last counts, by ord if there is one.
    """
    out = candidates
    own, linked, found = F.when(T.strip(T.blank(F.col("pmcid"))) != "", T.strip(F.col("pmcid"))), F.lit(None).cast("string"), F.lit(None).cast("string")
    if links is not None:
        out = out.join(_last(links, "pmid", linked="_linked"), "pmid", "left")
        linked = F.when(F.col("_linked") != "", F.col("_linked"))
    if searched is not None:
        out = out.join(_last(searched, "record_id", found="_found"), "record_id", "left")
        found = F.when(F.col("_found").startswith("PMC"), F.col("_found"))
    source = F.when(own.isNotNull(), "stage2_existing_pmcid").when(linked.isNotNull(), "pubmed_elink").when(found.isNotNull(), "europepmc").otherwise("none")
    return out.withColumns({"retrieval_source": source, "pmcid": F.coalesce(own, linked, found, F.lit(""))}).drop("_linked", "_found")


LINKS = "linksets array<struct<linksetdbs: array<struct<linkname: string, links: array<string>>>>>"
RESULTS = "resultList struct<result: array<struct<pmcid: string>>>"


def ask(rows: DataFrame, key: str, request: Column, client: Callable[[dict], str], *, workers: int = 4, tries: int = TRIES) -> DataFrame:
    """key, payload, error: one request a row, a map of strings; written, so that none is asked again by a later use."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, r in zip(f["key"], f["request"], strict=True):
                try:
                    row = (k, with_retries(client, dict(r), tries=tries), None)
                except Exception as e:
                    row = (k, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["key", "payload", "error"])

    wanted = rows.select(F.col(key).alias("key"), request.alias("request")).repartition(workers)
    return settled(wanted.mapInPandas(run, "key string, payload string, error string")).withColumnRenamed("key", key)


def linked(candidates: DataFrame, client: Callable[[dict], str], **how) -> DataFrame:
    """pmid, linked: the first full text that the links of a record without an own id name."""
    need = candidates.where((T.strip(T.blank(F.col("pmcid"))) == "") & (T.strip(T.blank(F.col("pmid"))) != "")).select(T.strip(F.col("pmid")).alias("pmid")).distinct()
    request = F.create_map(*map(F.lit, ("dbfrom", "pubmed", "db", "pmc", "retmode", "json", "id")), F.col("pmid"))
    found = F.flatten(F.transform(F.from_json("payload", LINKS)["linksets"], lambda s: F.coalesce(s["linksetdbs"], F.array())))
    first = F.get(F.filter(found, lambda d: (d["linkname"] == "pubmed_pmc") & (F.size(d["links"]) > 0)), 0)["links"]
    return ask(need, "pmid", request, client, **how).select("pmid", F.concat(F.lit("PMC"), F.get(first, 0)).alias("linked"))


def searched(candidates: DataFrame, client: Callable[[dict], str], **how) -> DataFrame:
    """record_id, found: the first full text that a search by pmid or DOI finds; a search that fails finds none."""
    pmid, doi = (T.strip(T.blank(F.col(c))) for c in ("pmid", "doi"))
    query = F.concat_ws(" OR ", F.when(pmid != "", F.concat(F.lit("EXT_ID:"), pmid, F.lit(" AND SRC:MED"))), F.when(doi != "", F.concat(F.lit('DOI:"'), doi, F.lit('"'))))
    need = candidates.where((pmid != "") | (doi != "")).select("record_id", query.alias("query"))
    request = F.create_map(*map(F.lit, ("format", "json", "pageSize", "5", "query")), F.col("query"))
    ids = F.transform(F.from_json("payload", RESULTS)["resultList"]["result"], lambda r: T.strip(T.blank(r["pmcid"])))
    return ask(need, "record_id", request, client, **how).select("record_id", F.get(F.filter(ids, lambda i: i.startswith("PMC")), 0).alias("found"))


def resolve_by_requests(candidates: DataFrame, links: Callable[[dict], str] | None, searches: Callable[[dict], str] | None, **how) -> DataFrame:
    """resolve() with what the given clients answer; the second is only asked for records that the first leaves open."""
    by_link = linked(candidates, links, **how) if links else None
    if searches is None:
        return resolve(candidates, by_link)
    still = resolve(candidates, by_link).where(F.col("pmcid") == "")
    return resolve(candidates, by_link, searched(still, searches, **how))


def fetch_missing(candidates: DataFrame, cache: DataFrame, client: Callable[[str], str], *, workers: int = 4) -> DataFrame:
    """pmcid, xml, error of the texts that the cache lacks, each fetched once, now, and written."""
    wanted = absent(candidates.where(F.col("pmcid") != "").select("pmcid").distinct(), cache, "pmcid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["pmcid"]:
                try:
                    row = (k, client(k), None)
                except Exception as e:
                    row = (k, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["pmcid", "xml", "error"])

    return settled(wanted.repartition(workers).mapInPandas(run, "pmcid string, xml string, error string"))


def _joined(node: ElementTree.Element | None) -> str:
    return "" if node is None else " ".join(t.strip() for t in node.itertext() if t.strip())


def _article(xml: str | None) -> str | None:
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None
    body = root.find(".//body")
    parts = [_joined(root.find(".//article-title"))]
    for section in body.iter("sec") if body is not None else ():
        title, whole = _joined(section.find("title")), _joined(section)
        parts.append(f"{title}\n{whole}" if title else whole)
    return "\n\n".join(p for p in parts if p) or _joined(body)


#: Texts that a task holds as Python objects at a time.
PARSED = 64


def _articles(xml: pa.Array) -> pa.Array:
    parts = [pa.array([_article(x) for x in xml.slice(at, PARSED).to_pylist()], pa.string()) for at in range(0, len(xml), PARSED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def article_text(xml: Column) -> Column:
    """Title, then each section's title and text, sections inside others again by themselves; the whole body where there
    are none. Null for what is no XML. Sections nest, which patterns can't follow, so a parser reads them in Arrow batches."""
    return F.arrow_udf(_articles, StringType())(xml)


def status(pmcid: Column, wanted: Column, cached: Column, text: Column, least: int = LEAST_WORDS) -> Column:
    """What came of a candidate's full text; ``text`` is null where fetching failed."""
    words = T.word_count(text)
    return (
        F.when(T.blank(pmcid) == "", "manual_retrieval_required")
        .when(~wanted, "pmc_open_available_not_cached")
        .when(text.isNull(), "pmc_linked_fetch_failed")
        .when(words < least, "pmc_fulltext_low_content_manual_check")
        .when(cached, "pmc_fulltext_cached")
        .otherwise("pmc_fulltext_fetched")
    )


def manifest(candidates: DataFrame, texts: DataFrame, *, fetched: bool = True) -> DataFrame:
    """candidates: resolved records; texts: pmcid, text, cached. One row a candidate, in the order of work."""
    j = candidates.join(_last(texts, "pmcid", text="text", cached="cached"), "pmcid", "left")
    j = j.withColumn("fulltext_status", status(F.col("pmcid"), F.lit(fetched), F.coalesce("cached", F.lit(False)), F.col("text")))
    need = F.col("fulltext_status").isin(*MANUAL)
    seen = coding.fulltext_relevance(F.col("title"), F.col("abstract"), F.col("review_type"))
    j = j.withColumns({"_seen": seen, "fulltext_word_count": F.coalesce(T.word_count(F.col("text")), F.lit(0)), "manual_retrieval_needed": F.when(need, "yes").otherwise("no")})
    priority = F.col("_seen.priority")
    j = j.withColumns({
        "manual_relevance_priority": F.when(need & (priority == "low"), "medium").otherwise(priority),
        "manual_relevance_flags": F.col("_seen.flags"),
        "osf_manual_adjudication_required": F.lit("yes"),
        "fulltext_checked_utc": F.current_timestamp(),
        "pubmed_url": T.pmid_url(F.col("pmid")),
    }).drop("_seen", "text", "cached")
    return j.orderBy("stage3_priority", F.desc("musculoskeletal_flag"), F.desc_nulls_first("year"), "title", "record_id")


def validation(made: DataFrame) -> DataFrame:
    """How many candidates came to what, with their mean length."""
    return made.groupBy("fulltext_status").agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg("fulltext_word_count"), F.lit(0.0)), 1).alias("mean_word_count"), F.count_if(F.col("manual_retrieval_needed") == "yes").alias("manual_retrieval_n")).orderBy("fulltext_status")
