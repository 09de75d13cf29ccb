"""Columns of the tables that stages exchange."""

from __future__ import annotations

#: Records as sources give them: name and type, in order.
RECORD = (
    ("record_id", "string"), ("database", "string"), ("interface", "string"), ("query_key", "string"), ("query_label", "string"),
    ("search_date", "date"), ("retrieved_at_utc", "timestamp"), ("pmid", "string"), ("pmcid", "string"), ("doi", "string"),
    ("title", "string"), ("abstract", "string"), ("journal", "string"), ("publication_date", "string"), ("year", "int"),
    ("authors", "array<string>"), ("author_count", "int"), ("first_author", "string"), ("affiliations", "array<string>"),
    ("contact_author_country_guess", "string"), ("language", "array<string>"), ("publication_types", "array<string>"),
    ("keywords", "array<string>"), ("mesh_terms", "array<string>"), ("publication_status_flag", "string"), ("pubmed_url", "string"),
)
MANIFEST = (
    ("database", "string"), ("query_key", "string"), ("query_label", "string"), ("search_date", "date"), ("date_start", "date"),
    ("date_end", "date"), ("record_count", "int"), ("output_file", "string"),
)
MANIFEST_KEYS = ("database", "query_key", "search_date", "output_file")


def ddl(columns) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns)


LISTS = tuple(n for n, t in RECORD if t == "array<string>")
