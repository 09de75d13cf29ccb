"""Countries named in addresses."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as T

# Forms that are looked for first, between spaces, in this order.
SPECIAL = {
    "usa": "United States",
    "u.s.a.": "United States",
    "us": "United States",
    "u.s.": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "the netherlands": "Netherlands",
}


def country_names(spark: SparkSession) -> list[str]:
    """Names of all countries that the JVM's locale data knows."""
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    return sorted({locale("", c).getDisplayCountry(english) for c in locale.getISOCountries()})


def country(text: Column, names: list[str], forms: Mapping[str, str] | None = None) -> Column:
    """The first special form, or else the longest country name in the text; empty if there is none.

    forms: official, common or local names with the name that stands for them, looked for among the names; the JVM has none.
    """
    low = F.concat(F.lit(" "), F.lower(T.blank(text)), F.lit(" "))
    special = reduce(lambda rest, kv: F.when(low.contains(f" {kv[0]} "), kv[1]).otherwise(rest), reversed(list(SPECIAL.items())), F.lit(None).cast("string"))
    label_of = {n.lower(): n for n in sorted(set(names) | set(SPECIAL.values()))} | {f.lower(): n for f, n in (forms or {}).items()}
    ordered = sorted(label_of, key=lambda n: (-len(n), n))
    # One pattern finds candidates; the longest of them wins.
    pattern = r"(?U)\b(" + "|".join(map(_quoted, ordered)) + r")\b"
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    best = F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), 0)
    label = F.create_map(*(F.lit(x) for n in ordered for x in (n, label_of[n])))
    return F.coalesce(special, label[best], F.lit(""))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)
