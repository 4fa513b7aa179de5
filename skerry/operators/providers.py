"""Content providers from the texts of a directory's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the entries.
LABELS = {
    "url": "URL:", "continent": "Continent:", "country": "Country:", "type": "Type:", "system": "System:", "in_base_since": "In BASE since:", "base_url": "BASE URL:",
    "coordinates": "Latitude/Longitude:",
}


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def some(c: Column) -> Column:
    return F.when(c != "", c)


def field(text: Column, label: str) -> Column:
    """What follows a label on its line or, if nothing does, on the next; the label's case doesn't matter."""
    return some(squeezed(F.regexp_extract(text, rf"(?i)(?<![A-Za-z ]){label}\s*(.+?)(?=\n|$)", 1)))


def providers(entries: DataFrame, name: str = "name", details: str = "details") -> DataFrame:
    """name and the fields of each entry; empty ones are null."""
    text = F.col(details)
    return entries.select(
        some(squeezed(F.get(F.split(name, "Further information"), F.lit(0)))).alias("name"),
        *(field(text, label).alias(column) for column, label in LABELS.items()),
        some(F.regexp_extract(text, r"Number of documents:\s*(\d+(?:[.,]\d+)*)", 1)).alias("document_count"),
        some(squeezed(F.regexp_extract(text, r"davon Open Access[^:]*:\s*([^(]+(?:\([^)]+\))?)", 1))).alias("open_access_info"),
        some(F.regexp_extract(text, r"https://ror\.org/\S+", 0)).alias("ror"),
    )


def registry_endpoint(fields: Column) -> Column:
    """Of a registry entry's (label, link) pairs, the link labelled OAI-PMH URL, if it is one."""
    own = F.filter(fields, lambda f: (f["label"] == "OAI-PMH URL") & f["link"].startswith("http"))
    return F.get(own, F.lit(0))["link"]
