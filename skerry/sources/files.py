"""Lists, tables and pages of other formats."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORE_PROVIDER


def endpoint_list(spark: SparkSession, path: str) -> DataFrame:
    """url: the lines of a list, trimmed, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def tsv(spark: SparkSession, path: str, schema: str, date_col: str | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A tab-separated table with a given schema; one column may be read as a date."""
    found = spark.read.schema(schema).option("sep", "\t").csv(path)
    return found.withColumn(date_col, F.try_to_timestamp(date_col, F.lit(date_format)).cast("date")) if date_col else found


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def core_providers(spark: SparkSession, path: str) -> DataFrame:
    """Provider files, one JSON object each; the string "null" as format is null."""
    found = spark.read.schema(CORE_PROVIDER).option("multiLine", "true").json(path)
    return found.withColumn("metadataFormat", F.nullif("metadataFormat", F.lit("null")))


def report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header whose lines end in carriage returns."""
    return spark.read.schema(schema).option("header", "true").option("lineSep", "\r").csv(path)


class _Tables(HTMLParser):
    """The cells of all tables, by row."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_tables(pages: DataFrame, html_col: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows of each page's only table, the header left out; a page with another number of tables is an error."""

    def run(frames):
        for f in frames:
            out = []
            for html in f[html_col]:
                parser = _Tables()
                parser.feed(html)
                if len(parser.tables) != 1:
                    raise ValueError(f"a page has {len(parser.tables)} tables, not one")
                out += [(row + [None] * len(columns))[: len(columns)] for row in parser.tables[0][1:] if row]
            yield pd.DataFrame(out, columns=list(columns))

    return pages.select(html_col).mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


class _Journals(HTMLParser):
    """Heading texts, and the second link of each paragraph of class archiveLinks."""

    def __init__(self):
        super().__init__()
        self.names, self.links, self.in_name, self.in_links = [], [], False, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "h3":
            self.in_name = True
            self.names.append("")
        elif tag == "p" and "archiveLinks" in (attrs.get("class") or "").split():
            self.in_links = True
            self.links.append([])
        elif tag == "a" and self.in_links:
            self.links[-1].append(attrs.get("href") or "")

    def handle_data(self, data):
        if self.in_name:
            self.names[-1] += data

    def handle_endtag(self, tag):
        if tag == "h3":
            self.in_name = False
        elif tag == "p":
            self.in_links = False


def journal_pages(pages: DataFrame, html_col: str) -> DataFrame:
    """name, homepage of the journals that index pages list."""

    def run(frames):
        for f in frames:
            out = []
            for html in f[html_col]:
                parser = _Journals()
                parser.feed(html)
                out += [(" ".join(n.split()), x[1]) for n, x in zip(parser.names, parser.links, strict=False) if len(x) > 1]
            yield pd.DataFrame(out, columns=["name", "homepage"])

    return pages.select(html_col).mapInPandas(run, "name string, homepage string")
