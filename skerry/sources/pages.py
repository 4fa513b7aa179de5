"""Cached response pages: files named <date>-<serial>.xml.gz or .zst, in a directory per set, format and endpoint.

The reader's line separator is the end tag of a response's list, so a file is streamed response by response
however many it holds, and files of several documents (packed ones) lose nothing. Records are cut out of a
response where their tags balance: a payload may hold ``record`` elements of its own, as MARCXML does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.protocol import directory_parts, page_date
from ..schemas import DC, RECORD

SUFFIXES = "*.xml.{gz,zst}"
END = "</ListRecords>"
#: Levels of elements of one name within each other that a cut keeps together.
NESTED = 4
#: Entities that XML knows; others are kept as text.
_UNKNOWN = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"
#: Spark's parser makes null of an element that is empty or white space, so one gets this noncharacter while it is parsed.
_BLANK = "\ufdd0"
_EMPTY = rf"(<(?:[\w.-]++:)?+(?:{'|'.join(DC.names)})(?:\s[^>]*+)?+(?<!/)>)(?=\s*+</)"


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, date, bytes of each finished page below ``root``: metadata only, nothing is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), page_date(name).alias("date"), F.col("length").alias("bytes"))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """directory, set, format, url, files, bytes, last_date: a row for each harvest; names that aren't keys are left out."""
    files = page_files(spark, root)
    directory = F.element_at(F.split("path", "/"), -2)
    parts = directory_parts(F.col("directory"))
    found = files.groupBy(directory.alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("date").alias("last_date"))
    found = found.withColumn("parts", parts).filter("parts is not null")
    return found.select("directory", F.get("parts", F.lit(0)).alias("set"), F.get("parts", F.lit(1)).alias("format"), F.get("parts", F.lit(2)).alias("url"), "files", "bytes", "last_date")


def find_endpoints(known: DataFrame, fragment: str) -> DataFrame:
    """Endpoints of a catalog whose URL contains ``fragment``."""
    return known.filter(F.contains("url", F.lit(fragment))).select("url").distinct()


def _balanced(tag: str, levels: int) -> str:
    """Pattern of an element with its end tag, ``levels`` of its own name inside. All loops are possessive: Java
    runs these without recursion, and none goes back."""
    start, end = rf"<{tag}(?:\s[^>]*+)?+(?<!/)>", rf"</{tag}\s*+>"
    empty = rf"<{tag}(?:\s[^>]*+|/)>(?<=/>)"
    other = rf"[^<]*+(?:(?:<!\[CDATA\[.*?\]\]>|<!--.*?-->|{empty}|<(?!/?{tag}[\s>/]))[^<]*+)*+"
    if not levels:
        return rf"{start}{other}{end}"
    return rf"{start}{other}(?:{_balanced(tag, levels - 1)}{other})*+{end}"


def split_elements(text: Column, tag: str, levels: int = NESTED) -> Column:
    """All outermost elements of a name in a text, at any depth, however many documents it holds. Elements of the
    same name inside, up to ``levels`` deep, stay part of the outer one; tags in comments and CDATA don't count."""
    return F.regexp_extract_all(text, F.lit(f"(?s)({_balanced(tag, levels)})"), F.lit(1))


def split_records(text: Column) -> Column:
    """All records of a text, however many documents it holds."""
    return split_elements(text, "record")


def raw_records(spark: SparkSession, root: str, from_: str = "") -> DataFrame:
    """xml, path, name of each record; files whose name is before ``from_`` aren't opened. A response is one value."""
    files = spark.read.option("lineSep", END).option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true").text(root)
    found = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    if from_:
        found = found.filter(F.col("name") >= from_)
    return found.select(F.explode(split_records(F.col("value"))).alias("xml"), "path", "name")


def _without_marks(metadata: Column) -> Column:
    """The parsed metadata without ``_BLANK``."""

    def values(of: Column) -> list[Column]:
        return [F.transform(of[e], lambda v: F.struct(F.replace(v["_VALUE"], F.lit(_BLANK), F.lit("")).alias("_VALUE"), v["_lang"].alias("_lang"))).alias(e) for e in DC.names]

    dc = metadata["dc"]
    return F.when(metadata.isNotNull(), F.struct(F.when(dc.isNotNull(), F.struct(*values(dc))).alias("dc"), *values(metadata)))


def decode(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """raw with header, metadata (struct), metadata_xml, about and corrupt (what can't be parsed)."""
    options = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
    parsed = F.from_xml(F.regexp_replace(F.regexp_replace(xml, _UNKNOWN, "&amp;"), _EMPTY, f"$1{_BLANK}"), RECORD, options)
    # The generator keeps filters above it: pushed below, each would parse the record again.
    found = raw.select("*", F.explode_outer(F.array(parsed)).alias("_record"))
    inner = F.regexp_extract(xml, r"(?s)<metadata[^>]*>(.*)</metadata>", 1)
    about = F.regexp_extract(xml, r"(?s)<about[^>]*>(.*)</about>", 1)
    return found.select(
        *raw.columns,
        F.col("_record.header").alias("header"),
        _without_marks(F.col("_record.metadata")).alias("metadata"),
        F.when(inner != "", inner).alias("metadata_xml"),
        F.when(about != "", about).alias("about"),
        (F.col("_record.header.identifier").isNull() & F.col("_record.metadata").isNull()).alias("corrupt"),
    )


def _within(stamp: Column, from_: str, until: str, whole_day: bool) -> Column:
    low = stamp >= from_ if from_ else F.lit(True)
    if not until:
        return low
    return low & (F.left(stamp, F.lit(len(until))) <= until if whole_day else stamp <= until)


def in_range(records: DataFrame, from_: str = "", until: str = "", whole_day: bool = False) -> DataFrame:
    """Records by datestamp, compared as strings; with ``whole_day`` a day as upper bound holds all of its times."""
    return records.filter(_within(F.col("header.datestamp"), from_, until, whole_day)) if from_ or until else records


def maybe_in_range(raw: DataFrame, from_: str = "", until: str = "", whole_day: bool = False, xml: str = "xml") -> DataFrame:
    """Unparsed records without those whose header, in its usual form, shows a datestamp outside the range."""
    if not (from_ or until):
        return raw
    stamp = F.regexp_extract(xml, r"^<record[^>]*+>\s*+<header[^>]*+>\s*+(?:<identifier>[^<]*+</identifier>\s*+)?+<datestamp>([^<&]++)</datestamp>", 1)
    return raw.filter((stamp == "") | _within(stamp, from_, until, whole_day))


def read_pages(spark: SparkSession, root: str, from_: str = "", until: str = "", whole_day: bool = False) -> DataFrame:
    """The records of a harvest's pages: pruned by file name, cut, dropped by the header's text, parsed, filtered."""
    raw = maybe_in_range(raw_records(spark, root, from_), from_, until, whole_day)
    return in_range(decode(raw), from_, until, whole_day)
