"""Text cleaning: control characters, charsets, entities, identifiers, snippets."""

from __future__ import annotations

import json
import re
from html import unescape as html_unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is mined from identifiers, and what isn't text.
DOI = r"10\.[0-9]{1,8}/\S+"
ISSN = r"[0-9]{4}-?[0-9]{3}[0-9xX]"
CONTROL = r"[\x00-\x09\x0B\x0C\x0E-\x1F\x{FFFD}\x{FFFE}]"
CHARSETS = ("UTF-8", "ISO-8859-1", "WINDOWS-1252", "UTF-16", "US-ASCII")


def without_control(c: Column) -> Column:
    """Control characters go, tabs too; line feeds and carriage returns stay."""
    return F.regexp_replace(c, CONTROL, "")


def first_doi(c: Column) -> Column:
    return F.regexp_extract(c, DOI, 0)


def first_issn(c: Column) -> Column:
    """The first eight digits that look like one, also inside longer numbers."""
    return F.regexp_extract(c, ISSN, 0)


def distinct_text(values: Column) -> Column:
    """Empty and null values go, then repeats; the order stays."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))


def append_unique(values: Column, value: Column) -> Column:
    return F.array_distinct(F.concat(values, F.array(value)))


def classify(identifiers: Column, sources: Column, raw_dois: Column | None = None) -> Column:
    """struct(urls, doi, issn): each distinct identifier, then each distinct source, is a URL if it starts with
    http, else gives its first DOI, else its first ISSN. Given DOIs come first."""
    values = F.concat(distinct_text(identifiers), distinct_text(sources))
    urls = F.filter(values, lambda v: v.startswith("http"))
    others = F.filter(values, lambda v: ~v.startswith("http"))
    dois = F.transform(F.filter(others, lambda v: first_doi(v) != ""), first_doi)
    issns = F.transform(F.filter(others, lambda v: (first_doi(v) == "") & (first_issn(v) != "")), first_issn)
    given = F.array().cast("array<string>") if raw_dois is None else distinct_text(raw_dois)
    return F.struct(F.array_distinct(urls).alias("urls"), F.array_distinct(F.concat(given, dois)).alias("doi"), F.array_distinct(issns).alias("issn"))


def snippet(c: Column) -> Column:
    """Short texts on one line; of long ones the length and 50 characters from either end."""
    flat = F.regexp_replace(c, r"\s*\n\s*", " ")
    long = F.concat(F.lit("["), F.length(c).cast("string"), F.lit("] "), F.left(flat, F.lit(50)), F.lit(" ... "), F.right(flat, F.lit(50)))
    return F.when(F.length(c) < 120, flat).otherwise(long)


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML character references; the full table of names has no built-in."""
    return texts.map(html_unescape, na_action="ignore")


def has_entity(c: Column) -> Column:
    return c.rlike("&[#A-Za-z]")


_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._:-]+)["']""")


def charsets(body: bytes) -> list[str]:
    """What to read bytes by, in order: what a byte order mark says, the declared charset, then the list; without any declaration UTF-8 only."""
    if body.startswith((b"\xff\xfe", b"\xfe\xff")):
        return ["utf-16", *CHARSETS]
    if not body.lstrip().startswith(b"<?xml"):
        return [CHARSETS[0]]
    declared = _DECLARED.match(body[:400])
    named = declared[1].decode("ascii") if declared else CHARSETS[0]
    return [*([] if named.lower().replace("_", "-") in ("utf-8", "utf8") else [named]), *CHARSETS]


def read_bytes(body: bytes) -> str | None:
    """The text by the first charset that is known and fits; null if none does."""
    for charset in charsets(body):
        try:
            return body.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return None


@F.pandas_udf(StringType())
def decode_with_fallback(bodies: pd.Series) -> pd.Series:
    """Bytes as text, by ``charsets``; null if no charset fits."""
    return bodies.map(lambda body: None if body is None else read_bytes(bytes(body)))


_TAG = re.compile(r"<[^>]*>")


def _unprefixed(tag: re.Match) -> str:
    """A tag without prefixes and their declarations, which stand outside the payload."""
    bare = re.sub(r'\sxmlns(?::[^=\s]*)?\s*=\s*"[^"]*"', "", tag[0])
    return re.sub(r"(^</?|\s)[A-Za-z_][\w.-]*:(?=[\w.-]+(?:\s*=|[\s/>]))", r"\1", bare)


def _as_value(node: ElementTree.Element):
    """A leaf is its text; else a map of children (lists for repeated ones), attributes (-name) and text (#text)."""
    local = lambda tag: tag.rpartition("}")[2]
    value: dict = {f"-{local(k)}": v for k, v in node.attrib.items()}
    for child in node:
        name, inner = local(child.tag), _as_value(child)
        if name in value:
            value[name] = [*(value[name] if isinstance(value[name], list) else [value[name]]), inner]
        else:
            value[name] = inner
    text = node.text or ""
    if not value:
        return text
    return value | ({"#text": text} if text.strip() else {})


@F.pandas_udf(StringType())
def xml_to_json(bodies: pd.Series) -> pd.Series:
    """Any XML as a JSON map by element names; {} for nothing, null for what can't be parsed. For payloads without a schema."""

    def one(xml: str | None) -> str | None:
        if not xml or not xml.strip():
            return "{}"
        try:
            root = ElementTree.fromstring(f"<_>{_TAG.sub(_unprefixed, xml)}</_>")
        except ElementTree.ParseError:
            return None
        value = _as_value(root)
        return json.dumps(value if isinstance(value, dict) else {"#text": value}, ensure_ascii=False)

    return bodies.map(one)


def first_sentence(c: Column) -> Column:
    """Up to the first full stop, question or exclamation mark before a blank and a capital, or all of it."""
    found = F.regexp_extract(c, r"^(.*?[.!?])(?:\s+(?=[\p{Lu}\d\"'(])|\s*$)", 1)
    return F.when(found != "", found).otherwise(c)


def fortune(descriptions: Column, endpoint: Column, sentence: bool = False) -> Column:
    """The first description, trimmed, with a signature; null if there is none. References must be decoded before."""
    text = F.regexp_replace(F.get(descriptions, F.lit(0)), r"^\s+|\s+$", "")
    body = first_sentence(text) if sentence else text
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(body, F.lit("\n\n    -- "), endpoint))
