"""OAI-PMH protocol rules as column functions: request URLs, tokens, dates, directory keys, rate limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol.
VERBS = ("Identify", "ListIdentifiers", "ListSets", "ListMetadataFormats", "ListRecords", "GetRecord")
DAY, SECOND = "YYYY-MM-DD", "YYYY-MM-DDThh:mm:ssZ"
PAGE_NAME = r"^(\d{4}-\d{2}-\d{2})-(\d{8})\.xml(?:\.gz|\.zst)?$"
MISSING_URL, INVALID_VERB, MISSING_PARAMETER = "missing URL", "invalid verb", "missing parameter"
RETRY_STATUS = (408, 429, 500, 502, 503, 504)


def blank(c: Column) -> Column:
    """Null and empty are the same in the protocol."""
    return F.coalesce(c, F.lit("")) == ""


def with_scheme(url: Column) -> Column:
    """``http://`` before whatever doesn't start with http."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))


def directory_key(set_: Column, prefix: Column, url: Column) -> Column:
    """Unpadded URL-safe base64 of set#format#url."""
    raw = F.concat_ws("#", F.coalesce(set_, F.lit("")), F.coalesce(prefix, F.lit("")), F.coalesce(url, F.lit("")))
    return F.translate(F.base64(raw.cast("binary")), "+/=\r\n", "-_")


def directory_parts(key: Column) -> Column:
    """[set, format, url] of a key; null for names that aren't keys."""
    text = F.try_to_binary(F.translate(key, "-_", "+/"), F.lit("base64")).cast("string")
    parts = F.split(text, "#", 3)
    return F.when(F.size(parts) == 3, parts)


def ellipsis(name: Column, length: int = 35) -> Column:
    """The first ``length`` bytes and three dots, for longer names."""
    cut = F.substring(name.cast("binary"), 1, length).cast("string")
    return F.when(F.octet_length(name) > length, F.concat(cut, F.lit("..."))).otherwise(name)


def page_date(name: Column) -> Column:
    """The date in a page file's name, null for other names."""
    found = F.regexp_extract(name, PAGE_NAME, 1)
    return F.when(found != "", found)


def compression(name: Column, head: Column | None = None) -> Column:
    """zstd or gzip by suffix, else by the first bytes, else gzip."""
    rule = F.when(name.endswith(".zst"), "zstd").when(name.endswith(".gz"), "gzip")
    return rule.otherwise("gzip") if head is None else rule.when(F.substring(head, 1, 2) == F.lit(b"\x1f\x8b"), "gzip").otherwise("gzip")


def request_error(base_url: Column, verb: Column, prefix: Column, identifier: Column, token: Column, suppress: Column) -> Column:
    """Null for a request that can be made."""
    needs_prefix = verb.isin("ListIdentifiers", "ListRecords", "GetRecord") & blank(prefix) & ~F.coalesce(suppress, F.lit(False))
    missing = (needs_prefix | ((verb == "GetRecord") & blank(identifier))) & blank(token)
    return F.when(blank(base_url), MISSING_URL).when(~F.coalesce(verb, F.lit("")).isin(*VERBS), INVALID_VERB).when(missing, MISSING_PARAMETER)


def request_url(base_url: Column, verb: Column, prefix: Column, identifier: Column, from_: Column, until: Column, set_: Column, token: Column, suppress: Column) -> Column:
    """The URL: keys sorted, values unescaped; a token goes with nothing but the verb and is escaped if it holds '!', blank or '+'."""

    def pair(key: str, value: Column, when: Column | None = None) -> Column:
        there = ~blank(value) if when is None else ~blank(value) & when
        return F.when(there, F.concat(F.lit(key + "="), value))

    takes_range = verb.isin("ListIdentifiers", "ListRecords")
    takes_prefix = verb.isin("ListIdentifiers", "ListRecords", "GetRecord") & ~F.coalesce(suppress, F.lit(False))
    plain = F.concat_ws(
        "&",
        pair("from", from_, takes_range),
        pair("identifier", identifier, verb.isin("GetRecord", "ListMetadataFormats")),
        pair("metadataPrefix", prefix, takes_prefix),
        pair("set", set_, takes_range),
        pair("until", until, takes_range),
        pair("verb", verb),
    )
    safe_token = F.when(token.rlike("[! +]"), F.url_encode(token)).otherwise(token)
    query = F.when(blank(token), plain).otherwise(F.concat(F.lit("resumptionToken="), safe_token, F.lit("&verb="), verb))
    error = request_error(base_url, verb, prefix, identifier, token, suppress)
    return F.when(error.isNull(), F.concat(base_url, F.lit("?"), query))


def next_token(size: Column, cursor: Column, identifiers: Column, records: Column, sets: Column) -> Column:
    """Empty once the cursor equals the complete size, as strings; else the first token of identifiers, records, sets."""
    first = F.when(~blank(identifiers), identifiers).when(~blank(records), records).when(~blank(sets), sets).otherwise("")
    return F.when(~blank(size) & ~blank(cursor) & (size == cursor), "").otherwise(first)


def first_of(sets: Column, identifiers: Column, records: Column) -> Column:
    """A token attribute, in the order sets, identifiers, records."""
    return F.when(~blank(sets), sets).when(~blank(identifiers), identifiers).when(~blank(records), records)


def list_size(size: Column) -> Column:
    """The complete list size as a number; null if it is none."""
    return F.when(size.rlike(r"^[+-]?\d+$"), size.try_cast("long"))


def date_layout(granularity: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM-ddTHH:mm:ssZ, or empty; the case must fit."""
    return F.when(granularity == DAY, "2006-01-02").when(granularity == SECOND, "2006-01-02T15:04:05Z").otherwise("")


def earliest_date(granularity: Column, stamp: Column) -> Column:
    """The earliest datestamp as a timestamp; null if it can't be read. The granularity's case doesn't matter."""
    day = F.try_to_timestamp(F.left(stamp, F.lit(10)), F.lit("yyyy-MM-dd"))
    full = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    short = F.length(stamp).between(10, 19)
    kind = F.lower(granularity)
    return F.when(kind == DAY.lower(), day).when((kind == SECOND.lower()) & short, day).when(kind == SECOND.lower(), full)


def rate_limit(text: Column) -> Column:
    """Bytes a second of '1.5MB/s' and the like, in steps of 1024; 0 for none, null for what can't be read."""
    body = F.upper(F.trim(F.regexp_replace(text, r"(?i)/s\s*$", "")))
    number, unit = F.regexp_extract(body, r"^(\d+(?:\.\d*)?|\.\d+)\s*(KB|MB|GB|K|M|G)?$", 1), F.regexp_extract(body, r"(KB|MB|GB|K|M|G)$", 1)
    factor = F.when(unit.isin("K", "KB"), 1024.0).when(unit.isin("M", "MB"), 1024.0**2).when(unit.isin("G", "GB"), 1024.0**3).otherwise(1.0)
    return F.when(blank(F.trim(text)) | (F.trim(text) == "0"), F.lit(0.0)).when(number != "", number.try_cast("double") * factor)


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.translate(F.base64(F.concat_ws(":", user, password).cast("binary")), "\r\n", ""))


def may_retry(status: Column, error: Column, ignore_errors: Column) -> Column:
    """Whether a failed request is worth another try, if errors are ignored at all."""
    passing = F.lower(F.coalesce(error, F.lit(""))).rlike("unexpected eof|connection refused|no such host|timeout")
    return F.coalesce(ignore_errors, F.lit(False)) & (F.coalesce(status.isin(*RETRY_STATUS), F.lit(False)) | passing)


def cache_path(url: Column, levels: int = 3) -> Column:
    """ab/cd/ef/… of a URL's SHA-1: two digits a level, then the rest."""
    h = F.sha1(url.cast("binary"))
    return F.concat_ws("/", *(F.substring(h, 2 * i + 1, 2) for i in range(levels)), F.substring(h, 2 * levels + 1, 40))
