"""Data source ``oaipmh``: pages of OAI-PMH endpoints, in batch or as a stream.

A token chain is serial, so the unit of parallel work is an (endpoint, interval): each is a partition whose
reader follows its chain. A row is a response page; ``records`` and the functions beside it decode pages with
DataFrame operations. As a stream the offset is a day: what was harvested up to yesterday isn't asked for
again, a day without records moves the offset like any other, and the checkpoint keeps the state.

TLS certificates are verified. Options (strings): url (comma-separated), verb, prefix, set, from, until, unit
(none, month, day, hour), max_requests, max_empty and max_waits (0: no limit), retries, delay, backoff, timeout,
rate (bytes a second, over all partitions), parallel (how many partitions run at once at most, if that is known;
the rate is shared among so many), max_bytes, ignore_http_errors, ignore_unexpected_eof, suppress_format, headers
(JSON), user, password, clean, today (for tests).

Without ``from`` a harvest by intervals begins where the endpoint's Identify says that its records do, and an
endpoint that knows days only is asked by days instead of hours. A stream begins at the earliest of its endpoints.
"""

from __future__ import annotations

import base64
import calendar
import gzip
import http.client
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.protocol import RETRY_STATUS, VERBS
from ..functions.text import read_bytes
from .pages import decode, split_records

SCHEMA = "endpoint string, verb string, set string, prefix string, from_date string, until_date string, page int, body string, code string, error string"
CONTROL = re.compile("[\x00-\x09\x0b\x0c\x0e-\x1f�￾]")
#: Codes after which a page counts as empty and the chain ends.
ENDS = ("noRecordsMatch", "badResumptionToken")
WAIT = "InternalException"
GRANULARITIES = ("yyyy-mm-dd", "yyyy-mm-ddthh:mm:ssz")


class ProtocolError(Exception):
    """A request that can't be made."""


@dataclass
class Chain(InputPartition):
    """``share``: how many chains share the rate; ``plain``: the endpoint's answers must come uncompressed."""

    endpoint: str
    from_date: str
    until_date: str
    share: int = 1
    plain: bool = False


@dataclass
class Offset:
    """Request parameters that stay the same along a chain."""

    verb: str
    prefix: str
    set: str
    identifier: str
    suppress: bool


def request_url(endpoint: str, o: Offset, from_: str, until: str, token: str) -> str:
    """The twin of the column function, for the reader."""
    if not endpoint:
        raise ProtocolError("missing URL")
    if o.verb not in VERBS:
        raise ProtocolError("invalid verb")
    if token:
        safe = urllib.parse.quote_plus(token) if re.search("[! +]", token) else token
        return f"{endpoint}?resumptionToken={safe}&verb={o.verb}"
    ranged = o.verb in ("ListIdentifiers", "ListRecords")
    values = {"verb": o.verb}
    if (ranged or o.verb == "GetRecord") and not o.suppress:
        if not o.prefix:
            raise ProtocolError("missing parameter")
        values["metadataPrefix"] = o.prefix
    if o.verb == "GetRecord" and not o.identifier:
        raise ProtocolError("missing parameter")
    if o.verb in ("GetRecord", "ListMetadataFormats") and o.identifier:
        values["identifier"] = o.identifier
    if ranged:
        values |= {k: v for k, v in (("from", from_), ("until", until), ("set", o.set)) if v}
    return endpoint + "?" + "&".join(f"{k}={values[k]}" for k in sorted(values))


def decompress(body: bytes) -> bytes:
    """zstd or gzip by the first bytes, else as it is."""
    if body.startswith(b"\x28\xb5\x2f\xfd"):
        import zstandard

        return b"".join(zstandard.ZstdDecompressor().read_to_iter(body))
    if body.startswith(b"\x1f\x8b"):
        return gzip.decompress(body)
    return body


def to_text(body: bytes) -> str:
    """By the byte order mark, the declared charset, or the first of the list that fits."""
    text = read_bytes(body)
    return body.decode("utf-8", "replace") if text is None else text


def retriable(error: Exception) -> bool:
    if isinstance(error, urllib.error.HTTPError):
        return error.code in RETRY_STATUS
    if isinstance(error, (http.client.IncompleteRead, TimeoutError, ConnectionError, EOFError)):
        return True
    return isinstance(error, urllib.error.URLError) and bool(re.search("refused|no such host|not known|timed out", str(error.reason)))


def retrying(action, retries: int, delay: float, backoff: float, worth=retriable, sleep=time.sleep):
    """``action`` again, up to ``retries`` times, after growing waits."""
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception as error:
            if attempt == retries or not worth(error):
                raise
            sleep(delay * backoff**attempt)


class Throttle:
    """At most ``rate`` bytes a second; 0 is no limit."""

    def __init__(self, rate: float):
        self.rate, self.read, self.began = rate, 0, time.monotonic()

    def took(self, n: int) -> None:
        self.read += n
        if self.rate:
            time.sleep(max(0.0, self.read / self.rate - (time.monotonic() - self.began)))


class Client:
    def __init__(self, options: dict[str, str], partitions: int = 1):
        number = lambda k, d: float(options.get(k, d) or d)
        self.retries, self.delay, self.backoff = int(number("retries", 3)), number("delay", 10), number("backoff", 2)
        self.timeout, self.most = number("timeout", 30), int(number("max_bytes", 1 << 30))
        self.throttle = Throttle(number("rate", 0) / max(1, partitions))
        self.headers = {"User-Agent": "skerry", "Accept-Encoding": "gzip"} | json.loads(options.get("headers") or "{}")
        if options.get("user"):
            self.headers["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()
        self.clean = options.get("clean", "true") == "true"

    @classmethod
    def of(cls, options: dict[str, str], chain: Chain) -> Client:
        client = cls(options, chain.share)
        if chain.plain:
            client.headers["Accept-Encoding"] = "identity"
        return client

    def once(self, url: str) -> str:
        request = urllib.request.Request(url, headers=self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            parts, size = [], 0
            while size < self.most and (part := response.read(min(1 << 16, self.most - size))):
                parts.append(part)
                size += len(part)
                self.throttle.took(len(part))
        text = to_text(decompress(b"".join(parts)))
        return CONTROL.sub("", text) if self.clean else text

    def get(self, url: str) -> str:
        return retrying(lambda: self.once(url), self.retries, self.delay, self.backoff)

    def identify(self, endpoint: str) -> str:
        """Once more without compression on an error; the header then stays for the harvest."""
        try:
            return self.get(f"{endpoint}?verb=Identify")
        except Exception:
            self.headers["Accept-Encoding"] = "identity"
            return self.get(f"{endpoint}?verb=Identify")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@dataclass
class Page:
    items: int
    token: str
    size: str
    cursor: str
    code: str
    message: str


ITEMS = {"record", "header", "set", "metadataFormat"}


def look(body: str) -> Page:
    """What the page loop needs of a page."""
    page = Page(0, "", "", "", "", "")
    try:
        root = ElementTree.fromstring(body.encode())
    except ElementTree.ParseError:  # pages with undefined entities and the like are still harvested
        token = re.search(r"(?s)<resumptionToken([^>]*)>([^<]*)<", body)
        error = re.search(r'(?s)<error[^>]*code="([^"]*)"[^>]*>([^<]*)<', body)
        attribute = lambda k: (re.search(rf'{k}="([^"]*)"', token[1]) or ["", ""])[1] if token else ""
        return Page(len(re.findall(r"<(?:record|set|metadataFormat)[ >]", body)), token[2].strip() if token else "", attribute("completeListSize"), attribute("cursor"), error[1] if error else "", error[2] if error else "")
    for verb in root:
        if _local(verb.tag) == "error":
            page.code, page.message = verb.get("code", ""), (verb.text or "").strip()
        for item in verb:
            if _local(item.tag) == "resumptionToken":
                page.token, page.size, page.cursor = (item.text or "").strip(), item.get("completeListSize", ""), item.get("cursor", "")
            elif _local(item.tag) in ITEMS:
                page.items += 1
    if page.size and page.cursor and page.size == page.cursor:
        page.token = ""
    return page


def pages(client: Client, options: dict[str, str], chain: Chain, wait: float = 30.0, sleep=time.sleep) -> Iterator[tuple]:
    """The pages of a chain: until there is no token or the same one again, or a limit is reached, or an error ends it."""
    fixed = Offset(options.get("verb", "ListRecords"), options.get("prefix", "oai_dc"), options.get("set", ""), options.get("identifier", ""), options.get("suppress_format", "false") == "true")
    most, most_empty = int(options.get("max_requests", 1048576)), int(options.get("max_empty", 10))
    most_waits = int(options.get("max_waits", 120))
    token, requests, empty, waits = "", 0, 0, 0
    row = lambda n, body, code="", error="": (chain.endpoint, fixed.verb, fixed.set, fixed.prefix, chain.from_date, chain.until_date, n, body, code, error)
    while not most or requests < most:
        requests += 1
        try:
            body = client.get(request_url(chain.endpoint, fixed, chain.from_date, chain.until_date, token))
        except (http.client.IncompleteRead, EOFError) as error:
            if options.get("ignore_unexpected_eof", "false") != "true":
                raise
            yield row(requests, None, "unexpected EOF", str(error))
            return
        except urllib.error.URLError as error:
            if options.get("ignore_http_errors", "false") != "true":
                raise
            yield row(requests, None, "HTTP", str(error))
            return
        page = look(body)
        if page.code == WAIT and (not most_waits or waits < most_waits):
            waits += 1
            sleep(wait)
            continue
        yield row(requests, body, page.code, page.message)  # an empty page too: it shows that the interval was asked for
        if page.code and page.code not in ENDS or page.code in ENDS:
            return
        empty = 0 if page.items else empty + 1
        if not page.token or page.token == token or most_empty and empty >= most_empty:
            return
        token = page.token


def _days(first: date, last: date, unit: str) -> Iterator[tuple[str, str]]:
    at = first
    while at <= last:
        if unit == "month":
            end = min(last, at.replace(day=calendar.monthrange(at.year, at.month)[1]))
        elif unit == "day":
            end = at
        else:
            end = last
        yield at.isoformat(), end.isoformat()
        at = end + timedelta(days=1)


def _today(options) -> date:
    return date.fromisoformat(options["today"]) if options.get("today") else datetime.now(timezone.utc).date()


def _endpoints(options) -> list[str]:
    return [u if u.startswith("http") else f"http://{u}" for u in map(str.strip, options.get("url", "").split(",")) if u]


@dataclass
class Start:
    endpoint: str
    day: str
    hours: bool
    plain: bool


def _starts(options) -> list[Start]:
    """Where each endpoint's harvest by intervals begins; who doesn't answer fails, or is left out on request."""
    endpoints = _endpoints(options)
    if options.get("from"):
        return [Start(e, options["from"], True, False) for e in endpoints]

    def ask(endpoint: str) -> Start | None:
        client = Client(options)
        try:
            body = client.identify(endpoint)
        except (OSError, EOFError, http.client.HTTPException):
            if options.get("ignore_http_errors", "false") != "true":
                raise
            return None
        said = lambda tag: (re.search(rf"<{tag}[^>]*>\s*([^<]*?)\s*</{tag}>", body) or ["", ""])[1]
        day, granularity = said("earliestDatestamp")[:10], said("granularity").lower()
        if granularity not in GRANULARITIES or not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
            raise ProtocolError(f"invalid earliest date: {endpoint}")
        return Start(endpoint, day, granularity != GRANULARITIES[0], client.headers["Accept-Encoding"] == "identity")

    with ThreadPoolExecutor(16) as pool:
        return [s for s in pool.map(ask, endpoints) if s]


def _sharing(chains: list[Chain], options) -> list[InputPartition]:
    """The chains, each with its part of the rate: all may run at once, unless ``parallel`` says how many do."""
    share = min(len(chains), int(options.get("parallel") or len(chains)))
    for chain in chains:
        chain.share = max(1, share)
    return chains


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o, unit = self.options, self.options.get("unit", "none")
        ranged = o.get("verb", "ListRecords") in ("ListRecords", "ListIdentifiers")
        if not ranged or unit == "none":
            return _sharing([Chain(e, o.get("from", "") if ranged else "", o.get("until", "") if ranged else "") for e in _endpoints(o)], o)
        last = date.fromisoformat(o["until"]) if o.get("until") else _today(o) - timedelta(days=1)
        chains = []
        for start in _starts(o):
            if unit == "hour" and start.hours:
                first = datetime.fromisoformat(start.day)
                hours = int((datetime.combine(last, datetime.min.time()) + timedelta(days=1) - first).total_seconds() // 3600)
                stamps = (first + timedelta(hours=h) for h in range(max(0, hours)))
                spans = ((f"{s:%Y-%m-%dT%H:%M:%SZ}", f"{s + timedelta(minutes=59, seconds=59):%Y-%m-%dT%H:%M:%SZ}") for s in stamps)
            else:
                spans = _days(date.fromisoformat(start.day[:10]), last, "day" if unit == "hour" else unit)
            chains += [Chain(start.endpoint, a, b, plain=start.plain) for a, b in spans]
        return _sharing(chains, o)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return pages(Client.of(self.options, partition), self.options, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are {"next": day}: the first day that wasn't asked for."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"next": min((s.day for s in _starts(self.options)), default="1970-01-01")}

    def latestOffset(self) -> dict:
        last = self.options.get("until")
        return {"next": (date.fromisoformat(last) + timedelta(days=1) if last else _today(self.options)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = date.fromisoformat(start["next"]), date.fromisoformat(end["next"]) - timedelta(days=1)
        return _sharing([Chain(e, a, b) for e in _endpoints(self.options) for a, b in _days(first, last, self.options.get("unit", "month"))], self.options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return pages(Client.of(self.options, partition), self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing to tell the endpoint: the checkpoint holds the offset."""


class OaiPmh(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oaipmh"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def records(found: DataFrame) -> DataFrame:
    """The records of pages."""
    return decode(found.select("endpoint", "set", "prefix", F.explode(split_records(F.col("body"))).alias("xml")))


def _items(tag: str, body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), F.lit(1))


def _text(xml: Column, tag: str) -> Column:
    found = F.regexp_extract(xml, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(name), F.lit(char))
    return F.when(found != "", found)


def _listed(found: DataFrame, tag: str, fields: tuple[str, ...]) -> DataFrame:
    exploded = found.select("endpoint", F.explode(_items(tag, F.col("body"))).alias("x"))
    return exploded.select("endpoint", *(_text(F.col("x"), f).alias(f) for f in fields))


def formats(found: DataFrame) -> DataFrame:
    return _listed(found, "metadataFormat", ("metadataPrefix", "schema", "metadataNamespace"))


def sets(found: DataFrame) -> DataFrame:
    return _listed(found, "set", ("setSpec", "setName"))


def identifiers(found: DataFrame) -> DataFrame:
    return _listed(found, "header", ("identifier", "datestamp"))


def identity(found: DataFrame) -> DataFrame:
    single = ("repositoryName", "baseURL", "protocolVersion", "earliestDatestamp", "deletedRecord", "granularity")
    many = F.transform(_items("adminEmail", F.col("body")), lambda x: F.regexp_extract(x, ">([^<]*)<", 1))
    return found.select("endpoint", *(_text(F.col("body"), f).alias(f) for f in single), many.alias("adminEmail"))


def complete_size(found: DataFrame) -> DataFrame:
    """endpoint, size: the complete list size that a first page tells; null if it tells none."""
    size = F.regexp_extract("body", r'<resumptionToken[^>]*completeListSize="([^"]*)"', 1)
    return found.filter("page = 1").select("endpoint", size.try_cast("long").alias("size"))


def report(identify: DataFrame, formats_: DataFrame, sets_: DataFrame, size: DataFrame) -> DataFrame:
    """One JSON document for each endpoint: identity, size, formats, sets."""
    of = formats_.groupBy("endpoint").agg(F.sort_array(F.collect_list(F.struct("metadataPrefix", "schema", "metadataNamespace"))).alias("formats"))
    by = sets_.groupBy("endpoint").agg(F.sort_array(F.collect_list(F.struct("setSpec", "setName"))).alias("sets"))
    joined = identity(identify).join(of, "endpoint", "left").join(by, "endpoint", "left").join(size, "endpoint", "left")
    who = F.struct(*(c for c in identity(identify).columns if c != "endpoint"))
    return joined.select("endpoint", F.to_json(F.struct("formats", who.alias("identify"), "sets", "size")).alias("value"))
