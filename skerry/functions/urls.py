"""URL cleaning, tagging, and guesses of endpoints."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the curation rules.
EDU_DOMAINS = ("brocku.ca", "cuni.cz", "hua.gr", "lagh-univ.dzmtak.hu", "sfu.ca", "u-szeged.hu", "uniag.sk", "uoc.gr", "yorku.ca", "ru.lv")
EDU_PATTERNS = (r"[/.]u[a-z]{2,8}.(br|ca|es)", r"uni.*[.](it|hr|ch|nl|ua|hu|fr|gr)", "uni.*.hr", "uni.*no", "thesis|theses", r"uni-|[.]uni[.]|univ-")
#: Platform, lower-cased, and what its endpoint adds to the site.
ENDPOINT_SUFFIX = {
    "contentdm": "/oai/oai.php",
    "eprints 3": "/cgi/oai2",
    "digitalcommons / bepress": "/do/oai",
    "dspace": "/oai/request",
    "dspace xoai": "/oai/request",
    "dspace iris": "/oai/request",
    "ojs": "/oai",
}
SPAM = ("web.archive.org/web", "whatsapp.com")
SHARE_PREFIX = "https://api.whatsapp.com/send?text="


def host_and_port(url: Column) -> Column:
    """What stands between // and the next slash; the port stays."""
    return F.get(F.split(url, "/"), F.lit(2))


def domain(url: Column) -> Column:
    """The last two labels of the host, without port."""
    labels = F.split(F.coalesce(host_and_port(url), F.lit("")), r"\.")
    return F.get(F.split(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), ":"), F.lit(0))


def tld(url: Column) -> Column:
    """The last label if it begins with two lower-case letters, else empty."""
    last = F.element_at(F.split(domain(url), r"\."), -1)
    return F.when(last.rlike("^[a-z]{2,20}"), last).otherwise("")


def tags(url: Column) -> Column:
    """struct(platform, is_edu, is_edu_world, is_id, is_museum, is_gov). Of platforms, the last rule that fits wins."""
    site = domain(url)
    world = F.contains(url, F.lit("casirgrid")) | url.rlike(r"[.]edu[.][a-z]{2,3}") | url.rlike(r"[.]ac[.][a-z]{2,3}")
    edu = world | site.isin(*EDU_DOMAINS) | site.endswith(".edu")
    for pattern in EDU_PATTERNS:
        edu = edu | url.rlike(pattern)
    platform = (
        F.when(F.contains(url, F.lit("opus.")), "opus")
        .when(F.contains(url, F.lit("/ojs/")) | url.rlike("/index.php/[^/]*/oai"), "ojs")
        .when(F.contains(url, F.lit("dspace")), "dspace")
        .otherwise("")
    )
    return F.struct(
        platform.alias("platform"),
        edu.alias("is_edu"),
        world.alias("is_edu_world"),
        (F.contains(url, F.lit(".id/")) | F.contains(url, F.lit("jurnal"))).alias("is_id"),
        F.contains(url, F.lit("museum")).alias("is_museum"),
        (F.contains(url, F.lit(".gov/")) | F.contains(url, F.lit(".gov."))).alias("is_gov"),
    )


def scrub(url: Column, unescaped: bool = False) -> Column:
    """Trimmed, without blanks and tabs, 10 to 120 bytes, parseable, with a scheme; else null. References must be decoded before."""
    text = F.translate(F.trim(url), " \t", "")
    fits = F.octet_length(text).between(10, 120) & F.contains(text, F.lit("://")) & F.try_parse_url(text, F.lit("PROTOCOL")).isNotNull()
    return F.when(fits, text)


def clean(text: Column) -> Column:
    """The first URL in a text, repaired: blanks around ':' and '/', references, garbage behind a known ending
    (com, org, …, if nothing of a path follows it), protocol, brackets and punctuation. https stays https."""
    found = F.regexp_extract(text, r"""(https?://[^\s<>"']+|www\.[^\s<>"']+)""", 0)
    c = F.when(found != "", found).otherwise(text)
    c = F.regexp_replace(c, r"(\w):\s+", "$1:")
    c = F.regexp_replace(c, r"(\w)\s+:/", "$1:/")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&#xd;", "")):
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"(com|org|net|edu|gov|io|co)[,)\s].*$", "$1")
    c = F.regexp_replace(c, r"^(https?):/*[<\"]+", "$1://")
    c = F.regexp_replace(c, r"^[<>]+|[<>]+$", "")
    c = F.regexp_replace(c, r"""[,.;!?")> \t\n]+$""", "")
    c = F.regexp_replace(c, r"\s+", "")
    c = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("http://"), c))
    return F.regexp_replace(c, "^(?:https?://)*(https?://)", "$1")


def is_valid(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), F.lit(False))


def site_cleanup(url: Column) -> Column:
    """An entry of the endpoint list: no last slash, no share prefix, no verb, no last question mark."""
    c = F.regexp_replace(url, "/$", "")
    c = F.replace(c, F.lit(SHARE_PREFIX), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, r"\?verb=.*", ""), r"\?$", "")


def endpoint_guess(system: Column, url: Column) -> Column:
    """The endpoint that a platform has for a site; null for platforms without a rule. The platform's case doesn't matter."""
    bare, kind = F.regexp_replace(url, "/+$", ""), F.lower(system)
    suffix = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ENDPOINT_SUFFIX.items()))[kind]
    suffix = F.when((kind == "islandora") & F.contains(url, F.lit(".hr/")), "/oai").otherwise(suffix)
    return F.concat(bare, suffix)


def journal_endpoint(url: Column) -> Column:
    """…/index becomes …/oai; a last slash gets oai; else /oai follows."""
    return F.when(url.endswith("/index"), F.regexp_replace(url, "/index$", "/oai")).when(url.endswith("/"), F.concat(url, F.lit("oai"))).otherwise(F.concat(url, F.lit("/oai")))


def ojs_endpoint(url: Column) -> Column:
    """…/index.php/x gets /oai; null for other URLs."""
    return F.when(url.rlike("^http.*/index.php/[^/]+$"), F.concat(url, F.lit("/oai")))


def article_endpoint(url: Column) -> Column:
    """The endpoint of the journal that an article link …/index.php/x/article… belongs to; null for others."""
    prefix = F.regexp_extract(url, r"^(.*/index\.php/[^/]+)/article", 1)
    return F.when(prefix != "", F.concat(prefix, F.lit("/oai")))


def report_endpoint(line: Column) -> Column:
    """Field 5 of a tab-separated report line, if it holds index.php: without /index, with /oai."""
    field = F.get(F.split(line, "\t"), F.lit(4))
    return F.when(F.contains(field, F.lit("index.php")), F.concat(F.regexp_replace(field, "/index$", ""), F.lit("/oai")))


def journal_paths(html: Column, base: str) -> Column:
    """Endpoints of the paths /en/journal/x in a page."""
    return F.transform(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(/en/journal/[A-Za-z0-9_-]+)"), F.lit(1))), lambda p: F.concat(F.lit(base), p, F.lit("/oai")))


def hrefs(html: Column) -> Column:
    """All link targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def journal_links(html: Column) -> Column:
    """Endpoints of the journals that a page links to: /index.php/x, its search suffix dropped."""
    own = F.filter(hrefs(html), lambda h: h.rlike(r"/index\.php/[^/]+/?(\?searchInitial.*)?$"))
    bare = F.transform(own, lambda h: F.regexp_replace(F.regexp_replace(h, r"\?searchInitial.*", ""), "/$", ""))
    return F.array_sort(F.array_distinct(F.transform(bare, lambda h: F.concat(h, F.lit("/oai")))))


def outside_links(html: Column) -> Column:
    """Links that start with http, cut at the question mark, without repeats."""
    own = F.filter(hrefs(html), lambda h: h.startswith("http"))
    return F.array_sort(F.array_distinct(F.transform(own, lambda h: F.get(F.split(h, r"\?"), F.lit(0)))))


def tokens(values: Column) -> Column:
    """White-space separated entries, each with a scheme."""
    found = F.filter(F.split(F.trim(values), r"\s+"), lambda v: v != "")
    return F.transform(found, lambda v: F.when(v.startswith("http"), v).otherwise(F.concat(F.lit("http://"), v)))
