"""Records to the flat analytics table, filters, counters, ingest requests, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import classify, distinct_text
from ..schemas import COLUMNS

# Fixed values of the ingest rules.
URL_BLOCKLIST = (
    "://arxiv.org/", "://europepmc.org/", "ncbi.nlm.nih.gov/", "semanticscholar.org/", "://doi.org/", "://dx.doi.org/", "zenodo.org/", "figshare.com/", "://archive.org/",
    ".archive.org/", "://127.0.0.1/", "://www.kb.dk/", "://kb-images.kb.dk/", "://mdz-nbn-resolving.de/", "://aggr.ukm.um.si/", "://edoc.mpg.de/", "doaj.org/", "orcid.org/",
    "://gateway.isiknowledge.com/", "://hdl.handle.net/",
)
ID_BLOCKLIST = (
    "oai:kb.dk:", "oai:bdr.oai.bsb-muenchen.de:", "oai:hispana.mcu.es:", "oai:bnf.fr:", "oai:ukm.si:", "oai:biodiversitylibrary.org:", "oai:hsp.org:", "oai:repec:", "oai:n/a:",
    "oai:quod.lib.umich.edu:", "oai:americanae.aecid.es:", "oai:www.irgrid.ac.cn:", "oai:espace.library.uq.edu:", "oai:edoc.mpg.de:", "oai:bibliotecadigital.jcyl.es:",
    "oai:repository.erciyes.edu.tr:", "oai:krm.or.kr:", "oai:hypotheses.org:%",
)
RELEASE_STAGES = {
    "info:eu-repo/semantics/draftVersion": "draft",
    "info:eu-repo/semantics/submittedVersion": "submitted",
    "info:eu-repo/semantics/acceptedVersion": "accepted",
    "info:eu-repo/semantics/publishedVersion": "published",
    "info:eu-repo/semantics/updatedVersion": "updated",
}


def element(name: str) -> Column:
    """The texts of a metadata element, inside its wrapper or bare."""
    wrapped, bare = F.col(f"metadata.dc.{name}"), F.col(f"metadata.{name}")
    return F.transform(F.coalesce(wrapped, bare), lambda v: v["_VALUE"])


def info(records: DataFrame, dates_and_sources: bool = False) -> DataFrame:
    """The flat table: oai, status, datestamp, sets, one array for each element, and mined urls, doi, issn. Empty arrays are null."""

    def some(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    mined = classify(element("identifier"), element("source"), element("doi"))
    found = records.select("*", F.explode_outer(F.array(mined)).alias("_mined"))  # computed once a record, whatever uses it
    columns = [some(distinct_text(element(e))).alias(c) for e, c in COLUMNS.items()]
    if dates_and_sources:
        columns += [some(distinct_text(element("date"))).alias("dates"), some(distinct_text(element("source"))).alias("sources")]
    return found.select(
        F.col("header.identifier").alias("oai"),
        F.col("header._status").alias("status"),
        F.col("header.datestamp").alias("datestamp"),
        some(F.coalesce("header.setSpec", F.array().cast("array<string>"))).alias("sets"),
        some(distinct_text(element("identifier"))).alias("ids"),
        *(some(F.col(f"_mined.{c}")).alias(c) for c in ("urls", "doi", "issn")),
        *columns,
    )


def live(records: DataFrame, skip_deleted: bool = True) -> DataFrame:
    """Without deleted records, then without those that have neither title nor identifier."""
    if skip_deleted:
        records = records.filter(~F.col("status").eqNullSafe("deleted"))
    return records.filter((F.coalesce(F.size("titles"), F.lit(0)) > 0) | (F.coalesce("oai", F.lit("")) != ""))


def counters(records: DataFrame, skip_deleted: bool = True) -> DataFrame:
    """total, deleted, skipped, encoded, in one aggregation."""
    gone = F.col("status").eqNullSafe("deleted") if skip_deleted else F.lit(False)
    empty = (F.coalesce(F.size("titles"), F.lit(0)) <= 0) & (F.coalesce("oai", F.lit("")) == "")
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("deleted"), F.count_if(~gone & empty).alias("skipped"), F.count_if(~gone & ~empty).alias("encoded")
    )


def distinct_records(records: DataFrame) -> DataFrame:
    """One of each record that repeats in all columns."""
    return records.dropDuplicates()


def latest(records: DataFrame, key: str = "oai", stamp: str = "datestamp") -> DataFrame:
    """The last record of each identifier (an extension: the same record is harvested again whenever it changes); of equal stamps the greatest by all columns, in order."""
    order = Window.partitionBy(key).orderBy(F.desc(stamp), *(F.desc(f.name) for f in records.schema.fields if "map<" not in f.dataType.simpleString()))
    return records.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def blocked_id(oai: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ID_BLOCKLIST)), lambda p: F.lower(oai).startswith(p))


def blocked_url(url: Column) -> Column:
    return F.exists(F.array(*map(F.lit, URL_BLOCKLIST)), lambda p: F.contains(url, p))


def may_be_pdf(formats: Column) -> Column:
    """No formats, or one that names pdf."""
    return (F.coalesce(F.size(formats), F.lit(0)) <= 0) | F.exists(formats, lambda f: F.contains(F.lower(f), F.lit("pdf")))


def release_stage(types: Column) -> Column:
    """The stage of the last type that has one."""
    stages = F.create_map(*(F.lit(x) for pair in RELEASE_STAGES.items() for x in pair))
    known = F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.map_contains_key(stages, t))
    return F.when(F.size(known) > 0, F.element_at(stages, F.element_at(known, -1)))


def canonical(url: Column) -> Column:
    """Scheme and host lower-cased, default port and blanks at the ends dropped, an empty path becomes /."""
    text = F.trim(url)
    head = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    return F.when(head == "", text).otherwise(F.concat(bare, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def ingest_requests(infos: DataFrame, source: str = "bulk") -> DataFrame:
    """A request for each URL of a record that passes: base_url, edit_extra, ext_ids, … (fields in order of their names)."""
    fits = F.col("oai").startswith("oai:") & (F.size("urls") > 0) & ~blocked_id(F.col("oai")) & may_be_pdf(F.col("formats"))
    doi = F.trim(F.lower(F.get("doi", F.lit(0))))
    wanted = F.when(fits, F.filter("urls", lambda u: ~blocked_url(u)))  # not a filter below the generator, which would repeat what urls are made of
    exploded = infos.select("oai", "doi", "types", F.explode_outer(wanted).alias("url")).filter("url is not null")
    return exploded.select(
        canonical(F.col("url")).alias("base_url"),
        F.struct(F.when(doi.startswith("10."), doi).alias("doi"), F.lower("oai").alias("oai")).alias("ext_ids"),
        F.lit(source).alias("ingest_request_source"),
        F.lit("pdf").alias("ingest_type"),
        F.lit("oai").alias("link_source"),
        F.lower("oai").alias("link_source_id"),
        release_stage(F.col("types")).alias("release_stage"),
    )
