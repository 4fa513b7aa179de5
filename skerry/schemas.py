"""Explicit schemas. Every value of the protocol is a string: inference would make dates of datestamps and titles."""

from __future__ import annotations

from pyspark.sql import types as T

#: The elements of unqualified Dublin Core.
ELEMENTS = (
    "contributor", "coverage", "creator", "date", "description", "format", "identifier", "language", "publisher", "relation", "rights", "source", "subject", "title", "type",
)
#: Column of an element in the flat table.
COLUMNS = {
    "contributor": "contributors", "coverage": "coverage", "creator": "creators", "description": "descriptions", "format": "formats", "language": "languages",
    "publisher": "publishers", "relation": "relations", "rights": "rights", "subject": "subjects", "title": "titles", "type": "types",
}

_values = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_lang", T.StringType())]))
DC = T.StructType([T.StructField(e, _values) for e in (*ELEMENTS, "doi")])
HEADER = T.StructType(
    [T.StructField("_status", T.StringType()), T.StructField("identifier", T.StringType()), T.StructField("datestamp", T.StringType()), T.StructField("setSpec", T.ArrayType(T.StringType()))]
)
RECORD = T.StructType([T.StructField("header", HEADER), T.StructField("metadata", T.StructType([T.StructField("dc", DC), *DC.fields]))])
SITE = "url string, tld string, platform string, is_edu boolean, is_edu_world boolean, is_id boolean, is_museum boolean, is_gov boolean"
PROVIDER = "name string, url string, continent string, country string, document_count string, open_access_info string, type string, system string, in_base_since string, base_url string, ror string, coordinates string"
CORE_PROVIDER = (
    "id bigint, openDoarId bigint, name string, email string, oaiPmhUrl string, homepageUrl string, software string, metadataFormat string, createdDate string, "
    "location struct<countryCode:string,latitude:double,longitude:double>, logo string, type string, rorId string, institutionName string, aliases array<string>, otherIdentifiers string"
)
JOURNAL = "name string, homepage string, oai string"
