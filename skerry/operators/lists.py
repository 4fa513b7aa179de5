"""Lists of endpoints and their statistics: set operations, block lists, counts, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import domain, host_and_port, tags, tld


def sites(urls: DataFrame, col: str = "url") -> DataFrame:
    """url, tld and the tags of each URL."""
    return urls.select(F.col(col).alias("url"), tld(F.col(col)).alias("tld"), tags(F.col(col)).alias("t")).select("url", "tld", "t.*")


def prefer_https(urls: DataFrame, col: str = "url") -> DataFrame:
    """https URLs, and http URLs whose rest doesn't stand under https too; each once."""
    keyed = urls.filter(F.col(col).isNotNull()).select(F.regexp_replace(F.trim(col), "^https?://", "").alias("rest"), F.trim(col).startswith("https://").alias("secure")).filter("rest <> ''")
    best = keyed.groupBy("rest").agg(F.max("secure").alias("secure"))  # one shuffle, combined before it
    return best.select(F.concat(F.when(F.col("secure"), "https://").otherwise("http://"), F.col("rest")).alias(col))


def without_matches(urls: DataFrame, patterns: DataFrame, col: str = "url", pattern: str = "pattern", most: int = 10_000) -> DataFrame:
    """Rows that contain none of the patterns. A short list (``most`` at the utmost) becomes an expression over
    the rows; a longer one is joined by substring, without a broadcast hint."""
    few = [r[0] for r in patterns.select(pattern).distinct().limit(most + 1).collect()]
    if len(few) <= most:
        hit = F.exists(F.array(*map(F.lit, few)), lambda p: F.contains(F.col(col), p)) if few else F.lit(False)
        return urls.filter(~F.coalesce(hit, F.lit(False)))
    block = patterns.select(F.col(pattern).alias("_pattern")).distinct()
    return urls.join(block, F.contains(urls[col], block["_pattern"]), "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def only_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with a dimension; whether it is broadcast is Spark's decision by its size."""
    return rows.join(dimension, key, how)


def merged(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.distinct()


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_counts(rows: DataFrame, *keys: str, k: int = 25) -> DataFrame:
    """The k largest groups; ties by key."""
    return count_by(rows, *keys).orderBy(F.desc("n"), *keys).limit(k)


def top_sums(rows: DataFrame, value: str, ks: tuple[int, ...] = (3, 5, 10, 20)) -> DataFrame:
    """k, total: the sum of the k largest values, from one top-k of the largest k."""
    best = rows.select(F.col(value).alias("v")).filter("v is not null").orderBy(F.desc("v")).limit(max(ks))
    ranked = best.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("v"))))  # max(ks) rows
    return ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("nth <= k").groupBy("k").agg(F.sum("v").alias("total"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands more than once."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key), key, "left_semi")


def host_histogram(urls: DataFrame, col: str = "url") -> DataFrame:
    return urls.groupBy(host_and_port(F.col(col)).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def tld_histogram(urls: DataFrame, col: str = "url") -> DataFrame:
    return urls.groupBy(tld(F.col(col)).alias("tld")).agg(F.count(F.lit(1)).alias("n"))


def url_kinds(urls: DataFrame, col: str = "url") -> DataFrame:
    """By domain: all URLs, those of PDF files, those of journals."""
    url = F.col(col)
    return urls.groupBy(domain(url).alias("domain")).agg(F.count(F.lit(1)).alias("urls"), F.count_if(url.endswith(".pdf")).alias("pdf"), F.count_if(F.contains(url, F.lit("/index.php/"))).alias("journal"))


def distinct_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in columns))


def last_date(files: DataFrame, default: str, col: str = "date") -> DataFrame:
    """The latest date, or the default if there is none."""
    return files.agg(F.coalesce(F.max(col), F.lit(default)).alias("last"))


def sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows in an order that only the seed and the key decide."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *key)), *key).limit(n)


def first_non_empty(rows: DataFrame, col: str) -> DataFrame:
    return rows.filter(F.coalesce(F.col(col), F.lit("")) != "").limit(1)


def by_date_then_name(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("date").asc_nulls_last(), "name")


def truthy(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))
