"""Continuous harvests: the ``oaipmh`` stream into partitioned Parquet, and event-time rollups of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.protocol import directory_key
from ..sources.oaipmh import OaiPmh


def stream(spark: SparkSession, **options: str) -> DataFrame:
    """Pages of new days, as they become complete."""
    spark.dataSource.register(OaiPmh)
    return spark.readStream.format("oaipmh").options(**options).load()


def store(pages: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append pages under their harvest's key and until-date; the checkpoint is the resume point. ``once`` takes what is there and stops."""
    keyed = pages.withColumn("harvest", directory_key(F.col("set"), F.col("prefix"), F.col("endpoint")))
    writer = keyed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("harvest", "until_date")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def changes(records: DataFrame, stamp: str = "ts", key: str = "key", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records and distinct-by-sketch keys for each tumbling window of event time; later ones than ``late`` are dropped.

    Works the same on a stream (with a watermark) and on a table.
    """
    timed = records.withWatermark(stamp, late) if records.isStreaming else records
    found = timed.groupBy(F.window(stamp, window), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
