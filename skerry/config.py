"""Places and settings: the base folder of harvests, a workspace for intermediate files, a log tee, list flags."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def base_dir() -> str:
    """SKERRY_DIR, or a folder in the user's cache."""
    cache = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.environ.get("SKERRY_DIR") or os.path.join(cache, "skerry")


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a local one where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='skerry-')).rstrip('/')}/work-{uuid.uuid4().hex}"


def list_flag(values: list[str]) -> str:
    """A repeated flag as it is shown."""
    return ", ".join(values)


class Tee(logging.Handler):
    """Copies records of a level or above to a second writer."""

    def __init__(self, writer, level: int = logging.WARNING):
        super().__init__(level)
        self.writer = writer

    def emit(self, record: logging.LogRecord) -> None:
        self.writer.write(self.format(record) + "\n")


def session(name: str = "skerry", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; a cluster's own settings win over them."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
