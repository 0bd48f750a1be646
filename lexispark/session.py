"""Spark session with the settings the engine is written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings that hold at every size; partition counts and memory are left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str | None = None, app: str = "lexispark", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows that Python is handed at once where they are whole texts or blocks.
BATCH_ROWS = 250
#: And about so many bytes of them, one row at least: of long texts the rows alone would be up to Spark's 64 MB.
BATCH_BYTES = 4 << 20


ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Large rows: a Python worker holds BATCH_ROWS of them at most, however many a task has, and BATCH_BYTES, however long
    they are, unless the session sets a bound of bytes itself."""
    if not 0 < int(spark.conf.get(ROWS_KEY, "10000")) <= BATCH_ROWS:
        spark.conf.set(ROWS_KEY, str(BATCH_ROWS))
    if spark.conf.get(BYTES_KEY, None) is None:
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what is written inside: Python is handed so many rows at once; then the session's setting holds again."""
    before = spark.conf.get(ROWS_KEY, "10000")
    spark.conf.set(ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_KEY, before)
