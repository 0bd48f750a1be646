"""Incremental re-sync as a stream: each micro-batch of incoming documents is merged into the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lexispark.operators import sync
from lexispark.operators.store import BUCKETS, BucketStore

STATE = "source_id long, external_id string, content_hash string, version int, is_active boolean"
INCOMING = "source_id long, external_id string, content_hash string, seq long"
KEY = ("source_id", "external_id")


def document_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, STATE, KEY, buckets)


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Within a batch the highest ``seq`` of a key wins; a stream never sees a whole source, so nothing is deactivated."""
    last = Window.partitionBy("source_id", "external_id").orderBy(F.desc("seq"), "content_hash")
    newest = incoming.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    plan = sync.plan_upsert(existing, newest.select("source_id", "external_id", "content_hash"))
    return plan.withColumn("is_active", F.col("is_active") | (F.col("outcome") == "deactivated")).drop("outcome")


def start(store: BucketStore, drop: str, checkpoint: str, name: str = "resync", files: int = 100) -> StreamingQuery:
    """Reads JSON files of ``drop`` as they come; micro-batch n is commit n of the store, which rewrites the buckets of the
    batch's keys only. A batch that is run again after a failure is either committed already or was not seen at all.
    Every hundredth batch drops the files that no late reader needs any more."""

    def upsert(batch: DataFrame, n: int) -> None:
        store.commit(name, n, batch, lambda old: merge(old, batch))
        if n % 100 == 99:
            store.vacuum()

    return store.spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files).json(drop).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
