"""Vectorisation of documents into a store of chunks, batch by batch; a run that broke off takes up where it stopped.

A run first writes its plan: for every document whether its chunks are skipped, rebuilt or purged, and its batch. Batches
are groups of the store's buckets, so a run rewrites each bucket at most once. Every batch is one commit of the store
under the run's name and the batch's number: what is committed is not done again, and a batch that broke off left nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import pipelines, prompts, sync
from lexispark.operators.lease import Lease
from lexispark.operators.store import BUCKETS, BucketStore, replace_keys

CHUNKS = "source_id long, document_id long, chunk_index int, chunk_count long, content string, content_hash string, point_id string, text_hash string, embedding array<double>"
#: Characters of a batch's documents, about: what is lost when a run breaks off.
BATCH_CHARS = 1 << 33


def chunk_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, CHUNKS, ("document_id",), buckets)


def current(store: BucketStore, docs: DataFrame) -> DataFrame:
    """document_id, current: the store has all chunks of the document's present text."""
    held = store.rows().select("document_id", "chunk_index", F.col("chunk_count").alias("expected_count"), "text_hash")
    texts = docs.select("document_id", _text_hash().alias("_hash"))
    return sync.current_documents(held.join(texts, "document_id").withColumn("matches", F.col("text_hash").eqNullSafe(F.col("_hash"))))


def _text_hash() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def plan(store: BucketStore, docs: DataFrame, run: str, force: bool = False, batch_chars: int = BATCH_CHARS) -> tuple[DataFrame, int]:
    """document_id, action and batch of a run, written by its first call and read by later ones; and the number of batches.
    Documents of the store that ``docs`` has no more are purged."""
    known = store.read(f"runs/{run}.json")
    if known is None:
        actions = sync.rebuild_plan(docs.select("source_id", "document_id", "is_active"), current(store, docs), force).select("document_id", "action")
        lost = store.rows().select("document_id").distinct().join(docs, "document_id", "left_anti").withColumn("action", F.lit("purge"))
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        batches = max(1, min(store.buckets, -(-chars // batch_chars)))
        folder = f"plan-{uuid.uuid4().hex}"
        rows = actions.unionByName(lost).withColumn("batch", F.pmod(store.bucket(), F.lit(batches)))
        rows.write.partitionBy("batch").parquet(f"{store.path}/runs/{folder}")
        store.create(f"runs/{run}.json", {"folder": folder, "batches": batches})
        known = store.read(f"runs/{run}.json")
    rows = store.spark.read.schema("document_id long, action string, batch int").parquet(f"{store.path}/runs/{known['folder']}")
    return rows, known["batches"]


def vectorize(
    store: BucketStore, docs: DataFrame, run: str, embed: Callable[[Column], Column], force: bool = False, batch_chars: int = BATCH_CHARS,
    lease: Lease | None = None, before: Callable[[int], None] = lambda batch: None,
) -> dict[str, int]:
    """Brings the chunks of ``docs(source_id, document_id, is_active, source_type, document_type, text)`` into the store.

    ``run`` names the run: called again with the same name, it does the batches that are not committed yet. ``embed``
    maps the passage input of a chunk to its vector; ``before`` is told each batch that begins. Returns the numbers of
    batches done now and in all, and of documents rebuilt, purged and skipped by the whole run.
    """
    planned, batches = plan(store, docs, run, force, batch_chars)
    done = 0
    for b in range(store.applied(run) + 1, batches):
        before(b)
        mine = planned.filter(F.col("batch") == b)
        changed = mine.filter("action <> 'skip'").select("document_id")
        wanted = docs.join(mine.filter("action = 'rebuild'").select("document_id"), "document_id", "left_semi")
        rows = pipelines.planned_chunks(pipelines.judged_chunks(wanted)).withColumnRenamed("document_chunk_count", "chunk_count")
        rows = rows.join(wanted.select("document_id", _text_hash().alias("text_hash")), "document_id")
        rows = rows.withColumn("embedding", embed(prompts.passage_input(F.col("content"))))
        done += store.commit(run, b, changed, replace_keys(rows.select(store.schema.names), changed, "document_id"), lease)
    n = {r["action"]: r["count"] for r in planned.groupBy("action").count().collect()}
    return {"done": done, "batches": batches, "rebuilt": n.get("rebuild", 0), "purged": n.get("purge", 0), "skipped": n.get("skip", 0)}
