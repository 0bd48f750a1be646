"""Incremental synchronisation of a document table with what a source holds now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plan_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each natural key (source_id, external_id) of either side, with the outcome and the resulting state.

    created: new key, version 1; skipped: same hash, active again; updated: other hash, version + 1; deactivated: not
    seen any more. ``existing(source_id, external_id, content_hash, version, is_active)``, ``incoming(source_id,
    external_id, content_hash)``.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    same_key = F.col("e.source_id").eqNullSafe(F.col("i.source_id")) & F.col("e.external_id").eqNullSafe(F.col("i.external_id"))
    old, new = F.col("e.version").isNotNull(), F.col("i.content_hash").isNotNull()
    same = F.col("e.content_hash").eqNullSafe(F.col("i.content_hash"))
    outcome = F.when(~old, "created").when(new & same, "skipped").when(new, "updated").when(F.col("e.is_active") & (F.coalesce("e.external_id", F.lit("")) != ""), "deactivated").otherwise("kept")
    return e.join(i, same_key, "full").select(
        F.coalesce("e.source_id", "i.source_id").alias("source_id"), F.coalesce("e.external_id", "i.external_id").alias("external_id"), outcome.alias("outcome"),
        F.coalesce("i.content_hash", "e.content_hash").alias("content_hash"), F.when(~old, F.lit(1)).when(new & ~same, F.col("e.version") + 1).otherwise(F.col("e.version")).cast("int").alias("version"),
        F.when(new, F.lit(True)).when(outcome == "deactivated", F.lit(False)).otherwise(F.col("e.is_active")).alias("is_active"),
    )


def current_documents(chunks: DataFrame) -> DataFrame:
    """document_id, current: whether a document's chunks are complete: all metadata match, one expected count, which is
    the count there is, and indexes 0..n-1. ``chunks(document_id, chunk_index, expected_count, matches)``."""
    n = F.count("*")
    whole = F.bool_and("matches") & (F.min("expected_count") == F.max("expected_count")) & (F.max("expected_count") == n)
    whole = whole & (F.min("chunk_index") == 0) & (F.max("chunk_index") == n - 1) & (F.count_distinct("chunk_index") == n)
    return chunks.groupBy("document_id").agg(F.coalesce(whole, F.lit(False)).alias("current"))


def orphan_points(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points whose chunk_id is missing, or whose chunk names another point. ``points(point_id, chunk_id)``."""
    valid = chunks.filter(F.coalesce("point_id", F.lit("")) != "").select(F.col("id").alias("chunk_id"), "point_id")
    return points.join(valid, ["chunk_id", "point_id"], "left_anti")


def scan_counts(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: points scanned, valid and orphans. ``chunks`` has one row an id."""
    known = chunks.filter(F.coalesce("point_id", F.lit("")) != "").select(F.col("id").alias("chunk_id"), "point_id", F.lit(1).alias("_known"))
    joined = points.join(known, ["chunk_id", "point_id"], "left")
    return joined.agg(F.count("*").alias("scanned"), F.count("_known").alias("valid"), (F.count("*") - F.count("_known")).alias("orphan"))


def latest_points(existing: DataFrame, incoming: DataFrame, order: str = "write_order") -> DataFrame:
    """Upsert by point_id, the last write wins: rows of ``existing`` that ``incoming`` replaces go, and of the rows of
    ``incoming`` with one id the one of greatest ``order`` stays (a column that the result does not have)."""
    last = Window.partitionBy("point_id").orderBy(F.desc(order))
    newest = incoming.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", order)
    return existing.join(newest.select("point_id"), "point_id", "left_anti").unionByName(newest)


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``plan_upsert`` with title and metadata: what is skipped keeps its title and takes the new metadata, what is
    updated or created takes both, what is not seen keeps both."""
    key = ["source_id", "external_id"]
    plan = plan_upsert(existing, incoming)
    for side, name in ((existing, "old"), (incoming, "new")):
        held = side.select(*[F.col(k).alias(f"_{k}") for k in key], F.struct("title", "metadata").alias(name))
        plan = plan.join(held, F.col("source_id").eqNullSafe(F.col("_source_id")) & F.col("external_id").eqNullSafe(F.col("_external_id")), "left").drop("_source_id", "_external_id")
    seen = F.col("new").isNotNull()
    title = F.when(seen & (F.col("outcome") != "skipped"), F.col("new.title")).otherwise(F.col("old.title"))
    return plan.withColumn("title", title).withColumn("metadata", F.when(seen, F.col("new.metadata")).otherwise(F.col("old.metadata"))).drop("old", "new")


def outcome_counts(outcomes: DataFrame, shown: int = 3) -> DataFrame:
    """One row of ``outcomes(external_id, outcome, error)``: created, updated, skipped, failed, and the first ``shown``
    messages of those that failed, by external_id."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "skipped", "failed")]
    total = outcomes.agg(*counts)
    first = outcomes.filter("outcome = 'failed'").select("external_id", "error").orderBy("external_id").limit(shown)
    return total.crossJoin(first.agg(F.transform(F.array_sort(F.collect_list(F.struct("external_id", "error"))), lambda x: x["error"]).alias("messages")))


def rebuild_plan(documents: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """document_id, action for all ``documents(document_id, is_active)``: inactive ones are purged, current ones (by
    ``current(document_id, current)``) skipped unless ``force``, the rest is rebuilt. ``scope`` says how old chunks go:
    by source where nothing of it is skipped, else by document."""
    known = documents.join(current, "document_id", "left")
    skipped = F.col("is_active") & F.coalesce("current", F.lit(False)) & F.lit(not force)
    known = known.withColumn("action", F.when(~F.col("is_active"), "purge").when(skipped, "skip").otherwise("rebuild"))
    of_source = known.groupBy("source_id").agg(F.count_if(F.col("action") == "skip").alias("n_skipped"))
    whole = F.when(F.col("n_skipped") == 0, "source").otherwise("document")
    return known.join(of_source, "source_id").select("source_id", "document_id", "action", F.when(F.col("action") != "skip", whole).alias("scope"))
