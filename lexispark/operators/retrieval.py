"""Candidate retrieval: exact cosine top-N, validity joins, a cap for each document, context budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions.vectors import cosine
from lexispark.operators.vector_index import VectorIndex


def top_n(points: DataFrame, query: DataFrame, limit: int = 100) -> DataFrame:
    """vec_id, score of the ``limit`` points nearest to the one row of ``query(q)``; ties by id."""
    one = F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))
    scored = points.crossJoin(one).select("vec_id", F.round(cosine(F.col("embedding"), F.col("_q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(limit)


def top_n_each(points: DataFrame, queries: DataFrame, limit: int = 100, unit: bool = True, own: bool = True, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``limit`` nearest of ``points`` (both vec_id,
    embedding) by cosine, or by inner product where not ``unit``; ties by id; without ``own``, a query does not meet its
    own id. Exact, over an index of so many inverted lists (see VectorIndex)."""
    found = VectorIndex(points, unit, lists).search(queries, limit, own)[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def retrieve_each(points: DataFrame, queries: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame, limit: int = 20, over_fetch: int = 100, most: int = 4) -> DataFrame:
    """``retrieve`` for every row of ``queries``: query_id and its valid hits."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    hits = top_n_each(points, queries, max(over_fetch, limit)).select("query_id", "vec_id", "score")
    found = chunks.withColumnRenamed("id", "chunk_id").join(hits, F.col("chunk_id") == F.col("vec_id"))
    found = found.join(docs.filter("is_active").select(F.col("id").alias("document_id"), "source_id"), "document_id")
    found = found.join(sources.filter("status = 'indexed'").select(F.col("id").alias("source_id")), "source_id")
    if most > 0:
        capped = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_id")
        found = found.withColumn("_rn", F.row_number().over(capped)).filter(F.col("_rn") <= most)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).select("query_id", "source_id", "document_id", "chunk_id", "chunk_index", "score")


def valid_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits whose chunk, active document and indexed source exist."""
    found = chunks.join(hits, chunks["id"] == hits["vec_id"]).select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "score")
    found = found.join(docs.filter("is_active").select(F.col("id").alias("document_id"), "source_id"), "document_id")
    return found.join(sources.filter("status = 'indexed'").select(F.col("id").alias("source_id")), "source_id")


def cap_per_document(hits: DataFrame, most: int = 4) -> DataFrame:
    if most <= 0:
        return hits
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")


def retrieve(points: DataFrame, query: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame, limit: int = 20, over_fetch: int = 100, most: int = 4) -> DataFrame:
    """The filter stays above the over-fetch: what is invalid uses up places among the first ``over_fetch``."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    hits = top_n(points, query, max(over_fetch, limit))
    return cap_per_document(valid_hits(hits, chunks, docs, sources), most).orderBy(F.desc("score"), "chunk_id").limit(limit)


def limit_context(ranked: DataFrame, most: int = 12_000) -> DataFrame:
    """Of ``ranked(query_id, rank, text)``, blank texts aside, the prefix of each query whose lengths sum to at most
    ``most``; the first is always kept."""
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = ranked.filter(F.length(F.trim("text")) > 0)
    kept = kept.withColumn("_sum", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(order))
    return kept.filter((F.col("_sum") <= most) | (F.col("_rn") == 1)).withColumn("citation", F.concat(F.lit("S"), F.col("_rn").cast("string"))).drop("_sum", "_rn")


# Why a hit is not used, in the order the reasons are tried.
VERDICTS = ("missing_chunk", "missing_document", "inactive_document", "missing_source", "source_status", "document_limit", "valid")


def judged_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame, most: int = 4) -> DataFrame:
    """``hits(query_id, chunk_id, score)``, all of them, each with its verdict; only valid hits count towards ``most``
    (<= 0: no limit). chunk_id may be a string; what is not a number is missing."""
    known = chunks.select(F.col("id").alias("_chunk"), "document_id", "chunk_index")
    known = known.join(docs.select(F.col("id").alias("document_id"), F.lit(True).alias("_document"), "source_id", "is_active"), "document_id", "left")
    known = known.join(sources.select(F.col("id").alias("source_id"), F.lit(True).alias("_source"), "status"), "source_id", "left")
    found = hits.join(known, F.col("chunk_id").try_cast("long") == F.col("_chunk"), "left")
    reason = (
        F.when(F.col("_chunk").isNull(), "missing_chunk")
        .when(F.col("_document").isNull(), "missing_document")
        .when(~F.coalesce("is_active", F.lit(False)), "inactive_document")
        .when(F.col("_source").isNull(), "missing_source")
        .when(~F.col("status").eqNullSafe("indexed"), "source_status")
        .otherwise("valid")
    )
    found = found.withColumn("verdict", reason).drop("_chunk", "_document", "_source")
    if most > 0:
        order = Window.partitionBy("query_id", "document_id", "verdict").orderBy(F.desc("score"), "chunk_id")
        over = (F.col("verdict") == "valid") & (F.row_number().over(order) > most)
        found = found.withColumn("verdict", F.when(over, "document_limit").otherwise(F.col("verdict")))
    return found


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("query_id").agg(F.count("*").alias("hits"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def retrieve_top(points: DataFrame, queries: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame, top_k: int = 5, multiplier: int = 20) -> DataFrame:
    """The plain form of ``retrieve_each``: ``top_k`` hits of the best ``top_k * multiplier``, three a document."""
    return retrieve_each(points, queries, chunks, docs, sources, top_k, max(top_k * multiplier, top_k), 3)


def containing(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows in which the joined columns contain a term, case aside."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.lower())))


def chunks_of_source(chunks: DataFrame, docs: DataFrame, source_id: int | None = None) -> DataFrame:
    """Chunks with the source of their document (of one source if wanted), in order of document and index."""
    known = docs.select(F.col("id").alias("document_id"), "source_id")
    known = known if source_id is None else known.filter(F.col("source_id") == source_id)
    return chunks.join(known, "document_id").orderBy("document_id", "chunk_index")


def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its chunks in order, none being an empty list: a group is what one document was cut into."""
    grouped = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("id").alias("chunk_id")))).alias("chunks"))
    joined = docs.join(grouped, docs["id"] == grouped["document_id"], "left")
    return joined.select(docs["id"], F.coalesce("chunks", F.array().cast("array<struct<chunk_index:bigint,chunk_id:bigint>>")).alias("chunks"))
