"""Whole runs as plans: ingest a source, plan its chunks and points, answer questions, evaluate rankings, import hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions import classify, documents, ids, text
from lexispark.operators import evaluation, prompts, retrieval, sync
from lexispark.session import short_batches
from lexispark.storage import settled

KEY = ("source_id", "external_id")


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; keys of both have the value of the second."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def parse_files(grabbed: DataFrame) -> DataFrame:
    """``grabbed(source_id, external_id, name, extension, mime_type, content, metadata)`` with route, document_type, cleaned
    text, content_hash and error: one that cannot be read stops none of the others."""
    route = classify.parser_route(F.col("extension"), F.col("mime_type"))
    known = grabbed.withColumn("route", route).withColumn("document_type", F.when(F.col("route") == "text", classify.document_type(F.col("extension"), F.col("mime_type"))).otherwise(F.col("route")))
    named = F.concat(F.lit("file"), F.coalesce("extension", F.lit("")))
    parsed = known.withColumn("text", text.clean(F.when(F.col("route").isNotNull(), documents.parsed_text(named, F.col("content")))))
    unsupported = F.concat(F.lit("Unsupported file type: "), F.coalesce(F.nullif(F.col("extension"), F.lit("")), F.lit("unknown")))
    error = F.when(F.col("route").isNull(), unsupported).when(F.coalesce("text", F.lit("")) == "", F.concat(F.lit("No text could be extracted from "), "name"))
    own = F.create_map(F.lit("parser"), F.col("route"))
    return parsed.withColumn("error", error).withColumn("content_hash", ids.content_hash(F.col("text"))).withColumn("metadata", merged(F.coalesce("metadata", F.create_map().cast("map<string,string>")), own)).drop("content")


def ingest(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed files are written out once, without their texts, before both sides are taken from them: no file is read or
    parsed twice. One row a key (source_id, external_id) of either side with outcome, error and the resulting document.

    ``existing(source_id, external_id, content_hash, version, is_active, title, metadata)``; ``parsed`` as of parse_files,
    keys unique. What failed counts as seen: it stays as it was, active or not, with outcome ``failed``; a failed key
    that was not there before has no version. The rest is upsert_documents, by which missing documents go inactive.
    """
    parsed = settled(parsed.select(*KEY, "content_hash", "name", "metadata", "error"), "parsed")
    good = parsed.filter("error IS NULL").select(*KEY, "content_hash", F.col("name").alias("title"), "metadata")
    failed = parsed.filter("error IS NOT NULL").select(*[F.col(k).alias(f"_{k}") for k in KEY], "error")
    planned = sync.upsert_documents(existing, good)
    same = F.col("source_id").eqNullSafe(F.col("_source_id")) & F.col("external_id").eqNullSafe(F.col("_external_id"))
    both = planned.join(failed, same, "full")
    broke = F.col("error").isNotNull()
    return both.select(
        F.coalesce("source_id", "_source_id").alias("source_id"), F.coalesce("external_id", "_external_id").alias("external_id"), F.when(broke, "failed").otherwise(F.col("outcome")).alias("outcome"),
        "error", "title", "metadata", "content_hash", "version", F.when(broke & (F.col("outcome") == "deactivated"), True).otherwise(F.col("is_active")).alias("is_active"),
    )


def source_status(outcomes: DataFrame) -> DataFrame:
    """source_id, counts, status and error of every source of ``ingest``'s rows: failed if nothing of it could be read."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = outcomes.groupBy("source_id").agg(*[n(o).alias(o) for o in ("created", "updated", "skipped", "failed", "deactivated")])
    done = F.col("created") + F.col("updated") + F.col("skipped")
    error = F.when((done == 0) & (F.col("failed") == 0), "no documents were found").when(done == 0, "no document could be read")
    return counts.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "indexed").otherwise("failed"))


def judged_chunks(docs: DataFrame) -> DataFrame:
    """source_id, document_id, raw_index, content, reason of all chunks of ``docs(source_id, document_id, source_type,
    document_type, text)``: texts are cleaned, cut, and every chunk is cleaned again and judged."""
    short_batches(docs.sparkSession)
    kind, form = F.col("source_type"), F.col("document_type")
    code = classify.is_code(kind, form)
    whole = docs.withColumn("text", documents.clean_document(F.col("text"), kind, code))
    rows = whole.select("source_id", "document_id", "source_type", "document_type", F.posexplode(documents.normal_chunks("text", "source_type", "document_type")).alias("raw_index", "chunk"))
    # Content and reason come out of a generator: a later filter on the reason would otherwise clean every chunk once more
    # for each place where the reason looks at it.
    judged = text.let(documents.cleaned_lines(F.col("chunk"), kind, code), lambda c: F.struct(c.alias("content"), documents.chunk_quality_reason(c, kind, form).alias("reason")))
    return rows.select("source_id", "document_id", "raw_index", F.inline(F.array(judged)))


def planned_chunks(judged: DataFrame) -> DataFrame:
    """The useful chunks as they are stored: indexes 0..n-1 anew, how many the document has, hash and point id."""
    kept = judged.filter("reason = 'useful'").withColumnRenamed("raw_index", "chunk_index").drop("reason")
    digest = ids.content_hash(F.col("content"))
    rows = prompts.reindex(kept).withColumn("content_hash", digest)
    return rows.withColumn("point_id", ids.point_id(F.col("source_id"), F.col("document_id"), F.col("chunk_index"), F.col("content_hash")))


def vectorize(docs: DataFrame, current: DataFrame, embed: Callable[[Column], Column], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The plan for all documents (see sync.rebuild_plan), and the chunks with embeddings of those to be rebuilt. ``embed``
    maps the passage input to a vector: a column function or an Arrow-batched model. Old rows of purged and rebuilt
    documents are replaced in one overwrite, so that a failed run leaves the former state."""
    plan = sync.rebuild_plan(docs.select("source_id", "document_id", "is_active"), current, force)
    wanted = docs.join(plan.filter("action = 'rebuild'").select("document_id"), "document_id", "left_semi")
    return plan, planned_chunks(judged_chunks(wanted)).withColumn("embedding", embed(prompts.passage_input(F.col("content"))))


def replaced(old: DataFrame, plan: DataFrame, new: DataFrame) -> DataFrame:
    """Rows after a run: of ``old`` those of documents that were skipped, and ``new``."""
    gone = plan.filter("action <> 'skip'").select("document_id")
    return old.join(gone, "document_id", "left_anti").unionByName(new)


def ask(
    questions: DataFrame, points: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame, score: Callable[[Column, Column], Column],
    history: DataFrame | None = None, candidates: int = 20, over_fetch: int = 100, most: int = 4, top: int = 5, budget: int = 12_000,
) -> tuple[DataFrame, DataFrame]:
    """Context rows and prompts of all ``questions(query_id, question, embedding)`` at once.

    Candidates (retrieve_each) are re-ranked by ``score(question, text)``, the best ``top`` cut to ``budget`` characters and
    numbered; a question without context has its prompt too. ``chunks(id, document_id, chunk_index, text)``, ``docs(id,
    source_id, is_active, title, external_id)``, ``sources(id, status, name, source_type, uri)``. Texts join the hits
    by a shuffle on the chunk, after the cut to ``candidates`` a question.
    """
    asked = questions.select(F.col("query_id").alias("vec_id"), "embedding")
    found = retrieval.retrieve_each(points, asked, chunks.select("id", "document_id", "chunk_index"), docs, sources, candidates, over_fetch, most)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    told = ranked.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").join(questions.select("query_id", "question"), "query_id")
    best = prompts.rerank(told.withColumn("rerank_score", score(F.col("question"), F.col("text"))), top)
    kept = retrieval.limit_context(best.withColumn("rank", F.col("new_rank")).drop("new_rank", "question"), budget)
    kept = kept.join(docs.select(F.col("id").alias("document_id"), "title", "external_id"), "document_id")
    kept = kept.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type", "uri"), "source_id")
    kept = kept.withColumn("reference", prompts.reference(F.col("source_type"), F.col("uri"), F.col("external_id"), F.col("title")))
    return kept, prompts.prompt(questions.select("query_id", "question"), kept, history)


def evaluate(candidates: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = evaluation.DEFAULT_KS) -> DataFrame:
    """ranking_metrics of both orders of ``candidates(case_id, rank, document_id, rerank_score)``, told apart by
    ``pipeline``: baseline (rank) and reranked (all candidates by score, missing scores last)."""
    order = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    again = candidates.withColumn("rank", F.row_number().over(order))
    sides = {"baseline": candidates, "reranked": again}
    out = [evaluation.ranking_metrics(d.select("case_id", "rank", "document_id"), relevant, ks).withColumn("pipeline", F.lit(p)) for p, d in sides.items()]
    return out[0].unionByName(out[1])


def researched(hits: DataFrame, attempts: int = 3) -> DataFrame:
    """Status of every hit of ``hits(query_id, rank, url, known, importable)`` of a web search: blocked, indexed, duplicate
    (known already; that counts as an attempt), failed, or untried after the first success or ``attempts`` tries."""
    judged = hits.withColumn("blocked", classify.is_blocked(F.col("url"))).withColumn("indexed", F.col("importable") & ~F.col("known"))
    tried = prompts.attempted(judged, attempts).select("query_id", "rank", F.lit(True).alias("_tried"))
    status = F.when(F.col("blocked"), "blocked").when(F.col("_tried").isNull(), "untried").when(F.col("known"), "duplicate").when(F.col("importable"), "indexed").otherwise("failed")
    return judged.join(tried, ["query_id", "rank"], "left").withColumn("status", status).select("query_id", "rank", "url", "status")


def imported(hits: DataFrame, results: DataFrame, clean_up: bool = False) -> tuple[DataFrame, DataFrame]:
    """What became of ``hits(position, source_id, outcome)``, registered as added, duplicate or invalid, by the runs of
    ``results(source_id, status, error)``, and the sources to remove: those that failed, if ``clean_up``. Null status: crashed."""
    added = F.col("outcome") == "added"
    joined = hits.join(results, "source_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
    failed = added & ~F.col("status").isin("indexed", "busy")
    busy = F.coalesce("error", F.lit("Source is already being indexed."))
    error = F.when(~added, F.col("outcome")).when(F.col("status") == "busy", busy).when(failed, F.col("error"))
    status = F.when(F.col("outcome") == "duplicate", "duplicate").when(~added, "failed").otherwise(F.col("status"))
    kept = added & ~failed if clean_up else added
    told = joined.select("position", F.when(kept, F.col("source_id")).alias("source_id"), status.alias("status"), error.alias("error"))
    return told, joined.filter(failed & F.lit(clean_up)).select("source_id")
