"""Registered queries over tables that are written, changed in place and read again: stores, runs, streams, the vector index."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import content, documents, ids, vocabulary
from lexispark.operators import adapter, registry, store, sync, vectorize
from lexispark.operators.keyword_index import KeywordIndex
from lexispark.operators.vector_index import VectorIndex
from lexispark.plans.queries import _SYNC, _VIEWS, _sides, asked_points, query, table, views
from lexispark.sources import paged
from lexispark.storage import Scratch
from lexispark.streaming import entries, resync


@query(f"{_SYNC} SELECT source_id, external_id, content_hash, version, CASE outcome WHEN 'deactivated' THEN true WHEN 'kept' THEN false ELSE is_active END AS is_active FROM plan")
def snk2_store_upsert(spark, sf_dir):
    """SNK-2 in place: what there is goes into a store, then two halves of what comes, each a commit; the second is replayed."""
    existing, incoming = _sides(spark, sf_dir)
    kept = resync.document_store(spark, f"{Scratch(spark, 'documents').path}/store", 8)
    kept.commit("load", 0, existing, lambda _: existing)
    for n in (0, 1, 1):
        half = incoming.filter(F.col("source_id") % 2 == n).withColumn("seq", F.lit(0))
        kept.commit("sync", n, half, lambda old, half=half: resync.merge(old, half))
    return kept.rows()


@query("""SELECT 'p' || vec_id AS point_id, CASE WHEN vec_id % 3 = 0 THEN 'third' WHEN vec_id % 2 = 0 THEN 'second' ELSE 'first' END AS payload, CASE WHEN vec_id % 3 = 0 THEN vec_id + 2 WHEN vec_id % 2 = 0 THEN vec_id + 1 ELSE vec_id END AS chunk_id FROM embeddings""")
def snk7_store_points(spark, sf_dir):
    """SNK-7 in place: points are written three times, each time fewer of them, some of them twice within a batch."""
    kept = store.BucketStore(spark, f"{Scratch(spark, 'points').path}/store", "point_id string, payload string, chunk_id long", ("point_id",), 8)
    rows = table(spark, sf_dir, "embeddings")
    for n, (name, every) in enumerate((("first", 1), ("second", 2), ("third", 3))):
        batch = rows.filter(F.col("vec_id") % every == 0).select(F.concat(F.lit("p"), "vec_id").alias("point_id"), F.lit(name).alias("payload"), (F.col("vec_id") + n).alias("chunk_id"), F.lit(1).alias("write_order"))
        twice = batch.unionByName(batch.filter("chunk_id % 5 = 0").withColumn("payload", F.lit("stale")).withColumn("write_order", F.lit(0)))
        kept.commit("points", n, twice, lambda old, twice=twice: sync.latest_points(old, twice))
    return kept.rows()


@query(f"""WITH {_VIEWS}, p AS (SELECT c.id, c.document_id FROM chunks c WHERE c.document_id % 7 <> 3)
SELECT d.id AS document_id, d.source_id, count(p.id) AS n_points FROM docs d LEFT JOIN p ON p.document_id = d.id GROUP BY ALL""")
def snk9_bucketed_points(spark, sf_dir):
    """SNK-9 with JN-7, JN-1 and SNK-8: points in a bucketed table; those of some documents are removed, the rest is counted
    for every document, without a shuffle of points."""
    chunks, docs, _ = views(spark, sf_dir)
    name = f"points_{uuid.uuid4().hex}"
    registry.ensure_points_table(spark, name, 8, f"{Scratch(spark, 'bucketed').path}/points")
    rows = chunks.join(docs.select(F.col("id").alias("document_id"), "source_id"), "document_id", "left")
    points = registry.insert_points(rows.select(F.concat(F.lit("p"), "id").alias("point_id"), "source_id", "document_id", F.col("id").alias("chunk_id"), F.lit(None).cast("array<float>").alias("embedding")), name)
    left = registry.delete_points(points, docs.filter("id % 7 = 3").select(F.col("id").alias("document_id")), "document_id")
    return registry.points_by_document(left, docs)


@query()
def pip2_vectorized(spark, sf_dir):
    """PIP-2 into a store: a run over all documents in batches, then one in which a fifth of them is inactive. The vectors
    are the chunks' lengths."""
    kind = "element_at(array('web', 'git', 'file', 'api'), cast(doc_id % 4 + 1 AS int)) AS source_type"
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id % 4 AS source_id"), F.col("doc_id").alias("document_id"), F.lit(True).alias("is_active"), F.expr(kind), F.expr("CASE WHEN doc_id % 4 = 1 THEN 'code' ELSE 'text' END AS document_type"), "text")
    kept = vectorize.chunk_store(spark, f"{Scratch(spark, 'vectorize').path}/store", 8)
    embed = lambda c: F.array(F.length(c).cast("double"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    vectorize.vectorize(kept, docs, "first", embed, batch_chars=chars // 3 + 1)
    vectorize.vectorize(kept, docs.withColumn("is_active", F.col("document_id") % 5 != 2), "second", embed)
    return kept.rows().select("source_id", "document_id", "chunk_index", "chunk_count", "content_hash", "point_id", F.col("embedding")[0].alias("vector"))


@query("""SELECT event_type AS logger, event_id AS entry_id, epoch_us(ts) AS us, props AS message
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 500""")
def agg12_last_entries_stream(spark, sf_dir):
    """AGG-12 and FLT-23 as a stream (an extra): the last 500 entries of every logger as keyed state, kept in a store."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as a stream takes no single file
    stream = stream.select(F.col("event_type").alias("logger"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("message"))
    place = Scratch(spark, "entries").path
    kept = store.BucketStore(spark, f"{place}/store", entries.ENTRY, ("logger",), 8)
    entries.start(stream, kept, f"{place}/marks", late="36500 days").awaitTermination()
    return kept.rows().select("logger", "entry_id", F.unix_micros("ts").alias("us"), "message")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def agg12_hourly_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("logger"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"))
    return entries.windowed_counts(rows).select(F.unix_micros("start").alias("start_us"), "kind", "n")


@query()
def top1_index_visits(spark, sf_dir):
    """TOP-1: for each question of top1_vector_top_n, how many lists and vectors of the index were visited."""
    points, asked = asked_points(spark, sf_dir)
    return VectorIndex(points).search(asked, 100)[1]


@query("SELECT vec_id AS point_id, label AS source_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE label IN (2, 5, 7) AND vec_id % 2 = 0")
def src10_paged_points(spark, sf_dir):
    """SRC-10 by the paged data source: all points as pages of a store, read in ranges of pages with a filter that the store
    applies and one that Spark does."""
    path = f"{Scratch(spark, 'paged').path}/store"
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("source_id"), F.col("embedding")[0].cast("double").alias("first"))
    paged.write_pages(points, path, "point_id", 100)
    rows = paged.register(spark).read.format("paged").schema("point_id long, source_id long, first double").option("path", path).option("filters", "source_id").option("pages", 2).load()
    return rows.filter(F.col("source_id").isin(2, 5, 7) & (F.col("point_id") % 2 == 0))


def _reply(text: str) -> str:
    """A stand-in for a model: some texts are over its limits for a while, some are refused, some get an empty reply."""
    if len(text) % 10 == 3:
        raise RuntimeError("503 service unavailable")
    if len(text) % 10 == 7:
        raise RuntimeError("input was refused")
    return "" if len(text) % 50 == 4 else f"{len(text)} characters"


@query("""WITH c AS (SELECT conv_id * 100000 + turn AS id, length(coalesce(text, '')) AS n FROM conversations)
SELECT id, CASE WHEN n % 10 IN (3, 7) OR n % 50 = 4 THEN 'refused' ELSE 'done' END AS status, CASE WHEN n % 10 = 3 OR n % 50 = 4 THEN 2 ELSE 1 END::INTEGER AS attempts,
  CASE WHEN n % 10 IN (3, 7) OR n % 50 = 4 THEN NULL ELSE n || ' characters' END AS reply, CASE WHEN n % 10 = 3 THEN 'RuntimeError: 503 service unavailable' WHEN n % 10 = 7 THEN 'RuntimeError: input was refused' WHEN n % 50 = 4 THEN 'empty reply' END AS error FROM c""")
def misc5_called_replies(spark, sf_dir):
    """MISC-5, FN-14 and FLT-24: a call for every message, in two runs; the second one has nothing left to call."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("input"))
    kept = adapter.outcome_store(spark, f"{Scratch(spark, 'calls').path}/store", 4)
    for _ in range(2):
        adapter.call_open(kept, rows, _reply, batches=2, tries=2, wait=0.001)
    return kept.rows()


@query("""WITH e AS (SELECT 'p' || vec_id AS point_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE vec_id END AS chunk_id FROM embeddings),
c AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 17 = 0 THEN 'q' ELSE 'p' || vec_id END AS point_id FROM embeddings WHERE vec_id % 19 <> 0)
SELECT count(*) AS scanned, count(c.id) AS valid, count(*) - count(c.id) AS orphan FROM e LEFT JOIN c ON c.id = e.chunk_id AND c.point_id = e.point_id AND c.point_id <> ''""")
def ops1_scan_counts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    points = e.selectExpr("concat('p', vec_id) AS point_id", "CASE WHEN vec_id % 13 = 0 THEN NULL ELSE vec_id END AS chunk_id")
    chunks = e.filter("vec_id % 19 <> 0").selectExpr("vec_id AS id", "CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 17 = 0 THEN 'q' ELSE concat('p', vec_id) END AS point_id")
    return sync.scan_counts(points, chunks)


@query("""WITH s AS (SELECT doc_id AS id, sha256(text) AS key, doc_id % 5 = 1 AS web FROM documents),
r AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 2 THEN 'rename' WHEN 3 THEN 'move' ELSE 'file' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'new ' || doc_id // 24 WHEN 1 THEN sha256(text) END AS key, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'n' || doc_id END AS name FROM documents WHERE doc_id % 3 = 0),
j AS (SELECT r.*, CASE WHEN kind = 'move' OR (kind = 'rename' AND trim(name) = '') OR (kind = 'file' AND (web OR r.key IS NULL)) THEN 'invalid' WHEN kind = 'file' AND (SELECT count(*) FROM s o WHERE o.key = r.key AND o.id <> r.id) > 0 THEN 'duplicate' ELSE 'updated' END AS o FROM r JOIN s USING (id)),
d AS (SELECT *, CASE WHEN o = 'updated' AND kind = 'file' AND row_number() OVER (PARTITION BY kind, o, key ORDER BY id) > 1 THEN 'duplicate' ELSE o END AS outcome FROM j)
SELECT s.id, outcome, CASE WHEN outcome = 'updated' AND kind = 'file' THEN d.key ELSE s.key END AS key, CASE WHEN outcome = 'updated' AND kind = 'file' THEN 'pending' ELSE 'indexed' END AS status,
  CASE WHEN outcome = 'updated' THEN coalesce(nullif(trim(d.name), ''), '') ELSE 's' || s.id END AS name, NOT coalesce(outcome = 'updated' AND kind = 'file', false) AS is_active
FROM s LEFT JOIN d USING (id)""")
def pip10_edited_sources(spark, sf_dir):
    """PIP-10: files of sources are replaced and sources renamed; the documents are sources of one document each."""
    docs = table(spark, sf_dir, "documents")
    digest = "sha2(cast(text AS binary), 256)"
    forgotten = [f"cast('x' AS string) AS {c}" for c in registry.FORGOTTEN]
    sources = docs.selectExpr("doc_id AS id", f"{digest} AS key", "CASE WHEN doc_id % 5 = 1 THEN 'web' ELSE 'file' END AS source_type", "cast(NULL AS string) AS uri", "concat('s', doc_id) AS name", "'indexed' AS status", *forgotten)
    requests = docs.filter("doc_id % 3 = 0").selectExpr(
        "doc_id AS position", "CASE doc_id % 4 WHEN 2 THEN 'rename' WHEN 3 THEN 'move' ELSE 'file' END AS kind", "doc_id AS source_id", "cast(NULL AS string) AS uri",
        f"CASE doc_id % 4 WHEN 0 THEN concat('new ', doc_id DIV 24) WHEN 1 THEN {digest} END AS file_hash", "CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE concat('n', doc_id) END AS name",
    )
    outcomes, after, held = registry.edit(sources, docs.selectExpr("doc_id AS source_id", "true AS is_active"), requests)
    joined = after.join(outcomes.select(F.col("source_id").alias("id"), "outcome"), "id", "left").join(held.select(F.col("source_id").alias("id"), "is_active"), "id")
    return joined.select("id", "outcome", "key", "status", F.coalesce("name", F.lit("")).alias("name"), "is_active")


@query()
def str24_main_content(spark, sf_dir):
    """STR-24 with the content told apart by density; ``plain`` is the fallback's number of characters."""
    found = table(spark, sf_dir, "pages").select("page_id", content.main_text(F.col("html")).alias("text"), documents.html_text(F.col("html")).alias("all"))
    return found.select("page_id", F.length("text").alias("n_chars"), ids.content_hash(F.col("text")).alias("content_hash"), F.length("all").alias("plain"))


TERMS = ("The ", "or", "license", "contact", "zzzqqq")


@query(f"""SELECT term, doc_id FROM documents, (VALUES {", ".join(f"('{t}')" for t in TERMS)}) t(term) WHERE contains(lower(coalesce(text, '')), lower(term))""")
def flt7_keyword_index(spark, sf_dir):
    """FLT-7 by the index of trigrams, for common, short, rare and unknown terms."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = KeywordIndex(spark, f"{Scratch(spark, 'keywords').path}/index", 16)
    index.build(rows)
    found = [index.containing(t, rows.schema).select(F.lit(t).alias("term"), F.col("id").alias("doc_id")) for t in TERMS]
    return reduce(DataFrame.unionByName, found)


@query()
def fn4_vocabulary_counts(spark, sf_dir):
    """FN-4 by the longest pieces of a public vocabulary, without and with the limit of a model's input."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", vocabulary.token_counts(F.col("text"), path, 1 << 30).alias("n_tokens")).withColumn("n_input", F.least(F.lit(512), "n_tokens"))
