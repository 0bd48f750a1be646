"""Registered queries of stores, runs and whole question sets, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text
from lexispark.operators import chat, evaluation, pipelines, prompts, registry, retrieval, sync
from lexispark.operators.numbering import numbered
from lexispark.plans import corpus, rules, shown, stores  # noqa: F401
from lexispark.plans.queries import _CLEAN, _HITS, _METRICS, _VIEWS, ORACLES, QUERIES, _ranked, _stripped, all_chunks, asked_points, query, table, views
from lexispark.sources import crawl

__all__ = ["ORACLES", "QUERIES"]


# ---- stores


@query("SELECT doc_id, ('0x' || left(sha256((doc_id % 4) || chr(31) || doc_id), 15))::BIGINT AS id FROM documents")
def snk1_inserted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 4 AS source_id")
    return registry.with_ids(rows, "source_id", "doc_id").select("doc_id", "id")


_TITLED = """WITH d AS (SELECT doc_id % 4 AS source_id, doc_id::VARCHAR AS external_id, doc_id, sha256(text) AS h FROM documents),
e AS (SELECT source_id, external_id, h AS content_hash, 1 AS version, doc_id % 5 <> 0 AS is_active, 'old ' || doc_id AS title, 'm0' AS metadata FROM d WHERE doc_id % 3 <> 0),
i AS (SELECT source_id, external_id, CASE WHEN doc_id % 2 = 0 THEN h ELSE 'x' || h END AS content_hash, 'new ' || doc_id AS title, 'm1' AS metadata FROM d WHERE doc_id % 7 <> 0)"""


@query(f"""{_TITLED} SELECT coalesce(e.external_id, i.external_id) AS external_id, CASE WHEN i.content_hash IS NOT NULL AND (e.version IS NULL OR i.content_hash <> e.content_hash) THEN i.title ELSE e.title END AS title,
  CASE WHEN i.content_hash IS NOT NULL THEN 'm1' ELSE 'm0' END AS metadata FROM e FULL JOIN i USING (source_id, external_id)""")
def snk2_titles_and_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id % 4 AS source_id", "cast(doc_id AS string) AS external_id", "doc_id", "sha2(cast(text AS binary), 256) AS h")
    existing = docs.filter("doc_id % 3 <> 0").selectExpr("source_id", "external_id", "h AS content_hash", "1 AS version", "doc_id % 5 <> 0 AS is_active", "concat('old ', doc_id) AS title", "'m0' AS metadata")
    incoming = docs.filter("doc_id % 7 <> 0").selectExpr("source_id", "external_id", "CASE WHEN doc_id % 2 = 0 THEN h ELSE concat('x', h) END AS content_hash", "concat('new ', doc_id) AS title", "'m1' AS metadata")
    return sync.upsert_documents(existing, incoming).select("external_id", "title", "metadata")


@query(f"WITH {_VIEWS} SELECT id, is_active AND source_id <> 1 AS is_active FROM docs")
def snk4_deactivated_source(spark, sf_dir):
    _, docs, _ = views(spark, sf_dir)
    return registry.deactivate(docs, spark.sql("SELECT 1L AS source_id")).select("id", "is_active")


@query(f"WITH {_VIEWS} SELECT c.id, c.document_id FROM chunks c LEFT JOIN docs d ON d.id = c.document_id WHERE d.id IS NULL OR d.source_id NOT IN (1, 2)")
def snk6_cascade_delete(spark, sf_dir):
    chunks, docs, sources = views(spark, sf_dir)
    return registry.delete_sources(spark.sql("SELECT explode(array(1L, 2L)) AS source_id"), sources, docs, chunks)[2].select("id", "document_id")


@query("SELECT vec_id AS point_id FROM embeddings WHERE vec_id % 10 <> 3 AND vec_id % 97 % 4 <> 1 AND vec_id % 97 NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 6 = 0)")
def snk8_deleted_points(spark, sf_dir):
    """By ids, by source and by document, one after the other; an empty list removes nothing."""
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS point_id", "vec_id % 97 AS document_id", "vec_id % 97 % 4 AS source_id")
    left = registry.delete_points(points, points.filter("point_id % 10 = 3"), "point_id")
    left = registry.delete_points(left, spark.sql("SELECT 1L AS source_id"), "source_id")
    left = registry.delete_points(left, points.filter("point_id % 6 = 0").selectExpr("point_id AS document_id"), "document_id")
    return registry.delete_points(left, points.filter("false"), "source_id").select("point_id")


@query("""WITH r AS (SELECT event_id // 2 AS run_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status FROM events)
SELECT 'r' || run_id AS run_id, arg_max(status, seq) AS status FROM r GROUP BY run_id""")
def snk11_run_log(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr("concat('r', event_id DIV 2) AS run_id", "event_id AS seq", "CASE WHEN event_id % 2 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status")
    return registry.run_log(runs).select("run_id", "status")


@query("""WITH s AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 3 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN page_id % 3 > 0 THEN 'old' END AS error FROM pages),
r AS (SELECT doc_id AS id, CASE WHEN bool_and(coalesce(quality, 0) = 0) THEN 'no document could be read' END AS error FROM labels GROUP BY 1)
SELECT s.id, CASE WHEN r.error IS NOT NULL THEN 'failed' WHEN r.id IS NOT NULL THEN 'indexed' ELSE status END AS status, CASE WHEN r.id IS NOT NULL THEN r.error ELSE s.error END AS error, CASE WHEN r.id IS NOT NULL AND r.error IS NULL THEN 9 ELSE 1 END AS last_synced_at
FROM s LEFT JOIN r USING (id)""")
def misc2_source_status(spark, sf_dir):
    """The pages as sources; those that have a label ran, and failed if they have none of good quality."""
    sources = table(spark, sf_dir, "pages").selectExpr("page_id AS id", "CASE WHEN page_id % 4 = 3 THEN 'failed' ELSE 'indexed' END AS status", "CASE WHEN page_id % 3 > 0 THEN 'old' END AS error", "1 AS last_synced_at")
    good = F.bool_and(F.coalesce("quality", F.lit(0)) == 0)
    results = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("source_id")).agg(F.when(good, "no document could be read").alias("error"))
    return registry.with_status(sources, results, F.lit(9)).select("id", "status", "error", "last_synced_at")


_NORMAL = r"""(SELECT position, origin || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM (SELECT page_id AS position, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS origin,
  regexp_replace(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '(.)/+$', '\1') AS path, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS q
  FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[?#].*$', '') || '//' ELSE url END AS url FROM pages)))"""


@query(f"""WITH k AS (SELECT position, 'web' AS source_type, key FROM {_NORMAL} UNION ALL SELECT doc_id + 1000000000, 'file', CASE WHEN doc_id % 8 <> 7 THEN sha256(text) END FROM documents),
s AS (SELECT key FROM {_NORMAL} WHERE position % 5 = 0 GROUP BY 1)
SELECT position, source_type, key, CASE WHEN key IS NULL THEN 'invalid' WHEN key IN (SELECT key FROM s) OR row_number() OVER (PARTITION BY key ORDER BY position) > 1 THEN 'duplicate' ELSE 'added' END AS outcome FROM k""")
def pip10_registered_sources(spark, sf_dir):
    """Pages as web sources and documents as files; every fifth page is registered already, some files have no hash."""
    url = "CASE WHEN page_id % 3 = 0 THEN concat(regexp_replace(url, '[?#].*$', ''), '//') ELSE url END"
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS position", "'web' AS source_type", f"{url} AS uri", "cast(NULL AS string) AS file_hash", "url AS name")
    files = table(spark, sf_dir, "documents").selectExpr("doc_id + 1000000000 AS position", "'file' AS source_type", "cast(NULL AS string) AS uri", "CASE WHEN doc_id % 8 <> 7 THEN sha2(cast(text AS binary), 256) END AS file_hash", "'f' AS name")
    known = pages.filter("position % 5 = 0").select(registry.identity(F.col("source_type"), F.col("uri"), F.col("file_hash")).alias("key")).distinct().withColumn("id", registry.stable_id(F.col("key")))
    return registry.register(known, pages.union(files)).select("position", "source_type", "key", "outcome")


@query("WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS id, min(b.doc_id) AS twin FROM k a JOIN k b ON a.key = b.key AND a.doc_id <> b.doc_id GROUP BY 1")
def flt1_twins(spark, sf_dir):
    return registry.twins(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "sha2(cast(text AS binary), 256) AS key"))


@query("SELECT doc_id FROM labels WHERE coalesce(CASE WHEN doc_id % 6 <> 0 THEN quality = 1 END, true) AND NOT coalesce(CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END, false)")
def flt6_pending_cases(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN doc_id % 6 <> 0 THEN quality = 1 END AS answerable", "CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END AS labeled")
    return evaluation.pending_cases(cases).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'the ')")
def flt7_keyword(spark, sf_dir):
    return retrieval.containing(table(spark, sf_dir, "documents"), "The ", "source", "lang", "text").select("doc_id")


@query(f"WITH {_VIEWS} SELECT c.document_id, c.chunk_index, c.id, d.source_id FROM chunks c JOIN docs d ON d.id = c.document_id")
def jn1_chunks_of_sources(spark, sf_dir):
    chunks, docs, _ = views(spark, sf_dir)
    return retrieval.chunks_of_source(chunks, docs).select("document_id", "chunk_index", "id", "source_id")


@query(f"WITH {_VIEWS} SELECT d.id, count(c.id)::INTEGER AS n_chunks, coalesce(string_agg(c.id::VARCHAR, ',' ORDER BY c.chunk_index), '') AS chunk_ids FROM docs d LEFT JOIN chunks c ON c.document_id = d.id GROUP BY 1")
def jn7_documents_with_chunks(spark, sf_dir):
    chunks, docs, _ = views(spark, sf_dir)
    found = retrieval.with_chunks(docs, chunks)
    return found.select("id", F.size("chunks").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: c["chunk_id"].cast("string")), ",").alias("chunk_ids"))


@query("SELECT count(DISTINCT source) AS sources, count(*) AS documents, sum(length(text)) AS chars FROM documents")
def agg1_counts(spark, sf_dir):
    """AGG-1 and AGG-9: how many sources there are, and the characters of all texts."""
    per_source = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return per_source.agg(F.count("source").alias("sources"), F.sum("n").alias("documents"), F.sum("chars").alias("chars"))


@query("""SELECT event_id AS run_id, round(d / s, 6) AS per_second, ceil(t / 32)::BIGINT AS batches, round((t - d) / (d / s), 6) AS seconds_left
FROM (SELECT event_id, event_id % 1000 AS d, 1000 AS t, nullif(event_id % 60, 0) / 4.0::DOUBLE AS s FROM events) WHERE d > 0 AND s IS NOT NULL""")
def agg10_throughput(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr("event_id AS run_id", "event_id % 1000 AS done", "1000 AS total", "cast(event_id % 60 AS double) / 4 AS seconds").filter("done > 0 AND seconds > 0")
    return registry.throughput(runs).select("run_id", "per_second", "batches", "seconds_left")


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def top5_latest_session(spark, sf_dir):
    return chat.sessions(table(spark, sf_dir, "conversations"), 0)


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS position FROM conversations")
def top7_whole_sessions(spark, sf_dir):
    return chat.last_messages(table(spark, sf_dir, "conversations"), None).select("conv_id", "turn", "position")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id")
def top10_documents_in_order(spark, sf_dir):
    """SRC-9 and TOP-10."""
    return table(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", "source")


_SAID = "SELECT conv_id + (turn % 9 = 4)::BIGINT * 1000000000 AS conv_id, turn + 1000 AS turn, CASE turn % 4 WHEN 0 THEN ' User ' WHEN 1 THEN 'assistant' WHEN 2 THEN role ELSE 'tool' END AS role, CASE WHEN turn % 7 = 5 THEN '  ' ELSE text END AS text FROM conversations"


@query(f"""WITH i AS ({_SAID}), j AS (SELECT i.*, CASE WHEN lower(trim(role)) NOT IN ('user', 'assistant') THEN 'role' WHEN trim(text) = '' THEN 'blank' WHEN conv_id NOT IN (SELECT conv_id FROM conversations) THEN 'session' END AS reason FROM i)
SELECT conv_id, turn, 'taken' AS outcome FROM j WHERE reason IS NULL UNION ALL SELECT conv_id, turn, reason FROM j WHERE reason IS NOT NULL""")
def pip11_appended_messages(spark, sf_dir):
    old = table(spark, sf_dir, "conversations")
    new = old.select(F.expr("conv_id + CASE WHEN turn % 9 = 4 THEN 1000000000L ELSE 0L END AS conv_id"), F.expr("turn + 1000 AS turn"), F.expr("CASE turn % 4 WHEN 0 THEN ' User ' WHEN 1 THEN 'assistant' WHEN 2 THEN role ELSE 'tool' END AS role"), F.expr("CASE WHEN turn % 7 = 5 THEN '  ' ELSE text END AS text"))
    taken, refused = chat.append(old, new)
    return taken.filter("turn >= 1000").select("conv_id", "turn", F.lit("taken").alias("outcome")).union(refused.select("conv_id", "turn", "reason"))


# ---- search and import


@query("""WITH r AS (SELECT page_id % 10 AS query_id, page_id AS position, CASE page_id % 6 WHEN 0 THEN ' ' || url || '#part ' WHEN 1 THEN url WHEN 2 THEN '' WHEN 3 THEN 'ftp://x/y' ELSE 'https://same.example/' || (page_id % 3) END AS url, CASE WHEN page_id % 4 = 1 THEN NULL ELSE 'Page ' || page_id END AS title FROM pages),
p AS (SELECT query_id, position, regexp_replace(trim(url), '#.*$', '') AS url, title FROM r), h AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY position) AS rn FROM p WHERE regexp_matches(url, '^(?i)https?:')),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM h WHERE rn = 1)
SELECT query_id, rank::INTEGER AS rank, url, coalesce(title, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))) AS title FROM n WHERE rank <= 20""")
def src11_search_hits(spark, sf_dir):
    url = "CASE page_id % 6 WHEN 0 THEN concat(' ', url, '#part ') WHEN 1 THEN url WHEN 2 THEN '' WHEN 3 THEN 'ftp://x/y' ELSE concat('https://same.example/', page_id % 3) END AS url"
    results = table(spark, sf_dir, "pages").select(F.expr("page_id % 10 AS query_id"), F.col("page_id").alias("position"), F.expr(url), F.expr("CASE WHEN page_id % 4 = 1 THEN NULL ELSE concat('Page ', page_id) END AS title"), F.lit(None).cast("string").alias("snippet"))
    return crawl.search_hits(results, 50).drop("snippet")


_WEB = "SELECT label AS query_id, vec_id AS rank, CASE WHEN vec_id % 3 = 0 THEN 'https://steamcommunity.com/' ELSE 'https://a.example/' END || vec_id AS url, vec_id % 5 = 1 AS known, (vec_id * 37) % 101 % 9 = 4 AS importable FROM embeddings"
_RESEARCH = f"""WITH h AS ({_WEB}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h WHERE url NOT LIKE 'https://steam%'), hit AS (SELECT query_id, min(n) AS stop FROM f WHERE importable AND NOT known GROUP BY 1),
s AS (SELECT h.query_id, h.rank, CASE WHEN f.n IS NULL THEN 'blocked' WHEN f.n > 3 OR f.n > coalesce(stop, f.n) THEN 'untried' WHEN h.known THEN 'duplicate' WHEN h.importable THEN 'indexed' ELSE 'failed' END AS status FROM h LEFT JOIN f ON f.query_id = h.query_id AND f.rank = h.rank LEFT JOIN hit ON hit.query_id = h.query_id)"""


def _researched(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").selectExpr("label AS query_id", "vec_id AS rank", "concat(CASE WHEN vec_id % 3 = 0 THEN 'https://steamcommunity.com/' ELSE 'https://a.example/' END, vec_id) AS url", "vec_id % 5 = 1 AS known", "(vec_id * 37) % 101 % 9 = 4 AS importable")
    return pipelines.researched(hits)


@query(f"{_RESEARCH} SELECT query_id, rank, status FROM s")
def pip8_research(spark, sf_dir):
    return _researched(spark, sf_dir).select("query_id", "rank", "status")


@query(f"{_RESEARCH} SELECT count(*) AS found, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'failed') AS failed FROM s")
def agg8_report(spark, sf_dir):
    return registry.report(_researched(spark, sf_dir))


@query()
def src2_site_crawl(spark, sf_dir):
    """The pages as one site, each linking to three others; some redirect, some failed, some are documents of other types."""
    link = "concat('<a href=\"', {0}, '\">x</a>')"
    html = "concat('<body>', " + ", ".join(link.format(x) for x in ("page_id * 2 + 1", "concat('/p/', page_id * 2 + 2, '?utm_source=s')", "concat('../p/', page_id DIV 3)")) + ", '</body>')"
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('https://site.example/p/', page_id) AS url", "CASE WHEN page_id % 10 = 7 THEN concat('https://site.example/p/', page_id + 1) END AS final_url",
        "CASE WHEN page_id % 6 = 5 THEN 'application/pdf' ELSE 'text/html' END AS mime_type", f"CASE WHEN page_id % 9 <> 8 THEN {html} END AS html",
    )
    return crawl.crawl_site(pages, "https://site.example/p/0", 1000, 8)


# ---- ingest and index


_INGEST = f"""WITH d AS (SELECT doc_id % 4 AS source_id, doc_id::VARCHAR AS external_id, doc_id, sha256({_CLEAN}) AS h, coalesce({_CLEAN}, '') = '' AS blank FROM documents),
e AS (SELECT source_id, external_id, CASE WHEN doc_id % 2 = 0 THEN h ELSE 'x' END AS content_hash, 1 AS version, doc_id % 5 <> 0 AS is_active FROM d WHERE doc_id % 3 <> 0),
i AS (SELECT source_id, external_id, h, doc_id % 11 = 0 OR blank AS broke FROM d WHERE doc_id % 7 <> 0),
r AS (SELECT coalesce(e.source_id, i.source_id) AS source_id, coalesce(e.external_id, i.external_id) AS external_id,
  CASE WHEN i.broke THEN 'failed' WHEN i.h IS NULL THEN CASE WHEN e.is_active THEN 'deactivated' ELSE 'kept' END WHEN e.version IS NULL THEN 'created' WHEN e.content_hash = i.h THEN 'skipped' ELSE 'updated' END AS outcome,
  CASE WHEN i.broke OR i.h IS NULL THEN e.content_hash ELSE i.h END AS content_hash, CASE WHEN i.broke OR i.h IS NULL THEN e.version WHEN e.version IS NULL THEN 1 WHEN e.content_hash = i.h THEN e.version ELSE e.version + 1 END::INTEGER AS version,
  CASE WHEN i.broke THEN e.is_active WHEN i.h IS NULL THEN false ELSE true END AS is_active FROM e FULL JOIN i USING (source_id, external_id))"""


def _ingested(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id % 4 AS source_id", "cast(doc_id AS string) AS external_id", "doc_id", "text")
    empty = F.create_map().cast("map<string,string>")
    hashed = F.when(F.col("doc_id") % 2 == 0, F.sha2(text.clean(F.col("text")).cast("binary"), 256)).otherwise("x")
    existing = docs.filter("doc_id % 3 <> 0").select("source_id", "external_id", hashed.alias("content_hash"), F.lit(1).alias("version"), (F.col("doc_id") % 5 != 0).alias("is_active"), F.lit("t").alias("title"), empty.alias("metadata"))
    kind = F.col("doc_id") % 11 == 0
    files = docs.filter("doc_id % 7 <> 0").select("source_id", "external_id", F.concat(F.lit("f"), "doc_id").alias("name"), F.when(kind, ".exe").otherwise(".txt").alias("extension"), F.when(kind, "image/png").otherwise("text/plain").alias("mime_type"), F.encode("text", "UTF-8").alias("content"), empty.alias("metadata"))
    return pipelines.ingest(existing, pipelines.parse_files(files))


@query(f"{_INGEST} SELECT * FROM r")
def pip1_ingested_documents(spark, sf_dir):
    return _ingested(spark, sf_dir).select("source_id", "external_id", "outcome", "content_hash", "version", "is_active")


@query(f"""{_INGEST} SELECT source_id, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
  CASE WHEN count(*) FILTER (outcome IN ('created', 'updated', 'skipped')) > 0 THEN 'indexed' ELSE 'failed' END AS status FROM r GROUP BY 1""")
def pip5_source_results(spark, sf_dir):
    return pipelines.source_status(_ingested(spark, sf_dir)).select("source_id", "created", "updated", "skipped", "failed", "status")


@query(f"""WITH {_VIEWS}, c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1), p AS (SELECT d.id AS document_id, d.source_id, CASE WHEN NOT is_active THEN 'purge' WHEN d.source_id <> 1 AND c.n IS NOT NULL AND d.id % 3 = 0 THEN 'skip' ELSE 'rebuild' END AS action FROM docs d LEFT JOIN c ON c.document_id = d.id)
SELECT source_id, document_id, action, CASE WHEN action <> 'skip' THEN CASE WHEN (SELECT count(*) FROM p q WHERE q.source_id = p.source_id AND q.action = 'skip') = 0 THEN 'source' ELSE 'document' END END AS scope FROM p""")
def pip3_rebuild_plan(spark, sf_dir):
    chunks, docs, _ = views(spark, sf_dir)
    current = chunks.join(docs.select(F.col("id").alias("document_id"), "source_id"), "document_id").groupBy("document_id").agg((F.max("source_id") != 1).alias("other")).selectExpr("document_id", "other AND document_id % 3 = 0 AS current")
    return sync.rebuild_plan(docs.withColumnRenamed("id", "document_id"), current)


@query()
def pip2_planned_chunks(spark, sf_dir):
    """Documents as web, git code, file and other sources by their ids."""
    kind = "element_at(array('web', 'git', 'file', 'api'), cast(doc_id % 4 + 1 AS int)) AS source_type"
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id % 4 AS source_id"), F.col("doc_id").alias("document_id"), F.expr(kind), F.expr("CASE WHEN doc_id % 4 = 1 THEN 'code' ELSE 'text' END AS document_type"), "text")
    return pipelines.planned_chunks(pipelines.judged_chunks(docs)).drop("content", "source_type", "document_type")


# ---- questions


_ASK = f"""{_HITS},
valid AS (SELECT h.query_id, c.id AS chunk_id, c.document_id, h.score, d.source_id FROM hits h JOIN chunks c ON c.id = h.vec_id JOIN docs d ON d.id = c.document_id AND d.is_active JOIN sources s ON s.id = d.source_id AND s.status = 'indexed'),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS rn FROM valid),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM capped WHERE rn <= 4),
questions AS (SELECT vec_id AS query_id, b.text AS question FROM embeddings e JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) b ON b.i = (e.vec_id // 20) % (SELECT count(*) FROM benchmark) WHERE vec_id % 20 = 0),
told AS (SELECT b.*, t.text, len(list_intersect(string_split(lower(question), ' '), string_split(lower(t.text), ' '))) AS shared FROM best b JOIN questions USING (query_id) JOIN documents t ON t.doc_id = b.document_id WHERE place <= 20),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, place) AS rank FROM told) WHERE rank <= 5 AND length(trim(text)) > 0),
summed AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM top),
kept AS (SELECT *, ['web', 'git', 'file', 'web'][source_id + 1] AS kind FROM summed WHERE total <= 12000 OR n = 1),
context AS (SELECT query_id, count(*) AS n_blocks, string_agg('[S' || n || ']' || chr(10) || 'Source: Source ' || source_id || chr(10) || 'Document: Document ' || document_id || chr(10) || 'Reference: ' ||
  CASE kind WHEN 'web' THEN 'e' || document_id WHEN 'git' THEN 'https://s1.example -> e' || document_id ELSE 'Document ' || document_id END || chr(10) || 'Content:' || chr(10) || {_stripped('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block FROM kept GROUP BY 1),
prompts AS (SELECT query_id, coalesce(n_blocks, 0) AS n_blocks, 'INDEXED CONTEXT:' || chr(10) || coalesce(chr(10) || block, 'No relevant indexed context was found.') || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || {_stripped('question')} || chr(10) || chr(10) ||
  'Answer the question now. Use source citations such as [S1] when the answer relies on the indexed context.' AS prompt FROM questions LEFT JOIN context USING (query_id))"""


def shared_words(question, of):
    words = lambda c: F.split(F.lower(c), " ")
    return F.size(F.array_intersect(words(question), words(of)))


def _asked(spark, sf_dir):
    points, asked = asked_points(spark, sf_dir)
    items = numbered(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    total = items.agg(F.count("*").alias("n"))
    questions = asked.crossJoin(F.broadcast(total)).withColumn("number", F.expr("(vec_id DIV 20) % n")).join(items, "number").select(F.col("vec_id").alias("query_id"), F.col("text").alias("question"), "embedding")
    _, docs, sources = views(spark, sf_dir)
    chunks = all_chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    docs = docs.selectExpr("*", "concat('Document ', id) AS title", "concat('e', id) AS external_id")
    sources = sources.selectExpr("*", "concat('Source ', id) AS name", "element_at(array('web', 'git', 'file', 'web'), cast(id + 1 AS int)) AS source_type", "concat('https://s', id, '.example') AS uri")
    return pipelines.ask(questions, points, chunks, docs, sources, shared_words)


@query(f"{_ASK} SELECT query_id, length(prompt)::INTEGER AS n_chars, sha256(prompt) AS prompt_hash FROM prompts")
def pip6_prompts(spark, sf_dir):
    prompt = _asked(spark, sf_dir)[1]
    return prompt.select("query_id", F.length("prompt").alias("n_chars"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"))


@query(f"{_ASK} SELECT query_id, rank::INTEGER AS rank, 'S' || n AS citation, source_id, document_id, chunk_id, score, shared::INTEGER AS rerank_score FROM kept")
def misc8_traces(spark, sf_dir):
    """WIN-3, WIN-4 and MISC-8: what each question's prompt is built of."""
    kept = prompts.traced(_asked(spark, sf_dir)[0])
    return kept.select("query_id", "rank", *[f"trace.{c}" for c in ("citation", "source_id", "document_id", "chunk_id", "score", "rerank_score")])


@query(f"{_ASK} SELECT query_id, count(*) AS blocks, sum(length(text))::BIGINT AS context_chars FROM kept GROUP BY 1")
def agg9_context_chars(spark, sf_dir):
    """AGG-9: characters of the selected context of every question."""
    return _asked(spark, sf_dir)[0].groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("context_chars"))


@query(f"""{_HITS},
valid AS (SELECT h.query_id, c.id AS chunk_id, c.document_id, h.score FROM hits h JOIN chunks c ON c.id = h.vec_id JOIN docs d ON d.id = c.document_id AND d.is_active JOIN sources s ON s.id = d.source_id AND s.status = 'indexed'),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS rn FROM valid)
SELECT query_id, document_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM capped WHERE rn <= 3) WHERE place <= 5""")
def top3_retrieved(spark, sf_dir):
    return retrieval.retrieve_top(*asked_points(spark, sf_dir), *views(spark, sf_dir)).select("query_id", "document_id", "chunk_id", "score")


_BOTH = (
    _METRICS.replace(
        "first AS (SELECT case_id, vec_id % 97 AS document_id, min(rank) AS r FROM scored WHERE rank <= 40 GROUP BY ALL)",
        "sides AS (SELECT 'baseline' AS pipeline, case_id, vec_id, rank FROM scored WHERE rank <= 40 UNION ALL SELECT 'reranked', case_id, vec_id, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN vec_id % 7 <> 0 THEN (vec_id * 37) % 101 END DESC NULLS LAST, rank) FROM scored WHERE rank <= 40),\nfirst AS (SELECT pipeline, case_id, vec_id % 97 AS document_id, min(rank) AS r FROM sides GROUP BY ALL)",
    )
    .replace("ranked AS (SELECT case_id, document_id, row_number() OVER (PARTITION BY case_id", "ranked AS (SELECT pipeline, case_id, document_id, row_number() OVER (PARTITION BY pipeline, case_id")
    .replace("sums AS (SELECT r.case_id", "sums AS (SELECT r.pipeline, r.case_id")
    .replace("metrics AS (SELECT t.case_id", "metrics AS (SELECT p.pipeline, t.case_id")
    .replace("FROM totals t CROSS JOIN", "FROM totals t CROSS JOIN (VALUES ('baseline'), ('reranked')) p(pipeline) CROSS JOIN")
    .replace("s.k = ks.k)", "s.k = ks.k AND s.pipeline = p.pipeline)")
)


def _evaluated(spark, sf_dir):
    points, asked = asked_points(spark, sf_dir)
    _, gold = _ranked(spark, sf_dir)
    score = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") * 37) % 101)
    hits = retrieval.top_n_each(points, asked, 40, unit=False, own=False)
    return pipelines.evaluate(hits.select(F.col("query_id").alias("case_id"), "rank", (F.col("vec_id") % 97).alias("document_id"), score.alias("rerank_score")), gold)


@query(f"{_BOTH} SELECT * FROM metrics")
def pip7_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir)


_SIDE = ", ".join(f"round(avg({m}) FILTER (pipeline = '{p}' AND k = {k}), 6) AS {p}_{n}_{k}" for p in ("baseline", "reranked") for m, n in (("hit_rate", "hit_rate"), ("reciprocal_rank", "mrr")) for k in (3, 20))


@query(f"{_BOTH} SELECT count(DISTINCT case_id) AS case_count, '3,5,10,20' AS k_values, {_SIDE}, (SELECT round(avg(vec_id % 7 / 8.0::DOUBLE), 6) FROM embeddings WHERE vec_id % 20 = 0) AS average_retrieval_seconds FROM metrics")
def agg7_summary(spark, sf_dir):
    asked = asked_points(spark, sf_dir)[1]
    took = asked.selectExpr("vec_id AS case_id", "cast(vec_id % 7 AS double) / 8 AS retrieval_seconds", "1.0D AS rerank_seconds")
    s = evaluation.summary(_evaluated(spark, sf_dir), took)
    of = lambda p, n, k: F.element_at(p, F.lit(k))[n].alias(f"{p}_{n}_{k}")
    return s.select("case_count", F.array_join(F.col("k_values").cast("array<string>"), ",").alias("k_values"), *[of(p, n, k) for p in ("baseline", "reranked") for n in ("hit_rate", "mrr") for k in (3, 20)], "average_retrieval_seconds")


@query(f"""{_METRICS.split("ranked AS")[0].rstrip().removesuffix(",")},
few AS (SELECT case_id, vec_id % 97 AS document_id, min(rank) AS r FROM scored WHERE rank <= 30 GROUP BY ALL)
SELECT case_id, document_id, rank::INTEGER AS rank FROM (SELECT case_id, document_id, row_number() OVER (PARTITION BY case_id ORDER BY r, document_id) AS rank FROM few) WHERE rank <= 15""")
def top9_shortlists(spark, sf_dir):
    return evaluation.shortlist(_ranked(spark, sf_dir)[0]).select("case_id", "document_id", "rank")
