"""Registered queries of the retrieval engine, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import documents, ids, text, urls
from lexispark.operators import chat, evaluation, retrieval, sync
from lexispark.session import short_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins for the store's tables, over the driver's: chunks belong to any of the documents, and every vector whose id is
# divisible by 20 is asked.
_VIEWS = """
chunks AS (SELECT vec_id AS id, vec_id % n AS document_id, vec_id // n AS chunk_index FROM embeddings, (SELECT greatest(count(*), 1) AS n FROM documents)),
docs AS (SELECT doc_id AS id, doc_id % 4 AS source_id, doc_id % 5 <> 2 AS is_active FROM documents),
sources AS (SELECT i AS id, CASE WHEN i = 3 THEN 'failed' ELSE 'indexed' END AS status FROM range(4) r(i))"""


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "documents").agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return table(spark, sf_dir, "embeddings").select("vec_id").crossJoin(F.broadcast(total)).selectExpr("vec_id AS id", "vec_id % n AS document_id", "vec_id DIV n AS chunk_index")


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "doc_id % 4 AS source_id", "doc_id % 5 <> 2 AS is_active")
    return all_chunks(spark, sf_dir), docs, spark.range(4).selectExpr("id", "CASE WHEN id = 3 THEN 'failed' ELSE 'indexed' END AS status")


def asked_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "embeddings")
    return points, points.filter("vec_id % 20 = 0")


_HITS = f"""WITH {_VIEWS},
scores AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0),
hits AS (SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 100)"""


@query(f"WITH {_VIEWS} SELECT c.id, c.document_id, c.chunk_index, d.source_id FROM chunks c JOIN docs d ON d.id = c.document_id JOIN sources s ON s.id = d.source_id WHERE d.is_active AND s.status = 'indexed'")
def jn2_valid_chunks(spark, sf_dir):
    chunks, docs, sources = views(spark, sf_dir)
    d = docs.filter("is_active").select(F.col("id").alias("document_id"), "source_id")
    s = sources.filter("status = 'indexed'").select(F.col("id").alias("source_id"))
    return chunks.join(d, "document_id").join(F.broadcast(s), "source_id").select("id", "document_id", "chunk_index", "source_id")


@query(f"WITH {_VIEWS} SELECT d.source_id, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM chunks c JOIN docs d ON d.id = c.document_id GROUP BY 1")
def agg5_counts_by_source(spark, sf_dir):
    chunks, docs, _ = views(spark, sf_dir)
    joined = chunks.join(docs.select(F.col("id").alias("document_id"), "source_id"), "document_id")
    return joined.groupBy("source_id", "document_id").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.sum("n").alias("chunks"), F.count("*").alias("documents"))


@query(f"{_HITS} SELECT * FROM hits")
def top1_vector_top_n(spark, sf_dir):
    return retrieval.top_n_each(*asked_points(spark, sf_dir))


@query(f"""{_HITS},
valid AS (
  SELECT h.query_id, c.id AS chunk_id, c.document_id, c.chunk_index, h.score, d.source_id FROM hits h JOIN chunks c ON c.id = h.vec_id JOIN docs d ON d.id = c.document_id AND d.is_active
  JOIN sources s ON s.id = d.source_id AND s.status = 'indexed'),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS rn FROM valid)
SELECT query_id, source_id, document_id, chunk_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM capped WHERE rn <= 4) WHERE place <= 20""")
def top2_candidate_retrieval(spark, sf_dir):
    return retrieval.retrieve_each(*asked_points(spark, sf_dir), *views(spark, sf_dir))


@query(f"""{_HITS},
held AS (SELECT id, document_id, chunk_index FROM chunks WHERE id % 19 <> 0), known AS (SELECT id, id % 5 AS source_id, is_active FROM docs WHERE id % 23 <> 0),
v AS (SELECT h.query_id, h.vec_id, h.score, c.document_id, CASE WHEN h.vec_id % 13 = 0 OR c.id IS NULL THEN 'missing_chunk' WHEN d.id IS NULL THEN 'missing_document' WHEN NOT d.is_active THEN 'inactive_document'
  WHEN s.id IS NULL THEN 'missing_source' WHEN s.status <> 'indexed' THEN 'source_status' ELSE 'valid' END AS v
  FROM hits h LEFT JOIN held c ON c.id = h.vec_id LEFT JOIN known d ON d.id = c.document_id LEFT JOIN sources s ON s.id = d.source_id),
j AS (SELECT query_id, CASE WHEN v = 'valid' AND row_number() OVER (PARTITION BY query_id, document_id, v ORDER BY score DESC, vec_id) > 4 THEN 'document_limit' ELSE v END AS v FROM v)
SELECT query_id, count(*) AS hits, count(*) FILTER (v = 'missing_chunk') AS missing_chunk, count(*) FILTER (v = 'missing_document') AS missing_document, count(*) FILTER (v = 'inactive_document') AS inactive_document,
  count(*) FILTER (v = 'missing_source') AS missing_source, count(*) FILTER (v = 'source_status') AS source_status, count(*) FILTER (v = 'document_limit') AS document_limit, count(*) FILTER (v = 'valid') AS valid FROM j GROUP BY 1""")
def flt3_validity_counters(spark, sf_dir):
    """Some payloads are no numbers, and some chunks, documents and sources are missing."""
    chunks, docs, sources = views(spark, sf_dir)
    payload = F.when(F.col("vec_id") % 13 == 0, "none").otherwise(F.col("vec_id").cast("string"))
    hits = retrieval.top_n_each(*asked_points(spark, sf_dir)).select("query_id", payload.alias("chunk_id"), "score")
    known = docs.filter("id % 23 <> 0").withColumn("source_id", F.col("id") % 5)
    return retrieval.verdict_counts(retrieval.judged_hits(hits, chunks.filter("id % 19 <> 0"), known, sources))


def _ranked(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all others; documents are vec_id % 97, relevant are those of equal label."""
    points, asked = asked_points(spark, sf_dir)
    ranked = retrieval.top_n_each(points, asked, 40, unit=False, own=False).select(F.col("query_id").alias("case_id"), "rank", (F.col("vec_id") % 97).alias("document_id"))
    # Documents of each label with their numbers of vectors: a question's own vector does not count.
    held = points.groupBy("label", (F.col("vec_id") % 97).alias("document_id")).agg(F.count("*").alias("n"))
    gold = asked.select(F.col("vec_id").alias("case_id"), "label").join(F.broadcast(held), "label").filter(F.col("n") > (F.col("document_id") == F.col("case_id") % 97).cast("int"))
    return ranked, gold.select("case_id", "document_id")


_METRICS = """WITH asked AS (SELECT vec_id AS case_id, embedding AS q, label AS wanted FROM embeddings WHERE vec_id % 20 = 0),
scored AS (SELECT case_id, vec_id, row_number() OVER (PARTITION BY case_id ORDER BY round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, vec_id) AS rank FROM embeddings JOIN asked ON vec_id <> case_id),
first AS (SELECT case_id, vec_id % 97 AS document_id, min(rank) AS r FROM scored WHERE rank <= 40 GROUP BY ALL),
ranked AS (SELECT case_id, document_id, row_number() OVER (PARTITION BY case_id ORDER BY r, document_id) AS rank FROM first),
gold AS (SELECT DISTINCT case_id, vec_id % 97 AS document_id FROM embeddings JOIN asked ON label = wanted AND vec_id <> case_id),
totals AS (SELECT case_id, count(*) AS n_relevant FROM gold GROUP BY 1),
sums AS (SELECT r.case_id, k, count(*) AS n, count(g.case_id) AS found, min(rank) FILTER (g.case_id IS NOT NULL) AS f
  FROM ranked r LEFT JOIN gold g USING (case_id, document_id), (VALUES (3), (5), (10), (20)) ks(k) WHERE rank <= k GROUP BY ALL),
metrics AS (SELECT t.case_id, ks.k, (coalesce(found, 0) > 0)::DOUBLE AS hit_rate, round(coalesce(found / n, 0), 6) AS precision, round(coalesce(found, 0) / n_relevant, 6) AS recall, round(coalesce(1 / f, 0), 6) AS reciprocal_rank
  FROM totals t CROSS JOIN (VALUES (3), (5), (10), (20)) ks(k) LEFT JOIN sums s ON s.case_id = t.case_id AND s.k = ks.k)"""


@query(f"{_METRICS} SELECT * FROM metrics")
def fn9_ranking_metrics(spark, sf_dir):
    return evaluation.ranking_metrics(*_ranked(spark, sf_dir))


@query(f"{_METRICS} SELECT k, count(*) AS case_count, round(avg(hit_rate), 6) AS hit_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr FROM metrics GROUP BY k")
def agg6_macro_average(spark, sf_dir):
    return evaluation.macro_average(evaluation.ranking_metrics(*_ranked(spark, sf_dir)))


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(of: str) -> str:
    return f"regexp_replace(regexp_replace({of}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


_CLEAN = _stripped("regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: " + _stripped(f"regexp_replace(x, '{_SPACE}+', ' ', 'g')") + "), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, sha256({_CLEAN}) AS content_hash, length({_CLEAN})::INTEGER AS cleaned_chars FROM documents")
def str1_clean_and_hash(spark, sf_dir):
    cleaned = text.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(cleaned).alias("content_hash"), F.length(cleaned).alias("cleaned_chars"))


# The signs beside letters and digits that count as text, as a class of either regular expression language.
_NOT_USEFUL = r"[^\p{L}\p{N}.,:;!?()\[\]{}+\-_=/%''" + '"]'
_NOT_SPACE = "[^" + _SPACE[1:]


def reason_sql(t: str) -> str:
    """SQL for why a stripped text is not useful, code and web rules aside."""
    visible = f"length(regexp_replace({t}, '{_SPACE}', '', 'g'))"
    words = f"len(regexp_extract_all({t}, '[A-Za-zА-Яа-яЁё0-9_]{{2,}}'))"
    return f"""CASE WHEN coalesce({t}, '') = '' THEN 'empty' WHEN length({t}) < 120 THEN 'too_short' WHEN {words} < 15 THEN 'too_few_words' WHEN {visible} = 0 THEN 'no_visible_characters'
  WHEN length(regexp_replace({t}, '{_NOT_USEFUL}', '', 'g')) / {visible} < 0.55 THEN 'mostly_symbols' WHEN len(regexp_extract_all({t}, '(?i)https?://{_NOT_SPACE}+|www\\.{_NOT_SPACE}+')) >= 5 AND {words} < 40 THEN 'mostly_links' ELSE 'useful' END"""


_TEXTS = "SELECT 'd' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'c', conv_id * 100000 + turn, text FROM conversations UNION ALL SELECT 'p', page_id, html FROM pages"


@query(f"SELECT kind, id, {reason_sql('t')} AS reason FROM (SELECT kind, id, {_stripped('t')} AS t FROM ({_TEXTS}))")
def str7_quality_reasons(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").selectExpr("'d' AS kind", "doc_id AS id", "text AS t").union(table(spark, sf_dir, "conversations").selectExpr("'c'", "conv_id * 100000 + turn", "text"))
    return texts.union(table(spark, sf_dir, "pages").selectExpr("'p'", "page_id", "html")).select("kind", "id", text.quality_reason(F.col("t")).alias("reason"))


def chunk_ctes(source: str, size: int, overlap: int, name: str) -> str:
    """A CTE ``name(id, i, s, e, t)``: the fixed-size chunks of the stripped, non-empty texts ``t`` of ``source(id, t)``. The
    window of a cut is read backwards, so that the first find of a separator is its last."""
    low = int(size * 0.65)
    cut = ", ".join(f"CASE WHEN strpos(b, {x}) > 0 THEN s + {size + 1} - strpos(b, {x}) END" for x in ("chr(10) || chr(10)", "chr(10)", "' .'", "' !'", "' ?'", "' ;'", "' ,'", "' '"))
    end = f"CASE WHEN s + {size} < length(t) THEN coalesce({cut}, s + {size}) ELSE length(t) END"
    return f"""{name} AS (SELECT id, 0::BIGINT AS i, s, ({end})::BIGINT AS e, t FROM (SELECT id, t, 0::BIGINT AS s, reverse(substr(t, {low + 1}, {size - low})) AS b FROM {source} WHERE t <> '')
  UNION ALL SELECT id, i, s, ({end})::BIGINT, t FROM (SELECT id, i, s, t, reverse(substr(t, s + {low + 1}, {size - low})) AS b
    FROM (SELECT id, i + 1 AS i, t, CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE e END AS s FROM {name} WHERE e < length(t))))"""


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_stripped('text')} AS t FROM documents), {chunk_ctes("d", 1400, 150, "cut")}
SELECT id AS doc_id, i::INTEGER AS chunk_index, s::INTEGER AS start, e::INTEGER AS "end", sha256({_stripped('substr(t, s + 1, e - s)')}) AS content_hash FROM cut""")
def str10_chunks(spark, sf_dir):
    short_batches(spark)
    spans = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(documents.spans_of(1400, 150)("text")).alias("chunk_index", "x"))
    return spans.select("doc_id", "chunk_index", F.col("x.s").alias("start"), F.col("x.e").alias("end"), ids.content_hash(F.col("x.chunk")).alias("content_hash"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('1:' || doc_id || ':0:' || sha256(text))) AS h FROM documents)
SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def fn2_point_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ids.point_id(F.lit(1), F.col("doc_id"), F.lit(0), ids.content_hash(F.col("text"))).alias("point_id"))


def _sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id % 4 AS source_id", "cast(doc_id AS string) AS external_id", "doc_id", "sha2(cast(text AS binary), 256) AS h")
    existing = docs.filter("doc_id % 3 <> 0").selectExpr("source_id", "external_id", "h AS content_hash", "1 AS version", "doc_id % 5 <> 0 AS is_active")
    incoming = docs.filter("doc_id % 7 <> 0").selectExpr("source_id", "external_id", "CASE WHEN doc_id % 2 = 0 THEN h ELSE concat('x', h) END AS content_hash")
    return existing, incoming


_SYNC = """WITH d AS (SELECT doc_id % 4 AS source_id, doc_id::VARCHAR AS external_id, doc_id, sha256(text) AS h FROM documents),
e AS (SELECT source_id, external_id, h AS content_hash, 1 AS version, doc_id % 5 <> 0 AS is_active FROM d WHERE doc_id % 3 <> 0),
i AS (SELECT source_id, external_id, CASE WHEN doc_id % 2 = 0 THEN h ELSE 'x' || h END AS content_hash FROM d WHERE doc_id % 7 <> 0),
plan AS (SELECT coalesce(e.source_id, i.source_id) AS source_id, coalesce(e.external_id, i.external_id) AS external_id,
  CASE WHEN e.version IS NULL THEN 'created' WHEN i.content_hash = e.content_hash THEN 'skipped' WHEN i.content_hash IS NOT NULL THEN 'updated' WHEN e.is_active THEN 'deactivated' ELSE 'kept' END AS outcome,
  coalesce(i.content_hash, e.content_hash) AS content_hash, CASE WHEN e.version IS NULL THEN 1 WHEN i.content_hash <> e.content_hash THEN e.version + 1 ELSE e.version END::INTEGER AS version, i.content_hash IS NOT NULL AS is_active
  FROM e FULL JOIN i USING (source_id, external_id))"""


@query(f"{_SYNC} SELECT * FROM plan")
def snk2_document_upsert(spark, sf_dir):
    return sync.plan_upsert(*_sides(spark, sf_dir))


@query(f"""{_SYNC}, f AS (SELECT external_id, CASE WHEN external_id::BIGINT % 17 = 0 THEN 'failed' ELSE outcome END AS outcome FROM plan)
SELECT count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
  (SELECT string_agg(m, '; ' ORDER BY external_id) FROM (SELECT external_id, 'could not read ' || external_id AS m FROM f WHERE outcome = 'failed' ORDER BY external_id LIMIT 3)) AS messages FROM f""")
def agg3_ingestion_outcomes(spark, sf_dir):
    plan = sync.plan_upsert(*_sides(spark, sf_dir))
    broke = F.col("external_id").cast("long") % 17 == 0
    rows = plan.select("external_id", F.when(broke, "failed").otherwise(F.col("outcome")).alias("outcome"), F.concat(F.lit("could not read "), "external_id").alias("error"))
    return sync.outcome_counts(rows).withColumn("messages", F.array_join("messages", "; "))


@query("""SELECT vec_id % 50 AS document_id, (bool_and(vec_id % 211 <> 5) AND min(expected) = max(expected) AND max(expected) = count(*) AND min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*)) AS current
FROM (SELECT vec_id, vec_id // 50 AS i, (SELECT count(*) FROM embeddings) // 50 AS expected FROM embeddings) GROUP BY 1""")
def agg11_current_documents(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    total = e.agg((F.count("*") / 50).cast("long").alias("expected_count"))
    rows = e.select("vec_id").crossJoin(F.broadcast(total)).selectExpr("vec_id % 50 AS document_id", "vec_id DIV 50 AS chunk_index", "expected_count", "vec_id % 211 <> 5 AS matches")
    return sync.current_documents(rows)


@query("""SELECT p.point_id, p.chunk_id FROM (SELECT 'p' || vec_id AS point_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE vec_id END AS chunk_id FROM embeddings) p
WHERE NOT EXISTS (SELECT 1 FROM (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 17 = 0 THEN 'q' ELSE 'p' || vec_id END AS point_id FROM embeddings WHERE vec_id % 19 <> 0) c WHERE c.id = p.chunk_id AND c.point_id = p.point_id)""")
def ops1_orphan_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    points = e.selectExpr("concat('p', vec_id) AS point_id", "CASE WHEN vec_id % 13 = 0 THEN NULL ELSE vec_id END AS chunk_id")
    chunks = e.filter("vec_id % 19 <> 0").selectExpr("vec_id AS id", "CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 17 = 0 THEN 'q' ELSE concat('p', vec_id) END AS point_id")
    return sync.orphan_points(points, chunks).select("point_id", "chunk_id")


@query("""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn2 FROM last WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS position FROM kept WHERE rn2 <= 8""")
def top8_prompt_history(spark, sf_dir):
    return chat.prompt_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", "position")


@query("""WITH c AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE length(trim(text)) > 0)
SELECT conv_id, turn, 'S' || rn AS citation FROM c WHERE total <= 1200 OR rn = 1""")
def win3_context_budget(spark, sf_dir):
    ranked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return retrieval.limit_context(ranked, 1200).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), "citation")


@query("""SELECT conv_id, turn, CASE WHEN t = '' THEN 'New consultation' WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 119)) || '…' END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)""")
def str30_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.title(F.col("text")).alias("title"))


_URL = r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
n AS (SELECT page_id, scheme || '://' || host AS origin, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS path,
  array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid'))), '&') AS q FROM u)"""


@query(f"{_URL} SELECT page_id, origin || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM n")
def str19_crawl_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_crawl_url(F.col("url")).alias("url"))


@query("""SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 80)""")
def agg12_recent_entries(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(80).select("event_id", "event_type")


@query("""WITH a AS (SELECT DISTINCT label, vec_id % 4 AS s, vec_id % 97 AS d FROM embeddings)
SELECT x.label AS a, y.label AS b, count(*) AS common, round(100.0 * count(*) / ((SELECT count(*) FROM a WHERE label = x.label) + (SELECT count(*) FROM a WHERE label = y.label) - count(*)), 6) AS overlap
FROM a x JOIN a y ON x.d = y.d AND x.s = y.s AND x.label < y.label GROUP BY x.label, y.label""")
def jn8_document_overlap(spark, sf_dir):
    return evaluation.overlap(table(spark, sf_dir, "embeddings").selectExpr("label AS query_id", "vec_id % 4 AS source_id", "vec_id % 97 AS document_id"))
