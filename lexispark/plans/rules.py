"""Registered queries of classification, text and URL rules, each with the SQL that says the same.

Stand-ins for what the driver's tables lack (loggers, file names, types, typed answers) are chosen by row number from short
lists, the same in both languages; every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import classify, documents, urls
from lexispark.operators import chat, evaluation, pipelines, registry
from lexispark.plans.queries import query, table
from lexispark.session import short_batches
from lexispark.sources import crawl


def pick(values: list[str | None], number: str) -> tuple[str, str]:
    """The Spark and the DuckDB expression for the element of a list at a number modulo its length."""
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({quoted}), cast({number} % {len(values)} + 1 AS int))", f"([{quoted}])[{number} % {len(values)} + 1]"


LOGGER = pick(["src.generation.llm", "src.retrieval.retriever", "advisor.ui", "urllib3.pool", "console"], "event_id")
MESSAGE = pick(
    [
        "Internet search started", "[Web] page fetched", "Chunk batch stored", "Embedded 32 texts", "Retrieved 20 candidates", "Rerank done", "[LLM] Gemini answered", "Advisor request received", "SQL opened", "Startup complete",
        "Read timeout: 503 Service Unavailable", "429 rate limit, 503", "connection refused",
    ],
    "event_id",
)
_LOG = "SELECT event_id, {0} AS logger, concat({1}, ' ', event_type, CASE WHEN event_id % 3 = 0 THEN concat(chr(10), '  ', chr(10), ' [Git] ', props) ELSE '' END) AS message FROM events"
LOG_SQL = _LOG.format(LOGGER[1], MESSAGE[1])


def log(spark, sf_dir) -> DataFrame:
    columns = _LOG.format(LOGGER[0], MESSAGE[0]).removeprefix("SELECT ").removesuffix(" FROM events")
    e = table(spark, sf_dir, "events")
    return e.select(*[F.expr(x) for x in (f"struct({columns}) AS s",)]).select("s.*")


def _has(value: str, *marks: str) -> str:
    return "(" + " OR ".join(f"contains({value}, '{m}')" for m in marks) + ")"


def _category(value: str) -> str:
    return f"""CASE WHEN {_has(value, "internet", "[web]", "[fandom]")} THEN 'RECON' WHEN {_has(value, "index", "vector", "chunk")} THEN 'ARCHIVE' WHEN {_has(value, "embed")} THEN 'EMBEDDING'
  WHEN {_has(value, "retriev")} THEN 'SEARCH' WHEN {_has(value, "rerank")} THEN 'ANALYSIS' WHEN {_has(value, "[llm]", "generation", "gemini", "groq")} THEN 'CORE'
  WHEN {_has(value, "chat", "advisor request", "consultation")} THEN 'CONSULTATION' WHEN {_has(value, "sql", "database", "persist")} THEN 'DATABASE' ELSE 'SYSTEM' END"""


@query(f"SELECT event_id, {_category('v')} AS category FROM (SELECT event_id, lower(logger || ' ' || message) AS v FROM ({LOG_SQL}))")
def flt22_log_categories(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", classify.log_category(F.col("logger"), F.col("message")).alias("category"))


@query(f"""WITH l AS (SELECT event_id, logger, unnest(string_split(message, chr(10))) AS line, generate_subscripts(string_split(message, chr(10)), 1) AS i FROM ({LOG_SQL})),
taken AS (SELECT event_id, i, CASE WHEN logger = 'console' THEN trim(line) ELSE line END AS line, logger FROM l WHERE trim(line) <> '' AND (logger LIKE 'src.%' OR logger LIKE 'advisor.%'
  OR (logger = 'console' AND regexp_matches(trim(line), '^\\[(Indexing|Vectorization|Embeddings|Retriever|Reranker|LLM|Web|Fandom|Git|OCR)\\]')))),
c AS (SELECT event_id, line, i, lower(logger || ' ' || line) AS v FROM taken)
SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY i))::INTEGER AS place, line, {_category("v")} AS category FROM c""")
def flt23_activity_lines(spark, sf_dir):
    lines = log(spark, sf_dir).select("event_id", "logger", F.posexplode(classify.log_lines(F.col("logger"), F.col("message"))).alias("at", "line"))
    return lines.select("event_id", (F.col("at") + 1).alias("place"), "line", classify.log_category(F.col("logger"), F.col("line")).alias("category"))


@query(f"""SELECT event_id, NOT regexp_matches(m, '400|401|403|404|422|429|access denied|unauthorized|forbidden|invalid api key|api key not valid|rate limit|too_many_requests|quota exhausted|quota exceeded')
  AND regexp_matches(m, '500|502|503|504|service_unavailable|service unavailable|high demand|temporarily unavailable|timeout|timed out|connection reset|connection aborted|connection refused') AS retryable,
  regexp_matches(m, 'timed out|timeout|read timeout|write timeout|read operation timed out|write operation timed out|connection reset|connection aborted|connection refused|temporarily unavailable|service unavailable|502|503|504|429') AS transient
FROM (SELECT event_id, lower(message) AS m FROM ({LOG_SQL}))""")
def flt24_retryability(spark, sf_dir):
    return log(spark, sf_dir).select("event_id", classify.is_retryable(F.col("message")).alias("retryable"), classify.is_transient(F.col("message")).alias("transient"))


EXTENSION = pick([".PDF", ".docx", ".pptx", ".md", ".markdown", ".csv", ".json", ".htm", ".xml", ".py", ".rs", ".exe", "", None, ".png", ".yaml", ".zip"], "doc_id")
MIME = pick(["text/plain", "application/pdf", "application/octet-stream", None, "text/html", "text/x-log", "application/json", "image/png", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/xhtml+xml", "text/csv"], "doc_id")


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{EXTENSION[0]} AS extension", f"{MIME[0]} AS mime_type")


_FILES = f"SELECT doc_id, lower(coalesce({EXTENSION[1]}, '')) AS e, coalesce({MIME[1]}, '') AS m, {MIME[1]} IS NULL AS untyped FROM documents"
_CODE = "('.py','.js','.jsx','.ts','.tsx','.vue','.php','.java','.cs','.c','.cpp','.cc','.h','.hpp','.go','.rs','.rb','.swift','.kt','.kts','.sql','.css','.scss','.sass','.less','.sh','.ps1','.bat')"


@query(f"""SELECT doc_id, CASE WHEN e = '.pdf' OR m = 'application/pdf' THEN 'pdf' WHEN e = '.docx' OR m = '{classify.WORD}' THEN 'docx' WHEN e = '.pptx' OR m = '{classify.SLIDES}' THEN 'pptx'
  WHEN e IN ('.txt','.md','.markdown','.rst','.csv','.json','.xml','.html','.htm','.yaml','.yml','.toml','.ini','.cfg') OR e IN {_CODE} OR m IN ('application/json','application/xml') OR m LIKE 'text/%' THEN 'text' END AS route,
  CASE WHEN m = 'text/html' OR e IN ('.html','.htm') THEN 'html' WHEN m = 'application/json' OR e = '.json' THEN 'json' WHEN e IN ('.md','.markdown') THEN 'markdown' WHEN e = '.csv' THEN 'csv' WHEN e = '.xml' THEN 'xml' WHEN e IN {_CODE} THEN 'code' ELSE 'text' END AS document_type
FROM ({_FILES})""")
def flt19_parser_routes(spark, sf_dir):
    """FLT-19 and FLT-20: the parser a file goes to, and the type that the text parser gives it."""
    e, m = F.col("extension"), F.col("mime_type")
    return files(spark, sf_dir).select("doc_id", classify.parser_route(e, m).alias("route"), classify.document_type(e, m).alias("document_type"))


@query(f"""SELECT doc_id, m IN ('text/html', 'application/xhtml+xml') OR (m IN ('', 'application/octet-stream') AND e IN ('', '.html', '.htm')) AS is_html,
  e IN ('', '.html', '.htm', '.txt', '.md', '.markdown', '.json', '.xml', '.csv', '.pdf', '.docx', '.pptx') OR m IN ('application/pdf','text/plain','text/markdown','text/csv','application/json','application/xml','text/xml','{classify.WORD}','{classify.SLIDES}') AS is_supported
FROM ({_FILES})""")
def flt13_crawled_types(spark, sf_dir):
    e = F.lower(F.coalesce("extension", F.lit("")))
    return files(spark, sf_dir).select("doc_id", classify.is_html(F.col("mime_type"), e).alias("is_html"), classify.is_crawled(F.col("mime_type"), e).alias("is_supported"))


NAME = pick(["a.md", "dir.x/b", "c.CSV", "d.xml", "e.py", ".hidden", "f.doc", "g.markdown"], "doc_id")


@query(f"""WITH d AS (SELECT doc_id, doc_id % 9 AS k, {NAME[1]} AS name FROM documents), s AS (SELECT *, lower(regexp_extract(name, '[^/](\\.[^./]+)$', 1)) AS own FROM d)
SELECT doc_id, CASE k WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/zip' WHEN 4 THEN CASE own WHEN '.doc' THEN 'application/msword' ELSE 'application/x-ole-storage' END
  WHEN 5 THEN 'text/html' WHEN 6 THEN 'application/json' ELSE CASE own WHEN '.md' THEN 'text/markdown' WHEN '.markdown' THEN 'text/markdown' WHEN '.csv' THEN 'text/csv' WHEN '.xml' THEN 'application/xml' ELSE 'text/plain' END END AS mime_type,
  CASE k WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' WHEN 3 THEN '.zip' WHEN 4 THEN nullif(own, '') WHEN 5 THEN '.html' WHEN 6 THEN '.json' ELSE coalesce(nullif(own, ''), '.txt') END AS extension FROM s""")
def flt17_file_types(spark, sf_dir):
    """FLT-17 and FLT-18: documents as files; the first bytes and the form of some are changed by their ids. Texts end in
    a word, so that empty ones are text too."""
    short_batches(spark)
    magic = ["255044462D", "89504E470D0A1A0A", "FFD8FF", "504B0304", "D0CF11E0A1B11AE1"]
    content = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN concat(unhex('{m}'), encode(coalesce(text, ''), 'UTF-8'))" for k, m in enumerate(magic))
    content += " WHEN 5 THEN encode(concat(' <!DOCTYPE html><p>', text), 'UTF-8') WHEN 6 THEN encode(to_json(array(text)), 'UTF-8') ELSE encode(concat('words ', coalesce(text, '')), 'UTF-8') END"
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{content} AS content", f"{NAME[0]} AS name")
    return rows.withColumn("t", classify.sniffed_type("content", "name")).select("doc_id", "t.mime_type", "t.extension")


@query("""SELECT page_id, url, regexp_matches(url, '^[^:]+://([^/?#]*\\.)?steamcommunity\\.com([/?#:]|$)') AS blocked
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '://[^/]*', '://steamcommunity.com') WHEN 1 THEN regexp_replace(url, '://', '://steamcommunity.com.') WHEN 2 THEN regexp_replace(url, '://[^/]*', '://a.steamcommunity.com') ELSE url END AS url FROM pages)""")
def flt21_blocked_domains(spark, sf_dir):
    url = "CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '://[^/]*', '://steamcommunity.com') WHEN 1 THEN regexp_replace(url, '://', '://steamcommunity.com.') WHEN 2 THEN regexp_replace(url, '://[^/]*', '://a.steamcommunity.com') ELSE url END AS url"
    return table(spark, sf_dir, "pages").selectExpr("page_id", url).withColumn("blocked", classify.is_blocked(F.col("url")))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
p AS (SELECT page_id, pos, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS origin, regexp_extract(h, '^([^?#]*)', 1) AS path FROM l WHERE h LIKE '/%' AND h NOT LIKE '//%'),
w AS (SELECT page_id, pos, origin || '/wiki' || path AS url, trim(replace(substr(path, 2), '_', ' ')) AS title FROM p WHERE length(path) > 1),
k AS (SELECT page_id, lower(title) AS key, min(pos) AS place, arg_max(title, pos) AS title, arg_max(url, pos) AS url FROM w GROUP BY 1, 2)
SELECT page_id, place::INTEGER AS place, title, url FROM k""")
def flt12_wiki_links(spark, sf_dir):
    """The rooted links of every page, as if they were those of a wiki."""
    wiki = F.regexp_replace("html", '<a href="/(?!/)', '<a href="/wiki/')
    return crawl.fandom_links(table(spark, sf_dir, "pages").select("page_id", "url", wiki.alias("html")))


@query("""SELECT page_id, CASE WHEN last <> '' THEN last ELSE host END AS name FROM (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host,
  url_decode(replace(regexp_extract(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '+', '%2B')) AS last FROM pages)""")
def str21_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.file_name(F.col("url")).alias("name"))


REQUEST = pick(["", "Please search online for ", "find the answer about ", "Найди мне информацию про ", "look up: ", "пожалуйста поищи в интернете "], "item_id")


@query(f"""WITH q AS (SELECT item_id, trim({REQUEST[1]} || text) AS q FROM benchmark),
a AS (SELECT item_id, q, regexp_replace(regexp_replace(q, '(?i)^\\s*(?:пожалуйста\\s+)?(?:поищи|найди|посмотри)(?:\\s+тогда)?(?:\\s+мне)?(?:\\s+ответ)?(?:\\s+в\\s+интернете|\\s+в\\s+сети|\\s+онлайн)?(?:\\s+информацию)?(?:\\s+про|\\s+о|\\s+об)?(?:\\s+то)?[\\s,:;-]*', ''),
  '(?i)^\\s*(?:please\\s+)?(?:search|find|look\\s+up)(?:\\s+the)?(?:\\s+answer)?(?:\\s+online|\\s+on\\s+the\\s+web|\\s+on\\s+the\\s+internet)?(?:\\s+for|\\s+about)?[\\s,:;-]*', '') AS r FROM q),
b AS (SELECT item_id, q, trim(regexp_replace(r, '\\s+', ' ', 'g'), ' ,.;:-') AS r FROM a), c AS (SELECT item_id, CASE WHEN r = '' THEN q ELSE r END AS r FROM b),
d AS (SELECT item_id, CASE WHEN length(r) > 240 THEN coalesce(nullif(trim(regexp_replace(left(r, 240), ' [^ ]*$', '')), ''), r) ELSE r END AS r FROM c)
SELECT item_id, CASE WHEN contains(lower(r), 'frostpunk') THEN r ELSE 'Frostpunk ' || r END AS query FROM d""")
def str31_web_queries(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").selectExpr("item_id", f"concat({REQUEST[0]}, text) AS question")
    return asked.select("item_id", crawl.web_query(F.col("question")).alias("query"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS size,
  CASE WHEN length(f) <= 350 THEN f ELSE rtrim(left(f, 350)) || '...' END AS preview FROM (SELECT doc_id, (length(text) * (1 + doc_id % 3 * 4099) * (1 + doc_id % 2 * 65537))::BIGINT AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)""")
def str34_sizes_and_previews(spark, sf_dir):
    """FLT-25, FN-15 and STR-34."""
    sized = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(length(text) AS bigint) * (1 + doc_id % 3 * 4099) * (1 + doc_id % 2 * 65537) AS n", "text")
    return sized.select("doc_id", classify.file_size(F.col("n")).alias("size"), classify.preview(F.col("text")).alias("preview"))


@query("""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN ' [' || props || ']' WHEN 2 THEN '{broken' END AS t FROM events)
SELECT event_id, CASE WHEN trim(t) LIKE '{%' AND json_valid(t) THEN len(json_keys(t)) WHEN trim(t) LIKE '[%' AND json_valid(t) THEN 1 ELSE 0 END::INTEGER AS n_keys, CASE WHEN trim(t) LIKE '[%' AND json_valid(t) THEN trim(t) END AS citations FROM m""")
def fn11_message_metadata(spark, sf_dir):
    told = table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat(' [', props, ']') WHEN 2 THEN '{broken' END AS t")
    read = told.select("event_id", chat.metadata(F.col("t")).alias("m"))
    return read.select("event_id", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit("citations")).alias("citations"))


@query("""SELECT doc_id, lang AS lang, 'text' AS parser, 2 + (doc_id % 2 = 0)::INTEGER AS n_keys, CASE WHEN doc_id % 2 = 0 THEN 'parsed' ELSE 'grabbed' END AS origin FROM documents""")
def fn12_merged_metadata(spark, sf_dir):
    grabbed = "CASE WHEN doc_id % 2 = 0 THEN map('lang', lang, 'origin', 'grabbed') ELSE map('lang', lang, 'origin', 'grabbed') END"
    parsed = "CASE WHEN doc_id % 2 = 0 THEN map('origin', 'parsed', 'parser', 'text') ELSE map('parser', 'text') END"
    m = pipelines.merged(F.expr(grabbed), F.expr(parsed))
    one = table(spark, sf_dir, "documents").select("doc_id", m.alias("m"))
    return one.select("doc_id", F.try_element_at("m", F.lit("lang")).alias("lang"), F.try_element_at("m", F.lit("parser")).alias("parser"), (F.size("m") - F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)).alias("n_keys"), F.try_element_at("m", F.lit("origin")).alias("origin"))


TYPED = pick(["", " S ", "u", "q", "id:7, 9,7", "id: ,", "1,3", "3, 1,3", "9", ",", "x"], "doc_id")


@query(f"""WITH t AS (SELECT doc_id, lower(trim({TYPED[1]})) AS v FROM labels),
n AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(v, '^id:', ''), ','), lambda x: trim(x)), lambda x: x <> '') AS typed FROM t),
c AS (SELECT *, list_transform(typed, lambda x: try_cast(x AS BIGINT)) AS numbers, v LIKE 'id:%' AS by_id FROM n)
SELECT doc_id, CASE WHEN v = '' THEN NULL WHEN v = 's' THEN 'skip' WHEN v = 'u' THEN 'unanswerable' WHEN v = 'q' THEN 'quit' WHEN len(typed) = 0 OR len(list_filter(numbers, lambda x: x IS NULL)) > 0 THEN 'error'
  WHEN by_id THEN 'ids' WHEN len(list_filter(numbers, lambda x: x < 1 OR x > 4)) > 0 THEN 'error' ELSE 'ids' END AS action,
  CASE WHEN v IN ('', 's', 'u', 'q') OR len(typed) = 0 OR len(list_filter(numbers, lambda x: x IS NULL)) > 0 THEN NULL WHEN by_id THEN array_to_string(numbers, ',') WHEN len(list_filter(numbers, lambda x: x < 1 OR x > 4)) > 0 THEN NULL
  ELSE CASE v WHEN '1,3' THEN (doc_id + 10) || ',' || (doc_id + 30) WHEN '3, 1,3' THEN (doc_id + 30) || ',' || (doc_id + 10) END END AS document_ids FROM c""")
def misc6_selections(spark, sf_dir):
    typed = table(spark, sf_dir, "labels").selectExpr("doc_id", f"{TYPED[0]} AS typed", "array(doc_id + 10, doc_id + 20, doc_id + 30, doc_id + 40) AS shown")
    s = typed.select("doc_id", evaluation.selection(F.col("typed"), F.col("shown")).alias("s"))
    return s.select("doc_id", "s.action", F.when(F.col("s.document_ids").isNotNull(), F.array_join(F.col("s.document_ids").cast("array<string>"), ",")).alias("document_ids"))


@query("""SELECT doc_id, least(512, len(regexp_extract_all(text, '\\S+')))::INTEGER AS n_tokens FROM documents""")
def fn4_token_counts(spark, sf_dir):
    """A stand-in for the model's tokenizer: words, up to the model's longest input."""
    return table(spark, sf_dir, "documents").select("doc_id", documents.token_count(F.col("text")).alias("n_tokens"))


@query("""SELECT event_id, (2 * pow(2, event_id % 5))::DOUBLE AS wait, ceil(event_id / 32)::BIGINT AS batches FROM events""")
def fn13_batches_and_waits(spark, sf_dir):
    """FN-13 and FN-14: batches of 32, and the wait before the next attempt."""
    n = F.col("event_id") % 5 + 1
    return table(spark, sf_dir, "events").select("event_id", classify.backoff(n, 2.0).alias("wait"), F.ceil(F.col("event_id") / F.lit(32)).alias("batches"))


@query("""SELECT event_id, CASE WHEN e > 0 THEN f || ' discovered · ' || a || ' archived · ' || e || ' existing' ELSE f || ' discovered · ' || a || ' archived' END AS headline, CASE WHEN s < 1 THEN printf('%.0f ms', s * 1000) WHEN s < 60 THEN printf('%.2f sec', s) ELSE (floor(s / 60)::BIGINT) || ' min ' || printf('%.1f sec', s - floor(s / 60) * 60) END AS took
FROM (SELECT event_id, event_id % 7 AS f, event_id % 3 AS a, event_id % 2 AS e, (event_id % 1000) / 8.0::DOUBLE AS s FROM events)""")
def misc11_headlines(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 7 AS f", "event_id % 3 AS a", "event_id % 2 AS e", "cast(event_id % 1000 AS double) / 8 AS s")
    return e.select("event_id", registry.headline(F.col("f"), F.col("a"), F.col("e")).alias("headline"), classify.duration(F.col("s")).alias("took"))
