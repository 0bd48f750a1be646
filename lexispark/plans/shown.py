"""Registered queries of what is shown, of routes, wiki crawls, imports and clean-ups, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import display
from lexispark.operators import pipelines, registry
from lexispark.plans.queries import _VIEWS, query, table, views
from lexispark.sources import wiki


def _one_of(key: str, *values: str | None) -> str:
    """SQL that chooses from a short list by a number, the same for both engines."""
    said = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {said} END"


# Stand-ins for columns that the driver's tables lack.
_TYPE = _one_of("doc_id", "web", "git", "file", "wIki page")
_EXTENSION = _one_of("doc_id", ".pdf", ".docx", ".xls", ".pptx", ".txt", "", None)
_STATUS = _one_of("doc_id", "pending", "Processing", "indexed", "failed", "odd")
_MESSAGE = _one_of(
    "event_id", "HTTP 429", "Quota Exceeded", "403 and 503", "Forbidden", "503", "High demand, timeout", "Gemini API timed out", "groq api: TIMEOUT", "read timeout", "broken", "",
)
_REFERENCES = {
    "kind": _one_of("doc_id", "web", "git", "file"), "uri": _one_of("doc_id", "https://s", "", None, "u", "v"), "external_id": _one_of("doc_id", "e1", "", None, "e2"),
    "title": _one_of("doc_id", "Title", "Other", None, "Last", "", "T", "U"),
}
_NAMED = ", ".join(f"{sql} AS {name}" for name, sql in _REFERENCES.items())


@query(f"""SELECT doc_id, CASE kind WHEN 'web' THEN 'Web' WHEN 'git' THEN 'Git' WHEN 'file' THEN CASE WHEN coalesce(e, '') = '' THEN 'File' ELSE upper(ltrim(e, '.')) END ELSE 'Wiki page' END AS label,
CASE WHEN kind = 'web' THEN 'language' WHEN kind = 'git' THEN 'code' WHEN e = '.pdf' THEN 'picture_as_pdf' WHEN e IN ('.doc', '.docx') THEN 'description' WHEN e IN ('.xls', '.xlsx', '.csv') THEN 'table_chart' WHEN e IN ('.ppt', '.pptx') THEN 'slideshow' ELSE 'draft' END AS icon,
CASE lower(s) WHEN 'pending' THEN 'orange-8' WHEN 'processing' THEN 'light-blue-8' WHEN 'indexed' THEN 'green-8' WHEN 'failed' THEN 'red-8' ELSE 'blue-grey-7' END AS color
FROM (SELECT doc_id, {_TYPE} AS kind, {_EXTENSION} AS e, {_STATUS} AS s FROM documents)""")
def flt25_display_values(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TYPE} AS kind", f"{_EXTENSION} AS e", f"{_STATUS} AS s")
    kind, extension = F.col("kind"), F.col("e")
    return rows.select("doc_id", display.source_label(kind, extension).alias("label"), display.source_icon(kind, extension).alias("icon"), display.status_color(F.col("s")).alias("color"))


@query(f"""SELECT event_id, CASE WHEN regexp_matches(m, '429|rate limit|too_many_requests|quota exhausted|quota exceeded') THEN 'CORE QUOTA EXHAUSTED' WHEN regexp_matches(m, '403|access denied|forbidden') THEN 'CORE ACCESS DENIED'
WHEN regexp_matches(m, '503|service[_ ]unavailable|high demand|temporarily unavailable') THEN 'CORE TEMPORARILY OVERLOADED' WHEN regexp_matches(m, 'timeout|timed out') THEN CASE WHEN regexp_matches(m, '(gemini|groq) api') THEN 'CORE NETWORK TIMEOUT' ELSE 'ARCHIVE NETWORK TIMEOUT' END
ELSE 'ADVISOR CORE ERROR' END AS title FROM (SELECT event_id, lower({_MESSAGE}) AS m FROM events)""")
def flt25_error_titles(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", display.error_title(F.expr(_MESSAGE)).alias("title"))


@query("""SELECT event_id, concat_ws(' · ', CASE WHEN event_id % 5 <> 0 THEN 'Search ' || printf('%.2f', (event_id % 1000) / 4.0::DOUBLE) || 's' END, CASE WHEN event_id % 3 <> 0 THEN 'Analysis ' || printf('%.2f', (event_id % 77) / 2.0::DOUBLE) || 's' END,
CASE WHEN event_id % 7 <> 0 THEN 'Core ' || printf('%.2f', (event_id % 13)::DOUBLE) || 's' END, CASE WHEN event_id % 11 <> 0 THEN 'Total ' || printf('%.2f', (event_id % 5000) / 4.0::DOUBLE) || 's' END) AS line FROM events""")
def fn15_timing_lines(spark, sf_dir):
    took = {"retrieval": "CASE WHEN event_id % 5 <> 0 THEN event_id % 1000 / 4D END", "rerank": "CASE WHEN event_id % 3 <> 0 THEN event_id % 77 / 2D END", "generation": "CASE WHEN event_id % 7 <> 0 THEN event_id % 13 / 1D END", "total": "CASE WHEN event_id % 11 <> 0 THEN event_id % 5000 / 4D END"}
    seconds = F.create_map(*[x for key, value in took.items() for x in (F.lit(key), F.expr(value))])
    return table(spark, sf_dir, "events").select("event_id", display.timing_line(seconds).alias("line"))


@query(f"""SELECT doc_id, CASE WHEN kind = 'web' AND external_id <> '' THEN external_id WHEN kind = 'git' THEN coalesce(uri, '') || ' -> ' || coalesce(nullif(external_id, ''), title, 'None') ELSE title END AS printed,
CASE kind WHEN 'web' THEN coalesce(nullif(external_id, ''), nullif(uri, ''), '') WHEN 'git' THEN CASE WHEN uri <> '' THEN uri || ' -> ' || coalesce(external_id, 'None') ELSE coalesce(external_id, '') END ELSE coalesce(nullif(title, ''), nullif(external_id, ''), '') END AS stored
FROM (SELECT doc_id, {_NAMED} FROM documents)""")
def misc7_references(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{sql} AS {name}" for name, sql in _REFERENCES.items()])
    of = [F.col(c) for c in _REFERENCES]
    return rows.select("doc_id", display.script_reference(*of).alias("printed"), display.dataset_reference(*of).alias("stored"))


@query(f"WITH {_VIEWS} SELECT d.id, CASE d.source_id WHEN 3 THEN 'Unknown' ELSE 'Source ' || d.source_id END AS source_name FROM docs d")
def misc1_source_names(spark, sf_dir):
    """Documents of four sources, of which the store has lost one."""
    _, docs, sources = views(spark, sf_dir)
    return registry.with_source_name(docs, sources.filter("id <> 3").selectExpr("id", "concat('Source ', id) AS name")).select("id", "source_name")


_GRABBED = "SELECT doc_id % 200 AS source_id, doc_id AS position, doc_id % 3 = 1 AS is_root, 'b' || doc_id AS branch, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id END AS commit_sha, 'g' || doc_id AS etag, 'l' || doc_id AS last_modified FROM documents"


@query(f"""WITH g AS ({_GRABBED}), s AS (SELECT i AS id, CASE i % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'web' ELSE 'file' END AS source_type FROM range(250) r(i)), f AS (SELECT source_id, min(position) AS first, min(position) FILTER (is_root) AS root FROM g GROUP BY 1)
SELECT s.id, CASE WHEN source_type = 'git' AND first IS NOT NULL THEN a.branch ELSE 'old' END AS git_branch, CASE WHEN source_type = 'git' AND first IS NOT NULL THEN a.commit_sha ELSE 'old' END AS git_commit_sha,
CASE WHEN source_type = 'web' AND root IS NOT NULL THEN b.etag ELSE 'old' END AS etag, CASE WHEN source_type = 'web' AND root IS NOT NULL THEN b.last_modified ELSE 'old' END AS last_modified
FROM s LEFT JOIN f ON f.source_id = s.id LEFT JOIN g a ON a.position = f.first LEFT JOIN g b ON b.position = f.root""")
def fn16_root_documents(spark, sf_dir):
    """250 sources, documents for 200 of them at most."""
    meta = "map('is_root', cast(doc_id % 3 = 1 AS string), 'branch', concat('b', doc_id), 'commit_sha', CASE WHEN doc_id % 2 = 0 THEN concat('c', doc_id) END, 'etag', concat('g', doc_id), 'last_modified', concat('l', doc_id)) AS metadata"
    grabbed = table(spark, sf_dir, "documents").selectExpr("doc_id % 200 AS source_id", "doc_id AS position", meta)
    old = ["git_branch", "git_commit_sha", "etag", "last_modified"]
    sources = spark.range(250).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'web' ELSE 'file' END AS source_type", *[f"'old' AS {c}" for c in old])
    return registry.with_grabbed_facts(sources, grabbed).select("id", *old)


_URI = "CASE doc_id % 7 WHEN 0 THEN 'https://a.fandom.com/wiki/Page_' || doc_id WHEN 1 THEN 'https://a.fandom.com/ru/wiki/' WHEN 2 THEN 'https://A.Example/x' WHEN 3 THEN '  ' WHEN 4 THEN 'https://fandom.com/wiki/X' WHEN 5 THEN 'https://b.fandom.com/about' END"


@query(f"""SELECT doc_id, CASE WHEN error IS NULL THEN CASE WHEN kind <> 'web' THEN kind WHEN doc_id % 7 = 0 THEN 'fandom' ELSE 'site' END END AS grabber, error FROM (SELECT doc_id, kind,
CASE WHEN kind NOT IN ('web', 'git', 'file') THEN 'unsupported source type' WHEN kind = 'web' AND doc_id % 7 IN (3, 6) THEN 'no URL' WHEN kind = 'web' AND doc_id % 7 IN (1, 5) THEN 'no wiki article' END AS error FROM (SELECT doc_id, {_TYPE} AS kind FROM documents))""")
def src7_grab_routes(spark, sf_dir):
    """SRC-7 and SRC-2a."""
    found = table(spark, sf_dir, "documents").select("doc_id", wiki.route(F.expr(_TYPE), F.expr(_URI)).alias("r"))
    return found.select("doc_id", "r.*")


@query()
def src3_wiki_crawl(spark, sf_dir):
    """The pages as one wiki, each linking to four others in mixed spelling; some redirect, some failed."""
    link = "concat('<a href=\"', {0}, '\">x</a>')"
    targets = ("concat('/wiki/Page_', page_id * 2 + 1)", "concat('/wiki/page%20', page_id * 2 + 2)", "concat('/wiki/PAGE_', page_id DIV 3)", "'/wiki/Category:All'")
    html = "concat('<body>', " + ", ".join(link.format(t) for t in targets) + ", '</body>')"
    articles = table(spark, sf_dir, "pages").selectExpr("concat('Page ', page_id) AS title", "CASE WHEN page_id % 10 = 7 THEN concat('Page ', page_id + 1) END AS resolved", f"CASE WHEN page_id % 9 <> 8 THEN {html} END AS html")
    return wiki.crawl_wiki(articles, "https://Some.fandom.com/wiki/Page_0", 1000, 8)


@query(f"WITH {_VIEWS} SELECT 'chunk' AS kind, id FROM chunks WHERE document_id % 6 <> 1 UNION ALL SELECT 'point', vec_id FROM embeddings WHERE vec_id % 97 % 6 <> 1")
def pip4_failed_rebuild(spark, sf_dir):
    """Chunks and points of the documents whose rebuild failed go."""
    chunks, docs, _ = views(spark, sf_dir)
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS point_id", "vec_id % 97 AS document_id")
    failed = spark.range(97).selectExpr("id AS document_id").union(docs.select("id")).distinct().filter("document_id % 6 = 1")
    points, chunks = registry.without_failed(failed, points, chunks)
    return chunks.select(F.lit("chunk").alias("kind"), "id").union(points.select(F.lit("point"), "point_id"))


_RESULT = f"SELECT doc_id AS source_id, {_one_of('doc_id', 'indexed', 'busy', 'failed', 'indexed', None)} AS status, {_one_of('doc_id', None, 'x')} AS error FROM documents"


@query(f"""WITH r AS ({_RESULT}), h AS (SELECT doc_id AS position, {_one_of('doc_id', 'added', 'duplicate', 'added', 'invalid', 'added', 'added')} AS outcome FROM documents)
SELECT position, CASE WHEN outcome = 'added' AND r.status IN ('indexed', 'busy') THEN position END AS source_id, CASE outcome WHEN 'duplicate' THEN 'duplicate' WHEN 'invalid' THEN 'failed' ELSE coalesce(r.status, 'failed') END AS status,
CASE WHEN outcome = 'added' AND r.status = 'indexed' THEN NULL WHEN outcome = 'added' AND r.status = 'busy' THEN coalesce(r.error, 'Source is already being indexed.') WHEN outcome = 'added' THEN r.error ELSE outcome END AS error FROM h JOIN r ON r.source_id = h.position""")
def pip9_imported_hits(spark, sf_dir):
    """Every document as a search hit; failed sources are removed again."""
    docs = table(spark, sf_dir, "documents")
    hits = docs.selectExpr("doc_id AS position", "doc_id AS source_id", f"{_one_of('doc_id', 'added', 'duplicate', 'added', 'invalid', 'added', 'added')} AS outcome")
    results = docs.selectExpr("doc_id AS source_id", f"{_one_of('doc_id', 'indexed', 'busy', 'failed', 'indexed', None)} AS status", f"{_one_of('doc_id', None, 'x')} AS error")
    return pipelines.imported(hits, results, clean_up=True)[0].select("position", "source_id", "status", "error")
