"""Display values, routes and imports on hand-made rows, the wiki crawl against a plain queue, and the queries against DuckDB."""

from collections import deque
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexispark.functions import display
from lexispark.operators import pipelines, registry
from lexispark.sources import wiki

SMALL = "/root/testdata/sf0.001"
WITH_SQL = ("flt25_display_values", "flt25_error_titles", "fn15_timing_lines", "misc7_references", "misc1_source_names", "fn16_root_documents", "src7_grab_routes", "pip4_failed_rebuild", "pip9_imported_hits")


@pytest.mark.parametrize("name", WITH_SQL)
def test_queries(spark, name):
    db = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SMALL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_labels_and_errors(spark):
    rows = spark.createDataFrame([("file", "..pdf", "Indexed"), ("file", None, None), ("oTHER kind", ".pdf", "x"), (None, None, "")], "t string, e string, s string")
    got = rows.select(display.source_label(F.col("t"), F.col("e")), display.source_icon(F.col("t"), F.col("e")), display.status_color(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("PDF", "draft", "green-8"), ("File", "draft", "blue-grey-7"), ("Other kind", "picture_as_pdf", "blue-grey-7"), (None, "draft", "blue-grey-7")]
    said = {"429 and 503": "CORE QUOTA EXHAUSTED", "403": "CORE ACCESS DENIED", "Service Unavailable": "CORE TEMPORARILY OVERLOADED", "Groq API: timed out": "CORE NETWORK TIMEOUT", "timeout": "ARCHIVE NETWORK TIMEOUT", "": "ADVISOR CORE ERROR"}
    got = spark.createDataFrame([(m,) for m in said], "m string").select("m", display.error_title(F.col("m"))).collect()
    assert dict(map(tuple, got)) == said


def test_timing_line(spark):
    line = spark.range(1).select(display.timing_line(F.expr("map('retrieval', 0.1D, 'generation', cast(NULL AS double), 'total', 2D)"))).first()[0]
    assert line == "Search 0.10s · Total 2.00s"


def test_import_without_clean_up_keeps_the_source(spark):
    hits = spark.createDataFrame([(1, 10, "added"), (2, 20, "added"), (3, None, "duplicate")], "position int, source_id int, outcome string")
    results = spark.createDataFrame([(10, "failed", "broke")], "source_id int, status string, error string")
    for clean_up, source, gone in ((False, 10, []), (True, None, [10, 20])):
        told, removed = pipelines.imported(hits, results, clean_up)
        rows = {r.position: (r.source_id, r.status, r.error) for r in told.collect()}
        assert rows[1] == (source, "failed", "broke") and rows[2][1:] == ("failed", None) and rows[3] == (None, "duplicate", "duplicate")
        assert sorted(r.source_id for r in removed.collect()) == gone


def test_sources_without_documents_stay(spark):
    sources = spark.createDataFrame([(1, "git", "b", "c", "e", "l"), (2, "web", "b", "c", "e", "l")], "id int, source_type string, git_branch string, git_commit_sha string, etag string, last_modified string")
    documents = spark.createDataFrame([(2, 1, {"is_root": "false", "etag": "x"})], "source_id int, position int, metadata map<string,string>")
    assert sorted(map(tuple, registry.with_grabbed_facts(sources, documents).collect())) == sorted(map(tuple, sources.collect()))


def by_queue(pages: dict, links: dict, root: str, max_pages: int, max_depth: int) -> list:
    key = lambda t: t.replace("_", " ").strip().lower()
    queue, visited, out = deque([(root, 0, None)]), set(), []
    while queue and len(out) < max_pages:
        title, depth, parent = queue.popleft()
        if key(title) in visited:
            continue
        visited.add(key(title))
        if key(title) not in pages:
            continue
        name = pages[key(title)]
        url = "https://x.fandom.com/ru/wiki/" + quote(name.replace(" ", "_"), safe="/:'()-")
        out.append((name, url, parent, depth, depth == 0))
        if depth < max_depth:
            queue.extend((t, depth + 1, url) for t in links[key(title)])
    return out


@pytest.mark.parametrize("most,deep", [(60, 2), (7, 9), (1, 0), (100, 9)])
def test_wiki_crawl_is_a_queue(spark, most, deep):
    titles = [f"Seite {i} (a*b) Ü~'" for i in range(40)]
    answers, rows, links = {}, [], {}
    for i, t in enumerate(titles):
        to = [titles[(i * 3 + 1) % 40], titles[(i * 7 + 2) % 40].upper(), titles[i // 2].replace(" ", "_")]
        links[t.lower()] = to
        # An apostrophe would end an attribute's value: links are encoded in full.
        html = "".join(f'<a href="/ru/wiki/{quote(x, safe="")}">x</a>' for x in to) + '<a href="/ru/wiki/Category:Y">y</a><a href="https://other.example/ru/wiki/Z">z</a>'
        name = titles[i + 1] if i % 10 == 7 else None
        if i % 9 != 8:
            answers[t.lower()] = name or t
        rows.append((t, name, html if i % 9 != 8 else None))
    articles = spark.createDataFrame(rows, "title string, resolved string, html string")
    root = "https://X.fandom.com/ru/wiki/" + quote(titles[0].replace(" ", "_"))
    got = wiki.crawl_wiki(articles, root, most, deep).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(got) + 1))
    assert [tuple(r)[1:] for r in got] == by_queue(answers, links, titles[0], most, deep)


def test_wiki_crawl_needs_its_root(spark):
    none = spark.createDataFrame([("A", None, "")], "title string, resolved string, html string")
    for root in ("https://x.fandom.com/about", "https://x.fandom.com/wiki/", "https://x.fandom.com/wiki/A"):
        with pytest.raises(ValueError):
            wiki.crawl_wiki(none, root)
