"""The retrieval engine against plain Python and hand-made rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from lexispark.functions import documents, ids, text, urls
from lexispark.operators import chat, evaluation, retrieval, sync


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def chunks(t, size, overlap):
    out, start = [], 0
    low = int(size * 0.65)
    while True:
        end = start + size
        if end < len(t):
            window = t[start + low : end]
            for sep in text.SEPARATORS:
                if (at := window.rfind(sep)) >= 0:
                    end = start + low + at + len(sep)
                    break
        else:
            end = len(t)
        out.append((start, end))
        if end >= len(t):
            return out
        start = end - overlap if end - overlap > start else end


def test_chunks(spark):
    texts = ["a", "x" * 100, "x" * 101, "word " * 80, "One. Two! " * 30, "p\n\nq" * 60, "a;b, c? " * 40]
    spans = documents.spans_of(100, 15)
    got = column(spark, texts, spans)
    assert [[(s.s, s.e) for s in g] for g in got] == [chunks(t.strip(), 100, 15) for t in texts]
    assert column(spark, ["", None], spans) == [[], None]
    with pytest.raises(ValueError):
        documents.spans_of(10, 10)


def test_cleaning(spark):
    assert column(spark, ["a \r\n\t b\xa0 c\r\r\r\r d  ", " x "], text.clean) == ["a\nb c\n\nd", "x"]
    assert column(spark, ["A\n\nA\nB\nb \nA"], text.drop_repeated_lines) == ["A\n\nB\nA"]
    folded = ["Straße STRASSE", "ΣΊΣΥΦΟΣ ς", "ﬁne ﬂow", "İ ŉ ſ µ", "ĞÄ", "Ω K Å", "plain"]
    assert column(spark, folded, text.casefold) == [t.casefold() for t in folded]
    assert column(spark, ["Maße\nMASSE\nﬁn\nFIN"], text.drop_repeated_lines) == ["Maße\nﬁn"]


def test_quality(spark):
    words = "plain words " * 20
    rows = ["", None, "short", "longword" * 20, words, "### $$$ %%% " * 15, "see http://a.example/x/y/z?q=abcdef " * 6, "ab ### $$$ " * 20, "ab ((( --- " * 20, "go WWW.a.example/path/to/page " * 5, "a b c d " * 30, "\u3000" * 200]
    want = ["empty", "empty", "too_short", "too_few_words", "useful", "too_few_words", "mostly_links", "mostly_symbols", "useful", "mostly_links", "too_few_words", "empty"]
    assert column(spark, rows, text.quality_reason) == want
    assert column(spark, ["x" * 79, "1 2 3 " * 20, "def name(value): return value " * 4], text.code_quality_reason) == ["code_too_short", "not_enough_code_content", "useful"]


def test_ids(spark):
    names = ["a", "1:2:3:é", ""]
    assert column(spark, names, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_urls(spark):
    rows = ["HTTPS://User@Example.com:443//a//b/?b=2&a=1#f", "example.com", "ftp://x/y", "http://github.com/o/r.git"]
    assert column(spark, rows, urls.normalize_source_url) == ["https://example.com/a/b?a=1&b=2", "https://example.com", None, "http://github.com/o/r.git"]
    # Queries are decoded, sorted and encoded again; the root keeps its slash.
    rest = ["https://h//", "https://h/a%20b?q=a%20b&q=A+b&x&%zz=1&k=%C3%A9*~&&e=", "https:///x", "https://h:8080/?z=1&a=%26"]
    assert column(spark, rest, urls.normalize_source_url) == ["https://h/", "https://h/a%20b?%25zz=1&e=&k=%C3%A9%2A~&q=A+b&q=a+b&x=", None, "https://h:8080/?a=%26&z=1"]
    from urllib.parse import parse_qsl, urlencode

    for raw in ("b=2&a=1", "x&y=&=z", "a=1=2&a=0", "q=%e9%20+*~-_.!'()", "k=%2B%25&k=%", "ä=ö&%C3%A4=1"):
        (got,) = column(spark, [f"https://h/?{raw}"], urls.normalize_source_url)
        assert got == "https://h/?" + urlencode(sorted(parse_qsl(raw, keep_blank_values=True))), raw
    assert column(spark, ["http://h:80/?UTM_source=x&q=1", "https://h"], urls.normalize_crawl_url) == ["http://h/?q=1", "https://h/"]
    assert column(spark, [*rows, "https://gitlab.com/o/r", "https://gitlab.com/o"], urls.source_type) == ["web", "web", "web", "git", "git", "web"]
    assert column(spark, [rows[3], "https://h/a/b/c", "https://h"], urls.display_name) == ["o/r", "h/a/b", "h"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 7), (2, 1, 9)], "case_id int, rank int, document_id int")
    relevant = spark.createDataFrame([(1, 7), (1, 8), (2, 1), (3, 4)], "case_id int, document_id int")
    got = {(r.case_id, r.k): tuple(r)[2:] for r in evaluation.ranking_metrics(ranked, relevant, (1, 3)).collect()}
    assert got[1, 1] == (0, 0, 0, 0) and got[1, 3] == (1, 0.5, 0.5, 0.5) and got[2, 3] == got[3, 3] == (0, 0, 0, 0)


def test_sync_is_idempotent(spark):
    empty = spark.createDataFrame([], "source_id long, external_id string, content_hash string, version int, is_active boolean")
    incoming = spark.createDataFrame([(1, "a", "h1"), (1, "b", "h2")], "source_id long, external_id string, content_hash string")
    first = sync.plan_upsert(empty, incoming)
    assert {r.outcome for r in first.collect()} == {"created"}
    again = sync.plan_upsert(first.drop("outcome"), incoming)
    assert {(r.outcome, r.version) for r in again.collect()} == {("skipped", 1)}
    gone = {r.external_id: r for r in sync.plan_upsert(first.drop("outcome"), incoming.filter("external_id = 'a'")).collect()}
    assert gone["b"].outcome == "deactivated" and not gone["b"].is_active


def test_context_and_chat(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, " "), (1, 3, "y" * 10), (1, 4, "z")], "query_id int, rank int, text string")
    assert [r["rank"] for r in retrieval.limit_context(rows, 20).collect()] == [1]
    assert [(r["rank"], r.citation) for r in retrieval.limit_context(rows, 60).orderBy("rank").collect()] == [(1, "S1"), (3, "S2")]
    assert column(spark, ["  a  b ", "", "w " * 100], chat.title) == ["a b", "New consultation", ("w " * 100)[:119].rstrip() + "…"]


def test_registered_queries_have_columns_of_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
