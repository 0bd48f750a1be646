"""The paged data source, calls of outer services, changed sources, main content, keyword index, vocabulary counts."""

import json
import random
import threading
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import content, vocabulary
from lexispark.operators import adapter, keyword_index, registry
from lexispark.sources import paged

POINT = "point_id long, source_id long, text string"


def store(tmp_path, first, end, size=10):
    for n in range(first, end):
        folder = tmp_path / "store" / f"page={n}"
        folder.mkdir(parents=True)
        (folder / "part-0.json").write_text("".join(json.dumps({"point_id": i, "source_id": i % 3, "text": f"t{i}", "other": 1}) + "\n" for i in range(n * size, n * size + size)))
    return str(tmp_path / "store")


def test_pages_are_read_in_parallel_with_the_store_s_filters(spark, tmp_path):
    path = store(tmp_path, 0, 7)
    read = paged.register(spark).read.format("paged").schema(POINT).option("path", path).option("filters", "source_id").option("pages", 2)
    assert read.load().rdd.getNumPartitions() == 4
    assert sorted(r.point_id for r in read.load().collect()) == list(range(70))
    assert sorted(r.point_id for r in read.load().filter("source_id = 1 AND point_id > 40").collect()) == [i for i in range(41, 70) if i % 3 == 1]
    # Only the store's column goes to the store.
    reader = paged.PagedReader({"path": path, "filters": "source_id"}, read.load().schema)
    kept = list(reader.pushFilters([paged.EqualTo(("source_id",), 2), paged.In(("source_id",), (1, 2)), paged.EqualTo(("point_id",), 5)]))
    assert kept == [paged.EqualTo(("point_id",), 5)] and reader.wanted == {"source_id": [2]}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(i % 3 == 2 for i in range(70))
    assert paged.PagedReader({"path": str(tmp_path / "none")}, read.load().schema).partitions() == []


def test_pages_as_a_stream_start_again_at_their_offset(spark, tmp_path):
    path, out, marks = store(tmp_path, 0, 3), str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        stream = paged.register(spark).readStream.format("paged").schema(POINT).option("path", path).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.point_id for r in spark.read.schema(POINT).parquet(out).collect())

    assert run() == list(range(30))
    assert run() == list(range(30))
    store(tmp_path, 3, 5)
    assert run() == list(range(50))


class Failing(paged.FolderPages):
    """Pages that fail at first, each once in a process."""

    seen: set = set()

    def page(self, n, filters, schema):
        if n not in Failing.seen:
            Failing.seen.add(n)
            raise ConnectionResetError("gone")
        return super().page(n, filters, schema)


def test_pages_are_asked_for_again(spark, tmp_path):
    path = store(tmp_path, 0, 2)
    reader = paged.PagedReader({"path": path, "client": "tests.test_services:Failing"}, spark.createDataFrame([], POINT).schema)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20


def test_written_pages_are_the_rows(spark, tmp_path):
    rows = spark.range(95).selectExpr("id AS point_id", "id % 3 AS source_id", "concat('t', id) AS text")
    paged.write_pages(rows, f"{tmp_path}/p", "point_id", 10)
    assert len(list(Path(f"{tmp_path}/p").glob("page=*"))) == 10
    got = paged.register(spark).read.format("paged").schema(POINT).option("path", f"{tmp_path}/p").load()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


# calls


def test_one_row_has_one_outcome():
    waits, tried = [], []

    def call(value):
        tried.append(value)
        if value == "twice" and tried.count(value) < 3:
            raise RuntimeError("503 service unavailable")
        if value in ("never", "limit"):
            raise RuntimeError("504 timed out" if value == "never" else "503: rate limit")
        return "" if value == "empty" else value.upper()

    one = lambda v: adapter.one(call, v, 3, 1.0, adapter.passes, waits.append)
    assert one("a") == ("done", 1, "A", None) and one("twice") == ("done", 3, "TWICE", None)
    assert one("never") == ("refused", 3, None, "RuntimeError: 504 timed out")
    assert one("limit") == ("refused", 1, None, "RuntimeError: 503: rate limit")  # a final mark wins
    assert one("empty") == ("refused", 3, None, "empty reply")
    assert len(waits) == 6 and all(base <= w <= 1.5 * base for w, base in zip(waits, [1, 2] * 3))
    assert adapter.passes(TimeoutError()) and not adapter.passes(ValueError("no"))


def test_calls_of_a_partition_are_bounded():
    under_way, most, lock = 0, 0, threading.Lock()

    def call(_):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.01)
        with lock:
            under_way -= 1
        return "x"

    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        assert len(list(pool.map(lambda v: adapter.one(call, v, 1, 0, adapter.passes, time.sleep), "abcdefghij"))) == 10
    assert most == 3


class Killed(BaseException):
    pass


def test_runs_call_only_what_is_open(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def call(value):
        with open(log / f"{value}", "a") as f:
            f.write("x")
        if value.endswith("7"):
            raise RuntimeError("unauthorized")
        return f"<{value}>"

    called = lambda: {p.name: len(p.read_text()) for p in log.iterdir()}
    kept = adapter.outcome_store(spark, str(tmp_path / "store"), 8)
    rows = spark.range(40).selectExpr("id", "concat('v', id) AS input")

    def stop(batch):
        if batch == 2:
            raise Killed

    with pytest.raises(Killed):
        adapter.call_open(kept, rows, call, batches=4, wait=0.0, before=stop)
    first = called()
    assert 0 < len(first) < 40
    adapter.call_open(kept, rows, call, batches=4, wait=0.0)
    assert set(called().values()) == {1} and len(called()) == 40
    assert adapter.call_open(kept, rows, call, batches=4, wait=0.0) == 0
    outcomes = {r.id: (r.status, r.attempts, r.reply, r.error) for r in kept.rows().collect()}
    assert outcomes == {i: ("refused", 1, None, "RuntimeError: unauthorized") if i % 10 == 7 else ("done", 1, f"<v{i}>", None) for i in range(40)}
    adapter.call_open(kept, rows, call, reopen=True, batches=4, wait=0.0)
    assert {k: n for k, n in called().items() if n > 1} == {f"v{i}": 2 for i in (7, 17, 27, 37)}


# sources


def test_edited_sources(spark):
    columns = "id long, key string, source_type string, uri string, name string, status string, " + ", ".join(f"{c} string" for c in registry.FORGOTTEN)
    old = lambda i, key, kind: (i, key, kind, key if kind != "file" else None, f"s{i}", "failed", *["x"] * len(registry.FORGOTTEN))
    sources = spark.createDataFrame([old(1, "https://a.example/x", "web"), old(2, "h2", "file"), old(3, "https://b.example/y", "web"), old(4, "h4", "file"), old(5, "https://c.example/z", "web")], columns)
    docs = spark.createDataFrame([(i, d, True) for i in range(1, 6) for d in (0, 1)], "source_id long, n int, is_active boolean")
    asked = [
        (0, "url", 1, "https://GitHub.com/o/r.git/", None, None), (1, "url", 2, "https://n.example/", None, None), (2, "file", 3, None, "h9", "f"), (3, "file", 2, None, "h4", "f.txt"), (4, "file", 4, None, "h7", "new.txt"),
        (5, "rename", 3, None, None, "  Three "), (6, "rename", 5, None, None, " "), (7, "rename", 99, None, None, "x"), (8, "url", 5, "https://b.example/y/", None, None), (9, "url", 3, "ftp://x", None, None),
        (10, "rename", 4, None, None, "Four"), (11, "url", 5, "https://d.example/1", None, "first"), (12, "url", 5, "https://d.example/2", None, "second"), (13, "url", 3, "https://d.example/2", None, None), (14, "other", 1, None, None, None),
    ]
    requests = spark.createDataFrame(asked, "position int, kind string, source_id long, uri string, file_hash string, name string")
    outcomes, after, held = registry.edit(sources, docs, requests)
    assert {r.position: r.outcome for r in outcomes.collect()} == {
        0: "updated", 1: "invalid", 2: "invalid", 3: "duplicate", 4: "updated", 5: "updated", 6: "invalid", 7: "not_found", 8: "duplicate", 9: "invalid", 10: "updated", 11: "superseded", 12: "updated", 13: "duplicate", 14: "invalid",
    }
    got = {r.id: r for r in after.collect()}
    assert (got[1].source_type, got[1].status, got[1].name, got[1].error, got[1].etag) == ("git", "pending", "o/r", None, None) and got[1].uri == got[1].key
    assert (got[2].key, got[2].status, got[2].name, got[2].error) == ("h2", "failed", "s2", "x")
    assert (got[3].name, got[3].status, got[3].key, got[3].etag) == ("Three", "failed", "https://b.example/y", "x")
    assert (got[4].key, got[4].name, got[4].status, got[4].uri, got[4].last_synced_at) == ("h7", "Four", "pending", None, None)
    assert (got[5].uri, got[5].name, got[5].status) == ("https://d.example/2", "second", "pending")
    assert {(r.source_id, r.is_active) for r in held.collect()} == {(1, False), (2, True), (3, True), (4, False), (5, False)}


# pages

BODY = "This is a sentence of the article, and it goes on for quite a few words so that nobody takes it for a menu."


def page(inner):
    links = "".join(f'<li><a href="/{i}">Section number {i} of this site with a long title for everyone</a></li>' for i in range(8))
    return f"<html><head><title>T</title></head><body><header><h1>Site name</h1><p>{BODY} But of the site.</p></header><ul>{links}</ul>{inner}<footer>{BODY} In the footer.</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        (f"<div><h2>Title</h2><p>{BODY}</p><p>Four short words here.</p><p>{BODY} Again.</p></div><aside>{BODY}</aside>", f"Title\n{BODY}\nFour short words here.\n{BODY} Again."),
        (f"<main><p>{BODY}</p><p>{BODY}</p></main><div>{BODY} Outside.</div>", f"{BODY}\n{BODY}"),
        (f"<article>{BODY}<p>{BODY}</article><article><p>{BODY} Two.</article>", f"{BODY}\n{BODY}\n{BODY} Two."),
        (f"<p>{BODY}<p>{BODY}<div class='user-comments'><p>{BODY} says a reader</p></div><div id=related>{BODY}</div>", f"{BODY}\n{BODY}"),
        (f"<p>{BODY} &amp; more &lt;tags&gt;<br>next <b>bold</b> line</p><script>var x = '{BODY}';</script><p>{BODY}</p>", f"{BODY} & more <tags> next bold line\n{BODY}"),
        (f"<table><tr><td>A cell with five words</td><td><a href=x>A cell of links only here</a></td></tr></table><p>{BODY}</p><p>{BODY}</p>", f"A cell with five words\n{BODY}\n{BODY}"),
    ],
)
def test_main_content(inner, want):
    assert content.main_content(page(inner)) == want


def test_pages_without_dense_text_give_all_of_it(spark):
    short = "<body><p>Hello</p><nav>Menu</nav><p>World</p></body>"
    assert content.main_content(short) == "Hello\nWorld" and content.main_content("") == "" and content.main_content(None) is None
    for broken in ("</p></div><p", "<<<>>>", "<p>" * 500 + BODY, "plain text only", "<table><td><td><tr></table></body>"):
        assert isinstance(content.main_content(broken), str)
    df = spark.createDataFrame([(short,), (None,)], "html string")
    assert [r.t for r in df.select(content.main_text("html").alias("t")).collect()] == ["Hello\nWorld", None]


# keyword index


def test_keyword_index_is_containment_and_reads_few_files(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ÄéX") for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["Needle in it", None, "aaaaaa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "index"), 16)
    index.build(rows)
    for term in ("abc", "AB", "ca b", "äéx", "needle", "NEEDLE IN IT", "nowhere", "aaaa", "a" * 7, "bcbcb", ""):
        want = {i for i, t in enumerate(texts) if term.lower() in (t or "").lower()}
        assert {r.id for r in index.containing(term, rows.schema).collect()} == want, term
    found = index.containing("needle in", rows.schema)
    assert len({f for f in found.inputFiles() if "/rows/" in f}) <= 1 or "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    empty = keyword_index.KeywordIndex(spark, str(tmp_path / "empty"), 4)
    empty.build(rows.limit(0))
    assert empty.containing("abc", rows.schema).collect() == []


# vocabulary


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab▁c", min_size=1, max_size=4), max_size=12), st.text("abc d▁", max_size=30))
def test_longest_pieces(pieces, text):
    shown, held, at, n = "▁" + text.replace(" ", "▁"), set(pieces), 0, 0
    while at < len(shown):
        at += next((size for size in range(len(shown) - at, 0, -1) if shown[at : at + size] in held), 1)
        n += 1
    assert vocabulary.Trie(pieces).tokens(text) == n


def test_vocabulary_counts_of_all_documents_are_those_of_a_plain_loop(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    held = set(vocabulary.pieces_of(path))
    longest = max(map(len, held))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n for r in docs.select("doc_id", vocabulary.token_counts(F.col("text"), path, 1 << 30).alias("n")).collect()}
    for doc_id, text in docs.collect():
        shown, at, n = "▁" + (text or "").replace(" ", "▁"), 0, 0
        while at < len(shown):
            at += next((size for size in range(min(longest, len(shown) - at), 0, -1) if shown[at : at + size] in held), 1)
            n += 1
        assert got[doc_id] == (None if text is None else n)


def test_links_of_a_page():
    from lexispark.sources.crawl import CONTENT, hrefs_within

    whole = "<a href=/0>0</a><body><a href='/1?a=1&amp;b=%20'>1</a><article><p><a class=x href = /2 >2</a></article><a HREF=\" /3 \">3</a><article><a href=/4>4</a></article></body><a href=/5>5</a>"
    # The first article alone, however many there are; entities resolved, quotes left out or not.
    assert hrefs_within(whole, CONTENT) == ["/2"]
    assert hrefs_within(whole, ("body",)) == ["/1?a=1&b=%20", "/2", "/3", "/4"] and len(hrefs_within(whole, ())) == 6
    assert hrefs_within("<div role=main><a href=/1>x</a><div><a href=/2></div></div><a href=/3>", CONTENT) == ["/1", "/2"]
    assert hrefs_within("<!-- <a href=/0> --><script>'<a href=/1>'</script><a name=x><br><a href=/2>", CONTENT) == ["/2"]
    assert hrefs_within(None, CONTENT) is None and hrefs_within("", CONTENT) == []
