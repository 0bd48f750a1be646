"""Rules, stores and whole runs on hand-made rows and against plain Python."""

import io
import json
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from lexispark.functions import classify, documents, text, urls
from lexispark.operators import chat, evaluation, pipelines, prompts, registry, retrieval, sync
from lexispark.sources import crawl
from tests.test_engine import column

# Document ids of a published evaluation of five questions, and what it found.
GOLD = {1: 10468, 2: 10471, 3: 10405, 4: 10371, 5: 10317}
BASELINE = {
    1: [10605, 10451, 10471, 10384, 10340, 10468, 10370, 10351, 10481, 10393, 10518, 10494, 10405, 10368, 10480, 10392],
    2: [10471, 10384, 10351, 10468, 10370, 10480, 10392, 10407, 10605, 10342, 10340, 10350],
    3: [10494, 10405, 10481, 10393, 10370, 10468, 10351, 10340, 10451, 10612],
    4: [10491, 10317, 10371, 10353, 10451, 10340, 10350, 10408, 10349, 10470, 10383, 10354],
    5: [10347, 10388, 10476, 10343, 10351, 10370, 10468, 10325, 10472, 10379, 10338, 10491, 10317, 10371],
}
RERANKED = {
    1: [10471, 10384, 10451, 10468, 10370, 10351, 10480, 10392, 10605, 10494, 10405, 10481, 10393, 10340, 10518, 10368],
    2: [10471, 10384, 10351, 10468, 10370, 10407, 10480, 10392, 10342, 10605, 10340, 10350],
    3: [10494, 10405, 10481, 10393, 10340, 10370, 10468, 10351, 10612, 10451],
    4: [10491, 10317, 10371, 10353, 10451, 10340, 10350, 10408, 10349, 10470, 10383, 10354],
    5: [10347, 10388, 10476, 10338, 10379, 10325, 10472, 10351, 10370, 10468, 10343, 10491, 10317, 10371],
}
SECONDS = {1: (12.766184800000246, 4.864227600000049), 2: (2.679866600000423, 4.94923419999941), 3: (0.7610221000004458, 4.6777038999998695), 4: (0.7798775999999634, 4.084131200000229), 5: (0.8132522999994762, 4.296986600000309)}
FOUND = {
    "baseline": {3: (0.6, 0.2, 0.6, 0.366667), 5: (0.6, 0.12, 0.6, 0.366667), 10: (0.8, 0.08, 0.8, 0.4), 20: (1.0, 0.080119, 1.0, 0.415385)},
    "reranked": {3: (0.6, 0.2, 0.6, 0.366667), 5: (0.8, 0.16, 0.8, 0.416667), 10: (0.8, 0.08, 0.8, 0.416667), 20: (1.0, 0.080119, 1.0, 0.432051)},
}


def golden(spark):
    rows = [(c, i + 1, d, float(-RERANKED[c].index(d))) for c, ds in BASELINE.items() for i, d in enumerate(ds)]
    candidates = spark.createDataFrame(rows, "case_id int, rank int, document_id long, rerank_score double")
    metrics = pipelines.evaluate(candidates, spark.createDataFrame(list(GOLD.items()), "case_id int, document_id long"))
    return metrics, evaluation.summary(metrics, spark.createDataFrame([(c, *s) for c, s in SECONDS.items()], "case_id int, retrieval_seconds double, rerank_seconds double"))


def test_published_evaluation(spark, tmp_path):
    metrics, summary = golden(spark)
    got = summary.first()
    for side, by_k in FOUND.items():
        assert sorted(got[side]) == sorted(by_k) and all(tuple(got[side][k]) == pytest.approx(v, abs=2e-6) for k, v in by_k.items())
    assert got.case_count == 5 and got.k_values == [3, 5, 10, 20]
    assert (got.average_retrieval_seconds, got.average_rerank_seconds) == (3.560041, 4.574457)
    evaluation.experiment_json(summary, metrics.select("case_id", "pipeline", "k", "hit_rate"), "2026-01-01", None).write.text(str(tmp_path / "out"))
    told = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()))
    assert len(told["cases"]) == 40 and told["session_id"] is None and told["summary"]["baseline"]["20"]["hit_rate"] == 1.0


def test_selection(spark):
    rows = ["", None, " S", "u", "Q", "id: 5,6,5", "id:", "2,1,2", "4", "x", ",", "id:x"]
    got = column(spark, rows, lambda v: evaluation.selection(v, F.array(F.lit(10), F.lit(20), F.lit(30))))
    want = [(None, None), (None, None), ("skip", None), ("unanswerable", None), ("quit", None), ("ids", [5, 6, 5]), ("error", None), ("ids", [20, 10]), ("error", None), ("error", None), ("error", None), ("error", None)]
    assert [(g.action, g.document_ids) for g in got] == want


def test_file_types():
    def archive(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "x")
        return out.getvalue()

    assert classify.sniff(b"%PDF-1.7", "a.txt") == ("application/pdf", ".pdf") and classify.sniff(b"GIF89a..", None) == ("image/gif", ".gif")
    assert classify.sniff(archive("word/a.xml"), "x") == (classify.WORD, ".docx") and classify.sniff(archive("XL/a.xml"), "x") == (classify.SHEET, ".xlsx")
    assert classify.sniff(archive("other"), "x.docx") == classify.sniff(classify.ZIP, "y") == ("application/zip", ".zip")
    assert classify.sniff(classify.OLE, "a.PPT") == ("application/vnd.ms-powerpoint", ".ppt") and classify.sniff(classify.OLE, "a") == ("application/x-ole-storage", None)
    assert classify.sniff(b' {"a": 1}', "x.md") == ("application/json", ".json") and classify.sniff(b"{a", "x.MD") == ("text/markdown", ".md")
    assert classify.sniff(b"  <HTML>", "x") == ("text/html", ".html") and classify.sniff("При".encode("cp1251"), "a.xml")[0] == "application/xml"
    assert classify.sniff(b"", "a.bin") == classify.sniff(None, "a.bin") == ("application/octet-stream", ".bin") and classify.sniff(b"plain", ".hidden") == ("text/plain", ".txt")


def test_logs_and_errors(spark):
    m = ["a\n \n b", "[Web] x\nother\n  [OCR] y ", "", None]
    assert column(spark, m[:2], lambda v: classify.log_lines(F.lit("src.x"), v)) == [["a", " b"], ["[Web] x", "other", "  [OCR] y "]]
    assert column(spark, m[:2], lambda v: classify.log_lines(F.lit("console"), v)) == [[], ["[Web] x", "[OCR] y"]]
    assert column(spark, m[:2], lambda v: classify.log_lines(F.lit("urllib3"), v)) == [[], []]
    assert column(spark, ["Reranker ready", "retriever: chunk", "Persisted"], lambda v: classify.log_category(F.lit("advisor.x"), v)) == ["ANALYSIS", "ARCHIVE", "DATABASE"]
    assert column(spark, ["503 busy", "503 and 429", "odd"], classify.is_retryable) == [True, False, False]
    assert column(spark, ["https://steamcommunity.com:443/a", "a.steamcommunity.com", "notsteamcommunity.com", None], classify.is_blocked) == [True, True, False, False]
    sizes = spark.createDataFrame([(None,), (0,), (1023,), (1024,), (1280,), (1 << 20,), (5 << 40,)], "n long").select(classify.file_size(F.col("n")).alias("x")).collect()
    assert [r.x for r in sizes] == ["", "0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "5120.0 GB"]


def test_links(spark):
    base = "https://h.example/a/b/c?x=1"
    rows = ["../d", "./e/../f?q#z", "/g/./h", "//h.example/i", "#j", "?k=1", "https://o.example/", "l", "../../../m", ".."]
    got = column(spark, rows, lambda v: urls.absolute(urls.parts(F.lit(base)), v))
    assert got == ["https://h.example/a/d", "https://h.example/a/b/f?q#z", "https://h.example/g/h", "https://h.example/i", "https://h.example/a/b/c#j", "https://h.example/a/b/c?k=1", "https://o.example/", "https://h.example/a/b/l", "https://h.example/m", "https://h.example/a/"]
    page = '<body><a href="out">o</a><div role="main"><a href="in.pdf">i</a><a href="p.JPG">j</a><a href="x.tar.gz">t</a></div></body>'
    assert column(spark, [page, page.replace('role="main"', ""), None], lambda v: crawl.links(F.lit("https://h.example/z"), v)) == [["https://h.example/in.pdf"], ["https://h.example/in.pdf", "https://h.example/out"], None]
    assert column(spark, ["https://h/a%20b+c/", "https://h:8/", "x y"], urls.file_name) == ["a b+c", "h", "x y"]
    wiki = '<a href="/wiki/Two_words">1</a><a href="/wiki/File:x">f</a><a href="/wiki/two%20Words?a">2</a><a href="/wiki/Other">3</a><a href="/other">4</a>'
    rows = crawl.fandom_links(spark.createDataFrame([(1, "https://w.fandom.com/wiki/Home", wiki), (2, "https://w.fandom.com/", None)], "page_id int, url string, html string")).orderBy("place").collect()
    assert [(r.place, r.title, r.url) for r in rows] == [(0, "two Words", "https://w.fandom.com/wiki/two%20Words"), (3, "Other", "https://w.fandom.com/wiki/Other")]
    assert column(spark, ["https://W.fandom.com/x", "https://fandom.com", "https://a.b"], crawl.grabber) == ["fandom", "site", "site"]


def test_web_query(spark):
    rows = ["Please find online about heat ,", "Найди мне в интернете про уголь", "find", "word " * 60, "x" * 300, "FROSTPUNK 2"]
    got = column(spark, rows, crawl.web_query)
    assert got[:3] == ["Frostpunk heat", "Frostpunk уголь", "Frostpunk find"] and got[5] == "FROSTPUNK 2"
    assert got[3] == "Frostpunk " + ("word " * 48)[:240].rsplit(" ", 1)[0].strip() and got[4] == "Frostpunk " + "x" * 240


def walk(pages, root, most, deep):
    """Breadth-first over {url: (final, mime, links)}, level by level."""
    seen, taken, level = {root}, {}, [(root, None)]
    for depth in range(deep + 1):
        got = {}
        for url, parent in level:
            final, mime, links = pages.get(url, (None, None, None))
            if links is not None and (final or url) not in taken:
                got[final or url] = min(got.get(final or url, (parent or "", mime, links)), (parent or "", mime, links))
        taken |= {u: depth for u in got}
        seen |= set(got)
        found = {}
        for u, (_, mime, links) in got.items():
            for x in links if mime == "text/html" else ():
                if x not in seen:
                    found[x] = min(found.get(x, u), u)
        seen |= set(found)
        level = list(found.items())
        if len(taken) >= most:
            break
    return sorted((d, u) for u, d in taken.items())[:most]


def test_site_crawl(spark):
    at = lambda i: f"https://s.example/p{i}"
    pages = {at(i): (at(i + 1) if i % 10 == 7 else None, "application/pdf" if i % 6 == 5 else "text/html", None if i % 9 == 8 else [at(2 * i + 1), at(2 * i + 2), at(i // 3)]) for i in range(60)}
    rows = [(u, f, m, None if x is None else "".join(f'<a href="{y}">y</a>' for y in x)) for u, (f, m, x) in pages.items()]
    table = spark.createDataFrame(rows, "url string, final_url string, mime_type string, html string")
    for most, deep in ((1000, 4), (9, 4), (1000, 0)):
        got = [(r.depth, r.url) for r in crawl.crawl_site(table, at(0), most, deep).collect()]
        assert got == walk(pages, at(0), most, deep) and len(got) > (0 if deep == 0 else 8)
    with pytest.raises(ValueError):
        crawl.crawl_site(table, at(8), 10, 1)
    links = {u: x or [] for u, (_, _, x) in pages.items()}
    edges = spark.createDataFrame([(u, y) for u, x in links.items() for y in x], "source string, target string")
    depth, queue = {at(0): 0}, deque([at(0)])
    while queue:
        for y in links.get(u := queue.popleft(), []):
            if y not in depth and depth[u] < 3:
                depth[y] = depth[u] + 1
                queue.append(y)
    got = crawl.crawl(edges, spark.createDataFrame([(at(0),)], "page string"), 1000, 3).collect()
    assert {r.page: r.depth for r in got} == depth


def test_judged_and_planned_chunks(spark):
    """Against the same rules in plain Python, chunk by chunk."""
    prose = "Some words that say a lot about very many things in one line, again and again. "
    docs = [(1, 1, "web", "text", "Menu\n" + prose * 40 + "\nSign in"), (1, 2, "git", "code", "def name(value):\n    return value\n" * 60), (2, 3, "file", "text", "\n\n".join(f"{i} {prose * 3}".strip() for i in range(9))), (2, 4, "web", "text", None), (2, 5, "file", "text", "tiny"), (2, 6, "api", "text", prose * 60)]
    table = spark.createDataFrame(docs, "source_id long, document_id long, source_type string, document_type string, text string").withColumn("is_active", F.col("document_id") != 5)
    judged = pipelines.judged_chunks(table)
    rows = {(r.document_id, r.raw_index): r for r in judged.collect()}
    cut = {d: documents.split_document(t.replace("Menu\n", "").replace("\nSign in", "") if t and k == "web" else t, k, kind) for _, d, k, kind, t in docs}
    assert {d: sum(k[0] == d for k in rows) for d in cut} == {1: 3, 2: len([k for k in rows if k[0] == 2]), 3: len(cut[3]), 4: 0, 5: 1, 6: len(cut[6])}
    assert [rows[6, i].content for i in range(len(cut[6]))] == cut[6] and rows[5, 0].reason == "too_short" and rows[2, 0].reason == "useful"
    plan, chunks = pipelines.vectorize(table, spark.createDataFrame([(3, True), (6, False)], "document_id long, current boolean"), lambda c: F.array(F.length(c).cast("float")))
    assert {r.document_id: (r.action, r.scope) for r in plan.collect()} == {1: ("rebuild", "source"), 2: ("rebuild", "source"), 3: ("skip", None), 4: ("rebuild", "document"), 5: ("purge", "document"), 6: ("rebuild", "document")}
    new = chunks.collect()
    assert {r.document_id for r in new} == {1, 2, 6} and len({r.point_id for r in new}) == len(new)
    assert all(r.chunk_index < r.document_chunk_count and r.embedding == [len(r.content) + 9.0] for r in new)
    left = pipelines.replaced(spark.createDataFrame([(3, "a"), (6, "b"), (5, "c")], "document_id long, content string"), plan, chunks.select("document_id", "content"))
    assert sorted(r.content for r in left.filter("document_id IN (3, 5)").collect()) == ["a"]


def test_repeated_lines(spark):
    def plain(t):
        kept, last = [], None
        for line in t.split("\n"):
            key = " ".join(line.split()).casefold()
            if not key:
                kept.append("")
            elif key != last:
                kept.append(line)
                last = key
        return __import__("re").sub("\n{3,}", "\n\n", "\n".join(kept)).strip()

    rows = ["A\n\na\nB", "a\n\n\n\na \n\nb\nB\n\n\nc", "", "\n\n", "Straße\nSTRASSE\nx", "x\n" * 2000, "\n".join(str(i % 3 // 2) for i in range(100))]
    assert column(spark, rows, text.drop_repeated_lines) == [plain(t) for t in rows]


def test_registry(spark, tmp_path):
    known = spark.createDataFrame([(7, "https://a.example/x")], "id long, key string")
    rows = [(1, "web", "A.example//x/", None), (2, "web", "https://b.example", None), (3, "web", "http://b.example:80", None), (4, "web", "https://B.example#top", None), (9, "web", "https://b.example/", None), (5, "file", None, "h"), (6, "file", None, "h"), (7, "file", None, None), (8, "web", "ftp://x", None)]
    got = {r.position: r for r in registry.register(known, spark.createDataFrame([(*r, "n") for r in rows], "position int, source_type string, uri string, file_hash string, name string")).collect()}
    assert {p: r.outcome for p, r in got.items()} == {1: "duplicate", 2: "added", 3: "added", 4: "duplicate", 5: "added", 6: "duplicate", 7: "invalid", 8: "invalid", 9: "added"}  # the root's slash is part of a URL
    assert got[1].id == 7 and got[2].id == got[4].id != got[9].id and got[7].id is None
    assert registry.same_key(known, "https://a.example/x", 7).count() == 0 and registry.same_key(known, "https://a.example/x").count() == 1
    points = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "point_id string, source_id long, document_id long")
    assert registry.delete_points(points, points.filter("false"), "point_id").count() == 2 and registry.delete_points(points, points.filter("source_id = 2"), "source_id").count() == 1
    with pytest.raises(ValueError):
        registry.delete_points(points, points, "title")
    registry.ensure_points_table(spark, "points_of_test", 2)
    registry.ensure_points_table(spark, "points_of_test", 2)
    assert spark.table("points_of_test").columns[0] == "point_id"
    spark.sql("DROP TABLE points_of_test")


def test_latest_points_and_outcomes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "point_id string, v int")
    new = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("c", 5, 1)], "point_id string, v int, write_order int")
    assert sorted(map(tuple, sync.latest_points(old, new).collect())) == [("a", 4), ("b", 2), ("c", 5)]
    rows = spark.createDataFrame([(str(i), "failed" if i < 5 else "created", f"e{i}") for i in range(8)], "external_id string, outcome string, error string")
    assert tuple(sync.outcome_counts(rows).first()) == (3, 0, 0, 5, ["e0", "e1", "e2"]) and sync.outcome_counts(rows.limit(0)).first().messages == []


def test_ingest(spark):
    files = [(1, "a", "a", ".txt", None, b" one  line ", None), (1, "b", "b", ".exe", "image/png", b"x", {"k": "v"}), (1, "c", "c", ".json", None, b'{"a":1}', None), (2, "d", "d", None, None, b"x", None), (3, "e", "e", ".md", None, b" \n", None)]
    parsed = pipelines.parse_files(spark.createDataFrame(files, "source_id long, external_id string, name string, extension string, mime_type string, content binary, metadata map<string,string>"))
    got = {r.external_id: r for r in parsed.collect()}
    assert got["a"].text == "one line" and got["a"].metadata == {"parser": "text"} and got["c"].document_type == "json" and got["b"].error == "Unsupported file type: .exe" and got["e"].error.startswith("No text")
    old = spark.createDataFrame([(1, "b", "h", 3, True, "t", {"m": "1"}), (1, "z", "h", 1, True, "t", None)], "source_id long, external_id string, content_hash string, version int, is_active boolean, title string, metadata map<string,string>")
    out = pipelines.ingest(old, parsed)
    got = {r.external_id: (r.outcome, r.version, r.is_active) for r in out.collect()}
    assert got == {"a": ("created", 1, True), "b": ("failed", 3, True), "c": ("created", 1, True), "d": ("failed", None, None), "e": ("failed", None, None), "z": ("deactivated", 1, False)}
    assert {r.source_id: r.status for r in pipelines.source_status(out).collect()} == {1: "indexed", 2: "failed", 3: "failed"}


def test_chat(spark):
    old = spark.createDataFrame([(1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, 2, " Assistant", " yes "), (1, 3, "system", "x"), (1, 4, "user", " "), (2, 1, "user", "x"), (1, 5, None, "x")], old.schema)
    taken, refused = chat.append(old, new)
    assert [tuple(r) for r in taken.orderBy("turn").collect()] == [(1, 1, "user", "hi"), (1, 2, "assistant", "yes")] and sorted(r.reason for r in refused.collect()) == ["blank", "role", "role", "session"]
    assert column(spark, ['{"a": [1]}', "[1, 2]", "{", None, "3"], chat.metadata) == [{"a": "[1]"}, {"citations": "[1, 2]"}, {}, {}, {}]
    assert column(spark, ["x " * 100, " "], chat.created_title) == [("x " * 100)[:120], "New consultation"]
    seen = chat.touched(spark.createDataFrame([(1, 5), (2, 9)], "conv_id long, updated_at int"), spark.createDataFrame([(1, 7), (2, 8)], "conv_id long, created_at int"))
    assert sorted((r.conv_id, r.updated_at) for r in seen.collect()) == [(1, 7), (2, 9)]


def test_prompt(spark):
    asked = spark.createDataFrame([(1, " why? "), (2, "how?")], "query_id int, question string")
    context = spark.createDataFrame([(1, 2, "S2", "n", "t", "", " b "), (1, 1, "S1", "n", "t", "r", "a")], "query_id int, rank int, citation string, source_name string, title string, reference string, text string")
    said = spark.createDataFrame([(1, i, role, t) for i, (role, t) in enumerate([("user", "old")] + [("system", "s"), ("user", " u "), ("assistant", "a"), ("user", " ")] * 2)], "query_id int, position int, role string, text string")
    got = {r.query_id: r.prompt for r in prompts.prompt(asked, context, said).collect()}
    assert got[1] == f"CHAT HISTORY:\nUSER: u\nASSISTANT: a\nUSER: u\nASSISTANT: a\n\nINDEXED CONTEXT:\n\n[S1]\nSource: n\nDocument: t\nReference: r\nContent:\na\n\n---\n\n[S2]\nSource: n\nDocument: t\nContent:\nb\n\nUSER QUESTION:\nwhy?\n\n{prompts.INSTRUCTION}"
    assert got[2] == f"{prompts.NO_CONTEXT}\n\nUSER QUESTION:\nhow?\n\n{prompts.INSTRUCTION}"


def test_verdicts(spark):
    hits = spark.createDataFrame([(1, str(i), 1.0 - i / 100) for i in range(8)] + [(1, None, 0.5), (1, "x", 0.4)], "query_id int, chunk_id string, score double")
    chunks = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 9, 0)], "id long, document_id long, chunk_index long")
    docs = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True), (4, 8, True)], "id long, source_id long, is_active boolean")
    sources = spark.createDataFrame([(1, "indexed"), (2, "failed")], "id long, status string")
    got = retrieval.verdict_counts(retrieval.judged_hits(hits, chunks, docs, sources, 2)).first()
    assert tuple(got) == (1, 10, 3, 1, 1, 1, 1, 1, 2)
