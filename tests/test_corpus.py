"""Sources, document preparation, prompts and the re-sync stream on hand-made rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexispark.functions import documents as D
from lexispark.operators import prompts
from lexispark.sources import crawl, files
from lexispark.streaming import resync
from tests.test_engine import column


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", content)
    return out.getvalue()


def test_normalize_and_noise(spark):
    assert column(spark, ["a&amp;b\u200b\xa0\ufb01\r\nc", None], D.normalize) == ["a&b fi\nc", None]
    rows = ["  Accept  cookie ", "Terms of service", "We use cookies here", "Наверх", "cookie jar", "", "x"]
    assert column(spark, rows, D.noise_line) == [True, True, True, True, False, True, False]
    page = "Menu\nText here\n\n\n\nText here\n  Sign in\nmore"
    assert column(spark, [page], lambda v: D.clean_document(v, F.lit("web"), F.lit(False))) == ["Text here\n\nmore"]
    assert column(spark, ["if x:\n    y  "], lambda v: D.clean_document(v, F.lit("git"), F.lit(True))) == ["if x:\n    y"]


def test_document_chunks(spark):
    pages = "Intro\n[Page 1]\none\n[Page 2]\n" + "two " * 400
    got = D.split_document(pages, "file", "text")
    assert got[:2] == ["Intro", "[Page 1]\none"] and len(got) > 3
    ten = "\n\n".join(f"p{i}" for i in range(10))
    assert D.split_document(ten, "file", "text") == ["\n\n".join(f"p{i}" for i in range(n)) for n in (8, 9, 10)]  # short ones all overlap
    giant = "a short one\n\n" + "word " * 400 + "\n\nlast"
    got = D.split_document(giant, "file", "text")
    assert got[0] == "a short one" and got[-1] == "last" and all(len(c) <= 900 for c in got)
    assert D.split_document(None, "file", None) == D.split_document(" \n", "web", None) == []
    assert D.tail(["a", "b" * 500], 100) == ["b" * 500] and D.tail(["a"], 0) == []
    rows = spark.createDataFrame([(ten, "file"), (None, "web")], "t string, s string")
    assert [len(r[0]) for r in rows.select(D.document_chunks("t", "s", F.lit("text"))).collect()] == [3, 0]


def test_parsers():
    assert D.plain_html("<nav>n</nav><p>a &amp; <b>b</b></p><script>x</script><p>c") == "a &\nb\nc"
    assert D.decode(b"\xcf\xf0\xe8") == "При" and D.decode(b"\xef\xbb\xbfa") == "a" and D.decode(None) is None
    assert D.pretty_json('{"a":"é"}') == '{\n  "a": "é"\n}' and D.pretty_json("{") == "{"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    doc = f'<w:document xmlns:w="w"><w:body>{p("one")}{p("")}<w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr></w:tbl></w:body></w:document>'
    assert D.parse("x.docx", zipped(word__document=doc)) == "one\n\na | b"
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:t>hi</a:t></p:sp></p:sld>'
    assert D.parse("x.pptx", zipped(ppt__slides__slide2=slide, ppt__slides__slide10=slide)) == "[Slide 2]\nhi\n\n[Slide 10]\nhi"
    assert D.parse("x.docx", b"broken") is None and D.parse("x.txt", b"") == ""


def test_repository(spark, tmp_path):
    for name, data in {"README": b"hello", "a/b.py": b"x = 1", "node_modules/c.py": b"x", "d.min.js": b"x", "e.bin": b"x", "f.txt": b"a\x00b", "g.txt": b"", "h.json": b'{"a":1}', "yarn.lock": b"x", "i.txt": b"\x01\x02abc"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.external_id: (r.mime_type, r.text) for r in files.read_repository(spark, str(tmp_path)).collect()}
    assert got == {"README": ("text/plain", "hello"), "a/b.py": ("text/plain", "x = 1"), "h.json": ("application/json", '{\n  "a": 1\n}')}
    assert [r.external_id for r in files.read_repository(spark, str(tmp_path), 1).collect()] == ["README"]
    assert [(r.external_id, r.text) for r in files.read_file(spark, str(tmp_path / "README")).collect()] == [("README", "hello")]


def test_cases(spark, tmp_path):
    cases = [{"id": "a", "question": "q"}, {"id": "b", "question": "q", "labeled": True, "relevant_document_ids": [3]}, {"id": "c", "question": "q", "labeled": True, "answerable": False, "relevant_document_ids": [3]}]
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "cases": cases}, indent=1))
    read = files.read_cases(spark, str(tmp_path / "c.json"))
    assert {(r.id, r.language, r.answerable, r.labeled, len(r.relevant_document_ids)) for r in read.collect()} == {("a", "en", True, False, 0), ("b", "en", True, True, 1), ("c", "en", False, True, 1)}
    assert [r.id for r in files.usable_cases(read).collect()] == ["b"]


def test_links_and_crawl(spark):
    page = '<a href="/out">o</a><main><a href="/a/">1</a><a href="b?utm_source=x&z=1#f">2</a><a class=k href=\'//h.org/c\'>3</a><a href="https://other.org/d">4</a><a href="mailto:x">5</a><a href="/Login/x">6</a><a href="/a">7</a></main>'
    assert column(spark, [page, "", None], lambda v: crawl.links(F.lit("https://H.org/dir/page"), v)) == [["https://h.org/a", "https://h.org/c", "https://h.org/dir/b?z=1"], [], None]
    wiki = ["https://en.wikipedia.org/wiki/Talk:X", "https://en.wikipedia.org/wiki/X?action=edit", "https://en.wikipedia.org/wiki/X", "https://h.org/wiki/Talk:X"]
    assert column(spark, wiki, crawl.ignored_wiki) == [True, True, False, False]
    assert column(spark, ["User talk:A", "Dragon"], crawl.ignored_fandom) == [True, False]
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 3), (3, 4)], "source int, target int")
    root = spark.createDataFrame([(0,)], "page int")
    assert [tuple(r) for r in crawl.crawl(edges, root).collect()] == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert [tuple(r) for r in crawl.crawl(edges, root, 0, -1).collect()] == [(0, 0)]


def test_prompts(spark):
    rows = spark.createDataFrame([("web", "u", "", "t"), ("git", "u", "f", None), ("git", "", "f", None), ("file", "u", "e", ""), (None, None, "e", None)], "s string, u string, e string, t string")
    assert [r[0] for r in rows.select(prompts.reference(*map(F.col, "suet"))).collect()] == ["u", "u -> f", "f", "e", "e"]
    chunks = spark.createDataFrame([(1, 2, "S2", "b"), (1, 1, "S1", "a")], "query_id int, rank int, citation string, text string")
    assert prompts.context_block(chunks).collect()[0].context == "[S1]\na\n\n---\n\n[S2]\nb"
    scored = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "query_id int, rank int, rerank_score double")
    assert [r["rank"] for r in prompts.rerank(scored, 4).orderBy("new_rank").collect()] == [4, 2, 3, 1]
    with pytest.raises(ValueError):
        prompts.rerank(scored, 0)


def test_resync_stream(spark, tmp_path):
    drop, out, marks = (str(tmp_path / n) for n in ("drop", "out", "marks"))

    def put(name, *rows):
        (tmp_path / "drop").mkdir(exist_ok=True)
        (tmp_path / "drop" / name).write_text("\n".join(json.dumps(dict(zip(("source_id", "external_id", "content_hash", "seq"), r))) for r in rows))

    put("1.json", (1, "a", "h1", 1), (1, "a", "h2", 2), (1, "b", "h1", 1))
    kept = resync.document_store(spark, out, 4)
    resync.start(kept, drop, marks).awaitTermination(60)
    put("2.json", (1, "a", "h3", 1), (1, "c", "h1", 1))
    resync.start(kept, drop, marks).awaitTermination(60)
    got = {(r.external_id, r.content_hash, r.version, r.is_active) for r in kept.rows().collect()}
    assert got == {("a", "h3", 2, True), ("b", "h1", 1, True), ("c", "h1", 1, True)}
