"""What showed on larger tables only: odd pages, and steps whose cost or memory grew faster than their input."""

import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.functions import documents as D
from lexispark.functions import text as T
from lexispark.operators import keyword_index, pipelines, vector_index, vectorize
from lexispark.plans.flows import QUERIES
from lexispark.session import BYTES_KEY, ROWS_KEY, batches_of
from tests.test_engine import column

SMALL = "/root/testdata/sf0.001"


def python_nodes(df):
    return str(df._jdf.queryExecution().executedPlan()).count("ArrowEvalPython [")


def test_references_without_their_semicolon(spark):
    page = "<title>a &amp;&amp</title><p>x &lt; y &nbsp; &lt z &notit; &#39; &#39 AT&T</p>"
    rows = spark.createDataFrame([(page,), (None,)], "html string")
    whole = "a &&amp\nx < y \xa0 &lt z &notit; ' &#39 AT&T"
    assert [r.t for r in rows.select(D.html_text_of_whole_references("html").alias("t")).collect()] == [whole, None]
    assert D.plain_html(page).startswith("a &&\nx < y \xa0 < z")


def test_noise_lines_as_a_set_are_what_the_patterns_match():
    assert all(any(re.search(p, k) for p in D.NOISE_LINES) for k in D.NOISE_KEYS)
    assert {"cookies", "accept cookie", "terms and conditions", "terms"} <= set(D.NOISE_KEYS) and len(D.NOISE_KEYS) == len(D.NOISE_LINES) + 4


def test_fifteen_words_are_enough(spark):
    filler = " ... " * 30
    rows = ["ab " * 14 + filler, "ab " * 15 + filler, "a b " * 40, "x\nab-" * 15 + filler, "абв_9 " * 14 + "z" + filler]
    assert column(spark, rows, lambda v: v.rlike(T.ENOUGH_WORDS)) == [len(re.findall(T.WORD, r)) >= T.MIN_WORDS for r in rows] == [False, True, False, True, False]


def test_chunks_are_cleaned_once_even_where_reasons_are_filtered(spark):
    # One node cleans documents and one cuts them; each copy of the cleaning in a filter would add one.
    plans = {q: QUERIES[q](spark, SMALL) for q in ("str7_chunk_reasons", "pip2_planned_chunks")}
    assert {q: python_nodes(p) for q, p in plans.items()} == {"str7_chunk_reasons": 2, "pip2_planned_chunks": 2}


@pytest.mark.parametrize("name", ["str7_chunk_reasons", "pip2_planned_chunks", "pip2_vectorized", "str10_chunks", "flt17_file_types"])
def test_python_is_handed_few_texts_at_once(spark, name):
    before = spark.conf.get(ROWS_KEY)
    spark.conf.set(ROWS_KEY, "10000")
    try:
        QUERIES[name](spark, SMALL)
        assert int(spark.conf.get(ROWS_KEY)) <= 250
    finally:
        spark.conf.set(ROWS_KEY, before)


def test_python_is_handed_few_bytes_at_once(spark):
    @F.pandas_udf("int")
    def handed(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    docs = spark.range(0, 100, 1, 1).selectExpr("0L AS source_id", "id AS document_id", "'web' AS source_type", "'text' AS document_type", "repeat('x', 1 << 18) AS text")
    before = spark.conf.get(BYTES_KEY, None)
    spark.conf.unset(BYTES_KEY)
    try:
        pipelines.judged_chunks(docs)
        assert docs.select(F.max(handed("text"))).first()[0] <= 17
        spark.conf.set(BYTES_KEY, "1m")
        pipelines.judged_chunks(docs)
        assert spark.conf.get(BYTES_KEY) == "1m"
    finally:
        spark.conf.unset(BYTES_KEY) if before is None else spark.conf.set(BYTES_KEY, before)


def test_an_empty_store_needs_no_python(spark, tmp_path):
    rows = vectorize.chunk_store(spark, str(tmp_path / "store"), 2).rows()
    assert "ExistingRDD" not in str(rows._jdf.queryExecution().executedPlan()) and rows.count() == 0
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in vectorize.chunk_store(spark, str(tmp_path / "store"), 2).schema]


def test_blocks_are_full_whatever_the_batches(spark):
    of = [0] * 7 + [1] * 3 + [2] * 5
    rows = pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([0] * 15, pa.int32()), pa.array(range(15))], ["list", "part", "id"])
    for size in (1, 2, 4, 15):
        got = [b.column(2).to_pylist() for b in vector_index.stretches((rows.slice(k, size) for k in range(0, 15, size)), 4)]
        assert got == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12, 13], [14]]
    with batches_of(spark, 7):
        assert spark.conf.get(ROWS_KEY) == "7"
    assert spark.conf.get(ROWS_KEY) != "7"


def test_open_lists_are_given_out_in_bounded_batches():
    n, lists = 1000, 50
    x = np.random.default_rng(1).normal(size=(lists, 4))
    sent = SimpleNamespace(value=vector_index.Lists(x, np.ones(lists), np.ones(lists, np.int64), False))
    asked = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([np.ones(4).tobytes()] * n, pa.binary()), pa.array([-np.inf] * n)], ["query_id", "vector", "least"])
    got = list(vector_index._open_lists(sent, 0, lists)([asked]))
    assert sum(b.num_rows for b in got) == n * lists and max(b.num_rows for b in got) <= vector_index.OPEN_PAIRS
    assert len({(q, k) for b in got for q, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}) == n * lists


def test_postings_hold_a_gram_once_a_group_of_texts(spark, tmp_path, monkeypatch):
    texts = ["abcabc", "ab", None, "xabc\U0001f600y", "cabc" * 5, "éabé", ""]
    want = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 2):
            want.setdefault(t[k : k + 3], {}).setdefault(i, []).append(k)
    for chars in (1, 12, 1 << 20):
        monkeypatch.setattr(keyword_index, "GROUP_CHARS", chars)
        rows = [r for g in keyword_index.groups(list(range(len(texts))), texts) for r in keyword_index.lists_of(*g).to_pylist()]
        got = {}
        for r in rows:
            for i, p in zip(r["ids"], r["places"], strict=True):
                assert got.setdefault(r["gram"], {}).setdefault(i, p) is p
        assert got == want and (chars > 12) == (len(rows) == len(want))
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "index"), 4)
    index.build(spark.createDataFrame([(i, "the same text") for i in range(100)], "id long, text string").coalesce(1))
    assert spark.read.parquet(f"{index.path}/grams").count() == 11 and index.ids("same t").count() == 100


def test_the_keyword_index_takes_less_room_than_its_texts(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "index"), 16)
    index.build(rows)
    size = {part: sum(f.stat().st_size for f in (tmp_path / "index" / part).rglob("*.parquet")) for part in ("grams", "rows")}
    assert 0 < size["grams"] < size["rows"]
    for term in ("The ", "contact", "ände", "zzzqqq"):
        want = {r.id for r in rows.filter(F.contains(F.lower("text"), F.lit(term.lower()))).collect()}
        assert {r.id for r in index.containing(term, rows.schema).collect()} == want, term


def test_texts_that_have_the_grams_apart_are_no_hits(spark, tmp_path):
    texts = ["xabc bcdx", "xABCDx", "bcd", None, "abcabc", "zzz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartitionByRange(6, "id")
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "index"), 4)
    index.build(rows)
    assert sorted(r.id for r in index.ids("abcd").collect()) == [0, 1]
    found = index.containing("abCd", rows.schema)
    assert [tuple(r) for r in found.collect()] == [(1, "xABCDx")]
    # Of the texts' files those are opened in which one has all grams; one text each, here.
    assert len(found.inputFiles()) == 2
