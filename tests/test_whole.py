"""The queries over whole tables, against DuckDB on the smallest tables and on what lies beyond the first rows."""

import pytest

import __spark_entry__ as entry
from lexispark.operators import retrieval

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = ("jn2_valid_chunks", "agg5_counts_by_source", "snk5_delete_chunks")
QUESTIONS = ("top1_vector_top_n", "top2_candidate_retrieval", "flt3_validity_counters", "fn9_ranking_metrics", "agg6_macro_average")


def by_sql(name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = db.sql(entry.oracle_sql()[name])
    return got.columns, sorted(got.fetchall(), key=repr)


@pytest.mark.parametrize("name", DOCUMENTS + QUESTIONS)
def test_whole_tables(spark, name):
    got = entry.queries()[name](spark, SMALL)
    columns, rows = by_sql(name)
    assert got.columns == columns and sorted((tuple(r) for r in got.collect()), key=repr) == rows


def test_documents_beyond_the_first_twelve(spark):
    assert entry.queries()["jn2_valid_chunks"](spark, SMALL).filter("document_id >= 12").count() > 0


def test_every_twentieth_vector_is_asked(spark):
    asked = spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert entry.queries()["fn9_ranking_metrics"](spark, SMALL).select("case_id").distinct().count() == asked > 10


def test_any_number_of_lists_gives_the_same(spark):
    points = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    one, many = (sorted(map(tuple, retrieval.top_n_each(points, points, 5, lists=n).collect())) for n in (1, 7))
    assert one == many and len(one) == 60 * 5
    assert all(q != v for q, _, v, _ in retrieval.top_n_each(points, points, 5, own=False).collect())
