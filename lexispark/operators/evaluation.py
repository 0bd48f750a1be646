"""Ranking metrics and their averages for whole question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_KS = (3, 5, 10, 20)


def first_occurrences(ranked: DataFrame) -> DataFrame:
    """``ranked(case_id, rank, document_id)`` with each document's first rank only, ranked anew."""
    one = ranked.groupBy("case_id", "document_id").agg(F.min("rank").alias("rank"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "document_id")))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """case_id, k, hit_rate, precision, recall, reciprocal_rank. Precision divides by the number of ranks there are up
    to k; ``relevant(case_id, document_id)``; cases without relevant documents are left out."""
    gold = relevant.distinct().withColumn("gold", F.lit(1))
    totals = gold.groupBy("case_id").agg(F.count("*").alias("n_relevant"))
    judged = first_occurrences(ranked).join(gold, ["case_id", "document_id"], "left")
    at_k = judged.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))]))).filter("rank <= k")
    sums = at_k.groupBy("case_id", "k").agg(F.count("*").alias("n"), F.count("gold").alias("found"), F.min(F.when(F.col("gold").isNotNull(), F.col("rank"))).alias("first"))
    every = totals.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))]))).join(sums, ["case_id", "k"], "left")
    found = F.coalesce(F.col("found"), F.lit(0))
    return every.select(
        "case_id", "k", (found > 0).cast("double").alias("hit_rate"), F.round(F.coalesce(found / F.col("n"), F.lit(0.0)), 6).alias("precision"),
        F.round(found / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def macro_average(metrics: DataFrame) -> DataFrame:
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return metrics.groupBy("k").agg(F.count("*").alias("case_count"), mean("hit_rate", "hit_rate"), mean("precision", "precision"), mean("recall", "recall"), mean("reciprocal_rank", "mrr"))


def summary(metrics: DataFrame, timings: DataFrame) -> DataFrame:
    """One row an evaluation: case_count, k_values, the averages of both pipelines by k as maps, and mean seconds.

    ``metrics`` as of ranking_metrics with a column ``pipeline`` (baseline, reranked); ``timings(case_id,
    retrieval_seconds, rerank_seconds)``. A k without values is in neither map.
    """
    mean = lambda c, name=None: F.round(F.avg(c), 6).alias(name or c)
    by_k = metrics.groupBy("pipeline", "k").agg(mean("hit_rate"), mean("precision"), mean("recall"), mean("reciprocal_rank", "mrr"))
    entry = F.struct("k", F.struct("hit_rate", "precision", "recall", "mrr").alias("v"))
    side = lambda p: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("pipeline") == p, entry)))).alias(p)
    maps = by_k.agg(F.array_sort(F.collect_set("k")).alias("k_values"), side("baseline"), side("reranked"))
    times = timings.agg(F.count("*").alias("case_count"), F.round(F.avg("retrieval_seconds"), 6).alias("average_retrieval_seconds"), F.round(F.avg("rerank_seconds"), 6).alias("average_rerank_seconds"))
    return maps.crossJoin(times)


def experiment_json(summaries: DataFrame, cases: DataFrame, created_at: str, session: str | None = None) -> DataFrame:
    """One row ``value``: the whole experiment as JSON, cases in order of their ids; for ``write.text``. A report of one
    evaluation: it holds as many cases as questions were asked by hand."""
    rows = F.array_sort(F.collect_list(F.struct(*cases.columns))).alias("cases")
    whole = F.struct(F.lit(created_at).alias("created_at"), F.lit(session).alias("session_id"), F.struct(*summaries.columns).alias("summary"), "cases")
    return summaries.crossJoin(cases.agg(rows)).select(F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def overlap(sets: DataFrame) -> DataFrame:
    """a, b, common, overlap in % of all documents of either, for the groups a < b of ``sets(query_id, source_id,
    document_id)`` that have a document in common."""
    once = sets.select("query_id", "source_id", "document_id").distinct()
    sized = once.join(once.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    x, y = (sized.select("source_id", "document_id", F.col("query_id").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    both = x.join(y, ["source_id", "document_id"]).filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return both.select("a", "b", "common", F.round(100.0 * F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("overlap"))


def shortlist(ranked: DataFrame, candidates: int = 30, shown: int = 15) -> DataFrame:
    """What is shown for labelling: of the first ``candidates`` rows of ``ranked(case_id, rank, document_id)`` the first
    ``shown`` documents, once each."""
    return first_occurrences(ranked.filter(F.col("rank") <= candidates).select("case_id", "rank", "document_id")).filter(F.col("rank") <= shown)


def pending_cases(cases: DataFrame) -> DataFrame:
    """Answerable cases that have no label yet; missing flags: answerable, not labelled."""
    return cases.filter(F.coalesce("answerable", F.lit(True)) & ~F.coalesce("labeled", F.lit(False)))


def selection(value: Column, shown: Column) -> Column:
    """struct<action, document_ids, error> of what was typed while labelling: '' none, s skip, u unanswerable, q quit,
    ``id:1,2`` ids, ``1,3`` numbers (from 1) among the documents ``shown``; ids once each, in order of the numbers."""
    v = F.lower(F.trim(value))
    typed = F.filter(F.transform(F.split(F.regexp_replace(v, "^id:", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(typed, lambda x: x.try_cast("long"))
    bad = F.exists(numbers, F.isnull)
    off = F.exists(numbers, lambda n: (n < 1) | (n > F.size(shown)))
    chosen = F.array_distinct(F.transform(numbers, lambda n: F.get(shown, (n - 1).cast("int"))))
    none = F.lit(None).cast("array<bigint>")
    row = lambda action, ids=none, error=None: F.struct(F.lit(action).alias("action"), ids.cast("array<bigint>").alias("document_ids"), F.lit(error).cast("string").alias("error"))
    out = F.when(F.coalesce(v, F.lit("")) == "", row(None))
    for letter, action in (("s", "skip"), ("u", "unanswerable"), ("q", "quit")):
        out = out.when(v == letter, row(action))
    by_id = v.startswith("id:")
    out = out.when((F.size(typed) == 0) & by_id, row("error", error="No document IDs were provided.")).when(F.size(typed) == 0, row("error", error="No documents selected."))
    out = out.when(bad, row("error", error="not a number")).when(by_id, row("ids", numbers))
    return out.when(off, row("error", error="out of range")).otherwise(row("ids", chosen))
