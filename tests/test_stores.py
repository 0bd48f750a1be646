"""Stores that are changed in place, leases, runs that break off, streams with state, numbering, and the vector index."""

import json
import random
import threading
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import lease, pipelines, registry, retrieval, store, vectorize
from lexispark.operators.numbering import numbered
from lexispark.operators.vector_index import VectorIndex
from lexispark.storage import Folder
from lexispark.streaming import entries, resync

ROW = "k long, v string"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).glob("data/*/bucket=*/*.parquet")}


def rows(kept):
    return sorted(map(tuple, kept.rows().collect()))


def put(kept, writer, n, values, **more):
    new = kept.spark.createDataFrame(values, ROW)
    return kept.commit(writer, n, new, store.replace_keys(new, new, "k"), **more)


def test_commits_rewrite_the_buckets_that_they_touch(spark, tmp_path):
    kept = store.BucketStore(spark, str(tmp_path), ROW, ("k",), 8)
    assert rows(kept) == [] and put(kept, "w", 0, [(i, "a") for i in range(40)])
    before = files(tmp_path)
    assert put(kept, "w", 1, [(3, "b")])
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert rows(kept) == sorted((i, "b" if i == 3 else "a") for i in range(40))
    # Seven of the eight buckets are read from the files of the first commit.
    assert sum(f.startswith("000000000000") for f in kept.head()["buckets"].values()) == 7
    # A replayed number changes nothing, whatever it brings; another writer counts for itself.
    assert not put(kept, "w", 1, [(4, "c")]) and files(tmp_path) == after and put(kept, "other", 0, [(4, "d")])
    assert dict(rows(kept))[4] == "d"
    with pytest.raises(ValueError):
        kept.commit("w", 2, spark.createDataFrame([(0, "")], ROW), lambda old: spark.createDataFrame([(i, "") for i in range(40)], ROW))
    # Emptied buckets are gone; what no late reader needs goes too.
    everything = spark.createDataFrame([(i, "") for i in range(40)], ROW)
    assert kept.commit("w", 2, everything, lambda old: old.filter("k = 7")) and rows(kept) == [(7, "a")]
    assert kept.vacuum(1) == 3 and rows(kept) == [(7, "a")] and len(files(tmp_path)) == 1
    with pytest.raises(ValueError):
        store.BucketStore(spark, str(tmp_path), ROW, ("k",), 4)


def test_of_commits_at_once_none_is_lost(spark, tmp_path):
    kept = store.BucketStore(spark, str(tmp_path), ROW, ("k",), 2)

    def write(writer):
        for n in range(3):
            put(kept, writer, n, [(10 * n + ord(writer), writer)])

    threads = [threading.Thread(target=write, args=(w,)) for w in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(rows(kept)) == 9 and kept.head()["number"] == 8 and kept.head()["writers"] == {"a": 2, "b": 2, "c": 2}


def test_a_commit_that_breaks_off_leaves_the_former_state(spark, tmp_path):
    kept = store.BucketStore(spark, str(tmp_path), ROW, ("k",), 2)
    put(kept, "w", 0, [(1, "a")])
    bad = F.udf(lambda v: 1 // 0, "string")
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        kept.commit("w", 1, spark.createDataFrame([(1, "")], ROW), lambda old: old.withColumn("v", bad("v")))
    assert rows(kept) == [(1, "a")] and put(kept, "w", 1, [(1, "b")]) and rows(kept) == [(1, "b")]


def test_leases(spark, tmp_path):
    folder, clock = Folder(spark, str(tmp_path)), [100.0]
    now = lambda: clock[0]
    first = lease.acquire(folder, "s1", "x", 10, now)
    assert first.number == 1 and first.held() and lease.acquire(folder, "s1", "y", 10, now) is None
    assert lease.acquire(folder, "s2", "y", 10, now).number == 1
    clock[0] = 111.0
    second = lease.acquire(folder, "s1", "y", 10, now)
    assert second.number == 2 and not first.held() and second.held()
    # A lost holder's late write is refused, and nothing of it stays.
    kept = store.BucketStore(spark, f"{tmp_path}/store", ROW, ("k",), 2)
    assert put(kept, "y", 0, [(1, "new")], lease=second)
    with pytest.raises(store.LostLease):
        put(kept, "x", 0, [(1, "late")], lease=first)
    assert rows(kept) == [(1, "new")] and len(files(f"{tmp_path}/store")) == 1
    second.release()
    assert lease.acquire(folder, "s1", "z", 10, now).number == 3


def test_two_runs_at_once_are_one_run_and_one_busy(spark, tmp_path):
    folder, inside, results = Folder(spark, str(tmp_path)), threading.Barrier(2), []

    def work(_):
        inside.wait(30)  # the other one has been told
        return 5

    def tell(out):
        results.append(out)
        if out["status"] == "busy":
            inside.wait(30)

    threads = [threading.Thread(target=lambda h=h: tell(lease.exclusive(folder, "source-1", h, work))) for h in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["status"] for r in results) == ["busy", "indexed"]

    def broken(_):
        raise ValueError("cannot be read")

    assert lease.exclusive(folder, "source-1", "c", broken) == {"status": "failed", "error": "cannot be read", "result": None}
    assert lease.exclusive(folder, "source-1", "d", lambda held: held.number)["result"] == 3


class Killed(BaseException):
    pass


def test_a_vectorisation_that_breaks_off_takes_up_where_it_stopped(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "source", "document", "plain", "reading", "text", "chunk"]
    texts = [(i % 3, i, True, "file", "text", ". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(rng.randrange(3, 40)))) for i in range(30)]
    docs = spark.createDataFrame(texts, "source_id long, document_id long, is_active boolean, source_type string, document_type string, text string")
    embed = lambda c: F.array(F.length(c).cast("double"))
    chars = sum(len(t[5]) for t in texts)
    got = {}
    for name in ("whole", "broken"):
        kept = vectorize.chunk_store(spark, str(tmp_path / name), 8)
        if name == "broken":

            def stop(batch):
                if batch == 2:
                    raise Killed

            with pytest.raises(Killed):
                vectorize.vectorize(kept, docs, "run", embed, batch_chars=chars // 4, before=stop)
            assert kept.applied("run") == 1 and 0 < kept.rows().select("document_id").distinct().count() < 30
            began = files(tmp_path / name)
            kept = vectorize.chunk_store(spark, str(tmp_path / name), 8)  # as a new process would
            told = vectorize.vectorize(kept, docs, "run", embed, batch_chars=chars // 4)
            assert (told["done"], told["batches"], told["rebuilt"]) == (told["batches"] - 2, told["batches"], 30)
            assert began.items() <= files(tmp_path / name).items()
        else:
            vectorize.vectorize(kept, docs, "run", embed, batch_chars=chars // 4)
        got[name] = sorted((r.document_id, r.chunk_index, r.chunk_count, r.content_hash, r.point_id, r.embedding[0]) for r in kept.rows().collect())
    plain = pipelines.planned_chunks(pipelines.judged_chunks(docs)).collect()
    assert got["whole"] == got["broken"] and [g[:5] for g in got["whole"]] == sorted((r.document_id, r.chunk_index, r.document_chunk_count, r.content_hash, r.point_id) for r in plain)
    # Nothing is done twice; changed, inactive and lost documents are.
    assert vectorize.vectorize(kept, docs, "run", embed)["done"] == 0
    changed = docs.filter("document_id <> 4").withColumn("is_active", F.col("document_id") != 5).withColumn("text", F.when(F.col("document_id") == 6, F.concat("text", F.lit(" One more closing sentence."))).otherwise(F.col("text")))
    told = vectorize.vectorize(kept, changed, "next", embed)
    assert (told["rebuilt"], told["purged"], told["skipped"]) == (1, 2, 27)
    left = {r.document_id: r.text_hash for r in kept.rows().collect()}
    assert set(left) == set(range(30)) - {4, 5} and left[6] != vectorize_hash(texts[6][5])


def vectorize_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_resync_replays_nothing(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    kept = resync.document_store(spark, str(tmp_path / "store"), 16)
    for n in range(3):
        (drop / f"{n}.json").write_text("\n".join(json.dumps({"source_id": 1, "external_id": f"e{i}", "content_hash": f"h{i * n}", "seq": n}) for i in range(n, n + 3)))
        resync.start(kept, str(drop), str(tmp_path / "marks")).awaitTermination(60)
    state = rows(kept)
    assert [(r[1], r[3]) for r in state] == [("e0", 1), ("e1", 2), ("e2", 3), ("e3", 2), ("e4", 1)]
    before = files(tmp_path / "store")
    # A lost checkpoint makes the stream begin anew: all its batches are there already.
    resync.start(kept, str(drop), str(tmp_path / "other")).awaitTermination(60)
    assert rows(kept) == state and files(tmp_path / "store") == before


def test_entries_as_a_stream(spark, tmp_path):
    rng, drop, start = random.Random(6), tmp_path / "drop", datetime(2024, 1, 1)
    drop.mkdir()
    sent, kept = [], store.BucketStore(spark, str(tmp_path / "store"), entries.ENTRY, ("logger",), 2)
    stream = spark.readStream.schema(entries.ENTRY).json(str(drop))
    for n in range(4):
        batch = [(rng.choice("ab"), 100 * n + i, start + timedelta(minutes=30 * n + i // 3), f"m{i}") for i in range(60)]
        batch += rng.sample(sent, min(len(sent), 10))  # repeated rows
        batch += [("a", 9000 + n, start - timedelta(hours=5), "late")] if n > 1 else []
        (drop / f"{n}.json").write_text("\n".join(json.dumps({"logger": x, "entry_id": i, "ts": t.isoformat(), "message": m}) for x, i, t, m in batch))
        sent += [b for b in batch if b[3] != "late"]
        entries.start(stream, kept, str(tmp_path / "marks"), keep=25).awaitTermination(120)
    table = spark.createDataFrame(sent, entries.ENTRY)
    want = sorted(map(tuple, entries.last_entries(table, 25).collect()))
    assert rows(kept) == want and len(want) == 50
    # Windows come once the watermark has passed them; repeated and late rows count nowhere.
    counted = entries.windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "counts")).option("checkpointLocation", str(tmp_path / "marks2")).outputMode("append")
    counted.trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "counts")).select("start", "kind", "n").collect()}
    batch = {tuple(r) for r in entries.windowed_counts(table).collect()}
    late = {r for r in got if r[0] < start}
    assert got - late and got - late <= batch


def test_points_in_buckets_are_not_shuffled(spark, tmp_path):
    registry.ensure_points_table(spark, "points_test", 4, str(tmp_path / "points"))
    rows = spark.range(200).selectExpr("concat('p', id) AS point_id", "id % 3 AS source_id", "id % 20 AS document_id", "id AS chunk_id", "array(cast(1 AS float)) AS embedding")
    points = registry.insert_points(rows, "points_test")
    registry.insert_points(rows.filter("document_id = 1").withColumn("point_id", F.concat("point_id", F.lit("x"))), "points_test")
    docs = spark.range(25).selectExpr("id", "id % 3 AS source_id")
    gone = spark.range(5).selectExpr("id AS document_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = registry.delete_points(points, gone, "document_id")
        found = registry.points_by_document(left, docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.document_id, r.n_points) for r in found.collect()} == {(i, 10 if 5 <= i < 20 else 0) for i in range(25)}
    # From the scan of points upwards no exchange until the join with what is small.
    above = plan.split("FileScan parquet spark_catalog.default.points_test")[0].splitlines()
    depth = len(above[-1]) - len(above[-1].lstrip(" :+-"))
    chain = []
    for line in reversed(above[:-1]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            chain.append(line.strip(" :+-"))
            depth = d
    assert any("SortMergeJoin" in x for x in chain) and not any("Exchange" in x for x in chain), chain
    spark.sql("DROP TABLE points_test")


def test_numbers_follow_the_order(spark):
    values = random.Random(7).sample(range(10_000), 700)
    got = numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(5), "v").collect()
    assert sorted((r.number, r.v) for r in got) == list(enumerate(sorted(values)))


def test_files_are_parsed_once(spark):
    rows = [(1, str(i), f"f{i}.txt", ".txt", "text/plain", bytearray(b"some words"), None) for i in range(3)]
    grabbed = spark.createDataFrame(rows, "source_id long, external_id string, name string, extension string, mime_type string, content binary, metadata map<string,string>")
    existing = spark.createDataFrame([], "source_id long, external_id string, content_hash string, version int, is_active boolean, title string, metadata map<string,string>")
    found = pipelines.ingest(existing, pipelines.parse_files(grabbed))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert [r.outcome for r in found.collect()] == ["created"] * 3


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, 16))
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("unit", [True, False])
def test_index_is_exact_and_visits_few_lists(spark, unit):
    x = clustered(6000, 8)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = VectorIndex(points, unit, lists=40)
    found, met = index.search(points.filter("vec_id % 60 = 0"), 5, own=False)
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    for q in range(0, 6000, 60):
        scores = np.round(y @ y[q], 6)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(6000), -scores))[:5]
        got = sorted((r for r in found.filter(F.col("query_id") == q).collect()), key=lambda r: (-r.score, r.vec_id)) if q < 300 else None
        if got is not None:
            assert [r.vec_id for r in got] == want.tolist() and np.allclose([r.score for r in got], scores[want], atol=1e-6)
    assert met.count() == 100
    share = met.agg(F.sum("n_vectors")).first()[0] / (100 * 6000)
    assert share < (0.25 if unit else 0.9), share


def test_index_takes_what_is_no_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.1]), (6, [2.0, 0.2]), (7, [1.0, 0.0, 3.0])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.top_n_each(points, points, 3)
    found = {(r.query_id, r.rank): r.vec_id for r in got.collect()}
    assert {q for q, _ in found} == {1, 6, 7} and found[1, 1] == 1 and found[7, 1] == 7
    assert retrieval.top_n_each(points.limit(0), points, 3).collect() == [] and retrieval.top_n_each(points, points.limit(0), 3).collect() == []
