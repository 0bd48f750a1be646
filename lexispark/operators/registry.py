"""The tables of sources, documents, chunks, points and runs: registration, look-ups, removal, status, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions import urls

RUN = "run_id string, source_id long, status string, created int, updated int, skipped int, failed int, error string"


def stable_id(*key: Column) -> Column:
    """A positive long from the natural key of a row: the same row has the same id in every run and on every executor."""
    joined = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key])
    return F.conv(F.substring(F.sha2(joined.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def with_ids(rows: DataFrame, *key: str) -> DataFrame:
    """Rows as they are inserted: with an ``id`` from their natural key."""
    return rows.withColumn("id", stable_id(*[F.col(k) for k in key]))


def identity(source_type: Column, uri: Column, file_hash: Column) -> Column:
    """What makes a source the same: the hash of a file's bytes, else the normalised URL."""
    return F.when(source_type == "file", file_hash).otherwise(urls.normalize_source_url(uri))


def register(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming(position, source_type, uri, file_hash, name)`` with key, outcome and id: ``added``, ``duplicate`` (of a
    source there is, or of an earlier row) or ``invalid`` (no key). ``sources(id, key)`` are those there are."""
    keyed = incoming.withColumn("key", identity(F.col("source_type"), F.col("uri"), F.col("file_hash")))
    first = Window.partitionBy("key").orderBy("position")
    known = sources.select("key", F.col("id").alias("_known"))
    keyed = keyed.join(known, "key", "left").withColumn("_rn", F.row_number().over(first))
    outcome = F.when(F.col("key").isNull(), "invalid").when(F.col("_known").isNotNull() | (F.col("_rn") > 1), "duplicate").otherwise("added")
    new = F.when(F.col("key").isNotNull(), stable_id(F.col("key")))
    return keyed.withColumn("outcome", outcome).withColumn("id", F.coalesce("_known", new)).drop("_known", "_rn")


#: What a source forgets when its place changes.
FORGOTTEN = ("error", "last_synced_at", "etag", "last_modified", "git_branch", "git_commit_sha")


def edit(sources: DataFrame, documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes of registered sources: outcomes of ``requests(position, kind, source_id, uri, file_hash, name)``, and sources and
    documents after them.

    ``kind`` is ``url`` (another URL), ``file`` (another file) or ``rename``. Outcomes: ``not_found``; ``invalid`` (a file
    that is to become a URL or the other way round, an empty new name, no key, an unknown kind); ``duplicate`` (another
    source has the key, or an earlier request of the same call takes it); ``superseded`` (a later request of the same call
    for this source counts); else ``updated``. A changed place makes a source pending, without error, sync time and facts
    of the grab, and its documents inactive; without a name it takes the one of its URL or file. A new name changes
    nothing else. ``sources(id, key, source_type, uri, name, status, *FORGOTTEN)``; ``name`` of a file request is its file's.
    """
    known = sources.select(F.col("id").alias("source_id"), F.col("source_type").alias("_type"))
    asked = requests.join(known, "source_id", "left")
    place = F.col("kind").isin("url", "file")
    kind = F.when(F.col("kind") == "file", "file").otherwise(urls.source_type(urls.normalize_source_url(F.col("uri"))))
    key = F.when(F.col("kind") == "url", urls.normalize_source_url(F.col("uri"))).when(F.col("kind") == "file", F.col("file_hash"))
    asked = asked.withColumn("key", key).withColumn("_new_type", F.when(place, kind))
    owners = sources.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    asked = asked.join(owners, "key", "left")
    wrong = F.when(place, ((F.col("_type") == "file") != (F.col("kind") == "file")) | F.col("key").isNull()).otherwise((F.col("kind") != "rename") | (F.trim(F.coalesce("name", F.lit(""))) == ""))
    taken = place & (F.col("_first").isNotNull() & ((F.col("_first") != F.col("source_id")) | (F.col("_last") != F.col("source_id"))))
    asked = asked.withColumn("outcome", F.when(F.col("_type").isNull(), "not_found").when(wrong, "invalid").when(taken, "duplicate").otherwise("updated"))
    # Of the requests that are left the first for a key counts, and of those the last for a source and kind of change.
    good = F.col("outcome") == "updated"
    first = F.min(F.when(good & place, F.struct("position", "source_id"))).over(Window.partitionBy("key"))
    asked = asked.withColumn("_one", first["source_id"])
    asked = asked.withColumn("outcome", F.when(good & place & (F.col("_one") != F.col("source_id")), "duplicate").otherwise(F.col("outcome")))
    change = F.when(F.col("kind") == "rename", "name").otherwise("place")
    latest = F.max(F.when(F.col("outcome") == "updated", F.col("position"))).over(Window.partitionBy("source_id", change))
    asked = asked.withColumn("_latest", latest)
    asked = asked.withColumn("outcome", F.when((F.col("outcome") == "updated") & (F.col("_latest") != F.col("position")), "superseded").otherwise(F.col("outcome")))
    done = asked.filter("outcome = 'updated'")
    named = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.when(F.col("kind") == "url", urls.display_name(F.col("key"))))
    moved = done.filter(place).select(F.col("source_id").alias("id"), F.struct(F.col("key"), F.col("_new_type").alias("type"), named.alias("name"), F.col("position"), F.col("kind")).alias("_moved"))
    renamed = done.filter("kind = 'rename'").select(F.col("source_id").alias("id"), F.struct(F.trim("name").alias("name"), F.col("position")).alias("_renamed"))
    new = sources.join(moved, "id", "left").join(renamed, "id", "left")
    gone = F.col("_moved").isNotNull()
    later = F.col("_renamed").isNotNull() & (~gone | (F.col("_renamed.position") > F.col("_moved.position")))
    values = {
        "key": F.when(gone, F.col("_moved.key")).otherwise(F.col("key")), "source_type": F.when(gone, F.col("_moved.type")).otherwise(F.col("source_type")),
        "uri": F.when(gone & (F.col("_moved.kind") == "url"), F.col("_moved.key")).otherwise(F.col("uri")),
        "name": F.when(later, F.col("_renamed.name")).when(gone, F.col("_moved.name")).otherwise(F.col("name")),
        "status": F.when(gone, "pending").otherwise(F.col("status")), **{c: F.when(~gone, F.col(c)) for c in FORGOTTEN},
    }
    after = deactivate(documents, done.filter(place).select("source_id"))
    return asked.select("position", "source_id", "outcome"), new.withColumns(values).drop("_moved", "_renamed"), after


def same_key(sources: DataFrame, key: str, other_than: int | None = None) -> DataFrame:
    """Sources with a key, one of them left out if wanted."""
    found = sources.filter(F.col("key") == key)
    return found if other_than is None else found.filter(F.col("id") != other_than)


def twins(sources: DataFrame) -> DataFrame:
    """id, twin for the rows of ``sources(id, key)`` whose key another row has too: the smallest such id. Two partial
    minima instead of a gathered or sorted group, so that a key that many rows have is no one task's."""
    keyed = sources.filter(F.col("key").isNotNull())
    first = keyed.groupBy("key").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = keyed.join(first, "key")
    second = found.filter(F.col("id") != F.col("_first")).groupBy("key").agg(F.min("id").alias("_second"))
    return found.join(second, "key").select("id", F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("twin"))


def deactivate(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """All documents, those of ``sources(source_id)`` inactive."""
    gone = sources.select("source_id").distinct().withColumn("_gone", F.lit(True))
    joined = documents.join(gone, "source_id", "left")
    return joined.withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def delete_sources(gone: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of sources, documents and chunks without the sources of ``gone(source_id)``. Points are not touched:
    those of removed chunks are orphans from then on."""
    ids = gone.select("source_id").distinct()
    removed = documents.join(ids, "source_id", "left_semi").select(F.col("id").alias("document_id"))
    return (
        sources.join(ids, F.col("id") == F.col("source_id"), "left_anti"),
        documents.join(ids, "source_id", "left_anti"),
        chunks.join(removed, "document_id", "left_anti"),
    )


def delete_points(points: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """Points without those whose ``by`` (point_id, source_id or document_id) is in ``gone``; none if it is empty."""
    if by not in ("point_id", "source_id", "document_id"):
        raise ValueError(f"points are not removed by {by}")
    return points.join(gone.select(by).distinct(), by, "left_anti")


def without_failed(failed: DataFrame, points: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and chunks after a rebuild that failed for ``failed(document_id)``: what it has written of them goes."""
    return delete_points(points, failed, "document_id"), chunks.join(failed.select("document_id").distinct(), "document_id", "left_anti")


def with_source_name(rows: DataFrame, sources: DataFrame, default: str = "Unknown") -> DataFrame:
    """``rows`` with source_name, by source_id from ``sources(id, name)``."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return rows.join(names, "source_id", "left").withColumn("source_name", F.coalesce("source_name", F.lit(default)))


def with_grabbed_facts(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources after a grab of ``documents(source_id, position, metadata)``: git sources take branch and commit_sha of their
    first document, web sources etag and last_modified of the first that is_root; keys that are missing become null, and
    sources without such a document stay as they are."""
    value = lambda *keys: F.struct(*[F.col("metadata")[k].alias(k) for k in keys])
    root = F.when(F.lower(F.col("metadata")["is_root"]) == "true", F.col("position"))
    found = documents.groupBy(F.col("source_id").alias("id")).agg(
        F.min_by(value("branch", "commit_sha"), F.col("position")).alias("_first"), F.min_by(value("etag", "last_modified"), root).alias("_root")
    )
    out = sources.join(found, "id", "left")
    for kind, of, columns in (("git", "_first", {"git_branch": "branch", "git_commit_sha": "commit_sha"}), ("web", "_root", {"etag": "etag", "last_modified": "last_modified"})):
        taken = (F.col("source_type") == kind) & F.col(of).isNotNull()
        for column, key in columns.items():
            out = out.withColumn(column, F.when(taken, F.col(of)[key]).otherwise(F.col(column)))
    return out.drop("_first", "_root")


POINTS = "point_id STRING, source_id BIGINT, document_id BIGINT, chunk_id BIGINT, embedding ARRAY<FLOAT>"


def ensure_points_table(spark: SparkSession, name: str, buckets: int = 64, path: str | None = None) -> None:
    """The table of points, bucketed and sorted by document, so that joins, groups and removals by document need no shuffle
    of points; there already: kept."""
    at = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({POINTS}) USING parquet CLUSTERED BY (document_id) SORTED BY (document_id) INTO {int(buckets)} BUCKETS{at}")


def insert_points(points: DataFrame, name: str) -> DataFrame:
    """Appends to the table, with one file a bucket and insert; returns the whole table."""
    spark = points.sparkSession
    columns = spark.table(name).columns
    buckets = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()["data_type"]
    points.select(columns).repartition(int(buckets), "document_id").write.insertInto(name)
    return spark.table(name)


def points_by_document(points: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, source_id and the number of its points for each of ``documents(id, source_id)``; points are grouped where
    they lie, and one row for each document that has any is joined."""
    n = points.groupBy("document_id").agg(F.count("*").alias("n_points"))
    joined = documents.join(n, documents["id"] == n["document_id"], "left")
    return joined.select(documents["id"].alias("document_id"), documents["source_id"], F.coalesce("n_points", F.lit(0)).alias("n_points"))


def with_status(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Sources after ``results(source_id, error)``: failed with its error, or indexed, without error and synced ``now``."""
    r = results.select(F.col("source_id").alias("id"), F.col("error").alias("_error"), F.lit(True).alias("_ran"))
    joined = sources.join(r, "id", "left")
    ran, failed = F.col("_ran").isNotNull(), F.col("_error").isNotNull()
    status = F.when(failed, "failed").when(ran, "indexed").otherwise(F.col("status"))
    error = F.when(ran, F.col("_error")).otherwise(F.col("error"))
    synced = F.when(ran & ~failed, now).otherwise(F.col("last_synced_at"))
    return joined.withColumn("status", status).withColumn("error", error).withColumn("last_synced_at", synced).drop("_ran", "_error")


def run_log(runs: DataFrame) -> DataFrame:
    """The last state of every run: of ``runs`` (RUN and ``seq``), appended when one starts and when it ends, the newest
    row of each."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return runs.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "seq")


def report(statuses: DataFrame) -> DataFrame:
    """Counts of an import: found, indexed, duplicates, failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(F.count("*").alias("found"), n("indexed").alias("indexed"), n("duplicate").alias("duplicates"), n("failed").alias("failed"))


def headline(found: Column, archived: Column, existing: Column) -> Column:
    """``5 discovered · 2 archived · 1 existing``; the last part only if there is any."""
    tail = F.when(existing > 0, F.format_string(" · %d existing", existing)).otherwise("")
    return F.concat(F.format_string("%d discovered · %d archived", found, archived), tail)


def throughput(progress: DataFrame) -> DataFrame:
    """``progress(run_id, done, total, seconds)`` with rows a second, batches of 32 in all, and seconds left."""
    speed = F.when(F.col("seconds") > 0, F.col("done") / F.col("seconds"))
    left = F.when(speed > 0, (F.col("total") - F.col("done")) / speed)
    return progress.withColumn("per_second", F.round(speed, 6)).withColumn("batches", F.ceil(F.col("total") / F.lit(32))).withColumn("seconds_left", F.round(left, 6))
