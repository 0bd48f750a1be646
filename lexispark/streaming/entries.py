"""Log entries as a stream: counts by event time, and the last entries of every logger as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lexispark.operators.store import BucketStore
from lexispark.storage import settled

KEEP = 500
LATE = "10 minutes"
ENTRY = "logger string, entry_id long, ts timestamp, message string"
_STATE = "ids array<long>, times array<long>, messages array<string>"


def windowed_counts(entries: DataFrame, width: str = "1 hour", late: str = LATE, kind: Column | str = "logger") -> DataFrame:
    """start, kind, n: entries of ``entries`` (a stream, or a table) in windows of event time, each id once. A stream
    gives a window when the watermark has passed its end; entries later than ``late`` are dropped."""
    once = entries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["entry_id"]) if entries.isStreaming else entries.dropDuplicates(["entry_id"])
    counted = once.groupBy(F.window("ts", width).alias("w"), (F.col(kind) if isinstance(kind, str) else kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def last_entries(entries: DataFrame, keep: int = KEEP, late: str = LATE) -> DataFrame:
    """The last ``keep`` entries of each logger by (ts, entry_id), each id once.

    Of a table: a window. Of a stream: keyed state that holds at most ``keep`` entries of a logger; a micro-batch gives
    the whole list of each logger that it changed. Entries behind the watermark are
    dropped, as they are in windowed counts.
    """
    if not entries.isStreaming:
        once = entries.select("logger", "entry_id", "ts", "message").dropDuplicates(["logger", "entry_id"])
        newest = Window.partitionBy("logger").orderBy(F.desc("ts"), F.desc("entry_id"))
        return once.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(("entry_id", "us", "message"), state.get if state.exists else ([], [], []), strict=True)))
        mark = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            new = pd.DataFrame({"entry_id": frame["entry_id"], "us": frame["us"], "message": frame["message"]})
            new = new[new["us"] > mark] if mark > 0 else new
            both = pd.concat([held, new]) if len(held) else new
            # Only the newest are held between the Arrow batches of a logger.
            held = both.drop_duplicates("entry_id").sort_values(["us", "entry_id"], ascending=False).head(keep)
        state.update((held["entry_id"].astype("int64").tolist(), held["us"].astype("int64").tolist(), held["message"].tolist()))
        yield held.assign(logger=key[0])[["logger", "entry_id", "us", "message"]]

    timed = entries.withWatermark("ts", late).select("logger", "entry_id", "ts", F.unix_micros("ts").alias("us"), "message")
    found = timed.groupBy("logger").applyInPandasWithState(update, "logger string, entry_id long, us long, message string", _STATE, "update", GroupStateTimeout.NoTimeout)
    return found.select("logger", "entry_id", F.timestamp_micros("us").alias("ts"), "message")


def start(entries: DataFrame, store: BucketStore, checkpoint: str, keep: int = KEEP, late: str = LATE, name: str = "entries") -> StreamingQuery:
    """Keeps the last entries of each logger of a stream in a store keyed by logger: a micro-batch replaces the rows of the
    loggers that it changed, once, whatever is replayed."""

    def upsert(batch: DataFrame, n: int) -> None:
        batch = settled(batch, "entries")  # the keyed state is updated once
        store.commit(name, n, batch, lambda old: old.join(batch.select("logger").distinct(), "logger", "left_anti").unionByName(batch.select(store.schema.names)))

    found = last_entries(entries, keep, late)
    return found.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
