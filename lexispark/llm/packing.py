"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, planned over a histogram of lengths.

Documents are encoded once, each with an end id; what is longer than a sequence is cut into pieces of its capacity, of
which the last may be shorter. Only the pieces' lengths are counted: at most ``capacity`` counts come to the driver.
Best fit, from the longest length down, then works on counts: all sequences with the same room left are one group, and
pieces of one length go to the group with the least room that still takes them, as many to a sequence as fit (as best
fit would place them one by one). Each such step is a *slot*: pieces of that length with ranks from ``first`` to
``last`` go to sequences in a row, ``per`` to each. Slots are a few for each length whatever the number of documents.

Pieces then take their slots by a join on length and rank within length. Ranks come from windows over parts of a length
(a hash of the piece), so that no task ranks all pieces of a common length, and the counts of parts before.

Defined cases: null and empty texts are the end id alone; rows that repeat a doc_id are packed as documents of their
own; null doc_ids are kept; very long texts are encoded whole and then cut; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import Scratch, short_batches, trim
from lexispark.llm.tokens import gathered, word_encoder

CAPACITY = 2048
END_ID = 0
#: About so many pieces of one length are ranked together.
PART_PIECES = 1_000


class Slot(NamedTuple):
    length: int
    first: int
    last: int
    sequence: int
    per: int
    place: int


SLOTS = "length int, first long, last long, sequence long, per int, place int"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for so many pieces of each length. Groups of sequences are kept by the room left: (first sequence, count)."""
    room: dict[int, list[tuple[int, int]]] = {}
    slots: list[Slot] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = min((r for r in room if r >= length), default=0)
            if space:
                groups = room[space]
                start, count = groups.pop()
                if not groups:
                    del room[space]
                per = space // length
            else:
                space, per = capacity, capacity // length
                start, count = sequences, -(-left // per)
                sequences += count
            whole = min(count, left // per)
            if whole:
                slots.append(Slot(length, rank, rank + whole * per - 1, start, per, capacity - space))
                room.setdefault(space - per * length, []).append((start, whole))
                rank, left = rank + whole * per, left - whole * per
            if whole < count and left:
                # Fewer are left than one more sequence takes.
                slots.append(Slot(length, rank, rank + left - 1, start + whole, left, capacity - space))
                room.setdefault(space - left * length, []).append((start + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < count:
                room.setdefault(space, []).append((start + whole, count - whole))
    return slots


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of all pieces."""
    short_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in gathered(batches):
            of, nth, starts, parts = [], [], [], []
            for row, got in enumerate(encoder.encode(batch.column(1))):
                ids = np.append(got, end_id).astype("<u4")
                cuts = range(0, len(ids), capacity)
                of += [row] * len(cuts)
                nth += range(len(cuts))
                starts += cuts
                parts += [ids[c : c + capacity] for c in cuts]
            columns = [batch.column(0).take(pa.array(of, pa.int32())), pa.array(nth, pa.int32()), pa.array(starts, pa.int64()), pa.array(list(map(len, parts)), pa.int32()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def ranked(found: DataFrame, histogram: dict[int, int], part_pieces: int = PART_PIECES) -> DataFrame:
    """With ``rank``, from 0, of each piece among those of its length. Equal rows may change places, which changes nothing."""
    parts = found.sparkSession.createDataFrame([(k, -(-n // part_pieces)) for k, n in histogram.items()], "length int, parts int")
    key = ("doc_id", "piece", "start", "ids_crc32")
    cut = found.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts"))).drop("parts")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(*key))
    return cut.withColumn("within", within).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("within") - 1).drop("part", "within", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, part_pieces: int = PART_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids) of every piece. Sequence ids go from 0 to
    the number of sequences; offsets within a sequence have no gaps."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    found = scratch.keep(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), SLOTS)
    at = F.col("rank") - F.col("first")
    placed = ranked(found, histogram, part_pieces).alias("f").join(F.broadcast(slots).alias("s"), (F.col("f.length") == F.col("s.length")) & F.col("rank").between(F.col("first"), F.col("last")))
    return placed.select(
        "doc_id", "piece", "start", F.col("f.length").cast("long").alias("length"), "ids_crc32", (F.col("sequence") + F.floor(at / F.col("per"))).alias("sequence_id"),
        (F.col("place") + F.pmod(at, F.col("per")) * F.col("f.length")).cast("long").alias("offset"), *["ids"][: int(with_ids)],
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of the sequences of ``pack(..., with_ids=True)``; a group is at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_")).select("sequence_id", F.flatten("_.ids").alias("ids"), F.col("_.doc_id").alias("doc_ids"))
