"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of LENGTH bytes that occurs twice loses all its occurrences. The index does not hold every suffix: of the
starts of all SEED-byte strings within a window of LENGTH bytes, the one with the smallest hash is the window's anchor
(the leftmost of equals). Equal windows have their anchors at equal offsets, so only suffixes that start at anchors,
about one in 80 bytes, are indexed, and a window is looked up by its anchor.

Suffix arrays are ordered by a 64-bit fingerprint of the suffix's first SEED bytes instead of the bytes themselves:
equal prefixes are neighbours in either order, and that is all a merge-scan needs. An array lists each seed once, with
the place of one of its suffixes and their number; so a seed that very many documents share is one entry. Documents come
in batches. A new batch's array is merge-scanned against the array of every level there is: seeds that occur in both,
and seeds that occur twice in the batch, are the long-match candidates, and only what these scans find is compared any
further. Two levels of equal size are merged into the next one, as in a binary counter, so n batches leave at most
log2(n) + 1 levels, and each entry is rewritten at most log2(n) times.

Runs of consecutive windows with one anchor are compared as a whole first, among the runs with one seed, by a second,
unrelated 64-bit hash of the bytes that the run's windows cover. Equal ones are repeats in all their windows, whatever the
number of copies. Where one seed has several different surroundings, one text of each is read again, and its windows are
compared one by one, among those of the seed, by their fingerprints.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; strings are judged on the input; matches
never cross documents; rows that repeat a doc_id, or have none, are told apart by a 64-bit hash of their text besides (rows
without id by two); those with equal texts are copies of each other; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch, forget, mix64, release, short_batches, trim

LENGTH, SEED = 200, 40
BATCHES = 4
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Random values of the bytes, from a rule.
_BYTES = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))
#: Bits of a position within a piece; longer texts are cut into pieces that overlap by LENGTH - 1 bytes.
_POSITION_BITS = 20
_PIECE = 1 << _POSITION_BITS


class Hashes:
    """Fingerprints of all substrings of a text: prefix sums of byte values times powers, mod 2**64."""

    _powers = _inverse = np.empty(0, _U)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes._powers) < n:
            size = max(n, 1 << 16)
            Hashes._powers, Hashes._inverse = (np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (_BASE, pow(_BASE, -1, 2**64)))
        self.inverse = Hashes._inverse
        self.sums = np.zeros(n, _U)
        np.cumsum(_BYTES[data] * Hashes._powers[: n - 1], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, _U)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, whole, first, count, offset for each run of windows with one anchor: fingerprint of the anchor's seed, hash of
    the run's bytes seeded by the anchor's place, first window's start, number of windows, anchor minus first."""
    parts = []
    step = _PIECE - LENGTH - SEED
    for base in range(0, max(1, len(data) - LENGTH + 1), step):
        piece = data[base : base + step + LENGTH - 1]
        if len(piece) < LENGTH:
            continue
        prints = Hashes(piece)
        seeds = prints.all(SEED)
        packed = (seeds & ~_U(_PIECE - 1)) | np.arange(len(seeds), dtype=_U)
        anchor = (window_minima(packed, LENGTH - SEED + 1) & _U(_PIECE - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        offset = anchor[first] - first
        view = memoryview(np.ascontiguousarray(piece))
        ends = first + count - 1 + LENGTH
        whole = map(xxhash.xxh3_64_intdigest, map(view.__getitem__, map(slice, first.tolist(), ends.tolist())), (offset * LENGTH + count).tolist())
        parts.append((seeds[anchor[first]], np.fromiter(whole, _U, len(first)), first + base, count, offset))
    if not parts:
        return tuple(np.empty(0, _U if i < 2 else np.int64) for i in range(5))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key: ``doc``, its doc_id or a hash of the text where it has none, and ``tag``, another
    64-bit hash of the text. Rows with one key have one text and are copies of each other."""
    known = F.col("doc_id").cast("long")
    doc = F.coalesce(known, F.xxhash64(F.lit("no id"), "text")).alias("doc")
    return docs.select(known.alias("doc_id"), "text", doc, F.xxhash64(F.coalesce("text", F.lit("")), known.isNull()).alias("tag"))


def pack(first: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return first << 32 | count << 8 | offset


ENTRY = "key long, whole long, doc long, tag long, place long, batch int"


def entries(docs: DataFrame, batches: int) -> DataFrame:
    """The suffixes that are indexed: seed, run, and where; with the batch of the document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rb in rows:
            out = []
            for text, doc, tag in zip(*(rb.column(i).to_pylist() for i in range(3)), strict=True):
                data = as_bytes(text)
                if len(data) < LENGTH:
                    continue
                key, whole, first, count, offset = anchor_runs(np.frombuffer(data, np.uint8))
                out.append((key.view(np.int64), whole.view(np.int64), np.full(len(key), doc), np.full(len(key), tag), pack(first, count, offset), np.full(len(key), mix_int(doc) % batches, np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "whole", "doc", "tag", "place", "batch"])
        trim()

    return keyed(docs).select("text", "doc", "tag").mapInArrow(run, ENTRY)


def mix_int(x: int) -> int:
    return int(mix64(np.array([x % 2**64], _U))[0] >> _U(1))


class IndexFamily:
    """Levels of sparse suffix arrays in the shared folder; level i has the suffixes of 2**i batches."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch, self.levels, self.added = spark, scratch, {}, 0

    def add(self, batch: DataFrame) -> DataFrame:
        """Indexes ``batch(key, doc, tag, place)``; returns key, doc, tag, place of the batch's first suffix for each seed that
        the batch has twice, or shares with an existing level."""
        self.added += 1
        level, name = 0, f"array-{self.added}"
        place = [F.first(c).alias(c) for c in ("doc", "tag", "place")]
        array = batch.groupBy("key").agg(F.count("*").alias("n"), *place)
        array = self.scratch.keep(array.sortWithinPartitions("key"), name)
        own = array.filter("n > 1").select("key", "doc", "tag", "place")
        found = reduce(DataFrame.unionByName, [own] + [array.filter("n = 1").join(old.select("key"), "key", "left_semi").select("key", "doc", "tag", "place") for old, _ in self.levels.values()])
        found = self.scratch.keep(found, f"matches-{self.added}")
        while level in self.levels:
            old, old_name = self.levels.pop(level)
            level, merged_name = level + 1, f"level-{level + 1}-{self.added}"
            both = old.unionByName(array).groupBy("key").agg(F.sum("n").alias("n"), *place)
            array = self.scratch.keep(both.sortWithinPartitions("key"), merged_name)
            self.scratch.drop(old_name, name)
            name = merged_name
        release(self.spark)
        self.levels[level] = array, name
        return found

    def sizes(self) -> DataFrame:
        """key, n of all levels together."""
        levels = [d.select("key", "n") for d, _ in self.levels.values()]
        return levels[0] if len(levels) == 1 else reduce(DataFrame.unionByName, levels).groupBy("key").agg(F.sum("n").alias("n"))


#: A key is hot with more than this share of the rows, so there are at most as many hot keys.
HOT_SHARE = 500
#: The windows of a seed with more surroundings than this are dealt out by fingerprint, into a slice for each so many.
HOT = 200
#: Runs whose windows are handed on together.
WINDOW_ROWS = 2_000


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], counted: DataFrame, rows: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. ``counted(keys, n)`` says how many of the so many rows of
    ``left`` a key has: the few keys that hold a good part of them are joined where they are, by broadcast."""
    hot = counted.filter(F.col("n") * HOT_SHARE > rows).select(keys).collect()
    if not hot:
        return left.join(right, keys)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot, counted.select(keys).schema))
    there = left.join(F.broadcast(right.join(hot, keys, "left_semi")), keys)
    return there.unionByName(left.join(hot, keys, "left_anti").join(right, keys))


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, tag, spans (sorted array of struct<s,e>) of the documents with repeated strings."""
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "suffixes")
    path = f"{scratch.path}/entries"
    entries(docs, batches).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(ENTRY).parquet(path)
    family = IndexFamily(spark, scratch)
    matches = [family.add(stored.filter(F.col("batch") == b).select("key", "doc", "tag", "place")) for b in range(batches)]
    seeds = reduce(DataFrame.unionByName, matches).select("key").distinct()
    found = scratch.keep(join_dealt(stored.drop("batch"), seeds, ["key"], family.sizes(), stored.count()), "found")
    scratch.drop("entries", *(f"matches-{b + 1}" for b in range(batches)), *(name for _, name in family.levels.values()))
    release(spark)

    # Runs with equal bytes: one row for each, with the number of copies.
    runs = scratch.keep(found.groupBy("key", "whole").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "tag", "place"))), "runs")
    release(spark)
    copied = runs.filter("n > 1").select("key", "whole", "n")
    full = scratch.keep(join_dealt(found, copied.drop("n"), ["key", "whole"], copied, found.count()).select("doc", "tag", "place"), "full")
    scratch.drop("found")
    release(spark)

    # Seeds with several surroundings: window by window.
    several = scratch.keep(runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    asked = join_dealt(runs, several.select("key", F.ceil(F.col("n") / HOT).alias("slices")), ["key"], several, runs.count())
    asked = scratch.keep(asked.select("key", "n", "doc", "tag", "place", "slices"), "asked")
    scratch.drop("runs")
    partial = scratch.keep(_compare(_windows(docs, asked)), "partial")
    scratch.drop("asked")
    release(spark)

    first, count = F.shiftrightunsigned("place", 32), F.shiftrightunsigned("place", 8).bitwiseAND(F.lit(255))
    spans = full.select("doc", "tag", F.array(F.struct(first.cast("int").alias("s"), (first + count - 1 + LENGTH).cast("int").alias("e"))).alias("spans"))
    spans = spans.unionByName(partial.select("doc", "tag", "spans").filter(F.size("spans") > 0))
    spans = scratch.keep(_merge_spans(spans.groupBy("doc", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))), "spans")
    scratch.drop("full", "partial", "several")
    release(spark)
    return spans


def _merge_spans(spans: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            cut = [[{"s": s, "e": e} for s, e in merged([(x["s"], x["e"]) for x in one])] for one in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(cut, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["doc", "tag", "spans"])

    return spans.mapInArrow(run, "doc long, tag long, spans array<struct<s:int,e:int>>")


def _attach(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """doc_id, text, doc, tag and the lists of the row; ``lists`` has doc, tag. The texts are shuffled by the rows' keys."""
    by_row = lists.groupBy("doc", "tag").agg(F.collect_list(F.struct(*[c for c in lists.columns if c not in ("doc", "tag")])).alias("lists"))
    return keyed(docs).join(by_row.hint("shuffle_hash"), ["doc", "tag"], how).select("doc_id", "text", "lists", "doc", "tag")


def _windows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """key, slice, n, doc, tag, place, at (index of each window in its run), prints, for the runs that are asked for."""
    lists = asked.select("doc", "tag", F.struct("place", "key", "n", "slices").alias("run"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            out = []
            for text, wanted, doc, tag in zip(*(rb.column(i).to_pylist() for i in range(1, 5)), strict=True):
                prints = Hashes(np.frombuffer(as_bytes(text), np.uint8)).all(LENGTH).view(np.int64)
                for r in wanted:
                    r = r["run"]
                    first, count = r["place"] >> 32, r["place"] >> 8 & 255
                    got = prints[first : first + count]
                    if r["slices"] == 1:
                        out.append((r["key"], 0, r["n"], doc, tag, r["place"], np.arange(count), got))
                        continue
                    of = got % r["slices"]
                    for s in np.unique(of):
                        at = np.flatnonzero(of == s)
                        out.append((r["key"], int(s), r["n"], doc, tag, r["place"], at, got[at]))
                    if len(out) > WINDOW_ROWS:
                        yield _window_rows(out)
                        out = []
                if len(out) > WINDOW_ROWS:
                    yield _window_rows(out)
                    out = []
            if out:
                yield _window_rows(out)
        trim()

    return _attach(docs, lists, "inner").mapInArrow(run, "key long, slice long, n long, doc long, tag long, place long, at array<int>, prints array<long>")


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    kinds = (pa.int64(),) * 6
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c[6]])]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c[6]), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c[7]), pa.int64()))]
    return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(c, kinds, strict=False)), *lists], ["key", "slice", "n", "doc", "tag", "place", "at", "prints"])


def _compare(windows: DataFrame) -> DataFrame:
    """doc, tag, place, spans of each row of ``windows``: the strings that it shares with runs of other surroundings. Seeds are
    streamed in order: only the rows of one Arrow batch and of the seed that it breaks off in are held."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for rb in rows:
            t = pa.Table.from_batches([rb])
            held = t if held is None else pa.concat_tables([held, t])
            key, part = held.column("key").to_numpy(), held.column("slice").to_numpy()
            last = int(np.argmax((key == key[-1]) & (part == part[-1])))
            if last:
                yield _shared(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield _shared(held)
        trim()

    return windows.repartition("key", "slice").sortWithinPartitions("key", "slice").mapInArrow(run, "doc long, tag long, place long, spans array<struct<s:int,e:int>>")


def _shared(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    lists = t.column("prints").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    prints, at = lists.flatten().to_numpy(), t.column("at").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(t)), counts)
    # Seeds tell windows apart as well: a repeat is a print that occurs twice with one seed.
    key = t.column("key").to_numpy()[row]
    order = np.lexsort((prints, key))
    p, k = prints[order], key[order]
    same = (p[1:] == p[:-1]) & (k[1:] == k[:-1])
    twice = np.zeros(len(p), bool)
    twice[1:] |= same
    twice[:-1] |= same
    # Runs that are copies of others are removed as a whole already.
    hit = np.sort(order[twice & (t.column("n").to_numpy()[row[order]] == 1)])
    r, a = row[hit], at[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(r))[: len(starts)] - 1
    first = t.column("place").to_numpy()[r[starts]] >> 32
    values = pa.StructArray.from_arrays([pa.array((first + a[starts]).astype(np.int32)), pa.array((first + a[ends] + LENGTH).astype(np.int32))], ["s", "e"])
    offsets = np.searchsorted(r[starts], np.arange(len(t) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc", "tag", "place")), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc", "tag", "place", "spans"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) for each row of ``docs``."""
    spans = repeated_spans(docs, batches)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            out = []
            for doc_id, text, lists in zip(*(rb.column(i).to_pylist() for i in range(3)), strict=True):
                data = as_bytes(text)
                cut = merged([(x["s"], x["e"]) for one in lists or () for x in one["spans"]])
                kept = data
                if cut:
                    edges = [0, *(v for c in cut for v in c), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            c = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _attach(docs, spans, "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
