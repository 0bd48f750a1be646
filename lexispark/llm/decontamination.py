"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are split into words (runs of word characters, lower case). Seeds are runs of SHINGLE
words that a document shares with an item; only pairs with seeds that could reach the threshold are tiled. Tiling
marks, again and again, the longest match of unmarked words in both texts, found by running Karp-Rabin hashes over
falling lengths, until none of MIN_MATCH words is left. Marked tiles never overlap, and their order does not matter, so
reordered passages are caught. A document is contaminated if its tiles cover THRESHOLD of an item's words.

The benchmark goes out in blocks of bounded size (BLOCK_WORDS words), one pass over the documents for each block; no
document is moved.

Defined cases: null and empty texts match nothing; items with fewer than MIN_MATCH words are too short to be evidence
and match nothing; repeated items match alike; an empty benchmark leaves every document clean; an empty table gives an
empty result; very long texts are searched whole; rows that repeat a doc_id are judged one by one; further columns,
whatever their names, are kept as they are by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import forget, fresh, short_batches, trim

SHINGLE = MIN_MATCH = 5
THRESHOLD = 0.8
#: Words of the benchmark that one pass holds.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes, mod 2**64, of all runs of so many ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * _BASE + ids[i : i + n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    return out ^ (out >> np.uint64(29))


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> int:
    """Words of ``item`` that greedy tiling covers with runs of ``doc``; ids below 0 match nothing."""
    free_item, free_doc = item >= 0, doc >= 0
    covered = 0
    length = min(len(item), len(doc))
    while length >= least:
        a = np.flatnonzero(_whole(free_item, length))
        b = np.flatnonzero(_whole(free_doc, length))
        found = None
        if len(a) and len(b):
            ha, hb = rolling(item, length)[a], rolling(doc, length)[b]
            places: dict[int, list[int]] = defaultdict(list)
            for at, h in zip(b.tolist(), hb.tolist(), strict=True):
                places[h].append(at)
            for at, h in zip(a.tolist(), ha.tolist(), strict=True):
                for to in places.get(h, ()):
                    # Equal hashes are checked word by word; earlier tiles of this length may have taken the words.
                    if free_item[at : at + length].all() and free_doc[to : to + length].all() and (item[at : at + length] == doc[to : to + length]).all():
                        free_item[at : at + length] = False
                        free_doc[to : to + length] = False
                        covered += length
                        found = length
                        break
        # The longest match at most shrinks by halves until something can match, then word by word.
        length = _next_length(item, doc, free_item, free_doc, length if found else length - 1, least)
    return covered


def _whole(free: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[length:] - sums[:-length] == length


def _next_length(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, most: int, least: int) -> int:
    """The longest length up to ``most`` at which free runs share a hash, or 0; a match of n words has one of n - 1."""
    low, high = 0, most
    if high < least or not _share(item, doc, free_item, free_doc, least):
        return 0
    low = least
    while low < high:
        middle = (low + high + 1) // 2
        if _share(item, doc, free_item, free_doc, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _share(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, length: int) -> bool:
    a, b = _whole(free_item, length), _whole(free_doc, length)
    return bool(a.any() and b.any() and np.isin(rolling(item, length)[a], rolling(doc, length)[b]).any())


class Index:
    """A block of benchmark items: vocabulary, seed hashes, items by seed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for item_id, text in items:
            words = tokens(text)
            if len(words) < MIN_MATCH:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            seeds = np.unique(rolling(ids, SHINGLE))
            pairs.append((seeds, np.full(len(seeds), len(self.items))))
            self.items.append((item_id, ids))
        hashes = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
        owners = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def hits(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items that the text contaminates."""
        words = tokens(text)
        if len(words) < MIN_MATCH or not self.items:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        runs = _whole(ids >= 0, SHINGLE)
        if not runs.any():
            return []
        seeds = np.unique(rolling(ids, SHINGLE)[runs])
        left, right = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        some = right > left
        if not some.any():
            return []
        shared = np.bincount(np.concatenate([self.owners[a:b] for a, b in zip(left[some], right[some], strict=True)]))
        out = []
        for i in np.flatnonzero(shared).tolist():
            item_id, item = self.items[i]
            # Tiles can only cover words that lie in a shared seed.
            within = np.zeros(len(item), bool)
            for at in np.flatnonzero(np.isin(rolling(item, SHINGLE), seeds)):
                within[at : at + SHINGLE] = True
            if within.sum() < threshold * len(item):
                continue
            covered = tile(np.where(within, item, -1), np.where(np.isin(ids, item), ids, -2))
            if covered >= threshold * len(item):
                out.append((item_id, covered / len(item)))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of bounded size over the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    count = max(1, -(-int(total) // most))
    for b in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        index = Index(sorted((r["item_id"], r["text"]) for r in part.collect()))
        if index.items:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: items array<long> (ascending, distinct) and coverage double (the
    highest, 0 without items)."""
    spark = docs.sparkSession
    short_batches(spark)
    found, most = fresh(docs, "_items", "_coverage")
    out = docs.withColumns({found: F.array().cast("array<bigint>"), most: F.lit(0.0)})
    schema = out.schema
    for index in blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                names = batch.schema.names
                texts, items, best = (batch.column(names.index(c)).to_pylist() for c in ("text", found, most))
                for i, text in enumerate(texts):
                    for item, coverage in sent.value.hits(text, threshold):
                        items[i], best[i] = [*items[i], item], max(best[i], coverage)
                own = {found: pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())), most: pa.array(best, pa.float64())}
                yield pa.RecordBatch.from_arrays([own.get(c, batch.column(i)) for i, c in enumerate(names)], names)
            trim()

        out = out.mapInArrow(run, schema)
    return out, found, most


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, contaminated, item_ids, coverage for each row of ``docs``."""
    out, found, most = contaminated(docs.select("doc_id", "text"), benchmark, threshold)
    return out.select("doc_id", (F.size(found) > 0).alias("contaminated"), F.col(found).alias("item_ids"), F.round(most, 6).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns unchanged."""
    out, found, _ = contaminated(docs, benchmark, threshold)
    return out.filter(F.size(found) == 0).select(*docs.columns)
