"""Exact top-k inner products by MaxScore over quantised vectors.

Each component is a term with weight floor(scale * x). The candidates stay in their partitions (shards). A shard's rows
are put together by their strongest term and cut into blocks of LIST_ROWS; a block keeps, for every term, the least and
greatest weight of its postings. For a query, a term's bound is the most it can add to a score in that block. A query
meets the blocks in falling order of the sum of its bounds, so that its threshold (its k-th best score so far) is high
early, and stops at the first block whose sum is below. In a block, terms are split by bound: the non-essential ones
cannot lift a candidate over the threshold by themselves. Essential postings are traversed for all candidates; the
others are probed, in falling order of bound, only for candidates whose score so far plus the bounds of what is left
can still reach the threshold. Each shard returns its k best for each query; the shards are merged by a window.

Queries go out in passes of bounded size (PASS_QUERIES vectors), one scan of the candidates for each pass.

Defined cases: vectors that are null, or hold null or non-finite components (or such that scaling takes beyond doubles), take no part on either side; vectors of
different lengths are padded with zeros; a null vec_id takes no part; ties go to the smaller vec_id; rows that repeat
a vec_id are one candidate each, a repeated query id is asked once, with its smallest vector, and a query never meets
rows of its own vec_id; fewer than k candidates give fewer rows; scores are exact however large (beyond 2**53 they are
added up as whole numbers); one that a long cannot hold is ranked rightly and shown as null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256
K = 5
#: Queries of one pass: at 64 components some 16 MB go to each executor.
PASS_QUERIES = 32_768
#: Rows of a block of postings.
LIST_ROWS = 256
#: Sums of products below this are exact in doubles.
_EXACT = 2.0**53
#: Terms that are probed at once.
_PROBE = 16
#: More than the digits that a product of two doubles, scaled and added up, can have.
_DIGITS = 640


def valid(vector: Column, scale: float = SCALE) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * float(scale)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(rows: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = rows.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        out = flat.reshape(len(ids), width)
    else:
        out = np.zeros((len(ids), width))
        out[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, np.floor(out * scale)


def padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Shard:
    """Running k best of one shard for a pass of queries; ``touched`` counts the postings read of ``offered``."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.best = [(np.empty(0), np.empty(0, np.int64))] * len(query_ids)
        self.touched = self.offered = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        x, q = padded(vectors, width), padded(self.queries, width)
        self.offered += len(q) * x.size
        if not len(q) or not len(x):
            return
        if not width or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width >= _EXACT:
            # Huge components: whole numbers of any size, slowly.
            whole = [[int(v) for v in row] for row in x]
            self.touched += len(q) * x.size
            for i, row in enumerate(q):
                terms = [int(v) for v in row]
                self._merge(i, ids, np.array([sum(map(int.__mul__, terms, r)) for r in whole] + [None], object)[:-1])
            return
        strongest = np.abs(x).argmax(1)
        order = np.lexsort((strongest, np.take_along_axis(x, strongest[:, None], 1)[:, 0] < 0, strongest))
        ids, x = ids[order], x[order]
        starts = range(0, len(x), LIST_ROWS)
        blocks = [(ids[a : a + LIST_ROWS], x[a : a + LIST_ROWS], np.asfortranarray(x[a : a + LIST_ROWS])) for a in starts]
        low, high = (np.stack([f(b[1], axis=0) for b in blocks]) for f in (np.min, np.max))
        # The sum of all bounds of each query in each block.
        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        turn = np.argsort(-most, axis=1, kind="stable")
        for i in range(len(q)):
            for b in turn[i].tolist():
                if most[i, b] < self._threshold(i):
                    break
                self._search(i, q[i], *blocks[b], np.maximum(q[i] * high[b], q[i] * low[b]))

    def _search(self, i: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, postings: np.ndarray, bounds: np.ndarray) -> None:
        terms = np.argsort(-bounds, kind="stable")
        left = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0.0)  # left[j]: the most that terms j.. can add
        threshold = self._threshold(i)
        at = int(np.argmax(left < threshold)) if left[-1] < threshold or (left < threshold).any() else len(terms)
        score = postings[:, terms[:at]] @ q[terms[:at]]
        self.touched += at * len(ids)
        alive = np.flatnonzero(score + left[at] >= threshold)
        score = score[alive]
        while at < len(terms) and len(alive):
            step = terms[at : at + _PROBE]
            score = score + x[np.ix_(alive, step)] @ q[step]
            self.touched += len(step) * len(alive)
            at += len(step)
            keep = score + left[min(at, len(terms))] >= threshold
            alive, score = alive[keep], score[keep]
        if len(alive):
            self._merge(i, ids[alive], score)

    def _threshold(self, i: int) -> float:
        scores = self.best[i][0]
        return float(scores[-1]) if len(scores) >= self.k else -np.inf

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids != self.query_ids[i]
        s, d = np.concatenate([self.best[i][0], scores[own]]), np.concatenate([self.best[i][1], ids[own]])
        order = np.lexsort((d, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-int(s[j]), d[j])), int)
        self.best[i] = (s[order[: self.k]], d[order[: self.k]])

    def rows(self) -> pa.RecordBatch:
        n = [len(b[1]) for b in self.best]
        scores = [int(s) for b in self.best for s in b[0]]
        fits = [-(2**63) <= s < 2**63 for s in scores]
        # Scores that are no longs: above or below them, and their digits in an order that strings have as well.
        beyond = [0 if f else 1 if s > 0 else -1 for f, s in zip(fits, scores, strict=True)]
        digits = [None if f else f"{s + 10**_DIGITS:0{_DIGITS + 1}d}" for f, s in zip(fits, scores, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.query_ids, n), pa.int64()), pa.array(np.concatenate([b[1] for b in self.best]) if n else [], pa.int64()),
                pa.array([s if f else None for f, s in zip(fits, scores, strict=True)], pa.int64()), pa.array(beyond, pa.int32()), pa.array(digits, pa.string()),
            ],
            ["query_id", "vec_id", "score", "beyond", "digits"],
        )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, block: int = PASS_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best of ``vectors`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    pick = lambda df: df.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"), scale)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    candidates, asked = pick(vectors), pick(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    passes = max(1, -(-asked.count() // block))
    parts = []
    for n in range(passes):
        of_pass = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n)
        table = of_pass.toArrow()
        if not table.num_rows:
            continue
        ids, numbers = quantised(table.combine_chunks().to_batches()[0], scale)
        sent = spark.sparkContext.broadcast((ids, numbers))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = Shard(*sent.value, k)
            for batch in batches:
                if batch.num_rows:
                    shard.add(*quantised(batch, scale))
            yield shard.rows()

        parts.append(candidates.mapInArrow(search, "query_id long, vec_id long, score long, beyond int, digits string"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("digits"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
