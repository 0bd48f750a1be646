"""Exact nearest neighbours over inverted lists: centroids with radius bounds, lists visited while they can still win.

*Index.* Centroids are fitted on a bounded sample (SAMPLE vectors, at most MAX_LISTS centroids); then every vector goes to
its nearest centroid, and a list keeps its number of vectors and its largest distance from the centroid. A list's vectors
lie in blocks of at most BLOCK_POINTS, dealt into parts of about PART_POINTS, so that a list with a good share of all
vectors is many tasks' work.

*Search.* For a query q and a list with centroid c and radius r no score is above ``q.c + |q| r``, nor, for unit vectors,
above ``1 - max(0, |q - c| - r)**2 / 2`` (triangle inequality). Lists are visited in falling order of the bound, in a few
rounds that grow by a factor (the last one may visit all); before each round a query drops the lists whose bound is below
its ``limit``-th best score so far. So the result is exact whatever the centroids are; they only decide how much is
visited, which ``search`` reports for each query.

Queries go to lists by shuffle, packed into matrices of at most QUERIES; no block of queries is collected or broadcast,
and the plan does not grow with their number. Only the lists' centroids, radii and counts go to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.session import batches_of
from lexispark.storage import Scratch

#: A list has a block of vectors at least, on average.
SAMPLE, MAX_LISTS, ITERATIONS = 20_000, 1024, 6
BLOCK_POINTS, PART_POINTS, QUERIES = 1024, 65_536, 512
#: Rows that Python holds at once: single vectors, and pairs of a block of queries and one of vectors (0.8 MB at 64 components).
VECTOR_ROWS, PAIR_ROWS = 1000, 32
#: Pairs of a query and a list, each with the query's vector, that are given out at once.
OPEN_PAIRS = 10_000
#: Lists of the first round, as a part of all; each further round visits so many times as many.
FIRST, FACTOR = 1 / 16, 4
#: Scores are rounded to so many digits; bounds get as much slack.
DIGITS = 6
SLACK = 2 * 10.0**-DIGITS


class Lists(NamedTuple):
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    unit: bool

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of each query (a row) with the vectors of each list."""
        products = q @ self.centroids.T
        bounds = products + np.sqrt((q * q).sum(1))[:, None] * self.radius
        if self.unit:
            apart = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * products + (self.centroids**2).sum(1), 0))
            bounds = np.minimum(bounds, 1 - np.maximum(apart - self.radius, 0) ** 2 / 2)
        bounds[:, self.counts == 0] = -np.inf
        return bounds + SLACK


def whole(df: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of the rows that have an id and a vector without nulls."""
    kept = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", F.isnull), F.lit(True))
    return df.filter(kept).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of possibly different lengths, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def scaled(x: np.ndarray, unit: bool) -> np.ndarray:
    """Unit vectors where wanted; a vector without direction, or with what is no number, is not a number at all."""
    if not unit:
        return x
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``, from rows of it that are far apart from the last ones taken."""
    rng = np.random.default_rng(7)
    lists = min(lists, len(x))
    squares = (x * x).sum(1)
    chosen = [0]
    nearest = np.full(len(x), np.inf)
    while len(chosen) < lists:
        c = x[chosen[-1]]
        nearest = np.minimum(nearest, np.maximum(squares - 2 * (x @ c) + c @ c, 0))
        total = nearest.sum()
        chosen.append(int(np.searchsorted(np.cumsum(nearest), rng.random() * total)) if total > 0 else len(chosen))
    centroids = x[np.minimum(chosen, len(x) - 1)].copy()
    for _ in range(ITERATIONS):
        of = np.argmax(x @ centroids.T - (centroids**2).sum(1) / 2, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one list and part (the first two columns) by ``most`` or fewer, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        of = batch.column(0).to_numpy() * (1 << 20) + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                if held and (n == most or of[a] != last):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
                piece = batch.slice(a, min(b - a, most - n))
                held.append(piece)
                n, a, last = n + piece.num_rows, a + piece.num_rows, of[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class VectorIndex:
    """``unit``: scores are cosines, else inner products. Vectors are padded to the longest of the sample and of their
    Arrow batch; longer queries than vectors lose nothing, as the rest would meet zeros."""

    def __init__(self, points: DataFrame, unit: bool = True, lists: int | None = None):
        self.spark: SparkSession = points.sparkSession
        self.unit, self.searches = unit, 0
        self.scratch = Scratch(self.spark, "vectors")
        rows = whole(points)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        x = scaled(matrix(sample.column("embedding")), unit) if sample.num_rows else np.zeros((1, 1))
        x = x[np.isfinite(x).all(1)]
        self.width = max(x.shape[1], int(rows.agg(F.max(F.size("embedding"))).first()[0] or 0))
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1]))) if len(x) else np.zeros((1, self.width))
        if lists is None:
            n = rows.count() if sample.num_rows == SAMPLE else sample.num_rows
            lists = max(1, int(min(MAX_LISTS, n // BLOCK_POINTS, n**0.5 / 2)))
        centroids = fit(x, lists)
        sent = self.spark.sparkContext.broadcast(centroids)
        width = self.width

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                v = scaled(matrix(batch.column(1), width), unit)
                good = np.isfinite(v).all(1)
                v = v[good]
                if not len(v):
                    continue
                of = np.argmax(v @ c.T - (c * c).sum(1) / 2, 1)
                apart = np.sqrt(((v - c[of]) ** 2).sum(1))
                ids = batch.column(0).cast(pa.int64()).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([ids, pa.array(of.astype(np.int32)), pa.array(apart), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "list", "apart", "vector"])

        assigned = self._keep(rows.mapInArrow(assign, "vec_id long, list int, apart double, vector binary"), "assigned")
        found = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()  # one row a list
        radius, counts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for r in found:
            radius[r["list"]], counts[r["list"]] = r["radius"], r["n"]
        self.lists = Lists(centroids, radius, counts, unit)
        parts = [(i, max(1, -(-int(n) // PART_POINTS)), int(n)) for i, n in enumerate(counts)]
        self.parts = self.spark.createDataFrame(parts, "list int, parts int, n long")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in stretches(batches, BLOCK_POINTS):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).slice(0, 1), piece.column(1).slice(0, 1), pa.array([piece.column(2).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(piece.column(3).to_pylist())], pa.binary())],
                    ["list", "part", "ids", "vectors"],
                )

        dealt = assigned.join(F.broadcast(self.parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        dealt = dealt.select("list", "part", "vec_id", "vector").repartition("list", "part").sortWithinPartitions("list", "part")
        self.blocks = self._keep(dealt.mapInArrow(pack, "list int, part int, ids array<long>, vectors binary"), "blocks")
        self.scratch.drop("assigned")

    def _keep(self, df: DataFrame, name: str, rows: int = VECTOR_ROWS) -> DataFrame:
        """``df`` written out, its steps in Python by ``rows`` at once: what a worker holds does not grow with the table."""
        with batches_of(self.spark, rows):
            return self.scratch.keep(df, name)

    def search(self, queries: DataFrame, limit: int, own: bool = True) -> tuple[DataFrame, DataFrame]:
        """query_id, vec_id, score of the ``limit`` best vectors for each of ``queries(vec_id, embedding)``, ties by id; and
        query_id, n_lists, n_vectors: what was visited for it. Without ``own`` a query does not meet its own id."""
        unit, width, sent = self.unit, self.width, self.spark.sparkContext.broadcast(self.lists)

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = scaled(matrix(batch.column(1)), unit)
                good = np.isfinite(v).all(1)
                v = np.pad(v, ((0, 0), (0, max(0, width - v.shape[1]))))[good, :width]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).filter(pa.array(good)), pa.array([r.tobytes() for r in v], pa.binary())], ["query_id", "vector"])

        asked = whole(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(take, "query_id long, vector binary")
        self.searches += 1
        asked = self._keep(asked, f"asked-{self.searches}")
        n, upto, begin, visited = len(self.lists.counts), max(1, int(len(self.lists.counts) * FIRST)), 0, []
        state = asked.withColumn("least", F.lit(float("-inf")))
        best = self.spark.createDataFrame([], "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        while begin < n:
            name = f"{self.searches}-{begin}"
            pairs = self._keep(state.mapInArrow(_open_lists(sent, begin, upto), "query_id long, list int, vector binary, least double"), f"open-{name}")
            visited.append(pairs.select("query_id", "list"))
            if begin and pairs.isEmpty():
                break
            found = best.unionByName(self._meet(pairs, limit, own))
            best = found.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")
            best = self._keep(best, f"best-{name}", PAIR_ROWS)
            begin, upto = upto, min(n, upto * FACTOR)
            if begin < n:
                full = best.groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("score")).alias("_least"))
                state = asked.join(full, "query_id", "left").select("query_id", "vector", F.coalesce("_least", F.lit(float("-inf"))).alias("least"))
        met = visited[0]
        for v in visited[1:]:
            met = met.unionByName(v)
        met = met.join(F.broadcast(self.parts), "list").groupBy("query_id").agg(F.count("*").alias("n_lists"), F.sum("n").alias("n_vectors"))
        return best, met

    def _meet(self, pairs: DataFrame, limit: int, own: bool) -> DataFrame:
        """The best of each query with each block of the lists that it visits."""
        width = self.width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in stretches(batches, QUERIES):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).slice(0, 1), piece.column(1).slice(0, 1), pa.array([piece.column(2).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(piece.column(3).to_pylist())], pa.binary()), pa.array([piece.column(4).to_pylist()], pa.list_(pa.float64()))],
                    ["list", "part", "query_ids", "asked", "least"],
                )

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    qids, q, least, ids, x = (batch.column(k)[row] for k in range(5))
                    qids, least, ids = (np.asarray(a.values) for a in (qids, least, ids))
                    q, x = (np.frombuffer(a.as_py()).reshape(-1, width) for a in (q, x))
                    scores = np.round(q @ x.T, DIGITS)
                    some = scores >= least[:, None]
                    if not own:
                        some &= qids[:, None] != ids
                    at, of = np.nonzero(some)
                    if not len(at):
                        continue
                    score, found = scores[at, of], ids[of]
                    ranked = np.lexsort((found, -score, at))
                    at, score, found = at[ranked], score[ranked], found[ranked]
                    kept = np.arange(len(at)) - np.searchsorted(at, at) < limit
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at[kept]]), pa.array(found[kept]), pa.array(score[kept])], ["query_id", "vec_id", "score"])

        dealt = pairs.join(F.broadcast(self.parts.select("list", "parts")), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("list", "part", "query_id", "vector", "least").repartition("list", "part").sortWithinPartitions("list", "part")
        chunks = dealt.mapInArrow(pack, "list int, part int, query_ids array<long>, asked binary, least array<double>")
        both = chunks.join(self.blocks, ["list", "part"]).select("query_ids", "asked", "least", "ids", "vectors")
        return both.mapInArrow(meet, "query_id long, vec_id long, score double")


def _open_lists(sent, begin: int, upto: int):
    """For each query the lists from place ``begin`` to ``upto`` in falling order of bounds that can still win."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).to_pylist()
            bounds = lists.bounds(np.stack([np.frombuffer(v) for v in vectors]))
            order = np.argsort(-bounds, axis=1, kind="stable")[:, begin:upto]
            least = batch.column(2).to_numpy()
            reach = np.take_along_axis(bounds, order, 1)
            row, at = np.nonzero((reach >= least[:, None]) & np.isfinite(reach))
            for s in range(0, len(row), OPEN_PAIRS):
                of, k = row[s : s + OPEN_PAIRS], at[s : s + OPEN_PAIRS]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(order[of, k].astype(np.int32)), batch.column(1).take(pa.array(of)), batch.column(2).take(pa.array(of))], ["query_id", "list", "vector", "least"])

    return run
