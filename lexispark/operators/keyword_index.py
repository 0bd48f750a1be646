"""Look-up of texts that contain a term, case aside, by an index of trigrams.

Texts are written once, by the tasks that read them. For every group of some texts of a file (GROUP_CHARS) the index has one row
for each of their different trigrams: the gram, the ids of the texts that have it and the texts' file, in files by a hash of the
gram. A look-up reads only the index files of the term's grams and counts how many of them each text has. A text may have all of
them apart, so the files of such texts are opened, and no others, and the texts in them looked through. Places of the grams would
spare that, but even packed they take three times the room of the texts (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexispark.operators import retrieval
from lexispark.session import batches_of
from lexispark.storage import Folder

SIZE, BUCKETS = 3, 64
#: Characters of a group, unless one text has more.
GROUP_CHARS = 1 << 20
#: Texts that Python is handed at once.
BUILD_ROWS = 500
LISTS = "gram string, ids array<long>, file string"
POSTINGS = f"{LISTS}, bucket int"
#: Ids that ascend take a few bits each as differences, which is what Parquet writes where it has no dictionary.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false"}


def groups(ids: list[int], texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Neighbouring texts that have grams, by GROUP_CHARS characters or one text."""
    of: list[int] = []
    held: list[str] = []
    n = 0
    for i, t in zip(ids, texts, strict=True):
        if t is None or len(t) < SIZE:
            continue
        if held and n + len(t) > GROUP_CHARS:
            yield of, held
            of, held, n = [], [], 0
        of.append(i)
        held.append(t)
        n += len(t)
    if held:
        yield of, held


def lists_of(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """gram, ids, places of a group of texts of SIZE characters at least; the index leaves the places out."""
    whole = "".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(text[: 1 - SIZE] == text[SIZE - 1 :])  # no gram goes over the end of a text
    key = code[at] << np.uint64(42) | code[at + 1] << np.uint64(21) | code[at + 2]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    text = text[at]
    other = np.concatenate(([True], key[1:] != key[:-1]))
    pair = np.flatnonzero(other | np.concatenate(([True], text[1:] != text[:-1])))
    gram = np.flatnonzero(other[pair])
    places = pa.ListArray.from_arrays(pa.array(np.append(pair, len(at)).astype(np.int32)), pa.array((at - (ends - sizes)[text]).astype(np.int32)))
    bounds = pa.array(np.append(gram, len(pair)).astype(np.int32))
    names = [whole[p : p + SIZE] for p in at[pair[gram]].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(bounds, pa.array(np.array(ids, np.int64)[text[pair]])), pa.ListArray.from_arrays(bounds, places)], ["gram", "ids", "places"])


def grams_of(term: str) -> list[str]:
    return sorted({term[k : k + SIZE] for k in range(len(term) - SIZE + 1)})


class KeywordIndex(Folder):
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.buckets = buckets

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _rows(self, schema: StructType, *files: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/rows/{f}" for f in files or ("",)))

    def build(self, rows: DataFrame, text: str = "text") -> None:
        """Indexes ``rows(id, ...)``, ids unique and not null. The lower case is Spark's, as it is of terms."""
        rows.write.option("compression", "zstd").parquet(f"{self.path}/rows")

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column(2).unique().to_pylist():
                    held = batch.filter(pc.equal(batch.column(2), file))
                    for ids, texts in groups(held.column(0).to_pylist(), held.column(1).to_pylist()):
                        lists = lists_of(ids, texts)
                        yield pa.RecordBatch.from_arrays([lists["gram"], lists["ids"], pa.array([file] * lists.num_rows)], ["gram", "ids", "file"])

        kept = self._rows(rows.schema).select("id", F.lower(text).alias("t"), F.col("_metadata.file_name").alias("file"))
        found = kept.mapInArrow(postings, LISTS).withColumn("bucket", self._bucket("gram"))
        # Common grams are in every group of texts: a bucket is written by as many tasks as its size takes.
        found = found.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
        with batches_of(self.spark, BUILD_ROWS):
            found.write.partitionBy("bucket").options(**PACKED).parquet(f"{self.path}/grams")

    def ids(self, term: str) -> DataFrame | None:
        """id and file of each row that has all grams of a lower-case term of at least SIZE characters: of all that contain it,
        and maybe of more. None if no row has any gram."""
        wanted = grams_of(term)
        grams = self.spark.createDataFrame([(g,) for g in wanted], "gram string").withColumn("bucket", self._bucket("gram"))
        buckets = sorted({r["bucket"] for r in grams.collect()})  # as many as the term has grams
        if not self.names("grams"):
            return None
        lists = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/grams").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        had = lists.select("file", F.explode("ids").alias("id")).groupBy("id", "file").agg(F.count("*").alias("n"))
        return had.filter(F.col("n") >= len(wanted)).select("id", "file")

    def containing(self, term: str, schema: StructType, text: str = "text") -> DataFrame:
        """The rows, of columns ``schema``, that contain ``term``. Terms shorter than a gram are looked for in all texts."""
        lowered = self.spark.range(1).select(F.lower(F.lit(term))).first()[0]
        if len(lowered) < SIZE:
            return retrieval.containing(self._rows(schema), lowered, text)
        hits = self.ids(lowered)
        files = [] if hits is None else sorted(r["file"] for r in hits.select("file").distinct().collect())  # at most as many as were written
        if not files:
            return self._rows(schema).filter("false")
        return self._rows(schema, *files).filter(F.contains(F.lower(text), F.lit(lowered)))
