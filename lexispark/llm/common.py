"""What the operators of this subpackage share: shared scratch tables, word splitting, the train/held-out rule."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: Rows of one Arrow batch: documents may be long, so batches are short.
BATCH_ROWS = 250


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine
    serves, but only for a local master; on a cluster it has to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Scratch folders opened within each running ``temporary`` block.
_open: list[list[Scratch]] = []


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor.

    What a result still reads stays until the application ends, or until the ``temporary`` block ends in which the
    scratch was opened; the rest is dropped by the operators as they go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = self._files()
        files.deleteOnExit(path)
        if _open:
            _open[-1].append(self)

    def _files(self, name: str = "") -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path, files = self._files(name)
            files.delete(path, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Drops the scratch folders opened inside when the block ends: results read from them must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.drop()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many underscores after them as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results have been written: it does so once the driver has
    collected the plans that refer to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def short_batches(spark: SparkSession) -> None:
    """Long documents: hand Python at most BATCH_ROWS rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id is in the training part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words(text: str | None) -> list[str]:
    """As WORD finds them: str.split would also split on other white space."""
    return _WORD.findall(text) if text else []


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow over batches, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None:
                    yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives back to the system what this Python worker has freed: workers live on after a task, one for each core."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What operators remember in a worker across tasks: at most one of them at a time.
_remembered: dict[str, object] = {}


def remembered(key: str, make: Callable[[], object]) -> object:
    """``make()``, kept by this Python worker until another key is asked for."""
    if key not in _remembered:
        _remembered.clear()
        trim()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """For operators that remember nothing: room for them."""
    if _remembered:
        _remembered.clear()
        trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit multiplicative hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
