"""Files that the driver and all executors share: scratch tables, settled frames, and small files created once only."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set a folder of this machine serves, but
    only for a local master; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))
    return context._jsc.sc().getCheckpointDir().get()


class Folder:
    """A folder of any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = "") -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        path, files = self._at(name)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def read(self, name: str) -> dict | None:
        """A small JSON file; None if it is not there."""
        path, files = self._at(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Writes a small JSON file if it is not there; False if it is. Of writers at the same time one succeeds: local files
        are linked into place from a finished draft, other stores create without overwriting."""
        path, files = self._at(name)
        data = json.dumps(value).encode()
        if path.toUri().getScheme() in (None, "file") and files.getScheme() == "file":
            target = path.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                f.write(data)
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        from py4j.protocol import Py4JJavaError

        try:
            stream = files.create(path, False)
        except Py4JJavaError:
            if files.exists(path):
                return False
            raise
        try:
            stream.write(data)
        finally:
            stream.close()
        return True

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path, files = self._at(name)
            files.delete(path, True)


class Scratch(Folder):
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor and go when the
    application ends."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
        path, files = self._at()
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` cut off from what it came from: written to the shared folder and read again."""
    return Scratch(df.sparkSession, name).keep(df, "rows")
