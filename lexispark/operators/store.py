"""Tables that are changed in place: hash buckets of a key, of which a commit rewrites those that it touches.

Files of a store:

* ``data/<commit>-<attempt>/bucket=<b>/``: Parquet files, written once and never changed
* ``log/<commit>.json``: which folder has each bucket, the last number of each writer, and the fences of leases

A commit writes its buckets into a folder of its own and then creates its log entry, which either exists as a whole or
does not; of two commits with one number the second finds the entry there, and starts again from the new state. So a
reader never sees half a commit, a failed or lost attempt leaves nothing but an unused folder, and buckets that a commit
does not touch keep their files. A writer numbers its commits upwards: a number that is there already is done, so a batch
that is replayed changes nothing. The log entry has one item for each bucket, so it is bounded by their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexispark.storage import Folder

if TYPE_CHECKING:
    from lexispark.operators.lease import Lease

BUCKETS = 64
#: Attempts of a commit that others overtake.
ATTEMPTS = 20
EMPTY = {"number": -1, "buckets": {}, "writers": {}, "fences": {}}


class BucketStore(Folder):
    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.schema = StructType.fromDDL(schema)
        self.key, self.buckets = key, buckets
        known = self.read("store.json")
        if known is None:
            self.create("store.json", {"key": list(key), "buckets": buckets})
            known = self.read("store.json")
        if (tuple(known["key"]), known["buckets"]) != (key, buckets):
            raise ValueError(f"the store at {path} has key {known['key']} in {known['buckets']} buckets")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def head(self) -> dict:
        """The last log entry."""
        names = [n for n in self.names("log") if n.endswith(".json") and not n.startswith(".")]
        return self.read(f"log/{names[-1]}") if names else EMPTY

    def rows(self, head: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, as of the last commit or of another one."""
        held = (self.head() if head is None else head)["buckets"]
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(held.items()) if buckets is None or int(b) in buckets]
        if not paths:  # an empty list as a frame would be read by Python workers, which every executor then keeps
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        return self.spark.read.schema(self.schema).parquet(*paths)

    def applied(self, writer: str) -> int:
        return self.head()["writers"].get(writer, -1)

    def commit(self, writer: str, number: int, touched: DataFrame, merge: Callable[[DataFrame], DataFrame], lease: Lease | None = None) -> bool:
        """Replaces the rows of all buckets that have a key of ``touched`` by ``merge(rows)``, which has no keys of other
        buckets. False: done before. A lease that was lost meanwhile is an error, and nothing is changed."""
        buckets = None
        for _ in range(ATTEMPTS):
            head = self.head()
            if number <= head["writers"].get(writer, -1):
                return False
            if buckets is None:
                buckets = {r[0] for r in touched.select(self.bucket()).distinct().collect()}  # at most ``self.buckets`` numbers
            folder = f"{head['number'] + 1:012d}-{uuid.uuid4().hex[:12]}"
            new = merge(self.rows(head, buckets)).select(self.schema.names).withColumn("bucket", self.bucket())
            new.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
            written = {int(n.removeprefix("bucket=")) for n in self.names(f"data/{folder}") if n.startswith("bucket=")}
            if not written <= buckets:
                self.drop(f"data/{folder}")
                raise ValueError("a commit has rows with keys that it did not name")
            held = {b: f for b, f in head["buckets"].items() if int(b) not in buckets} | {str(b): folder for b in written}
            fences = dict(head["fences"])
            if lease is not None:
                if not lease.held() or fences.get(lease.name, 0) > lease.number:
                    self.drop(f"data/{folder}")
                    raise LostLease(f"{lease.name}: number {lease.number} is not the last one any more")
                fences[lease.name] = lease.number
            entry = {"number": head["number"] + 1, "buckets": held, "writers": head["writers"] | {writer: number}, "fences": fences}
            if self.create(f"log/{entry['number']:012d}.json", entry):
                return True
            self.drop(f"data/{folder}")
        raise RuntimeError(f"other writers overtook commit {number} of {writer} {ATTEMPTS} times")

    def vacuum(self, keep: int = 3) -> int:
        """Drops what only log entries before the last ``keep`` refer to; returns the number of folders dropped. Folders of
        commits under way have numbers after the last entry and stay."""
        names = [n for n in self.names("log") if n.endswith(".json") and not n.startswith(".")]
        entries = [self.read(f"log/{n}") for n in names[-keep:]]
        used = {f for e in entries for f in e["buckets"].values()}
        last = entries[-1]["number"] if entries else -1
        gone = [f for f in self.names("data") if f not in used and int(f.split("-")[0]) <= last]
        for f in gone:
            self.drop(f"data/{f}")
        for n in names[:-keep]:
            self.drop(f"log/{n}")
        return len(gone)


class LostLease(RuntimeError):
    """Another holder has taken the lease over."""


def replace_keys(new: DataFrame, gone: DataFrame, key: str) -> Callable[[DataFrame], DataFrame]:
    """A merge: rows whose ``key`` is in ``gone`` go, ``new`` comes."""
    return lambda old: old.join(gone.select(key).distinct(), key, "left_anti").unionByName(new)
