"""A Python data source over stores that give their rows page by page, as vector stores, wikis and search services do.

``spark.read.format("paged")`` plans ranges of pages that executors read in parallel; equality and membership filters on
the columns named by ``filters`` go to the store with each request. ``spark.readStream.format("paged")`` has the number of
the next page as its offset: it reads pages that have come since, and takes up there after a restart.

A client is any class with ``pages()`` and ``page(n, filters)``, named by the option ``client`` as ``module:Class`` and built
from the options; FolderPages, the default, serves pages from a folder, as a stand-in for a service.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexispark.operators.numbering import numbered

#: Pages of a task, and times that a page is asked for.
PAGES, TRIES = 16, 3
DEFAULT = "lexispark.sources.paged:FolderPages"


class FolderPages:
    """Pages are the folders ``page=<n>`` of JSON lines below ``path``; a page has all rows of its number."""

    def __init__(self, options: dict[str, str]):
        self.files, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"].removeprefix("file:"))

    def pages(self) -> int:
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return 1 + max((int(f.base_name.removeprefix("page=")) for f in found if f.base_name.startswith("page=")), default=-1)

    def page(self, n: int, filters: dict[str, list], schema: pa.Schema) -> pa.Table:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/page={n}", allow_not_found=True))
        parts = []
        for f in sorted((f for f in found if f.base_name.endswith(".json") and f.size), key=lambda f: f.path):
            with self.files.open_input_stream(f.path) as stream:
                parts.append(pyarrow.json.read_json(stream, parse_options=pyarrow.json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")))
        rows = pa.concat_tables(parts) if parts else schema.empty_table()
        for column, values in filters.items():
            rows = rows.filter(pc.is_in(rows.column(column), pa.array(values, schema.field(column).type)))
        return rows.select(schema.names)


class Pages(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


def ranges(first: int, end: int, size: int) -> list[InputPartition]:
    return [Pages(a, min(end, a + size)) for a in range(first, end, size)]


class _Reading:
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.wanted = dict(options), schema, {}
        self.size = int(options.get("pages", PAGES))

    def client(self):
        module, name = self.options.get("client", DEFAULT).split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        client, schema = self.client(), to_arrow_schema(self.schema)
        for n in range(partition.first, partition.end):
            for tries in range(TRIES):
                try:
                    rows = client.page(n, self.wanted, schema)
                    break
                except OSError:
                    if tries == TRIES - 1:
                        raise
                    time.sleep(0.2 * 2**tries)
            yield from rows.to_batches()


class PagedReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes ``column = value`` and ``column IN (...)`` on the columns that the store can filter by; yields the rest."""
        able = {c for c in self.options.get("filters", "").split(",") if c}
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in able and None not in values:
                name = f.attribute[0]
                self.wanted[name] = [v for v in self.wanted[name] if v in values] if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return ranges(0, self.client().pages(), self.size)


class PagedStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:
        return {"page": self.client().pages()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(start["page"], end["page"], self.size)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged store needs a schema: .schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options, schema)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_pages(rows: DataFrame, path: str, order: str, size: int = 1000) -> None:
    """``rows`` as a folder of pages of ``size`` rows, in an order without ties; the columns ``page`` and ``number`` are its
    own."""
    paged = numbered(rows, order).withColumn("page", F.expr(f"number div {int(size)}")).drop("number")
    paged.write.partitionBy("page").json(path)
