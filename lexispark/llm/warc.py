"""WARC archives: writing with payload dedup, and a reader that salvages what damage leaves.

Writing is DataFrame work: digests, the first page of every payload, record text, Spark's text writer with the WARC
record end as line separator. Archives are plain (one record after the other), so damage stays local.

Pages are written by size class, with so many records to a file that a file's payloads have at most FILE_BYTES, or it
holds a single record. Reading takes whole archive files. The salvage reader follows the records; where a check fails (version line, headers,
length, record end, payload digest), it searches on for the next gzip member that opens, or the next version line,
logs the bytes between as a quarantined gap with its reason, and goes on.

Defined cases: a null html is the empty payload; a null url has no WARC-Target-URI; line ends in urls are
percent-encoded; a null page_id is a record without page; of equal page_ids with equal payloads all are responses if
theirs is the smallest id; with different payloads each is planned on its own; very large
pages have a file of their own; gzip members that grow beyond FILE_BYTES are read record by record; an empty table gives an
empty archive and an empty result; further columns, whatever their names, are not archived.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch

#: Payloads below so many bytes are always written in full.
MIN_REVISIT_BYTES = 100
#: Bounds an archive file, which the reader holds whole; gzip members that grow beyond it are read record by record.
FILE_BYTES = 1 << 27
#: Largest payloads of the size classes; beyond the last one, a record is a file.
CLASSES = (1 << 15, 1 << 19, 1 << 23)
VERSION = "WARC/1.1"
ID = "urn:page:"
END = "\r\n\r\n"
#: Bytes that are inflated at once.
_PIECE = 1 << 20
#: What the headers of a record take at most, in a member that is read record by record.
_HEADERS = 1 << 20


def payload_digests(pages: DataFrame) -> DataFrame:
    """page_id, digest, size of the payloads that may be revisited."""
    html = F.col("html")
    return pages.filter(F.octet_length(html) >= MIN_REVISIT_BYTES).select("page_id", F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"), F.octet_length(html).alias("size"))


def plan_records(digests: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of what becomes a revisit: a row for each page and payload that an earlier page has."""
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return digests.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, out: str) -> None:
    """One record for each row of ``pages(page_id, url, html)``."""
    scratch = Scratch(pages.sparkSession, "warc")
    digests = scratch.keep(payload_digests(pages), "digests")
    largest = digests.agg(F.max("size")).first()[0] or 0
    # Written first, so that its true size decides whether the join has to move the pages at all.
    revisits = scratch.keep(plan_records(digests), "revisits").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select("page_id", "url", "html", F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"))
    joined = digested.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(html)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{ID}"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex("digest"))),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length(html).cast("string")),
        F.concat(F.lit(f"WARC-Refers-To: <{ID}"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""),
        body,
    )
    size = F.octet_length(html)
    for i, (above, most) in enumerate(zip((-1, *CLASSES), (*CLASSES, None))):
        if largest > above:
            of_class = joined.filter((size > above) & (size <= most) if most else size > above)
            of_class.select(lines.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_BYTES // most if most else 1).text(f"{out}/{i}")
    scratch.drop()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    offset: int


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    """Records of one archive, and the gaps met on the way (after iteration)."""

    data: bytes
    gaps: list[Gap] = field(default_factory=list)

    _next = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")

    def __iter__(self) -> Iterator[Record]:
        at, n = 0, len(self.data)
        bad_from, reason = None, ""
        while at < n:
            got = self._member(at) if self.data.startswith(b"\x1f\x8b", at) else self._plain(self.data, at)
            if isinstance(got, str):
                if bad_from is None:
                    bad_from, reason = at, got
                found = self._next.search(self.data, at + 1)
                at = found.start() if found else n
                continue
            if bad_from is not None:
                self.gaps.append(Gap(bad_from, at, reason))
                bad_from = None
            records, end = got
            for record in records:
                record.offset = at
                yield record
            if isinstance(records, _Streamed):
                end, reason = records.end, records.reason
                if records.reason:
                    # What was read before the damage stays; the search goes on within the member.
                    bad_from, end = at, at + 1
                    found = self._next.search(self.data, end)
                    end = found.start() if found else n
            at = end
        if bad_from is not None:
            self.gaps.append(Gap(bad_from, n, reason))

    def _member(self, at: int) -> tuple[list[Record], int] | str:
        inflate, view, plain, to = zlib.decompressobj(31), memoryview(self.data), bytearray(), at
        try:
            while not inflate.eof and (to < len(view) or inflate.unconsumed_tail):
                if len(plain) > FILE_BYTES:
                    return _Streamed(self, at), at
                piece = inflate.unconsumed_tail or view[to : to + _PIECE]
                if not inflate.unconsumed_tail:
                    to += len(piece)
                plain += inflate.decompress(piece, _PIECE)
        except zlib.error as e:
            return f"gzip: {e}"
        if not inflate.eof:
            return "gzip: member is cut short"
        inner = Salvage(bytes(plain))
        records = list(inner)
        if inner.gaps and not records:
            return inner.gaps[0].reason
        end = to - len(inflate.unused_data)
        self.gaps += [Gap(at, end, f"in member: {g.reason}") for g in inner.gaps]
        return records, end

    @staticmethod
    def _plain(data: bytes, at: int) -> tuple[list[Record], int] | str:
        if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
            return "no version line"
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return "headers do not end"
        headers: dict[str, str] = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if not colon:
                return "header without colon"
            headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = headers.get("content-length", "")
        if not size.isdigit():
            return "no content length"
        begin = stop + 4
        end = begin + int(size)
        if data[end : end + 4] != b"\r\n\r\n":
            return "record does not end where its length says"
        payload = data[begin:end]
        said = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") == "response" and said.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != said[7:]:
            return "payload digest differs"
        return [Record(headers, payload, at)], end + 4


class _Streamed:
    """Records of a large gzip member, one at a time: what is held is a piece of the member and the record that it is in.
    After iteration ``end`` is where the member ends, or ``reason`` says what stopped it."""

    def __init__(self, salvage: Salvage, at: int):
        self.salvage, self.at, self.end, self.reason = salvage, at, at, ""
        self.inflate, self.to, self.held = zlib.decompressobj(31), at, bytearray()

    def _more(self) -> bool:
        view = memoryview(self.salvage.data)
        if self.reason or self.inflate.eof or not (self.to < len(view) or self.inflate.unconsumed_tail):
            return False
        piece = self.inflate.unconsumed_tail or view[self.to : self.to + _PIECE]
        if not self.inflate.unconsumed_tail:
            self.to += len(piece)
        try:
            self.held += self.inflate.decompress(piece, _PIECE)
        except zlib.error as e:
            self.reason = f"gzip: {e}"
            return False
        return True

    def _whole(self) -> None:
        """Reads on until the record at the front is complete, or cannot be one."""
        stop = self.held.find(b"\r\n\r\n")
        while stop < 0 and len(self.held) <= _HEADERS and self._more():
            stop = self.held.find(b"\r\n\r\n")
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", self.held[: max(stop, 0)])
        need = stop + 8 + int(size[1]) if size and self.held.startswith(b"WARC/") else 0
        while len(self.held) < need and self._more():
            pass

    def __iter__(self) -> Iterator[Record]:
        bad = ""
        while self.held or self._more():
            self._whole()
            got = Salvage._plain(self.held, 0)
            if not isinstance(got, str):
                (record,), end = got
                yield Record(record.headers, bytes(record.payload), self.at)
                del self.held[:end]
                continue
            bad = bad or got
            found = re.compile(rb"WARC/1\.[01]\r\n").search(self.held, 1)
            # A version line may begin at the end of what has been read.
            del self.held[: found.start() if found else max(1, len(self.held) - 9)]
            if not found and not self._more():
                break
        self.reason = self.reason or ("" if self.inflate.eof else "gzip: member is cut short")
        self.end = self.to - len(self.inflate.unused_data)
        if bad and not self.reason:
            self.salvage.gaps.append(Gap(self.at, self.end, f"in member: {bad}"))


def _page(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{ID}(-?\d+)>", value or "")
    return int(found[1]) if found else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, offset; per gap a row
    of record_type ``gap`` with offset, payload_bytes (its length) and reason."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("reason", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive, salvage, rows = name.as_py(), Salvage(content.as_py()), []
                for r in salvage:
                    h = r.headers
                    kind = h.get("warc-type")
                    digest = hashlib.sha256(r.payload).hexdigest() if kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha256:")
                    size = len(r.payload) if kind == "response" else int(h.get("x-payload-length", "0"))
                    rows.append((_page(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, kind, _page(h.get("warc-refers-to")), archive, r.offset, None))
                rows += [(None, None, g.end - g.start, None, "gap", None, archive, g.start, g.reason) for g in salvage.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, reason string")


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{Scratch(spark, 'warc').path}/archives"
    write_warc(pages, path)
    return read_warc(spark, path)
