"""Token-ID output: documents as token ids in patched frame-of-reference blocks, in ascending doc_id order.

File format. A store is a folder of Parquet files whose rows are *segments*: runs of whole documents in ascending
doc_id order, so that any file can be read alone and a lost task is written again by Spark's committer. A segment has

* ``shard``, ``segment``: its place; shards ascend with doc_id, segments within a shard
* ``shard_start``: ids in the shard before it
* ``doc_ids``, ``lengths``: the documents and their counts of ids
* ``payload``: the blocks

payload (little-endian): u32 number of ids, u32 number of blocks, u32 block start for each block and one for the end
(bytes from the first block), then the blocks. A block holds up to BLOCK ids: u32 minimum, u8 width, u16 number of
exceptions, the low ``width`` bits of (id - minimum) packed from the lowest bit on, then u16 positions and u32 high
parts (id - minimum) >> width of the exceptions. The width is the number of bits that PERCENTILE of the block's values
need; what does not fit is an exception.

Defined cases: a null text is encoded as the empty text (the end id alone); a null doc_id comes first; repeated doc_ids
are ordered by text; an empty table gives an empty store; a document is never split, however long; further columns of
the documents are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import Scratch, remembered, short_batches, trim

BLOCK = 256
PERCENTILE = 0.97
#: A segment is closed once it holds so many ids.
SEGMENT_IDS = 65536
END_ID = 2
#: Pieces in a generation of those whose ids a worker remembers, some 200 bytes each; it keeps two generations.
CACHE_WORDS = 400_000
#: Bytes of texts that are encoded together, in whole batches.
GATHERED = 4 << 20
#: Characters of the longest piece that is remembered.
LONG = 100
WHITE = " \t\n\v\f\r"
#: White space for str.split, but not for the tokenizer.
PYTHON_WHITE = "\x1c\x1d\x1e\x1f"
#: What the tokenizer cuts lowered words in ASCII and Latin letters into, short forms aside.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Kinds of bytes; the two bytes of a Latin letter are told apart later.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = np.array([SPACE if chr(b) in WHITE else OTHER if not 32 < b < 127 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256)], np.uint8)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: What short forms go on with after the apostrophe.
SHORT = np.isin(np.arange(256), list(b"stmdrvl"))
#: Texts, and the pieces that a tokenizer has to cut them into for the shorter way.
CUTS = {"Über.": ["über", "."], "Was,": ["was", ","], "x20(Ab'C)--": ["x", "2", "0", "(", "ab", "'", "c", ")--"]}
#: What a block starts with.
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
SEGMENT = "shard int, segment int, shard_start long, doc_ids array<long>, lengths array<int>, payload binary"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values (a multiple of 8 to a row) as rows of bytes, ``width`` bits a value, lowest bit first. Eight values
    fill ``width`` bytes; up to 16 bits, four of them fit a word."""
    if width > 16:
        raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(*values.shape, 4)
        return np.packbits(np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")
    v = values.astype(np.uint64).reshape(len(values), -1, 8)
    w = np.uint64(width)
    low, high = (v[:, :, k] | v[:, :, k + 1] << w | v[:, :, k + 2] << w * np.uint64(2) | v[:, :, k + 3] << w * np.uint64(3) for k in (0, 4))
    out = np.empty((*low.shape, width), np.uint8)
    half = 4 * width
    for b in range(width):
        at = 8 * b
        if at >= half:
            out[:, :, b] = high >> np.uint64(at - half)
        elif at + 8 <= half:
            out[:, :, b] = low >> np.uint64(at)
        else:
            out[:, :, b] = low >> np.uint64(at) | high << np.uint64(half - at)
    return out.reshape(len(values), -1)


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    """What pack_bits packed."""
    if width > 16:
        bits = np.zeros((len(data), data.shape[1] * 8 // width, 32), np.uint8)
        bits[:, :, :width] = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), -1, width)
        return np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(data), -1).astype(np.int64)
    groups = data.reshape(len(data), -1, width)
    out = np.empty((*groups.shape[:2], 8), np.int64)
    mask = np.int64((1 << width) - 1)
    for k in range(8):
        first, last = k * width // 8, ((k + 1) * width - 1) // 8
        word = np.zeros(groups.shape[:2], np.int64)
        for b in range(first, last + 1):
            word |= groups[:, :, b].astype(np.int64) << np.int64(8 * (b - first))
        out[:, :, k] = word >> np.int64(k * width - 8 * first) & mask
    return out.reshape(len(data), -1)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    count = -(-n // block)
    if not n:
        return struct.pack("<III", 0, 0, 0)
    padded = np.full(count * block, 0, np.int64)
    padded[:n] = ids
    padded[n:] = ids[-1]
    grid = padded.reshape(count, block)
    low = grid.min(1)
    rest = grid - low[:, None]
    at = np.partition(rest, min(block - 1, int(np.ceil(percentile * block)) - 1), 1)[:, min(block - 1, int(np.ceil(percentile * block)) - 1)]
    widths = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1))).astype(np.int64) + 1, 0)
    packed: list[bytes] = [b""] * count
    high = rest >> widths[:, None]
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            data = pack_bits(rest[rows] & ((1 << int(width)) - 1), int(width))
            for row, line in zip(rows, data, strict=True):
                packed[row] = line.tobytes()
    high[-1, n - (count - 1) * block :] = 0
    if n < count * block:
        packed[-1] = packed[-1][: ((n - (count - 1) * block) * int(widths[-1]) + 7) // 8]
    rows, where = np.nonzero(high)
    places, parts = where.astype("<u2").tobytes(), high[rows, where].astype("<u4").tobytes()
    heads = np.zeros(count, HEAD)
    heads["low"], heads["width"], heads["exceptions"] = low, widths, np.bincount(rows, minlength=count)
    ends = np.cumsum(heads["exceptions"], dtype=np.int64).tolist()
    raw = heads.tobytes()
    bodies = [raw[7 * i : 7 * i + 7] + packed[i] + places[2 * a : 2 * b] + parts[4 * a : 4 * b] for i, (a, b) in enumerate(zip([0, *ends], ends))]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype("<u4")
    return struct.pack("<II", n, count) + starts.tobytes() + b"".join(bodies)


def unpack_blocks(payload: bytes, block: int = BLOCK) -> np.ndarray:
    n, count = struct.unpack_from("<II", payload)
    if not n:
        return np.empty(0, np.int64)
    starts = np.frombuffer(payload, "<u4", count + 1, 8).astype(np.int64) + 8 + 4 * (count + 1)
    raw = np.frombuffer(payload, np.uint8)
    out = np.zeros(count * block, np.int64)
    heads = raw[starts[:-1, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    widths, exceptions = heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    sizes = np.full(count, block)
    sizes[-1] = n - (count - 1) * block
    grid = out.reshape(count, block)
    for width in np.unique(widths):
        if not width:
            continue
        rows = np.flatnonzero((widths == width) & (sizes == block))
        if len(rows):
            nbytes = (block * int(width) + 7) // 8
            data = raw[starts[rows][:, None] + 7 + np.arange(nbytes)]
            grid[rows] = unpack_bits(data, int(width))
    last = count - 1
    if sizes[last] < block and widths[last]:
        width, size = int(widths[last]), int(sizes[last])
        data = raw[starts[last] + 7 : starts[last] + 7 + (size * width + 7) // 8]
        bits = np.unpackbits(data, bitorder="little")[: size * width].reshape(size, width)
        grid[last, :size] = bits @ (1 << np.arange(width, dtype=np.int64))
    rows = np.repeat(np.arange(count), exceptions)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = (starts[:-1] + HEAD.itemsize + (sizes * widths + 7) // 8)[rows]
    where = raw[(lists + 2 * nth)[:, None] + np.arange(2)].reshape(-1).view("<u2")
    parts = raw[(lists + 2 * exceptions[rows] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    grid[rows, where] += parts.astype(np.int64) << widths[rows]
    grid += heads["low"].astype(np.int64)[:, None]
    return out[:n]


def utf8(column: pa.LargeStringArray | pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and the last ends."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Known(dict):
    """Ids of pieces met lately. Once full it starts afresh, and takes over from the last generation what comes up again."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.last = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.last.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids

    def renew(self) -> None:
        if len(self) > CACHE_WORDS:
            self.last = dict(self)
            self.clear()


class WordEncoder:
    """Ids of texts with a tokenizer that drops white space, piece by piece.

    Such a tokenizer never joins anything across white space, so a text's ids are those of its words. Of words in ASCII
    and Latin letters the pieces are known beforehand (PIECE): they are lowered and cut for a whole batch at once, and go
    straight to the tokenizer's model, as its normaliser and pre-tokenizer would hand them over. Words with another
    character or with what may be a short form ('s, 'll) are a piece each, for the whole tokenizer. Pieces recur: a batch
    looks each of its own up once, and each worker encodes one once. Texts with a special token or U+0000 go through the
    tokenizer as they are, and so do all words if it is not one that cuts like this.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Known(self.ids)
        self.model = self.tokenizer.model
        self.apart = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), "\x00"]
        # Byte-level alphabets show printable bytes as themselves and number the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.letters = {ord(c): "".join(hidden.get(b, chr(b)) for b in c.encode()) for c in map(chr, range(192, 256))}
        self.direct = all(self.whole(t).tolist() == [i for p in pieces for i in self.piece(p)] for t, pieces in CUTS.items())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]

    def ids(self, piece: str) -> bytes:
        if piece[0] in WHITE:
            return b""
        if self.direct and (piece.isascii() and piece.isalpha() and piece.islower() or PIECE.fullmatch(piece)):
            return array("I", self.piece(piece)).tobytes()
        words = piece.split()
        if len(words) > 1 and not any(c in piece for c in PYTHON_WHITE):
            return b"".join(map(self.known.__getitem__, words))
        return self.whole(piece).tobytes()

    def cut(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of texts that begin at ``begins``: the bytes, lowered where they are cut, and where each piece starts.
        White space is a piece too."""
        kinds, low = KINDS[raw], LOWER[raw]
        if self.direct:
            second = np.flatnonzero(raw == 0xC3) + 1
            second = second[(raw[second] != 0x97) & (raw[second] != 0xB7)]  # all but the signs of times and division
            kinds[second - 1] = kinds[second] = LETTER
            low[second] += np.where(raw[second] < 0x9F, 32, 0).astype(np.uint8)
        else:
            kinds[kinds != SPACE] = OTHER
        starts = kinds == DIGIT
        starts[1:] |= kinds[1:] != kinds[:-1]
        starts[begins] = True
        quotes = np.flatnonzero(raw[:-1] == ord("'"))
        kinds[quotes[SHORT[low[quotes + 1]]]] = OTHER
        others = np.flatnonzero(kinds == OTHER)
        if len(others):
            spaces = kinds == SPACE
            ends = spaces.copy()
            ends[begins] = True
            ends = np.append(np.flatnonzero(ends), len(raw))
            nth = np.unique(np.searchsorted(ends, others, "right"))  # the ends after words that hold one
            first = ends[nth - 1] + spaces[ends[nth - 1]]
            within = np.zeros(len(raw) + 1, np.int8)
            within[first] += 1
            within[ends[nth]] -= 1
            within = np.cumsum(within[:-1], dtype=np.int8).view(bool)
            starts &= ~within
            starts[first] = True
            low[within] = raw[within]
        return low, np.flatnonzero(starts)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is the empty text."""
        self.known.renew()
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        raw, bounds = utf8(column)
        alone = {}
        if any(s.encode() in bytes(raw) for s in self.apart):
            apart = np.any([pc.match_substring(column, s).to_numpy(zero_copy_only=False) for s in self.apart], axis=0)
            alone = {i: self.whole(column[i].as_py()) for i in np.flatnonzero(apart).tolist()}
            raw, bounds = utf8(pc.if_else(pa.array(apart), pa.scalar("", pa.large_string()), column))
        if len(raw):
            low, starts = self.cut(raw, bounds[:-1][bounds[:-1] < len(raw)])
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(low)).dictionary_encode()
            known = pa.array(list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.large_binary())
            data, places = utf8(known.take(pieces.indices))
            ids, at = data.view(np.uint32), places[np.searchsorted(starts, bounds)] // 4
        else:
            ids, at = np.empty(0, np.uint32), bounds
        return [alone[i] if i in alone else ids[a:b] for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``size`` bytes: the more texts, the fewer pieces are looked up for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, with what it remembers, across tasks, until another operator remembers something."""
    return remembered(f"tokens {path}", lambda: WordEncoder(path))


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes every document and writes the store at ``out``. The texts are shuffled once, by ranges of doc_id."""
    short_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, doc_ids, held, segment, before
            row = {"shard": [shard], "segment": [segment], "shard_start": [before], "doc_ids": [doc_ids], "lengths": [[len(x) for x in ids]], "payload": [pack_blocks(np.concatenate(ids))]}
            segment, before, ids, doc_ids, held = segment + 1, before + held, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])
        for batch in gathered(batches):
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids.append(np.append(got, end_id).astype(np.int64))
                doc_ids.append(doc_id)
                held += len(got) + 1
                if held >= SEGMENT_IDS:
                    yield close()
        if ids:
            yield close()
        trim()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENT).write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) for each document of a store. Only totals of shards are put in order."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    extra = ", ids array<int>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_blocks(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                parts = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array([row["shard"]] * len(parts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["shard_start"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["shard", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    decoded = segments.mapInArrow(decode, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + extra)
    return decoded.join(bases, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"][: int(with_ids)])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` to a store in the shared folder and reads it back."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'tokens').path}/store"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
