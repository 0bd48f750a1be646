"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often which ids do.

A text is encoded by both, with a space before it: A is a byte-level BPE (a ``tokenizers`` file), B a ``sentencepiece``
model that adds the space itself. Inside ``mapInPandas`` the cumulative ends of both token sequences, in bytes, are
merged; common ends cut the text into groups, and the last A and last B token of a group are linked. Each task gives
the different id pairs of every document with their counts; Spark counts the pairs of the corpus by ``groupBy``, finds
the highest count of each A id and each B id, and joins both back to the documents' links.

Neither tokenizer joins anything over a space that follows a character other than white space (B's pieces are looked
through for it when it is loaded), so texts are encoded in units that begin at such spaces, and a worker remembers the
units that it met lately. Units of a batch that it does not know go to the libraries together.

Defined cases: null and empty texts, and texts whose joined token bytes differ from the space and the text (U+2581 is
read as a space by B), have no tokens: all counts are 0 and ``groups`` is empty; repeated doc_ids are documents of
their own; an empty table gives an empty result; further columns of the documents are ignored. Ids without bytes do not
occur in either kind of file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch, release, remembered, short_batches, trim

#: The pre-tokenizer's pattern of byte-level BPE files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Units in a generation of those that a worker remembers, some 400 bytes each; it keeps two generations.
CACHE_UNITS = 150_000
#: Longer units are not remembered.
UNIT = 64
#: Up to so many id pairs, some 60 bytes each, go to all executors at once; beyond, their links are shuffled.
BROADCAST_PAIRS = 1_500_000
#: In shuffles a pair with more than this part of all links is hot and goes by broadcast: there are fewer than 1/HOT.
HOT = 0.001
_AFTER_SPACE = re.compile(r"\s ")
_STARTS = re.compile(r"(?<=\S)(?= )")


def shown_bytes() -> dict[str, int]:
    """Byte-level alphabets show printable bytes as themselves and number the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A: ids and bytes of a byte-level BPE file without normaliser; special tokens in texts are plain text.

    Where the file's ids are its merges in order, they are the ranks by which tiktoken merges; it gives the same ids
    several times as fast. Other files, and texts on which it fails, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, alphabet = {t["content"] for t in spec["added_tokens"]}, shown_bytes()
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(alphabet.__getitem__, token))
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        first = len(vocabulary) - len(merges)
        self.fast = None
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and all(vocabulary.get(m.replace(" ", "")) == first + k for k, m in enumerate(merges)):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= 10 * UNIT:
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """B: ids and bytes of a sentencepiece model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.last: dict[str, tuple[bytes, bytes, bool]] = {}
        # Ids with what follows them in the text of groups, as rows of bytes padded with zeros.
        width = len(str(max(len(self.a.bytes), len(self.b.bytes)))) + 1
        self.shown = [np.array([str(i).encode() + after for i in range(max(len(self.a.bytes), len(self.b.bytes)))], f"S{width}").view(np.uint8).reshape(-1, width) for after in (b",", b"|", b";")]
        self.shown = np.concatenate(self.shown)
        self.ids = len(self.shown) // 3

    def units(self, text: str) -> list[str]:
        """A space and the text, cut before each space that follows something other than white space; without the space
        that each unit begins with."""
        if not self.b.splits:
            return [text]
        apart = _AFTER_SPACE.search(text) or text[0] == " "
        units = [u[1:] for u in _STARTS.split(" " + text)] if apart else text.split(" ")
        if len(units) > 1 and not units[-1]:
            # B gives nothing for a unit of the space alone.
            units[-2:] = [units[-2] + " "]
        return units

    def learn(self, units: set[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of both for units, and whether they give the unit back."""
        found = {}
        units = list(units)
        for unit, b in zip(units, self.b.encode(units), strict=True):
            raw, a = (" " + unit).encode(), self.a.encode(" " + unit)
            whole = b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
            found[unit] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes(), whole)
        return found

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where they do not give the text back."""
        if len(self.known) > CACHE_UNITS:
            self.known, self.last = {}, self.known
        units = [self.units(t) if t else [] for t in texts]
        missing, known = set().union(*units).difference(self.known), self.known
        again = missing.intersection(self.last)
        known.update((u, self.last[u]) for u in again)
        new = self.learn(missing - again)
        known.update((u, x) for u, x in new.items() if len(u) <= UNIT)
        long = {u: x for u, x in new.items() if len(u) > UNIT}
        for text, parts in zip(texts, units, strict=True):
            got = [known[u] if u in known else long[u] for u in parts] if long else [known[u] for u in parts]
            a, b = (np.frombuffer(b"".join([g[k] for g in got]), "<u4").astype(np.int64) for k in (0, 1))
            if not all([g[2] for g in got]):
                raw = (" " + (text or "")).encode()
                if any(b"".join(map(t.bytes.__getitem__, x.tolist())) != raw for t, x in ((self.a, a), (self.b, b))):
                    a = b = a[:0]
            yield a, b

    def merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, the places of its last A and its last B token: the two ascending lists of ends are merged, and
        what is in both is next to its like. (A stable sort of two ascending lists is one merge of them.)"""
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        merged = np.concatenate([a_ends, b_ends])
        merged.sort(kind="stable")
        common = merged[1:][merged[1:] == merged[:-1]]
        return np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)

    def groups(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``"""
        a_counts, b_counts = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        out = np.empty(len(a) + len(b), np.int64)
        a_after, b_after = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_after[a_last], b_after[b_last] = 1, 2
        out[np.arange(len(a)) + np.repeat(np.cumsum(b_counts) - b_counts, a_counts)] = a + a_after * self.ids
        out[np.arange(len(b)) + np.repeat(np.cumsum(a_counts), b_counts)] = b + b_after * self.ids
        flat = self.shown[out].ravel()
        return flat[flat != 0].tobytes()[:-1]


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, across tasks, until another operator remembers something."""
    return remembered(f"alignment {a_path} {b_path}", lambda: Aligner(a_path, b_path))


def links(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """For each document its row, counts, the digest of its groups (and their text) and its different linked id pairs
    (A id * number of B ids + B id) with how often it links them."""
    short_batches(docs.sparkSession)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a_path, b_path)
        for frame in frames:
            rows = []
            for a, b in both.encode(frame["text"].tolist()):
                if not len(a):
                    rows.append((0, 0, 0, "", "", [], []))
                    continue
                a_last, b_last = both.merge(a, b)
                text = both.groups(a, b, a_last, b_last)
                pairs, times = np.unique(a[a_last] * len(both.b.bytes) + b[b_last], return_counts=True)
                rows.append((len(a), len(b), len(a_last), hashlib.sha256(text).hexdigest(), text.decode() if with_groups else "", pairs, times.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups_sha256", "groups", "pairs", "times"])
            out.insert(0, "row", frame["row"].to_numpy())
            out.insert(1, "doc_id", frame["doc_id"].to_numpy())
            yield out if with_groups else out.drop(columns="groups")
        trim()

    # pandas has no integers with nulls: doc_ids go to Python and back as text.
    kept = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "row long, doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string," + (" groups string," if with_groups else "") + " pairs array<long>, times array<int>"
    return kept.mapInPandas(emit, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id), count_sum,
    n_best_a (likewise of their A id) and groups_sha256 (and groups) of each document."""
    scratch = Scratch(docs.sparkSession, "alignment")
    found = scratch.keep(links(docs, a_path, b_path, with_groups), "links")
    release(docs.sparkSession)
    b_ids = pair_base(b_path)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_")).select("row", F.col("_.pairs").alias("pair"), F.col("_.times").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("docs"))
    counts = scratch.keep(counts.select("*", F.expr(f"pair div {b_ids}").alias("a"), F.expr(f"pair % {b_ids}").alias("b")), "counts")
    # One row an id: no more than either vocabulary has.
    best_a, best_b = (counts.groupBy(side).agg(F.max("count").alias(f"best_{side}")) for side in "ab")
    rated = counts.join(F.broadcast(best_a), "a").join(F.broadcast(best_b), "b")
    rated = scratch.keep(rated.select("pair", "docs", "count", (F.col("count") == F.col("best_a")).alias("is_best_a"), (F.col("count") == F.col("best_b")).alias("is_best_b")), "rated")
    n_pairs, n_links = rated.agg(F.count("*"), F.sum("docs")).first()
    joined = with_counts(each, rated, n_pairs, n_links or 0, broadcast_pairs)
    sums = joined.groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("is_best_b"), F.col("n"))).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("is_best_a"), F.col("n"))).alias("n_best_a"),
    )
    whole = found.drop("pairs", "times").join(sums, "row", "left")
    whole = whole.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_links", "n_best", "count_sum", "n_best_a")})
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a", *["groups"][: int(with_groups)])


def with_counts(each: DataFrame, rated: DataFrame, n_pairs: int, n_links: int, broadcast_pairs: int) -> DataFrame:
    """Links with their pair's counts. Beyond ``broadcast_pairs`` only hot pairs go by broadcast and all others by
    shuffle, so that no task gets much more than HOT of the links for one pair."""
    rated, docs = rated.drop("docs"), rated
    if n_pairs <= broadcast_pairs:
        return each.join(F.broadcast(rated), "pair")
    hot = docs.filter(F.col("docs") > HOT * n_links).drop("docs")
    cold = docs.filter(F.col("docs") <= HOT * n_links).drop("docs")
    rest = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
    return each.join(F.broadcast(hot), "pair").unionByName(rest.join(cold, "pair"))


def pair_base(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
