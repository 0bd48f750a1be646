"""Periodic runs of words within documents, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least
``max(LEAST, POWER * q)`` words. So every run consists of overlapping repeats ``w`` of exactly that length, which are
tandem repeats (POWER is even), and the method's three steps find them:

1. *Leftmost-covering repeats.* The documents of an Arrow batch are split into Lempel-Ziv blocks (longest earlier
   factors, from suffix arrays by prefix doubling). The leftmost place of a repeat never lies within a block, so its
   run goes over the start or the end of a block, and that block has at least 3q/2 words. Extensions to both sides for
   every such boundary and period give the runs that hold all leftmost repeats. Blocks of under three words cannot
   hold any, hence a document in which no three words in a row come twice has no blocks to look at.
2. *Complete vocabulary.* In the suffix tree of a document that has such runs, the repeat at a run's start is marked,
   and suffix links lead from each marked repeat ``aw'`` to ``w'a``, as long as that occurs and is not marked.
3. *Located occurrences.* The leaves below the marks are the places of all repeats; places in a row merge into runs.

A task holds one batch of documents at a time, with some 4 bytes a word for each doubling up to the longest repeat.

Defined cases: null and empty texts have no words and no runs, and collapse to the empty text; runs never cross
documents; repeated doc_ids are documents of their own; very long texts go through whole; an empty table gives an empty
result; further columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispark.llm.common import forget, mapped, mix64, short_batches

#: Shortest run in words, and in periods.
LEAST, POWER = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"
#: Words of the documents that are looked at together; a longer document is looked at alone.
GROUP_WORDS = 500_000


class Suffixes:
    """Suffix array, common prefixes and extensions of documents laid end to end, whose words differ between documents.

    ``names[j][i]`` tells apart the substrings of 2**j words at i; they come from prefix doubling, which only sorts what
    is not unique yet.
    """

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        _, first, counts = np.unique(words, return_inverse=True, return_counts=True)
        starts = np.cumsum(counts) - counts
        rank = starts[first]
        open_ = np.flatnonzero(counts[first] > 1)
        self.names = [self._padded(rank)]
        step = 1
        while len(open_):
            after = open_ + step
            key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            at, key = open_[order], key[order]
            group = rank[at]
            new_group = np.append(True, group[1:] != group[:-1])
            new_key = np.append(True, key[1:] != key[:-1])
            places = np.arange(len(at))
            within = places - np.maximum.accumulate(np.where(new_group, places, 0))
            rank[at] = (group + within)[np.maximum.accumulate(np.where(new_key, places, 0))]
            single = new_key & np.append(new_key[1:], True)
            open_ = np.sort(at[~single])
            self.names.append(self._padded(rank))
            step *= 2
        self.rank = rank
        self.sa = np.empty(n, np.int64)
        self.sa[rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        if n > 1:
            self.lcp[1:] = self.forward(self.sa[:-1], self.sa[1:])

    @staticmethod
    def _padded(rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int32)

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and y (x differs from y) on are equal."""
        got = np.zeros(len(x), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names = self.names[j]
            got += (names[np.minimum(x + got, self.n)] == names[np.minimum(y + got, self.n)]).astype(np.int64) << j
        return got

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x and y are equal, going left."""
        got = np.zeros(len(x), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, a, b = self.names[j], x - got - (1 << j), y - got - (1 << j)
            got += ((np.minimum(a, b) >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << j
        return got


def blocks(s: Suffixes, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the Lempel-Ziv blocks of at least ``least`` words: longest factors that start earlier too.
    Suffixes are taken out of the suffix array from the last place on, so that neighbours are the earlier ones."""
    shares = s.lcp >= least
    places = np.flatnonzero(shares | np.append(shares[1:], False))
    at = s.sa[places]
    common = np.where(shares[places], s.lcp[places], 0).tolist() + [0]
    before = list(range(-1, len(at) - 1))
    after = list(range(1, len(at) + 1))
    longest = np.zeros(len(at), np.int64)
    order = np.argsort(-at, kind="stable").tolist()
    for k in order:
        p, q = before[k], after[k]
        left, right = common[k], common[q]
        longest[k] = left if left > right else right
        common[q] = left if left < right else right
        if p >= 0:
            after[p] = q
        if q < len(at):
            before[q] = p
    starts, lengths, end = [], [], 0
    for k in reversed(order):
        if longest[k] >= least and at[k] >= end:
            starts.append(at[k])
            lengths.append(longest[k])
            end = at[k] + longest[k]
    return np.array(starts, np.int64), np.array(lengths, np.int64)


def covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of runs that hold every leftmost repeat: those over a block's start or end."""
    begin, size = blocks(s)
    upto = 2 * size // 3
    period = np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto) + 1
    b, h = np.repeat(begin, upto), np.repeat(begin + size, upto)
    found = []
    for x, y, back in ((b, b + period, 0), (b - period, b, 0), (h - period, h, 3)):
        # At least three words have to be equal on the block's side.
        k = np.flatnonzero((x - back >= 0) & (y - back + 2 < s.n))
        for step in range(3):
            k = k[s.names[0][x[k] - back + step] == s.names[0][y[k] - back + step]]
        x, y = x[k], y[k]
        start, end = x - s.backward(x, y), y + s.forward(x, y)
        keep = end - start >= np.maximum(LEAST, POWER * period[k])
        found.append(np.stack([start[keep], end[keep], period[k][keep]]))
    start, end, period = np.concatenate(found, 1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # A run's multiples of its period come to the same start and end: the smallest is the period.
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.empty(0, bool)
    return start[first], end[first], period[first]


class Tree:
    """The suffix tree of the document at [begin, end): nodes are intervals of its suffix array; leaves are ~place."""

    def __init__(self, s: Suffixes, begin: int, end: int):
        self.words, self.end = s.names[0], end
        self.sa = s.sa[begin:end].tolist()
        lcp = s.lcp[begin:end].tolist()
        lcp[0] = 0
        self.depth, self.low, self.high, self.parent = [0], [0], [len(self.sa) - 1], [-1]
        self.leaf_parent: dict[int, int] = {}
        self.children: dict[tuple[int, int], int] = {}
        self.link = {0: 0}
        path = [0]
        for k, place in enumerate(self.sa):
            shared, last = lcp[k], None
            while self.depth[path[-1]] > shared:
                last = path.pop()
                self.high[last] = k - 1
            top = path[-1]
            if self.depth[top] < shared:
                # What was the last child so far hangs below a new node.
                node = len(self.depth)
                self.depth.append(shared)
                self.low.append(self.low[last] if last is not None else k - 1)
                self.high.append(-1)
                self.parent.append(top)
                child = last if last is not None else ~self.sa[k - 1]
                self._hang(top, node)
                self._hang(node, child)
                path.append(node)
                top = node
            self._hang(top, ~place)
        for node in path:
            self.high[node] = len(self.sa) - 1

    def _hang(self, node: int, child: int) -> None:
        place = ~child if child < 0 else self.sa[self.low[child]]
        at = place + self.depth[node]
        self.children[node, int(self.words[at]) if at < self.end else -1] = child
        if child < 0:
            self.leaf_parent[place] = node
        else:
            self.parent[child] = node

    def down(self, node: int, place: int, length: int) -> int:
        """Below ``node``, the node at or under the word string of ``length`` words at ``place``, which occurs."""
        while node >= 0 and self.depth[node] < length:
            node = self.children[node, int(self.words[place + self.depth[node]])]
        return node

    def suffix_link(self, node: int) -> int:
        path = [node]
        while path[-1] not in self.link:
            path.append(self.parent[path[-1]])
        at = self.link[path.pop()]
        for node in reversed(path):
            at = self.link[node] = self.down(at, self.sa[self.low[node]] + 1, self.depth[node] - 1)
        return at

    def locus(self, place: int, length: int) -> int:
        node = ~place
        up = self.leaf_parent[place]
        while self.depth[up] >= length:
            node, up = up, self.parent[up]
        return node

    def rotated(self, node: int, length: int) -> int | None:
        """From the locus of ``aw'``, by the suffix link of the node above, that of ``w'a`` if that occurs."""
        place = ~node if node < 0 else self.sa[self.low[node]]
        up = self.leaf_parent[place] if node < 0 else self.parent[node]
        node = self.down(self.suffix_link(up), place + 1, length - 1)
        first = int(self.words[place])
        if node >= 0 and self.depth[node] == length - 1:
            return self.children.get((node, first))
        inner = ~node if node < 0 else self.sa[self.low[node]]
        at = inner + length - 1
        return node if at < self.end and int(self.words[at]) == first else None

    def places(self, node: int) -> list[int]:
        return [~node] if node < 0 else self.sa[self.low[node] : self.high[node] + 1]


def runs_of(tree: Tree, begin: int, starts: list[int], periods: list[int]) -> list[tuple[int, int, int]]:
    """start, length and period of all runs of a document, from the covering ones."""
    marked: dict[int, set[int]] = {}
    found: dict[int, list[int]] = {}
    for start, period in zip(starts, periods, strict=True):
        size = max(LEAST, POWER * period)
        marks = marked.setdefault(period, set())
        node = tree.locus(start, size)
        while node is not None and node not in marks:
            marks.add(node)
            found.setdefault(period, []).extend(tree.places(node))
            node = tree.rotated(node, size)
    out = []
    for period, places in found.items():
        at = np.sort(np.array(places, np.int64))
        cuts = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
        out += [(int(a) - begin, int(b - a) + max(LEAST, POWER * period), period) for a, b in zip(first, last, strict=True)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """start, length and period of the runs of each document, given as lists of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    group: list[int] = []
    held = 0
    for k, words in enumerate(documents):
        if len(words) >= LEAST:
            if group and held + len(words) > GROUP_WORDS:
                _runs_of_group(documents, group, out)
                group, held = [], 0
            group.append(k)
            held += len(words)
    if group:
        _runs_of_group(documents, group, out)
    return out


def _runs_of_group(documents: list[list[bytes]], group: list[int], out: list[list[tuple[int, int, int]]]) -> None:
    sizes = np.array([len(documents[k]) for k in group])
    flat = pa.array([w for k in group for w in documents[k]], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(group)), sizes)
    # Three words in a row that come twice in a document: by hashes, so that some documents without any stay too.
    key = mix64(flat[:-2] * 3 + 1) ^ mix64(mix64(flat[1:-1] * 5 + 2) + np.uint64(1)) ^ mix64(mix64(flat[2:] * 7 + 3) + np.uint64(2)) ^ mix64(mix64(of[:-2] * 11 + 5) + np.uint64(3))
    order = np.argsort(key)
    key = key[order]
    twice = np.unique(of[order[1:][key[1:] == key[:-1]]])
    if not len(twice):
        return
    keep = np.isin(of, twice)
    sizes, flat, of = sizes[twice], flat[keep], np.repeat(np.arange(len(twice)), sizes[twice])
    suffixes = Suffixes(of * (flat.max() + 1) + flat)
    start, _, period = covering(suffixes)
    ends = np.cumsum(sizes)
    for d in np.unique(of[start]) if len(start) else ():
        mine = of[start] == d
        begin = int(ends[d] - sizes[d])
        out[group[twice[d]]] = runs_of(Tree(suffixes, begin, int(ends[d])), begin, start[mine].tolist(), period[mine].tolist())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without the words that repeat
    the first period of a run, joined by one space. Words are runs of anything but ASCII white space."""
    short_batches(docs.sparkSession)
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        forget()
        words = [t.encode().split() if t else [] for t in batch.column(1).to_pylist()]
        found = runs(words)
        texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.array([r for rs in found for r in rs], np.int64).reshape(-1, 3)
        parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(*f) for f in fields])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return mapped(docs.select("doc_id", "text"), find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
