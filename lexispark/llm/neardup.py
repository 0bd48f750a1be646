"""Near-duplicate documents by DartMinHash signatures, banded candidates and exact checks.

A document is the weighted set of its runs of SHINGLE words (lower case, split at ASCII white space); the weight is
the number of occurrences, and similarity is the weighted Jaccard index. Every unit of weight of an element is a region
into which darts fall at hashed times (a Poisson process seeded by element and unit). A document keeps the darts up to
a time at which about COORDINATES * (ln COORDINATES + 4) of them have fallen, whatever its length; every dart is
hashed to a coordinate, and each coordinate keeps its earliest dart. Two documents agree in a coordinate with a
probability equal to their similarity.

Equal texts are collapsed first, so groups of copies cost one row each. Signatures are cut into bands; documents that
share a band form a bucket, whose smallest id leads it. Members are checked against leaders (exact similarity of the
whole texts), first one most-shared leader each, then what does not follow from the components found. Buckets that
still hold several components are then searched for links between members of different components. Shingles that no
other member has cannot be shared: a member with too many of them has no further link at all, which settles documents
that have a common passage and otherwise their own words; this and the sizes bound a pair's similarity exactly. A pair
is also passed over if more places of two sketches of the signatures (PLANES bits a place) differ than do, but for some
6 pairs in a million, at the least similarity (DEVIATIONS; bands miss 640 in a million there); of the buckets that a
pair shares, only the first gives it. Components are found by rounds of joins; nothing is collected.

Defined cases: documents without words (null, empty, white space) are never linked, not even with each other;
documents shorter than a shingle are one shingle; null doc_ids are never linked; rows that repeat a doc_id are classed
by their own texts, and one row of each class is kept; an empty table gives an empty result; further columns are kept
by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import Scratch, forget, fresh, mix64, short_batches, trim, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
COORDINATES = BANDS * ROWS
#: Shingles of the documents whose darts are thrown together.
SHINGLES_AT_ONCE = 200_000
#: Bits of each coordinate in a sketch.
PLANES = 3
#: Standard deviations that a sketch's differing bits may exceed what is expected at the least similarity.
DEVIATIONS = 4.5
#: Open members of a bucket that are compared with all of it in one task.
SLICE = 1000
#: Up to so many ids, the candidates' ids go to the documents by broadcast; beyond that, by a shuffled join.
BROADCAST_IDS = 250_000
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


class Shingler:
    """64-bit hashes of words, remembered by the worker."""

    def __init__(self, limit: int = 150_000):
        self.known, self.limit = {}, limit

    def shingles(self, text: str | None) -> np.ndarray:
        """Hashes of all runs of SHINGLE words, in order; one hash for fewer words, none for no words."""
        tokens = words(text.lower()) if text else []
        if not tokens:
            return np.empty(0, _U)
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, tokens), _U, len(tokens))
        width = min(SHINGLE, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, _U)
        for i in range(width):
            out = (out ^ (out >> _U(31))) * _MULT + h[i : i + n]
        return mix64(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard index of two multisets of hashes."""
    if not len(a) or not len(b):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both)


def dart_signatures(sets: list[np.ndarray], k: int = COORDINATES, slack: float = 4.0) -> np.ndarray:
    """One row of k earliest darts for each multiset of hashes; rows of empty sets are 0."""
    out = np.zeros((len(sets), k), _U)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], int)
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        elements = np.concatenate([sets[i] for i in todo])
        # Units of weight: the second occurrence of an element is a region of its own, and so on.
        order = np.lexsort((elements, owner))
        owner, elements = owner[order], elements[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (elements[1:] != elements[:-1])
        at = np.arange(len(owner))
        unit = at - np.maximum.accumulate(np.where(new, at, 0))
        cell = mix64(elements + unit.astype(_U) * _MULT)
        until = (k * (math.log(k) + slack) / sizes)[owner]
        time = np.zeros(len(cell))
        best = np.full(len(todo) * k, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        throw = 0
        while len(cell):
            throw += 1
            dart = mix64(cell + _U(throw * int(_MULT) % 2**64))
            time = time - np.log1p(-((dart >> _U(11)).astype(np.float64) * 2.0**-53))
            alive = time <= until
            cell, until, time, owner, dart = cell[alive], until[alive], time[alive], owner[alive], dart[alive]
            value = mix64(dart ^ _MULT)
            slot = owner * k + (value % _U(k)).astype(np.int64)
            np.minimum.at(best, slot, time)
            darts.append((slot, time, value))
        signature = np.zeros(len(todo) * k, _U)
        for slot, time, value in darts:
            first = best[slot] == time
            signature[slot[first]] = value[first]
        full = np.isfinite(best).reshape(len(todo), k).all(1)
        out[todo[full]] = signature.reshape(len(todo), k)[full]
        todo, slack = todo[~full], slack * 2
    return out


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    cut = signatures.reshape(len(signatures), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _MULT, cut.shape[:2]).copy()
    for i in range(cut.shape[2]):
        out = mix64(out ^ cut[:, :, i]) * _MULT
    return out.view(np.int64)


def bit_sketches(signatures: np.ndarray) -> np.ndarray:
    """PLANES bits of each coordinate, a plane packed into int64s after the other. Places of two documents differ in a
    share of (1 - similarity) * (1 - 2 ** -PLANES)."""
    planes = []
    for plane in range(PLANES):
        bits = np.packbits(((signatures >> _U(plane)) & _U(1)).astype(np.uint8), axis=1)
        planes.append(np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.int64))
    return np.ascontiguousarray(np.concatenate(planes, axis=1))


def most_differing(least: float, k: int = COORDINATES) -> int:
    share = (1 - least) * (1 - 2.0**-PLANES)
    return math.ceil(k * share + DEVIATIONS * math.sqrt(k * share * (1 - share)))


def text_digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, band hashes, number of shingles, bit sketch, for documents with words and id."""
    short_batches(docs.sparkSession)

    def some_at_once(sets: list[np.ndarray]) -> Iterator[list[int]]:
        """The sets that are not empty, in groups of bounded size (one set at least)."""
        group, held = [], 0
        for i, s in enumerate(sets):
            if len(s):
                if group and held + len(s) > SHINGLES_AT_ONCE:
                    yield group
                    group, held = [], 0
                group.append(i)
                held += len(s)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(t) for t in batch.column(1).to_pylist()]
            for some in some_at_once(sets):
                yield sketched(batch, sets, some)
        shingler.known.clear()
        trim()

    def sketched(batch: pa.RecordBatch, sets: list[np.ndarray], some: list[int]) -> pa.RecordBatch:
        signatures = dart_signatures([sets[i] for i in some])
        bands, bits = band_hashes(signatures), bit_sketches(signatures)
        lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands, bits))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(some)), batch.column(2).take(pa.array(some)), next(lists), pa.array([len(sets[i]) for i in some], pa.int64()), next(lists)],
            ["doc_id", "digest", "bands", "size", "bits"],
        )

    kept = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest(F.col("text")).alias("digest"))
    return kept.mapInArrow(run, "doc_id long, digest binary, bands array<long>, size long, bits array<long>")


def verify(edges: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The rows a, b of ``edges`` whose texts have the similarity; ``texts(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        known: dict[int, np.ndarray] = {}

        def of(doc_id: int, text: str) -> np.ndarray:
            if doc_id not in known:
                if len(known) >= 64:
                    known.clear()
                known[doc_id] = shingler.shingles(text)
            return known[doc_id]

        for batch in batches:
            a, ta, b, tb = (batch.column(c).to_pylist() for c in range(4))
            good = [similarity(of(w, x), of(y, z)) >= least for w, x, y, z in zip(a, ta, b, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        shingler.known.clear()
        trim()

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return edges.join(left, "a").join(right, "b").select("a", "text_a", "b", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component (its smallest id) for the ids of ``edges(a, b)``; rounds of min-label joins with pointer jumping."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-graph")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        # The label's own label: paths halve with every round.
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = labels.join(near, "id").join(jump, "component").select("id", F.least("component", "seen", "further").alias("component"), F.col("component").alias("was"))
        new = scratch.keep(new, f"{name}-{step}")
        changed = new.filter(F.col("component") != F.col("was")).limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


def extend(known: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component with ``links(a, b)`` added to ``known``: components are found on the graph of known components."""
    old = known.withColumnRenamed("component", "old")
    ends = links.select(F.col("a").alias("id"), "b").join(old, "id", "left").select(F.coalesce("old", "id").alias("a"), F.col("b").alias("id"))
    ends = ends.join(old, "id", "left").select("a", F.coalesce("old", "id").alias("b"))
    joined = components(ends.filter("a <> b").distinct(), scratch, name).withColumnRenamed("id", "old")
    new = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().join(known, "id", "left_anti")
    every = old.unionByName(new.select("id", F.col("id").alias("old")))
    return scratch.keep(every.join(joined, "old", "left").select("id", F.coalesce("component", "old").alias("component")), name)


def cluster(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id, n_tree_links, leads for each document with id: class_id is the smallest doc_id of its class,
    n_tree_links the number of links of its text to different texts that were verified to connect components, leads whether it is the one that stays."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    sketch = scratch.keep(sketches(docs), "sketches")
    reps = sketch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    members = sketch.select("doc_id", "digest")
    # Texts are numbered in the order of their smallest doc_ids, which several texts may have.
    reps = scratch.keep(reps.orderBy("first_id", "digest").withColumn("rep", F.monotonically_increasing_id()), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    shared = scratch.keep(buckets.join(leaders.drop("size"), "bucket"), "shared")
    candidates = scratch.keep(
        shared.filter(F.col("rep") != F.col("leader")).groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("bands")), "candidates"
    )
    texts = _texts(docs, reps.join(shared.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "first_id", "digest"), scratch)

    first = candidates.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    linked = scratch.keep(verify(first, texts, least), "links-1")
    known = components(linked, scratch, "components-1")
    rest = candidates.select("a", "b").join(first, ["a", "b"], "left_anti")
    more = scratch.keep(verify(_across(rest, known), texts, least), "links-2")
    linked, known = linked.unionByName(more), extend(known, more, scratch, "components-2")

    # What leaders have not settled: members of one bucket in different components.
    placed = shared.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = scratch.keep(placed.select("bucket", "rep", "component"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    open_ = scratch.keep(placed.join(mixed, "bucket"), "open")
    own = scratch.keep(own_shingles(texts.join(open_.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")), "own")
    facts = reps.select("rep", "size", "bits", "bands").join(own.withColumnRenamed("id", "rep"), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    open_ = open_.join(facts.filter(F.col("size") - F.col("own") >= F.col("size") * F.lit(least)), "rep")
    open_ = scratch.keep(open_, "open-2")
    # A bucket's member with the smallest share of own shingles is what its variants have in common: most links are its.
    hubs = open_.groupBy("bucket").agg(F.min(F.struct(F.col("own") / F.col("size"), "rep", "component")).alias("hub"))
    spokes = open_.join(hubs, "bucket").filter(F.col("component") != F.col("hub.component"))
    spokes = spokes.select(F.greatest("rep", "hub.rep").alias("a"), F.least("rep", "hub.rep").alias("b")).distinct().join(candidates, ["a", "b"], "left_anti")
    spokes = scratch.keep(spokes, "spokes")
    more = scratch.keep(verify(spokes, texts, least), "links-3")
    linked, known = linked.unionByName(more), extend(known, more, scratch, "components-3")
    open_ = open_.drop("component").join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = scratch.keep(open_, "open-3")
    # A bucket with many members is compared in slices: each of them meets all of the bucket's members in a task of its own.
    sliced = open_.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices"))
    open_ = open_.join(sliced, "bucket")
    longs = -(-COORDINATES // 64)
    parts = range(longs * PLANES)
    dealt = {"a": F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("slices") - 1))}
    left, right = (open_.select("bucket", dealt[r].alias("slice"), *[F.col(c).alias(f"{r}_{c}") for c in ("rep", "component", "size", "own", "bands")], *[F.get("bits", F.lit(i)).alias(f"{r}{i}") for i in parts]) for r in "ab")
    unlike = [F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")) for i in parts]
    differing = sum((F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), unlike[i::longs])) for i in range(longs)), F.lit(0))
    bound = lambda x, y: F.col(f"{x}_size") - F.col(f"{x}_own") >= (F.col(f"{y}_size") + F.col(f"{x}_own")) * F.lit(least)
    alike = bound("a", "b") & bound("b", "a") & (differing <= most_differing(least))
    # Band hashes tell their band: what stands before the bucket's in both lists is where the pair may have met before.
    before = lambda r: F.slice(f"{r}_bands", F.lit(1), F.array_position("a_bands", left["bucket"]).cast("int") - 1)
    alike = alike & ~F.arrays_overlap(before("a"), before("b"))
    pairs = left.join(right, (left["bucket"] == right["bucket"]) & (left["slice"] == right["slice"]) & (F.col("a_rep") > F.col("b_rep")) & (F.col("a_component") != F.col("b_component")) & alike)
    pairs = pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()
    pairs = pairs.join(candidates.select("a", "b").union(spokes), ["a", "b"], "left_anti")
    more = scratch.keep(verify(pairs, texts, least), "links-4")
    linked, known = linked.unionByName(more), extend(known, more, scratch, "components-4")

    degrees = linked.select(F.col("a").alias("rep")).union(linked.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_tree_links"))
    classes = reps.select("digest", "rep", "first_id").join(known.withColumnRenamed("id", "rep"), "rep", "left").join(degrees, "rep", "left")
    classes = classes.select("digest", "rep", "first_id", F.coalesce("component", "rep").alias("component"), F.coalesce("n_tree_links", F.lit(0)).cast("long").alias("n_tree_links"))
    # The component is its smallest text's number, which has its smallest doc_id.
    joint = classes.filter("rep <> component").join(classes.select(F.col("rep").alias("component"), F.col("first_id").alias("class_id")), "component")
    alone = classes.filter("rep = component").withColumn("class_id", F.col("first_id"))
    classes = joint.select("digest", "class_id", "n_tree_links", F.lit(False).alias("top")).union(alone.select("digest", "class_id", "n_tree_links", F.lit(True)))
    return members.join(classes, "digest").select("doc_id", "digest", "class_id", "n_tree_links", (F.col("top") & (F.col("doc_id") == F.col("class_id"))).alias("leads"))


def _across(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges whose ends are not in one component already."""
    a, b = (known.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return edges.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def own_shingles(texts: DataFrame) -> DataFrame:
    """id, own: the weight of the shingles of each of ``texts(id, text)`` that no other one has (ids without any are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles, weights = np.unique(shingler.shingles(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), doc_id)), pa.array(shingles.view(np.int64)), pa.array(weights)], ["id", "shingle", "weight"])

    found = texts.select("id", "text").mapInArrow(run, "id long, shingle long, weight long").groupBy("shingle")
    alone = found.agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("weight").alias("weight")).filter("n = 1")
    return alone.groupBy("id").agg(F.sum("weight").alias("own"))


def _texts(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """id, text for ``wanted(id, first_id, digest)``."""
    wanted = scratch.keep(wanted, "ids")
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").filter(F.length("text") > 0).withColumn("digest", text_digest(F.col("text")))
    found = texts.join(F.broadcast(wanted) if small else wanted, ["first_id", "digest"])
    return scratch.keep(found.groupBy("id").agg(F.min("text").alias("text")), "texts")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_tree_links, kept for every row of ``docs``; a document that is never linked is its own class."""
    found = cluster(docs, least).dropDuplicates(["doc_id", "digest"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("doc_id")))
    out = rows.join(found, ["doc_id", "digest"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_tree_links", F.lit(0)).alias("n_tree_links"), (F.col("leads").isNull() | (F.col("leads") & (F.col("_rn") == 1))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class (of its smallest doc_id) of ``docs``; columns unchanged."""
    scratch = Scratch(docs.sparkSession, "neardup")
    own, gone, of = fresh(docs, "_digest", "_gone", "_gone_digest")
    rows = cluster(docs, least).groupBy(F.col("doc_id").alias(gone), F.col("digest").alias(of)).agg(F.first("leads").alias("leads"), F.count("*").alias("n"))
    # Rows to drop, and those that stay once though they are there several times.
    marked = scratch.keep(rows.filter("NOT leads OR n > 1"), "gone")
    n, repeated = marked.agg(F.count("*"), F.count_if("leads")).first()
    sent = (lambda df: F.broadcast(df)) if n <= BROADCAST_IDS else (lambda df: df)
    keyed = docs.withColumn(own, text_digest(F.col("text")))
    same = (F.col("doc_id") == F.col(gone)) & (F.col(own) == F.col(of))
    left = keyed.join(sent(marked.select(gone, of)), same, "left_anti")
    if repeated:
        left = left.union(keyed.join(sent(marked.filter("leads").select(gone, of)), same, "left_semi").dropDuplicates(["doc_id", own]))
    return left.select(*docs.columns)
