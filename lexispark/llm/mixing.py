"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source without words
has target 0; a null doc_id is hashed as the empty string; equal rows are sampled one by one; an empty table gives an
empty result; very long texts are counted whole; further columns are kept whatever their names, for ``mix`` adds none,
``plan`` returns its own columns only, and ``with_repeats`` avoids names that are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import WORD, Scratch, fresh

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Buckets of the seeded hash for each source; the bucket in which a target ends is settled document by document.
BUCKETS = 65536


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row for each source of ``sizes(source, source_size)``: adds weight, target.

    The clamped sources are a prefix in the order of cap / weight, so the level at which redistribution comes to rest
    is found with running sums over the sources, of which there are few.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    # Levels fall from the first source that need not be clamped on, so that source has the highest fitting one.
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return ranked.withColumn("rest", level).select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("rest")), F.col("cap")).alias("target"))


def seeded(doc_id: Column, seed: int) -> Column:
    """32 bits of md5 over seed and id, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


#: Bits of the hash in one bucket.
_IN_BUCKET = (1 << 32) // BUCKETS


class Decisions:
    """What is decided over ``docs``: how often each document is taken.

    Every document is taken ``floor(target / source_size)`` times; of each source's documents, in the order of a
    seeded hash, as many get one more repetition as bring the source nearest its target. The cut is found on a
    histogram of the hash (partial sums, no source in one task); only documents in the bucket of the cut are ordered.
    No text is shuffled: what is joined to the documents has a row for each source, or for each document at a cut.
    Rows equal in id, source and size share one decision.

    ``sizes`` has doc_id, source, size, hash, bucket of every row; ``cuts`` a row for each source; ``near`` one for
    each document at a cut.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...], max_epochs: float, seed: int):
        scratch = Scratch(docs.sparkSession, "mixing")
        self.seed = seed
        rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed).alias("hash"))
        self.sizes = rows = scratch.keep(rows.withColumn("bucket", F.floor(F.col("hash") / _IN_BUCKET).cast("int")), "sizes")
        histogram = scratch.keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "histogram")
        plan = targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
        plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        plan = plan.withColumn("whole", F.floor("rate").cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
        plan = plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "extra")
        same = F.col("source").eqNullSafe(F.col("of"))
        along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Buckets are taken whole up to the first whose words no longer fit.
        cuts = histogram.withColumn("upto", F.sum("words").over(along)).join(plan, same).groupBy(*plan.columns).agg(
            F.min(F.when(F.col("upto") > F.col("extra"), F.col("bucket"))).alias("cut"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("extra"), F.col("upto"))), F.lit(0)).alias("below"),
        )
        self.cuts = cuts = scratch.keep(cuts, "cuts")
        in_order = Window.partitionBy("source").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        near = rows.join(cuts, same).filter(F.col("bucket") == F.col("cut"))
        near = near.withColumn("passed", F.col("below") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        near = near.groupBy(F.col("doc_id").alias("n_id"), F.col("source").alias("n_source"), F.col("size").alias("n_size"))
        self.near = scratch.keep(near.agg(F.max((F.col("passed") + F.col("size") / 2 <= F.col("extra")).cast("long")).alias("more")), "near")
        scratch.drop("histogram")

    def join(self, rows: DataFrame, bucket: Column, size: Column, some: Column, prefix: str) -> DataFrame:
        """``rows`` with ``prefix``repeats, _source_size, _target. ``size`` is looked at only at a cut, ``some``: it is not 0."""
        cuts, near = (d.select(*[F.col(c).alias(prefix + c) for c in d.columns]) for d in (self.cuts, self.near))
        of = lambda c: F.col(prefix + c)
        out = rows.join(cuts, F.col("source").eqNullSafe(of("of")), "left")
        at_cut = F.when(bucket == of("cut"), size)
        out = out.join(near, (at_cut == of("n_size")) & F.col("doc_id").eqNullSafe(of("n_id")) & F.col("source").eqNullSafe(of("n_source")), "left")
        more = F.coalesce(of("more"), (of("cut").isNull() | (bucket < of("cut"))).cast("long"))
        repeats = F.when(some, of("whole") + F.when(of("extra") > 0, more).otherwise(F.lit(0))).otherwise(of("whole"))
        return out.select(*rows.columns, repeats.alias(prefix + "repeats"), of("source_size"), of("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats for every row of ``docs``."""
    found = Decisions(docs, weights, max_epochs, seed)
    out = found.join(found.sizes, F.col("bucket"), F.col("size"), F.col("size") > 0, "_")
    return out.select("doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_repeats").alias("repeats"))


def _repeated(docs: DataFrame, weights: tuple[float, ...], max_epochs: float, seed: int) -> tuple[DataFrame, list[str]]:
    # A prefix that no column of the caller's begins with.
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names = fresh(docs, "_size", "_source_size", "_target", "_repeats")
    bucket = F.floor(seeded(F.col("doc_id"), seed) / _IN_BUCKET).cast("int")
    text = F.col("text")
    out = Decisions(docs, weights, max_epochs, seed).join(docs, bucket, size_of(text), F.coalesce(text.rlike(WORD), F.lit(False)), prefix)
    found = [size_of(text), *(F.col(prefix + c) for c in ("source_size", "target", "repeats"))]
    return out.select(*docs.columns, *(c.alias(n) for c, n in zip(found, names, strict=True))), names


def with_repeats(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """``docs`` with four more columns: _size, _source_size, _target, _repeats (with underscores after them if taken)."""
    return _repeated(docs, weights, max_epochs, seed)[0]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``ceil(max_epochs)`` times); columns unchanged."""
    # Sizes are not asked for, so texts are counted only at the cuts.
    out, (*_, repeats) = _repeated(docs, weights, max_epochs, seed)
    (nth,) = fresh(out, "_nth")
    return out.filter(F.col(repeats) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int")))).select(*docs.columns)
