"""Secret scans with DataFrame functions only: fixed patterns, then sliding-window entropy over candidate strings.

Spans are in code points, end exclusive. For each kind, matches are the leftmost non-overlapping ones of its pattern;
matches that are too short are dropped afterwards, so that what they cover stays used up. Positions come from the
lengths of the matches and of the gaps that the same pattern splits a text into.

The entropy scan adds spans of kind ``entropy``. Candidates are runs of key characters with a digit and a letter. Over
windows of WINDOW characters it keeps, for each candidate, the count of every character in the window and
S = sum of c * log2(c) over those counts; a step takes one character out and one in, so two counts and two terms of S
change. The window's entropy is log2(WINDOW) - S / WINDOW; the candidate's highest one is held against the limit of its
character class. Candidates on the allow-list, and those that a base span touches, add nothing.

Running sums, maxima and minima over n matches go by blocks of about sqrt(n), as a fold that appends to an array copies
it at every step; each text is split once for each kind.

Defined cases: null and empty texts have no spans; very long candidates are scanned whole, in time proportional to
their length; repeated rows give repeated results; an empty table gives an empty result; further columns, whatever
their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns and least lengths, in the order in which kinds are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy of a candidate's best window, in bits, by its character class.
ENTROPY_LIMITS = {"hex": 2.9, "word": 3.6, "base64": 3.8}
#: Candidates that match one of these are no secrets: UUIDs, runs of one character, counting rows, placeholders, digits alone.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|your[-_]?(key|token)|xxxxx|00000",
    r"0123456789|(?i)abcdefghij",
    r"^[0-9+/_=-]+$",
)
KINDS = ("assign", "access", "hex", "entropy")


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,found:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (ints) the fold of those before it, from ``zero``."""
    ints = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        start = F.struct(zero.alias("total"), ints.alias("before"))
        return F.aggregate(block, start, lambda acc, x: F.struct(add(acc["total"], x).alias("total"), F.array_append(acc["before"], acc["total"]).alias("before")))

    def all_of(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x["v"]), x["width"])
        return let(F.transform(starts, lambda i: within(F.slice(x["v"], i, x["width"]))), lambda blocks: joined_blocks(blocks))

    def joined_blocks(blocks: Column) -> Column:
        heads = within(F.transform(blocks, lambda b: b["total"]))["before"]
        return F.flatten(F.zip_with(blocks, heads, lambda b, head: F.transform(b["before"], lambda x: add(head, x))))

    width = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))
    return F.when(F.size(values) > 0, let(F.struct(values.alias("v"), width.alias("width")), all_of)).otherwise(ints)


def plus(a: Column, b: Column) -> Column:
    return a + b


def spans(text: Column, pattern: str, kind: str, least: int, group: int = 0) -> Column:
    """array<struct<start,rank,kind,end,found>> of the pattern's matches whose group has the least length."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # The first gap is what lies before the first match, and so on; the last one, after all matches, has no match beside it.
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    parts = F.struct(found.alias("m"), F.transform(value, lambda v: F.length(v)).alias("v"), gaps.alias("g"))
    rank = F.lit(KINDS.index(kind))

    def placed(p: Column) -> Column:
        steps = F.zip_with(p["m"], F.slice(p["g"], 1, F.size(p["m"])), lambda m, g: F.length(m) + g)
        zipped = F.arrays_zip(p["m"].alias("m"), p["v"].alias("v"), F.slice(p["g"], 1, F.size(p["m"])).alias("g"), running(steps, F.lit(0), plus).alias("at"))
        kept = F.filter(zipped, lambda z: z["v"] >= least)
        start = lambda z: z["at"] + z["g"]
        return F.transform(kept, lambda z: F.struct(start(z).alias("start"), rank.alias("rank"), F.lit(kind).alias("kind"), (start(z) + F.length(z["m"])).alias("end"), z["m"].alias("found")))

    return let(parts, placed)


def max_window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, over the windows of ``window`` characters; incremental counts."""
    xlog = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    moved = lambda counts, at, by: F.transform(counts, lambda c, i: F.when(i + 1 == at, c + by).otherwise(c))

    def entropy(x: Column) -> Column:
        # Characters by their place among the candidate's distinct ones, from 1 on.
        zeros = F.transform(x["kinds"], lambda _: F.lit(0))
        first = F.aggregate(F.slice(x["codes"], 1, window), zeros, lambda counts, c: moved(counts, c, 1))

        def scan_windows(counts: Column) -> Column:
            s0 = F.aggregate(counts, F.lit(0.0), lambda s, c: s + xlog(c))

            def step(acc: Column, i: Column) -> Column:
                # The window now starts at i (1-based): the character at i - 1 leaves, the one at i - 1 + window enters.
                old, new = F.get(x["codes"], i - 2), F.get(x["codes"], i - 2 + window)
                had, has = F.get(acc["counts"], old - 1), F.get(acc["counts"], new - 1)
                s = F.when(old == new, acc["s"]).otherwise(acc["s"] - xlog(had) + xlog(had - 1) - xlog(has) + xlog(has + 1))
                counts = F.when(old == new, acc["counts"]).otherwise(moved(moved(acc["counts"], old, -1), new, 1))
                return F.struct(s.alias("s"), F.least(acc["low"], s).alias("low"), counts.alias("counts"))

            steps = F.when(F.size(x["codes"]) > window, F.sequence(F.lit(2), F.size(x["codes"]) - window + 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, F.struct(s0.alias("s"), s0.alias("low"), counts.alias("counts")), step, lambda acc: F.log2(F.lit(float(window))) - acc["low"] / window)

        return let(first, scan_windows)

    chars = F.split(candidate, "")
    coded = let(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("kinds")), lambda x: F.struct(x["kinds"].alias("kinds"), F.transform(x["chars"], lambda c: F.array_position(x["kinds"], c).cast("int")).alias("codes")))
    return let(coded, entropy)


def is_secret_like(candidate: Column) -> Column:
    hexes, word = candidate.rlike(r"^[0-9a-fA-F]+$"), candidate.rlike(r"^[A-Za-z0-9]+$")
    limit = F.when(hexes, ENTROPY_LIMITS["hex"]).when(word, ENTROPY_LIMITS["word"]).otherwise(ENTROPY_LIMITS["base64"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]") & ~allowed & (F.round(max_window_entropy(candidate), 9) >= limit)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of struct<start,rank,kind,end,found>, by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPANS)
    # A cheap test first: most texts hold no match, and then nothing is split.
    base = F.array_sort(
        F.concat(
            F.when(t.rlike(ASSIGN), spans(t, ASSIGN, "assign", MIN_ASSIGN, 2)).otherwise(none),
            F.when(t.rlike(ACCESS), spans(t, ACCESS, "access", MIN_ACCESS)).otherwise(none),
            F.when(t.rlike(HEX[:-1] + "{%d}" % MIN_HEX), spans(t, HEX[:-1] + "{%d,}" % MIN_HEX, "hex", MIN_HEX)).otherwise(none),
        )
    )
    # A lookahead at the start of a run: only runs with a digit are candidates worth splitting a text for.
    worth = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20}"
    candidates = F.when(t.rlike(worth), spans(t, CANDIDATE, "entropy", WINDOW)).otherwise(none)
    found = docs.select("doc_id", base.alias("base"), candidates.alias("candidates"))
    clear = F.when((F.size("base") > 0) & (F.size("candidates") > 0), untouched(F.col("base"), F.col("candidates"))).otherwise(F.col("candidates"))
    return found.select("doc_id", "base", F.filter(clear, lambda s: is_secret_like(s["found"])).alias("added"))


def untouched(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span: by the furthest end of the base spans that start before or with one, and
    the next start after it."""
    entropy = KINDS.index("entropy")
    last = F.lit(2**31 - 1)

    def of(every: Column) -> Column:
        ends = F.transform(every, lambda s: F.when(s["rank"] < entropy, s["end"]).otherwise(F.lit(0)))
        starts = F.transform(F.reverse(every), lambda s: F.when(s["rank"] < entropy, s["start"]).otherwise(last))
        zipped = F.arrays_zip(every.alias("s"), running(ends, F.lit(0), F.greatest).alias("reach"), F.reverse(running(starts, last, F.least)).alias("next"))
        kept = F.filter(zipped, lambda z: (z["s"]["rank"] == entropy) & (z["reach"] <= z["s"]["start"]) & (z["next"] >= z["s"]["end"]))
        return F.transform(kept, lambda z: z["s"])

    return let(F.array_sort(F.concat(base, candidates)), of)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans")
    )
