"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult (with a weight), threat, target, negation, reported speech, clause end, other. Three small
transducers read the classes of a clause: ABUSE follows insult / target and threat / target patterns and gives each
insult or threat a weight; NEGATING and REPORTING give factors to what stands in their scope, whose length is counted
by their states. They are composed into one table, which scores matched clauses, not words alone. What a match is worth is
learned: the composed table also says which pattern an arc completes (a lone insult, an insult of a target, a lone
threat, a threat to a target) and in which scope (none, negated, reported). A document's strongest clause, the sum of its
clauses and the matches of each pattern and scope go through a logistic curve fitted on the training sample, so an insult
that is only quoted or denied counts as its labels say, and so does a lone one.

The insult lexicon is a short seed list plus terms learned from labelled training rows (at most TRAIN_ROWS): words and
word stems (prefixes) of which the share of toxic texts that have them is MIN_LIFT times that of other texts, and that
stand after at least MIN_CONTEXTS different words in toxic texts, which keeps the words of a copied document out.

Defined cases: null and empty texts get the score of a text without matched clause; null labels are left out, repeated
labels of a document count once (the highest); without training rows of both classes the seeds and a fixed curve
decide; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import held_out, short_batches

TRAIN_ROWS = 8_000
#: Lengths of the stems that are learned beside whole words.
STEMS = (4, 5, 6)
MIN_CONTEXTS, MIN_LIFT = 4, 10.0
CACHE_WORDS = 150_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# Seed words of the classes.
SEEDS = {
    INSULT: (
        "idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "pathetic", "loser", "losers", "worthless", "disgusting", "clown", "imbecile", "filth", "vermin",
        "idiota", "imbécil", "idiote", "imbécile", "abruti", "dummkopf", "abschaum",
    ),
    THREAT: ("kill", "hurt", "destroy", "beat", "stab", "shoot", "strangle", "töten", "umbringen", "tuer", "matar", "golpear"),
    TARGET: (
        "you", "your", "yours", "u", "he", "she", "they", "them", "those", "him", "her", "du", "ihr", "dich", "euch", "sie", "vous", "toi", "tu", "ils", "elles", "ustedes", "usted", "ellos",
    ),
    NEGATION: ("not", "never", "isn", "aren", "wasn", "nicht", "kein", "keine", "niemals", "pas", "jamais", "nunca"),
    REPORT: ("said", "says", "told", "wrote", "quoted", "called", "claimed", "reported", "sagte", "schrieb", "zitierte", "dit", "écrit", "dijo", "escribió"),
}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
#: Words after a negation, or after a word of reported speech, that are in its scope.
SCOPE = 3
NEGATED, REPORTED = 0.35, 0.5
#: Weight of a threat without and with target; factor of an insult beside a target.
THREAT_ALONE, THREAT_TARGET, INSULT_TARGET = 0.2, 2.5, 1.5


class Transducer:
    """Deterministic: (state, class) -> (state, weight); where no arc is given, the state's ``rest`` arc is taken."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, float]], rest: list[tuple[int, float]]):
        self.states = states
        self.table = [[arcs.get((s, c), rest[s]) for c in range(END + 1)] for s in range(states)]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; weights multiply."""
        arcs = {}
        for a, b in product(range(self.states), range(other.states)):
            for c in range(END + 1):
                (p, u), (q, v) = self.table[a][c], other.table[b][c]
                arcs[a * other.states + b, c] = (p * other.states + q, u * v)
        return Transducer(self.states * other.states, arcs, [(0, 0.0)] * (self.states * other.states))


def scope(opener: int, factor: float, length: int = SCOPE) -> Transducer:
    """State n: n more words are in the scope that ``opener`` opened; a clause end closes it."""
    arcs = {(s, c): (length if c == opener else 0, 1.0) for s in range(length + 1) for c in (opener, END)}
    return Transducer(length + 1, arcs, [(max(0, s - 1), factor if s else 1.0) for s in range(length + 1)])


# States of ABUSE: 0 nothing yet, 1 target, 2 insult, 3 threat.
ABUSE = Transducer(
    4,
    {
        (0, TARGET): (1, 0.0), (0, INSULT): (2, 1.0), (0, THREAT): (3, THREAT_ALONE),
        (1, INSULT): (2, INSULT_TARGET), (1, THREAT): (3, THREAT_TARGET),
        (2, TARGET): (1, INSULT_TARGET - 1.0), (2, INSULT): (2, 1.0), (2, THREAT): (3, THREAT_TARGET),
        (3, TARGET): (1, THREAT_TARGET), (3, INSULT): (2, INSULT_TARGET), (3, THREAT): (3, THREAT_ALONE),
        **{(s, END): (0, 0.0) for s in range(4)},
    },
    [(s, 0.0) for s in range(4)],
)
GRAMMAR = ABUSE.compose(scope(NEGATION, NEGATED)).compose(scope(REPORT, REPORTED))

# What an arc of ABUSE completes, and the scopes that it may be in.
LONE_INSULT, INSULTED, LONE_THREAT, THREATENED = range(4)
COMPLETES = {
    (0, INSULT): LONE_INSULT, (2, INSULT): LONE_INSULT, (1, INSULT): INSULTED, (3, INSULT): INSULTED, (2, TARGET): INSULTED,
    (0, THREAT): LONE_THREAT, (3, THREAT): LONE_THREAT, (1, THREAT): THREATENED, (2, THREAT): THREATENED, (3, TARGET): THREATENED,
}
SCOPES = 3
PATTERNS = 4 * SCOPES


def completed() -> list[list[int]]:
    """For each state of GRAMMAR and class the pattern and scope that the arc completes, -1 for none."""
    out = []
    for abuse, denied, told in product(range(ABUSE.states), range(SCOPE + 1), range(SCOPE + 1)):
        within = 1 if denied else 2 if told else 0
        out.append([COMPLETES[abuse, c] * SCOPES + within if (abuse, c) in COMPLETES else -1 for c in range(END + 1)])
    return out


MATCHES = completed()


class Scorer:
    """Clause scores of texts, with a lexicon of insult terms and weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {w: (c, 1.0) for c, ws in SEEDS.items() for w in ws}
        self.lexicon, self.known = lexicon, {}
        self.stems = sorted({len(k) - 1 for k in lexicon if k.endswith("*")}, reverse=True)

    def of(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        weights = [self.lexicon[k] for k in (word, *(word[:n] + "*" for n in self.stems if len(word) > n)) if k in self.lexicon]
        if weights and (found is None or found[0] == INSULT):
            return INSULT, max(weights)
        return found or ((END, 1.0) if word in ".!?;\n" else (OTHER, 1.0))

    def clauses(self, text: str | None, matches: list[float] | None = None) -> list[float]:
        """Scores of the clauses; the weights of the words that complete each pattern are added to ``matches``."""
        if not text:
            return []
        tokens = _TOKEN.findall(text.lower())
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = self.of(w)
        scores: list[float] = []
        state, score = 0, 0.0
        table = GRAMMAR.table
        for kind, weight in map(known.__getitem__, tokens):
            before = state
            state, w = table[state][kind]
            if w:
                score += w * weight
                if matches is not None:
                    matches[MATCHES[before][kind]] += weight
            if kind == END and score:
                scores.append(score)
                score = 0.0
        return [*scores, score] if score else scores

    def features(self, text: str | None) -> list[float]:
        """Strongest clause, sum of clauses and each pattern's matches (both by logarithm)."""
        matches = [0.0] * PATTERNS
        found = self.clauses(text, matches)
        return [max(found), math.log1p(sum(found)), *map(math.log1p, matches)] if found else [0.0] * (2 + PATTERNS)


def learn_lexicon(sample: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Terms of ``sample(text, label)`` with weights; stems end in an asterisk."""
    if not positives or not negatives:
        return {}

    def terms(word: str) -> list[str]:
        return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if len(word) > 2 else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict[str, set[int]] = defaultdict(set)
        having: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _TOKEN.findall((text or "").lower())
                having[bool(label)].update({t for word in set(tokens) for t in terms(word)})
                if label:
                    for before, word in zip(["", *tokens], tokens, strict=False):
                        for t in terms(word):
                            contexts[t].add(hash_text(before))
        rows = [(t, c, 0, 0) for t, cs in contexts.items() for c in cs] + [(t, None, having[1][t], having[0][t]) for t in {*having[0], *having[1]}]
        for i in range(0, len(rows), 50_000):
            columns = zip(zip(*rows[i : i + 50_000], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["term", "context", "toxic", "other"])

    counted = sample.mapInArrow(count, "term string, context long, toxic long, other long").groupBy("term")
    counted = counted.agg(F.countDistinct("context").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    least = max(MIN_CONTEXTS, round(0.005 * positives))
    lift = (F.col("toxic") / positives) / ((F.col("other") + 0.5) / negatives)
    # Bounded by the sample's toxic texts: a term is in at least ``least`` of their contexts.
    best = counted.filter(F.col("contexts") >= least).withColumn("lift", lift).filter(F.col("lift") >= MIN_LIFT).orderBy(F.desc("lift"), "term")
    return {r["term"]: min(2.0, math.log(r["lift"]) / math.log(100.0)) for r in best.select("term", "lift").collect()}


def hash_text(text: str) -> int:
    """Same in every process, unlike hash()."""
    import zlib

    return zlib.crc32(text.encode())


#: Ridge on the weights of the clause scores, and on those of single patterns, which some training samples hardly show.
RIDGE, PATTERN_RIDGE = 0.05, 1.0


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``features`` and of 1 by Newton's method with a light ridge."""
    if not len(y) or y.min() == y.max():
        return np.array([2.0, 1.0, *[0.0] * PATTERNS, -2.0])
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.array([RIDGE, RIDGE, *[PATTERN_RIDGE] * (x.shape[1] - 2), RIDGE])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    short_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    # Bounded by ``most`` pairs of id and label, so the documents are not moved.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("_label").alias("label"))
    lexicon = learn_lexicon(sample, sum(n for k, n in counts.items() if k), counts.get(0, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            found = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = sample.mapInArrow(measure, "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, 2 + PATTERNS)
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    return lexicon, fit_curve(x[order], y[order])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    lexicon, curve = train(docs, labels, most)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            found = np.array([scorer.features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, 2 + PATTERNS)
            score = 1 / (1 + np.exp(-np.clip(found @ curve[:-1] + curve[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
