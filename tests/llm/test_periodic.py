"""Periodic runs against brute force over all places and periods, and the query against plain Python."""

import hashlib
import random
import re
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import periodic, queries

DOC = "doc_id long, text string, runs string, collapsed string"


def brute(words):
    """start, length, period of all runs, from the smallest period on."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((i, size, q) for (i, size), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), min_size=1, max_size=4), st.integers(1, 7), st.integers(0, 40))
def test_runs_are_those_of_brute_force(documents, period, size):
    documents = [w[:5] + (w[:period] * 40)[: size if w else 0] + w[5:] for w in documents]
    assert periodic.runs(documents) == [brute(w) for w in documents]


def test_runs_of_random_documents_in_small_groups(monkeypatch):
    rng = random.Random(40)
    documents = []
    for _ in range(400):
        letters = [b"%d" % i for i in range(rng.choice([1, 2, 3, 5, 40]))]
        words = [rng.choice(letters) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            root = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (root * 20)[: rng.randrange(1, 6 * len(root) + 4)]
        documents.append(words)
    want = [brute(w) for w in documents]
    assert periodic.runs(documents) == want
    monkeypatch.setattr(periodic, "GROUP_WORDS", 100)
    assert periodic.runs(documents) == want


def test_long_periodic_documents_take_about_linear_time():
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        assert periodic.runs([[b"a"] * n, [b"%d" % (i % 3000) for i in range(n)], [b"a", b"b"] * (n // 2)]) == [[(0, n, 1)], [(0, n, 3000)], [(0, n, 2)]]
        took.append(time.time() - began)
    assert took[1] < 16 * max(took[0], 0.1)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_query_is_that_of_plain_python(spark, tmp_path):
    rng = random.Random(41)
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice([3, 500]))}" for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [(None, None), (None, "a " * 9), (-5, ""), (7, "x y x\x1cz " * 6), (7, "x y x\x1cz " * 6), (8, " \t\n"), (9, "ß \U0001f600\n" * 7), (1000, "long " * 30_000)]
    spark.createDataFrame([(*r, "a", "b") for r in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in rows if r[0] != 1000]
    assert sorted(repr(tuple(r)) for r in got.collect() if r.doc_id != 1000) == sorted(repr(expected(*r)) for r in short)
    (long,) = [r for r in got.collect() if r.doc_id == 1000]
    assert (long.n_runs, long.length, long.period) == (1, 30_000, 1)


def test_operator_gives_runs_and_texts(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "x", "y"), (2, None, "x", "y")], DOC)
    got = {r.doc_id: r for r in periodic.collapse_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "a b c" and got[1].n_words == 9
    assert got[2].runs == [] and got[2].collapsed == ""
    assert periodic.collapse_runs(df.limit(0)).collect() == []
