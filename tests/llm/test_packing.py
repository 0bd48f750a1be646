"""Packing: slots against best fit of single pieces, and the query's sequences against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import packing, queries
from lexispark.llm.queries import tokenizer_path

DOC = "doc_id long, text string, length string, rank string, first string, part string"


def best_fit(histogram, capacity):
    """The number of sequences of best fit, from the longest piece down, one by one."""
    rooms = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= length]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def fills(slots):
    """Pieces' places in each sequence."""
    held, ranks = defaultdict(list), defaultdict(list)
    for s in slots:
        for rank in range(s.first, s.last + 1):
            nth = rank - s.first
            held[s.sequence + nth // s.per].append((s.place + nth % s.per * s.length, s.length))
            ranks[s.length].append(rank)
    return held, ranks


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12), st.integers(30, 64))
def test_plan_is_best_fit_without_gaps(histogram, capacity):
    held, ranks = fills(packing.plan(histogram, capacity))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(held) == list(range(len(held))) and len(held) == best_fit(histogram, capacity)


def test_slots_are_few_whatever_the_counts():
    rng = random.Random(60)
    histogram = {n: rng.randrange(1, 1000) for n in range(1, 2049)}
    small, large = len(packing.plan(histogram)), len(packing.plan({k: n * 1_000_000 for k, n in histogram.items()}))
    assert small < 8 * 2048 and large < 8 * 2048
    assert packing.plan({}) == []


def test_query_packs_every_piece(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(61)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(200)]
    rows += [(None, None), (None, ""), (3, ""), (3, rows[3][1]), (3, rows[3][1]), (500, "a b " * 5000), (501, "x" * 9000), (502, "<|endoftext|> \x1c \n")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got, want = got.collect(), Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(held) == best_fit(Counter(r.length for r in got), 2048)
    # Ranks over many parts of a length, and the sequences themselves.
    parted = packing.pack(docs, tokenizer_path(), with_ids=True, part_pieces=7)
    whole = packing.sequences(parted).collect()
    assert len(whole) == len(held) and sorted(i for r in whole for i in r.doc_ids if i is not None) == sorted(r.doc_id for r in got if r.doc_id is not None)
    at = {(r.sequence_id, r.offset): r.ids_crc32 for r in parted.collect()}
    lengths = {(r.sequence_id, r.offset): r.length for r in parted.collect()}
    ids = {r.sequence_id: r.ids for r in whole}
    assert all(zlib.crc32(np.array(ids[s][o : o + lengths[s, o]], "<u4").tobytes()) == crc for (s, o), crc in at.items())
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []
