"""Alignment of two tokenizers against a plain two-pointer walk over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, row string, pairs string, n string"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.shown_bytes()

    def tokens(text):
        """Ids and bytes of both."""
        first = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        second = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return first, second

    return tokens


def walk(first, second):
    """Groups by two pointers."""
    groups, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(first) or j < len(second):
        if x <= y and i < len(first):
            groups[-1][0].append(first[i][0])
            x += len(first[i][1])
            i += 1
        else:
            groups[-1][1].append(second[j][0])
            y += len(second[j][1])
            j += 1
        if x == y:
            groups.append(([], []))
    return groups[:-1]


def expected(rows, tokens):
    each, counts = [], Counter()
    for doc_id, text in rows:
        first, second = tokens(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in x) != raw for x in (first, second)):
            first, second = [], []
        groups = walk(first, second)
        links = [(a[-1], b[-1]) for a, b in groups]
        counts.update(links)
        each.append((doc_id, len(first), len(second), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, groups, links in each:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


TEXTS = [None, "", " ", "a", "  two  spaces ", "line\nbreak\n next\t tab", "x\n\n  y", "<|endoftext|> and <s> </s> <unk> <0x41>", "nul\x00in", "low▁line", "é ü ß 漢字 😀 \U0001f469‍\U0001f467", "\x85 \xa0   　x", "a\x1c b", "don't we'll 12345 !!!", "﻿mark", "é"]


def test_query_is_that_of_two_pointers(spark, tmp_path, plain):
    rng = random.Random(50)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)] + ["".join(rng.choice(" \n\tab.é▁'s1") for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [rng.choice(words) * 400, " " * 3000, "x" * 3000]
    rows = [(i % 200 or None, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_alignment(spark, str(tmp_path))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = expected(rows, plain)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    # Hot pairs by broadcast, all others by shuffle; and the groups themselves.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    shuffled = alignment.align(docs, A, B, with_groups=True, broadcast_pairs=0).collect()
    assert sorted((tuple(r[c] for c in names) for r in shuffled), key=repr) == want
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in shuffled)
    assert alignment.align(docs.limit(0), A, B).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("ab \n\t\x1c\x85 '", max_size=20), max_size=5))
def test_units_encode_as_whole_texts(plain, texts):
    both = alignment.aligner(A, B)
    for text, (a, b) in zip(texts, both.encode(texts), strict=True):
        first, second = plain(text)
        raw = (" " + text).encode()
        if text and all(b"".join(t for _, t in x) == raw for x in (first, second)):
            assert (a.tolist(), b.tolist()) == ([i for i, _ in first], [i for i, _ in second])
        else:
            assert not len(a) and not len(b)


def test_units_are_forgotten_and_met_again(monkeypatch, plain):
    monkeypatch.setattr(alignment, "CACHE_UNITS", 5)
    both = alignment.Aligner(A, B)
    for text in ["one two three", "two three four five six seven", "one two eight", "nine ten two", "x" * 100 + " two"]:
        ((a, b),) = both.encode([text])
        assert [a.tolist(), b.tolist()] == [[i for i, _ in x] for x in plain(text)]


def test_hot_pairs_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", 0.2)
    each = spark.createDataFrame([(i, 7 if i % 2 else i, 2) for i in range(40)], "row long, pair long, n int")
    rated = each.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("docs"))
    assert sorted(map(tuple, alignment.with_counts(each, rated, 21, 40, 3).collect())) == sorted(map(tuple, alignment.with_counts(each, rated, 21, 40, 99).collect()))
