"""Cases of the first review."""

import math
import random

import numpy as np

from lexispark.llm import neardup, tokens, warc
from lexispark.llm.queries import tokenizer_path


def test_separators_that_only_python_splits_at():
    from tokenizers import Tokenizer

    encoder, tokenizer = tokens.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["a\x1cb", "hello \x1f world", "x\x1d", "\x1e", "a\x85b\xa0c\u2003d\u2028e\x0bf"]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.array_equal(got, tokenizer.encode(text, add_special_tokens=False).ids)


def test_payloads_of_one_page_id_are_planned_apart(spark):
    a, b = "a" * 100, "b" * 100
    rows = [(1, "u", a), (2, "u", a), (2, "u", b), (3, "u", a), (4, "u", b), (4, "u", a)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = sorted((r.page_id, "a" if r.payload_digest == warc.hashlib.sha256(a.encode()).hexdigest() else "b", r.record_type, r.refers_to) for r in got)
    assert kinds == [(1, "a", "response", None), (2, "a", "revisit", 1), (2, "b", "response", None), (3, "a", "revisit", 1), (4, "a", "revisit", 1), (4, "b", "revisit", 2)]


def test_repeated_doc_ids_are_classed_by_their_texts(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    rows = [(5, x), (5, y), (7, y + " end"), (8, x), (9, "z " * 30), (9, "z " * 30), (None, x), (None, x), (10, None), (10, None), (11, y), (4, x + " more"), (5, x + " again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.kept) for r in neardup.classes(df).collect()))
    assert got == sorted([(5, 4, False), (5, 5, True), (7, 5, False), (8, 4, False), (9, 9, True), (9, 9, False), (0, 0, True), (0, 0, True), (10, 10, True), (10, 10, True), (11, 5, False), (4, 4, True), (5, 4, False)])
    left = [tuple(r) for r in neardup.drop_near_duplicates(df).collect()]
    assert sorted(left, key=repr) == sorted([(5, y), (4, x + " more"), (9, "z " * 30), (None, x), (None, x), (10, None), (10, None)], key=repr)


def test_sketch_bound_and_tree_links(spark):
    k, share = neardup.COORDINATES, 0.2 * (1 - 2.0**-neardup.PLANES)
    lost = sum(math.comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(neardup.most_differing(0.8) + 1, k + 1))
    assert lost < 1e-5
    found = neardup.classes(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
    assert "n_tree_links" in found.columns and "n_links" not in found.columns


def test_sliced_buckets_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(80)] = f"x{rng.random()}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = lambda: sorted((r.doc_id, r.class_id) for r in neardup.classes(df).collect())
    whole = run()
    monkeypatch.setattr(neardup, "SLICE", 3)
    assert run() == whole and 1 < len({c for _, c in whole}) < 60
