"""Encoding of whole batches against the tokenizer itself, and how often a batch asks for a piece's ids."""

import random

import pyarrow as pa
import pytest

from lexispark.llm import tokens
from lexispark.llm.queries import tokenizer_path

PARTS = [*"abzAZsStmdrvl019.,!'-_(<|>/ \t\n\v\x00\x1c\x1f\x7f\x85\xa0²ªº×÷ßÿÀÉéÜİıKΣςσ́̈‍ 　あ가漢😀", "'s", "'LL", "<|endoftext|>", "  ", "</w>", "it's", "É.", "é"]


@pytest.mark.parametrize("direct", [True, False])
def test_batches_are_encoded_as_the_whole_tokenizer_does(direct):
    encoder, rng = tokens.WordEncoder(tokenizer_path()), random.Random(7)
    assert encoder.direct
    encoder.direct = direct
    texts = ["".join(rng.choices(rng.sample(PARTS, 6) if i % 2 else PARTS, k=rng.choice([0, 1, 3, 8, 40]))) for i in range(4000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(["left out", *texts, None]).slice(1)
    for got in (encoder.encode(column), encoder.encode([*texts, None])):
        assert [t for t, a, b in zip([*texts, None], got, [*want, []], strict=True) if a.tolist() != b] == []
    assert encoder.encode([]) == [] and [len(x) for x in encoder.encode([None, ""])] == [0, 0]


def test_a_batch_asks_for_each_piece_once():
    class Counting(tokens.Known):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    encoder = tokens.WordEncoder(tokenizer_path())
    encoder.known = Counting(encoder.known.make)
    texts = ["Über the river, (and) THE River... it's Über", "the, RIVER; and über"] * 500
    got = encoder.encode(texts)
    assert encoder.known.asked <= 20 and got[998].tolist() == encoder.whole(texts[0]).tolist()


def test_long_pieces_are_not_remembered():
    encoder = tokens.WordEncoder(tokenizer_path())
    texts = ["y" * 5000, "漢　" * 3000 + "a\x85b", "漢" * 2000]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole(t).tolist() for t in texts]
    assert max(map(len, encoder.known)) <= tokens.LONG
    assert "漢" in encoder.known


def test_batches_are_gathered_whole():
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["a" * 100, None]})
    got = list(tokens.gathered(iter([batch] * 7), 3 * batch.nbytes))
    assert [b.num_rows for b in got] == [6, 6, 2] and list(tokens.gathered(iter([]))) == []
