"""Token counts by a vocabulary: the longest piece that fits at each place, by a trie built once for each worker."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shown in pieces where a text has a blank.
BLANK = "▁"
#: Words that a worker remembers with their counts.
CACHE_WORDS = 200_000
_END = ""


class Trie:
    def __init__(self, pieces: Iterable[str]):
        self.root: dict = {}
        self.known: dict[str, int] = {}
        for piece in pieces:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            if piece:
                node[_END] = True
        # No piece goes over the start of a word, so words can be counted one by one.
        self.by_words = not any(BLANK in p[1:] and p.strip(BLANK) for p in pieces if p)

    def count(self, text: str) -> int:
        """Pieces of a text, from its start on always the longest; a character that begins no piece counts as one."""
        n, at, end = 0, 0, len(text)
        while at < end:
            node, stop, k = self.root, at + 1, at
            while k < end and (node := node.get(text[k])) is not None:
                k += 1
                if _END in node:
                    stop = k
            n, at = n + 1, stop
        return n

    def tokens(self, text: str) -> int:
        shown = BLANK + text.replace(" ", BLANK)
        if not self.by_words or BLANK * 2 in shown or shown.endswith(BLANK):
            return self.count(shown)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        n, known = 0, self.known
        for word in shown[1:].split(BLANK):
            found = known.get(word)
            if found is None:
                found = self.count(BLANK + word)
                if len(word) < 40:
                    known[word] = found
            n += found
        return n


_tries: dict[str, Trie] = {}


def pieces_of(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def token_counts(text: Column, path: str, most: int = 512) -> Column:
    """Tokens of a text by the vocabulary at ``path``, up to the longest input of a model (null: null)."""

    @F.pandas_udf("int")
    def counts(texts: pd.Series) -> pd.Series:
        trie = _tries.get(path)
        if trie is None:
            _tries.clear()
            trie = _tries[path] = Trie(pieces_of(path))
        return texts.map(lambda t: None if t is None else min(most, trie.tokens(t))).astype("Int32")

    return counts(text)
