"""Token counts by a whole-token shortcut.

Offline, every string of the vocabulary that may stand alone as a pre-token is encoded; those that give exactly
one token are proven whole. Pre-tokens among them count one each; only the rest are merged.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .tokens import CHUNK, OUTSIDE, SEPARATORS, WORD_PIECE, Memo, byte_letters, lettered


class TokenCounter:
    """Counts tokens of whole texts as the ``tokenizers`` library does without added special tokens."""

    def __init__(self, path: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.suffix = self.model.end_of_word_suffix
        if not self.suffix:
            raise ValueError("the shortcut is for vocabularies with word ends")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.leads = re.compile("[" + re.escape("".join({x[0] for x in self.added} or {"\0"})) + "]|" + OUTSIDE.pattern)
        self.whole = self._prove()
        self.rest = Memo(lambda piece: len(self.model.tokenize(lettered(piece))), memo)
        self.chunks = Memo(self._chunk, memo)

    def _prove(self) -> frozenset[str]:
        """Pre-tokens that the vocabulary is proven to encode as one token."""
        letters = {c: b for b, c in byte_letters().items()}
        proven = set()
        for string, token in self.library.get_vocab(with_added_tokens=False).items():
            if not string.endswith(self.suffix) or not (bare := string[: -len(self.suffix)]) or not all(c in letters for c in bare):
                continue
            try:
                piece = bytes(letters[c] for c in bare).decode()
            except UnicodeDecodeError:
                continue
            if OUTSIDE.search(piece) or WORD_PIECE.findall(piece) != [piece]:
                continue
            if [t.id for t in self.model.tokenize(bare)] == [token]:
                proven.add(piece)
        return frozenset(proven)

    def _chunk(self, chunk: str) -> int:
        if self.leads.search(chunk) and (OUTSIDE.search(chunk) or any(x in chunk for x in self.added)):
            return len(self.library.encode(chunk, add_special_tokens=False).ids)
        whole, rest = self.whole, self.rest
        return sum(1 if p in whole else rest[p] for p in WORD_PIECE.findall(chunk.lower()))

    def count(self, text: str) -> int:
        chunks = CHUNK.findall(text) if SEPARATORS.search(text) else text.split()
        return sum(map(self.chunks.__getitem__, chunks))


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """One counter for each Python worker and vocabulary."""
    return TokenCounter(path)


def count_tokens(documents: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """Counts the tokens of every whole text.

    Returns ``doc_id, n_bytes long, n_tokens long, over_limit boolean`` for each row; ``n_bytes`` is the length
    in UTF-8. A null text counts as empty (0 bytes, 0 tokens). Null and repeated ids and repeated rows stay as
    they are, further columns are ignored, an empty table gives no rows. Nothing is shuffled.
    """

    def counts(texts: list[str]) -> dict[str, object]:
        counter = token_counter(vocabulary_path)
        n = np.array([counter.count(t) for t in texts], dtype=np.int64)
        return {"n_bytes": np.array([len(t.encode()) for t in texts], dtype=np.int64), "n_tokens": n, "over_limit": n > limit}

    return map_texts(documents, counts, "n_bytes long, n_tokens long, over_limit boolean")
