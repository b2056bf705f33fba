"""Token ids of whole texts by the ``tokenizers`` library, with a memo of pieces and of white-space-bounded chunks.

Both vocabularies split a text into pieces before merging, and no piece crosses from one chunk (a run of
other than white space, for the byte-level pattern with the one space before it) into the next. A chunk's ids
therefore don't depend on its surroundings, so each distinct chunk is encoded once by the library and then
looked up. Chunks outside Latin-1, or with the text of an added token, go through the library's whole
encoding path; the others through the same pattern and the library's merge model. For the byte-level vocabulary a text
without such chunks is split into its pieces at once: a word is then encoded once, whatever marks follow it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: What \s is in the libraries' patterns, and the letters and numbers of Latin-1.
SPACE = "\t-\r \x85\xa0  -     　"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"

#: Fixed value: the pre-token pattern of the byte-level vocabularies, in the syntax of ``regex``.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts in Latin-1, and that of the vocabularies with word ends.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BYTE_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
OUTSIDE = re.compile("[^\x00-\xff]")
#: White space other than the space and the line feed.
OTHER_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What Python's str.split() takes for white space and the libraries don't.
SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def lettered(piece: str) -> str:
    """A piece in the byte-level alphabet."""
    return (piece if piece.isascii() else piece.encode().decode("latin-1")).translate(byte_letters())


class Memo(dict):
    """Key to value; makes what is missing and keeps the first ``cap`` keys of up to 64 characters."""

    def __init__(self, make: Callable[[str], object], cap: int):
        super().__init__()
        self.make, self.cap = make, cap

    def __missing__(self, key: str) -> object:
        value = self.make(key)
        if len(self) < self.cap and len(key) <= 64:
            self[key] = value
        return value


def uneven(text: str) -> bool:
    """Whether white space stands in a run, at an edge, or is neither a space nor a line feed; such texts take the general chunk pattern."""
    return not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text) is not None


def spaced(text: str, first: dict, rest: dict, any_chunk: dict, line_feed: bytes) -> bytes:
    """What the chunks of ``text`` map to, joined. ``rest`` has chunks without the space before them."""
    if uneven(text):
        return b"".join(map(any_chunk.__getitem__, CHUNK.findall(text)))
    lines = []
    for line in text.split("\n"):
        head, *tail = line.split(" ")
        lines.append(first[head] + b"".join(map(rest.__getitem__, tail)))
    return line_feed.join(lines)


class LibraryEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo: int = 350_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.leads = re.compile("[" + re.escape("".join({x[0] for x in self.added} or {"\0"})) + "]|" + OUTSIDE.pattern)
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.library.get_vocab_size() + 1)]
        #: White space is dropped by the pattern of the vocabularies with word ends.
        self.words = self.model.end_of_word_suffix is not None
        self.piece_ids = Memo(self._piece, memo // 4 if self.words else 2 * memo)
        self.chunk_ids = Memo(self._chunk, memo // 4)
        self.word_ids = Memo(self._chunk, memo)
        self.spaced_ids = Memo(self._spaced_chunk, memo)
        self.line_feed = self._chunk("\n")

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(lettered(piece))])

    def _spaced_chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._piece(" " + chunk)
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        if self.leads.search(chunk) and (OUTSIDE.search(chunk) or any(x in chunk for x in self.added)):
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.words:
            chunk = chunk.lower()
        pieces = [chunk] if chunk.isalpha() else WORD_PIECE.findall(chunk) if self.words else BYTE_PIECE.findall(chunk)
        if len(pieces) == 1:  # kept as a chunk already
            return self._piece(pieces[0])
        return b"".join(map(self.piece_ids.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        if not self.words:
            if (text.isascii() or not OUTSIDE.search(text)) and not any(x in text for x in self.added):
                return b"".join(map(self.piece_ids.__getitem__, BYTE_PIECE.findall(text)))
            return spaced(text, self.chunk_ids, self.spaced_ids, self.chunk_ids, self.line_feed)
        chunks = CHUNK.findall(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.word_ids.__getitem__, chunks))


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder for each Python worker and vocabulary."""
    return LibraryEncoder(path)
