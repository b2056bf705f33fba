"""Sets of word shingles as sorted 64-bit hashes, computed with numpy over many texts at once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: A text is hashed in segments of about so many bytes, cut at white space.
SEGMENT = 1 << 20
#: ASCII white space, and the multipliers of the word and shingle hashes.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = 0x9E3779B97F4A7C15 | 1
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype="<u8").astype(np.uint64)


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(BASE, -1, 1 << 64)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * STEPS[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of lower-cased bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    up, down = POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_bytes_table()[raw] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _segments(text: bytes) -> list[bytes]:
    """Parts of a long text that end at white space."""
    parts, at = [], 0
    while len(text) - at > SEGMENT:
        cut = at + SEGMENT
        while cut < len(text) and not IS_SPACE[text[cut]]:
            cut += 1
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words (A-Z lower-cased).

    A text with fewer words has its whole sequence as the one shingle, a text without words none.
    """
    raw = [t.encode().lower() for t in texts]
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(raw)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            hashes, starts = word_hashes(b"\n".join(raw[k] for k in held))
            ends = np.cumsum([len(raw[k]) + 1 for k in held])
            bounds = [0, *np.searchsorted(starts, ends).tolist()]
            for k, low, high in zip(held, bounds, bounds[1:], strict=False):
                out[k] = _set(hashes[low:high], width)
        held, size = [], 0

    for k, text in enumerate(raw):
        if len(text) > SEGMENT:
            out[k] = _set(np.concatenate([word_hashes(x)[0] for x in _segments(text)]), width)
            continue
        if size + len(text) > SEGMENT:
            flush()
        held.append(k)
        size += len(text) + 1
    flush()
    return out


def _set(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    n = len(words) - width + 1
    if n < 1:
        return mixed(np.array([sum(int(w) * pow(int(STEPS[3]), k + 1, 1 << 64) for k, w in enumerate(words)) % (1 << 64)], dtype=np.uint64))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * np.uint64(pow(int(STEPS[2]), k + 1, 1 << 64))
    return np.unique(mixed(total))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)
