"""Byte-level BPE encoding and decoding with length-bucketed, padded numpy matrices.

Pre-tokens of similar length form one padded matrix of ids. In each round every row merges its leftmost pair of
minimum rank; ranks of pairs come from an open-addressing hash table, and a compaction drops the merged column
and the rows that are done. A pre-token of more than ``LONGEST`` bytes is a matrix of one row. It would need as many
rounds as it has merges, so a round there merges all places of the minimum rank, from the left, wherever no pair that
comes about on the way has that rank or a smaller one: then merging the leftmost place again and again gives the same.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .tokens import BYTE_PATTERN, BYTE_PIECE, CHUNK, OUTSIDE, spaced, uneven

BUCKETS = (2, 3, 4, 6, 8, 11, 15, 20, 27, 36, 48, 64)
LONGEST = BUCKETS[-1]
NONE = np.int32(2**31 - 1)


class PairRanks:
    """(left id, right id) to the rank of their merge, by open addressing at a load of a quarter or less."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=np.uint64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.ranks[slot] == NONE
            taken, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[taken], self.ranks[taken] = keys[todo[placed]], rank[todo[placed]]
            left_over = np.ones(len(todo), dtype=bool)
            left_over[placed] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where two ids don't merge; ids below 0 are padding and never merge."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.ranks[slot] != NONE))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != NONE)]
        found[(left < 0) | (right < 0)] = NONE
        return found


class MatrixBpe:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str, pattern: str, memo: int = 450_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern, self.memo = regex.compile(pattern), memo
        #: Chunks between white space don't depend on each other under this pattern; under any other whole texts are split.
        self.chunks = pattern == BYTE_PATTERN
        size = max(self.ranks.values()) + 1
        self.strings = [b""] * size
        for string, rank in self.ranks.items():
            self.strings[rank] = string
        self.id_bytes = [k.to_bytes(4, "little") for k in range(size)]
        self.decimals = [str(k) for k in range(size)]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[s[:k]], self.ranks[s[k:]], r) for s, r in self.ranks.items() for k in range(1, len(s)) if s[:k] in self.ranks and s[k:] in self.ranks]
        self.pair_ranks = PairRanks(*np.array(pairs, dtype=np.int32).T)
        self.pieces: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def split(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk) if OUTSIDE.search(chunk) else BYTE_PIECE.findall(chunk)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit bytes, by the matrices."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            out[k] = self.merge_long(pieces[k]).astype("<u4").tobytes()
        for k in np.flatnonzero(sizes == 1).tolist():
            out[k] = int(self.byte_ids[pieces[k][0]]).to_bytes(4, "little")
        low = 1
        for width in BUCKETS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(rows), 8192):
                self._bucket(pieces, rows[at : at + 8192], sizes, width, out)
            low = width
        return out

    def _bucket(self, pieces: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in rows), dtype=np.uint8).reshape(len(rows), width)
        size = sizes[rows]
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                done, ends = ids[over], np.cumsum(4 * size[over]).tolist()
                flat = done[done >= 0].astype("<u4").tobytes()
                for k, low, high in zip(rows[over].tolist(), [0, *ends], ends, strict=False):
                    out[k] = flat[low:high]
                on = ~over
                rows, size, ids, ranks, at, best = rows[on], size[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    return
            n, w = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            stays = np.ones((n, w), dtype=bool)
            stays[each, at + 1] = False
            ids = ids[stays].reshape(n, w - 1)
            size = size - 1
            stays = np.ones((n, w - 1), dtype=bool)
            stays[each, at] = False
            ranks = ranks[stays].reshape(n, w - 2)
            if w - 2:
                k = np.flatnonzero(at > 0)
                ranks[k, at[k] - 1] = self.pair_ranks(ids[k, at[k] - 1], ids[k, at[k]])
                k = np.flatnonzero(at < w - 2)
                ranks[k, at[k]] = self.pair_ranks(ids[k, at[k]], ids[k, at[k] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one long pre-token."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                each = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, each, 0))
                at = at[(each - run) % 2 == 0]  # of overlapping places every second one
                met = np.full(len(at), best, dtype=np.int32)
                before = np.where(np.diff(at, prepend=-3) == 2, best, np.where(at > 0, ids[at - 1], -1))
                after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                if min(self.pair_ranks(before, met).min(), self.pair_ranks(met, after).min()) <= best:
                    at = at[:1]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            now = at - np.arange(len(at))
            for k in (now[now > 0] - 1, now[now < len(ranks)]):
                ranks[k] = self.pair_ranks(ids[k], ids[k + 1])
        return ids

    def _learn(self, chunks: set[str], into: dict[str, bytes], lead: str) -> None:
        """Adds the ids of new chunks, merging their new pre-tokens together."""
        alone = [c for c in chunks if c.isalpha()]  # letters only: one pre-token
        split = [(c, self.split(lead + c)) for c in chunks if not c.isalpha()]
        new = list({p for _, pieces in split for p in pieces}.difference(self.pieces))
        raw = [(lead + c).encode() for c in alone] + [p.encode() for p in new]
        ids = [b"" if (r := self.ranks.get(b)) is None else self.id_bytes[r] for b in raw]
        open_ = [k for k, x in enumerate(ids) if not x and raw[k]]
        for k, x in zip(open_, self.merge([raw[k] for k in open_]), strict=True):
            ids[k] = x
        into.update(zip(alone, ids, strict=False))
        self.pieces.update(zip(new, ids[len(alone) :], strict=True))
        for c, pieces in split:
            into[c] = b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if len(self.pieces) + len(self.first) + len(self.rest) > self.memo:
            self.pieces, self.first, self.rest = {}, {}, {}
        if not self.chunks:
            split = [[m[0] for m in self.pattern.finditer(t)] for t in texts]
            new = list({p for pieces in split for p in pieces}.difference(self.pieces))
            raw = [p.encode() for p in new]
            known = [self.ranks.get(b) for b in raw]
            merged = iter(self.merge([b for b, r in zip(raw, known, strict=True) if r is None]))
            self.pieces.update((p, next(merged) if r is None else self.id_bytes[r]) for p, r in zip(new, known, strict=True))
            return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in split]
        first, rest = {"\n"}, set()
        for text in texts:
            if uneven(text):
                first.update(CHUNK.findall(text))
            else:
                for line in text.split("\n"):
                    head, *tail = line.split(" ")
                    first.add(head)
                    rest.update(tail)
        self._learn(first.difference(self.first), self.first, "")
        self._learn(rest.difference(self.rest), self.rest, " ")
        return [spaced(t, self.first, self.rest, self.first, self.first["\n"]) for t in texts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def matrix_bpe(path: str, pattern: str) -> MatrixBpe:
    """One codec for each Python worker and rank file."""
    return MatrixBpe(path, pattern)


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns ``doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string`` for each row. A null text counts
    as empty: no ids, and the digests of the empty string. Null and repeated ids, repeated rows and further
    columns pass through or are ignored; an empty table gives no rows. Nothing is shuffled.
    """

    def digests(texts: list[str]) -> dict[str, object]:
        bpe = matrix_bpe(ranks_path, pattern)
        n, ids_sha, text_sha = [], [], []
        for raw in bpe.encode(texts):
            ids = np.frombuffer(raw, dtype="<u4").tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return {"n_tokens": np.array(n, dtype=np.int64), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_texts(documents, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
