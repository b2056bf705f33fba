"""Whole-word terms found by an Aho-Corasick automaton over folded code points.

The automaton of a list of terms is built once in each Python worker and reads every text once, whatever the number of
terms. Folding maps a code point to one code point, as case-insensitive patterns do, so offsets stay those of the text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import point_folds

#: Matches that are gathered before a batch is sent on.
BATCH_MATCHES = 20_000
MATCHES = "doc_id long, ord int, type string, start int, end int, text string, place long"


def folded(text: str) -> str:
    """A text of the same length whose equal code points differ in case at most."""
    return text.lower() if text.isascii() or not _odd().search(text) else text.translate(point_folds())


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Code points whose lower case is not their fold, and the sigma, whose lower case depends on what follows."""
    odd = sorted({k for k, f in point_folds().items() if chr(k).lower() != f} | {k for k in range(sys.maxunicode + 1) if k not in point_folds() and not 0xD800 <= k <= 0xDFFF and chr(k).lower() != chr(k)} | {0x3A3})
    return re.compile("[" + "".join(map(re.escape, map(chr, odd))) + "]")


@lru_cache(maxsize=1 << 16)
def in_word(c: str) -> bool:
    """Whether a code point is of a word: letters, marks, digits, connectors, joiners, and letters in circles and squares."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9" or "\U0001f130" <= c <= "\U0001f149" or "\U0001f150" <= c <= "\U0001f169" or "\U0001f170" <= c <= "\U0001f189"


class Terms:
    """An automaton of (ord, term, type) rows; terms that fold alike share their matches."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by_key: dict[str, list[tuple[int, str]]] = {}
        for ord_, term, kind in rows:
            by_key.setdefault(folded(term), []).append((ord_, kind))
        for key, own in by_key.items():
            self.automaton.add_word(key, (len(key), tuple(own)))
        if by_key:
            self.automaton.make_automaton()
        self.empty = not by_key

    def matches(self, text: str) -> list[tuple[int, str, int, int]]:
        """(ord, type, start, end) of all whole-word matches by start and ord; of one term's, those that a search from the left meets."""
        if self.empty or not text:
            return []
        found, reach, size = [], {}, len(text)
        for last, (length, own) in self.automaton.iter(folded(text)):
            start, end = last + 1 - length, last + 1
            if (start > 0 and in_word(text[start - 1])) == in_word(text[start]) or (end < size and in_word(text[end])) == in_word(text[last]):
                continue
            for ord_, kind in own:
                if reach.get(ord_, 0) <= start:
                    reach[ord_] = end
                    found.append((ord_, kind, start, end))
        return sorted(found, key=lambda m: (m[2], m[0]))


_BUILT: dict[int, Terms] = {}


def _of(shared: Broadcast, name: int) -> Terms:
    """The automaton of a broadcast list; a worker keeps the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Terms(shared.value)
    return _BUILT[name]


def scanned(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, ord, type, start, end, text, place of all matches of a table of terms (ord, term, type) that is small enough to be
    broadcast; ``place`` numbers a document's matches by start and ord. A null text has none."""
    shared = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in terms.collect()])
    name = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(shared, name)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows += [(doc, *m, text[m[2] : m[3]], k) for k, m in enumerate(own.matches(text))]
                if len(rows) > BATCH_MATCHES:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
    names = [x.split()[0] for x in MATCHES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
