"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes, kept as sorted arrays a depth: for each context the
counts of the bytes that follow it in the training texts. A byte is coded in the longest context the trie holds; if
the byte isn't there, an escape is coded and the next shorter context is tried, with the bytes of the longer one
excluded, down to a uniform choice among the bytes no context has seen. Escapes are estimated as half of the
number of distinct following bytes, taken off their counts. The code length of a text is the sum over its bytes and one end mark; contexts start
afresh in every text.

The trie is pretrained, so a byte's code length depends only on itself and the ``ORDER`` bytes before it. All grams of
all training texts are in the trie, which is built in shards: a shard has all windows whose ``LOW`` bytes before the last
one are its own, and with them all longer contexts of these; the shorter contexts are few and every shard has them.
A context that more windows share than a shard should have is dealt out by the contexts one byte longer, and so on; the shards of
these get the counts of the shared one, at most 256, beside their own windows.
Each distinct window of the table is scored once, in its shard. Texts take the code lengths of the most frequent
windows, those that reach the least count at which no more than ``FREQUENT_WINDOWS`` are left, from a broadcast, and
all others by a join.

Beside it stands a smoothed unigram score of words. The most frequent words, those that reach the least count at
which no more than ``FREQUENT_WORDS`` words are left, are scored from a broadcast, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, give_back, slices, stored, tidy
from .shingles import word_hashes

ORDER = 6
FREQUENT_WINDOWS = 2_000_000
FREQUENT_WORDS = 300_000
#: Context bytes that windows of one shard share, and the windows that a shard has on average.
LOW, SHARD_WINDOWS = 3, 200_000
#: Contexts of a size that are dealt out over shards, because too many windows share them, are no more than so many.
CROWDED = 1_000_000
FOLDS = 10
#: A byte that UTF-8 never holds: it fills the context before a text and marks its end.
MARK = b"\xff"
#: Bytes of text whose windows are held at once.
STEP = 1 << 20
#: Distinct keys of a kind that a task gathers before it hands their counts on, and the rows it hands on at once.
FLUSH_KEYS, HANDED_ROWS = 4_000_000, 100_000
GRAM, WORD = 0, 1
#: Fixed value: the name of the token that ends a text, which no hash of a word is allowed to be.
END_TOKEN = np.uint64(0)


def windows(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owner) of the windows of ORDER + 1 bytes of each text with its marks, a bounded number at a time."""
    pieces: list[tuple[int, bytes]] = []
    held = 0
    for k, text in enumerate(raw):
        stream = MARK * ORDER + text + MARK
        for at in range(0, len(stream) - ORDER, STEP):
            piece = stream[at : at + STEP + ORDER]
            if held and held + len(piece) > STEP:
                yield _windows(pieces)
                pieces, held = [], 0
            pieces.append((k, piece))
            held += len(piece)
    if pieces:
        yield _windows(pieces)


def _windows(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(p for _, p in pieces), dtype=np.uint8)
    n = len(raw) - ORDER
    codes = raw[:n].astype(np.uint64)
    for k in range(1, ORDER + 1):
        codes <<= np.uint64(8)
        codes |= raw[k : n + k]
    sizes = np.array([len(p) for _, p in pieces])
    owner = np.repeat(np.arange(len(pieces)), sizes)[:n]
    last = np.cumsum(sizes) - ORDER
    place = np.arange(n)
    keep = place < last[owner]
    return codes[keep], np.array([k for k, _ in pieces])[owner[keep]]


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of all words and end tokens; A-Z count as lower case."""
    hashes, owners = [], []
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        got, starts = word_hashes(b"\n".join(raw[k] for k in group).lower())
        ends = np.cumsum([len(raw[k]) + 1 for k in group])
        hashes.append(np.where(got == END_TOKEN, np.uint64(1), got))
        owners.append(np.array(group)[np.searchsorted(ends, starts, side="right")])
        group, held = [], 0

    for k, text in enumerate(raw):
        if group and held + len(text) > STEP:
            flush()
        group.append(k)
        held += len(text)
    if group:
        flush()
    hashes.append(np.full(len(raw), END_TOKEN))
    owners.append(np.arange(len(raw)))
    return np.concatenate(hashes), np.concatenate(owners)


class Tally:
    """Counts of 64-bit keys in sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        got = np.unique(keys, return_counts=True)
        self.parts.append(got)
        self.size += len(got[0])
        if len(self.parts) > 4:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys, kind="stable")  # the parts are sorted, so this merges them
        keys, counts = keys[order], np.concatenate([c for _, c in self.parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.parts = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.size = len(first)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self._merge()
        got, self.parts, self.size = self.parts[0], [], 0
        return got


def _counts(rows: DataFrame) -> DataFrame:
    """How often each byte gram and each word stands in all training texts, and each gram in all texts: kind, key, n, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {(GRAM, False): Tally(), (GRAM, True): Tally(), (WORD, False): Tally()}

        def handed(kind: int, held_out: bool) -> Iterator[pa.RecordBatch]:
            every, counts = tallies[kind, held_out].taken()
            for at in range(0, len(every), HANDED_ROWS):
                keys, m = every[at : at + HANDED_ROWS], counts[at : at + HANDED_ROWS].astype(np.int64)
                n = np.zeros_like(m) if held_out else m
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(m)], names=["kind", "key", "n", "m"])

        for batch in batches:
            for part, texts in slices(batch):
                held = part.column(1).to_pylist()
                for held_out in (False, True):
                    raw = [t.encode() for t, h in zip(texts, held, strict=True) if h == held_out]
                    if not raw:
                        continue
                    for codes, _ in windows(raw):
                        tallies[GRAM, held_out].add(codes)
                    if not held_out:
                        tallies[WORD, False].add(words_of(raw)[0])
                for kind, tally in tallies.items():
                    if tally.size > FLUSH_KEYS:
                        yield from handed(*kind)
        for kind in tallies:
            yield from handed(*kind)

    # Tasks have counted already: adding up before the shuffle as well would fill a hash map and save nothing.
    counted = rows.select("text", "held_out").mapInArrow(tidy(run), "kind int, key long, n long, m long").repartition("kind", "key")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Lengths:
    """A hash table of the code lengths (log10 of the probability) of distinct windows."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=np.uint64)
        self.logs = np.zeros(1 << bits, dtype=np.float32)
        todo, slot, self.probes = np.arange(len(codes)), self._slot(codes), 0
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == np.uint64(2**64 - 1))
            taken, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[taken], self.logs[taken] = codes[todo[placed]], logs[todo[placed]]
            rest = np.ones(len(todo), dtype=bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code lengths, 0 for windows that aren't here; whether each is here)."""
        slot = self._slot(codes)
        out = self.logs[slot].astype(np.float64)
        open_ = np.flatnonzero(self.keys[slot] != codes)
        slot = slot[open_]
        found = np.ones(len(codes), dtype=bool)
        found[open_], out[open_] = False, 0.0
        on = self.keys[slot] != np.uint64(2**64 - 1)
        open_, slot = open_[on], slot[on]
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == codes[open_]
            out[open_[hit]] = self.logs[slot[hit]]
            found[open_[hit]] = True
            on = ~hit & (self.keys[slot] != np.uint64(2**64 - 1))
            open_, slot = open_[on], slot[on]
        return out, found


class Trie:
    """The pretrained trie: for each order the sorted grams and contexts with what coding needs."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """grams[k]: codes of k + 1 bytes, ascending, and counts; totals[k]: contexts of k bytes and their full counts."""
        self.grams = grams
        self.contexts = []
        for k, (codes, counts) in enumerate(grams):
            context, first, distinct = np.unique(codes >> np.uint64(8), return_index=True, return_counts=True)
            kept = np.add.reduceat(counts, first) if len(codes) else np.empty(0, dtype=np.int64)
            full = _at(totals[k], context)
            excluded = np.zeros(len(context), dtype=np.int64)
            if k and len(codes):
                below = _at(grams[k - 1], codes & np.uint64((1 << (8 * k)) - 1))
                excluded = np.add.reduceat(below, first)
            self.contexts.append((context, kept, distinct, np.maximum(full - kept, 0), excluded))
        codes, counts = grams[-1]
        context, kept, _, missed, _ = self.contexts[-1]
        at = np.searchsorted(context, codes >> np.uint64(8))
        self.longest = Lengths(codes, np.log10((counts - 0.5) / (kept + missed)[at]) if len(codes) else np.empty(0))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the bytes before it."""
        out, found = self.longest.find(codes)
        rest = np.flatnonzero(~found)
        if len(rest):
            distinct, at = np.unique(codes[rest], return_inverse=True)
            out[rest] = self.escaped(distinct)[at]
        return out

    def escaped(self, codes: np.ndarray) -> np.ndarray:
        """The same, from the longest context down, for any windows."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        used, gone = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        for k in range(ORDER, -1, -1):
            now = codes[open_]
            context, kept, distinct, missed, excluded = self.contexts[k]
            if not len(context):
                continue
            wanted = (now >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(context, wanted), len(context) - 1)
            there = context[at] == wanted
            left, new = kept[at] - gone[open_], distinct[at] - used[open_]
            whole = left + missed[at]
            live = there & (left > 0)
            count = _at(self.grams[k], now & np.uint64((1 << (8 * (k + 1))) - 1))
            seen = live & (count > 0)
            out[open_[seen]] += np.log10((count[seen] - 0.5) / whole[seen])
            escapes = live & ~seen
            out[open_[escapes]] += np.log10((new / 2 + missed[at])[escapes] / whole[escapes])
            used[open_[there]], gone[open_[there]] = distinct[at][there], excluded[at][there]
            open_ = open_[~seen]
        out[open_] -= np.log10(np.maximum(1, 256 - used[open_]))
        return out

    def score(self, raw: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text with its end mark."""
        out = np.zeros(len(raw))
        for codes, owner in windows(raw):
            out += np.bincount(owner, weights=self.log10(codes), minlength=len(raw))
        return out


def _at(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values of keys in a table of ascending keys; 0 where there are none."""
    own, values = table
    if not len(own):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, values[at], 0)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and the sums of their counts."""
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def _lower(grams: tuple[np.ndarray, np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of an order from those of a higher one."""
    return _summed(grams[0] & np.uint64((1 << (8 * (order + 1))) - 1), grams[1])


def _context(size: int) -> Column:
    """The ``size`` bytes before the last one of a window."""
    return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def _with_depths(grams: DataFrame, limit: int) -> DataFrame:
    """The windows with ``depth``, the size of the shortest context of LOW bytes or more that no more than ``limit`` windows share.

    Contexts that more of them share are at most as many as ``limit`` goes into the number of windows, so they are
    broadcast. Windows with the same context of ORDER bytes stay together, as there are no more than 256 of them.
    """
    now = grams.withColumn("depth", F.lit(LOW))
    for size in range(LOW, ORDER):
        shared = now.where(F.col("depth") == size).groupBy(_context(size).alias("context")).agg(F.count("*").alias("windows"))
        crowded = stored(shared.where(F.col("windows") > limit).select("context", F.lit(1).alias("crowded")), "crowded")
        if crowded.isEmpty():
            break
        reached = (F.col("depth") == size) & (_context(size) == F.col("context"))
        now = now.join(F.broadcast(crowded), reached, "left").withColumn("depth", F.col("depth") + F.coalesce("crowded", F.lit(0))).drop("context", "crowded")
    return now


def _sent_along(windows: DataFrame) -> DataFrame:
    """What shards need of contexts that other shards have windows of too: the counts of their grams, once a shard.

    ``windows`` has key, n, depth and shard. A crowded context has up to 256 grams, and the up to 256 contexts one
    byte longer take them to their shards. Returns shard, size (of the context), code, n.
    """
    split = windows.where(F.col("depth") > LOW).select("key", "n", "shard", F.explode(F.sequence(F.lit(LOW), F.col("depth") - 1)).alias("size"))
    split = split.withColumn("code", F.expr("key & (shiftleft(1L, 8 * (size + 1)) - 1)")).withColumn("context", F.shiftrightunsigned("code", 8))
    counts = split.where("n > 0").groupBy("size", "context", "code").agg(F.sum("n").alias("n"))
    return split.select("size", "context", "shard").distinct().join(counts, ["size", "context"]).select("shard", "size", "code", "n")


def _sharded(grams: DataFrame) -> DataFrame:
    """The rows of each shard: shard, key, n, m, depth, sent.

    These are windows, whose shard has all windows with the same context of ``depth`` bytes, and grams of shorter
    contexts that were ``sent`` along, with the size of their context as ``depth``. A shard has about SHARD_WINDOWS
    windows, and no context takes more than an eighth of that into one shard (but for tables of more than
    CROWDED times as many windows).
    """
    total = grams.count()
    windows = _with_depths(grams, max(SHARD_WINDOWS // 8, total // CROWDED))
    context = F.coalesce(*[F.when(F.col("depth") == size, _context(size)) for size in range(LOW, ORDER + 1)])
    windows = windows.withColumn("shard", F.pmod(F.xxhash64(context), F.lit(max(1, -(-total // SHARD_WINDOWS)))).cast("int"))
    along = _sent_along(windows).select("shard", F.col("code").alias("key"), "n", F.lit(0).cast("long").alias("m"), F.col("size").alias("depth"), F.lit(True).alias("sent"))
    return windows.select("shard", "key", "n", "m", "depth", F.lit(False).alias("sent")).unionByName(along)


def _lengths(grams: DataFrame) -> DataFrame:
    """The code length of every distinct window (key, n in training texts, m in all texts): code, m, log."""
    spark = grams.sparkSession
    short = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * LOW)) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    low = [_summed(short.column(0).to_numpy().view(np.uint64), short.column(1).to_numpy())]
    for k in range(LOW - 2, -1, -1):
        low.insert(0, _lower(low[0], k))
    shared = spark.sparkContext.broadcast(low)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sent = rows["sent"].to_numpy(bool)
        key, n, depth = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy(), rows["depth"].to_numpy()
        every = list(shared.value)
        for k in range(LOW, ORDER + 1):
            # Counts of a context of k bytes are whole where its windows are all here, or were summed before.
            whole = (n > 0) & np.where(sent, depth == k, depth <= k)
            every.append(_summed(key[whole] & np.uint64((1 << (8 * (k + 1))) - 1), n[whole]))
        trie = Trie(every, [_summed(c >> np.uint64(8), x) for c, x in every])
        out = pd.DataFrame({"code": rows["key"].to_numpy()[~sent], "m": rows["m"].to_numpy()[~sent], "log": trie.log10(key[~sent]).astype(np.float32)})
        del trie, every
        give_back()
        return out

    return _sharded(grams).groupBy("shard").applyInPandas(run, "code long, m long, log float")


def _least_count(counted: DataFrame, bound: int) -> int:
    """The least count (column n) that no more than ``bound`` rows reach, from a small table of how many rows have each count.

    Counts are rounded down to three significant digits there.
    """
    size = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10("n")) - 2))
    histogram = counted.groupBy((F.floor(F.col("n") / size) * size).cast("long").alias("n")).agg(F.count("*").alias("rows")).collect()
    least, left = 1, bound
    for row in sorted(histogram, key=lambda r: -r["n"]):
        left -= row["rows"]
        if left < 0:
            return least if least > 1 else row["n"] + 1
        least = row["n"]
    return 1


def _listed(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each of ``n`` owners the list of its distinct keys and the list of how often each stands."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])[: len(keys)])
    times = np.diff(np.append(new, len(keys)))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


def score(documents: DataFrame) -> DataFrame:
    """Scores every whole text; the model learns from rows whose fold (crc32 of the id as text, modulo 10) isn't 0.

    Returns a row for each row: ``doc_id, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score
    double``. A null text counts as empty: its end token and end mark alone. A null id counts as the empty text for
    its fold, which makes the row held out. Repeated rows count as often as they stand; further columns are ignored;
    an empty table gives no rows, and without training rows all words are unknown and all bytes equally likely.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_fold(F.col("doc_id").cast("long")) % FOLDS == 0).alias("held_out"))
    counts = stored(_counts(rows), "counts")
    lengths = stored(_lengths(counts.where(F.col("kind") == GRAM).select("key", "n", "m")), "lengths")
    least = _least_count(lengths.select(F.col("m").alias("n")), FREQUENT_WINDOWS)
    often = lengths.where(F.col("m") >= least).select("code", "log").toArrow()
    direct = spark.sparkContext.broadcast(Lengths(often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()))
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    whole = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole["n"] or 0, whole["v"]
    floor = total + 0.1 * (distinct + 1)
    frequent = words.where(F.col("c") >= _least_count(words.withColumnRenamed("c", "n"), FREQUENT_WORDS)).toArrow()
    order = np.argsort(frequent.column(0).to_numpy())
    known = (frequent.column(0).to_numpy()[order], frequent.column(1).to_numpy()[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, texts in slices(batch):
                raw, n = [t.encode() for t in texts], len(texts)
                hashes, owner = words_of(raw)
                seen = _at(known, hashes.view(np.int64))
                base = np.bincount(owner, weights=np.where(seen > 0, np.log10((seen + 0.1) / floor), 0.0), minlength=n)
                rare = np.flatnonzero(seen == 0)
                code_length, left = np.zeros(n), [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))]
                for codes, of in windows(raw):
                    logs, found = direct.value.find(codes)
                    code_length += np.bincount(of, weights=logs, minlength=n)
                    left.append((codes[~found], of[~found]))
                yield pa.RecordBatch.from_arrays([
                    pa.array((np.int64(task) << np.int64(33)) + at + np.arange(n)), part.column(0), part.column(2),
                    pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, weights=seen > 0, minlength=n).astype(np.int64)), pa.array(base), pa.array(code_length),
                    *_listed(hashes[rare], owner[rare], n), *_listed(*map(np.concatenate, zip(*left, strict=True)), n),
                ], names=names)
                at += n

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "windows", "window_times"]
    scored = stored(rows.select("doc_id", "text", "held_out").mapInArrow(tidy(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>, windows array<long>, window_times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(floor))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    others = scored.select("row", F.explode(F.arrays_zip("windows", "window_times")).alias("x")).select("row", F.col("x.windows").alias("code"), F.col("x.window_times").alias("times"))
    coded = others.join(lengths.where(F.col("m") < least).select("code", "log"), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log").cast("double")).alias("code_length"))
    out = scored.drop("rare", "times", "windows", "window_times").join(rest, "row", "left").join(coded, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("code_length", F.lit(0.0))).alias("score"))
