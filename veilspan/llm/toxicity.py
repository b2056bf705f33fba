"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features are densities of lexicon terms, the nearness of lexicon terms to words that address the reader, and rates
of capitals, punctuation and obfuscation. The lexicon is learnt: terms and term beginnings whose document frequency
in toxic training texts stands out. Trees, lexicon and calibration are fitted on a bounded sample of labelled rows
(``sample_rows``); every text is scored whole.

Texts stay on the executors: they count the terms of the sample and compute its features. The driver gets the terms
that pass the test and some numbers a sampled row, and fits the trees on those.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, slices, stored, tidy

SAMPLE_ROWS = 6_000
LEXICON_TERMS = 300
FOLDS = 5
#: Words that address the reader, in the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself youre u ur ya tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie vosotros vuestro usted ustedes vos".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": "", "+": "t"})
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
DISGUISED = re.compile(r"[^\s]*[^\W\d_][0-9@$!|*._+-]+[^\W\d_][^\s]*|[0-9@$][^\W\d_]{2,}[^\s]*")
#: Words looked at on either side of a lexicon term for one that addresses the reader.
NEAR = 5
BEGINNINGS = (5, 7)


def terms(word: str) -> list[str]:
    """The lexicon keys of a lower-cased word: itself, and its beginnings where it is longer."""
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


class Lexicon(dict):
    """Lower-cased word to (weight of the word, largest weight of its beginnings, whether it addresses the reader), or None.

    Made from the weights of the learnt terms; words are looked up once and then kept.
    """

    def __init__(self, weights: dict[str, float] | None = None):
        super().__init__()
        self.weights = weights or {}

    def __missing__(self, word: str) -> tuple[float, float, bool] | None:
        whole, *parts = (self.weights.get(t, 0.0) for t in terms(word))
        value = (whole, max(parts, default=0.0), word in SECOND_PERSON)
        value = value if any(value) else None
        if len(self) < 300_000 and len(word) < 64:
            self[word] = value
        return value

    def __reduce__(self):
        return Lexicon, (self.weights,)


#: Symbols that stand for swearing.
SYMBOLS = "#$%&*"


def class_of(code: int) -> int:
    """Letter 1, capital 2, punctuation 4, symbol of SYMBOLS 8, for a code point of any script."""
    c = chr(code)
    return c.isalpha() | 2 * c.isupper() | 4 * (unicodedata.category(c)[0] in "PS" and c != "_") | 8 * (c in SYMBOLS)


CLASS = np.array([class_of(code) for code in range(256)], dtype=np.uint8)


def classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text, and the class of each."""
    try:
        codes = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
        return codes, CLASS[codes]
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        distinct, at = np.unique(codes, return_inverse=True)
        return codes, np.array([class_of(c) for c in distinct.tolist()], dtype=np.uint8)[at]


NAMES = ("words", "hits", "hit_density", "distinct", "strongest", "weight_density", "part_hits", "part_density", "part_strongest", "address_density", "nearest", "near_hits", "capitals", "shouted", "exclamations", "questions", "punctuation", "disguised", "disguised_hits", "repeated", "symbols")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text; an empty text has zeros."""
    words = WORD.findall(text.lower())
    n, size = max(1, len(words)), max(1, len(text))
    told = [(k, v) for k, v in enumerate(map(lexicon.__getitem__, words)) if v]
    hits = [(k, v[0]) for k, v in told if v[0] > 0]
    parts = [v[1] for _, v in told if v[1] > 0 and not v[0]]
    address = [k for k, v in told if v[2]]
    near, nearest = 0, NEAR + 1
    if hits and address:
        places = np.array(address)
        for k, _ in hits:
            at = int(np.searchsorted(places, k))
            gap = min((abs(int(places[j]) - k) for j in (at - 1, at) if 0 <= j < len(places)), default=NEAR + 1)
            near += gap <= NEAR
            nearest = min(nearest, gap)
    raw, kind = classes(text)
    capital, letter = (kind & 2) > 0, (kind & 1) > 0
    shouted = sum(len(w) > 1 and w.isupper() for w in WORD.findall(text)) if (capital[1:] & capital[:-1]).any() else 0
    repeated = int((letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])).sum())
    mixed = (~letter[1:-1] & (raw[1:-1] > 32) & letter[:-2] & letter[2:]).any() or any(c in text for c in "013457@$")
    disguised = DISGUISED.findall(text) if mixed else []
    opened = sum(1 for x in disguised if (v := lexicon[x.lower().translate(DISGUISE).strip(".,;:?\"'()")]) and (v[0] or v[1]))
    return [
        np.log1p(len(words)), float(len(hits)), 100 * len(hits) / n, float(len({words[k] for k, _ in hits})), max((a for _, a in hits), default=0.0), sum(a for _, a in hits) / n,
        float(len(parts)), 100 * len(parts) / n, max(parts, default=0.0), 100 * len(address) / n, float(NEAR + 1 - nearest), float(near),
        float(capital.sum()) / size, shouted / n, text.count("!") / n, text.count("?") / n, float(((kind & 4) > 0).sum()) / size,
        len(disguised) / n, float(opened), repeated / n, float(((kind & 8) > 0).sum()) / size,
    ]


class Trees:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(width)]
        binned = self._binned(x)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        raw, self.trees = np.full(n, self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._leaf(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """A full binary tree by levels: (feature, bin, value); feature -1 is a leaf."""
        nodes: list[tuple[int, int, float]] = []
        where, at = np.zeros(len(g), dtype=np.int64), 0
        for level in range(self.depth + 1):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(where == node)
                G, H = g[own].sum(), h[own].sum()
                value = float(-self.rate * G / (H + 1.0))
                best = (1e-6, -1, 0)
                if level < self.depth and len(own) >= 2 * self.least:
                    for k in range(binned.shape[1]):
                        b = binned[own, k]
                        top = len(self.edges[k]) + 1
                        gs, hs, cs = (np.cumsum(np.bincount(b, weights=w, minlength=top))[:-1] for w in (g[own], h[own], None))
                        if not len(gs):
                            continue
                        gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                        gain[(cs < self.least) | (len(own) - cs < self.least)] = -1
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (float(gain[j]), k, j)
                nodes.append((best[1], best[2], value))
                if best[1] >= 0:
                    where[own] = 2 * node + 1 + (binned[own, best[1]] > best[2])
            at += 2**level
        return nodes

    @staticmethod
    def _leaf(tree: list[tuple[int, int, float]], binned: np.ndarray) -> np.ndarray:
        feature, bound, value = (np.array(v) for v in zip(*tree, strict=True))
        at = np.zeros(len(binned), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            rows = np.flatnonzero(inner)
            now = at[rows]
            at[rows] = 2 * now + 1 + (binned[rows, feature[now]] > bound[now])

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.start + sum(self._leaf(t, binned) for t in self.trees)


class Isotonic:
    """The non-decreasing step function nearest to 0/1 labels, by pooling adjacent violators."""

    def fit(self, score: np.ndarray, label: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
            blocks.append([y, 1.0, s])
            while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
                y2, n2, top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, max(top, blocks[-1][2])]
        self.tops = np.array([b[2] for b in blocks])
        self.values = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return self.values[np.minimum(np.searchsorted(self.tops, score, side="left"), len(self.values) - 1)]


@dataclass
class Model:
    """What scoring needs; a few thousand numbers."""

    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None
    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts])
        raw = self.trees.raw(x)
        # Within a step of the calibration, the trees' order shows in the sixth digit, but never across one half.
        steps = self.calibration(raw)
        fine = steps + 1e-6 / (1 + np.exp(-raw))
        return np.clip(np.where(steps < 0.5, np.minimum(fine, 0.4999999), fine), 0, 1)


def sampled(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame | None:
    """At most ``sample_rows`` labelled rows, stored: text, toxic, part (0 or 1, by the text); None where there are none.

    Labels come from rows whose fold isn't 0. Contradicting labels of one id count by their mean. Which rows are in the
    sample is settled by hashes of ids and texts, so only those numbers come to the driver; of rows with equal id and
    text one counts.
    """
    truth = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").where(crc_fold("doc_id") % FOLDS != 0)
    chosen = truth.where(crc_fold("doc_id") % FOLDS != 0).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample_rows).collect()
    if not chosen:
        return None
    spark = documents.sparkSession
    named = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int"))
    found = rows.join(named, "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "text", "toxic")
    found = stored(found.groupBy("doc_id", "mark", "toxic").agg(F.first("text").alias("text")), "labelled")
    marks = found.select("doc_id", "mark").orderBy(F.xxhash64("mark", "doc_id")).limit(sample_rows).collect()
    kept = F.broadcast(spark.createDataFrame([(r["doc_id"], r["mark"]) for r in marks], "doc_id long, mark long"))
    return found.join(kept, ["doc_id", "mark"]).select("text", "toxic", F.pmod("mark", F.lit(2)).cast("int").alias("part"))


def term_counts(sample: DataFrame) -> DataFrame:
    """In how many texts each term stands, by part and label: term, part, toxic, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part, texts in slices(batch):
                for text, toxic, half in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    counts.update((t, half, toxic) for t in {t for w in set(WORD.findall(text.lower())) for t in terms(w)})
                if len(counts) > 300_000:
                    yield handed(counts)
                    counts.clear()
        yield handed(counts)

    def handed(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "part", "toxic", "n"])

    return sample.select("text", "toxic", "part").mapInArrow(tidy(run), "term string, part int, toxic int, n long").groupBy("term", "part", "toxic").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame, n1: int, n0: int, size: int) -> Lexicon:
    """The ``size`` terms whose document frequency in toxic texts stands out most, weighted by their log odds.

    ``counts`` holds term, toxic, n; n1 and n0 are the numbers of toxic and other texts.
    """
    n1, n0 = max(1, n1), max(1, n0)
    both = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    p, q, pooled = F.col("a") / F.lit(n1), F.col("b") / F.lit(n0), (F.col("a") + F.col("b")) / F.lit(n1 + n0)
    z = (p - q) / F.sqrt(F.greatest(F.lit(1e-12), pooled * (1 - pooled) * F.lit(1 / n1 + 1 / n0)))
    scored = both.where((F.col("a") >= 3) & (z >= 4) & (p >= 4 * q)).select("term", z.alias("z"), F.log((p + 1e-4) / (q + 1e-4)).alias("weight"))
    return Lexicon({r["term"]: r["weight"] for r in scored.orderBy(F.desc("z"), "term").limit(size).collect()})


def sample_features(sample: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(labels, parts, a feature matrix for each lexicon) of the sample, in an order that doesn't depend on its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                rows = [[x for own in lexicons for x in features(t, own)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    got = sample.select("text", "toxic", "part").mapInArrow(tidy(run), "toxic int, part int, x array<double>").collect()
    got.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), len(lexicons), len(NAMES))
    return np.array([r["toxic"] for r in got], dtype=np.float64), np.array([r["part"] for r in got]), [x[:, k] for k in range(len(lexicons))]


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_terms: int = LEXICON_TERMS) -> Model:
    """A model from at most ``sample_rows`` labelled rows; held-out rows are never used.

    The calibration uses scores of rows that lexicon and trees haven't seen: each half is scored by a model of the
    other. With no labels, or labels of one class only, every score is the share of toxic rows (0 without labels).
    """
    sample = sampled(documents, labels, sample_rows)
    if sample is None:
        return Model(Lexicon(), None, None, 0.0)
    sizes = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    rows, toxic = sum(sizes.values()), sum(n for (_, y), n in sizes.items() if y)
    share = toxic / rows if rows else 0.0
    if rows < 40 or len(sizes) < 4:
        return Model(Lexicon(), None, None, share)
    counts = stored(term_counts(sample), "terms")
    halves = [lexicon_of(counts.where(F.col("part") != k), sizes[1 - k, 1], sizes[1 - k, 0], lexicon_terms) for k in (0, 1)]
    lexicon = lexicon_of(counts, toxic, rows - toxic, lexicon_terms)
    y, part, (*half_x, x) = sample_features(sample, [*halves, lexicon])
    raw = np.zeros(len(y))
    for k in (0, 1):
        raw[part == k] = Trees().fit(half_x[k][part != k], y[part != k]).raw(half_x[k][part == k])
    return Model(lexicon, Trees().fit(x, y), Isotonic().fit(raw, y), share)


def toxicity(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores every whole text for toxicity as ``labels.toxic`` marks it.

    Returns a row for each row: ``doc_id, held_out boolean, score double (0 to 1), predicted int``. Ids, languages
    and sources are no inputs of a score. A null text counts as empty; empty texts are scored too. A null id counts
    as the empty text for its fold, which makes the row held out. Repeated rows get equal scores; further columns
    are ignored; an empty table gives no rows.
    """
    model = fit(documents, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                score = model.score(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id").cast("long")) % FOLDS == 0).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` whose whole texts score under one half, with all their columns as they are.

    A null text counts as empty. Rows with equal texts, and so repeated rows, stay or go together, whatever their ids;
    null ids are no matter. Columns of any name pass through; an empty table gives no rows.
    """
    model = fit(documents, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield part.filter(pa.array(model.score(texts) < 0.5))

    return documents.mapInArrow(tidy(run), documents.schema)
