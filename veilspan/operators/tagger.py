"""A statistical analyser for names, organisations and addresses: an averaged perceptron over tag sequences.

A token's score for a tag is the sum of weights of features of three words: its own, the one before and the one after.
Each of these depends on a word alone, so a batch of texts needs one score for each different word and place; a best path
over tags is then found for many segments at once. Training mixes parameters: every partition learns from its own
sentences, the weights are averaged, and the next round starts from the mean.

No tagged corpus comes with the package. ``lesson_sentences`` makes tagged sentences of patterns and word lists, and text that
is known to hold no names can be added as counterexamples.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("PERSON", "ORGANIZATION", "STREET_ADDRESS")
TAGS = ["O", *[f"{b}-{k}" for k in KINDS for b in ("B", "I")]]
BUCKETS = 1 << 16
TOKEN = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")
#: Segments longer than this are read in parts; a part of a line ends after a full stop that no title precedes.
LONGEST = 200
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof".split())
SENTENCES = "tokens array<string>, tags array<string>"

# Words that the lessons are made of.
FIRST = "Anna Martin Claire Omar Priya Daniel Lucia Henrik Maria Peter Grace Samuel Ines Tomas Noor Felix Hannah Victor Leila Oscar".split()
LAST = "Hartley Sorensen Okafor Petrov Lindqvist Moreau Castellan Whitfield Novak Brandt Delgado Ferris Gallagher Iversen Jansen Kovacs Larkin Menzies Osei Pemberton".split()
STREETS = "Riverside Station Church Victoria Orchard Harbour Mill Garden Bridge Albert Hillcrest Market".split()
TYPES = "Street St Road Rd Avenue Ave Lane Drive Court Place Boulevard Way Terrace Crescent".split()
PLACES = "Newport Ashfield Richmond Fairview Kingston Marrick Bayside Preston Glenroy Westbrook".split()
STATES = "NSW VIC QLD WA SA TAS".split()
FIRMS = "Mutual Bank Ltd Limited Group University Insurance Partners Hospital Holdings Pty Council Court".split()
ROLES = "supervisor manager colleague partner spouse doctor nurse landlord sister neighbour director assistant".split()
PATTERNS = (
    "{P} called about the claim .", "Please contact {P} at the office .", "Claimant : Ms . {P}", "Patient : Mr . {P}", "Dr . {L} wrote to {P} .", "Sent by her {R} , {P} , who asked for it .", "My {R} , {P} , has approved the form .",
    "{F} has since agreed .", "{F} said so .", "{F} told us .", "I spoke with {P} yesterday .", "{P} and {P} met at {O} .", "Regards , {P}", "Signed : {P}", "Dear {F} ,", "{O} confirmed the payment .", "We had a letter from {O} today .",
    "Checked against {O} , a partner .", "She is employed by {O} .", "He banks with {O} and {O} .", "Post to {A} .", "He lives at {A} .", "Address : {A}", "Send it to {A} , please .", "Mail went to {P} , {A} .",
    "Reference : CR-{N}-AC", "She can be reached at {N} {N} .", "Checked against the list of {N} items .", "The claim was lodged on Monday .", "Payment of {N} is due .", "It is not known when they came .", "Then the office closed .", "Mail a copy to the address above .",
    "Post it again .", "His {R} asked for the file .", "Please wait for the {R} .", "Under the Act this is allowed .", "On Friday the Board met .", "There were {N} of them .", "Has anyone seen the form ?", "Order number {N} is late .", "Their report came in March .", "Reference numbers are new .",
)


def _invented(rng: random.Random) -> str:
    """A capitalised word of made-up syllables, so that names are told by more than a list."""
    return "".join(rng.choice("b d f g h k l m n p r s t v br st th".split()) + rng.choice("a e i o u ai ou".split()) for _ in range(rng.randrange(1, 4))).capitalize() + rng.choice(["", "n", "r", "ll", "k", "s"])


def lesson(rng: random.Random) -> tuple[list[str], list[str]]:
    """A tagged sentence."""
    tokens, tags = [], []

    def put(words: list[str], kind: str | None) -> None:
        tokens.extend(words)
        tags.extend(["O"] * len(words) if kind is None else [f"{'I' if k else 'B'}-{kind}" for k in range(len(words))])

    def some(words: list[str]) -> str:
        return _invented(rng) if rng.random() < 0.6 else rng.choice(words)

    for x in rng.choice(PATTERNS).split():
        if x == "{P}":
            put([some(FIRST), *[some(LAST)] * (rng.random() < 0.9)], "PERSON")
        elif x in ("{F}", "{L}"):
            put([some(FIRST if x == "{F}" else LAST)], "PERSON")
        elif x == "{O}":
            put([some(LAST + PLACES), *([some(STREETS)] if rng.random() < 0.3 else []), rng.choice(FIRMS)], "ORGANIZATION")
        elif x == "{A}":
            put([str(rng.randrange(1, 400)), *[some(STREETS) for _ in range(rng.randrange(1, 3))], rng.choice(TYPES), *([","] if rng.random() < 0.7 else []), some(PLACES), rng.choice(STATES), str(rng.randrange(1000, 9999))], "STREET_ADDRESS")
        elif x == "{R}":
            put([rng.choice(ROLES)], None)
        else:
            put([x.replace("{N}", str(rng.randrange(10, 99999)))], None)
    return tokens, tags


def lesson_sentences(spark: SparkSession, n: int = 4000, seed: int = 11) -> DataFrame:
    """``n`` tagged sentences (tokens, tags), made where they are used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [lesson(random.Random(seed * 1_000_003 + k)) for k in batch["id"]]
            yield pd.DataFrame({"tokens": [t for t, _ in made], "tags": [g for _, g in made]})

    return spark.range(n).mapInPandas(run, SENTENCES)


def plain_sentences(documents: DataFrame, n: int = 2000) -> DataFrame:
    """At most ``n`` lines of texts that hold no names, tagged as such; which ones depends on their hashes only."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(20, 400))
    tokens = F.regexp_extract_all("line", F.lit(r"(?U)\w+(?:['’-]\w+)*|[^\w\s]"), F.lit(0))
    own = lines.orderBy(F.xxhash64("line"), "line").limit(n).select(tokens.alias("tokens"))
    return own.select("tokens", F.transform("tokens", lambda _: F.lit("O")).alias("tags"))


def shape(word: str) -> str:
    """A word's form: runs of capitals, small letters, digits and others as one sign each."""
    return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c if not c.isalpha() else "w" for c in word))


def features(word: str, place: int) -> list[int]:
    """Buckets of a word's features as the word before (-1), itself (0) or the word after (1)."""
    low, form = word.lower(), shape(word)
    named = [f"s={form}", f"w={low}", f"e={low[-3:]}", f"i={word[:1].isupper()}"]
    if place == 0:
        named += [f"p={low[:3]}", f"n={min(len(word), 8)}", "b"]
    return [zlib.crc32(f"{place}{x}".encode()) % BUCKETS for x in named]


_STARTS = {place: zlib.crc32(str(place).encode()) for place in (-1, 0, 1)}


def word_features(word: str) -> list[int]:
    """The features of a word as the word before, itself and the word after, one after the other."""
    low = word.lower()
    form = "x" if word.isascii() and word.isalpha() and low == word else shape(word)
    around = [x.encode() for x in (f"s={form}", f"w={low}", f"e={low[-3:]}", f"i={word[:1].isupper()}")]
    own = [*around, f"p={low[:3]}".encode(), f"n={min(len(word), 8)}".encode(), b"b"]
    return [zlib.crc32(x, _STARTS[place]) % BUCKETS for place, part in ((-1, around), (0, own), (1, around)) for x in part]


class WordScores:
    """Scores of words by place, of weights that no longer change: each word is scored when it is first met. Up to ``cap`` words are kept."""

    def __init__(self, weights: np.ndarray, cap: int = 200_000):
        self.weights, self.cap = weights, cap
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.tables = np.zeros((3, 1024, len(TAGS)), dtype=np.float32)
        self.starts = np.zeros(1024, dtype=bool)
        self.add([""])

    def add(self, words: list[str]) -> None:
        low, high = len(self.index), len(self.index) + len(words)
        if high > self.tables.shape[1]:
            more = max(high, 2 * self.tables.shape[1])
            self.tables = np.concatenate([self.tables, np.zeros((3, more - self.tables.shape[1], len(TAGS)), dtype=np.float32)], axis=1)
            self.starts = np.concatenate([self.starts, np.zeros(more - len(self.starts), dtype=bool)])
        at = np.array([word_features(w) for w in words])
        for table, part in zip(self.tables, (at[:, :4], at[:, 4:11], at[:, 11:]), strict=True):
            for k in range(part.shape[1]):
                table[low:high] += self.weights[part[:, k]]
        self.starts[low:high] = [w[:1].isupper() or w[:1].isdigit() for w in words]  # a name begins with a capital or a number
        self.index.update(zip(words, range(low, high), strict=True))

    def of(self, segments: list[list[str]]) -> np.ndarray:
        """Codes of the words of segments, with one of none before and after each; what is beyond a segment is none."""
        new = [w for w in dict.fromkeys(chain.from_iterable(segments)) if w not in self.index]
        if new and len(self.index) + len(new) > self.cap:
            self.clear()
            new = [w for w in dict.fromkeys(chain.from_iterable(segments)) if w not in self.index]
        if new:
            self.add(new)
        sizes = np.array([len(s) for s in segments])
        codes = np.zeros((len(segments), sizes.max() + 2), dtype=np.int64)
        codes[:, 1:][np.arange(sizes.max() + 1) < sizes[:, None]] = np.fromiter(map(self.index.__getitem__, chain.from_iterable(segments)), dtype=np.int64, count=sizes.sum())
        return codes


#: Which tag may follow which: I of a kind follows B or I of it only. The last row is for the first token.
_MAY = np.array([[not t.startswith("I") or (s != "" and s[2:] == t[2:] and s != "O") for t in TAGS] for s in [*TAGS, ""]])
_NEVER = -1e6


@dataclass
class Tagger:
    """Weights of features by tag, and of tags that follow each other."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, len(TAGS)), dtype=np.float32))
    follows: np.ndarray = field(default_factory=lambda: np.zeros((len(TAGS) + 1, len(TAGS)), dtype=np.float32))

    def scores(self, segments: list[list[str]], known: WordScores | None = None) -> np.ndarray:
        """Segments by tokens by tags; a segment's end and what is beyond it score as the words around a sentence do.

        ``known`` keeps the words' scores from call to call, where the weights stay."""
        known = known or WordScores(self.weights)
        codes, tables = known.of(segments), known.tables
        out = tables[0][codes[:, :-2]] + tables[1][codes[:, 1:-1]] + tables[2][codes[:, 2:]]
        out[:, :, [t.startswith("B") for t in TAGS]] += np.where(known.starts[codes[:, 1:-1]], 0, _NEVER)[:, :, None]
        return out

    def paths(self, segments: list[list[str]], known: WordScores | None = None) -> list[np.ndarray]:
        """The best tags of each segment."""
        if not segments:
            return []
        scores = self.scores(segments, known)
        step = np.where(_MAY, self.follows, _NEVER)
        best = scores[:, 0] + step[-1]
        back = np.zeros(scores.shape, dtype=np.int64)
        lengths = np.array([len(s) for s in segments])
        final = best.copy()
        for t in range(1, scores.shape[1]):
            through = best[:, :, None] + step[None, :-1]
            back[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[:, t]
            final[lengths == t + 1] = best[lengths == t + 1]
        whole, each = np.zeros(scores.shape[:2], dtype=np.int64), np.arange(len(segments))
        whole[each, lengths - 1] = final.argmax(axis=1)
        for t in range(scores.shape[1] - 1, 0, -1):
            own = each[lengths > t]
            whole[own, t - 1] = back[own, t, whole[own, t]]
        return [path[:size] for path, size in zip(whole, lengths, strict=True)]

    def learn(self, sentences: list[tuple[list[str], list[int]]], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The averages of the weights over one pass; the weights themselves change too."""
        total, total_follows = np.zeros(self.weights.shape), np.zeros(self.follows.shape)
        order = list(range(len(sentences)))
        random.Random(seed).shuffle(order)
        for n, k in enumerate(order):
            words, right = sentences[k]
            found = self.paths([words])[0]
            # An update at step n stands in all averages after it.
            left = (len(order) - n) / len(order)
            around = ["", *words, ""]
            for t, (good, bad) in enumerate(zip(right, found, strict=True)):
                if good != bad:
                    own = features(around[t], -1) + features(around[t + 1], 0) + features(around[t + 2], 1)
                    for table, share in ((self.weights, 1.0), (total, left)):
                        np.add.at(table, (own, good), share)
                        np.add.at(table, (own, bad), -share)
                before = (right[t - 1], found[t - 1]) if t else (len(TAGS), len(TAGS))
                if (before[0], good) != (before[1], bad):
                    for table, share in ((self.follows, 1.0), (total_follows, left)):
                        table[before[0], good] += share
                        table[before[1], bad] -= share
        return total, total_follows


def fit(sentences: DataFrame, rounds: int = 5, parts: int = 4) -> Tagger:
    """A tagger from tagged sentences; empty ones are left out. The driver holds weights only: ``parts`` of them a round."""
    spark, tagger = sentences.sparkSession, Tagger()
    dealt = sentences.where(F.size("tokens") > 0).repartition(parts, F.xxhash64("tokens", "tags")).persist()
    for n in range(rounds):
        shared = spark.sparkContext.broadcast((tagger.weights, tagger.follows))

        def run(batches: Iterator[pd.DataFrame], shared=shared, n=n) -> Iterator[pd.DataFrame]:
            own = Tagger(shared.value[0].copy(), shared.value[1].copy())
            rows = [(list(t), [TAGS.index(x) for x in g]) for batch in batches for t, g in zip(batch["tokens"], batch["tags"], strict=True)]
            if rows:
                rows.sort()
                change, follows = own.learn(rows, n)
                at = np.flatnonzero(change.any(axis=1))
                yield pd.DataFrame({"rows": [len(rows)], "at": [at.astype("<i8").tobytes()], "weights": [change[at].astype("<f4").tobytes()], "follows": [follows.astype("<f4").tobytes()]})

        learnt = dealt.mapInPandas(run, "rows long, at binary, weights binary, follows binary").collect()
        shared.unpersist()
        seen = sum(r["rows"] for r in learnt)
        for r in learnt:
            share = r["rows"] / seen
            np.add.at(tagger.weights, np.frombuffer(r["at"], dtype="<i8"), share * np.frombuffer(r["weights"], dtype="<f4").reshape(-1, len(TAGS)))
            tagger.follows += share * np.frombuffer(r["follows"], dtype="<f4").reshape(tagger.follows.shape)
    dealt.unpersist()
    return tagger


def segments(text: str) -> list[list[re.Match]]:
    """The tokens of a text by line and sentence."""
    out: list[list[re.Match]] = []
    for line in re.finditer(r"[^\n]+", text):
        own: list[re.Match] = []
        for m in TOKEN.finditer(text, line.start(), line.end()):
            own.append(m)
            ends = m[0] in ".!?" and not (len(own) > 1 and own[-2][0] in TITLES)
            if ends or len(own) >= LONGEST:
                out.append(own)
                own = []
        if own:
            out.append(own)
    return out


def analyser(tagger: Tagger, batch: int = 256) -> Callable[[pd.Series], pd.Series]:
    """A function over texts for the name layer: lists of {start, end, entity, score}. Null texts have none."""

    known: list[WordScores] = []

    def run(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(WordScores(tagger.weights))
        # A tagged line depends on its own words only, and so does a segment of it, so each is read once for all texts.
        lines: dict[str, list[tuple[int, int, str]]] = {line: [] for text in texts if text for line in text.split("\n")}
        work: dict[tuple[str, ...], list[tuple[str, list[re.Match]]]] = {}
        for line in lines:
            for s in segments(line):
                words = tuple(m[0] for m in s)
                if any(w[:1].isupper() or w[:1].isdigit() for w in words):
                    work.setdefault(words, []).append((line, s))
        order = sorted(work, key=len)
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            for words, path in zip(part, tagger.paths(part, known[0]), strict=True):
                if not path.any():
                    continue
                t = 0
                while t < len(path):
                    tag, first = TAGS[path[t]], t
                    t += 1
                    if tag.startswith("B"):
                        while t < len(path) and TAGS[path[t]] == f"I{tag[1:]}":
                            t += 1
                        for line, own in work[words]:
                            lines[line].append((own[first].start(), own[t - 1].end(), tag[2:]))
        found: list[list[dict]] = []
        for text in texts:
            at, own = 0, []
            for line in text.split("\n") if text else ():
                own += [{"start": at + start, "end": at + end, "entity": kind, "score": 0.85} for start, end, kind in sorted(lines[line])]
                at += len(line) + 1
            found.append(own)
        return pd.Series(found, index=texts.index, dtype=object)

    # Annotations name the pandas types that Spark takes the kind of function from.
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


def saved(tagger: Tagger, spark: SparkSession, path: str) -> None:
    """Writes the weights that aren't zero as Parquet; row -1 - s holds those after tag s."""
    at = np.flatnonzero(tagger.weights.any(axis=1))
    rows = [(int(k), tagger.weights[k].tolist()) for k in at] + [(-1 - k, w.tolist()) for k, w in enumerate(tagger.follows)]
    spark.createDataFrame(rows, "at int, weights array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str) -> Tagger:
    """A tagger that ``saved`` has written, of at most ``BUCKETS`` rows."""
    out = Tagger()
    for r in spark.read.parquet(path).collect():
        (out.weights if r["at"] >= 0 else out.follows)[r["at"] if r["at"] >= 0 else -1 - r["at"]] = r["weights"]
    return out
