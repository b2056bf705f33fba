"""All matches of a pattern with their offsets, inside the JVM.

The text is split at the matches and the matches are extracted; running lengths of both give each match's offset.
Texts without a match skip both,
and those that lack what every match holds aren't searched at all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "struct<start:int,end:int,text:string>"
#: Results of a fold are appended to blocks of so many, as appending to one long array copies it each time.
BLOCK = 256
#: Steps of a fold that gathers matches.
STEPS = 64


def none(kind: str) -> Column:
    """An empty array of a type."""
    return F.array().cast(f"array<{kind}>")


def buffer(kind: str) -> Column:
    """An empty buffer for the results of a fold: full blocks, and the last one."""
    return F.struct(none(f"array<{kind}>").alias("done"), none(kind).alias("last"))


def appended(out: Column, x: Column) -> Column:
    """The buffer with one result more."""
    full = F.size(out["last"]) >= BLOCK
    return F.struct(
        F.when(full, F.concat(out["done"], F.array(out["last"]))).otherwise(out["done"]).alias("done"),
        F.when(full, F.array(x)).otherwise(F.concat(out["last"], F.array(x))).alias("last"),
    )


def unrolled(out: Column) -> Column:
    """All results of a buffer as one array."""
    return F.flatten(F.concat(out["done"], F.array(out["last"])))


def all_matches(text: Column | str, pattern: str, gate: Column | None = None) -> Column:
    """Every non-overlapping match, leftmost first: array of start, end, text. ``pattern`` is a Java pattern.

    ``gate`` is a cheap condition that holds for every text with a match; other texts aren't searched.
    """
    text = F.col(text) if isinstance(text, str) else text
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        taken = F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))
        return F.when(x["hit"].isNull(), state).otherwise(taken)

    # Each array is named once, as an expression that stands twice is evaluated twice; the gap after the last match has no hit.
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    pairs = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit")))
    start_state = F.struct(F.lit(0).alias("at"), none(MATCH).alias("out"))
    # Spark copies a fold's state at each step, so blocks are folded one by one and then moved by the lengths before them.
    blocks = F.transform(in_blocks(pairs), lambda x: F.aggregate(x, start_state, step))
    shift = lambda m, by: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["text"].alias("text"))

    def moved(done: Column) -> Column:
        both = F.arrays_zip(done.alias("block"), before_each(F.transform(done, lambda x: x["at"])).alias("by"))
        return F.flatten(F.transform(both, lambda x: F.transform(x["block"]["out"], lambda m: shift(m, x["by"]))))

    whole = F.element_at(F.transform(F.array(blocks), moved), 1)  # names the blocks, so they are folded once
    searched = F.when(text.rlike(pattern), whole).otherwise(none(MATCH))
    return searched if gate is None else F.when(gate, searched).otherwise(none(MATCH))


def in_blocks(items: Column) -> Column:
    """An array in parts of up to STEPS. The array is named first, as a lambda's body is evaluated for each part."""

    def parts(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / STEPS).cast("int")), lambda k: F.slice(own, k * STEPS + 1, F.lit(STEPS)))

    return F.element_at(F.transform(F.array(items), parts), 1)


def before_each(sizes: Column) -> Column:
    """For each number of an array the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), none("int").alias("out"))
    return F.aggregate(sizes, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def literal(term: str) -> str:
    """A term as a pattern that matches just itself, in Java and RE2 alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", term)


def whole_word(term: str) -> str:
    """A case-insensitive pattern for a whole-word term."""
    return rf"(?iuU)\b{literal(term)}\b"


def any_of(text: Column, literals: Sequence[str]) -> Column:
    """Whether a text holds one of some literals: a search of bytes, far cheaper than a pattern."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in literals])


def may_hold(text: Column, lowered: Column, term: str) -> Column:
    """A condition that holds for every text in which ``whole_word`` matches a term of ASCII characters; ``lowered`` is the text in lower case.

    Beside the letters of ASCII, that pattern takes the long s, the i with and without a dot, and the Kelvin sign.
    """
    return F.contains(lowered, F.lit(term.lower())) | any_of(text, "\u017f\u0130\u0131\u212a")


def literal_places(text: Column, value: Column) -> Column:
    """Start of every occurrence of a literal value, overlapping ones too.

    The text is split before each occurrence, so all parts but the first start with one.
    """
    before = F.concat(F.lit(r"(?=\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    sizes = F.transform(F.split(text, before, -1), F.length)

    def step(state: Column, size: Column) -> Column:
        there = (state["at"] > 0) | text.startswith(value)
        return F.struct((state["at"] + size).alias("at"), F.when(there, appended(state["out"], state["at"])).otherwise(state["out"]).alias("out"))

    folded = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), buffer("int").alias("out")), step, lambda s: unrolled(s["out"]))
    return F.when((F.length(value) > 0) & F.contains(text, value), folded).otherwise(none("int"))


def disjoint(spans: Column, kind: str) -> Column:
    """From the left, the spans of an array sorted by start that don't overlap the last one taken."""

    def step(state: Column, x: Column) -> Column:
        return F.when(x["start"] < state["end"], state).otherwise(F.struct(x["end"].alias("end"), appended(state["out"], x).alias("out")))

    return F.aggregate(spans, F.struct(F.lit(-1).alias("end"), buffer(kind).alias("out")), step, lambda s: unrolled(s["out"]))


def greedy(candidates: Column, rank: list, kind: str) -> Column:
    """Keeps each candidate, best first, that overlaps none kept before; the result is in order of start.

    ``candidates`` is an array of structs of type ``kind`` with start and end; ``rank`` lists functions from a candidate
    to a key, the smallest key being the best. Candidates of different islands of overlap don't touch each other, so
    each island is settled by itself; a candidate is held against those kept in its own island only.
    """
    in_order = F.transform(F.array_sort(F.transform(candidates, lambda c: F.struct(c["start"].alias("s"), c.alias("c")))), lambda x: x["c"])

    def step(state: Column, c: Column) -> Column:
        new = c["start"] >= state["reach"]
        return F.struct(
            F.when(new, c["end"]).otherwise(F.greatest(state["reach"], c["end"])).alias("reach"),
            F.when(new, F.array(c)).otherwise(F.concat(state["island"], F.array(c))).alias("island"),
            F.when(new, appended(state["out"], state["island"])).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(-1).alias("reach"), none(kind).alias("island"), buffer(f"array<{kind}>").alias("out"))
    islands = F.aggregate(in_order, start, step, lambda s: unrolled(appended(s["out"], s["island"])))
    return F.flatten(F.transform(islands, lambda i: F.when(F.size(i) < 2, i).otherwise(_best_of(i, rank, kind))))


def _best_of(island: Column, rank: list, kind: str) -> Column:
    """The same for one island. The fold depends on what it has kept, so no window can express it."""
    ranked = F.array_sort(F.transform(island, lambda c: F.struct(*[f(c).alias(f"k{i}") for i, f in enumerate(rank)], c.alias("c"))))

    def step(kept: Column, x: Column) -> Column:
        c = x["c"]
        clash = F.exists(kept, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate(ranked, none(kind), step)
    return F.transform(F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("s"), c.alias("c")))), lambda x: x["c"])
