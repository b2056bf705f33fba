"""Overlaps of two sets of ranges within a document, without comparing all ranges of a document with each other.

Whether a span is overlapped at all is told by a sweep: ranges enter at their start, a span asks at its end, and of the
ranges that entered before it the furthest end decides. Which ranges overlap it is told by a join whose second key is
a bin of offsets; a pair that shares many bins is kept in the bin where the later of the two starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlaps

#: Code points in a bin.
BIN = 256
_AT, _REACH, _SPAN = "sweep at", "sweep reach", "sweep span"


def with_overlap(spans: DataFrame, ranges: DataFrame, name: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``spans`` with a boolean column ``name``: whether any of the ranges with the same keys overlaps it.

    Rows stay as they are, repeated ones too; a null offset or key overlaps nothing. One exchange by the keys and a sort.
    """
    kept = spans.columns
    asking = spans.withColumn(_AT, F.col("end")).withColumn(_REACH, F.lit(None).cast("int")).withColumn(_SPAN, F.lit(0))
    given = ranges.dropna(subset=[*keys, "start", "end"]).select(*keys, F.col("start").alias(_AT), F.col("end").alias(_REACH), F.lit(1).alias(_SPAN))
    # Of rows at one offset spans come first, as a range that starts where they end doesn't touch them.
    order = Window.partitionBy(*keys).orderBy(_AT, _SPAN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asking.unionByName(given, allowMissingColumns=True).withColumn(_REACH, F.max(_REACH).over(order)).where(F.col(f"`{_SPAN}`") == 0)
    return swept.select(*kept, F.coalesce(F.col(f"`{_REACH}`") > F.col("start"), F.lit(False)).alias(name))


def swept(rows: DataFrame, given: Column, name: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The same for spans and ranges in one table, where ``given`` marks the ranges; these get the column too, without meaning."""
    sound = given & F.col("start").isNotNull()
    for key in keys:
        sound = sound & F.col(key).isNotNull()
    order = Window.partitionBy(*keys).orderBy(F.when(given, F.col("start")).otherwise(F.col("end")), given).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.coalesce(F.max(F.when(sound, F.col("end"))).over(order) > F.col("start"), F.lit(False)))


def apart(spans: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The spans that overlap none of the ranges."""
    return with_overlap(spans, ranges, _SPAN, keys).where(~F.col(f"`{_SPAN}`")).drop(_SPAN)


def touched(spans: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The spans that overlap one of the ranges or more."""
    return with_overlap(spans, ranges, _SPAN, keys).where(F.col(f"`{_SPAN}`")).drop(_SPAN)


def bins(start: Column, end: Column) -> Column:
    """The bins that a range lies in."""
    return F.sequence(F.floor(start / BIN).cast("int"), F.floor(F.greatest(start, end - 1) / BIN).cast("int"))


def pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All overlapping pairs with the same keys: the keys, and the rows as structs ``a`` and ``b``."""

    def binned(rows: DataFrame, name: str) -> DataFrame:
        sound = rows.where("start >= 0 and start <= end")
        return sound.select(*keys, F.struct(*rows.columns).alias(name), F.explode(bins(F.col("start"), F.col("end"))).alias("bin"))

    met = binned(a, "a").join(binned(b, "b"), [*keys, "bin"])
    first = F.floor(F.greatest("a.start", "b.start") / BIN).cast("int")
    return met.where((F.col("bin") == first) & overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))).drop("bin")
