"""How document filters interact: what each of them removes in every order of applying them.

Whether a row fails a filter doesn't depend on the order, so a histogram says all there is to know. Native
expressions turn a text into a mask with a bit for each filter it fails; for the filter on copies a groupBy of the
texts' SHA-256 gives each text's smallest id. What is left of the table are at most 32 cells a part: a mask and
its number of rows. All 120 orders are enumerated from these cells.

Texts don't leave the task that reads them: rows of (id, part, digest, mask) are counted, written once and read by
the steps after it. A row's copies meet in aggregates with partial sums only, and the first of a text is found again by digest
and id together, so a text or a part that holds a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the contract: the letters of the filters in the order of their bits, and what stands between words.
LETTERS = "ABCDE"
BLANK, BLANKS = r"[ \t-\r]+", " \t\n\x0b\x0c\r"
SYMBOLS = r"[#$%&*|]"
#: Parts of the key that spreads rows without an id, which have no label, over the join with labels.
SALTS = 1024


def text_mask(text: Column, least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5) -> Column:
    """Bits of the filters A to D that a text (not null) fails: few words, few distinct words, many capitals, symbols."""
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare != "", F.split(bare, BLANK)).otherwise(F.array().cast("array<string>"))
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [size < least_words, 100 * distinct < distinct_percent * size, 100 * capitals > capital_percent * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), start=F.lit(0)).cast("int")


def failure_cells(documents: DataFrame, labels: DataFrame, part: str = "source", **limits) -> DataFrame:
    """``part, mask int, n, good, toxic long``: the rows of each part by the set of filters they fail.

    Bits 0 to 3 are those of ``text_mask``, bit 4 is set for a row whose text also stands under a smaller doc_id,
    in whatever part. ``good`` and ``toxic`` count rows that any of their labels marks so. A null text or part counts
    as empty. Equal rows of one id are copies of each other but not of a smaller id; a row without an id is no copy and has no label,
    and its text makes none. Further columns are ignored; an empty table gives no cells.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text, **limits).alias("mask"))
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "filter-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id match nothing; a salt keeps them apart.
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(-1))
    known = salted.join(first.withColumn("salt", F.lit(-1).cast("long")), ["digest", "doc_id", "salt"], "left").join(marks.withColumn("salt", F.lit(-1).cast("long")), ["doc_id", "salt"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = (F.col("mask") + F.when(copy, 16).otherwise(0)).cast("int")
    return known.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def steps(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, bits of the filters before, bit of this filter) for all orders of the filters."""
    return [("".join(o), k + 1, sum(1 << letters.index(x) for x in o[:k]), 1 << letters.index(o[k])) for o in permutations(letters) for k in range(len(letters))]


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, filter_order, step int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long``.

    A row for each part of the cells, each order of the filters and each step; zeros included. What is clear of a set
    of filters is summed once for each of the 32 sets; a step is the difference of two of them. A part's cells are at
    most 2 ** filters rows.
    """
    sets = 1 << len(letters)
    every = F.sequence(F.lit(0), F.lit(sets - 1))
    names = ("n", "good", "toxic")
    by_part = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("cells"))

    def of(name: str, mask: Column) -> Column:
        return F.coalesce(F.try_element_at("cells", mask.cast("int"))[name], F.lit(0).cast("long"))

    def clear(name: str) -> Column:
        return F.transform(every, lambda s: F.aggregate(F.filter(every, lambda m: m.bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda total, m: total + of(name, m)))

    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")) for o, k, before, bit in steps(letters)])
    rows = by_part.select("part", "cells", *[clear(x).alias(f"clear_{x}") for x in names]).select("*", F.explode(plan).alias("s"))
    before, after = F.col("s.before") + 1, F.col("s.before") + F.col("s.bit") + 1
    lost = {x: F.element_at(f"clear_{x}", before) - F.element_at(f"clear_{x}", after) for x in names}
    failing = F.element_at("clear_n", 1) - F.element_at("clear_n", F.col("s.bit") + 1)
    made = rows.select("part", "s.filter_order", "s.step", "s.bit", F.element_at("clear_n", after).alias("kept"), lost["n"].alias("removed"), (failing - lost["n"]).alias("redundant"), of("n", F.col("s.bit")).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"))
    return made.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(documents: DataFrame, labels: DataFrame, part: str = "source", **limits) -> DataFrame:
    """What each filter removes in each order: ``interactions`` of the table's ``failure_cells``."""
    return interactions(failure_cells(documents, labels, part, **limits))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows_ AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(words.doc_id > first, false)::INT AS mask
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows_ GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT [f1.x, f2.x, f3.x, f4.x, f5.x] AS xs, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs
  FROM f f1 JOIN f f2 ON f2.b <> f1.b JOIN f f3 ON f3.b NOT IN (f1.b, f2.b) JOIN f f4 ON f4.b NOT IN (f1.b, f2.b, f3.b) JOIN f f5 ON f5.b NOT IN (f1.b, f2.b, f3.b, f4.b)
),
steps AS (SELECT array_to_string(xs, '') AS filter_order, k AS step, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS before, bs[k] AS bit FROM orders, range(1, 6) r(k)),
made AS (
  SELECT part, filter_order, step::INT AS step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM made
"""
