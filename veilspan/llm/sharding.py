"""Sharding by jump consistent hashing: an id's shard follows from the id and the number of shards, with no table.

A pseudo-random sequence that the key seeds tells at which shard counts the key moves, and each move is to the shard
that was new at that count: going from n to n + 1 shards a key stays, or goes to shard n. The generator is the 64-bit
linear congruential one of the published algorithm; its products are made of three limbs of 24, 24 and 16 bits, so that no long
overflows. A key is the first 64 bits of the MD5 of the id as text, so ids in any pattern spread alike.

All of it is column expressions. Rows take their slots in a shard in the order of a digest of what is told of them; a shard
is cut into ranges of this digest, each numbered by itself and moved by the rows in the ranges before it. Equal rows
are counted, not gathered, and spread by lots, so an id that holds a third of all rows meets no single task. That one shard then
holds these rows is the law itself: only the id and the shard count decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the published algorithm: the generator's multiplier, and what its upper 31 bits are set in relation to.
MULTIPLIER, SPAN = 2862933555777941757, float(1 << 31)
LOW = (1 << 24) - 1
#: Jumps that are folded for every key; the few keys with more go on, up to as many as there are shards.
JUMPS = 16
#: Rows in a range of a shard on average, and equal rows in a lot.
RANGE_ROWS, LOT_ROWS = 200_000, 100_000


def _hex(text: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(text, start, length), 16, 10).cast("long")


def id_key(doc_id: Column) -> Column:
    """An id's 64-bit key as limbs (low, mid, high) of 24, 24 and 16 bits; a null id counts as the empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.struct(_hex(digest, 11, 6).alias("low"), _hex(digest, 5, 6).alias("mid"), _hex(digest, 1, 4).alias("high"))


def _next(key: Column) -> Column:
    """The key times the multiplier plus one, modulo 2 ** 64."""
    a, b, c = MULTIPLIER & LOW, (MULTIPLIER >> 24) & LOW, MULTIPLIER >> 48
    low = key["low"] * a + 1
    mid = key["low"] * b + key["mid"] * a + F.shiftright(low, 24)
    high = key["low"] * c + key["mid"] * b + key["high"] * a + F.shiftright(mid, 24)
    return F.struct(low.bitwiseAND(F.lit(LOW)).alias("low"), mid.bitwiseAND(F.lit(LOW)).alias("mid"), high.bitwiseAND(F.lit((1 << 16) - 1)).alias("high"))


def _jumped(state: Column, shards: int, grown: int) -> Column:
    """The state after one more jump, if its last was within ``grown`` shards: key, shard of both counts, next."""

    def moved(key: Column) -> Column:
        upper = F.shiftleft(key["high"], 15).bitwiseOR(F.shiftright(key["mid"], 9))
        at = state["next"]
        return F.struct(key.alias("key"), F.when(at < shards, at).otherwise(state["shard"]).alias("shard"), at.alias("grown"), F.floor((at + 1) * (F.lit(SPAN) / (upper + 1))).cast("long").alias("next"))

    return F.when(state["next"] < grown, F.element_at(F.transform(F.array(_next(state["key"])), moved), 1)).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """A struct of ``shard``, the key's shard of ``shards``, and ``grown``, its shard if there is one more."""
    if shards < 1:
        raise ValueError("there must be a shard")
    zero = F.lit(0).cast("long")
    start = F.struct(key.alias("key"), zero.alias("shard"), zero.alias("grown"), zero.alias("next"))
    grown = shards + 1

    def fold(state: Column, jumps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), state, lambda s, _: _jumped(s, shards, grown))

    def done(state: Column) -> Column:
        return F.when(state["next"] >= grown, state).otherwise(fold(state, grown))

    last = F.element_at(F.transform(F.array(fold(start, JUMPS)), done), 1)
    return F.struct(last["shard"].cast("int").alias("shard"), last["grown"].cast("int").alias("grown"))


def with_shard(rows: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``rows`` with the shard of each in a column ``name``, which is replaced if there is one."""
    return rows.withColumn(name, jump_shard(id_key(F.col(f"`{key}`")), shards)["shard"])


def assignments(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Every row's place: ``doc_id, size, text_crc32 long, law string, shard int, slot long, grown_shard int``.

    ``size`` is that of the text in UTF-8 (null: none) plus 16, ``text_crc32`` the unsigned one of these bytes, ``slot``
    the row's number in its shard, gapless from 0, ``grown_shard`` its shard if there were one more; ``law`` is "key".
    A null doc_id is a key like any other. Repeated rows, and rows with one id, are all there, each with a slot of its own, and
    share a shard. Further columns are ignored; an empty table gives no rows. The result doesn't depend on how the
    table is partitioned.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    told = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    equal = told.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT_ROWS).cast("long"))))
    lots = lots.withColumn("n", F.least(F.lit(LOT_ROWS).cast("long"), F.col("n") - F.col("lot") * LOT_ROWS))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size", "lot").cast("binary"))
    lots = stored(lots.withColumn("place", jump_shard(id_key(F.col("doc_id")), shards)).select("doc_id", "size", "text_crc32", "lot", "n", "place.shard", "place.grown", digest.alias("digest")), "shards")
    total = lots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // (shards * RANGE_ROWS)))
    # Ranges of the digest's first 32 bits; the order in a shard is that of the digest, however many ranges there are.
    ranged = lots.withColumn("cut", F.floor(_hex(F.col("digest"), 1, 8) * ranges / float(1 << 32)).cast("int"))
    sizes = ranged.groupBy("shard", "cut").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cut").orderBy("digest", "doc_id", "text_crc32", "size", "lot").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "cut"])
    slot = F.explode(F.sequence(F.col("base") + F.col("offset"), F.col("base") + F.col("offset") + F.col("n") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), F.col("grown").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = 40, parts: int = 1) -> DataFrame:
    """Writes all rows with all their columns as Parquet, a folder ``shard=k`` for each shard, and reads them back.

    Each shard is written by ``parts`` tasks, among which equal ids are dealt out by their texts. A column ``shard`` of
    the rows is replaced. Nulls and repeats are kept as they are; an empty table gives no folders, and no rows.
    """
    rows = with_shard(documents, shards)
    part = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(parts))
    rows.repartition(shards * parts, "shard", part).write.partitionBy("shard").parquet(path)
    return documents.sparkSession.read.schema(rows.schema).parquet(path)


ORACLE = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(xor(c >> 4, T[1 + (xor(c, b) & 15)]) >> 4, T[1 + (xor(xor(c >> 4, T[1 + (xor(c, b) & 15)]), b >> 4) & 15)]))) AS text_crc32
  FROM documents
),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 100000 AS lot FROM told),
keys AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS key FROM documents),
jumps(doc_id, key, place, next) AS (
  SELECT doc_id, key, -1::BIGINT, 0::BIGINT FROM keys
  UNION ALL
  SELECT doc_id, k, next, floor((next + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM jumps WHERE next < 41)
),
places AS (SELECT doc_id, (max(place) FILTER (place < 40))::INT AS shard, max(place)::INT AS grown_shard FROM jumps GROUP BY doc_id)
SELECT n.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', coalesce(n.doc_id::VARCHAR, ''), text_crc32::VARCHAR, size::VARCHAR, lot::VARCHAR)), n.doc_id NULLS FIRST, text_crc32, size, lot) - 1 AS slot, grown_shard
FROM numbered n JOIN places p ON n.doc_id IS NOT DISTINCT FROM p.doc_id
"""


def _nibbles() -> list[int]:
    """CRC-32 of the sixteen half bytes, by its reflected polynomial."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


ORACLE = ORACLE.replace("T[", f"{_nibbles()}[")
