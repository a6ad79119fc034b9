"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard is the last landing of a sequence of jumps driven by a 64-bit linear congruential generator:
no ring table, and with one more shard a key either stays or moves to the new shard. Products modulo 2**64
are taken in 32-bit halves of longs, which never overflow and so need no particular ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Fixed values of the published generator: its multiplier in halves.
FACTOR = 2862933555777941757
HIGH, LOW = FACTOR >> 32, FACTOR & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Jumps that are followed. Each one lands on a greater shard, so up to 160 shards no key makes more. Beyond, a key lands on
#: shard i with probability 1 / (i + 1), each by itself: 22 jumps on average for 2**31 shards, and more than 160 with a
#: probability below (e * 23 / 160)**160, about 1e-65.
JUMPS = 160


def _low(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, x below 2**32."""
    return ((x.bitwiseAND(0xFFFF)) * F.lit(factor) + F.shiftleft((F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, from and in 32-bit halves."""
    t, u = low.bitwiseAND(0xFFFF) * F.lit(LOW), F.shiftright(low, 16) * F.lit(LOW)
    sums = t.bitwiseAND(MASK) + F.shiftleft(u.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(sums, 32)
    return (F.shiftright(t, 32) + F.shiftright(u, 16) + carry + _low(high, LOW) + _low(low, HIGH)).bitwiseAND(MASK), sums.bitwiseAND(MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, from 0 to shards - 1; a null key goes as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0))
    state = lambda b, j, high, low: F.struct(b.alias("b"), j.alias("j"), high.alias("high"), low.alias("low"))
    start = state(F.lit(0).cast("long"), F.lit(0).cast("long"), F.shiftrightunsigned(key, 32).bitwiseAND(MASK), key.bitwiseAND(MASK))

    def jump(acc: Column, _: Column) -> Column:
        high, low = _step(acc["high"], acc["low"])
        landing = F.floor((acc["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.when(acc["j"] >= shards, acc).otherwise(state(acc["j"], landing, high, low))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, JUMPS))), start, jump)
    return last["b"].cast("int")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    shard: jump_hash of doc_id (law `key`); grown_shard: the same with one shard more. size: UTF-8 bytes of
    the text (null: none) plus 1; text_crc32: of the same bytes (null: of none, 0). slot numbers a shard's
    rows from 0 without gaps, in order of a hash of the id, then id and text hash; rows that repeat have
    slots of their own. A null doc_id goes as id 0. Further columns are ignored; an empty table gives an
    empty result.

    Slots are ranks within cells of a shard plus the cell's offset from counts, so no task holds a shard.
    The offsets have shards * cells rows.
    """
    cells = max(16, 4 * partitions(docs.sparkSession))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.xxhash64("doc_id", "text").alias("tie"),
    ).withColumn("cell", F.pmod("tie", F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("tie", "doc_id")) - 1
    ranked = rows.withColumn("within", within).join(offsets, ["shard", "cell"])
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("within") + F.col("offset")).cast("long").alias("slot"), "grown_shard")
