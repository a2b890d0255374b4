"""Sharding by jump consistent hashing, in column expressions only.

A key's shard follows from the key and the shard count alone, without a ring or a table: the key walks upwards through
jump targets and stays at the last one below the count. With one more shard, a key either stays or moves to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.tables import table

MULTIPLIER = 2862933555777941757  # of the generator in the published algorithm
STEPS = 256  # jumps grow as the logarithm of the count, twice 31 at most on average; a key that needs more is an error, not a guess


def _next(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 in 16-bit limbs, since long products that overflow raise errors."""
    a = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    m = [MULTIPLIER >> 16 * i & 0xFFFF for i in range(4)]
    carry, out = F.lit(1).cast("long"), None
    for i in range(4):
        limb = carry
        for j in range(i + 1):
            limb = limb + a[j] * F.lit(m[i - j]).cast("long")
        part = F.shiftleft(limb.bitwiseAND(F.lit(0xFFFF)), 16 * i)
        out = part if out is None else out.bitwiseOR(part)
        carry = F.shiftrightunsigned(limb, 16)
    return out


def jump(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard among `shards`, and among one more."""

    def step(s: Column, _: Column) -> Column:
        k = _next(s["key"])
        leap = (s["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))
        going = s["at"] <= shards
        return F.struct(
            F.when(going, k).otherwise(s["key"]).alias("key"),
            F.when(going, leap.cast("long")).otherwise(s["at"]).alias("at"),
            F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]).alias("shard"),
            F.when(going, s["at"]).otherwise(s["grown"]).alias("grown"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(key.alias("key"), zero.alias("at"), zero.alias("shard"), zero.alias("grown"))
    steps = F.sequence(F.lit(1), F.lit(min(shards + 2, STEPS)))

    def finish(s: Column) -> Column:
        done = F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))
        return F.when(s["at"] > shards, done).otherwise(F.raise_error(F.lit("a jump walk did not end")))

    return F.aggregate(steps, start, step, finish)


def assign(docs: DataFrame, shards: int = 16, parts: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, law = 'key', shard, slot, grown_shard.

    Slots number a shard's rows from 0 without gaps, by (hash mod parts, doc_id, size, crc): each shard is numbered in
    `parts` pieces, dealt by a hash of all three, whose counts (shards * parts rows) give the first slot of each. A null text has size 1 and the CRC of
    the empty text. A null id hashes as 0 and comes first. Repeated rows get slots of their own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        jump(key, shards).alias("to"),
    ).select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).alias("part"), F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(first), ["shard", "part"])  # shards * parts rows
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), "grown_shard")
    )


def op3_jump_hash(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
