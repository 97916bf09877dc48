"""Shards by jump consistent hashing, in DataFrame functions only.

The key's 64-bit linear congruential sequence decides at which shard counts the key moves, so going
from n to n + 1 shards moves the keys that belong into the new shard and no others, without a ring
table. The published generator is kept: other implementations give the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.words import order_hash
from sheafline.session import materialize

# Fixed values of the published algorithm: the generator's multiplier, as two 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
MASK_16, MASK_32 = 0xFFFF, 0xFFFFFFFF
#: Jumps of a key are as many as the records of a random sequence, about ln(shards): more than this
#: do not happen for any shard count below 2**31 (chance under 2**-100).
MOST_JUMPS = 128


def _times_32(a: Column, b: int) -> Column:
    """A value congruent to a * b modulo 2**32, for 0 <= a, b < 2**32, without overflow."""
    return a.bitwiseAND(F.lit(MASK_16)) * F.lit(b) + F.shiftleft(
        (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(MASK_16)), 16
    )


def _step(state: Column, shards: int) -> Column:
    """The next jump: key = key * multiplier + 1 modulo 2**64, in halves; then the next shard."""
    high, low = state["high"], state["low"]
    upper = F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW)
    lower = low.bitwiseAND(F.lit(MASK_16)) * F.lit(MULTIPLIER_LOW) + F.lit(1)
    total = lower + F.shiftleft(upper.bitwiseAND(F.lit(MASK_16)), 16)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    new_low = total.bitwiseAND(F.lit(MASK_32))
    new_high = (carry + _times_32(high, MULTIPLIER_LOW) + _times_32(low, MULTIPLIER_HIGH)).bitwiseAND(F.lit(MASK_32))
    reach = F.lit(2.0**31) / (F.shiftright(new_high, 1) + F.lit(1)).cast("double")
    jumped = F.struct(
        new_high.alias("high"),
        new_low.alias("low"),
        state["next"].alias("shard"),
        F.floor((state["next"] + F.lit(1)).cast("double") * reach).cast("long").alias("next"),
    )
    return F.when(state["next"] < F.lit(shards), jumped).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, from 0 to ``shards - 1``. A null key counts as key 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(MASK_32)).alias("high"),
        key.bitwiseAND(F.lit(MASK_32)).alias("low"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )
    turns = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))
    return F.aggregate(turns, start, lambda s, _: _step(s, shards), lambda s: s["shard"].cast("int"))


def shard_manifest(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8 (null text: 8, checksum of nothing); ``slot``
    numbers the rows of a shard from 0 without gaps, in the order of the key's hash. Other columns
    of the input are not read, so their names cannot clash. An empty table gives an empty manifest.

    Equal rows are counted before the shuffle and expanded after it, so a key that holds a third of
    all rows is one row there. A shard is never sorted as a whole: it is cut into 4096 ranges of the
    hash, whose counts give the first slot of each range.
    """
    body = F.col(text).cast("binary")
    narrow = df.select(
        F.col(key).cast("long").alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + F.lit(8)).alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
    )
    rows = (
        narrow.groupBy("key", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("shard", jump_hash(F.col("key"), shards))
        .withColumn("grown_shard", jump_hash(F.col("key"), shards + 1))
        .withColumn("hash", order_hash(F.col("key")))
        .withColumn("part", F.shiftright("hash", 48))
    )
    rows = materialize(rows)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "part")
        .agg(F.sum("copies").alias("in_part"))
        .withColumn("first_slot", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
        .drop("in_part")
    )
    within = (
        Window.partitionBy("shard", "part")
        .orderBy("hash", "key", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("earlier", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(
        starts, ["shard", "part"]
    )
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return placed.select("*", copy.alias("copy")).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("earlier") + F.col("copy")).alias("slot"),
        "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """All rows and columns of ``df`` in folders ``path/_shard=n``; no shuffle, the key decides."""
    if "_shard" in df.columns:
        raise ValueError("the column name _shard is taken by the folders")
    df.withColumn("_shard", jump_hash(F.col(key), shards)).write.partitionBy("_shard").parquet(path)
