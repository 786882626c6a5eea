"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.running import before, slots
from sheaf.llm.store import workspace, written
from sheaf.sources.tables import table

#: Fixed value: the multiplier of the published generator, as its upper and lower 32 bits.
MULTIPLIER_HIGH, MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
LOW32 = 0xFFFFFFFF
SHARDS, ROW_BYTES = 40, 16


def _low(v: Column) -> Column:
    return v.bitwiseAND(F.lit(LOW32))


def _times(v: Column, by: int) -> tuple[Column, Column]:
    """``v`` * ``by`` for 32-bit values, as (a, b) with a + b * 2^16; both fit in a signed 64-bit integer."""
    return v.bitwiseAND(F.lit(0xFFFF)) * F.lit(by), F.shiftright(v, 16) * F.lit(by)


def _drawn(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state modulo 2^64 from its upper and lower halves, without an overflow that ANSI mode rejects."""
    a, b = _times(low, MULTIPLIER_LOW)
    total = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    c, d = _times(high, MULTIPLIER_LOW)
    upper = F.shiftright(total, 32) + F.shiftright(b, 16) + _low(low * F.lit(MULTIPLIER_HIGH)) + _low(c) + F.shiftleft(
        d.bitwiseAND(F.lit(0xFFFF)), 16
    )
    return _low(upper), _low(total)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, next): the key's shard of ``shards``, and the first shard count at which the key would move, less one.

    A key's jumps do not depend on the number of shards, so with one more shard it moves if and only if
    ``next`` equals ``shards``. Each jump goes at least one shard on, so ``shards`` rounds always suffice; a
    key that has ended passes through the rest unchanged.
    """

    def step(s: Column, _: Column) -> Column:
        high, low = _drawn(s["high"], s["low"])
        leap = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")))
        return F.when(
            s["next"] < F.lit(shards), F.struct(high.alias("high"), low.alias("low"), s["next"].alias("shard"), leap.alias("next"))
        ).otherwise(s)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), _low(key).alias("low"), F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["next"].alias("next"))
    )


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard under the law ``key``: id, size, text_crc32, shard, slot, grown_shard.

    Only the id and the number of shards decide, so equal texts with different ids may part; with one more
    shard, rows move into that one only. A null text has no bytes, a null id counts as 0, and rows repeated in
    full share a shard with a slot each. Slots number a shard's rows from 0 without gaps: the rows of a shard
    are dealt over slots by hash and counted in two levels. Columns of other names are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        jump(key, shards).alias("jump")
    )
    deal = F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slots(docs))).cast("int")
    kept = rows.select(
        "id", "size", "text_crc32", "jump.shard",
        F.when(F.col("jump.next") == shards, F.lit(shards)).otherwise(F.col("jump.shard")).cast("int").alias("grown_shard"), deal.alias("deal")
    )
    kept = written(kept, workspace(docs.sparkSession, "shards"))
    return before(kept, ["shard"], "deal", [F.col("id"), F.col("text_crc32"), F.col("size")], F.lit(1), "slot").drop("deal")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among 40 shards."""
    return sharded(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
