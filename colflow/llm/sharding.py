"""Sharding by jump consistent hashing (Lamping and Veach): a stable key and the
number of shards decide the shard, with no table of the ring, and a new shard
takes rows only into itself. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colflow.llm.common import documents
from colflow.session import materialize

# fixed value: the generator of the published algorithm, key * MULTIPLIER + 1 mod 2^64
MULTIPLIER = 2862933555777941757


def _next_key(key: Column) -> Column:
    """One step of the generator in 64-bit wrap-around arithmetic, from limbs of
    24, 24 and 16 bits so that no product overflows (ANSI mode would fail)."""
    mask = (1 << 24) - 1
    a0, a1, a2 = key.bitwiseAND(mask), F.shiftrightunsigned(key, 24).bitwiseAND(mask), F.shiftrightunsigned(key, 48)
    m0, m1, m2 = (F.lit(MULTIPLIER >> s & mask).cast("long") for s in (0, 24, 48))
    r0 = a0 * m0 + F.lit(1)
    r1 = a0 * m1 + a1 * m0 + F.shiftright(r0, 24)
    r2 = a0 * m2 + a1 * m1 + a2 * m0 + F.shiftright(r1, 24)
    low = r0.bitwiseAND(mask).bitwiseOR(F.shiftleft(r1.bitwiseAND(mask), 24))
    return low.bitwiseOR(F.shiftleft(r2.bitwiseAND(0xFFFF), 48))


def jump_hash(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown`` among one more.

    The jumps for ``shards + 1`` begin with those for ``shards``, so one walk
    gives both: the last jump below each count."""

    def step(state: Column, _: Column) -> Column:
        drawn = _next_key(state["key"])
        jump = F.floor(
            (state["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(drawn, 33) + F.lit(1)).cast("double"))
        )
        return F.when(state["next"] > shards, state).otherwise(
            F.struct(
                drawn.alias("key"),
                F.when(state["next"] < shards, state["next"]).otherwise(state["shard"]).alias("shard"),
                state["next"].alias("grown"),
                jump.alias("next"),
            )
        )

    # ``next`` holds the jump not yet taken; every jump goes up by at least one
    zero = F.lit(0).cast("long")
    start = F.struct(key.cast("long").alias("key"), zero.alias("shard"), zero.alias("grown"), zero.alias("next"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)),
        start,
        step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")),
    )


def assign_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """``rows`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``,
    gapless from 0 inside each shard. Columns of these names are replaced.

    The shard depends on the key and the count alone; null keys count as key 0;
    repeated keys share their shard. The slot numbers the rows as they were
    stored: each stored part numbers its own rows and begins where the parts
    before it end, so no task sees more than the rows of one part, however many
    rows have the same key. An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    placed = rows.select(
        F.struct(*names).alias("row"),
        jump_hash(F.coalesce(F.col(key).cast("long"), F.lit(0)), shards).alias("jump"),
        F.monotonically_increasing_id().alias("seq"),
    )
    # stored, so that the sequence numbers stay as they are if tasks run again
    stored = materialize(placed, "shards").withColumn("part", F.shiftright("seq", 33)).withColumn("shard", F.col("jump.shard"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("shard", "part").count()
    starts = sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("seq")
    numbered = stored.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "part"]).select(
        "row.*",
        F.col("shard"),
        (F.col("start") + F.col("nth")).cast("long").alias("slot"),
        F.col("jump.grown").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents in 16 shards by ``doc_id``; a null text has size 1 and the
    checksum of the empty text."""
    docs = documents(spark, sf_dir) if docs is None else docs
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(slim, "doc_id", 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
