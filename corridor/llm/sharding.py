"""Placement of documents on shards by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import bytes_of, free_name

SHARDS = 64
#: A prime, over fifty slots a shard: shares differ by a few hundredths, and the table stays one small broadcast.
SLOTS = 4099
#: Bytes of values that a task writes, about.
PIECE_BYTES = 64 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot. Shards claim in turns, each the next slot in its own order that is still free.

    The order of a shard starts at an offset and goes on by a step, both from the hash of its name, so that it visits
    every slot of a prime-sized table. A shard that is added takes slots from all the others; the rest hardly move.
    """
    if not 0 < shards <= slots:
        raise ValueError("shards must be 1 to slots")
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of 3 or more")
    at = [_number(f"offset:{s}") % slots for s in range(shards)]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in range(shards)]
    table, free = [-1] * slots, slots
    while free:
        for s in range(shards):
            while table[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            table[at[s]] = s
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 48 bits of the md5 of the key, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with slot and shard (with as many _ before them as make the names free).

    The key is ``key``'s text; a row without one goes by the md5 of its text, and without both to slot 0's shard.
    Equal keys share a shard, as a placement must; nothing is grouped or sorted here, so a hot key costs no task more.
    The table has ``slots`` rows, whatever the data, and is broadcast.
    """
    spark = docs.sparkSession
    slot, shard = free_name("slot", docs.columns), shard_column(docs)
    number = free_name("_lookup", [*docs.columns, slot, shard])
    filled = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    table = spark.range(1).select(F.posexplode(filled).alias(number, "_to")).select(number, F.col("_to").cast("int").alias(shard))
    of = F.coalesce(F.col(key).cast("string"), F.md5(F.col("text").cast("binary"))) if "text" in docs.columns else F.col(key).cast("string")
    out = docs.withColumn(slot, F.coalesce(slot_of(of, slots), F.lit(0)))
    return out.join(F.broadcast(table), F.col(slot) == F.col(number), "left").drop(number)


def shard_column(docs: DataFrame) -> str:
    """The name that ``place`` gives to the shard of ``docs``."""
    return free_name("shard", docs.columns)


def ordered_by_shard(placed: DataFrame, shard: str = "shard", shards: int = SHARDS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``placed`` dealt for writing: a task holds pieces of shards, sorted by shard and doc_id (nulls first, ties anyhow).

    A shard falls into as many pieces as its share of all bytes needs, so neither a large table nor a hot key makes one
    task hold more than about ``piece_bytes``. Pieces are drawn by a hash of doc_id, text (if there is one) and the input
    partition: copies of one row are spread too, and a partition computed anew goes to the same pieces.
    """
    total = placed.agg(F.sum(bytes_of(placed))).first()[0] or 0
    pieces = -(-total // (piece_bytes * shards)) or 1
    tasks = max(-(-total // piece_bytes), placed.sparkSession.sparkContext.defaultParallelism)
    names = placed.columns
    of = [F.col(f"`{c}`") for c in ("doc_id", "text") if c in names]
    rows = placed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.pmod(F.xxhash64(*of, F.spark_partition_id()), F.lit(pieces)).alias("_piece"))
    dealt = rows.repartition(min(tasks, pieces * shards), F.col(f"_row.`{shard}`"), F.col("_piece"))
    return dealt.sortWithinPartitions(F.col(f"_row.`{shard}`"), F.col("_row.doc_id")).select("_row.*")
