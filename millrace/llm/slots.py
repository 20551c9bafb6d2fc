"""Sharding by fixed virtual slots, in DataFrame and SQL functions only.

Records are hashed into n_slots slots, the bytes of each slot are summed, and a map from slots to shards is stored with
a version. A new map deals the slots, largest first, each to the shard with least bytes so far. Growing edits a map:
each shard gives its smallest slots to the new one while they fit into what it holds beyond the new fair share, so no
shard falls under that share, the new one gets at most its share, and no other slot moves.

Slots are found from a hash of all of doc_id and the text's checksum, so that copies of one doc_id spread too. Sizes of
slots and the map are n_slots rows, whatever the input, so they may be broadcast. Places inside a shard are numbered
slot by slot: a window orders each slot, and a running sum over the slots of a shard gives each slot's first place.

Defined cases: null text counts as empty (size 8); null doc_id is hashed like any value; repeated rows are numbered
one by one (equal rows are alike, so their order is open); an empty table gives an empty result; other columns are
not carried. More shards than slots raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path

N_SLOTS = 4096
OVERHEAD = 8


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))



def deal(sizes: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """New map (virtual_slot, bytes, shard, version 1): slots by falling bytes, each to the shard with least bytes."""
    if not 0 < n_shards <= n_slots:
        raise ValueError("there must be 1 to n_slots shards")
    spark = sizes.sparkSession
    every = spark.range(n_slots).selectExpr("cast(id as int) virtual_slot").join(F.broadcast(sizes), "virtual_slot", "left").na.fill(0, ["bytes", "n_rows"])
    slots = every.agg(F.expr("array_sort(collect_list(named_struct('neg', -bytes, 'virtual_slot', virtual_slot))) slots"))
    start = f"named_struct('load', array_repeat(0L, {n_shards}), 'shard', cast(array() as array<int>))"
    least = "cast(array_position(a.load, array_min(a.load)) as int)"
    step = f"named_struct('load', transform(a.load, (l, i) -> if(i = {least} - 1, l - s.neg, l)), 'shard', concat(a.shard, array({least} - 1)))"
    dealt = slots.selectExpr("slots", f"aggregate(slots, {start}, (a, s) -> {step}, a -> a.shard) shard")
    flat = dealt.selectExpr("inline(arrays_zip(slots, shard))")
    return flat.selectExpr("slots.virtual_slot virtual_slot", "-slots.neg bytes", "shard", "1 version")


def grow(slot_map: DataFrame) -> DataFrame:
    """The next version with one more shard, which takes the smallest slots of each shard as far as they lie beyond the new fair share."""
    whole = W.partitionBy()  # the map has n_slots rows
    by_size = W.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    j = slot_map.withColumn("all_bytes", F.sum("bytes").over(whole)).withColumn("n_shards", F.max("shard").over(whole) + 1).withColumn("upto", F.sum("bytes").over(by_size))
    own = F.sum("bytes").over(W.partitionBy("shard"))
    return j.select("virtual_slot", "bytes", F.when(F.col("upto") <= own - F.col("all_bytes") / (F.col("n_shards") + 1), F.col("n_shards")).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def store(slot_map: DataFrame, path: str) -> None:
    """Adds a version of the map to the table at path."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, bytes bigint, shard int, version int").parquet(path).where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard and slot, the record's place in its shard (gapless from 0)."""
    sizes = slot_sizes(rows).select("virtual_slot", "n_rows")
    known = slot_map.select("virtual_slot", "shard").join(F.broadcast(sizes), "virtual_slot", "left").na.fill(0, ["n_rows"])
    first = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    known = known.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(first), F.lit(0)).cast("bigint").alias("base"))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(inside)).join(F.broadcast(known), "virtual_slot").withColumn("slot", F.col("base") + F.col("place") - 1)


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Records with size, text_crc32, shard and slot by a map made from their bytes and stored at map_path."""
    spark = docs.sparkSession
    rows = with_slots(docs, n_slots)
    path = map_path or fresh_path(spark, "slot-map")
    store(deal(slot_sizes(rows), n_shards, n_slots), path)
    return assign(rows, load(spark, path, 1))
