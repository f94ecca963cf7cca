"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, bytes are added up a slot, and a small versioned table maps slots to
shards. Rebalancing edits that table and moves whole slots; records never hash anew. Only DataFrame functions are used.

A slot that holds far more records than its share, as all records of one id or without an id meet in one, is *hot*: its
records are dealt to further slots, numbered from ``n_slots`` on, by a key of their own. So the slot table has at most
``n_slots + n_slots / HOT`` rows whatever the input; the map is built in one row and broadcast. Records themselves are
shuffled once, by virtual slot, for their place in the shard, and no slot holds more than about ``HOT`` shares.

Defined cases: a null text counts as empty (size 1, CRC of no bytes); a null id hashes as the empty string; repeated rows
are records of their own; equal keys take places in any order; an empty table has an empty map and result; other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

SLOTS = 4096
HOT = 8  # shares of all records from which a slot is hot
FEW = 64  # records that make no slot hot


def virtual_slot(key: Column, n_slots: int = SLOTS) -> Column:
    """The slot of a key: 32 bits of its MD5, modulo the number of slots."""
    word = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return (word % n_slots).cast("int")


def sized(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and a key of the row: all that later steps need, so the texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), n_slots).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
    )


def cooled(records: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """The records (a table) with those of hot slots dealt to further slots."""
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    share = counts.agg(F.sum("n").alias("total"))
    limit = F.greatest(HOT * F.ceil(F.col("total") / n_slots), F.lit(FEW))
    hot = counts.crossJoin(F.broadcast(share)).filter(F.col("n") > limit).select("virtual_slot", F.ceil(F.col("n") / limit).alias("parts"))
    before = F.sum("parts").over(W.partitionBy().orderBy("virtual_slot")) - F.col("parts")  # n_slots / HOT rows at most
    hot = hot.withColumn("first", F.lit(n_slots) + before)
    dealt = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return records.join(F.broadcast(hot), "virtual_slot", "left").withColumn("virtual_slot", F.coalesce(dealt, "virtual_slot").cast("int")).drop("parts", "first")


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def balanced_map(slots: DataFrame, n_shards: int = 8) -> DataFrame:
    """Version 1 of the map: the heaviest slot goes to the lightest shard, again and again. At most ``n_slots`` rows.

    Returns map_version, virtual_slot, shard, bytes, n_rows.
    """
    heaviest = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "n_rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards")
    )

    def place(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == at, x - slot["b"]).otherwise(x)).alias("loads"),
            F.concat(acc["shards"], F.array(at)).alias("shards"),
        )

    one = slots.agg(heaviest.alias("slots"))
    one = one.withColumn("shards", F.aggregate("slots", start, place, lambda acc: acc["shards"]))
    return one.select(F.explode(F.arrays_zip("slots", "shards")).alias("x")).select(
        F.lit(1).alias("map_version"),
        F.col("x.slots.virtual_slot").alias("virtual_slot"),
        F.col("x.shards").alias("shard"),
        (-F.col("x.slots.b")).alias("bytes"),
        F.col("x.slots.n_rows").alias("n_rows"),
    )


def grow(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, with shard ``n_shards`` added: each old shard gives up slots until it holds its new
    share; slots move into the new shard only.
    """
    shard = W.partitionBy("shard")
    after = F.sum("bytes").over(shard.orderBy("bytes", "virtual_slot"))  # small slots first: the rest is small
    total = F.sum("bytes").over(W.partitionBy())  # at most n_slots rows
    excess = F.sum("bytes").over(shard) - total / (n_shards + 1)
    return slot_map.withColumns({"after": after, "excess": excess}).select(
        (F.col("map_version") + 1).alias("map_version"),
        "virtual_slot",
        F.when(F.col("after") <= F.col("excess"), F.lit(n_shards)).otherwise(F.col("shard")).alias("shard"),
        "bytes",
        "n_rows",
    )


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot (the place in the shard, gapless from 0): the rows of the shard's earlier virtual slots, plus
    the rank within the own one. A sort holds one virtual slot, never a shard."""
    before = F.sum("n_rows").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("n_rows")
    small = slot_map.select("map_version", "virtual_slot", "shard", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return (
        records.withColumn("rank", rank)
        .join(F.broadcast(small), "virtual_slot")
        .withColumn("slot", (F.col("before") + F.col("rank")).cast("long"))
        .drop("before", "rank")
    )


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS) -> DataFrame:
    """Puts whole documents into shards of near-equal bytes; see the contract of op9 for the columns."""
    records = materialize(cooled(materialize(sized(docs, n_slots), "shard-rows"), n_slots), "shard-records")
    slot_map = materialize(balanced_map(slot_bytes(records), n_shards), "slot-map")
    return place(records, slot_map).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
