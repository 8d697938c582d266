"""Sharding by fixed virtual slots and a versioned slot-to-shard map (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed number of virtual slots; never changes with the data or the number of shards.
N_SLOTS = 4096
#: Rows of one slot that one ranking task takes.
RANK_ROWS = 10_000


def with_virtual_slot(rows: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds ``vslot``, a hash of the text's key, so equal texts share a slot; the rows of a text that alone exceeds the mean
    load of a shard are hashed one by one.

    Fewer than ``n_shards`` texts can exceed the mean load, so their table is broadcast.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = rows.groupBy("text_key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * n_shards > total).select("text_key", F.lit(True).alias("heavy"))
    return rows.join(F.broadcast(heavy), "text_key", "left").withColumn(
        "vslot", F.pmod(F.when(F.col("heavy"), F.xxhash64("text_key", "row")).otherwise(F.xxhash64("text_key")), F.lit(n_slots)).cast("int")).drop("heavy")


def slot_totals(rows: DataFrame, size: str = "size") -> DataFrame:
    """Bytes and rows per slot, summed before the shuffle."""
    return rows.groupBy("vslot").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map: slots dealt round robin."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"),
                                       (F.col("id") % n_shards).cast("int").alias("shard"))


def rebalance(old: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """The next version: (version, vslot, shard, bytes, n, moved).

    Every shard keeps its largest slots as long as they fit the mean load; the slots beyond it move, largest first,
    each to the shard with the least load so far. The map has a fixed number of rows, so the edit is one fold.
    """
    sized = old.join(totals, "vslot", "left").select(
        "version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    marked = sized.withColumn("mean", F.sum("bytes").over(everything) / n_shards) \
        .withColumn("upto", F.sum("bytes").over(in_shard)) \
        .withColumn("moved", (F.col("shard") >= n_shards) | ((F.col("bytes") > 0) & (F.col("upto") > F.col("mean"))))
    loads = [F.sum(F.when(~F.col("moved") & (F.col("shard") == s), F.col("bytes")).otherwise(0)) for s in range(n_shards)]
    state = marked.agg(F.array(*loads).alias("loads"),
                       F.sort_array(F.collect_list(F.when(F.col("moved"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("todo"))

    def place(acc, slot):
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1
        return F.struct(F.transform(acc["loads"], lambda x, i: F.when(i == least, x - slot["less"]).otherwise(x)).alias("loads"),
                        F.concat(acc["picks"], F.array(least.cast("int"))).alias("picks"))

    placed = state.select("todo", F.aggregate("todo", F.struct(F.col("loads"), F.array().cast("array<int>").alias("picks")), place)["picks"].alias("picks")) \
        .select(F.explode(F.arrays_zip("todo", "picks")).alias("x")) \
        .select(F.col("x.todo.vslot").alias("vslot"), F.col("x.picks").alias("to"))
    return marked.join(placed, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"), "bytes", "n", "moved")


def shard_rows(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and ``slot``, the row's place in its shard without gaps: rows of earlier slots plus the place in its own.

    ``slot_map`` has one row per virtual slot (a fixed number), so it is broadcast. A slot is ranked in parts of about
    RANK_ROWS rows by hash, whose counts are added up, so a slot with one text's many copies is no single task.
    """
    place = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("vslot", "shard", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("before"), F.expr(f"1 + n div {RANK_ROWS}").alias("parts"))
    dealt = rows.join(F.broadcast(offsets), "vslot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    earlier = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("c")).select("vslot", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "row"))
    return dealt.withColumn("rank", rank).join(counts, ["vslot", "part"]) \
        .withColumn("slot", F.col("before") + F.col("ahead") + F.col("rank") - 1).drop("before", "ahead", "rank", "part", "parts")


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """All documents in shards 0 to n_shards - 1 under the law ``bytes``: shard sizes are near equal.

    size is the UTF-8 bytes of the text plus 1 (null text: 1); text_crc32 of a null text is that of the empty text.
    Equal texts are one group and lie in one shard, unless the group alone exceeds the mean load of a shard: the law then
    splits it. Null counts as the empty text. Repeated rows stay separate rows. Slots' bytes decide version 2 of the stored
    map. grown_shard is null under this law. Empty input gives an empty result. Only doc_id and text are read, once: a
    narrow table of sizes and keys serves all passes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    rows = with_virtual_slot(rows, n_shards)
    first = first_map(spark, n_shards)
    edited = rebalance(first, slot_totals(rows), n_shards)
    versions = materialize(edited.unionByName(first.withColumns({"bytes": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "moved": F.lit(False)})),
                           "slot-map")
    return shard_rows(rows, versions.where("version = 2")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op7_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"))
