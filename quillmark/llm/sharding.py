"""Sharding through fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots; bytes and rows are
aggregated per slot, and a slot-to-shard map, stored under a version, deals
the slots out. Records never move between slots, so rebalancing edits only
the map: at most ``slots`` rows, whatever the number of records.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SLOTS = 4096


def slot_of(*keys: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of records (virtual_slot, size)."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(slots: DataFrame, loads: DataFrame) -> DataFrame:
    """Deal slots (virtual_slot, bytes, rows), largest first, each to the shard with the least bytes so far; ``loads`` is one row that says where the shards start."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "rows")))
    start = F.struct("loads", F.array().cast("array<int>").alias("homes"))

    def step(s: Column, x: Column) -> Column:
        to = F.array_position(s["loads"], F.array_min(s["loads"])).cast("int") - 1
        return F.struct(F.transform(s["loads"], lambda y, i: F.when(i == to, y - x["less"]).otherwise(y)).alias("loads"), F.concat(s["homes"], F.array(to)).alias("homes"))

    one = slots.agg(order.alias("slots")).crossJoin(F.broadcast(loads)).select("slots", F.aggregate("slots", start, step, lambda s: s["homes"]).alias("homes"))
    dealt = one.select(F.explode(F.arrays_zip("slots", "homes")).alias("x"))
    return dealt.select("x.slots.virtual_slot", F.col("x.homes").alias("shard"), (-F.col("x.slots.less")).alias("bytes"), "x.slots.rows")


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """Version 1 of a map: (version, virtual_slot, shard, bytes, rows), shards near equal in bytes."""
    loads = totals.sparkSession.range(1).select(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"))
    return _deal(totals, loads).select(F.lit(1).alias("version"), "*")


def rebalance(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new totals or more shards.

    Each shard keeps slots, largest first, up to its fair share; only the rest moves, to the shards with the least bytes.
    """
    fair = totals.agg(F.ceil(F.sum("bytes") / shards).alias("fair"))
    now = totals.join(old.select("virtual_slot", "shard", "version"), "virtual_slot", "left").crossJoin(F.broadcast(fair))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = common.materialize(now.withColumn("stays", F.col("shard").isNotNull() & (F.col("shard") < shards) & (running <= F.col("fair"))), "slot-moves")
    kept = marked.where("stays").select("virtual_slot", "shard", "bytes", "rows")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"))
    start = loads.select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("loads"))
    moved = _deal(marked.where("not stays").select("virtual_slot", "bytes", "rows"), start)
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return kept.unionByName(moved).crossJoin(F.broadcast(version)).select("version", "virtual_slot", "shard", "bytes", "rows")


_MAP = "virtual_slot int, shard int, bytes long, rows long"


def stored_version(spark: SparkSession, path: str) -> int:
    """The last version of the map below ``path``; 0 where there is none."""
    try:
        found = spark.read.schema(f"{_MAP}, version int").parquet(path)
    except AnalysisException:
        return 0
    return found.agg(F.max("version")).first()[0] or 0


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of the map below ``path`` (at most ``slots`` rows) and read it back."""
    slot_map.select("virtual_slot", "shard", "bytes", "rows").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_map(slot_map.sparkSession, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def edit_map(spark: SparkSession, path: str, totals: DataFrame, shards: int) -> DataFrame:
    """The map for these totals and shards: the first one, or the next version of the stored one, edited as ``rebalance`` does."""
    version = stored_version(spark, path)
    new = rebalance(read_map(spark, path, version), totals, shards) if version else first_map(totals, shards)
    return store_map(new, path, version + 1)


def copy_numbers(records: DataFrame) -> DataFrame:
    """Records (doc_id, text_crc32, size, part) with ``copy``, a number from 0 for each of the rows that are equal but for ``part``.

    Equal rows are numbered part by part, so that a row that stands millions of times is no single task's work; part is whatever
    bounds a task's rows, such as the partition that they were read in.
    """
    key = ["doc_id", "text_crc32", "size"]
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy("part"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = records.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before is not null").select(*[F.col(c).alias(f"k_{c}") for c in (*key, "part")], "before")
    same = F.col("part") == F.col("k_part")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    numbered = records.withColumn("inside", inside).join(later, same, "left")
    return numbered.select(*key, (F.col("inside") - 1 + F.coalesce("before", F.lit(0))).alias("copy"))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None, grow: bool = False) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text; other columns are ignored); a map that is stored below ``map_path`` is rebalanced.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, next_shard): slot is the row's position
    in its shard, without gaps from 0, by virtual slot and doc_id. size is the text's UTF-8 bytes plus 1; null counts as empty. The law is
    ``bytes``: shards are near equal in size, so grown_shard is null. A record's virtual slot follows from its id, its text and its
    number among equal rows, so that rows of null or repeated ids and equal rows spread alike. With ``grow`` the map is then
    rebalanced for one shard more and stored as the version after map_version, and next_shard is where that has the row; else it is
    null. An empty table gives an empty result. The texts are read once.
    """
    spark = docs.sparkSession
    t = common.text_bytes()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.spark_partition_id().alias("part"))
    numbered = copy_numbers(common.materialize(read, "records-read"))
    records = common.materialize(numbered.withColumn("virtual_slot", slot_of("doc_id", "text_crc32", "size", "copy", slots=slots)), "records")
    path, totals = map_path or common.scratch_path(spark, "slot-map"), slot_totals(records)
    stored = edit_map(spark, path, totals, shards)
    version = stored_version(spark, path)
    following = (edit_map(spark, path, totals, shards + 1) if grow else stored.withColumn("shard", F.lit(None).cast("int"))).select("virtual_slot", F.col("shard").alias("next_shard"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("rows")
    places = stored.withColumn("before", before).select("virtual_slot", "shard", "before").join(following, "virtual_slot")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    at = records.withColumn("at", inside).join(F.broadcast(places), "virtual_slot")  # at most ``slots`` rows
    return at.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"), "next_shard")


def op8_sharding(spark, sf_dir):
    """Query: all documents into eight shards through 4096 virtual slots, and where they go with a ninth."""
    return shard(common.table(spark, sf_dir, "documents"), grow=True)
