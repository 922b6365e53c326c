"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes are summed per slot, and a small versioned map sends slots to
shards. Rebalancing edits the map; records never change their slot. Only DataFrame functions touch rows; the driver sees one
row per slot (SLOTS is a constant, so that part has a fixed size).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Virtual slots. Fixed for the life of a data set: the hash of a record modulo SLOTS never changes.
SLOTS = 4096
#: Bytes that each record costs besides its text.
OVERHEAD = 16
#: Equal rows that one task numbers at a time.
RUN = 10_000


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of text + 16; null text: 16), text_crc32 (null text: 0), virtual_slot.

    The slot follows doc_id, size, checksum and, for rows equal in these, the number of the repeat, so that neither many texts under one
    doc_id (or a null one) nor many equal rows share a slot. Repeats are counted before they are numbered: a row with very many of
    them is dealt in runs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy(*own).agg(F.count("*").alias("_n"))
    count_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = counted.where(F.col("_n") <= RUN).select(*own, count_to(F.col("_n")).alias("_k"))
    runs = counted.where(F.col("_n") > RUN).select(*own, "_n", count_to(F.ceil(F.col("_n") / RUN)).alias("_r")).repartition("doc_id", "size", "text_crc32", "_r")
    many = runs.select(*own, "_r", count_to(F.least(F.lit(RUN), F.col("_n") - F.col("_r") * RUN)).alias("_i")).select(*own, (F.col("_r") * RUN + F.col("_i")).alias("_k"))
    first = F.xxhash64(*own)
    slot = F.pmod(F.when(F.col("_k") == 0, first).otherwise(F.xxhash64(*own, "_k")), F.lit(slots)).cast("int")
    return few.unionByName(many).select(*own, slot.alias("virtual_slot"))


def slot_loads(slotted: DataFrame) -> DataFrame:
    """Bytes and records per virtual slot: at most one row per slot, aggregated before the shuffle."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def assign(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Slot-to-shard map with near-equal bytes: heaviest slots first, each to the lightest shard; ties to the lower number."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda k: (-loads.get(k, 0), k)):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + max(loads.get(slot, 0), 1), shard))
    return out


def grow(mapping: list[int], loads: dict[int, int], new_shard: int) -> list[int]:
    """The map edited for one more shard: slots move only into it, from the heaviest shards, until it holds its share."""
    out = list(mapping)
    shards = sorted(set(mapping) | {new_shard})
    total = {s: 0 for s in shards}
    own: dict[int, list[int]] = {s: [] for s in shards}
    for slot in sorted(range(len(out)), key=lambda k: (loads.get(k, 0), -k)):
        total[out[slot]] += loads.get(slot, 0)
        own[out[slot]].append(slot)
    share = sum(total.values()) / len(shards)
    while True:
        donor = max((s for s in shards if s != new_shard and own[s]), key=lambda s: (total[s], -s), default=None)
        if donor is None:
            return out
        slot = next((k for k in reversed(own[donor]) if total[new_shard] + loads.get(k, 0) <= share and loads.get(k, 0)), None)
        if slot is None:
            return out
        own[donor].remove(slot)
        total[donor] -= loads[slot]
        total[new_shard] += loads[slot]
        out[slot] = new_shard


def save_map(spark: SparkSession, path: str, version: int, mapping: list[int], offsets: list[int] | None = None) -> None:
    """Write one version of the map: version, virtual_slot, shard, first (the slot's first position in its shard)."""
    rows = F.arrays_zip(
        F.split(F.lit(",".join(map(str, mapping))), ",").alias("shard"),
        F.split(F.lit(",".join(map(str, offsets or [0] * len(mapping)))), ",").alias("first"),
    )
    spark.range(1).select(F.posexplode(rows).alias("virtual_slot", "x")).select(
        F.lit(version).alias("version"), "virtual_slot", F.col("x.shard").cast("int").alias("shard"), F.col("x.first").cast("long").alias("first")
    ).coalesce(1).write.parquet(f"{path}/version={version}/map")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("version int, virtual_slot int, shard int, first long").parquet(f"{path}/version={version}/map")


def latest_version(spark: SparkSession, path: str) -> int:
    """Highest version of the map below path; 0 if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)


def _loads(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    return {r[0]: (r[1], r[2]) for r in slot_loads(slotted).collect()}  # at most one row per slot


def _firsts(mapping: list[int], loads: dict[int, tuple[int, int]]) -> list[int]:
    """First position of each slot in its shard: the records of the shard's slots before it."""
    out, at = [0] * len(mapping), {}
    for slot, s in enumerate(mapping):
        out[slot] = at.get(s, 0)
        at[s] = out[slot] + loads.get(slot, (0, 0))[1]
    return out


def rebalance(docs: DataFrame, map_path: str, new_shard: int | None = None, version: int | None = None, slots: int = SLOTS) -> DataFrame:
    """docs placed by an edited map: a stored version (the latest by default) is loaded, edited for the docs' present bytes and stored
    as the next version. Slots move only into new_shard (by default one more than the map has) until it holds its share; records
    never change their slot. Returns what `shard` returns."""
    spark = docs.sparkSession
    version = version or latest_version(spark, map_path)
    before = [r["shard"] for r in load_map(spark, map_path, version).orderBy("virtual_slot").collect()]  # a row per slot
    rows = with_slots(docs, slots)
    loads = _loads(rows)
    after = grow(before, {k: v[0] for k, v in loads.items()}, max(before) + 1 if new_shard is None else new_shard)
    fresh = latest_version(spark, map_path) + 1
    save_map(spark, map_path, fresh, after, _firsts(after, loads))
    return place(rows, load_map(spark, map_path, fresh))


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """All records in `shards` shards of near-equal bytes (law `bytes`), by way of fixed virtual slots.

    Returns doc_id, size, text_crc32, law, shard, slot (the record's position in its shard, gapless from 0), grown_shard
    (null under this law), virtual_slot, map_version. Null texts count 16 bytes; null and repeated doc_ids keep every row, rows
    equal in all fields take neighbouring positions; an empty table gives an empty result; other columns are ignored. The map
    is stored as the first version below map_path, or as the next one if maps are there; by default the map goes into the shared
    folder and is deleted when the process ends. Equal texts are the groups that may be large: their rows spread over slots, since
    the slot follows the doc_id too and the number of the repeat where that is equal as well, so no shard must take a whole group.
    """
    spark = docs.sparkSession
    rows = with_slots(docs, slots)
    loads = _loads(rows)
    mapping = assign({k: v[0] for k, v in loads.items()}, shards, slots)
    first = _firsts(mapping, loads)
    path = map_path or common.new_path(spark, "slot-map")
    version = latest_version(spark, path) + 1
    save_map(spark, path, version, mapping, first)
    return place(rows, load_map(spark, path, version))


def place(slotted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of `with_slots` with shard and position by a stored version of the map."""
    in_slot = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = slotted.withColumn("at", F.row_number().over(in_slot)).join(F.broadcast(stored), "virtual_slot")  # a row per slot
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
