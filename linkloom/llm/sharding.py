"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, far more than there are shards. Bytes are summed
per slot, and a versioned map says which shard owns each slot. Only the map is edited when
shards are rebalanced or added; a record's slot never changes, so an edit moves whole slots.
The map has one entry a slot, whatever the size of the corpus.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._rank import rank_within
from ._scratch import Scratch

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """shard[s] owns slot s; an edit gives a new version and leaves the old one as it was."""

    version: int
    n_shards: int
    shard: tuple[int, ...]

    @staticmethod
    def balanced(weights: list[int], n_shards: int) -> SlotMap:
        """First version: heaviest slot first, each to the shard with the fewest bytes so far (ties: lower numbers)."""
        heap = [(0, s) for s in range(n_shards)]
        owner = [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            load, s = heapq.heappop(heap)
            owner[slot] = s
            heapq.heappush(heap, (load + weights[slot], s))
        return SlotMap(1, n_shards, tuple(owner))

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for w, s in zip(weights, self.shard):
            out[s] += w
        return out

    def rebalanced(self, weights: list[int], tolerance: float = 0.01) -> SlotMap:
        """Next version: slots go from the fullest to the emptiest shard while that narrows the gap."""
        owner, loads = list(self.shard), self.loads(weights)
        slots: list[set[int]] = [set() for _ in loads]
        for i, s in enumerate(owner):
            slots[s].add(i)
        mean = sum(loads) / len(loads)
        for _ in range(len(owner)):
            high, low = max(range(len(loads)), key=lambda s: (loads[s], -s)), min(range(len(loads)), key=lambda s: (loads[s], s))
            gap = loads[high] - loads[low]
            fit = [i for i in slots[high] if 0 < weights[i] < gap]
            if gap <= tolerance * mean or not fit:
                break
            move = min(fit, key=lambda i: (abs(gap / 2 - weights[i]), i))
            slots[high].discard(move)
            slots[low].add(move)
            loads[high] -= weights[move]
            loads[low] += weights[move]
            owner[move] = low
        return replace(self, version=self.version + 1, shard=tuple(owner))

    def grown(self, weights: list[int]) -> SlotMap:
        """Next version with one shard more, which alone takes slots, from the fullest shards."""
        new, owner, loads = self.n_shards, list(self.shard), [*self.loads(weights), 0]
        target = sum(loads) / (new + 1)
        for slot in sorted(range(len(owner)), key=lambda i: (-weights[i], i)):
            if weights[slot] and loads[owner[slot]] > target and loads[new] + weights[slot] <= target:
                loads[owner[slot]] -= weights[slot]
                loads[new] += weights[slot]
                owner[slot] = new
        return SlotMap(self.version + 1, new + 1, tuple(owner))

    def table(self, spark: SparkSession, weights: list[int], rows: list[int]) -> DataFrame:
        return spark.createDataFrame([(self.version, i, s, weights[i], rows[i]) for i, s in enumerate(self.shard)], MAP_SCHEMA)

    def store(self, spark: SparkSession, path: str, weights: list[int], rows: list[int]) -> None:
        """Adds this version to the map table; stored versions are never changed."""
        self.table(spark, weights, rows).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or else the latest version."""
        rows = spark.read.schema(MAP_SCHEMA).parquet(path)
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        shard = tuple(r["shard"] for r in rows.filter(F.col("version") == version).orderBy("slot").collect())
        return SlotMap(version, max(shard) + 1, shard)


def record_slots(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot): the slot comes from the id, or from the text where the id is null."""
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0).cast("long"))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null"), text)).otherwise(key)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Puts all records into shards of near equal bytes through virtual slots.

    Returns id, size, text_crc32, virtual_slot, shard, slot (the record's place in its shard,
    gapless from 0) and map_version. Null texts have size 8 and the CRC of no bytes. Repeated
    rows are records of their own. An empty table gives no rows. With map_path, the stored
    map is used and edited where bytes have drifted; the version in use is stored there.
    Other columns of ``docs`` are not read, so their names never clash.
    """
    spark = docs.sparkSession
    records = Scratch(spark, "sharding").save(record_slots(docs, n_slots, id_col, text_col), "records")
    weights, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        weights[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["n"]
    slot_map = SlotMap.balanced(weights, n_shards)
    if map_path:
        try:
            stored = SlotMap.load(spark, map_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            slot_map.store(spark, map_path, weights, rows)
        else:
            while stored.n_shards < n_shards:
                stored = stored.grown(weights)
            slot_map = stored.rebalanced(weights)
            slot_map.store(spark, map_path, weights, rows)
    bases, filled = [], [0] * n_shards
    for slot, shard in enumerate(slot_map.shard):
        bases.append(filled[shard])
        filled[shard] += rows[slot]
    lookup = F.broadcast(spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(slot_map.shard, bases))], "virtual_slot int, shard int, base long"))
    ranked = rank_within(records, "virtual_slot", dict(enumerate(rows)), [F.col("id"), F.col("text_crc32"), F.col("size")], "within")
    return ranked.join(lookup, "virtual_slot").select("id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("within")).alias("slot"), F.lit(slot_map.version).alias("map_version"))
