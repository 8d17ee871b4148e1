"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots, which never change. A grouped aggregate counts rows and
bytes of each slot (at most SLOTS rows, whatever the input), and a small versioned map, stored as a
table, says which shard holds which slot. Version 1 deals slots in turn, blind to bytes. Balancing and
growing edit the latest stored version only, and store the edit as the next one.

Defined results: a null text has no bytes and the checksum of the empty text. Null and repeated ids
are told apart by checksum and size, so that they spread as far as their texts differ; equal rows
share a slot, in any order. Ties in size go to the lower slot and shard. Other columns do not matter
to `place`, which returns them all beside its own (`__s_` columns are dropped). An empty table gives
an empty table and a map with all slots dealt in turn.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import shared_dir

SLOTS = 16384
ROW_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; version counts the edits."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1

    @classmethod
    def dealt(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Slots in turn, before any bytes are known."""
        return cls(tuple(k % shards for k in range(slots)), shards)

    @classmethod
    def fresh(cls, slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slots first, each to the shard with the fewest bytes; then `balanced`."""
        heap, out = [(0, 0, s) for s in range(shards)], [0] * slots
        for slot in sorted(range(slots), key=lambda k: (-slot_bytes.get(k, 0), k)):
            load, held, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + slot_bytes.get(slot, 0), held + 1, shard))
        return cls(tuple(out), shards)

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, n in slot_bytes.items():
            out[self.shard_of[slot]] += n
        return out

    def balanced(self, slot_bytes: dict[int, int], tolerance: float = 0.001) -> SlotMap:
        """Move slots from the fullest to the emptiest shard while that narrows the gap by more than
        the tolerance; the version rises if any slot moved."""
        out, loads = list(self.shard_of), self.loads(slot_bytes)
        held: list[list[int]] = [[] for _ in loads]
        for slot in slot_bytes:
            held[out[slot]].append(slot)
        mean, moved = sum(loads) / self.shards, False
        for _ in range(len(slot_bytes)):
            full, free = max(range(self.shards), key=lambda s: (loads[s], -s)), min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[full] - loads[free]
            if gap <= tolerance * mean:
                break
            fit = [s for s in held[full] if 0 < slot_bytes[s] < gap]
            if not fit:
                break
            slot = min(fit, key=lambda s: (abs(slot_bytes[s] - gap / 2), s))
            n, moved = slot_bytes[slot], True
            held[full].remove(slot)
            held[free].append(slot)
            loads[full], loads[free], out[slot] = loads[full] - n, loads[free] + n, free
        return SlotMap(tuple(out), self.shards, self.version + 1) if moved else self

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """One more shard: it takes slots from the fullest shards; no slot moves between old ones."""
        out, loads = list(self.shard_of), self.loads(slot_bytes) + [0]
        held: list[list[tuple[int, int]]] = [[] for _ in loads]
        for slot in range(len(out)):
            held[out[slot]].append((slot_bytes.get(slot, 0), slot))
        for h in held:
            h.sort()
        goal = sum(loads) / (self.shards + 1)
        heap = [(-load, s) for s, load in enumerate(loads[:-1])]
        heapq.heapify(heap)
        while heap and loads[-1] < goal:
            load, s = heapq.heappop(heap)
            if not held[s]:
                continue
            n, slot = held[s].pop()
            if loads[-1] + n <= goal + max(1, goal * 0.01) or not held[s]:
                out[slot], loads[-1] = self.shards, loads[-1] + n
                load += n
            if held[s]:
                heapq.heappush(heap, (load, s))
        return SlotMap(tuple(out), self.shards + 1, self.version + 1)

    def moves(self, newer: SlotMap) -> list[tuple[int, int, int]]:
        """(slot, from, to) of the slots that lie elsewhere in a newer version."""
        return [(k, a, b) for k, (a, b) in enumerate(zip(self.shard_of, newer.shard_of)) if a != b]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, k, s) for k, s in enumerate(self.shard_of)], "version int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(path)
        version = version or stored.agg(F.max("version")).first()[0]
        rows = sorted((r.slot, r.shard) for r in stored.where(F.col("version") == version).collect())  # as many as slots
        return cls(tuple(s for _, s in rows), max(s for _, s in rows) + 1, version)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Add `__s_size`, `__s_crc` and `__s_slot`."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    out = docs.withColumns({"__s_size": size_of(F.col(text)), "__s_crc": crc})
    return out.withColumn("__s_slot", F.pmod(F.xxhash64(F.col(key), "__s_crc", "__s_size"), F.lit(slots)).cast("int"))


def slot_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each slot that has any: at most `slots` entries."""
    found = slotted(docs.select(key, text), key, text, slots).groupBy("__s_slot").agg(F.count("*").alias("n"), F.sum("__s_size").alias("b"))
    return {r["__s_slot"]: (r["n"], r["b"]) for r in found.collect()}


def place(spark: SparkSession, rows: DataFrame, slot_map: SlotMap, stats: dict[int, tuple[int, int]]) -> DataFrame:
    """Slotted rows with `shard` and `place`, gapless from 0 in each shard: the rows of the shard's
    lower slots come first, so only rows of one slot need an order."""
    at, first = [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        first.append((slot, shard, at[shard]))
        at[shard] += stats.get(slot, (0, 0))[0]
    starts = F.broadcast(spark.createDataFrame(first, "__s_slot int, shard int, __s_first long"))  # one row a slot
    order = Window.partitionBy("__s_slot").orderBy("__s_crc", "__s_size", *(c for c in ("doc_id",) if c in rows.columns))
    return rows.withColumn("__s_rank", F.row_number().over(order) - 1).join(starts, "__s_slot").withColumn("place", F.col("__s_first") + F.col("__s_rank"))


def rebalanced(spark: SparkSession, slot_bytes: dict[int, int], shards: int, path: str) -> SlotMap:
    """The latest map stored at the path (version 1 where there is none), balanced for the bytes; an
    edit is stored as the next version. What is used is what was stored."""
    try:
        now = SlotMap.load(spark, path)
    except AnalysisException:  # no map yet
        SlotMap.dealt(shards).save(spark, path)
        now = SlotMap.load(spark, path)
    after = now.balanced(slot_bytes)
    if after.version > now.version:
        after.save(spark, path)
    return SlotMap.load(spark, path, after.version)


def digest(spark: SparkSession, docs: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """path: of the stored slot map; a new one in the shared folder if not given."""
    docs = docs.select("doc_id", "text")
    stats = slot_stats(docs)
    load = {k: b for k, (_, b) in stats.items()}
    slot_map = rebalanced(spark, load, shards, path or f"{shared_dir(spark).rstrip('/')}/slots-{uuid.uuid4().hex}")
    rows = slotted(docs).drop("text")
    return place(spark, rows, slot_map, stats).select(
        "doc_id",
        F.col("__s_size").alias("size"),
        F.col("__s_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__s_slot").cast("long").alias("virtual_slot"),
        F.lit(slot_map.version).alias("map_version"),
    )
