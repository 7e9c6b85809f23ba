"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by id into ``n_slots`` virtual slots that never change.
Which shard holds a slot is said by a small map, stored as a table with a
version. Version 0 deals the slots out in turn; rebalancing aggregates the bytes
of every slot and edits the map: slots move, one at a time, from the fullest
shard to the emptiest while that brings the two closer, and slots swap places
where no single move does. Each edit is a new version with the moves that led to
it; older ones stay readable. All other slots, and so their records, stay put.

A slot that holds more than an eighth of a shard's fair share (a repeated id, or
few records in all) is dealt over sub-slots by a hash of the row, as many as
bring each under that share; a single record is never cut. Rows of such a slot may
move when its number of sub-slots changes.

Bounds: the map has ``n_slots`` entries and at most ``8 * n_shards`` sub-slots
more, whatever the table's size; only those totals reach the driver. Texts don't
move: places within a shard come from one range shuffle of ids.

Defined cases: null text has no bytes (size 1); a null id is hashed like any
other value; repeated rows each have their own place; an empty table gives no
rows and leaves version 0; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import running_sum, stage, with_uid

MAP_SCHEMA = "version int, slot int, sub int, shard int, bytes long"
#: A slot above 1 / HOT of a shard's fair share is dealt over sub-slots.
HOT = 8

Map = dict[tuple[int, int], int]


def initial_map(n_slots: int, n_shards: int) -> Map:
    """Version 0: the slots in turn, nothing known of their bytes."""
    return {(s, 0): s % n_shards for s in range(n_slots)}


def rebalance(old: Map, loads: dict[tuple[int, int], int], n_shards: int) -> Map:
    """``old`` edited so that the shards' bytes are near equal, moving as few slots as the steps below need.

    A sub-slot that ``old`` lacks starts where its slot is. Each step takes the
    fullest and the emptiest shard and moves the slot whose bytes come nearest to
    half their difference, or swaps two slots whose difference does; it ends when
    neither brings them closer.
    """
    new = {k: old.get(k, old.get((k[0], 0), k[0] % n_shards)) for k in set(old) | set(loads)}
    held: list[dict] = [{} for _ in range(n_shards)]
    for k in sorted(loads):
        if loads[k] > 0:
            held[new[k]][k] = loads[k]
    total = [sum(h.values()) for h in held]
    for _ in range(4 * len(new) + 64):
        hi = max(range(n_shards), key=lambda s: (total[s], -s))
        lo = min(range(n_shards), key=lambda s: (total[s], s))
        gap = total[hi] - total[lo]
        if gap < 2:
            break
        # best move: bytes nearest to half the gap; best swap: the same of two slots' difference, by one merge of both lists
        ups = sorted((b, k) for k, b in held[hi].items())
        downs = [(0, None)] + sorted((b, k) for k, b in held[lo].items())
        best, j = None, 0
        for b, k in ups:
            while j + 1 < len(downs) and abs(2 * (b - downs[j + 1][0]) - gap) <= abs(2 * (b - downs[j][0]) - gap):
                j += 1
            for c, o in {downs[0], downs[j]}:
                if 0 < b - c < gap:
                    cand = (abs(2 * (b - c) - gap), o is not None, k, o or (-1, -1), b, c)
                    best = cand if best is None else min(best, cand)
        if best is None:
            break
        _, swap, k, o, b, c = best
        del held[hi][k]
        held[lo][k], new[k] = b, lo
        if swap:
            del held[lo][o]
            held[hi][o], new[o] = c, hi
        total[hi] -= b - c
        total[lo] += b - c
    return new


class SlotMaps:
    """The versions of a slot-to-shard map, each a Parquet table of its own under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, version: int, entries: Map, loads: dict | None = None) -> DataFrame:
        loads = loads or {}
        rows = [(version, s, u, shard, int(loads.get((s, u), 0))) for (s, u), shard in sorted(entries.items())]
        table = self.spark.createDataFrame(rows, MAP_SCHEMA)
        table.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v={version}")

    def entries(self, version: int) -> Map:
        return {(r["slot"], r["sub"]): r["shard"] for r in self.read(version).select("slot", "sub", "shard").collect()}


def slotted(docs: DataFrame, id_col: str, text_col: str, n_slots: int) -> DataFrame:
    """(uid, id, size, text_crc32, vslot) of every row; the text is read once and not passed on."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = with_uid(docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32")))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("id"), F.lit(n_slots)).cast("int"))


def _sub(fan) -> F.Column:
    """The sub-slot of a row of a slot dealt ``fan`` ways."""
    return F.when(F.coalesce(fan, F.lit(1)) > 1, F.pmod(F.xxhash64("uid", "text_crc32"), fan)).otherwise(F.lit(0)).cast("int")


def shard_rows(docs: DataFrame, n_shards: int = 16, n_slots: int = 4096, id_col: str = "doc_id", text_col: str = "text",
               maps: SlotMaps | None = None, version: int | None = None) -> tuple[DataFrame, SlotMaps, int]:
    """(uid, id, size, text_crc32, vslot, sub, shard, slot) of every row, the maps and the version used.

    ``slot`` is the row's place in its shard, gapless from 0 in the order of
    (id, uid). Without ``maps`` a new series starts from version 0; with them the
    given version is edited for this table's bytes into the next one.
    """
    spark = docs.sparkSession
    if maps is None:
        maps, version = SlotMaps(spark, scratch_path(spark, "llm-slot-maps")), 0
        maps.write(0, initial_map(n_slots, n_shards))
    if version is None:
        raise ValueError("name the version of the map to edit")
    rows = stage(slotted(docs, id_col, text_col, n_slots), "shard-slots")
    per_slot = {r["vslot"]: int(r["b"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}  # n_slots rows at most
    share = max(1, sum(per_slot.values()) // (HOT * n_shards))
    fans = [(s, -(-b // share)) for s, b in sorted(per_slot.items()) if b > share]  # HOT * n_shards rows at most
    fan = spark.createDataFrame(fans or [(-1, 1)], "vslot int, fan long")
    rows = rows.join(F.broadcast(fan), "vslot", "left").withColumn("sub", _sub(F.col("fan"))).drop("fan")
    loads = {(r["vslot"], r["sub"]): int(r["b"]) for r in rows.groupBy("vslot", "sub").agg(F.sum("size").alias("b")).collect()}
    entries = rebalance(maps.entries(version), loads, n_shards)
    if loads:
        version += 1
        maps.write(version, entries, loads)
    table = maps.read(version).select(F.col("slot").alias("vslot"), "sub", "shard")
    placed = rows.join(F.broadcast(table), ["vslot", "sub"])
    order = placed.select("uid", "id", "size", "text_crc32", "vslot", "sub", "shard", F.lit(1).cast("bigint").alias("one"))
    numbered = running_sum(order, ["shard", "id", "uid"], "one", "before", "shard-order")
    start = numbered.groupBy("shard").agg(F.min("before").alias("start"))  # n_shards rows
    out = numbered.join(F.broadcast(start), "shard").withColumn("slot", F.col("before") - F.col("start"))
    return out.select("uid", F.col("id").alias(id_col), "size", "text_crc32", "vslot", "sub", "shard", "slot"), maps, version


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """The whole rows of ``docs`` in one folder for each shard; each input task writes its share of every shard.

    Added columns get names that ``docs`` does not have.
    """
    uid, shard = (next(n for n in (base + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("uid", "shard"))
    rows = with_uid(docs, uid).join(placed.select(F.col("uid").alias(uid), F.col("shard").alias(shard)), uid).drop(uid)
    rows.write.mode("errorifexists").partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)


__all__ = ["SlotMaps", "initial_map", "rebalance", "shard_rows", "write_shards"]
