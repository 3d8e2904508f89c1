"""Sharding through fixed virtual slots.

A record's virtual slot depends on its id and text only and never changes.
A slot map says which shard holds which slot.  Its versions are Parquet
folders ``v=<n>`` in one directory; a version is written once and never
edited.  Rebalancing reads the bytes of each slot, edits the newest map by
moving as few slots as it can and stores the result as the next version, so
records move only with their slots.

Rows that are equal in id and text share a virtual slot.  Where such rows make
a slot hold more than ``1 / WIDE`` of a shard's even share, it is split: its
rows are dealt over extra slots of the map, ``1 / FINE`` of a share each, and
what was dealt is stored.

Only statistics of slots (thousands, whatever the data) reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

SLOTS = 8192
WIDE, FINE = 16, 256
MAP = "slot int, shard int"


def with_slots(docs: DataFrame, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): size is the UTF-8 bytes of the text (null: none) plus 1.

    With ``carry`` the whole record follows as a struct ``row``."""
    content = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
                       F.crc32(content).alias("text_crc32"), *([F.struct("*").alias("row")] if carry else []))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")
    return rows.select(*rows.columns[:3], slot.alias("virtual_slot"), *rows.columns[3:])


def split_wide(rows: DataFrame, sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``rows`` and ``sizes`` with each slot of several rows and too many bytes dealt over slots from ``slots`` on.

    At most ``2 * FINE * shards`` extra slots in all.  Rows are dealt by their
    place in the task that reads them and written once, so a task that runs
    again finds them as they were dealt."""
    total = sum(b for b, _ in sizes.values())
    first, entries = slots, []
    for n, (size, count) in sorted(sizes.items()):
        if count > 1 and size * shards * WIDE > total:
            parts = min(count, -(-size * shards * FINE // total))
            entries.append((n, first, parts))
            first += parts
    if not entries:
        return rows, sizes
    wide = F.broadcast(rows.sparkSession.createDataFrame(entries, "virtual_slot int, first int, parts int"))  # bounded above
    turn = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.col("parts")).cast("int")
    dealt = rows.join(wide, "virtual_slot").withColumn("virtual_slot", F.col("first") + turn).select(*rows.columns)
    dealt = stored(dealt, "split-slots")
    whole = rows.join(wide, "virtual_slot", "left_anti").select(*rows.columns)
    left = {n: v for n, v in sizes.items() if n not in {e[0] for e in entries}}
    return whole.unionByName(dealt), left | slot_sizes(dealt)


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Virtual slot -> (bytes, rows); one entry a slot, combined before the shuffle."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r.virtual_slot: (r.bytes, r.rows) for r in found}


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1, made without data: slot n lies in shard n modulo the number of shards."""
    return [n % shards for n in range(slots)]


def rebalance(old: list[int], sizes: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """An edited map with near equal bytes for shards 0 to ``shards - 1``.

    Shards give up slots until none holds more than its even share (largest
    slots that fit their excess first), and the slots set free, with those of
    shards that are no longer there, go largest first to the lightest shard.
    Then single moves and swaps between the heaviest and the lightest shard
    are made while they narrow the gap.
    """
    size = [sizes.get(n, (0, 0))[0] for n in range(len(old))]
    share = sum(size) / shards
    new, load = list(old), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    free = []
    for n, s in enumerate(old):
        if s < shards:
            held[s].append(n)
            load[s] += size[n]
        else:
            free.append(n)
    for s in range(shards):
        for n in sorted(held[s], key=lambda n: (-size[n], n)):
            if size[n] and load[s] - size[n] >= share:
                load[s] -= size[n]
                free.append(n)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for n in sorted(free, key=lambda n: (-size[n], n)):
        total, s = heapq.heappop(heap)
        new[n] = s
        load[s] = total + size[n]
        heapq.heappush(heap, (load[s], s))
    for _ in range(4 * shards):
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        mine = sorted((size[n], n) for n in range(len(new)) if new[n] == high and size[n])
        other = [(0, -1)] + sorted((size[n], n) for n in range(len(new)) if new[n] == low and size[n])
        best, j = None, 0
        for s, n in mine:  # the difference nearest to half the gap, over moves and swaps
            while j + 1 < len(other) and s - other[j + 1][0] >= gap / 2:
                j += 1
            for k in (j, j + 1):
                if k < len(other) and 0 < s - other[k][0] < gap:
                    off = abs(gap - 2 * (s - other[k][0]))
                    if best is None or off < best[0]:
                        best = (off, n, other[k][1])
        if best is None or best[0] >= gap:
            break
        new[best[1]] = low
        if best[2] >= 0:
            new[best[2]] = high
        load = [0] * shards
        for n, s in enumerate(new):
            load[s] += size[n]
    return new


def store_map(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    """Write one version (a few thousand rows); an existing one is never overwritten."""
    spark.createDataFrame([(n, s) for n, s in enumerate(shards)], MAP).coalesce(1).write.mode("error").parquet(f"{path}/v={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema(MAP).parquet(f"{path}/v={version}").collect()
    return [r.shard for r in sorted(rows, key=lambda r: r.slot)]


def assign(rows: DataFrame, shards: list[int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """``rows`` with shard and slot: the record's place in its shard, from 0 without gaps.

    A place is the number of rows in the shard's earlier virtual slots plus the
    rank in its own, so a window covers one virtual slot, never a shard."""
    spark = rows.sparkSession
    before, table = {}, []
    for n, s in enumerate(shards):
        table.append((n, s, before.get(s, 0)))
        before[s] = before.get(s, 0) + sizes.get(n, (0, 0))[1]
    places = F.broadcast(spark.createDataFrame(table, "virtual_slot int, shard int, before long"))  # len(shards) rows
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(places, "virtual_slot").withColumn("slot", F.col("before") + F.col("rank") - 1).drop("before", "rank")


def shard_documents(docs: DataFrame, path: str, shards: int = 8, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, virtual_slot, shard, slot, map_version (and ``row`` with ``carry``).

    Version 1 of the map in ``path`` deals the slots out evenly; version 2 is
    its rebalanced edit for the bytes found.  Later calls can ``load_map`` a
    version, ``rebalance`` it for new sizes or another number of shards and
    store the next.  Rows without doc_id or text have a slot like any other.
    Repeated rows share their virtual slot, or its parts where it is split, and
    get places of their own.  A text of any length is one record; no shard can
    be smaller than the longest.  Other columns, whatever their names, only
    follow in ``row``.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = with_slots(docs, slots, carry)
    store_map(spark, path, 1, first_map(slots, shards))
    rows, sizes = split_wide(rows, slot_sizes(rows), shards, slots)
    old = load_map(spark, path, 1)
    old += [n % shards for n in range(len(old), max(sizes, default=-1) + 1)]
    store_map(spark, path, 2, rebalance(old, sizes, shards))
    return assign(rows, load_map(spark, path, 2), sizes).withColumn("map_version", F.lit(2))


def write_shards(placed: DataFrame, path: str) -> None:
    """The records themselves as Parquet folders, one a shard (``placed`` from :func:`shard_documents` with ``carry``).

    The folder column is ``shard``, with underscores before it where records have a column of that name."""
    folder = "shard"
    while folder in placed.select("row.*").columns:
        folder = "_" + folder
    out = placed.repartition("shard", "virtual_slot").select("row.*", F.col("shard").alias(folder))
    out.write.partitionBy(folder).parquet(path)
