"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, bytes are added up per slot, and a versioned table maps slots to
shards.  Rebalancing edits that map: version n + 1 moves as few slots as it needs and leaves the rest.
Only the slot table (one row per slot, a fixed number) reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.words import kept_row
from wayfare.session import settle

SLOTS = 8192


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per row: ``row``, ``id``, ``size`` (UTF-8 bytes and one), ``text_crc32`` and ``virtual_slot``.

    The slot hashes id, checksum and source, so rows that share an id still spread; a null text is empty.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = kept_row(docs, id=docs["doc_id"], size=(F.octet_length(text) + 1).cast("long"), text_crc32=F.crc32(text), source__=docs["source"])
    slot = F.pmod(F.xxhash64("id", "text_crc32", "source__"), F.lit(slots)).cast("int")
    return rows.select("row", "id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, records: at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def first_map(slots: int, shards: int) -> dict[int, int]:
    """Version 0: slots dealt in turn."""
    return {s: s % shards for s in range(slots)}


def rebalanced(slot_map: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map with near equal bytes per shard; a balanced map stays as it is.

    Slots of shards that no longer exist go, largest first, to the lightest shard.  Then the heaviest and the
    lightest shard exchange the slot or pair of slots that evens them out most; a shard that nothing helps is set
    aside, until none is left above the lightest.
    """
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    pool = []
    for slot, shard in slot_map.items():
        if shard < shards:
            held[shard].add(slot)
            load[shard] += sizes.get(slot, 0)
        else:
            pool.append(slot)
    lightest = [(load[k], k) for k in range(shards)]
    heapq.heapify(lightest)
    for slot in sorted(pool, key=lambda s: (-sizes.get(s, 0), s)):
        _, k = heapq.heappop(lightest)
        held[k].add(slot)
        load[k] += sizes.get(slot, 0)
        heapq.heappush(lightest, (load[k], k))
    open_ = set(range(shards))
    while len(open_) > 1:
        high = max(open_, key=lambda k: (load[k], -k))
        low = min(open_, key=lambda k: (load[k], k))
        if not _exchange(held, load, sizes, high, low):
            open_.discard(high)
    return {slot: k for k in range(shards) for slot in held[k]}


def _exchange(held: list[set[int]], load: list[int], sizes: dict[int, int], high: int, low: int) -> bool:
    """Move or swap slots between two shards so that their difference shrinks most; false if nothing shrinks it."""
    gap = load[high] - load[low]
    if gap <= 1:
        return False
    ours = sorted((sizes.get(s, 0), s) for s in held[high])
    theirs = [(0, -1), *sorted((sizes.get(s, 0), s) for s in held[low])]
    best, j = None, 0
    for size, slot in ours:
        # The best partner is about gap / 2 smaller; partners grow with the slots.
        while j + 1 < len(theirs) and theirs[j + 1][0] <= size - gap / 2:
            j += 1
        for other, partner in theirs[j : j + 2]:
            left = abs(gap - 2 * (size - other))
            if size > other and left < gap and (best is None or left < best[0]):
                best = (left, size - other, slot, partner)
    if best is None:
        return False
    _, moved, slot, partner = best
    held[high].discard(slot)
    held[low].add(slot)
    if partner >= 0:
        held[low].discard(partner)
        held[high].add(partner)
    load[high] -= moved
    load[low] += moved
    return True


def map_table(spark, versions: list[dict[int, int]]) -> DataFrame:
    """The stored map: version, virtual_slot, shard; later versions are edits of earlier ones."""
    rows = [(v, slot, shard) for v, m in enumerate(versions) for slot, shard in sorted(m.items())]
    return settle(spark.createDataFrame(rows, "version int, virtual_slot int, shard int"))


def sharded(docs: DataFrame, shards: int = 16, *, slots: int = SLOTS) -> DataFrame:
    """``row``, ``id``, ``size``, ``text_crc32``, ``virtual_slot``, ``shard`` and ``place`` (from 0 in the shard, gapless).

    Places come in two parts: the rows of a slot are numbered in the slot's own window, and the slots of
    a shard follow each other by the counts in the slot table.  No window holds more than a slot.
    An empty table gives no rows.  Repeated rows share a slot and get places of their own.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots)
    # One row per slot, at most ``slots``.
    sizes = {r["virtual_slot"]: (r["bytes"], r["records"]) for r in slot_bytes(rows).collect()}
    start = first_map(slots, shards)
    edited = rebalanced(start, {s: b for s, (b, _) in sizes.items()}, shards)
    stored = map_table(spark, [start, edited]).where("version = 1").select("virtual_slot", "shard")
    before, counts = [0] * shards, []
    for slot in range(slots):
        counts.append((slot, before[edited[slot]]))
        before[edited[slot]] += sizes.get(slot, (0, 0))[1]
    starts = spark.createDataFrame(counts, "virtual_slot int, start__ long")
    table = stored.join(starts, "virtual_slot")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size"))
    placed = rows.withColumn("within__", within).join(F.broadcast(table), "virtual_slot")
    return placed.select("row", "id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start__") + F.col("within__") - 1).alias("place"))
