"""Resharding by minimum-cost flow.

Rows lie in blocks, blocks in old shards. From the old shards' bytes and the new shards' capacities a minimum-cost flow
says how many bytes go from each old to each new shard: keeping a byte costs nothing, moving it costs one, so the flow
moves the fewest bytes that the capacities allow. Blocks are then handed out along the flow, largest first, and the last
unevenness is levelled block by block. Rows of moved blocks are rewritten; shards without moves aren't touched.

A block holds the rows whose texts hash to it, so equal texts lie together. Only a group of equal texts of more than `SHARE` of
a shard is cut, into pieces by its rows' ids, so a group that holds a third of all rows spreads over the shards. Groups of
more than `ROWS_A_BLOCK` rows are cut the same way for the tasks that write them, but their pieces go to one shard. What the
driver holds is one number for each block and such piece; there is a block for every `ROWS_A_BLOCK` rows, and
`BLOCKS_A_SHARD` for each shard at least. Tasks that write get about `BIN_BYTES` each, however many that makes.

Defined results: a null text has no bytes and counts as empty; null ids are ordinary values; repeated rows get slots of
their own, in any order among each other. An empty table gives empty shards.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, work_path

BLOCKS_A_SHARD = 160
ROWS_A_BLOCK = 100_000
BIN_BYTES = 32 << 20
#: Groups of equal texts stay together up to this share of a mean shard; larger ones are cut into pieces of an eighth of it.
SHARE = 0.5


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flow from sources to sinks that carries all supply at the least cost, by successive shortest paths with potentials.

    sum(capacity) must be at least sum(supply); costs must not be negative.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities can't hold the supply")
    left, room, flow = list(supply), list(capacity), {}
    potential = [0] * (n + m)
    while True:
        start = [i for i in range(n) if left[i] > 0]
        if not start:
            return {k: v for k, v in flow.items() if v}
        far = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        heap = []
        for i in start:
            far[i] = 0
            heapq.heappush(heap, (0, i))
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow.get((i, u - n), 0) > 0)
            for v, price in steps:
                reach = d + price + potential[u] - potential[v]
                if reach < far[v]:
                    far[v], back[v] = reach, u
                    heapq.heappush(heap, (reach, v))
        sink = min((j for j in range(m) if room[j] > 0), key=lambda j: far[n + j] + potential[n + j])
        limit = far[n + sink]
        for k in range(n + m):
            potential[k] += min(far[k], limit)
        path, v = [], n + sink
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], room[sink], *(flow[(b, a - n)] for a, b in path if a >= n))
        left[v] -= amount
        room[sink] -= amount
        for a, b in path:
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + amount
            else:
                flow[(b, a - n)] -= amount


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


@dataclass
class Plan:
    """Where each block goes: block -> new shard; which old shards lose or gain rows; bytes that move."""

    place: dict[tuple, int]
    affected: set[int]
    moved_bytes: int
    flow: dict[tuple[int, int], int] = field(default_factory=dict)
    columns: tuple[str, str, str] = ("__shard", "__slot", "__old")  # as reshard named them


def plan_blocks(blocks: dict[tuple, tuple[int, int]], old_shards: int, new_shards: int, capacities: list[int] | None = None) -> Plan:
    """blocks: block -> (old shard, bytes). Shard k is kept as shard k where it is still there."""
    supply = [0] * old_shards
    for old, size in blocks.values():
        supply[old] += size
    room = list(capacities or even(sum(supply), new_shards))
    flow = min_cost_flow(supply, room, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    rest = [{j: flow[(i, j)] for j in range(new_shards) if (i, j) in flow} or {i % new_shards: 0} for i in range(old_shards)]
    place, load = {}, [0] * new_shards
    for block in sorted(blocks, key=lambda b: (-blocks[b][1], b)):
        old, size = blocks[block]
        to = max(rest[old], key=lambda j: (rest[old][j], j == old, -j))
        rest[old][to] -= size
        place[block] = to
        load[to] += size
    _level(blocks, place, load, room)
    moves = {(blocks[b][0], to): 0 for b, to in place.items()}
    for b, to in place.items():
        moves[(blocks[b][0], to)] += blocks[b][1]
    affected = {s for (i, j), size in moves.items() if i != j and size for s in (i, j)}
    return Plan(place, affected, sum(v for (i, j), v in moves.items() if i != j), moves)


def _level(blocks: dict, place: dict, load: list[int], room: list[int]) -> None:
    """Hands blocks from the fullest shard to the emptiest while that brings them closer."""
    if len(load) < 2:
        return
    held: list[list] = [[] for _ in load]
    for b, to in place.items():
        held[to].append((blocks[b][1], b))
    for x in held:
        x.sort()
    while True:  # each move makes the loads' squares smaller, so this ends
        over = [load[j] - room[j] for j in range(len(load))]
        high, low = over.index(max(over)), over.index(min(over))
        gap = over[high] - over[low]
        at = bisect.bisect_right(held[high], (gap // 2, (float("inf"),))) - 1
        if at < 0 or held[high][at][0] == 0:
            if not held[high] or held[high][0][0] >= gap:
                return
            at = 0
        size, b = held[high][at]
        if not 0 < size < gap:
            return
        held[high].pop(at)
        bisect.insort(held[low], (size, b))
        load[high] -= size
        load[low] += size
        place[b] = low


def reshard(docs: DataFrame, *, old_shards: int, new_shards: int, capacities: list[int] | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Plan]:
    """Every row of docs with __shard, __slot (gapless from 0 in its shard) and __old, and the plan; names made fresh where taken.

    The old layout has block b in old shard b % old_shards.
    """
    size, block, part, old, shard, base, bin_, nth, slot, many, from_, text_hash = fresh(docs, "size_", "block_", "part_", "old_", "shard_", "base_", "bin_", "nth_", "slot_", "many_", "from_", "text_hash_")
    out_shard, out_slot, out_old = fresh(docs, "__shard", "__slot", "__old")
    rows = docs.count()
    n_blocks = max(BLOCKS_A_SHARD * new_shards, rows // ROWS_A_BLOCK)
    n_blocks += -n_blocks % old_shards
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sized = docs.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).withColumn(block, F.pmod(hashed, F.lit(n_blocks)).cast("int"))
    spark = docs.sparkSession
    totals = {r[0]: (r[1], r[2]) for r in sized.groupBy(block).agg(F.sum(size), F.count("*")).collect()}
    share = max(1, int(sum(v for v, _ in totals.values()) * SHARE / new_shards))
    groups = _large_groups(sized.where(F.col(block).isin([b for b, (v, n) in totals.items() if v > share or n > 4 * ROWS_A_BLOCK])), hashed, block, size, share)
    units: dict[tuple, tuple] = {}
    if groups:
        listed, used = [], dict.fromkeys(totals, 1)
        for b, h, total, count in groups:
            pieces = max(-(-count // ROWS_A_BLOCK), -(-8 * total // share) if total > share else 1)
            listed.append((b, h, used[b], pieces))
            units.update({(b, used[b] + k): (b, used[b] + (k if total > share else 0)) for k in range(pieces)})
            used[b] += pieces
        cut = F.broadcast(spark.createDataFrame(listed, f"{block} int, {text_hash} long, {from_} int, {many} int"))
        sized = sized.withColumn(text_hash, hashed).join(cut, [block, text_hash], "left")
        sized = sized.withColumn(part, F.coalesce(F.col(from_) + F.pmod(F.xxhash64(doc_id, F.lit(7)), F.col(many)).cast("int"), F.lit(0))).drop(from_, many, text_hash)
    else:
        sized = sized.withColumn(part, F.lit(0))
    blocks: dict[tuple, tuple[int, int]] = {}
    sizes = {(b, p): (total, count) for b, p, total, count in sized.groupBy(block, part).agg(F.sum(size), F.count("*")).collect()}
    for key, (total, _) in sizes.items():
        unit = units.get(key, key)
        blocks[unit] = (key[0] % old_shards, blocks.get(unit, (0, 0))[1] + total)
    plan = plan_blocks(blocks, old_shards, new_shards, capacities)
    plan.columns = (out_shard, out_slot, out_old)
    place = {key: plan.place[units.get(key, key)] for key in sizes}
    at, listed, filled = [0] * new_shards, [], 0
    for key in sorted(sizes, key=lambda k: (place[k], k)):
        to = place[key]
        listed.append((*key, to, at[to], filled // BIN_BYTES + to))
        at[to] += sizes[key][1]
        filled += sizes[key][0]
    if not listed:
        listed = [(0, 0, 0, 0, 0)]
    bins = {x[-1]: n for n, x in enumerate({x[-1]: x for x in listed}.values())}
    listed = [(*x[:-1], bins[x[-1]]) for x in listed]
    placed = sized.join(F.broadcast(spark.createDataFrame(listed, f"{block} int, {part} int, {shard} int, {base} long, {bin_} int")), [block, part])
    placed = placed.repartitionById(len(bins), F.col(bin_))
    in_block = Window.partitionBy(shard, bin_, block, part).orderBy(F.col(doc_id).asc_nulls_first(), hashed)
    placed = placed.withColumn(nth, F.row_number().over(in_block)).withColumn(slot, F.col(base) + F.col(nth) - 1)
    placed = placed.withColumn(old, F.col(block) % old_shards)
    return placed.select(*docs.columns, F.col(shard).alias(out_shard), F.col(slot).cast("long").alias(out_slot), F.col(old).alias(out_old)), plan


def _large_groups(rows: DataFrame, hashed: Column, block: str, size: str, share: int) -> list[tuple]:
    """(block, hash of the text, bytes, rows) of the groups that are cut: at most one for every ROWS_A_BLOCK rows, and 1 / SHARE a shard."""
    found = rows.groupBy(F.col(block).alias("b"), hashed.alias("h")).agg(F.sum(size).alias("total"), F.count("*").alias("count"))
    return sorted(tuple(r) for r in found.where((F.col("total") > share) | (F.col("count") > ROWS_A_BLOCK)).collect())


def rewrite(placed: DataFrame, plan: Plan, path: str | None = None) -> DataFrame:
    """Writes the files of the affected shards, one folder each, and reads them back; the others keep their files.

    Where no shard k held files before, all its rows are written.
    """
    spark, shard = placed.sparkSession, plan.columns[0]
    path = path or work_path(spark, "shards")
    touched = placed.where(F.col(shard).isin(sorted(plan.affected))) if plan.affected else placed
    touched.write.partitionBy(shard).parquet(path)
    columns = [f for f in placed.schema.fields if f.name != shard] + [placed.schema[shard]]
    return spark.read.schema(type(placed.schema)(columns)).parquet(path)
