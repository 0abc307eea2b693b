"""Resharding by minimum-cost flow.

From the bytes of the old shards and the capacities of the new ones, a minimum-cost flow
says how many bytes stay (cost 0) and how many move (cost 1 a byte). The flow is carried
out in blocks: the rows of an old shard are dealt by the hash of their place into blocks
of about equal size, so that a block is a small part of a shard at every corpus size.
An old shard keeps blocks, the largest first, as far as its flow allows; the others go,
the largest first, to the new shard that has the most bytes open. The driver sees block
sizes only, a number that follows from ``blocks`` and not from the rows.

Only new shards that gain or lose a block differ from the old ones; ``rewrite`` writes
those and no others.

A null text has no bytes, and every row has one byte more than its text. Rows are told
apart by their place, so repeated rows and null ids are rows like any other. Input columns
named like output columns are replaced. A very long text is a row that may be larger than a
shard's room; the shard that has the most open takes it. An empty table gives no rows, and all
new shards are written empty.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import without

BLOCKS = 16384
MOST_OLD_SHARDS = 1024


class FlowNetwork:
    """Minimum-cost flow by cheapest augmenting paths with potentials."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.out)
        while True:
            far, by = [None] * len(self.out), [-1] * len(self.out)
            far[source], heap = 0, [(0, source)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for e in self.out[v]:
                    w = self.to[e]
                    if self.room[e] and (far[w] is None or d + self.cost[e] + height[v] - height[w] < far[w]):
                        far[w], by[w] = d + self.cost[e] + height[v] - height[w], e
                        heapq.heappush(heap, (far[w], w))
            if far[sink] is None:
                return
            height = [h + f if f is not None else h for h, f in zip(height, far)]
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            n = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= n
                self.room[e ^ 1] += n


def staying_bytes(sizes: list[int], capacities: list[int]) -> list[int]:
    """Bytes that each old shard keeps where the fewest bytes move. Old shard i and new
    shard i are the same place; the capacities add up to the sizes."""
    n, m = len(sizes), len(capacities)
    source, pool, sink = n + m, n + m + 1, n + m + 2
    net = FlowNetwork(n + m + 3)
    stay = []
    for i, size in enumerate(sizes):
        net.arc(source, i, size, 0)
        stay.append(net.arc(i, n + i, size, 0) if i < m else None)
        net.arc(i, pool, size, 1)
    for j, capacity in enumerate(capacities):
        net.arc(pool, n + j, sum(sizes), 0)
        net.arc(n + j, sink, capacity, 0)
    net.run(source, sink)
    return [net.flow(e) if e is not None else 0 for e in stay]


@dataclass
class Transfers:
    """What goes where. ``place[(old shard, block)]`` is (new shard, first slot)."""

    place: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    moved_bytes: int = 0
    flow_bytes: int = 0
    affected: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


def plan_transfers(blocks: list[tuple[int, int, int, int]], new_shards: int, capacities: list[int] | None = None) -> Transfers:
    """Transfers of blocks (old shard, block, bytes, rows) to new shards of these
    capacities, equal ones by default."""
    n_old = 1 + max((b[0] for b in blocks), default=-1)
    sizes = [0] * n_old
    for old, _, size, _ in blocks:
        sizes[old] += size
    total = sum(sizes)
    if capacities is None:
        capacities = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    stay = staying_bytes(sizes, capacities)
    out = Transfers(flow_bytes=total - sum(stay), sizes=[0] * new_shards)
    where, moving, touched = {}, [], set()
    for old, block, size, _ in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        if old < new_shards and size <= stay[old]:
            stay[old] -= size
            where[old, block] = old
            out.sizes[old] += size
        else:
            moving.append((old, block, size))
    open_bytes = [(-(c - s), j) for j, (c, s) in enumerate(zip(capacities, out.sizes))]
    heapq.heapify(open_bytes)
    for old, block, size in moving:
        left, j = heapq.heappop(open_bytes)
        where[old, block] = j
        out.sizes[j] += size
        if j != old:
            out.moved_bytes += size
            touched |= {j, old}
        heapq.heappush(open_bytes, (left + size, j))
    slots = [0] * new_shards
    for old, block, _, rows in sorted(blocks, key=lambda b: b[:2]):
        j = where[old, block]
        out.place[old, block] = (j, slots[j])
        slots[j] += rows
    # A new shard without an old one of its number has to be written in any case.
    out.affected = sorted(j for j in range(new_shards) if j in touched or j >= n_old)
    return out


def file_number(docs: DataFrame) -> Column:
    """Number of the file a row comes from, the files with rows in the order of their paths.
    Beyond MOST_OLD_SHARDS files, files that hash alike count as one old shard."""
    name = F.col("_metadata.file_path")
    found = docs.select(name.alias("file")).distinct().limit(MOST_OLD_SHARDS + 1).collect()
    files = sorted(r.file for r in found)
    if len(files) > MOST_OLD_SHARDS:
        return F.pmod(F.xxhash64(name), F.lit(MOST_OLD_SHARDS)).cast("int")
    if not files:
        return F.lit(0)
    numbers = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i))])
    return numbers[name]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1


def reshard(
    docs: DataFrame,
    old_shard: Column,
    place: list[Column],
    new_shards: int,
    size: Column | None = None,
    blocks: int = BLOCKS,
) -> tuple[DataFrame, Transfers]:
    """The documents with size, old_shard, shard and slot, and the transfers.

    ``old_shard`` numbers the old shards from 0; ``place`` tells rows apart; ``size`` is
    a row's bytes, by default those of the column ``text`` and one more. Slots are gapless
    from 0 in every new shard."""
    own = without(docs, "size", "old_shard", "shard", "slot", "_block", "_at", "_first", "_rank")
    sized = docs.select(
        *[F.col(f"`{c}`") for c in own.columns],
        (text_bytes(F.col("text")) if size is None else size).cast("long").alias("size"),
        old_shard.cast("int").alias("old_shard"),
        F.struct(*place).alias("_at"),
    )
    n_old = 1 + (sized.agg(F.max("old_shard")).first()[0] or 0)
    each = max(16, blocks // n_old)
    blocked = sized.withColumn("_block", F.pmod(F.xxhash64("_at"), F.lit(each)).cast("int"))
    loads = blocked.groupBy("old_shard", "_block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    plan = plan_transfers([(r.old_shard, r._block, r.b, r.n) for r in loads], new_shards)
    rows = [(o, b, j, s) for (o, b), (j, s) in plan.place.items()]
    table = docs.sparkSession.createDataFrame(rows, "old_shard int, _block int, shard int, _first bigint")
    # As many rows as there are blocks: bounded by ``blocks`` and MOST_OLD_SHARDS.
    found = blocked.join(F.broadcast(table), ["old_shard", "_block"])
    # A block lies in one shard. Named here, the shard can be filtered below the window: a job that
    # needs some shards moves the texts of those alone.
    in_block = Window.partitionBy("old_shard", "_block", "shard").orderBy("_at")
    slot = F.col("_first") + F.row_number().over(in_block) - 1
    names = [F.col(f"`{c}`") for c in own.columns]
    return found.withColumn("slot", slot.cast("long")).select(*names, "size", "old_shard", "shard", "slot"), plan


def rewrite(resharded: DataFrame, plan: Transfers, path: str | None = None) -> str:
    """Writes the shards that the transfers change, one folder each, and returns the
    path. A shard that keeps all its blocks and gains none is not touched."""
    path = path or new_folder(resharded.sparkSession, "llm-shards")
    changed = resharded.where(F.col("shard").isin(plan.affected or [-1]))
    changed.withColumn("shard_no", F.col("shard")).write.partitionBy("shard_no").parquet(path)
    return path
