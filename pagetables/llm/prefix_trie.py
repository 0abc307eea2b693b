"""Trie of conversation prefixes, screened by a count-min sketch of prefix digests.

A node is a distinct sequence of first turns; conversations that begin with it are its members.

1. A turn becomes a 256-bit hash of its role and text and a count of words; texts are not
   shuffled. Turns are dealt in ranges of conversation and turn. The digest of a prefix is
   the sum of turn hash x factor^position in two 64-bit lanes, so ranges are summed apart and
   joined by what the ranges before them hold of the same conversation: a conversation
   of any length is no one task's.
2. If conversations borrow their first turns from another one, the digests follow by
   arithmetic: the borrowed prefix plus own turns moved to their new places.
3. A count-min sketch of all prefix digests (``ROWS`` x at most ``MOST_CELLS`` cells that count to
   two) is built by task, merged by slices and broadcast. It never counts too little, so an
   estimate of one proves that a prefix has one member: such rows become nodes where they are.
4. Only the others, possibly shared prefixes, are shuffled and grouped by digest, after
   partial aggregation. What the sketch could not prove single is found single there.
5. Sums over a subtree need no walk by levels. Each node is charged to its smallest member; running
   sums from the end of each conversation, in ranges again, give what lies at or below each
   of its prefixes, and adding these up by digest gives the subtree's sums.
6. Members that end at a node are sorted in ranges, joined into blocks of ids and hashed block after
   block, so a node at which very many end costs one hash state, not a list.

To the driver go the sketch (at most 8 MB) and one row for each range whose conversation goes
on in the next. Nothing grows with the group of a prefix.

Null roles and texts are empty, null turns first. Turns that tie in number stand in the order of
the hash of role and text; repeated rows are turns of their own. Rows without a conversation id
take no part. Empty texts are turns without words; very long ones are read once, in their
row. An empty table has no nodes. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOST_HEAD = 3
ROWS = 4
MOST_CELLS = 1 << 24
LEAST_CELLS = 1 << 15
SLICE = 1 << 15
IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "a", "b"]
WRAP = 1 << 64


class Powers:
    """Powers of a factor modulo 2^64, looked up by ten bits of the exponent at a time."""

    def __init__(self, factor: int):
        self.factor = factor
        self.tables = []
        for place in range(4):
            step, table, x = pow(factor, 1 << (10 * place), WRAP), [], 1
            for _ in range(1024):
                table.append(x)
                x = x * step % WRAP
            self.tables.append(np.array(table, dtype=np.uint64))

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        """Exponents from -3 to 2^40."""
        below = np.minimum(exponents, 0)
        e = (exponents - below).astype(np.uint64)
        out = self.tables[0][e & np.uint64(1023)]
        for place in range(1, 4):
            high = (e >> np.uint64(10 * place)) & np.uint64(1023)
            if high.any():
                out = out * self.tables[place][high]
        if below.any():
            inverse = np.array([pow(self.factor, -k, WRAP) for k in range(MOST_HEAD + 1)], dtype=np.uint64)
            out = out * inverse[-below]
        return out


POWERS: list[Powers] = []


def powers() -> list[Powers]:
    if not POWERS:
        POWERS.extend(Powers(f) for f in FACTORS)
    return POWERS


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def signed(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.view(np.int64), pa.int64())


class Running:
    """Sums within runs of equal keys, carried from batch to batch."""

    def __init__(self, lanes: int):
        self.key: int | None = None
        self.count = 0
        self.sums = [np.uint64(0)] * lanes

    def ranks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row in its run, and the index at which its run starts in the batch."""
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        ranks = np.arange(len(keys)) - starts + 1
        if self.key is not None and keys[0] == self.key:
            ranks[starts == 0] += self.count
        return ranks, starts

    def sum(self, keys: np.ndarray, starts: np.ndarray, ranks: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for lane, v in enumerate(values):
            total = np.cumsum(v, dtype=np.uint64)
            before = np.where(starts > 0, total[starts - 1], np.uint64(0))
            found = total - before
            if self.key is not None and keys[0] == self.key:
                found[starts == 0] += self.sums[lane]
            out.append(found)
        self.key, self.count = int(keys[-1]), int(ranks[-1])
        self.sums = [o[-1] for o in out]
        return out


def in_ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def carried(rows: DataFrame, *lanes: str) -> dict[tuple[int, int], list[tuple[int, ...]]]:
    """For conversations that begin in an earlier range: by range and conversation, what
    the earlier ranges hold of it, in their order. At most a row for each range."""
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).orderBy("part").collect()
    cut = {a.hi for a, b in zip(ends, ends[1:], strict=False) if a.hi == b.lo}
    if not cut:
        return {}
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in cut], "conv_id bigint"))
    last = F.max_by(F.struct("rank", *lanes), "rank").alias("last")
    found: dict[int, list] = {}
    for r in rows.join(wanted, "conv_id").groupBy("conv_id", "part").agg(last).orderBy("conv_id", "part").collect():
        found.setdefault(r.conv_id, []).append((r.part, tuple(r.last)))
    return {(part, c): [x for _, x in parts[:k]] for c, parts in found.items() for k, (part, _) in enumerate(parts) if k}


def turn_rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    both = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    return conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(both.cast("binary"), 256)).alias("hash"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    ).where("conv_id IS NOT NULL")


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, rank from 1, words, digest (a, b) of the prefix up to a turn and (pa, pb) of the one
    before it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), Running(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("conv_id").to_numpy(zero_copy_only=False)
            hashes = np.frombuffer(b"".join(batch.column("hash").to_pylist()), dtype="<u8").reshape(-1, 4)
            ranks, starts = state.ranks(keys)
            parts = [hashes[:, lane] * power(ranks) for lane, power in enumerate(powers())]
            now = state.sum(keys, starts, ranks, parts)
            lanes = [*now, *(n - p for n, p in zip(now, parts, strict=True))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(len(keys), part), pa.int32()), pa.array(ranks, pa.int64()), batch.column("words")]
                + [signed(x) for x in lanes],
                names=names,
            )

    names = ["conv_id", "part", "rank", "words", "a", "b", "pa", "pb"]
    schema = "conv_id bigint, part int, rank bigint, words bigint, a bigint, b bigint, pa bigint, pb bigint"
    # Rows alike in all of these may stand in any order; the number only deals them out.
    dealt = turns.withColumn("any", F.monotonically_increasing_id())
    rows = stored(in_ranges(dealt, "conv_id", F.col("turn").asc_nulls_first(), "hash", "any").mapInArrow(number, schema), "turns")
    before = {}
    for key, parts in carried(rows, "a", "b").items():
        rank, sums = 0, [0, 0]
        for count, *lanes in parts:
            sums = [(s + lane * pow(f, rank, WRAP)) % WRAP for s, lane, f in zip(sums, lanes, FACTORS, strict=True)]
            rank += count
        before[key] = (rank, *sums)
    if not before:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(before)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("conv_id").to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False).copy()
            lanes = [unsigned(batch.column(c)).copy() for c in names[4:]]
            for (part, key), (rank, *sums) in sent.value.items():
                here = (keys == key) & (parts == part)
                if here.any():
                    ranks[here] += rank
                    for lane in range(4):
                        factor = np.uint64(pow(FACTORS[lane % 2], rank, WRAP))
                        lanes[lane][here] = lanes[lane][here] * factor + np.uint64(sums[lane % 2])
            columns = [batch.column("conv_id"), batch.column("part"), pa.array(ranks, pa.int64()), batch.column("words")]
            yield pa.RecordBatch.from_arrays(columns + [signed(x) for x in lanes], names=names)

    return stored(rows.mapInArrow(resolve, schema), "turns")


def prefixes(conversations: DataFrame, base: Column | None, head: Column | None, columns: tuple[str, str, str, str]) -> tuple[DataFrame, DataFrame]:
    """(conversations, prefixes): conv_id and n_turns; conv_id, depth, digest (a, b), that of the
    parent (pa, pb), words of the last turn, and whether the conversation ends there."""
    turns = ranked(turn_rows(conversations, *columns))
    nothing = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words"))
    firsts = [F.max(F.when(F.col("rank") == i, F.struct("a", "b", "words"))).alias(f"t{i}") for i in range(1, MOST_HEAD + 1)]
    heads = stored(turns.groupBy("conv_id").agg(F.max("rank").alias("n"), *firsts), "heads")
    borrowed = F.array(nothing, *[F.coalesce(f"t{i}", nothing) for i in range(1, MOST_HEAD + 1)])
    heads = heads.select("conv_id", "n", borrowed.alias("own"))
    if base is None or head is None:
        base, head = F.col("conv_id"), F.lit(0)
    convs = heads.withColumns({"h": head.cast("int"), "base": base.cast("long")})
    lent = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("lent_n"), F.col("own").alias("lent"))
    convs = convs.join(lent, "base", "left").withColumn("m", F.least("h", F.coalesce("lent_n", F.lit(0))).cast("int"))
    convs = convs.withColumn("n_turns", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    lent_at = lambda i: F.coalesce(F.col("lent")[i], nothing)
    convs = convs.select(
        "conv_id", "n_turns", "h", "m", "lent", lent_at(F.col("m")).alias("top"), F.col("own")[F.least(F.col("h"), F.col("n").cast("int"))].alias("cut")
    )
    convs = stored(convs, "conversations")
    ends = (F.col("depth") == F.col("n_turns")).alias("ends")
    at = convs.where("m > 0").withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("m"))))
    at = at.withColumns({"x": F.col("lent")[F.col("depth")], "p": F.col("lent")[F.col("depth") - 1]})
    lent_rows = at.select("conv_id", F.col("depth").cast("long").alias("depth"), "x.a", "x.b", F.col("p.a").alias("pa"), F.col("p.b").alias("pb"), "x.words", ends)

    def moved(a: pa.Array, b: pa.Array, p_a: pa.Array, p_b: pa.Array, top: pa.Array, cut: pa.Array, by: pa.Array) -> pa.Array:
        shift = by.to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for lanes in ((a, b), (p_a, p_b)):
            for name, lane, power in zip("ab", lanes, powers(), strict=True):
                out.append(signed(unsigned(top.field(name)) + (unsigned(lane) - unsigned(cut.field(name))) * power(shift)))
        return pa.StructArray.from_arrays(out, names=["a", "b", "pa", "pb"])

    digest = F.arrow_udf(moved, "struct<a: bigint, b: bigint, pa: bigint, pb: bigint>")
    own = turns.join(convs.select("conv_id", "n_turns", "h", "m", "top", "cut"), "conv_id").where("rank > h")
    own = own.withColumn("d", digest("a", "b", "pa", "pb", "top", "cut", (F.col("m") - F.col("h")).cast("long")))
    own = own.withColumn("depth", F.col("rank") - F.col("h") + F.col("m"))
    own_rows = own.select("conv_id", "depth", "d.a", "d.b", "d.pa", "d.pb", "words", ends)
    return convs.select("conv_id", "n_turns"), stored(lent_rows.union(own_rows), "prefixes")


class Sketch:
    """Count-min sketch of digests that counts to two."""

    def __init__(self, bits: int, many: np.ndarray | None = None):
        self.bits = bits
        self.many = many

    def cells(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        mixed = a + depth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        rows = [mixed + np.uint64(k) * (b | np.uint64(1)) for k in range(ROWS)]
        # Multiplied so that the high bits, which name the cell, depend on all bits.
        return [((r * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.bits)).astype(np.int64) + (k << self.bits) for k, r in enumerate(rows)]

    def fill(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS << self.bits, dtype=np.uint8)
        for batch in batches:
            if batch.num_rows:
                for cells in self.cells(*(unsigned(batch.column(c)) for c in KEY)):
                    cell, n = np.unique(cells, return_counts=True)
                    counts[cell] = np.minimum(counts[cell] + np.minimum(n, 2), 2)
        for part, slice_ in enumerate(counts.reshape(-1, SLICE)):
            if slice_.any():
                row = {"slice": part, "once": np.packbits(slice_ > 0).tobytes(), "many": np.packbits(slice_ > 1).tobytes()}
                yield pa.RecordBatch.from_pylist([row], SLICES)

    @staticmethod
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                once, many = (np.frombuffer(r[c], dtype=np.uint8) for c in ("once", "many"))
                if r["slice"] in found:
                    before = found[r["slice"]]
                    found[r["slice"]] = [before[0] | once, before[1] | many | (before[0] & once)]
                else:
                    found[r["slice"]] = [once, many]
        for part, (once, many) in found.items():
            yield pa.RecordBatch.from_pylist([{"slice": part, "once": once.tobytes(), "many": many.tobytes()}], SLICES)

    def single(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the estimate for each digest, all of which were counted, is one."""
        out = np.zeros(len(a), dtype=bool)
        for cells in self.cells(depth, a, b):
            out |= (self.many[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 0
        return out


SLICES = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("many", pa.binary())])


def sketch_of(rows: DataFrame, most_cells: int = MOST_CELLS) -> Sketch:
    """The sketch of all digests: about four cells a row of the sketch for each prefix, up to the bound."""
    wanted = max(LEAST_CELLS, min(most_cells, 4 * rows.count()))
    sketch = Sketch((wanted - 1).bit_length())
    parts = rows.select(*KEY).mapInArrow(sketch.fill, "slice int, once binary, many binary")
    merged = parts.repartition("slice").mapInArrow(Sketch.merge, "slice int, once binary, many binary")
    many = np.zeros((ROWS << sketch.bits) // 8, dtype=np.uint8)
    for r in merged.select("slice", "many").collect():
        many[r.slice * SLICE // 8 : (r.slice + 1) * SLICE // 8] = np.frombuffer(r.many, dtype=np.uint8)
    return Sketch(sketch.bits, many)


def screened(rows: DataFrame, sketch: Sketch) -> DataFrame:
    """Prefixes with their kind: 0 may be shared, 1 is single under a parent that may be shared, 2 is
    single under one that is single too or under the root."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def kind(depth: pa.Array, a: pa.Array, b: pa.Array, p_a: pa.Array, p_b: pa.Array) -> pa.Array:
        level = unsigned(depth)
        single = sent.value.single(level, unsigned(a), unsigned(b))
        parent = (level == 1) | sent.value.single(level - np.uint64(1), unsigned(p_a), unsigned(p_b))
        return pa.array(np.where(single, np.where(parent, 2, 1), 0), pa.int32())

    return stored(rows.withColumn("kind", F.arrow_udf(kind, "int")(*KEY, "pa", "pb")), "screened", "kind")


def below(shared: DataFrame, charges: DataFrame) -> DataFrame:
    """Digests of the shared prefixes with what is charged to their conversations at or below them:
    saved and leaves. One row a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), Running(2)
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("conv_id").to_numpy(zero_copy_only=False)
                ranks, starts = state.ranks(keys)
                sums = state.sum(keys, starts, ranks, [unsigned(batch.column(c)) for c in ("saved", "leaves")])
                own = [batch.column(c) for c in ("conv_id", *KEY, "charge")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.full(len(keys), part), pa.int32()), pa.array(ranks, pa.int64()), *(signed(s) for s in sums)], names=names
                )

    names = ["conv_id", *KEY, "charge", "part", "rank", "saved", "leaves"]
    schema = "conv_id bigint, depth bigint, a bigint, b bigint, charge int, part int, rank bigint, saved bigint, leaves bigint"
    none = F.lit(0).cast("long")
    both = shared.select("conv_id", *KEY, F.lit(1).alias("charge"), none.alias("saved"), none.alias("leaves")).union(
        charges.select("conv_id", "depth", none, none, F.lit(0), "saved", "leaves")
    )
    # Charges of a prefix stand before it.
    rows = stored(in_ranges(both, "conv_id", F.col("depth").desc(), "charge").mapInArrow(run, schema), "below")
    before = [(p, c, sum(x[1] for x in parts), sum(x[2] for x in parts)) for (p, c), parts in carried(rows, "saved", "leaves").items()]
    rows = rows.where("charge = 1")
    if before:
        more = rows.sparkSession.createDataFrame(before, "part int, conv_id bigint, saved0 bigint, leaves0 bigint")
        rows = rows.join(F.broadcast(more), ["part", "conv_id"], "left")
        rows = rows.withColumns({c: F.col(c) + F.coalesce(f"{c}0", F.lit(0)) for c in ("saved", "leaves")})
    return rows.select(*KEY, "saved", "leaves")


def end_digests(ends: DataFrame) -> DataFrame:
    """By node, the hash of the ids that end there: ascending, joined by commas."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()) for k in key] + [pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=[*KEY, "first", "ids"]
            )

        for batch in batches:
            for *now, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv_id")), strict=True):
                if now != key or len(ids) == IDS:
                    if ids:
                        yield done()
                    key, ids = now, []
                ids.append(c)
        if ids:
            yield done()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        schema = pa.schema([*((k, pa.int64()) for k in KEY), ("sha", pa.string())])
        for batch in batches:
            for *now, text in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids")), strict=True):
                if now == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    out.append(dict(zip(schema.names, [*key, state.hexdigest()], strict=True)))
                key, state = now, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*key, state.hexdigest()], strict=True))], schema)

    keys = "depth bigint, a bigint, b bigint"
    joined = in_ranges(ends.select(*KEY, "conv_id"), *KEY, "conv_id").mapInArrow(blocks, f"{keys}, first bigint, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, f"{keys}, sha string")


def build(
    conversations: DataFrame,
    base: Column | None = None,
    head: Column | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. With ``base`` and ``head``, columns over conv_id, a conversation's
    first ``head`` turns (at most ``MOST_HEAD``) are those of conversation ``base``."""
    convs, rows = prefixes(conversations, base, head, (conv_id, turn, role, text))
    members = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    kinds = screened(rows, sketch_of(rows, most_cells))
    shared, alone = kinds.where("kind = 0"), kinds.where("kind > 0")
    nodes = shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        F.count_if("ends").alias("n_ends"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
    )
    nodes = nodes.withColumns(
        {"saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (F.col("n_ends") == F.col("n_convs")).cast("long")}
    )
    nodes = stored(nodes, "nodes")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    charges = nodes.select("conv_id", "depth", "saved", "leaves").union(alone.where("ends").select("conv_id", "depth", none, one))
    children = nodes.select("depth", "pa", "pb").union(alone.where("kind = 1").select("depth", "pa", "pb")).where("depth > 1")
    ended = shared.where("ends").select(*KEY, "conv_id").union(convs.where("n_turns = 0").select(none, none, none, "conv_id"))
    digests = stored(end_digests(ended), "ends")

    # Everything known of a shared node in one grouping: null or zero where a source does not know.
    def facts(source: DataFrame, **known: Column | str) -> DataFrame:
        kinds = {"conv_id": "long", "n_convs": "long", "pa": "long", "pb": "long", "children": "long", "leaves": "long", "saved": "long", "sha": "string"}
        return source.select(*KEY, *[(F.col(v) if isinstance(v := known.get(c, F.lit(None)), str) else v).cast(t).alias(c) for c, t in kinds.items()])

    known = facts(nodes, conv_id="conv_id", n_convs="n_convs", pa="pa", pb="pb")
    known = known.union(facts(below(shared, charges), leaves="leaves", saved="saved"))
    known = known.union(
        facts(children.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")), children=one)
    )
    known = known.union(facts(digests, sha="sha"))
    whole = known.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "pa", "pb", "sha")],
        *[F.coalesce(F.sum(c), none).alias(c) for c in ("children", "leaves", "saved")],
    )
    whole = whole.where("conv_id IS NOT NULL")
    # Shared nodes and the first single nodes below them look their parents up.
    sha = F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    single = lambda kind: alone.where(F.col("kind") == kind).select(
        "conv_id", "depth", "pa", "pb", one.alias("n_convs"), (~F.col("ends")).cast("long").alias("children"), one.alias("leaves"), none.alias("saved"), sha.alias("sha")
    )
    names = ["conv_id", "depth", "pa", "pb", "n_convs", "children", "leaves", "saved", "sha"]
    asking = whole.select(*names).union(single(1).select(*names))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
    answered = asking.join(parents, ["depth", "pa", "pb"], "left").select(*names, F.coalesce("parent", "conv_id").alias("parent"))
    every = answered.union(single(2).select(*names, F.col("conv_id")))
    root = F.lit(members.least).cast("long")
    every = every.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 1, root).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )
    # The root: sums over all that is charged, one row.
    top = charges.select(none.alias("children"), "leaves", "saved").union(
        nodes.where("depth = 1").select(one, none, none).union(alone.where("depth = 1").select(one, none, none))
    )
    top = top.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("children", "leaves", "saved")])
    ends = digests.where("depth = 0").agg(F.max("sha").alias("sha"))
    top = top.join(F.broadcast(ends), F.lit(True)).where(F.lit(members.n > 0)).select(
        root.alias("conv_id"),
        none.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(members.n).cast("long").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.when(F.col("children") == 0, one).otherwise(F.col("leaves")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return every.union(top)
