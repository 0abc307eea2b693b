"""Best-fit packing of token pieces into sequences by linear grouping.

1. Documents become pieces of at most ``capacity`` tokens.
2. Large lengths are put in order and cut into ``groups`` groups of equal cardinality;
   each group's lengths are rounded up to its longest. Over these few sizes the best
   configurations (which sizes share a sequence) come from the linear program, solved
   by column generation, and are rounded down; what is left is packed best-fit.
3. Each place of a configuration takes the next actual piece of its group, so a
   sequence holds actual lengths and has more room than the configuration says.
4. Small pieces go, longest first, into the sequence with the least room that
   suffices; new sequences are opened only when none has room.

Steps 2 to 4 work on the histogram of lengths alone: pieces of one length are
interchangeable, so the plan says "pieces i to j of length l go to sequences a to b
at offset o". Its size depends on ``capacity`` and ``groups``, not on the rows. The
executors number the pieces of each length and look their place up.

A null text is an empty document: one piece with the end id. Repeated rows are pieces of
their own. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw_texts, split_words, stored, without

CAPACITY = 4096
END_ID = 1
GROUPS = 64
SALTS = 64
LONGEST = 64
VOCABULARY = "word_bpe_49k.json"


_MAY_COMPOSE = re.compile(rb"[A-Z](?=[\x80-\xff])")
# The vocabulary takes runs of letters, single digits and runs of other marks, so it always cuts a
# mark from a letter before it; one that a character outside ASCII follows is left, since the
# two may be composed or form one run.
_MARK_AFTER_LETTER = re.compile(rb"(?<=[a-z])[!-/:-@\[-`{-~](?![\x80-\xff])")
# Words that neither normalising nor cutting changes: a-z and the small letters of U+00DF to U+00FF.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


# Byte-level vocabularies write a byte as the Latin-1 character of its number, but for bytes that
# are not printable there; these are the ones a plain word can hold. Fixed values.
_WRITTEN = {0x9F: "\u0141", 0xA0: "\u0142", 0xAD: "\u0143"}
_PACKERS = [Struct(f"<{n}I").pack for n in range(128)]


def lowered(raw: bytes) -> bytes:
    """A-Z lowered, but for letters that a character after them may be composed with."""
    if raw.isascii():
        return raw.lower()
    out = bytearray(raw.lower())
    for m in _MAY_COMPOSE.finditer(raw):
        out[m.start()] = raw[m.start()]
    return bytes(out)


class WordIds(dict[bytes, bytes]):
    """Ids of words by a vocabulary that never joins words across white space: each is encoded when
    first asked for and remembered. When ``limit`` words are known, those that do not come
    again before as many others are known are forgotten."""

    def __init__(self, path: str, limit: int = 250_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.limit = limit
        self.before: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            if _PLAIN.fullmatch(word):
                # The merges alone are what is left of the tokenizer's work.
                written = word.decode("latin-1")
                ids = [t.id for t in self.merges(written if word.isascii() else written.translate(_WRITTEN))]
            else:
                ids = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids
            found = _PACKERS[len(ids)](*ids) if len(ids) < 128 else np.array(ids, dtype="<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found

    @staticmethod
    def words(raw: bytes | None) -> list[bytes]:
        """The text cut at white space and before marks. The vocabulary lowers all letters itself, but
        composes before: what stands before a character outside ASCII stays. So do the
        marks of special tokens."""
        if not raw:
            return []
        return split_words(raw if b"<|" in raw else _MARK_AFTER_LETTER.sub(rb" \g<0>", lowered(raw)))

    def encode(self, raw: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        return b"".join([self[w] for w in self.words(raw)])


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(
    docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """The other columns with one row per piece: piece, start, length, ids_crc32 and,
    if asked for, ids (little-endian unsigned 32-bit)."""
    path = vocabulary or vocabulary_path()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.list_(pa.struct(fields + ([("ids", pa.binary())] if keep_ids else [])))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(texts: pa.Array) -> pa.Array:
        encode, out = encoder(path).encode, []
        for raw in raw_texts(texts):
            ids, pieces = encode(raw) + end, []
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                row = {"piece": k, "start": at // 4, "length": len(own) // 4, "ids_crc32": zlib.crc32(own)}
                pieces.append(row | {"ids": own} if keep_ids else row)
            out.append(pieces)
        return pa.array(out, kind)

    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    spark_type = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint" + (", ids: binary" if keep_ids else "") + ">>"
    own = [c for c in without(docs, text, "_piece", "_pieces", "sequence_id", "offset", *names).columns]
    cutter = F.arrow_udf(cut, spark_type).asNondeterministic()
    pieces = docs.select(*[F.col(f"`{c}`") for c in own], cutter(F.col(text).cast("string")).alias("_pieces"))
    return pieces.select(*[F.col(f"`{c}`") for c in own], F.explode("_pieces").alias("_piece")).select(
        *[F.col(f"`{c}`") for c in own], *[F.col(f"_piece.{n}").alias(n) for n in names]
    )


# --- the plan over the histogram of lengths ---------------------------------------


@dataclass
class Stretch:
    """``n`` sequences from ``first`` on, each filled up to ``used``."""

    first: int
    n: int
    used: int


class Plan:
    """Where the pieces of each length go: rows (length, first piece, pieces, first
    sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.taken = np.zeros(capacity + 1, dtype=np.int64)
        self.n_sequences = 0
        self.room: dict[int, list[Stretch]] = {}

    def put(self, length: int, stretch: Stretch) -> None:
        """One piece of this length into every sequence of the stretch."""
        self.rows.append((length, int(self.taken[length]), stretch.n, stretch.first, stretch.used))
        self.taken[length] += stretch.n
        stretch.used += length

    def open(self, n: int) -> Stretch:
        stretch = Stretch(self.n_sequences, n, 0)
        self.n_sequences += n
        return stretch

    def keep(self, stretch: Stretch) -> None:
        if stretch.n and stretch.used < self.capacity:
            self.room.setdefault(self.capacity - stretch.used, []).append(stretch)

    def lookup(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (length and first piece) with first pieces, sequences, offsets."""
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        return (rows[:, 0] << 48) + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity with the highest price."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for _ in range(capacity // int(sizes.min())):
        before = worth.copy()
        for i, s in enumerate(sizes):
            gain = before[: capacity + 1 - s] + prices[i]
            better = gain > worth[s:] + 1e-12
            worth[s:][better] = gain[better]
            last[s:][better] = i
        if np.array_equal(before, worth):
            break
    counts = np.zeros(len(sizes), dtype=np.int64)
    at = capacity
    while last[at] >= 0:
        counts[last[at]] += 1
        at -= sizes[last[at]]
    return float(counts @ prices), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """How many sequences get which configuration, by the linear program over
    configurations, rounded down. Covers at most the demand."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = best_configuration(sizes, np.maximum(prices, 0.0), capacity)
        if value <= 1 + 1e-7:
            break
        amounts = np.linalg.solve(basis, demand.astype(float))
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0.0) / np.where(step > 1e-9, step, 1.0), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    left, chosen = demand.astype(np.int64).copy(), []
    amounts = np.linalg.solve(basis, demand.astype(float))
    for j in np.argsort(-amounts):
        counts = np.rint(basis[:, j]).astype(np.int64)
        n = min([int(amounts[j] + 1e-6), *(left[counts > 0] // counts[counts > 0]).tolist()])
        if n > 0:
            chosen.append((n, counts))
            left -= n * counts
    return chosen


class Groups:
    """The large pieces from longest to shortest, cut into groups of equal cardinality
    and handed out group by group, each group in that order."""

    def __init__(self, counts: np.ndarray, groups: int):
        lengths = np.flatnonzero(counts)[::-1]
        total = int(counts.sum())
        k = max(1, min(groups, len(lengths)))
        ends = [total * (i + 1) // k for i in range(k)]
        self.runs: list[list[list[int]]] = [[] for _ in range(k)]
        at, g = 0, 0
        for length in lengths.tolist():
            n = int(counts[length])
            while n:
                take = min(n, ends[g] - at)
                if take:
                    self.runs[g].append([length, take])
                at, n = at + take, n - take
                g += at == ends[g] and g + 1 < k
        self.runs = [r for r in self.runs if r]
        self.sizes = np.array([r[0][0] for r in self.runs], dtype=np.int64)
        self.demand = np.array([sum(n for _, n in r) for r in self.runs], dtype=np.int64)

    def take(self, group: int, n: int) -> tuple[int, int]:
        """(length, count) of at most ``n`` next pieces of one length."""
        run = self.runs[group][0]
        n = min(n, run[1])
        run[1] -= n
        length = run[0]
        if not run[1]:
            self.runs[group].pop(0)
        self.demand[group] -= n
        return length, n


def fill(plan: Plan, groups: Groups, n: int, counts: np.ndarray) -> None:
    """``n`` new sequences by one configuration, with actual pieces."""
    stretches = [plan.open(n)]
    for group in np.flatnonzero(counts).tolist():
        for _ in range(int(counts[group])):
            after = []
            for s in stretches:
                first, left = s.first, s.n
                while left:
                    length, m = groups.take(group, left)
                    part = Stretch(first, m, s.used)
                    plan.put(length, part)
                    after.append(part)
                    first, left = first + m, left - m
            stretches = after
    for s in stretches:
        plan.keep(s)


def best_fit(plan: Plan, length: int, n: int) -> None:
    """``n`` pieces of one length, each into the sequence with the least room that
    suffices, else into new sequences."""
    while n:
        fits = [r for r in plan.room if r >= length]
        if not fits:
            each = plan.capacity // length
            for m, copies in ((n // each, each), (1, n % each)):
                if m and copies:
                    s = plan.open(m)
                    for _ in range(copies):
                        plan.put(length, s)
                    plan.keep(s)
            return
        room = min(fits)
        s = plan.room[room].pop()
        if not plan.room[room]:
            del plan.room[room]
        copies = max(1, min(room // length, n // s.n))
        if n < s.n:
            plan.keep(Stretch(s.first + n, s.n - n, s.used))
            s.n = n
        for _ in range(copies):
            plan.put(length, s)
        n -= copies * s.n
        plan.keep(s)


def grouped_plan(counts: np.ndarray, capacity: int, groups: int) -> Plan:
    """The plan by configurations of grouped lengths."""
    plan, counts = Plan(capacity), counts.astype(np.int64).copy()
    if counts[capacity]:
        plan.put(capacity, plan.open(int(counts[capacity])))
        counts[capacity] = 0
    small = capacity // 8
    large = counts.copy()
    large[: small + 1] = 0
    if large.any():
        grouped = Groups(large, groups)
        for n, config in configurations(grouped.sizes, grouped.demand, capacity):
            fill(plan, grouped, n, config)
        for g in range(len(grouped.runs)):
            while grouped.runs[g]:
                best_fit(plan, *grouped.take(g, int(grouped.demand[g])))
    for length in range(small, 0, -1):
        if counts[length]:
            best_fit(plan, length, int(counts[length]))
    return plan


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan for ``counts[length]`` pieces of each length. Rounding up costs most where few
    pieces or groups are; if best fit alone needs fewer sequences, that plan is taken."""
    plan, plain = grouped_plan(counts, capacity, groups), Plan(capacity)
    for length in np.flatnonzero(counts)[::-1].tolist():
        best_fit(plain, length, int(counts[length]))
    return plain if plain.n_sequences < plan.n_sequences else plan


# --- the packing ------------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``. Pieces of one length are
    numbered in salted parts, so that a length that many pieces share is no one task's."""
    spark = pieces.sparkSession
    located = pieces.withColumn("_file", F.col("_metadata.file_name")).withColumn("_row", F.col("_metadata.row_index"))
    salted = located.withColumn("_salt", F.pmod(F.xxhash64("_file", "_row"), F.lit(SALTS)))
    # At most capacity x SALTS rows, whatever the number of pieces.
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("length", "_salt", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[r.length] = r.n
    keys, firsts, sequences, offsets = plan_packing(counts, capacity, groups).lookup()
    table = spark.sparkContext.broadcast((keys, firsts, sequences, offsets))

    def look_up(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        keys, firsts, sequences, offsets = table.value
        length = lengths.to_numpy(zero_copy_only=False)
        number = numbers.to_numpy(zero_copy_only=False)
        row = np.searchsorted(keys, (length << 48) + number, side="right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(sequences[row] + number - firsts[row]), pa.array(offsets[row])], names=["sequence_id", "offset"]
        )

    in_part = Window.partitionBy("length", "_salt").orderBy("_file", "_row")
    numbered = salted.withColumn("_rank", F.row_number().over(in_part).cast("long") - 1)
    numbered = numbered.join(parts.select("length", "_salt", "_before"), ["length", "_salt"])
    found = F.arrow_udf(look_up, "struct<sequence_id: bigint, offset: bigint>").asNondeterministic()
    placed = numbered.withColumn("_place", found("length", F.col("_before") + F.col("_rank")))
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        F.col("_place.sequence_id").alias("sequence_id"),
        F.col("_place.offset").alias("offset"),
    )


def pack(
    docs: DataFrame,
    text: str = "text",
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    vocabulary: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """All documents as pieces with their sequence and offset."""
    own = without(docs, "_file", "_row", "_salt", "_rank", "_before", "_n", "_place", "_metadata")
    return place(stored(token_pieces(own, text, capacity, vocabulary, keep_ids), "pieces"), capacity, groups)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces packed with their ids: at most
    ``capacity`` tokens a row."""
    return (
        placed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_own"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", "n_tokens", F.expr("aggregate(_own, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
    )
