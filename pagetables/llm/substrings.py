"""Removing passages that other documents hold too, by suffix automata.

Two operators share the automaton.

``remove_reference_spans`` streams documents past a reference of bounded size (a
benchmark, say). The reference is cut into shards, an automaton of each shard is
broadcast, and every span of ``width`` or more words whose matching statistics say that
it stands in the reference is removed.

``remove_repeats`` takes the corpus as its own reference, which has no size bound, so
its automata cannot be broadcast: they are built where their part of the corpus is.

1. Every window of ``width`` words has an anchor, the smallest hash among its short
   word sequences. Windows with the same words have the same anchor. Consecutive windows
   with one anchor make a run; only the anchors' hashes are shuffled.
2. Anchors that only one document has are done. So are anchors whose runs are all the
   same words: the smallest id among them owns every window.
3. The other runs, each distinct one once, are the reference. They are dealt into
   shards by anchor; an automaton of the shard's passages knows for every state the
   smallest id that has it. Each passage is streamed past the automaton, and where its
   matching statistics reach ``width`` words the state says who has the window first.
4. An anchor with more words than fit a shard is not gathered: its passages get longer
   anchors, which tell their surroundings apart, and go through steps 2 and 3 again,
   in the end with anchors as long as a window. A passage that stands in every
   document so becomes one run.
5. A document loses the words of each window that a smaller id has.

Words are compared as bytes. Windows are judged on the input. Null and empty texts and
texts shorter than ``width`` words lose nothing, nor do documents without an id, which
also are nobody's reference. Rows with one id do not take from each other. Input
columns named like output columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, raw_texts, split_words, stored, without

WIDTH = 50
ANCHOR_WORDS = 8
SHARD_WORDS = 50_000
MAX_REFERENCE_WORDS = 200_000
NOBODY = (1 << 63) - 1


class Automaton:
    """Suffix automaton of passages. A state stands for the word sequences that end at
    the same places; ``owner`` is the smallest id among the passages that have them."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [NOBODY]

    def _state(self, length: int, link: int, out: dict[bytes, int], owner: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state of its own for what is reached from ``p`` and is shorter than ``q``."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.owner[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: Iterable[bytes], owner: int) -> None:
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:
                # An earlier passage has it already.
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(length[last] + 1, 0, {}, NOBODY)
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if owner < owners[last]:
                owners[last] = owner

    def settle(self) -> None:
        """Owners of longer sequences own their endings too."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.owner[v] < self.owner[up]:
                self.owner[up] = self.owner[v]

    def statistics(self, words: Iterable[bytes], width: int) -> tuple[list[int], list[int]]:
        """At each word the length of the longest match that ends there, and the owner
        of the last ``width`` words (NOBODY if the match is shorter)."""
        nexts, link, length = self.next, self.link, self.length
        lengths, owners, v, n = [], [], 0, 0
        for word in words:
            while v and word not in nexts[v]:
                v = link[v]
                n = length[v]
            if word in nexts[v]:
                v, n = nexts[v][word], n + 1
            lengths.append(n)
            if n >= width:
                u = v
                while length[link[u]] >= width:
                    u = link[u]
                owners.append(self.owner[u])
            else:
                owners.append(NOBODY)
        return lengths, owners


# --- anchors ----------------------------------------------------------------------

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def runs_of(words: list[bytes], width: int, anchor_words: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the passage, first window, windows) of each run."""
    n = len(words) - width + 1
    if n < 1:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    m = len(words) - anchor_words + 1
    short = np.zeros(m, dtype=np.uint64)
    for k in range(anchor_words):
        short = short * _MULTIPLIER + hashes[k : k + m]
    short = (short ^ (short >> np.uint64(29))) * _MULTIPLIER
    short ^= short >> np.uint64(32)
    choices = width - anchor_words + 1
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(short, choices).argmin(axis=1)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    counts = np.diff(np.concatenate([starts, [n]]))
    spans = zip(starts.tolist(), (starts + counts + width - 1).tolist())
    passages = np.fromiter((digest(hashes[a:b].tobytes()) for a, b in spans), np.uint64, len(starts))
    return short[at[starts]].view(np.int64), passages.view(np.int64), starts, counts


def _runs(docs: DataFrame, width: int, anchor_words: int) -> DataFrame:
    """(doc_id, text_key, anchor, run, start, n) of all documents with an id."""
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("run", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))

    def of(texts: pa.Array) -> pa.Array:
        found = [runs_of(split_words(r), width, anchor_words) for r in raw_texts(texts)]
        offsets = np.cumsum([0] + [len(f[0]) for f in found])
        columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(4)]
        rows = pa.StructArray.from_arrays(
            [pa.array(c).cast(t.type) for c, t in zip(columns, kind.value_type)], fields=list(kind.value_type)
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows).cast(kind)

    finder = F.arrow_udf(of, "array<struct<anchor: bigint, run: bigint, start: int, n: int>>").asNondeterministic()
    found = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), finder("text").alias("r"))
    return found.select("doc_id", "text_key", F.explode("r").alias("r")).select("doc_id", "text_key", "r.*")


# --- shards -----------------------------------------------------------------------


def _owners_in_shard(width: int):
    """Applied to one shard (anchor, run, owner, passage): stretches of each run's
    windows that one id owns."""
    stretch = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32()), ("owner", pa.int64())]))

    def stretches(owners: list[int]) -> list[dict]:
        out = []
        for i, owner in enumerate(owners):
            if out and out[-1]["owner"] == owner:
                out[-1]["n"] += 1
            else:
                out.append({"i": i, "n": 1, "owner": owner})
        return out

    def of(shard: pa.Table) -> pa.Table:
        passages = [p.split(b"\x20") for p in shard["passage"].cast(pa.binary()).to_pylist()]
        automaton = Automaton()
        for words, owner in zip(passages, shard["owner"].to_pylist()):
            automaton.add(words, owner)
        automaton.settle()
        owners = [stretches(automaton.statistics(words, width)[1][width - 1 :]) for words in passages]
        return pa.table({"anchor": shard["anchor"], "run": shard["run"], "owners": pa.array(owners, stretch)})

    return of


def _window_owners(units: DataFrame, n_words: int, width: int, shard_words: int) -> DataFrame:
    """(anchor, run, i, n, owner): stretches of windows of units (anchor, run, owner, n,
    passage), by automata of shards that hold whole anchors."""
    shards = 1 + n_words // shard_words
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = (
        dealt.select("shard", "anchor", "run", "owner", "passage")
        .groupBy("shard")
        .applyInArrow(_owners_in_shard(width), "anchor bigint, run bigint, owners array<struct<i: int, n: int, owner: bigint>>")
    )
    return found.select("anchor", "run", F.explode("owners").alias("o")).select("anchor", "run", "o.*")


def _sub_runs(width: int, anchor_words: int):
    """UDF over passages: their runs by longer anchors, with the words of each."""
    kind = pa.list_(
        pa.struct(
            [("anchor", pa.int64()), ("run", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("passage", pa.string())]
        )
    )

    def of(passages: pa.Array) -> pa.Array:
        out = []
        for raw in raw_texts(passages):
            words = raw.split(b"\x20")
            found = zip(*(x.tolist() for x in runs_of(words, width, anchor_words)))
            out.append(
                [
                    {"anchor": a, "run": r, "start": s, "n": n, "passage": b" ".join(words[s : s + n + width - 1]).decode()}
                    for a, r, s, n in found
                ]
            )
        return pa.array(out, kind)

    spark_type = "array<struct<anchor: bigint, run: bigint, start: int, n: int, passage: string>>"
    return F.arrow_udf(of, spark_type).asNondeterministic()


def _owned(units: DataFrame, width: int, shard_words: int, anchor_words: int) -> DataFrame:
    """(anchor, run, i, n, owner): who has the windows of each distinct run first. The
    units (anchor, run, owner, n, passage) are stored and have anchors of
    ``anchor_words`` words."""
    words = F.col("n") + width - 1
    sizes = units.groupBy("anchor").agg(F.sum(words).alias("words"), F.count("*").alias("runs"))
    large = stored(sizes.where((F.col("words") > shard_words) & (F.col("runs") > 1)).select("anchor"), "large")
    total = units.agg(F.sum(words)).first()[0] or 0
    if anchor_words == width or large.isEmpty():
        return _window_owners(units, total, width, shard_words)
    small = _window_owners(units.join(large, "anchor", "left_anti"), total, width, shard_words)

    longer = min(width, anchor_words + max(1, width // 3))
    sub = units.join(large, "anchor").select("anchor", "run", "owner", _sub_runs(width, longer)("passage").alias("s"))
    sub = sub.select("anchor", "run", "owner", F.explode("s").alias("s")).select(
        "anchor", "run", "owner", F.xxhash64("anchor", "s.anchor").alias("sub"), F.col("s.run").alias("sub_run"), "s.start", "s.n", "s.passage"
    )
    sub = stored(sub, "sub-runs")
    groups = sub.groupBy("sub").agg(
        F.min("owner").alias("first_id"), (F.min("sub_run") != F.max("sub_run")).alias("varied")
    )
    joined = sub.join(stored(groups, "sub-anchors"), "sub")
    alike = joined.where("not varied").select("anchor", "run", F.col("start").alias("i"), "n", F.col("first_id").alias("owner"))
    varied = joined.where("varied")
    inner = varied.groupBy("sub", "sub_run").agg(F.min("owner").alias("owner"), F.min("n").alias("n"), F.min("passage").alias("passage"))
    inner = stored(inner.select(F.col("sub").alias("anchor"), F.col("sub_run").alias("run"), "owner", "n", "passage"), "units")
    found = _owned(inner, width, shard_words, longer).select(
        F.col("anchor").alias("sub"), F.col("run").alias("sub_run"), "i", F.col("n").alias("m"), F.col("owner").alias("first_owner")
    )
    parts = varied.select("anchor", "run", "sub", "sub_run", "start").join(found, ["sub", "sub_run"])
    parts = parts.select("anchor", "run", (F.col("start") + F.col("i")).alias("i"), F.col("m").alias("n"), F.col("first_owner").alias("owner"))
    return small.unionByName(alike).unionByName(parts)


def _passages(docs: DataFrame, units: DataFrame, width: int) -> DataFrame:
    """Units (anchor, run, owner, n, text_key, start) with their words, joined by one
    blank; the words come from the owner's text."""
    wanted = units.groupBy("owner", "text_key").agg(F.collect_list(F.struct("anchor", "run", "start", "n")).alias("u"))
    kind = pa.list_(pa.string())

    def of(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for raw, s, e in zip(raw_texts(texts), starts.to_pylist(), ends.to_pylist()):
            words = split_words(raw)
            out.append([b" ".join(words[a:b]).decode() for a, b in zip(s, e)])
        return pa.array(out, kind)

    cutter = F.arrow_udf(of, "array<string>").asNondeterministic()
    there = docs.select(F.col("doc_id").alias("owner"), F.xxhash64("text").alias("text_key"), "text")
    found = there.join(wanted, ["owner", "text_key"]).select(
        "owner", "u", cutter("text", F.col("u.start"), F.expr(f"transform(u, x -> x.start + x.n + {width - 1})")).alias("p")
    )
    return found.select("owner", F.explode(F.arrays_zip("u", "p")).alias("x")).select(
        "x.u.anchor", "x.u.run", "owner", "x.u.n", F.col("x.p").alias("passage")
    )


def repeated_windows(docs: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text_key, start, n): stretches of windows that begin in a document with
    a smaller id too. ``docs`` has doc_id and text."""
    anchor_words = min(ANCHOR_WORDS, width)
    runs = _runs(docs, width, anchor_words)
    anchors = runs.groupBy("anchor").agg(
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        (F.min("run") != F.max("run")).alias("varied"),
    )
    # Stored, so that both sides of the join are shuffled and a frequent anchor's can be split.
    shared = stored(anchors.where("first_id < last_id").select("anchor", "first_id", "varied"), "anchors")
    hits = stored(runs.join(shared, "anchor"), "hits")
    alike = hits.where("not varied and first_id < doc_id").select("doc_id", "text_key", "start", "n")

    varied = hits.where("varied")
    first = varied.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "text_key", "start", "n")).alias("r"))
    units = first.select("anchor", "run", F.col("r.doc_id").alias("owner"), "r.text_key", "r.start", "r.n")
    passages = stored(_passages(docs, units, width).dropDuplicates(["anchor", "run"]), "passages")
    owned = _owned(passages, width, shard_words, anchor_words).withColumnsRenamed({"n": "m"})
    taken = varied.select("doc_id", "text_key", "anchor", "run", "start").join(owned, ["anchor", "run"])
    taken = taken.where("owner < doc_id").select("doc_id", "text_key", (F.col("start") + F.col("i")).alias("start"), F.col("m").alias("n"))
    return alike.unionByName(taken)


def _cut(width: int):
    """Kept words and their number; the words are joined by one blank."""

    def of(texts: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        rows = []
        for raw, s, n in zip(raw_texts(texts), starts.to_pylist(), counts.to_pylist()):
            words = split_words(raw)
            kept = words
            if s:
                windows = np.concatenate([np.arange(a, a + b) for a, b in zip(s, n)])
                gone = covered(np.unique(windows), width, len(words))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            text = b" ".join(kept)
            rows.append(
                {
                    "n_words": len(words),
                    "n_removed": len(words) - len(kept),
                    "kept_sha256": hashlib.sha256(text).hexdigest(),
                    "text": text.decode() if len(kept) < len(words) else None,
                }
            )
        kind = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())]
        return pa.array(rows, pa.struct(kind))

    return F.arrow_udf(of, "struct<n_words: bigint, n_removed: bigint, kept_sha256: string, text: string>").asNondeterministic()


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The documents with n_words, n_removed and kept_sha256 (of the kept words joined
    by one blank). ``text`` is the kept words joined by one blank where words were
    removed, and untouched elsewhere."""
    names = ["n_words", "n_removed", "kept_sha256"]
    own = without(docs, "_id", "_key", "_starts", "_counts", "_cut", *names)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    spans = (
        repeated_windows(plain, width, shard_words)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "n")).alias("s"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("s.start").alias("_starts"), F.col("s.n").alias("_counts"))
    )
    cut = own.withColumn("_key", F.xxhash64(F.col(text).cast("string")))
    cut = cut.join(spans, (F.col(doc_id) == F.col("_id")) & (cut["_key"] == spans["_key"]), "left")
    cut = cut.withColumn("_cut", _cut(width)(F.col(text).cast("string"), "_starts", "_counts"))
    kept = [F.coalesce("_cut.text", f"`{c}`").alias(c) if c == text else F.col(f"`{c}`") for c in own.columns]
    return cut.select(*kept, *[F.col(f"_cut.{n}").alias(n) for n in names])


# --- a reference of bounded size --------------------------------------------------


def remove_reference_spans(
    docs: DataFrame,
    reference: DataFrame,
    text: str = "text",
    reference_text: str = "text",
    width: int = WIDTH,
    shard_words: int = SHARD_WORDS,
    max_reference_words: int = MAX_REFERENCE_WORDS,
) -> DataFrame:
    """The documents without their maximal spans of ``width`` or more words that stand
    in the reference, with n_words, n_removed and kept_sha256.

    The automata go to every executor, so the reference must not have more than
    ``max_reference_words`` words; a larger one raises ValueError."""
    texts = reference.select(F.col(reference_text).cast("string").alias("t"))
    size = texts.agg(F.sum(F.size(F.split("t", r"[\x20\x09-\x0D]+"))).alias("n")).first().n or 0
    if size > max_reference_words:
        raise ValueError(f"the reference has {size} words, more than {max_reference_words}")
    automata, words = [Automaton()], 0
    for row in texts.toLocalIterator():
        own = split_words((row.t or "").encode())
        if words + len(own) > shard_words and words:
            automata.append(Automaton())
            words = 0
        automata[-1].add(own, 0)
        words += len(own)
    shards = docs.sparkSession.sparkContext.broadcast(automata)

    def windows(texts: pa.Array) -> pa.Array:
        out = []
        for raw in raw_texts(texts):
            own, starts = split_words(raw), set()
            for automaton in shards.value:
                lengths, _ = automaton.statistics(own, width)
                starts.update(i - width + 1 for i, n in enumerate(lengths) if n >= width)
            out.append(sorted(starts))
        return pa.array(out, pa.list_(pa.int32()))

    names = ["n_words", "n_removed", "kept_sha256"]
    own = without(docs, "_starts", "_cut", *names)
    found = own.withColumn("_starts", F.arrow_udf(windows, "array<int>").asNondeterministic()(F.col(text).cast("string")))
    ones = F.transform("_starts", lambda x: F.lit(1))
    found = found.withColumn("_cut", _cut(width)(F.col(text).cast("string"), "_starts", ones))
    kept = [F.coalesce("_cut.text", f"`{c}`").alias(c) if c == text else F.col(f"`{c}`") for c in own.columns]
    return found.select(*kept, *[F.col(f"_cut.{n}").alias(n) for n in names])
