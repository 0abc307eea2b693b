"""Near duplicates by SimHash with a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of the hashes of its word
shingles have it. Documents whose fingerprints differ in at most ``limit`` bits are
linked; a class is what links connect.

The index is a hierarchy of nodes, each a mask and the bit pattern its fingerprints
share under that mask.

* Upper nodes are spread over the cluster. The 64 bits are cut into ``limit + 1``
  parts; fingerprints within the limit agree in one part at least, so every distinct
  fingerprint is filed under the pattern of each part. A node with more than ``LEAF``
  fingerprints is cut again the same way in the bits its mask leaves open. After
  ``DEPTH`` cuts few bits are open, so every node is small without any cap.
* Inside a node the fingerprints are sorted by their rank in Gray order, where
  neighbours differ in few bits. Consecutive ones are factored into a tree whose nodes
  hold the bits all of theirs share. A search adds up the differences from the root
  down, each bit counted at the highest node that holds it, and leaves a whole group
  as soon as the sum exceeds the limit.

A node reports a spanning forest of its links, never all pairs. Fingerprints are made
distinct first, so copies cost one row.

Null and empty texts have fingerprint zero and are linked like any other. A document
without an id belongs to its class but never names it; a class of such documents has a
null ``component_id``. Input columns named like output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import raw_texts, split_words, stored, without
from .components import connected_components

SEED = 42
SHINGLE = 3
LIMIT = 2
LEAF = 4096
DEPTH = 4
FAN = 8
BITS = 64
_ALL = (1 << BITS) - 1


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other hashes for every further table, made from the first ones."""
    if not table:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(table * 0x9E3779B97F4A7C15 & _ALL)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(raw: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles of ``width`` words, A-Z lowered; a text of fewer
    words is one shingle."""
    words = split_words(raw.lower()) if raw else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(width, len(words)) - 1
    spans = zip(starts[:n].tolist(), ends[last : last + n].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n)


def fingerprint(raw: bytes | None, width: int = SHINGLE, tables: int = 1) -> np.ndarray:
    """SimHash of the text's shingles of ``width`` words, A-Z lowered, for each table."""
    hashes = shingle_hashes(raw, width)
    n = len(hashes)
    if not n:
        return np.zeros(tables, dtype=np.uint64)
    counts = np.zeros((tables, BITS), dtype=np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        for t in range(tables):
            bits = _mixed(part, t).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts[t] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(text: Column, width: int = SHINGLE, tables: int = 1) -> Column:
    """The fingerprints as an array of signed longs, one for each table."""

    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(r, width, tables).view(np.int64) for r in raw_texts(texts)]
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * tables, pa.int32()), pa.array(flat))

    return F.arrow_udf(of, "array<bigint>").asNondeterministic()(text.cast("string"))


# --- the index inside a node ------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


class GrayIndex:
    """Tree over codes in Gray order. ``levels`` go from the codes up to the roots, each
    with the masks and the patterns of its nodes."""

    def __init__(self, codes: np.ndarray):
        masks, patterns = np.full(len(codes), _ALL, dtype=np.uint64), codes
        self.levels = [(masks, patterns)]
        while len(codes) > FAN and len(patterns) > FAN:
            heads = np.arange(0, len(patterns), FAN)
            first = np.repeat(patterns[heads], FAN)[: len(patterns)]
            masks = np.bitwise_and.reduceat(masks, heads) & ~np.bitwise_or.reduceat(patterns ^ first, heads)
            patterns = patterns[heads] & masks
            self.levels.append((masks, patterns))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) places whose codes differ in at most ``limit`` bits."""
        masks, patterns = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(patterns))
        node = np.tile(np.arange(len(patterns)), len(queries))
        apart = np.bitwise_count((queries[q] ^ patterns[node]) & masks[node])
        for level in range(len(self.levels) - 1, -1, -1):
            near = apart <= limit
            q, node, apart = q[near], node[near], apart[near]
            if not level:
                break
            above = self.levels[level][0]
            masks, patterns = self.levels[level - 1]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = child < len(patterns)
            parent, child = np.repeat(node, FAN)[there], child[there]
            q, apart = np.repeat(q, FAN)[there], np.repeat(apart, FAN)[there]
            new = masks[child] & ~above[parent]
            apart = apart + np.bitwise_count((queries[q] ^ patterns[child]) & new)
            node = child
        return q, node


def union(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking places a with b; a root is the smallest place."""
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := roots[roots], roots):
            roots = up


def forest(codes: np.ndarray, limit: int, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the root of each, where codes within the limit are linked."""
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    index, roots = GrayIndex(codes), np.arange(len(codes))
    for at in range(0, len(codes), step):
        q, found = index.search(codes[at : at + step], limit)
        roots = union(roots, q + at, found)
    return codes, codes[roots]


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the nodes in a partition (t, mask, pattern, code) that is
    sorted by node."""

    def of(rows: np.ndarray) -> list[np.ndarray]:
        ends = np.flatnonzero((np.diff(rows[:3]) != 0).any(axis=0)) + 1
        codes = rows[3].view(np.uint64)
        starts = np.concatenate([[0], ends])
        stops = np.concatenate([ends, [rows.shape[1]]])
        two, more = stops - starts == 2, stops - starts > 2
        pair = starts[two]
        near = pair[np.bitwise_count(codes[pair] ^ codes[pair + 1]) <= limit]
        t, a, b = [rows[0][near]], [codes[near]], [codes[near + 1]]
        for s, e in zip(starts[more].tolist(), stops[more].tolist()):
            own, root = forest(codes[s:e], limit)
            linked = own != root
            a.append(own[linked])
            b.append(root[linked])
            t.append(np.full(int(linked.sum()), rows[0, s]))
        return [np.concatenate(t), np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)]

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in of(rows)], names=["t", "a", "b"])

    left = np.empty((4, 0), dtype=np.int64)
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        rows = np.hstack([left, np.stack(columns)])
        if not rows.shape[1]:
            continue
        # The last node may go on in the next batch.
        same = (rows[:3] == rows[:3, -1:]).all(axis=0)
        cut = rows.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
        left = rows[:, cut:]
        if cut:
            yield batch_of(rows[:, :cut])
    if left.shape[1]:
        yield batch_of(left)


# --- the upper nodes --------------------------------------------------------------


def parts_of(free: int, parts: int) -> list[int]:
    """The free bits cut into so many masks of about the same number of bits."""
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(codes: DataFrame, limit: int = LIMIT, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(t, a, b): links between the distinct codes (t, code) of each table that connect
    all codes within the limit, directly or by others."""
    masks = parts_of(_ALL, limit + 1)
    filed = codes.select("t", "code", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found, node = None, ["t", "mask", "pattern"]
    for level in range(depth):
        filed = filed.withColumn("pattern", F.col("code").bitwiseAND(F.col("mask")))
        last = level == depth - 1
        sizes = filed.groupBy(*node).agg(F.count("*").alias("n"))
        large = None if last else stored(sizes.where(F.col("n") > leaf).select(*node), "large-nodes")
        done = last or large.isEmpty()
        small = filed if done else filed.join(large, node, "left_anti")
        dealt = small.select(*node, "code").repartition(*node).sortWithinPartitions(*node)
        own = dealt.mapInArrow(lambda batches: _links(batches, limit), "t bigint, a bigint, b bigint")
        found = own if found is None else found.union(own)
        if done:
            return found
        # The masks in use are known: (limit + 1) to the power of the level.
        below = {m: [m | p for p in parts_of(_ALL & ~m, limit + 1)] for m in masks}
        children = F.create_map(
            *[x for m, c in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(i)) for i in c]))]
        )
        rest = stored(filed.join(large, node), "nodes")
        filed = rest.select("t", "code", F.explode(children[F.col("mask")]).alias("mask"))
        masks = [i for c in below.values() for i in c]
    return found


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, limit: int = LIMIT, tables: int = 1
) -> DataFrame:
    """(doc_id, text_key, code, component, component_id) for every row: the fingerprint
    as a long (the first table's), its class and the smallest id of the class.
    ``text_key`` is a hash of the text that tells rows of one id apart.

    With one table the links are exactly those within the limit. Near copies often differ in
    more bits; further tables of fingerprints from other hashes link them without a
    higher limit, which would link unlike texts."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = own.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprints(F.col("text"), width, tables).alias("codes"))
    # One table: the code itself; several: a hash of them all.
    one = F.col("codes")[0] if tables == 1 else F.xxhash64("codes")
    marked = stored(marked.withColumn("sign", one), "fingerprints")
    signs = stored(marked.groupBy("sign").agg(F.min("doc_id").alias("first_id"), F.any_value("codes").alias("codes")), "signs")
    filed = signs.select("sign", F.posexplode("codes").alias("t", "code"))
    filed = filed.select("sign", F.col("t").cast("long").alias("t"), "code")
    if tables == 1:
        edges = links(filed, limit).select("a", "b")
    else:
        filed = stored(filed, "codes")
        heads = stored(filed.groupBy("t", "code").agg(F.min("sign").alias("head")), "heads")
        alike = filed.join(heads, ["t", "code"]).where("sign != head").select(F.col("sign").alias("a"), F.col("head").alias("b"))
        near = links(heads, limit)
        for end in ("a", "b"):
            near = near.join(heads.select("t", F.col("code").alias(end), F.col("head").alias(f"head_{end}")), ["t", end])
        edges = alike.union(near.select("head_a", "head_b"))
    classes = connected_components(edges)
    known = signs.join(classes.withColumnRenamed("node", "sign"), "sign", "left").select(
        "sign", "first_id", F.coalesce("component", "sign").alias("component")
    )
    named = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    table = known.select("sign", "component").join(named, "component")
    return marked.join(table, "sign").select("doc_id", "text_key", F.col("codes")[0].alias("code"), "component", "component_id")


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, limit: int = LIMIT, tables: int = 1
) -> DataFrame:
    """One document of every class, the one with the smallest id, in the columns of the
    input. Rows without an id come last, rows of one id go by the hash of their text;
    of rows alike in both one stays."""
    return first_of_class(docs, near_duplicates(docs, doc_id, text, width, limit, tables), doc_id, text)


def first_of_class(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of every class of (doc_id, text_key, component)."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    first = classes.groupBy("component").agg(F.min(order).alias("r"))
    first = first.select(F.col("r.no_id").alias("_no_id"), F.col("r.id").alias("_id"), F.col("r.text_key").alias("_key"))
    own = without(docs, "_no_id", "_id", "_key", "_n")
    keyed = (
        own.withColumn("_no_id", F.col(doc_id).isNull())
        .withColumn("_id", F.coalesce(F.col(doc_id), F.lit(0)))
        .withColumn("_key", F.xxhash64(F.col(text).cast("string")))
    )
    keys = ["_no_id", "_id", "_key"]
    # Rows that share all keys are copies with one id: any of them will do.
    one = Window.partitionBy(*keys).orderBy(*keys)
    return keyed.join(first, keys).withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*own.columns)
