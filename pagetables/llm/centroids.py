"""Centroid clustering with an incremental distance matrix.

A vector's components become integers, floor(scale * x). Every vector keeps its exact integer
dot products with all centroids in a table. A round

1. adds to each product what the centroid's changed components contribute: only
   components with a nonzero change, only centroids that have any,
2. assigns the vector to the smallest |x|^2 - 2 x.c + |c|^2, ties to the smaller number,
3. sums components and vectors by cluster, one partial sum a task, and replaces every
   centroid that has vectors by the floor of its mean.

The first products are those of a change from zero. The products of a round are read from
the files of the round before, whose folder is removed when the next stands, so a lost
executor repeats tasks of one round only.

All numbers are exact. Components, products and changes are held in the narrowest integers that a
batch needs; products of matrices run in floating point only below 2^53, in 64 bits below 2^62, in
Python integers beyond, so finite components of any size work. Sums travel as 32-bit limbs. A
distance or an inertia beyond a long is null.

What reaches the driver is the centroids and their sums: ``k`` x ``size`` numbers. A cluster that
holds most vectors is a row of each task's partial sums, no group.

Vectors that are null, of another size, or with a null or non-finite component are left out.
Rows that share an id are vectors of their own, also repeated ones; centroids that tie in the
hash of their id start in the order of their components. Null ids start only when no others are
left. Fewer vectors than ``k`` give fewer centroids, an empty table no rows. Other columns
stay; those that clash with the operator's own are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, remove_folder
from .common import without

SIZE = 64
K = 40
ROUNDS = 5
SCALE = 256
SLICE = 4096
KINDS = (np.int16, np.int32, np.int64)
OWN = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "_vector", "_values", "_products", "_order")
LONG = 1 << 63


def packed(numbers: np.ndarray) -> list[bytes]:
    """Each row of integers as bytes: their width in bytes, then the numbers; wider ones than a
    long as decimal text after a 0."""
    if numbers.dtype == object:
        if len(numbers) and max(abs(int(x)) for x in numbers.flat) >= LONG:
            return [b"\0" + ",".join(map(str, row)).encode() for row in numbers.tolist()]
        numbers = numbers.astype(np.int64)
    most = int(max(numbers.max(), -(numbers.min() + 1))) if numbers.size else 0
    kind = next(k for k in KINDS if most <= np.iinfo(k).max)
    raw, width = numbers.astype(kind).tobytes(), numbers.shape[1] * np.dtype(kind).itemsize
    mark = bytes([np.dtype(kind).itemsize])
    return [mark + raw[i : i + width] for i in range(0, len(raw), width)]


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """Rows of integers; 64-bit ones if all of them fit."""
    kinds = {r[0] for r in rows}
    if len(kinds) == 1 and 0 not in kinds:
        return np.frombuffer(b"".join(r[1:] for r in rows), dtype=f"<i{kinds.pop()}").reshape(-1, size).astype(np.int64)
    one = lambda r: np.frombuffer(r[1:], dtype=f"<i{r[0]}").astype(np.int64) if r[0] else np.array([int(x) for x in r[1:].split(b",")], dtype=object)
    return np.stack([one(r) for r in rows])


def largest(numbers: np.ndarray) -> int:
    return max(abs(int(numbers.max())), abs(int(numbers.min()))) if numbers.size else 0


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as exact integers."""
    scaled = np.floor(values * float(scale))
    if np.isfinite(scaled).all() and (not scaled.size or np.abs(scaled).max() < 2.0**62):
        return scaled.astype(np.int64)
    flat = [math.floor(float(x) * scale) if math.isfinite(float(x) * scale) else int(float(x)) * scale for x in values.flat]
    return np.array(flat, dtype=object).reshape(values.shape)


def product(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact products of the rows of a (n x m) with weights (m)."""
    bound = largest(vectors) * largest(weights) * max(1, len(weights))
    if bound < 1 << 53:
        return (vectors.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return vectors.astype(np.int64) @ weights.astype(np.int64)
    return vectors.astype(object) @ weights.astype(object)


def updated(products: np.ndarray, vectors: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The products after the centroids changed: touches only components that did."""
    across = np.ascontiguousarray(vectors.T)
    for k in range(len(change)):
        moved = np.flatnonzero(change[k])
        if len(moved):
            more = product(across[moved].T, change[k][moved])
            if products.dtype != object and (more.dtype == object or largest(products[:, k]) + largest(more) >= 1 << 62):
                products = products.astype(object)
            products[:, k] += more
    return products


def nearest(products: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector."""
    wide = max(largest(vectors), largest(centroids)) >= 1 << 26 or products.dtype == object
    if wide:
        vectors, centroids, products = vectors.astype(object), centroids.astype(object), products.astype(object)
    distances = (vectors * vectors).sum(1)[:, None] - 2 * products + (centroids * centroids).sum(1)[None, :]
    best = distances.argmin(1)
    return best, distances[np.arange(len(best)), best]


def limbs(number: int) -> Iterator[tuple[int, int]]:
    """(place, part) with number = sum of part * 2^(32 place); only the last part is signed."""
    place = 0
    while number not in (0, -1):
        yield place, number & 0xFFFFFFFF
        number, place = number >> 32, place + 1
    if number:
        yield place, -1


@dataclass
class Centroids:
    """Rows are centroids; exact integers, 64-bit if they fit."""

    rows: list[list[int]]

    def array(self) -> np.ndarray:
        wide = any(abs(x) >= 1 << 62 for row in self.rows for x in row)
        return np.array(self.rows, dtype=object if wide else np.int64)

    def since(self, before: Centroids | None) -> np.ndarray:
        now = self.array()
        return now if before is None else now.astype(object) - before.array().astype(object)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.rows]


def kept_vectors(rows: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    """Rows with a whole vector, that as ``_values`` and its integers as ``_vector``."""
    values = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = (F.size(values) == size) & good

    def integers(vectors: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        for at in range(0, len(vectors), SLICE):
            part = vectors.slice(at, SLICE)
            there = part.drop_null()
            flat = np.asarray(there.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, size)
            found = iter(packed(floors(flat, scale)))
            out += [next(found) if ok else None for ok in part.is_valid().to_pylist()]
        return pa.array(out, pa.binary())

    kept = rows.withColumn("_values", F.when(whole, values)).where("_values IS NOT NULL")
    return kept.withColumn("_vector", F.arrow_udf(integers, "binary")(F.col("_values")))


def by_batch(change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield change(batch.slice(at, SLICE))

    return run


def assigned(state: DataFrame, before: Centroids | None, now: Centroids, size: int, keep: bool) -> DataFrame:
    """The state of the next round: products with the centroids as they are now, cluster and
    distance. ``keep``: whether another round needs the products."""
    spark = state.sparkSession
    sent = spark.sparkContext.broadcast((now.since(before), now.array()))
    own = [c for c in state.columns if c not in ("_products", "cluster", "distance")]
    schema = state.select(*own).withColumns({"_products": F.lit(b""), "cluster": F.lit(0), "distance": F.lit("")}).schema
    names = schema.names

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        changes, centroids = sent.value
        vectors = unpacked(batch.column("_vector").to_pylist(), size)
        if "_products" in batch.schema.names:
            products = unpacked(batch.column("_products").to_pylist(), len(centroids))
        else:
            products = np.zeros((batch.num_rows, len(centroids)), dtype=np.int64)
        products = updated(products, vectors, changes)
        cluster, distance = nearest(products, vectors, centroids)
        columns = [batch.column(c) for c in own] + [
            pa.array(packed(products) if keep else [b""] * batch.num_rows, pa.binary()),
            pa.array(cluster, pa.int32()),
            pa.array([str(d) for d in distance.tolist()], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return state.mapInArrow(by_batch(change), schema)


def means(state: DataFrame, now: Centroids, size: int) -> Centroids:
    """The centroids after a round."""
    k = len(now.rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, size), dtype=object)
        counts = np.zeros(k, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                vectors = unpacked(part.column("_vector").to_pylist(), size)
                cluster = part.column("cluster").to_numpy(zero_copy_only=False)
                if largest(vectors) * SLICE >= 1 << 62:
                    vectors = vectors.astype(object)
                for c in np.unique(cluster):
                    own = vectors[cluster == c]
                    totals[c] = totals[c] + own.sum(0).astype(object)
                    counts[c] += len(own)
        rows = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        rows += [(c, j, place, part) for c in range(k) for j in range(size) for place, part in limbs(int(totals[c][j]))]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("c", "j", "place", "part"), r, strict=True)) for r in rows],
            pa.schema([("c", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("part", pa.int64())]),
        )

    parts = state.select("_vector", "cluster").mapInArrow(sums, "c int, j int, place int, part bigint")
    # k x size numbers of a few limbs: bounded by the parameters.
    found = parts.groupBy("c", "j", "place").agg(F.sum("part").alias("part")).collect()
    counts = {r.c: r.part for r in found if r.j < 0}
    totals: dict[tuple[int, int], int] = {}
    for r in found:
        if r.j >= 0:
            totals[r.c, r.j] = totals.get((r.c, r.j), 0) + (r.part << (32 * r.place))
    return Centroids(
        [[totals.get((c, j), 0) // counts[c] for j in range(size)] if c in counts else row for c, row in enumerate(now.rows)]
    )


def first_centroids(kept: DataFrame, k: int, size: int) -> Centroids:
    """The vectors with the smallest ``_order``, ties by their components; ``k`` rows reach the driver."""
    rows = kept.orderBy(F.col("_order").asc_nulls_last(), "_values").limit(k).select("_vector").collect()
    return Centroids([[int(x) for x in unpacked([bytes(r[0])], size)[0]] for r in rows])


def cluster(
    rows: DataFrame,
    order: Column,
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
) -> DataFrame:
    """The other columns of the kept rows with cluster, distance, cluster_inertia, inertia and the
    digest of the centroid. ``order``: the k vectors with the smallest start."""
    spark = rows.sparkSession
    rows = without(rows.withColumn("_order", order), *[c for c in OWN if c != "_order"])
    folders: list[str] = []

    def written(state: DataFrame) -> DataFrame:
        folders.append(new_folder(spark, "llm-products"))
        state.write.parquet(folders[-1])
        return spark.read.schema(state.schema).parquet(folders[-1])

    kept = kept_vectors(rows, vector, size, scale)
    now, before = first_centroids(kept, k, size), None
    state = written(kept.drop(vector, "_order", "_values"))
    if now.rows:
        for step in range(rounds + 1):
            state = written(assigned(state, before, now, size, keep=step < rounds))
            remove_folder(spark, folders[-2])
            if step < rounds:
                before, now = now, means(state, now, size)
    else:
        state = state.withColumns({"cluster": F.lit(0), "distance": F.lit("0")})
    # At most k rows.
    distance = F.expr("try_cast(distance AS decimal(38,0))")
    exact = state.groupBy("cluster").agg(F.try_sum(distance).alias("n"), F.count_if(distance.isNull()).alias("wide")).collect()
    inertia = {r.cluster: None if r.wide else r.n for r in exact}
    total = sum(inertia.values()) if exact and None not in inertia.values() else None
    long = lambda n: int(n) if n is not None and n < LONG else None
    digests = now.digests()
    table = [(c, long(inertia.get(c)), long(total), digests[c]) for c in range(len(digests))]
    each = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = state.drop("_vector", "_products").join(F.broadcast(each), "cluster")
    others = [F.col(f"`{c}`") for c in state.columns if c not in (*OWN, "distance")]
    return found.select(
        *others, "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )
