"""Approximate nearest neighbours by multi-probe p-stable hashing.

Vectors are brought to unit length, where the order by Euclidean distance is the order by
cosine. Each of ``tables`` hash tables takes ``projections`` Gaussian (2-stable)
projections, shifts and cuts them into slots of ``width``; the slots name a bucket.
Every vector is filed in one bucket of every table. A query visits ``probes`` buckets of
each table: its own and perturbed ones, in the order of their estimated success, the
sum of the squared distances to the slot borders that the perturbation crosses. What
all tables yield is merged and ranked by the exact cosine.

Unless they are given, the numbers of projections, tables and probes follow from the rows
(``tune``): a sample of about ``SAMPLE_QUERIES`` queries is searched against all rows. By a fifth of
them, of the settings that reach ``TARGET`` of their neighbours the one with the least work is
taken, where the work is the share of about ``SAMPLE_ROWS`` sampled rows in the buckets visited,
what the visits cost, and what filing costs. The others, which the choice has not seen, then say
how many probes the taken setting needs. Projections go up to twice the binary logarithm of the
rows, so buckets stay small as rows grow, where the vectors let them. If no setting reaches the
target, all queries are searched against all rows.

Buckets are searched where they are: a unit of work holds some buckets' vectors and the
queries that visit them, and returns the best of each query, not pairs. A bucket with
more than ``block`` vectors or queries is spread over several units, and all are
searched: there is no cap on buckets or candidates. Queries that find fewer than ``k``
neighbours in the buckets they visit are then searched against all vectors, in
blocks.

Null, zero or non-finite vectors take no part, nor do rows without an id or with another
number of components than most have. Rows alike in id and vector count once, and rows
with a query's id are its own. Of vectors that are alike, the k + 1 smallest ids stand for
all: no other can be among the k nearest. Equal scores are ranked by the smaller id. An empty table
gives no rows. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TABLES = 4
PROJECTIONS = 6
SLOT = 3.0
PROBES = 200
# The tuning: queries and rows of the sample, the recall to reach, and the cost of a visit, and of
# a row filed once more, in distances computed.
SAMPLE_QUERIES = 160
SAMPLE_ROWS = 2048
TARGET = 0.95
VISIT_COST = 20
FILING_COST = 100
BLOCK = 4096
UNIT = 16384
SEED = 20240229


class Hashing:
    """The projections of all tables."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables, self.width = tables, width
        self.directions = rng.standard_normal((tables, size, projections))
        self.shifts = rng.random((tables, 1, projections)) * width
        self.factors = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1
        self.bases = rng.integers(1, 1 << 62, (tables, 1), dtype=np.int64)

    def first(self, tables: int) -> Hashing:
        """The first tables alone."""
        self.tables = tables
        self.directions, self.shifts = self.directions[:tables], self.shifts[:tables]
        self.factors, self.bases = self.factors[:tables], self.bases[:tables]
        return self

    def slots(self, units: np.ndarray) -> np.ndarray:
        """tables x vectors x projections."""
        return (units @ self.directions + self.shifts) / self.width

    def buckets(self, slots: np.ndarray) -> np.ndarray:
        """tables x vectors: one number for each bucket of each table."""
        with np.errstate(over="ignore"):
            return (slots.astype(np.int64) * self.factors[:, None, :]).sum(axis=2) + self.bases

    def visits_by_table(self, units: np.ndarray, probes: int) -> list[list[list[int]]]:
        """For each vector and table the buckets to visit, in order."""
        at = self.slots(units)
        own = np.floor(at)
        home, inside = self.buckets(own).tolist(), at - own
        factors, out = self.factors.tolist(), []
        for i in range(len(units)):
            found = []
            for t in range(self.tables):
                start, of = home[t][i] + (1 << 63), factors[t]
                moved = [start + sum(s * of[j] for j, s in step) for step in self._steps(inside[t, i].tolist(), probes)]
                # Sums of 64 bits, as in ``buckets``.
                found.append([(m & ((1 << 64) - 1)) - (1 << 63) for m in moved])
            out.append(found)
        return out

    def visits(self, units: np.ndarray, probes: int) -> list[list[int]]:
        """For each vector the buckets to visit, over all tables."""
        return [list(dict.fromkeys(b for table in own for b in table)) for own in self.visits_by_table(units, probes)]

    @staticmethod
    def _steps(inside: Sequence[float], probes: int) -> list[tuple[tuple[int, int], ...]]:
        """Perturbations in the order of their scores: each a set of (projection, -1 or
        +1). A set grows by its next dearer step or trades its dearest for the next."""
        priced = [(x * x, j, -1) for j, x in enumerate(inside)]
        priced += [((1 - x) ** 2, j, 1) for j, x in enumerate(inside)]
        priced.sort()
        out, heap = [()], [(priced[0][0], (0,))]
        while heap and len(out) < probes:
            score, chosen = heapq.heappop(heap)
            if len({priced[c][1] for c in chosen}) == len(chosen):
                out.append(tuple((priced[c][1], priced[c][2]) for c in chosen))
            last = chosen[-1]
            if last + 1 < len(priced):
                heapq.heappush(heap, (score + priced[last + 1][0], (*chosen, last + 1)))
                heapq.heappush(heap, (score - priced[last][0] + priced[last + 1][0], (*chosen[:-1], last + 1)))
        return out


@dataclass(frozen=True)
class Setting:
    """Numbers of a search. ``recall`` and ``share`` (of the rows visited) are those of the sample."""

    tables: int
    projections: int
    width: float
    probes: int
    recall: float = math.nan
    share: float = math.nan


def _ranks(visited: list[int], buckets: np.ndarray) -> np.ndarray:
    """How many buckets are visited before each of ``buckets``; PROBES for those not visited."""
    rank = {b: r for r, b in reversed(list(enumerate(visited)))}
    known = np.array(sorted(rank), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, buckets), len(known) - 1)
    return np.where(known[at] == buckets, np.array([rank[b] for b in known.tolist()])[at], PROBES)


def _first_visits(hashing: Hashing, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """tables x queries x rows: the rank of the row's bucket by any of the first tables."""
    buckets = hashing.buckets(np.floor(hashing.slots(rows)))
    ranks = [[_ranks(v, b) for v, b in zip(own, buckets)] for own in hashing.visits_by_table(asked, PROBES)]
    return np.minimum.accumulate(np.array(ranks).swapaxes(0, 1), axis=0)


def _to_near(hashing: Hashing, asked: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """tables x neighbours: the rank of each neighbour's bucket for its query."""
    return np.concatenate([_first_visits(hashing, asked[i : i + 1], rows)[:, 0] for i, rows in enumerate(near)], axis=1)


def _needed(ranks: np.ndarray, target: float) -> int:
    """The number of probes at which enough neighbours have been met."""
    return int(np.sort(ranks)[math.ceil(target * len(ranks)) - 1]) + 1


def tune(total: int, queries: int, asked: np.ndarray, near: list[np.ndarray], rows: np.ndarray, target: float = TARGET) -> Setting | None:
    """The setting with the least work that reaches the recall; None if there is none.

    ``asked`` are sampled queries of the ``queries``, ``near`` the true neighbours of each, ``rows`` a
    sample of the ``total`` rows, all of unit length. A fifth of the queries chooses, the others
    measure."""
    size, found = asked.shape[1], []
    few = -(-len(asked) // 5)
    finest = max(PROJECTIONS, min(size, 2 * math.log2(total + 1)))
    for projections in sorted({round(p) for p in np.geomspace(min(PROJECTIONS, size), finest, 5)}):
        hashing = Hashing(size, TABLES, projections, SLOT)
        hits, seen = _to_near(hashing, asked[:few], near[:few]), _first_visits(hashing, asked[:few], rows)
        for tables in range(1, TABLES + 1):
            probes = _needed(hits[tables - 1], target)
            if probes <= PROBES:
                share = float((seen[tables - 1] < probes).mean())
                work = share * total + tables * (VISIT_COST * probes + FILING_COST * total / max(1, queries))
                found.append((work, tables, projections))
    for _, tables, projections in sorted(found):
        hashing = Hashing(size, TABLES, projections, SLOT).first(tables)
        hits = _to_near(hashing, asked[few:] if len(asked) > few else asked, near[few:] or near)[-1]
        probes = _needed(hits, target)
        if probes <= PROBES:
            share = float((_first_visits(hashing, asked[:few], rows)[-1] < probes).mean())
            return Setting(tables, projections, SLOT, probes, float((hits < probes).mean()), share)
    return None


def _matrix(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return _scaled(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row by a power of two, which changes no cosine, so that no square overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q, v = query[order], ids[order]
    # One pair can come from several buckets.
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])]) if len(q) else np.empty(0, bool)
    order = order[new]
    q = query[order]
    heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(q)]])))
    return order[rank < k]


def _search(size: int, k: int):
    """Applied to a unit's vectors (vec_id, vector, cell) and its queries (query_id, qvec,
    cells); a query with null cells visits all."""

    def of(members: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(members) and len(queries):
            ids = members["vec_id"].to_numpy()
            rows, asked = _matrix(members["vector"], size), _matrix(queries["qvec"], size)
            lengths, long = np.linalg.norm(rows, axis=1), np.linalg.norm(asked, axis=1)
            units, asked_units = rows / lengths[:, None], asked / long[:, None]
            query_ids = queries["query_id"].to_numpy()
            cells, cell_of = np.unique(members["cell"].to_numpy(), return_inverse=True)
            order = np.argsort(cell_of, kind="stable")
            bounds = np.searchsorted(cell_of[order], np.arange(len(cells) + 1))
            visitors: dict[int, list[int]] = {}
            for q, own in enumerate(queries["cells"].to_pylist()):
                if own is None:
                    places = range(len(cells))
                else:
                    at = np.searchsorted(cells, own)
                    places = [int(a) for a, c in zip(at, own) if a < len(cells) and cells[a] == c]
                for c in places:
                    visitors.setdefault(c, []).append(q)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for c, who in visitors.items():
                inside = order[bounds[c] : bounds[c + 1]]
                for at in range(0, len(who), 512):
                    q = np.array(who[at : at + 512])
                    near = asked_units[q] @ units[inside].T
                    near[query_ids[q][:, None] == ids[inside][None, :]] = -np.inf
                    # Equal scores at the border all go on to the exact ranking.
                    floor = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
                    x, y = np.nonzero(near >= np.maximum(floor - 1e-12, -2.0)[:, None])
                    if len(x) > 4 * k * len(q):
                        top = _best(x, ids[inside][y], np.round(near[x, y], 12), k)
                        x, y = x[top], y[top]
                    pairs.append((q[x], inside[y]))
            if pairs:
                q, m = (np.concatenate(p) for p in zip(*pairs))
                exact = np.einsum("ij,ij->i", asked[q], rows[m]) / (long[q] * lengths[m])
                top = _best(query_ids[q], ids[m], exact, k)
                found = [query_ids[q][top], ids[m][top], exact[top]]
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    return of


def _usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(
        "vec_id is not null and vector is not null"
    )
    return own.where(
        ~F.exists("vector", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
        & F.exists("vector", lambda x: x != 0)
    )


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int | None = None,
    projections: int | None = None,
    width: float | None = None,
    probes: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest
    first. ``is_query`` is a condition on the column vec_id. If none of ``tables``,
    ``projections``, ``width`` and ``probes`` is given, they are tuned on a sample."""
    usable = _usable(rows, vec_id, vector)
    sizes = usable.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size, _ = max(((r["size"], r.n) for r in sizes), key=lambda x: (x[1], -x[0]))
    alike = Window.partitionBy("vector").orderBy("vec_id")
    usable = usable.where(F.size("vector") == size)
    queries = usable.where(is_query).dropDuplicates(["vec_id", "vector"])
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvec"), F.xxhash64("vec_id", "vector").alias("asker"))
    queries = stored(queries, "queries")
    distinct = usable.distinct().withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n")
    distinct = stored(distinct, "vectors")
    total, asking = distinct.count(), queries.count()
    schema = "query_id bigint, vec_id bigint, score double"

    def everywhere(some: DataFrame, purpose: str) -> DataFrame:
        """These queries against every vector, block by block."""
        units = 1 + total // UNIT
        every = distinct.select(F.pmod(F.xxhash64("vec_id"), F.lit(units)).alias("unit"), F.lit(0).cast("long").alias("cell"), "vec_id", "vector")
        some = some.select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long"))).alias("unit"),
            "query_id",
            "qvec",
            F.lit(None).cast("array<bigint>").alias("cells"),
        )
        return stored(every.groupBy("unit").cogroup(some.groupBy("unit")).applyInArrow(_search(size, k), schema), purpose)

    def ranked(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        once = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return once.select("query_id", "rank", "vec_id", "score")

    def tuned() -> Setting | None:
        few = queries.where(F.pmod("asker", F.lit(max(1, asking))) < SAMPLE_QUERIES).limit(2 * SAMPLE_QUERIES)
        few = stored(few, "sampled")
        near = ranked(everywhere(few, "sampled-near")).join(distinct, "vec_id").dropDuplicates(["query_id", "vec_id"]).collect()
        by: dict[int, list] = {}
        for r in near:
            by.setdefault(r.query_id, []).append(r.vector)
        asked = [(r.qvec, by[r.query_id]) for r in few.collect() if r.query_id in by]
        if not asked:
            return None
        place = F.pmod(F.xxhash64("vec_id", "vector", F.lit(SEED)), F.lit(total))
        some = distinct.where(place < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS).select("vector").collect()
        units = lambda vectors: _unit(_scaled(np.array(vectors, dtype=np.float64).reshape(-1, size)))
        return tune(total, asking, units([x for x, _ in asked]), [units(v) for _, v in asked], units([r.vector for r in some]))

    if tables is None and projections is None and width is None and probes is None:
        setting = tuned()
        if setting is None:
            return ranked(everywhere(queries, "rest"))
        hashing = Hashing(size, TABLES, setting.projections, setting.width).first(setting.tables)
        tables, probes = setting.tables, setting.probes
    else:
        tables, probes = tables or TABLES, probes or PROBES
        hashing = Hashing(size, tables, projections or PROJECTIONS, width or SLOT)

    def buckets(vectors: pa.Array) -> pa.Array:
        slots = np.floor(hashing.slots(_unit(_matrix(vectors, size))))
        return pa.array(hashing.buckets(slots).T.tolist(), pa.list_(pa.int64()))

    def visits(vectors: pa.Array) -> pa.Array:
        return pa.array(hashing.visits(_unit(_matrix(vectors, size)), probes), pa.list_(pa.int64()))

    own = F.arrow_udf(buckets, "array<bigint>").asNondeterministic()("vector")
    filed = stored(distinct.select("vec_id", "vector", own.alias("buckets")), "buckets")
    filed = filed.select("vec_id", "vector", F.explode("buckets").alias("bucket"))
    # Visits carry no vector: it is joined where the visits of a unit are together.
    asked = queries.select("query_id", "asker", F.arrow_udf(visits, "array<bigint>").asNondeterministic()("qvec").alias("buckets"))
    asked = stored(asked, "visits").select("query_id", "asker", F.explode("buckets").alias("bucket"))

    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    loads = filed.groupBy("bucket").agg(F.count("*").alias("n")).join(
        asked.groupBy("bucket").agg(F.count("*").alias("m")), "bucket"
    )
    loads = stored(loads.select("bucket", blocks("n").alias("n"), blocks("m").alias("m")), "loads")
    units = 1 + total * tables // UNIT
    cell = F.xxhash64("bucket", "x", "y")

    def dealt(side: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        """Each row in its block of the bucket, once for every block of the other side."""
        both = side.join(loads, "bucket").withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        both = both.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return both.withColumn("cell", cell).withColumn("unit", F.pmod("cell", F.lit(units)))

    members = dealt(filed, "vec_id", "n", "m", "x", "y").select("unit", "cell", "vec_id", "vector")
    visitors = dealt(asked, "query_id", "m", "n", "y", "x")
    visitors = visitors.groupBy("unit", "query_id", "asker").agg(F.collect_set("cell").alias("cells"))
    visitors = visitors.join(queries, ["query_id", "asker"]).select("unit", "query_id", "qvec", "cells")
    found = members.groupBy("unit").cogroup(visitors.groupBy("unit")).applyInArrow(_search(size, k), schema)
    found = stored(found, "found")

    # Queries that the buckets leave short meet every vector.
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = queries.join(enough, "query_id", "left_anti")
    if not short.isEmpty():
        found = found.unionByName(everywhere(short, "rest"))
    return ranked(found)
