import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetables.llm import centroids as C



def order():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)


def floor_of(x, scale=256):
    return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale


def brute(rows, k, rounds, size):
    """All in Python integers."""
    kept = [
        (i, [floor_of(x) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted((i for i in kept if i[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    own = lambda v: min(range(len(now)), key=lambda c: (far(v, now[c]), c))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(own(v), []).append(v)
        for c, vs in held.items():
            now[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    found = [(i, own(v), far(v, now[own(v)])) for i, v in kept]
    inertia = {c: sum(d for _, k2, d in found if k2 == c) for c in range(len(now))}
    long = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, long(d), long(inertia[c]), long(sum(inertia.values())), digest[c]) for i, c, d in found), key=repr)


def mine(frame):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def frame_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


def vectors(n, size, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, size))
    rows = centres[rng.integers(0, 7, n)] + 0.3 * rng.standard_normal((n, size))
    return [(i, v) for i, v in enumerate(rows.astype(np.float32).astype(float).tolist())]


@pytest.mark.parametrize("k,rounds", [(9, 5), (3, 1), (4, 0)])
def test_against_brute_force(spark, k, rounds):
    rows = vectors(300, 8)
    assert mine(C.cluster(frame_of(spark, rows), order(), k=k, rounds=rounds, size=8)) == brute(rows, k, rounds, 8)


def test_odd_rows_ties_and_clashes(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)] + [(7, [5.0, 5.0])] * 2 + [(None, [0.5, 0.5])]
    odd = [(70, None), (71, []), (72, [1.0]), (73, [None, 1.0]), (74, [math.nan, 1.0]), (75, [math.inf, 0.0]), (76, [-0.001, 2.0])]
    frame = frame_of(spark, rows + odd, "double").withColumn("Cluster", F.lit("x")).withColumn("k", F.lit(1))
    found = C.cluster(frame, order(), k=6, size=2)
    assert found.columns == ["vec_id", "k", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert mine(found) == brute(rows + odd, 6, 5, 2)


@pytest.mark.parametrize("k", [30, 2])
def test_numbers_beyond_a_long(spark, k):
    rows = vectors(40, 4, 2) + [(100, [1e30, 0.0, -1e25, 1.0]), (101, [1e30, 1.0, 0.0, 0.0]), (102, [1e308, 0.0, 0.0, -1e308])]
    rows += [(103, [3e9, 0.0, 0.0, 1.0]), (104, [3.1e9, 0.0, 0.0, 1.0])]
    assert mine(C.cluster(frame_of(spark, rows, "double"), order(), k=k, rounds=3, size=4)) == brute(rows, k, 3, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(3, 4)
    assert mine(C.cluster(frame_of(spark, rows), order(), k=5, size=4)) == brute(rows, 5, 5, 4)
    assert C.cluster(frame_of(spark, []), order(), k=5, size=4).count() == 0


def test_products_follow_their_centroids():
    rng = np.random.default_rng(1)
    vectors, now = rng.integers(-300, 300, (50, 6)), rng.integers(-300, 300, (4, 6))
    products = C.updated(np.zeros((50, 4), dtype=np.int64), vectors, now)
    assert (products == vectors @ now.T).all()
    after = now.copy()
    after[1, 2:4] += 5
    after[3, 0] -= 1 << 40
    products = C.updated(products, vectors, after - now)
    assert (products == vectors @ after.T).all()


def test_packing_round_trip():
    for rows in ([[1, -2]], [[40000, 1], [0, 0]], [[-(1 << 63), (1 << 63) - 1]], [[1 << 80, -1], [3, 4]], [[-(1 << 15), (1 << 15) - 1]]):
        wide = any(abs(x) >= 1 << 63 and x != -(1 << 63) for r in rows for x in r)
        array = np.array(rows, dtype=object if wide else np.int64)
        assert C.unpacked(C.packed(array), 2).tolist() == rows
    for n in (0, 1, -1, 5, -5, 1 << 32, -(1 << 32), (1 << 100) - 7, -(1 << 100) - 7):
        assert sum(p << (32 * j) for j, p in C.limbs(n)) == n
