import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetables.llm import neighbours as N


def brute(rows, k, every):
    ids = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, v in ids:
        if q % every:
            continue
        best = []
        for i, w in ids:
            if i != q:
                a, b = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                best.append((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i))
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in best)[:k]]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def frame_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")


def vectors(n, size, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, size))
    rows = centres[rng.integers(0, 5, n)] + rng.standard_normal((n, size))
    return [(i, v) for i, v in enumerate(rows.astype(np.float32).tolist())]


@pytest.mark.parametrize("block", [N.BLOCK, 16])
def test_recall_against_brute_force(spark, block):
    rows = vectors(1500, 24)
    mine = found(N.nearest(frame_of(spark, rows), F.col("vec_id") % 50 == 0, block=block))
    want = brute(rows, 5, 50)
    assert set(mine) == set(want) and all(len(v) == 5 for v in mine.values())
    hits = sum(len({i for i, _ in mine[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    by = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, near in mine.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, s in near:
            assert s == pytest.approx(by[q] @ by[i] / np.linalg.norm(by[q]) / np.linalg.norm(by[i]), abs=1e-12)


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(40, [1.0, 0.0, 0.5])] * 3
    rows += [(100 + i, [0.0, 1.0, float(i)]) for i in range(3)]
    frame = frame_of(spark, rows)
    odd = spark.createDataFrame(
        [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (350, [float("nan")] * 3), (400, [float("inf"), 1.0, 1.0]), (450, [1.0]), (None, [1.0, 1.0, 1.0])],
        "vec_id bigint, embedding array<float>",
    )
    frame = frame.union(odd).withColumn("Rank", F.lit("clash"))
    mine = found(N.nearest(frame, F.col("vec_id") % 50 == 0))
    assert set(mine) == {0, 100}
    assert [i for i, _ in mine[0]] == [1, 2, 3, 4, 5]
    assert mine == {q: [(i, pytest.approx(s)) for i, s in v] for q, v in brute(rows, 5, 50).items()}


def test_queries_that_the_buckets_leave_short(spark):
    rows = vectors(300, 16, 3)
    mine = found(N.nearest(frame_of(spark, rows), F.col("vec_id") % 50 == 0, tables=1, width=0.05, probes=1))
    want = brute(rows, 5, 50)
    assert {q: [i for i, _ in v] for q, v in mine.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_fewer_candidates_than_asked_for(spark):
    assert len(found(N.nearest(frame_of(spark, vectors(3, 4)), F.col("vec_id") == 0))[0]) == 2
    assert N.nearest(frame_of(spark, [(0, [1.0, 2.0])]), F.col("vec_id") == 0).count() == 0
    assert N.nearest(frame_of(spark, vectors(3, 4)).where("false"), F.col("vec_id") == 0).count() == 0


def test_probes_come_in_the_order_of_their_scores():
    inside = np.array([0.1, 0.6, 0.35])
    steps = N.Hashing._steps(inside, 27)
    score = lambda s: sum((inside[j] if d < 0 else 1 - inside[j]) ** 2 for j, d in s)
    assert len(steps) == len(set(steps)) == 27
    assert [score(s) for s in steps] == sorted(score(s) for s in steps)


def clustered(n, size=32, around=64, seed=5):
    """Unit vectors near centres, ``around`` for each."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // around, size))
    rows = np.repeat(centres, around, axis=0) + 0.25 * rng.standard_normal((n // around * around, size))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tuned(rows, some=N.SAMPLE_QUERIES, k=5):
    rng = np.random.default_rng(1)
    asked = rng.choice(len(rows), some, replace=False)
    near = rows[asked] @ rows.T
    near[np.arange(some), asked] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    sample = rows[rng.choice(len(rows), min(len(rows), N.SAMPLE_ROWS), replace=False)]
    return N.tune(len(rows), len(rows) // 50, rows[asked], [rows[b] for b in best], sample), asked, best


def test_share_of_rows_visited_falls_as_rows_grow():
    shares = []
    for n in (2_000, 8_000, 32_000):
        rows = clustered(n)
        setting, asked, best = tuned(rows)
        hashing = N.Hashing(rows.shape[1], N.TABLES, setting.projections, setting.width).first(setting.tables)
        filed = hashing.buckets(np.floor(hashing.slots(rows)))
        others = np.random.default_rng(9).choice(n // 64 * 64, 60, replace=False)
        hits, seen = 0, 0
        for i, visits in zip(others, hashing.visits(rows[others], setting.probes)):
            near = rows[i] @ rows.T
            near[i] = -2
            met = np.isin(filed, np.array(visits, dtype=np.int64)).any(axis=0)
            hits += met[np.argsort(-near)[:5]].sum()
            seen += met.sum()
        # Queries that the tuning did not see.
        assert hits >= 0.9 * 5 * len(others)
        shares.append(seen / len(others) / len(rows))
    assert shares[0] > 1.5 * shares[1] > 2.25 * shares[2] and shares[2] < 0.1, shares


def test_no_setting_where_the_probes_do_not_reach(monkeypatch):
    monkeypatch.setattr(N, "PROBES", 1)
    rows = clustered(2_000)
    assert N.tune(len(rows), 40, rows[:8], [-rows[:8][i : i + 1] for i in range(8)], rows) is None


def test_very_large_and_very_small_vectors(spark):
    rows = vectors(120, 8, 2)
    sizes = [1e200, 1e-200, 1.0]
    scaled = [(i, [x * sizes[i % 3] for x in v]) for i, v in rows]
    mine = found(N.nearest(spark.createDataFrame(scaled, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0))
    want = brute(rows, 5, 50)
    for q, near in mine.items():
        assert [s for _, s in near] == [pytest.approx(s, abs=1e-9) for _, s in want[q]] or len({i for i, _ in near} & {i for i, _ in want[q]}) >= 4


def test_without_a_setting_all_rows_are_searched(spark, monkeypatch):
    monkeypatch.setattr(N, "PROBES", 1)
    monkeypatch.setattr(N, "TABLES", 1)
    rows = vectors(300, 16, 3)
    mine = found(N.nearest(frame_of(spark, rows), F.col("vec_id") % 50 == 0))
    assert {q: [i for i, _ in v] for q, v in mine.items()} == {q: [i for i, _ in v] for q, v in brute(rows, 5, 50).items()}
