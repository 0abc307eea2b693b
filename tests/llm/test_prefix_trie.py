import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from pagetables.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def base_and_head():
    conv = F.col("conv_id")
    return conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4


def brute(rows, borrow=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        rebuilt[c] = convs.get(c - c % 20 if c >= 0 else c + (-c % 20), [])[:h] + own[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for k, members in nodes.items():
        inside = [x for x in nodes if x[: len(k)] == k]
        kids = [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in inside) for x in inside)
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", x[-1][1])) for x in inside if x)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def mine(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = rng.random() < 0.4
        for turn in range(rng.randint(1, 6)):
            text = f"turn {turn} of all" if hot else f"turn {turn} says {rng.randint(0, 1 + 3 * turn)}"
            rows.append((c + c // 30, turn, "user" if turn % 2 == 0 else "assistant", text))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus(120)
    assert mine(T.build(spark.createDataFrame(rows, SCHEMA), *base_and_head())) == brute(rows)


def test_a_full_sketch_only_shuffles_more(spark, monkeypatch):
    rows = corpus(60, 3)
    monkeypatch.setattr(T.Sketch, "single", lambda self, depth, a, b: a != a)
    assert mine(T.build(spark.createDataFrame(rows, SCHEMA))) == brute(rows, borrow=False)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (2, 0, "", ""), (2, None, "user", "first"), (None, 0, "user", "x")]
    rows += [(3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, 5, "a", "tie"), (40, 0, "user", "one turn"), (41, 0, "user", "gone"), (45, 0, "user", "gone")]
    rows += [(-7, 0, "user", "negative"), (-20, 0, "user", "base"), (9, 0, "user", "word " * 20000), (10, 0, "user", "word " * 20000)]
    rows += [(1 << 60, 0, "us", "er"), (2 + (1 << 60), 0, "u", "ser")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit("clash"), "Depth": F.lit(1), "kind": F.lit(9), "part": F.lit(0)})
    assert mine(T.build(frame, *base_and_head())) == brute(rows)
    assert mine(T.build(frame)) == brute(rows, borrow=False)


def test_empty_table(spark):
    assert T.build(spark.createDataFrame([], SCHEMA), *base_and_head()).count() == 0


def test_conversations_that_go_over_several_ranges(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}") for c in (3, 7) for t in range(600)] + [(5, 0, "user", "turn 0"), (8, 0, "user", "x")]
    rows += [(7, 600, "user", "more"), (3, 600, "user", "end")]
    ranges = lambda frame, *order: frame.repartitionByRange(7, *order).sortWithinPartitions(*order)
    monkeypatch.setattr(T, "in_ranges", ranges)
    frame = T.ranked(T.turn_rows(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text"))
    assert frame.select("part").distinct().count() == 7
    found = {}
    for r in frame.collect():
        found.setdefault(r.conv_id, {})[r.rank] = (r.a, r.b, r.pa, r.pb)
    assert sorted(found[3]) == list(range(1, 602))
    assert all(found[3][d] == found[7][d] for d in range(1, 601)) and found[3][601][:2] != found[7][601][:2]
    assert all(found[3][d][2:] == found[3][d - 1][:2] for d in range(2, 602))
    got = mine(T.build(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_deep(rows)


def brute_deep(rows):
    """As ``brute`` for two long conversations, without comparing all pairs of nodes."""
    short = [r for r in rows if r[1] < 3 or r[1] >= 598]
    moved = [(c, t if t < 3 else t - 595, role, text) for c, t, role, text in short]
    want = {(r[0], r[1]): r for r in brute(moved, borrow=False)}
    out = []
    for (c, d), r in want.items():
        left = 602 - 7 if 0 <= d <= 3 and r[3] > 1 and c == 3 or d == 0 else 0
        out.append((c, d + 595 if d > 3 else d, *r[2:6], r[6] + 2 * left, r[7]))
    for d in range(4, 599):
        after = 600 - d + 1
        out.append((3, d, 3, 2, 1, 2, 2 * after, hashlib.sha256(b"").hexdigest()))
    return sorted(out, key=repr)


def test_ends_of_many_members_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS", 7)
    ranges = lambda frame, *order: frame.repartitionByRange(5, *order).sortWithinPartitions(*order)
    monkeypatch.setattr(T, "in_ranges", ranges)
    ends = [(1, 1, 1, c) for c in range(-50, 60)] + [(2, 1, 1, 4), (0, 0, 0, 9), (0, 0, 0, 10)]
    frame = spark.createDataFrame(ends, "depth bigint, a bigint, b bigint, conv_id bigint")
    found = {r.depth: r.sha for r in T.end_digests(frame).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert found == {1: sha(range(-50, 60)), 2: sha([4]), 0: sha([9, 10])}
