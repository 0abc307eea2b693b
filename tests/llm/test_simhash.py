import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetables.llm import components, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(codes, limit):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = list(root)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def unsigned(x):
    return x & (1 << 64) - 1


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=6), st.integers(0, 2**32), st.integers(0, 200), st.integers(0, 4))
def test_forest_links_what_brute_force_links(seeds, seed, n, limit):
    rng = random.Random(seed)
    codes = set(seeds)
    for c in list(codes):
        for _ in range(n // 6):
            for _ in range(rng.randint(0, 3)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    found, roots = simhash.forest(np.array(sorted(codes), dtype=np.uint64), limit)
    mine = {}
    for c, r in zip(found.tolist(), roots.tolist()):
        mine.setdefault(r, set()).add(c)
    want = {}
    for c, r in classes(codes, limit).items():
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_search_adds_up_differences():
    rng = random.Random(3)
    codes = np.array(sorted({rng.getrandbits(64) & 0xFFFFF for _ in range(900)}), dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    q, found = simhash.GrayIndex(codes).search(codes, 2)
    want = {(i, j) for i, a in enumerate(codes.tolist()) for j, b in enumerate(codes.tolist()) if (a ^ b).bit_count() <= 2}
    assert set(zip(q.tolist(), found.tolist())) == want


def test_gray_rank_neighbours_differ_in_one_bit():
    order = np.argsort(simhash.gray_rank(np.arange(64, dtype=np.uint64)))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))


def test_documents(docs_of, odd_pairs):
    docs = docs_of(odd_pairs).withColumn("component_id", F.lit("clash")).withColumn("code", F.lit(0))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd_pairs)
    code = {(i, t): plain(t) for i, t in odd_pairs}
    root = classes(set(code.values()), 2)
    smallest = {}
    for (i, t), c in code.items():
        if i is not None:
            smallest[root[c]] = min(i, smallest.get(root[c], i))
    want = sorted(str((i, plain(t), smallest.get(root[plain(t)]))) for i, t in odd_pairs)
    assert sorted(str((r.doc_id, unsigned(r.code), r.component_id)) for r in rows) == want


def test_deduplicate_keeps_one_of_each(docs_of, odd_pairs):
    docs = docs_of(odd_pairs)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    found = {str(r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert len(ids) == len(found) and ids.count(6) == 0 and ids.count(5) == 1 and ids.count(0) == 1


def test_large_nodes_are_cut_again(spark):
    rng = random.Random(9)
    codes = set()
    while len(codes) < 600:
        c = 0x123456789ABCDEF0
        for _ in range(rng.randint(0, 6)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    frame = spark.createDataFrame([(0, simhash._signed(c)) for c in codes], "t bigint, code bigint")
    links = simhash.links(frame, limit=2, leaf=8)
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    groups, want = {}, {}
    for c, r in classes(codes, 2).items():
        want.setdefault(r, set()).add(c)
        groups.setdefault(found.get(simhash._signed(c), simhash._signed(c)), set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_more_tables_find_near_copies_and_leave_others_alone(docs_of, prose):
    pairs = []
    for i in range(60):
        words = prose(200, i).split()
        pairs.append((i, " ".join(words)))
        for k in (60, 130):
            words[k] = f"changed{i}"
        pairs.append((100 + i, " ".join(words)))
    docs = docs_of(pairs)
    kept = {t: {r.doc_id for r in simhash.deduplicate(docs, tables=t).collect()} for t in (1, 16)}
    assert set(range(60)) <= kept[16] <= kept[1]
    assert len(kept[16]) <= 66


def test_links_of_several_tables_against_brute_force(docs_of, odd_pairs):
    pairs = [(i, t) for i, t in odd_pairs if i is not None]
    codes = {t: simhash.fingerprint((t or "").encode(), 3, 4).tolist() for _, t in pairs}
    texts = list(codes)
    linked = {
        (a, b)
        for a in range(len(texts))
        for b in range(a)
        if any((x ^ y).bit_count() <= 2 for x, y in zip(codes[texts[a]], codes[texts[b]]))
    }
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    smallest = {}
    for i, t in pairs:
        r = root[texts.index(t)]
        smallest[r] = min(i, smallest.get(r, i))
    rows = simhash.near_duplicates(docs_of(pairs), tables=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((i, smallest[root[texts.index(t)]]) for i, t in pairs)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 3), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.deduplicate(docs_of([])).count() == 0
