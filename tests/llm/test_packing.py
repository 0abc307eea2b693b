import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetables.llm import packing


def check_plan(counts, capacity, groups):
    plan = packing.plan_packing(counts, capacity, groups)
    bins = defaultdict(list)
    seen = defaultdict(set)
    for length, first, n, sequence, offset in plan.rows:
        for i in range(n):
            assert first + i not in seen[length]
            seen[length].add(first + i)
            bins[sequence + i].append((offset, length))
    for length, n in enumerate(counts):
        assert seen[length] == set(range(n))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(bins) == set(range(plan.n_sequences))
    return plan.n_sequences


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 9))
def test_plan_is_a_packing(lengths, groups):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, dtype=int)
    n = check_plan(counts, 64, groups)
    assert n >= -(-sum(lengths) // 64)
    # No worse than half full on average, one sequence apart.
    assert n <= 2 * (sum(lengths) // 64 + 1)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.5, 1.0, 20_000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    assert check_plan(counts, 4096, 64) <= 1.02 * lengths.sum() / 4096 + 1


def test_configurations_are_optimal_where_known():
    # 3 + 3 + 4 fills a sequence of 10; 100 of 4 and 200 of 3 need 100.
    sizes, demand = np.array([4, 3]), np.array([100, 200])
    assert sum(n for n, _ in packing.configurations(sizes, demand, 10)) == 100


def test_ids_and_places(docs_of, odd_pairs):
    docs = docs_of([*odd_pairs, (12, "a <|endoftext|> b <|ENDOFTEXT|>x"), (13, "don't, it's; we'll!! x''s")])
    docs = docs.withColumn("piece", F.lit("clash")).withColumn("offset", F.lit(1))
    rows = packing.pack(docs.select("doc_id", "text", "piece", "offset"), keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    texts = defaultdict(list)
    for d in docs.collect():
        texts[d.doc_id].append(d.text or "")
    for doc_id, want in texts.items():
        encoded = sorted(
            [*tokenizer.encode(t, add_special_tokens=False).ids, 1][a : a + 4096]
            for t in want
            for a in range(0, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1, 4096)
        )
        assert sorted(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in own[doc_id]) == encoded
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [0, *ends[:-1]] == [o for o, _ in sorted(b)] and ends[-1] <= 4096


def test_sequences_round_trip(docs_of, prose):
    docs = docs_of([(i, prose(20 + 40 * i, i)) for i in range(12)])
    placed = packing.pack(docs.select("doc_id", "text"), keep_ids=True)
    for r in packing.sequences(placed).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 4 * 4096


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("limit", [1, 50])
def test_small_memory_gives_the_same_ids(prose, limit):
    tight = packing.WordIds(packing.vocabulary_path(), limit)
    wide = packing.WordIds(packing.vocabulary_path())
    for i in range(20):
        raw = prose(60, i).encode()
        assert tight.encode(raw) == wide.encode(raw)


def test_capitals_that_compose_only_when_lowered():
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    words = packing.WordIds(packing.vocabulary_path())
    for letter in ("J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"):
        for text in (letter, letter + "an, Plain. A" + letter, "Latin, Words! " + letter + "' \u00c9t\u00c9, x", "a" + letter + "=\u0338b<\u0338 a=\u0338"):
            got = np.frombuffer(words.encode(text.encode()), "<u4").tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ids_of_random_strings_equal_the_tokenizers():
    path = packing.vocabulary_path()
    plain, words = Tokenizer.from_file(path), packing.WordIds(path, limit=3000)
    rng = random.Random(11)
    pool = [*"abcXYZJHTWKk'.,!=<>-_ \t\n019", "don't", "it's", "5's", "İ", "ß", "é", "É", "ñ", "×", "÷", "«", "»", "—", "…", " ", "　", " "]
    pool += ["ñó", "süß", "à", "ÿ,", "\u0301", "̊", "̸", "⃣", "ͅ", "ẞ", "ΣΑΣ", "中文", "٣", "²", "½", "\U0001f600", "\x1c", "\x85", "ﬁ", "K", "<|endoftext|>", "<|", "ୋ"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(words.encode(t.encode()), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def fewest_bins(lengths, capacity):
    """The exact optimum, by trying every place for every piece."""
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= lengths[i] and room[j] not in room[:j]:
                place(i + 1, [r - lengths[i] * (k == j) for k, r in enumerate(room)])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return best


def test_close_to_the_exact_optimum_of_small_cases():
    rng, extra = random.Random(4), []
    for _ in range(150):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 8))), reverse=True)
        n = check_plan(np.bincount(lengths, minlength=65), 64, 64)
        extra.append(n - fewest_bins(lengths, 64))
    assert min(extra) >= 0 and max(extra) <= 1 and sum(extra) <= 0.05 * len(extra)
