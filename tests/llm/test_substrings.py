import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetables.llm import substrings


def plain(pairs, width):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=24), max_size=6), st.text("ab", max_size=40))
def test_automaton_against_brute_force(passages, probe):
    automaton, width = substrings.Automaton(), 3
    for owner, p in enumerate(passages):
        automaton.add([x.encode() for x in p], owner)
    automaton.settle()
    lengths, owners = automaton.statistics([x.encode() for x in probe], width)
    for end in range(1, len(probe) + 1):
        longest = max((n for n in range(end + 1) if any(probe[end - n : end] in p for p in passages)), default=0)
        assert lengths[end - 1] == longest
        window = probe[max(0, end - width) : end]
        who = [i for i, p in enumerate(passages) if len(window) == width and window in p]
        assert owners[end - 1] == (min(who) if who else substrings.NOBODY)


def corpus(prose):
    rng = random.Random(4)
    passage = prose(70, "p")
    pairs = [(i, prose(60 + i, i)) for i in range(12)]
    pairs += [(20 + i, f"{prose(30, 100 + i)} {passage} {prose(20, 200 + i)}") for i in range(15)]
    pairs += [(40, pairs[3][1]), (41, pairs[3][1]), (42, " ".join(["again"] * 130)), (43, " ".join(["again"] * 51))]
    for i in range(44, 56):
        words = pairs[i % 12][1].split()
        words[rng.randrange(len(words))] = "changed"
        pairs.append((i, " ".join(words)))
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("shard_words", [50_000, 300])
def test_repeats_against_brute_force(docs_of, prose, odd_pairs, shard_words):
    pairs = corpus(prose) + [(1000 + i if i is not None else None, t) for i, t in odd_pairs]
    docs = docs_of(pairs).withColumn("N_removed", F.lit("clash"))
    found = substrings.remove_repeats(docs, shard_words=shard_words)
    rows = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == plain(pairs, 50)
    for r in rows:
        if r.n_removed:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_reference_spans(docs_of, prose, spark):
    passage = prose(60, "bench")
    docs = docs_of([(1, f"{prose(20, 1)} {passage} end"), (2, prose(90, 2)), (3, None), (4, " ".join(passage.split()[:49]))])
    reference = spark.createDataFrame([(passage,), (prose(200, 9),), (None,)], "text string")
    for shard_words in (100, 10_000):
        rows = {r.doc_id: r for r in substrings.remove_reference_spans(docs, reference, shard_words=shard_words).collect()}
        assert [rows[i].n_removed for i in (1, 2, 3, 4)] == [60, 0, 0, 0]
        assert rows[1].text == f"{prose(20, 1)} end"
    with pytest.raises(ValueError):
        substrings.remove_reference_spans(docs, reference, max_reference_words=10)


def test_empty_table(docs_of):
    assert substrings.remove_repeats(docs_of([])).count() == 0
