from collections import Counter

from pyspark.sql import functions as F

from pagetables.llm import quality


def plain(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


def test_measures_and_base(docs_of, odd_pairs):
    docs = docs_of(odd_pairs).withColumn("kept", F.lit("clash")).withColumn("N_WORDS", F.lit(-1))
    rows = quality.judge(docs, measures=quality.MEASURES).collect()
    assert len(rows) == len(odd_pairs)
    want = Counter((i, *plain(t).items()) for i, t in odd_pairs)
    assert Counter((r.doc_id, *((m, r[m]) for m in quality.MEASURES)) for r in rows) == want
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed
        assert not (failed and r.kept)
        assert r.kept == (r.rejected_by is None)


def test_order_changes_cost_not_verdict(docs_of, odd_pairs):
    docs = docs_of(odd_pairs)
    both = [
        sorted(str((r.doc_id, r.kept)) for r in quality.judge(docs, rules=rules).collect())
        for rules in (quality.RULES, quality.RULES[::-1])
    ]
    assert both[0] == both[1]


def test_cascade_puts_rejection_per_cost_first(docs_of, prose):
    def slow(t):
        return sum(i for i in range(20_000)) < 0 or t.n_words > 5

    rules = [
        quality.Rule("slow", slow),
        quality.Rule("never", lambda t: False),
        quality.Rule("quick", lambda t: t.n_words > 5),
    ]
    docs = docs_of([(i, prose(30, i)) for i in range(60)])
    assert quality.plan_cascade(docs, rules)[0].name == "quick"


def test_stops_at_the_first_rejection(docs_of):
    rules = [quality.Rule("few", lambda t: t.n_words < 10), quality.Rule("boom", lambda t: t.n_words < 10 and 1 // 0 == 0)]
    found = [next(r.name for r in rules if r.rejects(quality.Text(b"x")))]
    assert found == ["few"]


def test_empty_table(docs_of):
    assert quality.judge(docs_of([]), measures=quality.MEASURES).count() == 0
