import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetables.llm import token_counts as T


def plain(text, sections, rule):
    """Counts by a loop over single tokens and bytes."""
    tokens = T.tokens_of()
    owner = [k for k, s in enumerate(sections) for _ in range(len(s))]
    counts, at = [0.0] * len(sections), 0
    for i in tokens.encoding.encode_ordinary(text):
        size = len(tokens.encoding.decode_single_token_bytes(i))
        own = owner[at : at + size]
        at += size
        if rule == "start":
            counts[own[0]] += 1
        elif rule == "most":
            counts[max(set(own), key=lambda k: (own.count(k), -k))] += 1
        else:
            for k in own:
                counts[k] += 1 / size
    assert at == len(owner)
    return counts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n\té漢😀.", max_size=12), min_size=1, max_size=5), st.sampled_from(T.RULES))
def test_attribution_against_brute_force(parts, rule):
    text = "".join(parts)
    sections = [p.encode() for p in parts]
    ends, at = [], 0
    for s in sections:
        at += len(s)
        ends.append(at)
    import numpy as np

    found = T.attribute(T.tokens_of().ends(text), np.array(ends), rule)
    assert found == pytest.approx(plain(text, sections, rule))


@pytest.mark.parametrize("rule", T.RULES)
def test_sections_of_documents(docs_of, odd_pairs, rule):
    pairs = [(i, t) for i, t in odd_pairs if t is None or len(t) < 5000] + [(20, "a\n\nb c\r\n"), (21, "é漢\n😀 x")]
    docs = docs_of(pairs).withColumn("section", F.lit("clash"))
    rows = T.count_sections(docs.select("doc_id", "text", "section"), rule=rule).collect()
    want = []
    for i, t in pairs:
        lines = (t or "").encode().split(b"\n")
        sections = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        start = 0
        for k, (s, n) in enumerate(zip(sections, plain(t or "", sections, rule))):
            chars = len(s.decode())
            want.append(str((i, k, start, chars, round(n, 6))))
            start += chars
    assert sorted(str((r.doc_id, r.section, r.start, r.n_chars, round(r.n_tokens, 6))) for r in rows) == sorted(want)


def test_long_texts_add_up(docs_of, prose):
    text = "\n".join(prose(300, i) for i in range(200))
    rows = T.count_sections(docs_of([(1, text)]).select("doc_id", "text")).collect()
    assert len(rows) == 200 and sum(r.n_tokens for r in rows) == len(T.tokens_of().encoding.encode_ordinary(text))


def test_fields(spark):
    frame = spark.createDataFrame([("a title", "some text", None), (None, None, None), ("x", "", "y z")], "title string, body string, note string")
    rows = T.count_fields(frame, ["title", "body", "note"]).collect()
    for r in rows:
        sections = [((r.title or "") + "\n").encode(), ((r.body or "") + "\n").encode(), (r.note or "").encode()]
        want = plain(b"".join(sections).decode(), sections, "start")
        assert [r.n_tokens_title, r.n_tokens_body, r.n_tokens_note] == want and r.n_tokens == sum(want)


def test_empty_table_and_unknown_rule(docs_of):
    assert T.count_sections(docs_of([]).select("doc_id", "text")).count() == 0
    with pytest.raises(ValueError):
        T.count_sections(docs_of([]), rule="none")
