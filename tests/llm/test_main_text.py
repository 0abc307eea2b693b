import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetables.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="page-with-sidebar"><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<header>Site of things</header><div class="ad">Buy the thing now and save.</div>
<{open}><h1>The &amp; title</h1><p>First &eacute; paragraph with
 several words, which <b>goes on</b> for a while.<p>Second one,<br>broken, with <a href=x>one link</a> in it and more.
<blockquote>A quoted sentence of some length.</blockquote></{close}>
<aside>See also our other pages.</aside><form><button>Send</button></form>
<div id="comments"><p>I liked this very much, said a reader in a long sentence.</p></div>
<footer>&copy; all of us {n}</footer>"""
TEXT = (
    "The & title First é paragraph with several words, which goes on for a while. "
    "Second one, broken, with one link in it and more. A quoted sentence of some length."
)


def pages(spark, opening="article"):
    rows = [(i, "u", PAGE.format(open=opening, close=opening.split()[0], n=i)) for i in range(30)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.mark.parametrize("opening", ["article", "main", 'div class="post-content"'])
def test_main_text(spark, opening):
    # The markup of half of the pages tells what content is; the others have to be guessed.
    model = M.train(pages(spark))
    rows = M.extract_main_text(pages(spark, opening), model=model).collect()
    assert {r.text for r in rows} == {TEXT}
    assert {r.n_chars for r in rows} == {len(TEXT)}


def test_odd_pages(spark):
    long = "<article>" + "<p>word word word.</p>" * 5000 + "</article>"
    rows = [(1, None), (2, ""), (3, "<"), (4, "plain text only"), (5, "<article><p>a&nbsp;b</p>"), (None, "<b"), (6, long), (6, long)]
    frame = spark.createDataFrame([(i, "u", h, "clash") for i, h in rows], "page_id bigint, url string, html string, TEXT string")
    found = M.extract_main_text(frame, model=M.train(pages(spark))).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows) and by[1].text == by[2].text == "" and by[1].n_chars == 0
    assert by[5].text == "a b" and by[6].n_chars == 5000 * 16 - 1
    assert M.extract_main_text(frame.where("false")).count() == 0


def test_blocks():
    found = M.blocks_of("<div>a<p>b <i>c</i><p>d<ul><li>e<li>f</ul>g</div><a href=x>hh</a>&lt;i&gt;")
    assert [b.text for b in found] == ["a", "b c", "d", "e", "f", "g", "hh<i>"]
    assert found[-1].linked == 2


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_minimum_cut_against_brute_force(data):
    n = data.draw(st.integers(1, 6))
    costs = st.lists(st.integers(0, 9), min_size=n, max_size=n)
    content, other = (np.array(data.draw(costs)) for _ in "ab")
    edges = [(i, j, data.draw(st.integers(0, 6))) for i, j in itertools.combinations(range(n), 2)]

    def cost(side):
        own = sum(int(o) if s else int(c) for s, c, o in zip(side, content, other))
        return own + sum(c for a, b, c in edges if side[a] != side[b])

    best = min(cost(side) for side in itertools.product((False, True), repeat=n))
    assert cost(M.minimum_cut(content, other, edges)) == best


def test_smoothness_flips_a_doubtful_block():
    content, other = np.array([1000, 40, 1000]), np.array([10, 60, 10])
    assert M.minimum_cut(content, other, []).tolist() == [True, False, True]
    assert M.minimum_cut(content, other, [(0, 1, 50), (1, 2, 50)]).tolist() == [True, True, True]


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\"", "<!--", "<script ", "<!", "</", '<a x="\'>', "<div>", "<i>", "<div></i>", "<p>a "])
def test_hostile_pages_take_linear_time(unit):
    start = time.perf_counter()
    M.blocks_of(unit * (2_000_000 // len(unit)))
    # A quadratic reader takes hours.
    assert time.perf_counter() - start < 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("< </ > \" ' a p div i script <!-- --> <! / = x <p> </p> <div> </div> </script> <i> </i> text".split()), max_size=40))
def test_pieces_are_those_of_one_pattern(bits):
    page = " ".join(bits).replace(" a", "a")
    pattern = re.compile(
        r"<!--.*?(?:-->|\Z)|<(script)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
        r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
        re.S | re.I,
    )
    expected = []
    for m in pattern.finditer(page):
        if m[3]:
            expected.append((m[3].lower(), m[4], bool(m[2])))
        elif m[1] is None and not m[0].startswith(("<!", "<?")):
            expected.append((None, m[0], False))
    assert list(M._Scanner(page).pieces()) == expected


def test_smoothness_is_stronger_the_deeper_the_common_path():
    blocks = M.blocks_of("<div><ul><li>a<li>b</ul><p>c</div><p>d")
    assert [(b.depth, b.shared) for b in blocks] == [(3, 0), (3, 2), (2, 1), (1, 0)]
    costs = {(i, j): c for i, j, c in M.smoothness(blocks, 1.0)}
    assert costs[0, 1] == int(1000 * (0.2 + 0.8 * 2 / 3)) and costs[1, 2] == int(1000 * (0.2 + 0.8 / 3)) and costs[2, 3] == 200
