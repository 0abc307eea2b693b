"""Main text of web pages by minimum-cut labelling.

A page becomes a list of blocks: stretches of text between block-level tags, each with the
path of elements it stands in. A logistic regression over features of the block and its
path gives the probability that a block is content. The costs of the two labels become
capacities from the source and to the sink; blocks next to each other, and blocks with
one parent element, are joined by edges that cost something if their labels differ,
the more the deeper their common path. The minimum cut, found by augmenting paths level by
level, is the cheapest labelling of the whole page; its source side is the main text.

The classifier is trained on a bounded sample of the pages themselves, with the page
authors' own markup as labels: blocks inside an article or main element are content,
blocks in navigation, headers, footers, asides, forms and the like are not. Every sample
block is used twice, once without the markup features, so that pages without such
elements are judged by text, links and class names.

Null and empty pages have an empty text; an empty table gives an empty table. Pages are read
whole in time linear in their length, also where tags, quotes, comments or elements are left
open or stand inside each other by the thousand. A page's labelling does not depend on other
rows, and of equally cheap cuts it takes the one with the fewest blocks of main text. Repeated rows are extracted each. Input columns named
like output columns are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, without
from .linear import Logistic

TRAIN_PAGES = 400
SMOOTH = 0.35
SCALE = 1000

# Elements by what they say about their content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu fieldset".split())
BAD_NAMES = re.compile(
    r"(?<![a-z])(ad|ads|advert\w*|banner|promo\w*|sponsor\w*|sidebar|side|menu|nav\w*|breadcrumb\w*|footer|foot|header|masthead|"
    r"comment\w*|reply|replies|respond|disqus|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscri\w*|signup|login|"
    r"share|sharing|social|related|recommend\w*|widget\w*|toolbar|copyright|legal|search|pagination|pager|tags?)(?![a-z])"
)
GOOD_NAMES = re.compile(r"(?<![a-z])(article\w*|content|post|entry|story|body|main|text|prose|page)(?![a-z])")

_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe|textarea|title)\b", re.I)
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_SPECIAL = re.compile("[>\"']")
_NAMES = re.compile(
    r"(?<![a-z])(ad|ads|advert\w*|banner|promo\w*|sponsor\w*|sidebar|side|menu|nav\w*|breadcrumb\w*|footer|foot|header|masthead|"
    r"comment\w*|reply|replies|respond|disqus|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscri\w*|signup|login|"
    r"share|sharing|social|related|recommend\w*|widget\w*|toolbar|copyright|legal|search|pagination|pager|tags?)(?![a-z])"
)
GOOD_NAMES = re.compile(r"(?<![a-z])(article\w*|content|post|entry|story|body|main|text|prose|page)(?![a-z])")

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    text: str
    tag: str
    depth: int  # block-level elements around it,
    element: int  # the number of the innermost (0: none)
    parent: int  # and of the one around that (0: none)
    shared: int  # elements that are also around the block before
    linked: int
    good: int
    bad: int
    content: bool
    boilerplate: bool


class _Element:
    __slots__ = ("tag", "number", "place", "block", "outer", "depth", "good", "bad", "content", "boilerplate", "linked")

    def __init__(self, tag: str, number: int, place: int, names: str, above: _Element | None):
        good, bad = (bool(GOOD_NAMES.search(names)), bool(BAD_NAMES.search(names))) if names else (False, False)
        # Names of wrappers, such as content-with-sidebar, say nothing of what is inside.
        if (good and bad) or tag in ("html", "body", "article", "main"):
            good = bad = False
        self.tag, self.number, self.place = tag, number, place
        # The innermost block-level element here, the one around this element, and how many there are.
        self.outer = above.block if above else None
        self.block = self if tag in BLOCKS else self.outer
        self.depth = (above.depth if above else 0) + (tag in BLOCKS)
        self.good = (above.good if above else 0) + good
        self.bad = (above.bad if above else 0) + bad
        self.content = tag in CONTENT or bool(above and above.content)
        self.boilerplate = tag in BOILERPLATE or bool(above and above.boilerplate)
        self.linked = tag == "a" or bool(above and above.linked)


class _Scanner:
    """Cuts a page into text and tags, each place of the page read a bounded number of times
    however many tags, quotes or comments are left open."""

    def __init__(self, page: str):
        self.page = page
        self.following: dict[str, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}

    def after(self, what: str, at: int) -> int:
        """Where ``what`` comes next at or after ``at``, -1 if nowhere. Asked for growing
        places, so that the last answer holds up to the place it names."""
        since, found = self.following.get(what, (0, -2))
        if found == -2 or (found != -1 and not since <= at <= found) or at < since:
            found = self.page.find(what, at)
            self.following[what] = (at, found)
        return found

    def special(self, at: int) -> int:
        """The next of > and the quotes at or after ``at``, -1 if there is none."""
        since, found = self.following.get("special", (0, -2))
        if found == -2 or (found != -1 and not since <= at <= found) or at < since:
            m = _SPECIAL.search(self.page, at)
            found = m.start() if m else -1
            self.following["special"] = (at, found)
        return found

    def end_of_tag(self, at: int) -> int:
        """The > that ends a tag whose attributes begin at ``at``, outside of quotes; -1 if the
        tag or a quote in it stays open. What is known of a quote is kept for later tags."""
        page, ends, seen = self.page, self.ends, []
        place = self.special(at)
        while place >= 0 and page[place] != ">" and place not in ends:
            seen.append(place)
            closing = page.find(page[place], place + 1)
            if closing < 0:
                place = -1
            else:
                m = _SPECIAL.search(page, closing + 1)
                place = m.start() if m else -1
        end = ends.get(place, place)
        for quote in seen:
            ends[quote] = end
        return end

    def pieces(self) -> Iterator[tuple[str | None, str, bool]]:
        """(tag, its attributes, whether it ends an element) or (None, text, False); comments,
        declarations and elements whose content is no text are left out."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            if page[at] != "<":
                stop = page.find("<", at)
                stop = n if stop < 0 else stop
                yield None, page[at:stop], False
                at = stop
            elif page.startswith("<!--", at):
                stop = self.after("-->", at + 4)
                at = n if stop < 0 else stop + 3
            elif page.startswith(("<!", "<?"), at):
                stop = self.after(">", at + 2)
                if stop < 0:
                    yield None, "<", False
                at = at + 1 if stop < 0 else stop + 1
            else:
                m = _TAG.match(page, at)
                stop = self.end_of_tag(m.end()) if m else -1
                if stop < 0:
                    yield None, "<", False
                    at += 1
                    continue
                raw = _RAW.match(page, at)
                if raw:
                    closed = re.compile(rf"</{re.escape(raw[1])}\s*+>", re.I).search(page, stop + 1)
                    at = closed.end() if closed else n
                else:
                    yield m[2].lower(), page[m.end() : stop], bool(m[1])
                    at = stop + 1


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in page order."""
    out: list[Block] = []
    stack: list[_Element] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = number = lowest = 0

    def close() -> None:
        nonlocal linked, lowest
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else None
            block = top.block if top else None
            depth = top.depth if top else 0
            out.append(
                Block(
                    text,
                    block.tag if block else "",
                    depth,
                    block.number if block else 0,
                    block.outer.number if block and block.outer else 0,
                    lowest,
                    min(linked, len(text)),
                    top.good if top else 0,
                    top.bad if top else 0,
                    bool(top and top.content),
                    bool(top and top.boilerplate),
                )
            )
            lowest = depth
        parts.clear()
        linked = 0

    def leave(place: int) -> None:
        nonlocal lowest
        for element in reversed(stack[place:]):
            places[element.tag].pop()
        del stack[place:]
        lowest = min(lowest, stack[-1].depth if stack else 0)

    for tag, piece, ends in _Scanner(page).pieces():
        if tag is None:
            parts.append(piece)
            if stack and stack[-1].linked:
                linked += len(piece)
            continue
        if ends:
            if tag in BLOCKS:
                close()
            around = stack[-1].block if stack else None
            # An inline end tag does not reach over a block.
            if places.get(tag) and (tag in BLOCKS or around is None or places[tag][-1] > around.place):
                leave(places[tag][-1])
        else:
            if tag in BLOCKS:
                close()
                # A paragraph or list item ends where the next block begins.
                around = stack[-1].block if stack else None
                if around is not None and (around.tag == "p" or around.tag == tag == "li"):
                    leave(around.place)
            elif tag == "br":
                parts.append(" ")
            if tag not in VOID and not piece.endswith("/"):
                number += 1
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(piece)).lower() if piece else ""
                places.setdefault(tag, []).append(len(stack))
                stack.append(_Element(tag, number, len(stack), names, stack[-1] if stack else None))
    close()
    return out


# Features of a block; those up to MARKUP come from the markup and are left out of the second copy.
FEATURES = (
    "in_content in_boilerplate good_name bad_name paragraph heading item cell other_tag words_0 words_4 words_12 words_40 words_100 "
    "no_links some_links mostly_links all_links full_stop no_stop first_block last_block symbol"
).split()
MARKUP = 2
_PLACE = {f: i for i, f in enumerate(FEATURES)}


def features(blocks: list[Block]) -> list[np.ndarray]:
    """Features of each block: numbers of those that hold."""
    out = []
    for i, b in enumerate(blocks):
        words, density = b.text.count(" ") + 1, b.linked / len(b.text)
        own = [
            f
            for f, holds in (
                ("in_content", b.content),
                ("in_boilerplate", b.boilerplate),
                ("good_name", b.good > 0),
                ("bad_name", b.bad > 0),
                ("first_block", i == 0),
                ("last_block", i == len(blocks) - 1),
                ("symbol", "©" in b.text),
            )
            if holds
        ]
        own.append(
            "paragraph" if b.tag in ("p", "pre", "blockquote")
            else "heading" if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            else "item" if b.tag in ("li", "dt", "dd")
            else "cell" if b.tag in ("td", "th")
            else "other_tag"
        )
        own.append(next(f"words_{n}" for n in (100, 40, 12, 4, 0) if words >= n))
        own.append("no_links" if not density else "some_links" if density < 0.5 else "mostly_links" if density < 0.95 else "all_links")
        own.append("full_stop" if b.text[-1] in ".!?\"'”»)" else "no_stop")
        out.append(np.array(sorted(_PLACE[f] for f in own), dtype=np.int64))
    return out


def minimum_cut(content: np.ndarray, other: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """Which nodes stand on the source side. ``content`` is what it costs to cut a node
    from the source, ``other`` from the sink; an edge costs its capacity if its ends part.

    What flows straight through a node is taken off first. The rest is pushed along
    shortest paths, one level graph after another."""
    n = len(content)
    excess = (content - other).tolist()
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(excess):
        if x > 0:
            arc(source, i, x, 0)
        elif x < 0:
            arc(i, sink, -x, 0)
    for a, b, c in edges:
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level[:n]], dtype=bool)
        at = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                cut = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            else:
                if not path:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]


def smoothness(blocks: list[Block], smooth: float = SMOOTH) -> list[tuple[int, int, int]]:
    """Edges between neighbours and between blocks of one parent, with capacities."""
    out, last_child = [], {}
    for i, b in enumerate(blocks):
        near = {i - 1: b.shared} if i else {}
        if b.parent in last_child:
            j = last_child[b.parent]
            near[j] = max(0, b.depth - 1) + (b.element == blocks[j].element != 0)
        for j, common in near.items():
            share = common / max(1, b.depth, blocks[j].depth)
            out.append((j, i, int(SCALE * smooth * (0.2 + 0.8 * share))))
        last_child[b.parent] = i
    return out


def label(blocks: list[Block], model: Logistic, smooth: float = SMOOTH) -> np.ndarray:
    """Which blocks are main text."""
    if not blocks:
        return np.empty(0, bool)
    p = np.clip(model.probabilities(features(blocks))[:, 1], 1e-4, 1 - 1e-4)
    costs = (-SCALE * np.log(np.stack([1 - p, p]))).astype(np.int64)
    return minimum_cut(costs[0], costs[1], smoothness(blocks, smooth))


def main_text(page: str | None, model: Logistic) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(blocks, label(blocks, model)) if keep)


def train(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Logistic:
    """The classifier, from the ``train_pages`` pages whose texts hash lowest. Blocks that
    neither kind of element encloses are not used, nor pages without both kinds of
    blocks; bad names count as boilerplate, also inside an article."""
    kind = pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("content", pa.bool_())]))

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for page in texts.to_pylist():
            blocks = blocks_of(page or "")
            rows = []
            for b, f in zip(blocks, features(blocks)):
                bad = b.boilerplate or b.bad > 0
                if b.content or bad:
                    rows.append({"f": f.tolist(), "content": not bad})
            out.append(rows if len({r["content"] for r in rows}) == 2 else [])
        return pa.array(out, kind)

    texts = pages.where(F.col(html).isNotNull()).select(F.col(html).cast("string").alias("t"))
    sample = sampled(texts, F.col("t"), train_pages)
    reader = F.arrow_udf(of, "array<struct<f: array<int>, content: boolean>>").asNondeterministic()
    # One row per distinct set of features: a bounded number, with its count.
    rows = (
        sample.select(F.explode(reader("t")).alias("b")).groupBy("b.f", "b.content").agg(F.count("*").alias("n")).collect()
    )
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r.f, r.content)):
        f = np.array(r.f, dtype=np.int64)
        for own in (f, f[f >= MARKUP]):
            x.extend([own] * r.n)
            y.extend([int(r.content)] * r.n)
    # What the names of the elements mean, for kinds that the sample lacks.
    known = [(("in_content", "paragraph"), 1), (("in_content", "heading"), 1), (("in_boilerplate",), 0), (("bad_name",), 0), (("good_name", "paragraph"), 1)]
    known += [(("in_content", "bad_name"), 0), (("in_content", "in_boilerplate"), 0), (("all_links", "item"), 0), (("symbol",), 0)]
    known += [(("paragraph", "no_links", "full_stop", "words_40"), 1), (("other_tag", "no_links", "full_stop", "words_100"), 1)]
    for names, content in known:
        weight = max(20, len(x) // 100)
        x.extend([np.array(sorted(_PLACE[f] for f in names), dtype=np.int64)] * weight)
        y.extend([content] * weight)
    return Logistic.fit(x, np.array(y), len(FEATURES), 2, penalty=1e-5, rounds=150)


def extract_main_text(pages: DataFrame, html: str = "html", model: Logistic | None = None) -> DataFrame:
    """The other columns with ``text`` and ``n_chars``, its characters."""
    model = model or train(pages, html)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([main_text(t, shared.value) for t in texts.to_pylist()], pa.string())

    own = [F.col(f"`{c}`") for c in without(pages, html, "text", "n_chars").columns]
    found = F.arrow_udf(of, "string").asNondeterministic()(F.col(html).cast("string"))
    return pages.select(*own, found.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
