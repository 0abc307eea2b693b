"""Quality rules as a short-circuit cascade.

Every rule is timed and tried on a bounded sample of the documents. The rules are
then ordered by documents rejected per second, each next rule judged only on the
sample documents that the rules before it let through. In the pass over all
documents a document leaves the cascade at the first rule that rejects it; the
verdict does not depend on the order, only the time does.

Null and empty texts have no words. Repeated rows get the same verdict each. Input
columns named like an output column are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, raw_texts, split_words, without

SAMPLE_ROWS = 2000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Windows are numbered exactly: a window's number and its next word make the
    # number of the window that is one word longer.
    window = ids
    for k in range(1, width):
        pairs = window[: len(ids) - k] * len(numbers) + ids[k:]
        distinct, window = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
    counts = np.bincount(window)
    return int(covered(np.flatnonzero(counts[window] > 1), width, len(words)).sum())


class Text:
    """A document whose measures are taken when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return split_words(self.raw)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = np.frombuffer(b"".join(self.words), np.uint8)
        return int(np.count_nonzero((joined & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (bytes([s]) for s in SYMBOLS)))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r"))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return count_repeat_words(self.words)

    @cached_property
    def n_shouted(self) -> int:
        return sum(map(self.raw.count, (b"!!", b"??")))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text breaks the rule. ``base`` rules are those the
    base verdict is made of."""

    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda t: t.n_words < 10, base=True),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words, base=True),
    Rule("symbols", lambda t: 2 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("shouting", lambda t: 2 * t.n_shouted > t.n_words),
)


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS):
    """The rules in the order of the cascade: most sample documents rejected per
    second first. At most about ``sample_rows`` documents are tried."""
    n = docs.count()
    tried = docs.select(F.col(text).cast("string").alias("text"))
    if n > sample_rows:
        tried = tried.sample(sample_rows / n, seed=7)

    def measure(batches):
        for batch in batches:
            raws = list(raw_texts(batch.column(0)))
            hit, spent = [], []
            for rule in rules:
                start = time.thread_time_ns()
                hit.append([rule.rejects(Text(r)) for r in raws])
                spent.append((time.thread_time_ns() - start) // max(1, len(raws)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(h) for h in zip(*hit)], pa.list_(pa.bool_())),
                    pa.array([spent] * len(raws), pa.list_(pa.int64())),
                ],
                names=["hit", "spent"],
            )

    rows = tried.mapInArrow(measure, "hit array<boolean>, spent array<bigint>").collect()
    if not rows:
        return list(rules)
    hit = np.array([r.hit for r in rows], dtype=bool)
    cost = np.array([r.spent for r in rows], dtype=float).mean(axis=0) + 1.0
    order, left, alive = [], list(range(len(rules))), np.ones(len(hit), bool)
    while left:
        best = max(left, key=lambda i: (hit[alive, i].mean() / cost[i] if alive.any() else 0.0, -cost[i]))
        order.append(best)
        left.remove(best)
        alive &= ~hit[:, best]
    return [rules[i] for i in order]


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    measures: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The documents with ``kept``, ``rejected_by`` (the first rule of the cascade
    that rejects, null if kept), ``base_failed`` where measures are asked for, and the
    ``measures`` themselves, which are then taken of every document.

    Without ``measures`` a rejected document costs no more than the rules up to the
    one that rejects it."""
    order = plan_cascade(docs, rules, text, sample_rows)
    measures = tuple(measures)
    kind = pa.struct(
        [
            ("kept", pa.bool_()),
            ("rejected_by", pa.string()),
            *([("base_failed", pa.bool_())] if measures else []),
            *[(m, pa.int64()) for m in measures],
        ]
    )

    def verdicts(texts: pa.Array) -> pa.Array:
        out = []
        for raw in raw_texts(texts):
            t = Text(raw)
            by = next((r.name for r in order if r.rejects(t)), None)
            row = {"kept": by is None, "rejected_by": by}
            if measures:
                row["base_failed"] = any(r.rejects(t) for r in rules if r.base)
                row |= {m: getattr(t, m) for m in measures}
            out.append(row)
        return pa.array(out, kind)

    names = [f.name for f in kind]
    fields = ", ".join(f"{f.name}: {({pa.bool_(): 'boolean', pa.string(): 'string'}).get(f.type, 'bigint')}" for f in kind)
    verdict = F.arrow_udf(verdicts, f"struct<{fields}>").asNondeterministic()
    judged = without(docs, "_verdict").withColumn("_verdict", verdict(F.col(text).cast("string")))
    return judged.select(*without(judged, "_verdict", *names).columns, *[F.col(f"_verdict.{n}").alias(n) for n in names])
