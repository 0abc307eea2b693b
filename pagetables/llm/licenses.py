"""Licence scan by a trained paragraph classifier.

Paragraphs are the lines of a text and, as notices are wrapped over lines and a line may
grant two licences, the runs of words of the whole text that hold a template. Sparse word 1-, 2- and 3-grams go into a multinomial
logistic regression over licence families and ``unknown``. Only n-grams of the templates are
features, so a paragraph without any is unknown at once. The model is trained on
variants of the templates (other versions, words left out, text before and after) and, as
``unknown``, on a bounded sample of the corpus' own lines and on sentences that speak of
licences without granting one.

The unknown class is calibrated on held-out variants and lines: a family is accepted only
from the probability at which at most ``MAX_FALSE`` of the held-out unknown paragraphs
would be taken for a licence. An accepted paragraph is then compared with the family's
templates; it is confirmed if ``CONFIRM`` of the words of one template stand in it in
order, among them all that name the licence, and if no negation stands one or two words before.
A licence that is worded like a family's but has another name is not confirmed.

A run has at most ``2 n + SLACK`` words for a template of n, across line ends, and is cut
to what the template spans. Runs are looked for where a text has one of the template's
rarest words, so many that a confirmed run cannot do without all of them. A run counts for
its family if the classifier takes its words for that family and its telling words are not
all those of another family's run, so that a notice is not also one of a licence with a
shorter name. Words of other families' runs are left out where the
template does not need them, if the words outside these runs still speak for the family:
that is the second licence of a notice that grants two. A run is numbered by the line it
begins in.

Null and empty texts have no paragraphs, an empty table gives no rows. Texts are scanned whole; a text that
is nothing but licence wording takes milliseconds a word. Of equally probable families the first by
name counts. Repeated rows are scanned each. Input columns
named like output columns are replaced.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, without
from .linear import Logistic

UNKNOWN = "unknown"
SAMPLE_LINES = 4000
MAX_FALSE = 0.001
CONFIRM = 0.7
GRAMS = 3
SLACK = 8
# Words in the templates of so many families at most tell families apart.
TELLING = 3

# Customary short notices of public licences. A number stands for a version.
TEMPLATES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it under the terms of the gnu affero general public license",
        "spdx-license-identifier agpl-3.0-only",
        "spdx-license-identifier agpl-3.0-or-later",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the apache license",
        "spdx-license-identifier apache-2.0",
    ),
    "bsd": (
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "spdx-license-identifier bsd-3-clause",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "cc-by-sa": (
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ),
    "gpl": (
        "licensed under the gnu general public license version 3",
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        "spdx-license-identifier gpl-3.0-only",
        "spdx-license-identifier gpl-3.0-or-later",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 3",
        "you can redistribute it under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-3.0-only",
        "spdx-license-identifier lgpl-3.0-or-later",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "spdx-license-identifier mit",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "spdx-license-identifier mpl-2.0",
    ),
    "public-domain": (
        "this work is released into the public domain",
        "this is free and unencumbered software released into the public domain",
        "spdx-license-identifier cc0-1.0",
    ),
}

# Words of the templates that name a licence. Another licence may share all the rest.
NAMES = frozenset(
    "affero agpl-0-only agpl-0-or-later apache apache-0 attribution attribution-noncommercial attribution-sharealike bsd "
    "bsd-0-clause by by-nc by-sa cc cc0-0 commons domain general gnu gpl-0-only gpl-0-or-later lesser lgpl-0-only lgpl-0-or-later "
    "mit mozilla mpl-0".split()
)
NEGATIONS = frozenset("never neither no nor not without".split())

# Sentences that are no grant of a licence.
OTHER = (
    "a driving license is needed to rent the car",
    "the general public was invited to the work",
    "the committee released the version to the public",
    "she works under the terms of the contract",
    "the license of the restaurant was not renewed",
    "all rights are reserved by the owner",
    "free of charge for any person under twelve",
    "the software is a copy of the source",
    "permission to use the domain was not granted",
    "he moved from mit to another place",
    "apache and mozilla are names of foundations",
    "use of the file in binary forms",
)

_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
_VERSION = re.compile(r"\d+(\.\d+)*")


def tokens(paragraph: str) -> list[str]:
    """Words in lower case, every version number as ``0``."""
    return [_VERSION.sub("0", w) for w in _WORD.findall(paragraph.lower())]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def rare_words(template: list[str], counts: Counter) -> list[str]:
    """The rarest words of a template, one of which is in every run that confirms it."""
    own, out = Counter(template), []
    spare = max(k for k in range(len(template) + 1) if (len(template) - k) / len(template) >= CONFIRM)
    for w in sorted(own, key=lambda w: (counts[w], w)):
        out.append(w)
        spare -= own[w]
        if spare < 0:
            break
    return out


def matched(template: list[str], words: list[str]) -> list[int]:
    """Places of the longest common order of a template and a few words."""
    n, m = len(template), len(words)
    best = np.zeros((n + 1, m + 1), dtype=np.int64)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if template[i] == words[j] else max(best[i + 1, j], best[i, j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if template[i] == words[j]:
            out.append(j)
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def named(template: list[str], words: Iterable[str]) -> bool:
    """Whether the words name the licence that the template names."""
    return NAMES.intersection(template) <= set(words)


def likeness(template: list[str], words: list[str]) -> float:
    """Part of the template's words that stand in the line in the same order; 0 if the line does
    not name the licence or denies something, which is for the runs to look at closely."""
    if not named(template, words) or not NEGATIONS.intersection(words) <= set(template):
        return 0.0
    return in_order(template, words)


def runs(template: list[str], words: list[str], places: list[int]) -> list[tuple[float, list[int]]]:
    """(similarity, places of the matched words) of the runs around ``places`` that
    confirm the template, name its licence and are not denied. They do not overlap."""
    longest, known = 2 * len(template) + SLACK, set(template)
    starts = {s for i in places for s in range(max(0, i - longest + 1), i + 1) if words[s] in known}
    scored = []
    for s in sorted(starts):
        window = words[s : s + longest]
        if not named(template, window):
            continue
        if len(known.intersection(window)) >= CONFIRM * len(known) / 2 and (similarity := in_order(template, window)) >= CONFIRM:
            scored.append((similarity, s))
    out: list[tuple[float, list[int]]] = []
    # The best first, of equal ones the latest start: the shortest run.
    for similarity, s in sorted(scored, reverse=True):
        own = [s + j for j in matched(template, words[s : s + longest])]
        if not named(template, [words[i] for i in own]) or NEGATIONS.intersection(words[max(0, own[0] - 2) : own[0]]):
            continue
        if all(own[-1] < o[0] or o[-1] < own[0] for _, o in out):
            out.append((similarity, own))
    return out


def in_order(template: list[str], words: list[str]) -> float:
    """Part of the template's words that stand in the paragraph in the same order."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    # Longest increasing run of places, a word's places from last to first.
    tails: list[int] = []
    for w in template:
        for i in reversed(places.get(w, ())):
            k = int(np.searchsorted(tails, i))
            tails[k : k + 1] = [i]
    return len(tails) / len(template)


@dataclass
class LicenceModel:
    """``features`` numbers the n-grams; ``threshold`` is what a family's probability
    must reach."""

    families: list[str]
    features: dict[str, int]
    model: Logistic
    threshold: float
    templates: dict[str, list[list[str]]]
    anchors: dict[str, list[tuple[str, int]]] = field(default_factory=dict)

    def __post_init__(self):
        self.first_words = {g for g in self.features if " " not in g}
        holders = Counter(w for ts in self.templates.values() for w in {w for t in ts for w in t})
        self.telling = {w for w, n in holders.items() if n <= TELLING}

    def row(self, words: list[str]) -> np.ndarray:
        known = self.features
        return np.array(sorted(known[g] for g in grams(words) if g in known), dtype=np.int64)

    def scan(self, paragraphs: Iterable[str]) -> list[tuple[str, float, float] | None]:
        """(family, probability, similarity) of each paragraph, None if unknown."""
        return self.scan_words([tokens(p) for p in paragraphs])

    def scan_words(self, split: list[list[str]]) -> list[tuple[str, float, float] | None]:
        out: list[tuple[str, float, float] | None] = [None] * len(split)
        # Without a word of the templates no n-gram of them is there.
        some = [i for i, words in enumerate(split) if not self.first_words.isdisjoint(words)]
        if not some:
            return out
        found = self.model.probabilities([self.row(split[i]) for i in some])
        unknown = self.families.index(UNKNOWN)
        for i, p in zip(some, found):
            best = int(p.argmax())
            if best != unknown and p[best] >= self.threshold:
                family = self.families[best]
                similarity = max(likeness(t, split[i]) for t in self.templates[family])
                out[i] = (family, float(p[best]), similarity)
        return out

    def judge(self, words: list[str]) -> tuple[str, float]:
        """The most likely family, also ``unknown``, and its probability."""
        p = self.model.probabilities([self.row(words)])[0]
        return self.families[int(p.argmax())], float(p.max())

    def scan_runs(self, words: list[str]) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, similarity, first place, last place) of the confirmed
        runs of a text's words, the best of each family where they overlap."""
        places: dict[tuple[str, int], list[int]] = {}
        for i, w in enumerate(words):
            for key in self.anchors.get(w, ()):
                places.setdefault(key, []).append(i)
        found = [(f, x, own) for (f, t), at in places.items() for x, own in runs(self.templates[f][t], words, at)]
        taken, open_ = [], []
        for family, similarity, own in found:
            best, p = self.judge(words[own[0] : own[-1] + 1])
            if best == family and p >= self.threshold:
                taken.append((family, p, similarity, own))
            else:
                open_.append((family, similarity, own))
        first = list(taken)
        for family, similarity, own in open_:
            others = {i for f, _, _, o in first if f != family for i in range(o[0], o[-1] + 1)}
            span = range(own[0], own[-1] + 1)
            outside = [words[i] for i in span if i not in others]
            if len(outside) < len(span) and self.judge(outside)[0] == family:
                needed = set(own)
                best, p = self.judge([words[i] for i in span if i in needed or i not in others])
                if best == family and p >= self.threshold:
                    taken.append((family, p, similarity, own))
        out: list[tuple[str, float, float, int, int]] = []
        told: dict[int, str] = {}
        telling = [{i for i in hit[3] if words[i] in self.telling} for hit in taken]
        # The run with the most telling words first. One whose telling words all tell of
        # another family already is that family's notice.
        for k in sorted(range(len(taken)), key=lambda k: (-len(telling[k]), -taken[k][2], -taken[k][1], taken[k][3])):
            family, p, similarity, own = taken[k]
            if telling[k] and all(told.get(i, family) != family for i in telling[k]):
                continue
            if all(o[0] != family or o[4] < own[0] or own[-1] < o[3] for o in out):
                out.append((family, p, similarity, own[0], own[-1]))
                told.update((i, family) for i in telling[k] if i not in told)
        return out

    def scan_text(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, similarity) of all lines and runs, in order. A
        run stands for its family's lines within it, unless one of them is confirmed."""
        split = [tokens(p) for p in text.split("\n")]
        lines = {(i, h[0]): h[1:] for i, h in enumerate(self.scan_words(split)) if h}
        for (i, family), (p, _) in lines.items():
            # What the line before denies is for the runs to look at.
            if i and NEGATIONS.intersection(split[i - 1][-2:]):
                lines[i, family] = (p, 0.0)
        words = [w for line in split for w in line]
        if not self.anchors.keys() & set(words):
            return [(i, f, *x) for (i, f), x in lines.items()]
        line_of = [i for i, line in enumerate(split) for _ in line]
        for family, p, similarity, a, b in self.scan_runs(words):
            within = [(i, family) for i in range(line_of[a], line_of[b] + 1) if (i, family) in lines]
            if not any(lines[k][1] >= CONFIRM for k in within):
                for k in within:
                    del lines[k]
                lines[line_of[a], family] = (p, similarity)
        return sorted((i, f, *x) for (i, f), x in lines.items())


def _variants(rng: random.Random, filler: list[list[str]], n: int) -> list[tuple[str, list[str]]]:
    out = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = tokens(template)
            out.append((family, words))
            for _ in range(n):
                own = [w for w in words if rng.random() > 0.05]
                before, after = (rng.choice(filler)[: rng.choice((0, 0, 4, 12))] for _ in "ab")
                out.append((family, before + own + after))
    return out


def train(lines: list[str], seed: int = 11) -> LicenceModel:
    """The model, with the given corpus lines as unknown paragraphs. Lines that hold a
    whole template are left out of them."""
    rng = random.Random(seed)
    templates = {f: [tokens(t) for t in ts] for f, ts in TEMPLATES.items()}
    every = [t for ts in templates.values() for t in ts]
    split = [tokens(p) for p in lines]
    plain = [w for w in split if w and not any(set(t) <= set(w) for t in every)]
    other = [tokens(p) for p in OTHER]
    filler = (plain or other)[:500]
    vocabulary = sorted(set().union(*(grams(t) for t in every)))
    features = {g: i for i, g in enumerate(vocabulary)}
    families = [UNKNOWN, *TEMPLATES]
    made = _variants(rng, filler, 24)
    unknown = plain + other * 10
    rows = [(families.index(f), w) for f, w in made] + [(0, w) for w in unknown]
    rng.shuffle(rows)
    empty = Logistic(np.zeros((len(features), len(families))), np.zeros(len(families)))
    counts, anchors = Counter(w for words in plain for w in words), {}
    for family, own in templates.items():
        for k, template in enumerate(own):
            for w in rare_words(template, counts):
                anchors.setdefault(w, []).append((family, k))
    model = LicenceModel(families, features, empty, 0.0, templates, anchors)
    x, y = [model.row(w) for _, w in rows], np.array([c for c, _ in rows])
    held = np.arange(len(rows)) % 4 == 0
    kept = np.flatnonzero(~held)
    model.model = Logistic.fit([x[i] for i in kept], y[kept], len(features), len(families), penalty=1e-5, rounds=300, rate=0.2)
    test = np.flatnonzero(held)
    p = model.model.probabilities([x[i] for i in test])
    taken = np.sort(p[:, 1:].max(axis=1)[y[test] == 0])[::-1]
    allowed = int(MAX_FALSE * len(taken))
    model.threshold = max(0.5, float(taken[allowed]) + 1e-6 if len(taken) else 0.5)
    return model


def sample_lines(docs: DataFrame, text: str = "text", lines: int = SAMPLE_LINES) -> list[str]:
    """At most so many lines: the last line and one by hash of the documents whose texts hash lowest."""
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"))
    picked = sampled(texts, F.col("t"), lines // 2)
    two = "array(l[size(l) - 1], l[pmod(xxhash64(t), size(l))])"
    rows = picked.withColumn("l", F.split("t", "\n")).select(F.expr(two).alias("l")).collect()
    return [p for r in rows for p in r.l if p]


def scan(docs: DataFrame, text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """The documents with ``licences``: for each line or run that a family was accepted
    for, the number of its (first) line, family, probability, similarity and confirmed."""
    model = model or train(sample_lines(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(
        pa.struct(
            [
                ("paragraph", pa.int32()),
                ("family", pa.string()),
                ("probability", pa.float64()),
                ("similarity", pa.float64()),
                ("confirmed", pa.bool_()),
            ]
        )
    )

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found = [
                {"paragraph": i, "family": family, "probability": p, "similarity": similarity, "confirmed": similarity >= CONFIRM}
                for i, family, p, similarity in shared.value.scan_text(text or "")
            ]
            out.append(found)
        return pa.array(out, kind)

    spark_type = "array<struct<paragraph: int, family: string, probability: double, similarity: double, confirmed: boolean>>"
    scanner = F.arrow_udf(of, spark_type).asNondeterministic()
    return without(docs, "licences").withColumn("licences", scanner(F.col(text).cast("string")))
