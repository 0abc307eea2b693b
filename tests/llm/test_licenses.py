import random

import pytest
from pyspark.sql import functions as F

from pagetables.llm import licenses


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(1)
    words = "the of and a house river work under version public terms free general source by license".split() + [
        "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)
    ]
    return [" ".join(rng.choices(words, k=rng.randint(2, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def model(lines):
    return licenses.train(lines[:1000])


FOUND = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "You can redistribute it under the terms of the GNU Lesser General Public License": "lgpl",
    "SPDX-License-Identifier: Apache-2.0": "apache",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License": "cc-by-sa",
}


def test_families(model):
    hits = model.scan(FOUND)
    assert [h and h[0] for h in hits] == list(FOUND.values())
    assert all(h[2] >= licenses.CONFIRM for h in hits)


def test_held_out_lines_stay_unknown(model, lines):
    assert sum(h is not None for h in model.scan(lines[1000:])) <= 1
    assert not any(model.scan(["", "   ", *licenses.OTHER]))


def test_held_out_variants(model, lines):
    filler = [licenses.tokens(x) for x in lines[:50]]
    made = licenses._variants(random.Random(99), filler, 6)
    hits = model.scan([" ".join(w) for _, w in made])
    right = sum(h is not None and h[0] == f for h, (f, _) in zip(hits, made))
    assert right >= 0.93 * len(made)


def test_similarity_is_the_longest_common_order():
    assert licenses.in_order(["a", "b", "c"], ["x", "a", "c", "b", "c"]) == 1
    assert licenses.in_order(["a", "b", "c", "d"], ["d", "c", "b", "a"]) == 0.25
    assert licenses.in_order(["a"], []) == 0


def test_scan(docs_of, odd_pairs):
    pairs = odd_pairs + [(50 + i, f"some text here\n{line}\nmore") for i, line in enumerate(FOUND)]
    rows = licenses.scan(docs_of(pairs).withColumn("Licences", F.lit("clash"))).collect()
    assert len(rows) == len(pairs)
    got = {r.doc_id: [(x.paragraph, x.family, x.confirmed) for x in r.licences] for r in rows}
    for i, family in enumerate(FOUND.values()):
        assert got[50 + i] == [(1, family, True)]
    assert all(not got[i] for i, _ in odd_pairs)


def test_empty_table(docs_of):
    assert licenses.scan(docs_of([])).count() == 0


NOTICES = {
    " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General "
    "Public License as published by\n * the Free Software Foundation": {(0, "gpl")},
    "Intro\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License\nend": {(1, "cc-by-sa")},
    "# you can redistribute it under the terms\n#\n# of the GNU Lesser General\n# Public License": {(0, "lgpl")},
    "x\nLicensed under the MIT License or the Apache License, Version 2.0": {(1, "mit"), (1, "apache")},
    "Licensed under either the Apache License, Version 2.0 or the MIT License.": {(0, "apache"), (0, "mit")},
    "Released under the BSD License. This work is released into the public domain.": {(0, "bsd"), (0, "public-domain")},
    "This work is licensed under the GNU\nAffero General Public License version 3": {(0, "agpl")},
    "Permission is hereby\ngranted, free of charge, to any\nperson obtaining a copy of this software\n\nand\n\n"
    "SPDX-License-Identifier: MPL-2.0": {(0, "mit"), (6, "mpl")},
}


@pytest.mark.parametrize("notice", NOTICES)
def test_wrapped_and_double_notices(model, notice):
    found = model.scan_text(notice)
    assert {(i, f) for i, f, _, x in found if x >= licenses.CONFIRM} == NOTICES[notice]


def test_held_out_texts_stay_unknown(model, lines):
    found = [h for i in range(1000, 1500, 10) for h in model.scan_text("\n".join(lines[i : i + 10]))]
    assert len(found) <= 1
    assert not model.scan_text("\n".join(licenses.OTHER))


def test_a_confirmed_run_has_a_rare_word():
    for template in (licenses.tokens(t) for ts in licenses.TEMPLATES.values() for t in ts):
        rare = set(licenses.rare_words(template, {w: 0 for w in template}))
        assert sum(w not in rare for w in template) / len(template) < licenses.CONFIRM


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under the ISC license",
        "Licensed under the Eclipse Public License version 2.0",
        "Licensed under the GNU Free Documentation License version 1.3",
        "Released under the Boost license",
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "This source code form is subject to the terms of the European Union Public License version 1.2",
        "This file is not licensed under the MIT license",
        "It was never released\nunder the BSD license",
        "SPDX-License-Identifier: ISC",
        "SPDX-License-Identifier: EPL-2.0",
    ],
)
def test_other_licences_and_denials_are_not_confirmed(model, text):
    assert not [h for h in model.scan_text(text) if h[3] >= licenses.CONFIRM]


@pytest.mark.parametrize(
    "text, family",
    [
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl"),
        ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
        ("SPDX-License-Identifier: CC0-1.0", "public-domain"),
        ("SPDX-License-Identifier: BSD-2-Clause", "bsd"),
        ("This is not a toy. It was made with care and is licensed under the MIT License.", "mit"),
    ],
)
def test_identifiers_and_grants_beside_a_negation(model, text, family):
    assert [h[1] for h in model.scan_text(text) if h[3] >= licenses.CONFIRM] == [family]
