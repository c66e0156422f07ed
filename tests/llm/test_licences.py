import itertools
import random
import re

import pytest

from quire.llm import licences as L
from tests.llm.corpus import DOCS, empty, frame, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    """The base columns by comparing every place with every phrase."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_base_columns_equal_brute_force_on_awkward_documents(spark):
    r = random.Random(3)
    pieces = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "under", "the", "é", "cc", "by", "license", "ünder the mit license", "\x7f", "GPL", "\n", "under the under the mit license"]
    data = rows() + [(1000 + i, " ".join(r.choices(pieces, k=r.randint(0, 40))), "x", "s", 0) for i in range(200)]
    data += [(2000, "cc by nc " * 30_000, "x", "s", 0)]
    got = sorted([tuple(x)[:6] for x in L.licences(frame(spark, data)).collect()], key=str)
    assert got == sorted([(d[0], *plain(d[1])) for d in data], key=str)
    assert L.licences(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("line", "labels", "freedom"),
    [
        ("MIT", ["mit"], 0.9),
        ("MIT OR Apache-2.0", ["mit", "apache-2"], 0.9),
        ("(MIT AND GPL-2.0-only) OR CC-BY-NC-4.0", ["mit", "gpl-2", "cc-by-nc"], 0.4),
        ("MIT AND GPL-2.0-only OR CC-BY-NC-4.0", ["mit", "gpl-2", "cc-by-nc"], 0.4),
        ("MIT AND (GPL-2.0-or-later OR CC-BY-NC-4.0)", ["mit", "gpl-2", "cc-by-nc"], 0.4),
        ("GPL-2.0+ WITH Classpath-exception-2.0", ["gpl-2"], 0.7),
        ("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT", ["gpl-2", "mit"], 0.7),
        ("MIT */", ["mit"], 0.9),
        ("MIT and that is all", ["mit", "that"], 0.3),
        ("((MIT))", ["mit"], 0.9),
        ("MIT OR", ["mit"], None),
        ("(MIT OR ISC", ["mit", "isc"], None),
        ("MIT) OR ISC", ["mit", "isc"], None),
        ("AND MIT", ["mit"], None),
        ("()", [], None),
        ("MIT AND OR ISC WITH X", ["mit", "isc"], None),
    ],
)
def test_expressions(line, labels, freedom):
    got = L.evaluate(L.tokens_of(line.lower()))
    assert got[0] == labels and (got[1] == freedom if freedom is None else got[1] == pytest.approx(freedom))


def test_two_stacks_agree_with_recursive_evaluation():
    """Random expressions against Python's own `and`, `or` on sets of choices: the worth is the best choice of the worst part."""
    r = random.Random(8)
    names = ["mit", "gpl-2.0", "cc-by-nc-4.0", "apache-2.0", "mpl-2.0"]

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            name = r.choice(names)
            return [name], [frozenset([name])]
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        if r.random() < 0.5:
            return ["(", *a, "or", *b, ")"], x + y
        return ["(", *a, "and", *b, ")"], [p | q for p, q in itertools.product(x, y)]

    for _ in range(200):
        tokens, choices = tree(4)
        best = max(min(L.freedom_of(L.label_of(n)) for n in c) for c in choices)
        assert L.evaluate(tokens)[1] == pytest.approx(best)


def test_labels_score_and_expressions_of_a_document(spark):
    data = [
        (1, "x\n// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause\nunder the MIT license. All rights reserved", "x", "s", 0),
        (2, "GNU General Public License, version 3.", "x", "s", 0),
        (3, "SPDX-License-Identifier: MIT OR (", "x", "s", 0),
        (4, "Creative Commons CC BY-NC-SA 4.0", "x", "s", 0),
    ]
    got = {x["doc_id"]: x for x in L.licences(spark.createDataFrame(data, DOCS)).collect()}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["score"]) == ("all-rights-reserved,bsd-3-clause,gpl-3,mit", "mit", 0.0)
    assert [(e["text"], e["valid"], e["freedom"]) for e in got[1]["expressions"]] == [("( mit or gpl-3.0-only ) and bsd-3-clause", True, 0.9)]
    assert (got[2]["labels"], got[2]["score"]) == ("gpl-3", 0.4)
    assert (got[3]["labels"], got[3]["score"], got[3]["expressions"][0]["valid"]) == ("mit", 0.0, False)
    assert (got[4]["labels"], got[4]["base_labels"]) == ("cc-by-nc,cc-by-nc-sa", "cc-by-nc")
