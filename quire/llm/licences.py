"""Licence scans: Aho-Corasick finds notices and identifier tags, a shunting-yard parser evaluates the tags' expressions.

A text's A-Z are lower-cased and its words are runs of digits, letters and all that is beyond ASCII. One automaton over the
words, a space between two, finds every place of every notice and of the tag's words in one pass, whatever their number.
Behind each tag stands an expression up to the line's end (or up to what no expression can hold): identifiers joined by
`and`, `or`, `with` and brackets. Two stacks put it in order: `with` binds closest, then `and`, then `or`.

An identifier is worth how freely its licence allows use, 0 to 1. `or` lets one choose, so it is worth the better; `and`
binds to both, so the worse; an exception (`with`) takes back half of what its licence withholds. A document's score is the
least of its notices and expressions, 0 where none was found: without a licence nothing is allowed. A broken expression
(a bracket or operand missing) is worth nothing, but its identifiers are labels still.

Nulls: a null text is an empty one; a null doc_id is kept. Empty texts have no words and no labels. Very long texts are
scanned whole, one at a time. Repeated rows are rows each. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.common import map_arrow

#: Phrases of the base rules and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices and their labels; where one holds another, both are found and the longer stands for the two.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely a licence allows use, by the beginning of its label; the longest that fits counts.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "zlib": 0.9, "apache": 0.9, "bsl": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.3
BINDING = {"or": 1, "and": 2, "with": 3}

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z, and what is in no word to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if WORDS.match(bytes([c])) else 32 for c in range(256))
BEHIND = re.compile(r"spdx[^0-9a-z\n\x80-\U0010ffff]+license[^0-9a-z\n\x80-\U0010ffff]+identifier[ \t]*:?([^\n\r]*)")
TOKEN = re.compile(r"[ \t]*([a-z0-9][a-z0-9.+:-]*|[()])")
LABELS = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<struct<text:string,valid:boolean,freedom:double>>"


def label_of(identifier: str) -> str:
    """The label of an identifier: without -only, -or-later, + and a version's .0; families that differ by terms, not by version, lose the version."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    name = re.sub(r"(\.0)+$", "", name)
    return re.sub(r"-[0-9.]+$", "", name) if name.startswith("cc-") else name


def freedom_of(label: str) -> float:
    fits = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def tokens_of(tail: str) -> list[str]:
    """The tokens of an expression at the start of a line's rest: up to what none can hold, or a word that no operator joins."""
    out: list[str] = []
    at, awaits = 0, True
    while found := TOKEN.match(tail, at):
        token = found[1]
        if token not in "()":
            joins = token in BINDING
            if not awaits and not joins:
                break  # two operands side by side: the line goes on with something else
            awaits = joins
        elif token == "(" and not awaits:
            break
        out.append(token)
        at = found.end()
    return out


def evaluate(tokens: list[str]) -> tuple[list[str], float | None]:
    """(labels, freedom) of an expression; no freedom where it is broken."""
    values: list[float] = []
    operators: list[str] = []
    labels: list[str] = []
    awaits = True  # an operand is to come

    def apply() -> None:
        right, left, by = values.pop(), values.pop(), operators.pop()
        values.append(left + (1 - left) / 2 if by == "with" else min(left, right) if by == "and" else max(left, right))

    for token in tokens:
        if token == "(":
            if not awaits:
                return labels, None
            operators.append(token)
        elif token == ")":
            while not awaits and operators and operators[-1] != "(":
                apply()
            if awaits or not operators:
                return labels + _rest(tokens, labels), None
            operators.pop()
        elif token in BINDING:
            if awaits:
                return labels + _rest(tokens, labels), None
            while operators and operators[-1] != "(" and BINDING[operators[-1]] >= BINDING[token]:
                apply()
            operators.append(token)
            awaits = True
        else:
            excepts = bool(operators) and operators[-1] == "with" and awaits
            if not excepts:
                labels.append(label_of(token))
            values.append(freedom_of(label_of(token)))
            awaits = False
    if awaits or "(" in operators:
        return labels, None
    while operators:
        apply()
    return labels, values[0]


def _rest(tokens: list[str], known: list[str]) -> list[str]:
    """The labels of a broken expression that were not reached; what follows `with` is none."""
    named = [label_of(t) for before, t in zip([""] + tokens, tokens, strict=False) if t not in BINDING and t not in "()" and before != "with"]
    return named[len(known) :]


def automaton(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
    """Phrases between spaces, each with its length, its label and whether a base rule has it."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**notices, TAG: ""}.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, False))
    for phrase, label in base.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, True))
    found.make_automaton()
    return found


def scan(text: str, machine) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions) of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    spans: list[tuple[int, int, str]] = []
    tagged = False
    at = before = 0  # words that begin before a place
    for end, (size, label, is_base) in machine.iter(line):
        start = end - size + 1
        before += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        if not label:
            tagged = True
            continue
        if is_base:
            base.append(before)
            base_labels.add(label)
        spans.append((start, end, label))
    labels |= base_labels
    # A notice inside a longer one says nothing of its own.
    spans.sort(key=lambda s: (s[0], -s[1]))
    furthest, kept = -1, []
    for start, end, label in spans:
        if end > furthest:
            kept.append(label)
            furthest = end
    labels.update(kept)
    worth = [freedom_of(label) for label in labels]
    expressions = []
    if tagged:
        low = text.translate(LOWER)
        for tail in BEHIND.findall(low):
            tokens = tokens_of(tail)
            if not tokens:
                continue
            names, freedom = evaluate(tokens)
            labels.update(names)
            worth.append(freedom or 0.0)
            expressions.append({"text": " ".join(tokens), "valid": freedom is not None, "freedom": freedom})
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(worth, default=0.0), expressions


LOWER = {c: c + 32 for c in range(65, 91)}


def licences(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions) of each document.

    base and notices: {phrase: label}, phrases of lower-case words with a space between two.
    """

    schema = to_arrow_schema(StructType.fromDDL(LABELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, notices)
        for batch in batches:
            found = [scan(t.as_py() or "", machine) for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, LABELS)
