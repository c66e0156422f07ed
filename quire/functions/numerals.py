"""Numerals as Column functions: roman, spelled, and printed page numbers; and scores from signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the letters and words are worth.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
SPELLED = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}

# How much each signal speaks for a reference; negative ones speak against it.
SIGNALS = {
    "explicit-link": 0.99, "superscript": 0.7, "bracketed": 0.6, "parenthesized": 0.25, "glued-symbol": 0.3,
    "system-key": 0.5, "sequence": 0.2, "cue": 0.6, "cued-list": 0.5, "intrinsic-form": 0.45,
    "named-node-exists": 0.35, "capitalized-label": 0.15, "lemma": 0.75, "line-key": 0.8, "author-date": 0.5,
    "math-context": -0.7, "isolated-typography": -0.4, "vocabulary-only": -0.5,
}
ACCEPT_RESOLVED, KEEP_UNRESOLVED = 0.4, 0.6


def mapped(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def roman_value(s: Column) -> Column:
    """The value of roman letters by subtraction, valid numeral or not; null for anything else."""
    worth = F.transform(F.regexp_extract_all(F.upper(s), F.lit("[IVXLCDM]"), F.lit(0)), lambda c: F.try_element_at(mapped(ROMAN), c))
    # Each counts against the total where a greater one follows.
    signed = F.transform(worth, lambda v, i: F.when(v < F.coalesce(F.get(worth, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(s.rlike("^(?i)[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def number_value(s: Column) -> Column:
    """Digits, English number words to fifty added up, or roman letters; null for anything else."""
    words = F.filter(F.split(F.lower(s), r"[\s-]+"), lambda w: w != "")
    spelled = F.transform(words, lambda w: F.try_element_at(mapped(SPELLED), w))
    total = F.when((F.size(words) > 0) & F.forall(spelled, lambda v: v.isNotNull()), F.aggregate(spelled, F.lit(0), lambda a, v: a + v))
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("int")).otherwise(F.coalesce(total, roman_value(s)))


def page_numeral(s: Column) -> Column:
    """struct<value, roman> of a line that is a numeral with marks around it; null for anything else."""
    edge = r"[^\p{L}\p{N}]*"
    digits, letters = F.regexp_extract(F.trim(s), f"^{edge}([0-9]{{1,4}}){edge}$", 1), F.regexp_extract(F.trim(s), f"^{edge}((?i)[ivxlcdm]{{1,7}}){edge}$", 1)
    return F.when(digits != "", F.struct(digits.try_cast("int").alias("value"), F.lit(False).alias("roman"))).when(letters != "", F.struct(roman_value(letters).alias("value"), F.lit(True).alias("roman")))


def recognition_score(signals: Column) -> Column:
    """What signals of an array say together: one less the product of the doubts, less the worst objection; 3 decimals."""
    weights = F.filter(F.transform(signals, lambda s: F.try_element_at(mapped(SIGNALS), s)), lambda w: w.isNotNull())
    doubt = F.aggregate(F.filter(weights, lambda w: w >= 0), F.lit(1.0), lambda a, w: a * (1 - w))
    objection = F.coalesce(F.array_max(F.transform(F.filter(weights, lambda w: w < 0), lambda w: -w)), F.lit(0.0))
    return F.floor((1 - doubt) * (1 - objection) * 1000 + 0.5) / 1000


def decision(score: Column, destination: Column, ambiguous: Column, candidates: Column) -> Column:
    """accepted, accepted-unresolved or rejected, by score and by confidence in the destination."""
    unresolved = (ambiguous & (candidates >= 2) & (score >= ACCEPT_RESOLVED)) | (score >= KEEP_UNRESOLVED)
    return F.when(destination > 0, F.when(score >= ACCEPT_RESOLVED, "accepted").otherwise("rejected")).otherwise(F.when(unresolved, "accepted-unresolved").otherwise("rejected"))
