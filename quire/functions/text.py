"""Text functions on columns: normal forms, quality, keys, markers. Offsets count code points, from 0."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Presentation forms and what they stand for, characters that only steer line breaking, odd spaces.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}
INVISIBLE = "[­​-‍⁠﻿]"
SPACES = "[  -   　]"
VOWELS = "[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüαεηιουωаеиоуыэюя]"
LETTER = r"A-Za-zÀ-ɏͰ-Ͽ"
MIN_CHARS, MIN_QUALITY, LONGEST_WORD = 60, 0.55, 24
#: A division's own heading, which is never page furniture.
STRUCTURAL = r"(?i)^(book|volume|part|chapter|canto|act|section)\s+([0-9]+|[ivxlcdm]+|[a-z-]+)$"
NUMERAL_LINE = r"^[\s.\-–—\[\]()]*([0-9]{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})[\s.\-–—\[\]()]*$"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normal_text(s: Column) -> Column:
    """Composed letters, ligatures spelled out, invisible characters gone, plain spaces. ASCII texts skip Python."""
    t = F.when(s.rlike(r"^\p{ASCII}*$"), s).otherwise(_nfc(s))
    for form, plain in LIGATURES.items():
        t = F.replace(t, F.lit(form), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), SPACES, " ")


def respaced(s: Column) -> Column:
    """Put back the space that got lost after punctuation before a letter, a sentence's end, or a closing quote."""
    # Few texts have such a place; one look tells whether any of the three rules may find one.
    may = s.rlike(rf"[,;:”’](?=[{LETTER}])|[.!?](?=[\"“'‘]?[A-ZÀ-Þ])")
    t = F.regexp_replace(s, f"([,;:])(?=[{LETTER}])", "$1 ")
    t = F.regexp_replace(t, r"([a-zß-ɏ’'”\"])([.!?]+)(?=[\"“'‘]?[A-ZÀ-Þ])", "$1$2 ")
    return F.when(may, F.regexp_replace(t, rf"([”’])(?=[{LETTER}])", "$1 ")).otherwise(s)


def squeezed(s: Column) -> Column:
    return F.trim(F.when(s.rlike(r"\s\s|[\s&&[^ ]]"), F.regexp_replace(s, r"\s+", " ")).otherwise(s))


#: Characters that say nothing: undecodable, of private use, or control characters.
UNREADABLE = r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x1F]"


def quality(s: Column) -> Column:
    """How far a text reads like text: letters, decodable characters and words of sane shape, 0 to 1, 2 decimals."""
    t = squeezed(s)
    n = F.length(t)
    # Letters and the spaces between words, in one pass; what is counted of words is counted in it.
    cores = F.regexp_replace(t, r"[^\p{L} ]+", "")
    letters = F.length(F.replace(cores, F.lit(" "), F.lit("")))
    bad = F.when(t.rlike(UNREADABLE), F.length(F.regexp_replace(t, rf"[^{UNREADABLE[1:]}", ""))).otherwise(0)
    words = F.regexp_count(cores, F.lit("[^ ]+"))
    sane = F.regexp_count(F.lower(cores), F.lit(rf"(?<![^ ])(?=[^ ]{{1,{LONGEST_WORD}}}(?![^ ]))[^ ]*?{VOWELS}[^ ]*"))
    ratio = F.when(words > 0, sane / words).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), letters / n * 0.4 + (1 - bad / n) * 0.2 + ratio * 0.4))
    return F.when(n > 0, F.floor(score * 100 + 0.5) / 100).otherwise(0.0)


def page_kind(chars: Column, q: Column) -> Column:
    return F.when(chars < MIN_CHARS, "scanned").when(q < MIN_QUALITY, "poor_native").otherwise("native")


def shape_key(s: Column) -> Column:
    """A line with its digits out of account, for telling repeated lines."""
    return F.lower(F.regexp_replace(s, "[0-9]+", "#"))


def head_key(s: Column) -> Column:
    """A running head with case, marks and digits out of account."""
    t = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[0-9]+", "#"), r"\s+", " "))


def marker_key(s: Column) -> Column:
    """What a printed marker is without its brackets and full stop; letters in lower case."""
    core = F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[\[(<{]\s*", ""), r"\s*[\])>}]?[.:]?$", ""))
    return F.when(core.rlike("^[A-Za-z]+$"), F.lower(core)).otherwise(core)


def marker_class(key: Column) -> Column:
    """numeric, symbol, roman, alphabetic or null; letters that are numerals count as roman."""
    roman = F.lower(key).rlike("^(?=[ivxlc])c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(key) <= 6)
    symbol = key.rlike(r"^(\*{1,3}|†{1,3}|‡{1,3}|§{1,3}|¶{1,3})$")
    return F.when(key.rlike("^[0-9]{1,3}$"), "numeric").when(symbol, "symbol").when(roman, "roman").when(F.lower(key).rlike("^[a-z]$"), "alphabetic")


#: A symbol set against the end of a word or of its punctuation.
GLUED = r"(?<=[\p{L}\p{N}.,;:!?'\"’”)\]])(\*{1,3}|†{1,3}|‡{1,3}|§{1,3}|¶{1,3})(?![\p{L}\p{N}*†‡§¶])"


def glued_symbols(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(GLUED), F.lit(1))


def first_word_case(s: Column) -> Column:
    """upper or lower by the first word's first letter; null where it is no word or all in capitals."""
    w = F.regexp_extract(s, r"^(\p{L}[\p{L}'’]*)", 1)
    return F.when((w == "") | ((F.length(w) >= 2) & (w == F.upper(w))), None).when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), "upper").otherwise("lower")


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) <= 1


def snippet(s: Column, at: Column, length: int, before: int = 60, after: int = 80) -> Column:
    """The text around a hit of `length` that starts at code point `at`."""
    start = F.greatest(F.lit(0), at - before)
    return F.substring(s, (start + 1).cast("int"), (at + length + after - start).cast("int"))
