"""A corpus's own evidence about words: counts, neighbours, hyphenated compounds, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


WORD = "[A-Za-zÀ-ɏ']+"
LOWER_WORD = "[a-zÀ-ɏ']+"
COMPOUND = "([A-Za-zÀ-ɏ]{2,})[-‐]([A-Za-zÀ-ɏ]{2,})"
#: Fused words are looked at from 11 to 28 letters, halves from 3, and a pair counts from 4 sightings.
FUSED, HALF, SEEN = (11, 28), 3, 4


def words(lines: DataFrame, by: list[str]) -> DataFrame:
    """(*by, word, n): words of at least two letters in lower case."""
    found = lines.select(*by, F.explode(F.transform(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), F.lower)).alias("word"))
    return found.where(F.length("word") >= 2).groupBy(*by, "word").agg(F.count("*").alias("n"))


def bigrams(lines: DataFrame, by: list[str]) -> DataFrame:
    """(*by, a, b, n): words that stand side by side in a line."""
    seq = lines.select(*by, F.regexp_extract_all(F.lower("line"), F.lit(LOWER_WORD), F.lit(0)).alias("seq")).where(F.size("seq") >= 2)
    pairs = seq.select(*by, F.explode(F.arrays_zip(F.expr("slice(seq, 1, size(seq) - 1)").alias("a"), F.expr("slice(seq, 2, size(seq) - 1)").alias("b"))).alias("p"))
    return pairs.select(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def compounds(lines: DataFrame, by: list[str]) -> DataFrame:
    """(*by, compound): what is printed with a hyphen inside a line."""
    found = lines.select(*by, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(COMPOUND.replace("A-Z", "")), F.lit(0))).alias("c"))
    return found.select(*by, F.regexp_replace("c", "‐", "-").alias("compound")).distinct()


def fused_words(lines: DataFrame, by: list[str]) -> DataFrame:
    """(*by, word, left, right, n): long words seen once at most whose halves the same lines print side by side.

    Of several places to part a word the pair seen most often wins, of equals the leftmost.
    """
    lo, hi = FUSED
    long = words(lines, by).where(F.col("n") <= 1).where(F.length("word").between(lo, hi)).where(~F.col("word").contains("'"))
    cut = long.select(*by, "word", F.explode(F.sequence(F.lit(HALF), F.length("word") - HALF)).alias("at"))
    cut = cut.select(*by, "word", "at", F.expr("substring(word, 1, at)").alias("a"), F.expr("substring(word, at + 1)").alias("b"))
    pairs = bigrams(lines, by).where(F.col("n") >= SEEN)
    hits = cut.join(pairs, [*by, "a", "b"])
    return hits.groupBy(*by, "word").agg(F.max_by(F.struct("a", "b", "n"), F.struct("n", -F.col("at"))).alias("x")).select(*by, "word", F.col("x.a").alias("left"), F.col("x.b").alias("right"), F.col("x.n").alias("n"))


def joiners(lines: DataFrame, compound: DataFrame, short: list[str]) -> DataFrame:
    """(doc_id, line_no, joiner): how each line joins the one before it: "", "-" or a space.

    A hyphen at a line's end before a small letter is a break unless the compound is printed elsewhere; a tail of one or
    two letters that is no word is a cut word.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    pairs = lines.select("doc_id", "line_no", F.col("line").alias("next"), F.lag("line").over(w).alias("prev")).where("prev is not null")
    hyphen = F.col("prev").rlike("[-‐]$") & F.col("next").rlike("^[a-z]")
    a, b = F.lower(F.regexp_extract("prev", "([A-Za-zÀ-ɏ]+)[-‐]$", 1)), F.lower(F.regexp_extract("next", "^([a-zÀ-ɏ]+)", 1))
    pairs = pairs.select("doc_id", "line_no", "prev", "next", hyphen.alias("hyphen"), F.when(hyphen, F.concat(a, F.lit("-"), b)).alias("compound"))
    known = pairs.join(compound.withColumn("known", F.lit(True)), ["doc_id", "compound"], "left")
    tail = F.regexp_replace(F.lower(F.regexp_extract("prev", "([A-Za-z’']+)$", 1)), "[’']", "")
    cut = F.col("next").rlike("^[a-z]") & (tail != "") & (F.length(tail) <= 2) & ~tail.isin(short)
    return known.select("doc_id", "line_no", F.when(F.col("hyphen"), F.when(F.coalesce("known", F.lit(False)), "-").otherwise("")).when(cut, "").otherwise(" ").alias("joiner"))


#: Words of one and two letters.
SHORT_WORDS = (
    "a i o ah am an as at be by do go ha he hi if in is it la lo me mr ms my no of oh on or ox so to up us we ye yo"
).split()
