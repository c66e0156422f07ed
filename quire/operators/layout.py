"""Page furniture and page numbers by repetition and sequence, as aggregations, joins and windows.

Lines are rows (doc_id, page, idx, y, size, text); idx counts a page's lines from its top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numerals import page_numeral, roman_value
from quire.functions.stats import half_up
from quire.functions.text import NUMERAL_LINE, STRUCTURAL, head_key, shape_key, within_one_edit


# How long a line of furniture may be that is told by its shape, and how often the shape must come back.
SHAPE_LETTERS, SHAPE_LEAST = 70, 5


def _pages(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))


def shape_furniture(lines: DataFrame, profile: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, idx, text, classification, confidence): short lines of one shape at one height on many pages.

    profile: (doc_id, body_size). Many: at least 5 and 5 per cent of the pages. All of a shape bare numerals: page numbers.
    """
    pages = pages if pages is not None else _pages(lines)
    small = lines.join(profile, "doc_id").where((F.length("text") <= SHAPE_LETTERS) & (F.col("size") <= F.col("body_size") * 1.1) & ~F.col("text").rlike(STRUCTURAL))
    keyed = small.withColumn("key", shape_key(F.col("text"))).withColumn("height", half_up(F.col("y") / 8))
    groups = keyed.groupBy("doc_id", "key", "height").agg(F.count("*").alias("n"), F.bool_and(F.col("text").rlike(NUMERAL_LINE)).alias("numeric"))
    many = groups.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(float(SHAPE_LEAST)), F.col("pages") * 0.05))
    hit = keyed.join(many, ["doc_id", "key", "height"])
    return hit.select("doc_id", "page", "idx", "text", F.when(F.col("numeric"), "printed-page-number").otherwise("running-head").alias("classification"), F.least(F.lit(0.98), 0.6 + F.col("n") / (F.col("pages") * 4)).alias("confidence"))


def wording_furniture(lines: DataFrame, profile: DataFrame, removed: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """As above for lines not yet removed whose wording alone repeats: at least 8 and 8 per cent of the pages, to 45 letters."""
    pages = pages if pages is not None else _pages(lines)
    left = lines.join(removed.select("doc_id", "page", "idx"), ["doc_id", "page", "idx"], "left_anti")
    small = left.join(profile, "doc_id").where((F.length("text") <= 45) & (F.col("size") <= F.col("body_size") * 1.1) & ~F.col("text").rlike(STRUCTURAL))
    keyed = small.withColumn("key", shape_key(F.col("text")))
    groups = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.bool_and(F.col("text").rlike(NUMERAL_LINE)).alias("numeric"))
    many = groups.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(8.0), F.col("pages") * 0.08))
    return keyed.join(many, ["doc_id", "key"]).select("doc_id", "page", "idx", "text", F.when(F.col("numeric"), "printed-page-number").otherwise("repeated-boilerplate").alias("classification"), F.lit(0.8).alias("confidence"))


def band_lines(lines: DataFrame) -> DataFrame:
    """The two first and two last lines of each page, with their band; a line is in one band."""
    w = Window.partitionBy("doc_id", "page")
    placed = lines.withColumn("__rank", F.row_number().over(w.orderBy("idx"))).withColumn("__n", F.count("*").over(w))
    return placed.where((F.col("__rank") <= 2) | (F.col("__rank") > F.col("__n") - 2)).withColumn("band", F.when(F.col("__rank") <= 2, "top").otherwise("bottom")).withColumnRenamed("__n", "page_lines").drop("__rank")


def longest_run(pages: DataFrame, by: list[str], gap: int = 2) -> DataFrame:
    """(*by, run): the most distinct pages in a row that are at most `gap` apart.

    One sort by key and page, and no table of pages or of stretches in memory: a page met before stands right after itself, and
    a stretch's length is how many pages have been met less how many had been when it began.
    """
    w = Window.partitionBy(*by).orderBy("page")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag(F.struct("page")).over(w)
    marked = pages.select(*by, "page").withColumn("met", (~F.struct("page").eqNullSafe(before)).cast("long")).withColumn("apart", before.isNull() | F.coalesce(F.col("page") - before["page"] > gap, F.lit(False)))
    counted = marked.withColumn("seen", F.sum("met").over(upto))
    begun = counted.withColumn("begun", F.max(F.when(F.col("apart"), F.col("seen") - 1)).over(upto))
    return begun.groupBy(*by).agg(F.max(F.col("seen") - F.col("begun")).alias("run"))


def number_offsets(bands: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, roman, offset, support): sequences printed = page + offset that hold on enough pages, or four in a row."""
    cands = bands.withColumn("num", page_numeral(F.col("text"))).where("num is not null")
    cands = cands.select("doc_id", "page", F.col("num.roman").alias("roman"), (F.col("num.value") - F.col("page")).alias("offset"))
    support = cands.groupBy("doc_id", "roman", "offset").agg(F.countDistinct("page").alias("support"))
    runs = longest_run(cands, ["doc_id", "roman", "offset"])
    joined = support.join(runs, ["doc_id", "roman", "offset"]).join(pages, "doc_id")
    enough = F.greatest(F.lit(4), half_up(F.col("pages") * 0.03))
    return joined.where((F.col("support") >= enough) | ((F.col("support") >= 4) & (F.col("run") >= 4))).select("doc_id", "roman", "offset", "support")


def page_numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, page, idx, text, printed, roman, how) of band lines that continue a sequence.

    how: 'sequence' for a clean numeral, 'noisy' for the expected number among stray marks, 'misread' for one character
    off. A line is taken by the first that fits; of several sequences, by the one with most support.
    """
    bands = band_lines(lines)
    offsets = number_offsets(bands, _pages(lines))
    digits = F.regexp_extract_all("text", F.lit("[0-9]{1,4}"), F.lit(0))
    plain = bands.withColumn("num", page_numeral(F.col("text"))).withColumn("lone", F.when((F.size(digits) == 1) & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) <= 1) & (F.size(F.split(F.trim("text"), r"\s+")) <= 3), digits[0]))
    fits = plain.join(offsets, "doc_id")
    expected = F.col("page") + F.col("offset")
    how = (
        F.when((F.col("num.value") == expected) & (F.col("num.roman") == F.col("roman")), F.lit(1))
        .when(~F.col("roman") & (F.col("lone").try_cast("int") == expected), F.lit(2))
        .when(~F.col("roman") & within_one_edit(F.col("lone"), expected.cast("string")), F.lit(3))
    )
    best = fits.withColumn("how", how).where("how is not null").groupBy("doc_id", "page", "idx", "text").agg(F.min(F.struct("how", -F.col("support"), expected.alias("printed"), "roman")).alias("m"))
    names = F.array(F.lit("sequence"), F.lit("noisy"), F.lit("misread"))
    return best.select("doc_id", "page", "idx", "text", F.col("m.printed").alias("printed"), F.col("m.roman").alias("roman"), F.get(names, F.col("m.how") - 1).alias("how"))


def running_heads(lines: DataFrame, numbers: DataFrame, em: DataFrame) -> DataFrame:
    """(doc_id, page, idx, text, other_page): band lines whose wording recurs in the same band one or two pages away.

    Pages of fewer than 8 lines have none; lines of 3 to 70 letters and at most 10 words, not set larger than the text's
    (em: (doc_id, em)) by a quarter. The nearest page before comes first: -2, -1, 1, 2.
    """
    bands = band_lines(lines).join(numbers.select("doc_id", "page", "idx"), ["doc_id", "page", "idx"], "left_anti").withColumn("key", head_key(F.col("text")))
    mine = bands.join(em, "doc_id").where((F.col("page_lines") >= 8) & F.length(F.trim("text")).between(3, 70) & (F.size(F.split(F.trim("text"), r"\s+")) <= 10) & (F.col("size") <= F.col("em") * 1.25) & (F.length("key") >= 3))
    near = mine.withColumn("step", F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)]))).withColumn("other_page", F.col("page") + F.col("step"))
    others = bands.select("doc_id", F.col("page").alias("other_page"), "band", "key").distinct()
    return near.join(others, ["doc_id", "other_page", "band", "key"]).groupBy("doc_id", "page", "idx", "text").agg(F.min("step").alias("step")).select("doc_id", "page", "idx", "text", (F.col("page") + F.col("step")).alias("other_page"))


def furniture(lines: DataFrame, profile: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, idx, text, classification, confidence): all that is no reading text; the first rule that takes a line has it.

    numbers: the lines' page numbers, where they are known. Nothing is found in a document of one page with fewer than SHAPE_LEAST
    lines of SHAPE_LETTERS letters at most: numbers and heads need other pages, shapes and wordings need to come back.
    """
    one = shape_furniture(lines, profile)
    two = wording_furniture(lines, profile, one)
    first = one.unionByName(two)
    numbers = numbers if numbers is not None else page_numbers(lines)
    heads = running_heads(lines, numbers, profile.select("doc_id", F.col("body_size").alias("em")))
    late = numbers.select("doc_id", "page", "idx", "text", F.lit("printed-page-number").alias("classification"), F.lit(0.9).alias("confidence")).unionByName(heads.select("doc_id", "page", "idx", "text", F.lit("running-head").alias("classification"), F.lit(0.8).alias("confidence")))
    late = late.where(~F.col("text").rlike(STRUCTURAL)).join(first.select("doc_id", "page", "idx"), ["doc_id", "page", "idx"], "left_anti")
    return first.unionByName(late)


def page_map(removed: DataFrame, sequences: DataFrame) -> DataFrame:
    """(doc_id, page, printed, roman): the number printed on each page; a sequence's word goes over a lone numeral's."""
    token = F.regexp_replace("text", "[^0-9ivxlcdmIVXLCDM]", "")
    lone = removed.where("classification = 'printed-page-number'").select("doc_id", "page", "idx", token.alias("token")).where("token != ''")
    lone = lone.select("doc_id", "page", "idx", F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").try_cast("int")).otherwise(roman_value(F.col("token"))).alias("printed"), (~F.col("token").rlike("^[0-9]+$")).alias("roman"))
    lone = lone.where(F.col("printed").between(1, 5000)).groupBy("doc_id", "page").agg(F.min_by(F.struct("printed", "roman"), "idx").alias("l"))
    seq = sequences.groupBy("doc_id", "page").agg(F.min_by(F.struct("printed", "roman"), "idx").alias("s"))
    both = lone.join(seq, ["doc_id", "page"], "full_outer")
    pick = F.coalesce("s", "l")
    return both.select("doc_id", "page", pick["printed"].alias("printed"), pick["roman"].alias("roman"))
