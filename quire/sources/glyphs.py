"""From characters, fonts, link boxes and recognised words to positioned spans, in windows, joins and aggregates.

chars (doc_id, page, i, ch, code, x, y, w, h, oy, font_id, size): in reading order i; code <= 0 is undecodable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.stats import half_up
from quire.functions.text import normal_text

FIXED, SERIF, SYMBOLIC, ITALIC, SMALL_CAP, FORCE_BOLD = 1 << 0, 1 << 1, 1 << 2, 1 << 6, 1 << 17, 1 << 18


def fonts(descriptors: DataFrame) -> DataFrame:
    """(doc_id, font_id, family, subset, bold, italic, sc, mono, symbolic) from names, flag words and weights."""
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    tag = F.regexp_extract("ps_name", r"^([A-Z]{6})\+(.+)$", 1)
    family = F.when(tag != "", F.regexp_extract("ps_name", r"^([A-Z]{6})\+(.+)$", 2)).otherwise(F.col("ps_name"))
    bold = (F.col("weight") >= 700) | flag(FORCE_BOLD) | F.col("ps_name").rlike("(?i)(bold|black|heavy|semib|demib)")
    small = flag(SMALL_CAP) | F.col("ps_name").rlike("(?i)small-?caps?")
    return descriptors.select("doc_id", F.concat_ws("|", "ps_name", "flags", "weight").alias("font_id"), family.alias("family"), F.when(tag != "", tag).alias("subset"), bold.alias("bold"), flag(ITALIC).alias("italic"), small.alias("sc"), flag(FIXED).alias("mono"), (flag(SYMBOLIC) & ~flag(SERIF)).alias("symbolic"))


def runs(chars: DataFrame) -> DataFrame:
    """chars with their run: a new one where the font or the size to a tenth changes; line ends only part them."""
    w = Window.partitionBy("doc_id", "page").orderBy("i")
    kind = F.concat_ws("|", "font_id", half_up(F.col("size") * 10).cast("string"))
    body = chars.where(~F.col("ch").isin("\r", "\n")).withColumn("__kind", kind)
    # A line end between two characters shows as a gap in i.
    new = (F.col("__kind") != F.lag("__kind").over(w)) | (F.col("i") - F.lag("i").over(w) > 1)
    return body.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)).drop("__kind")


def spans(run_chars: DataFrame, font_table: DataFrame) -> DataFrame:
    """Positioned spans: runs parted where decodable and undecodable characters meet, white space going with what follows.

    (doc_id, page, o, x, y, w, s, h, f, fam, t, t0, em, strong, sc, mono, unmapped); spans that are blank and decoded go.
    """
    w = Window.partitionBy("doc_id", "page", "run").orderBy("i")
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.when(~F.col("ch").rlike(r"^\s*$"), F.coalesce((F.col("code") <= 0), F.lit(False)) | F.col("ch").rlike(r"[\x00\x{FFFD}]"))
    marked = run_chars.withColumn("__bad", bad)
    # White space takes after the next character that says something, at the end of a run after the last.
    marked = marked.withColumn("__state", F.coalesce(F.first("__bad", ignorenulls=True).over(ahead), F.last("__bad", ignorenulls=True).over(behind), F.lit(False)))
    marked = marked.withColumn("__group", F.sum(F.coalesce((F.col("__state") != F.lag("__state").over(w)).cast("int"), F.lit(0))).over(w))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda c: c["ch"]), "")
    grouped = marked.groupBy("doc_id", "page", "run", "__group").agg(
        F.min("i").cast("int").alias("o"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.min_by("oy", "i").alias("y"), F.max("h").alias("h"),
        F.first("size").alias("s"), F.first("font_id").alias("f"), raw.alias("t0"), F.count_if("__bad").cast("int").alias("unmapped"),
    )
    placed = grouped.withColumn("t", normal_text(F.col("t0"))).where((F.trim("t") != "") | (F.col("unmapped") > 0))
    fonts_of = font_table.select("doc_id", F.col("font_id").alias("f"), F.col("family").alias("fam"), F.col("italic").alias("em"), F.col("bold").alias("strong"), "sc", "mono")
    named = placed.join(fonts_of, ["doc_id", "f"], "left")
    round_to = lambda c, n: (half_up(F.col(c) * 10**n) / 10**n).alias(c)
    return named.select("doc_id", "page", "o", round_to("x", 2), round_to("y", 2), round_to("w", 2), round_to("s", 1), "h", "f", "fam", "t", "t0", "em", "strong", "sc", "mono", "unmapped")


def link_text(links: DataFrame, chars: DataFrame) -> DataFrame:
    """links (doc_id, page, link_id, x, y, w, h, ...) with start, end and text of the characters whose centres they cover.

    Both sides are cut into bands of BAND units of y, so that the join has equal keys and meets a page's band at a time.
    """
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    points = chars.select("doc_id", "page", "i", "ch", cx.alias("cx"), cy.alias("cy"), F.floor(cy / BAND).alias("band"))
    boxes = links.select("doc_id", "page", "link_id", "x", "y", "w", "h", F.explode(F.sequence(F.floor(F.col("y") / BAND), F.floor((F.col("y") + F.col("h")) / BAND))).alias("band"))
    hit = boxes.join(points, ["doc_id", "page", "band"]).where((F.col("cx") >= F.col("x")) & (F.col("cx") <= F.col("x") + F.col("w")) & (F.col("cy") >= F.col("y")) & (F.col("cy") <= F.col("y") + F.col("h")))
    ends = hit.groupBy("doc_id", "page", "link_id").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    # The range may span characters that the box does not cover; they belong to the text.
    covered = ends.join(chars.select("doc_id", "page", "i", "ch"), ["doc_id", "page"]).where("i >= start and i < end")
    text = covered.groupBy("doc_id", "page", "link_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda c: c["ch"]), "")).alias("text"))
    return links.join(ends, ["doc_id", "page", "link_id"], "left").join(text, ["doc_id", "page", "link_id"], "left")


BAND = 64.0


def recognised_spans(words: DataFrame, pages: DataFrame) -> DataFrame:
    """OCR words (doc_id, page, n, t, x, y, w, h, c, ly, lh; pixels from the top) as spans, scaled, turned and on baselines.

    Sizes within 30 per cent of a page's most frequent height (of equals the greatest) become that.
    pages: (doc_id, page, img_width, img_height, pdf_width, pdf_height).
    """
    sx = F.when(F.col("img_width") > 0, F.col("pdf_width") / F.col("img_width")).otherwise(1.0)
    sy = F.when(F.col("img_height") > 0, F.col("pdf_height") / F.col("img_height")).otherwise(1.0)
    tall = lambda a, b: F.when(F.coalesce(F.col(a), F.lit(0.0)) != 0, F.col(a)).otherwise(b)
    scaled = words.join(pages, ["doc_id", "page"]).withColumn("sx", sx).withColumn("sy", sy).withColumn("height", half_up(tall("lh", F.col("h")) * F.col("sy")).cast("double"))
    modes = scaled.groupBy("doc_id", "page", "height").agg(F.count("*").alias("n")).groupBy("doc_id", "page").agg(F.max(F.struct("n", "height")).alias("m"))
    two = lambda c: half_up(c * 100) / 100
    mode = F.col("m.height")
    size = F.when((mode > 0) & (F.abs(F.col("height") - mode) <= mode * 0.3), mode).otherwise(F.col("height"))
    return scaled.join(modes, ["doc_id", "page"]).select("doc_id", "page", F.col("n").cast("int").alias("o"), two(F.col("x") * F.col("sx")).alias("x"), two(F.col("pdf_height") - tall("ly", F.col("y") + F.col("h")) * F.col("sy")).alias("y"), two(F.col("w") * F.col("sx")).alias("w"), size.alias("s"), F.lit("ocr").alias("f"), F.concat("t", F.lit(" ")).alias("t"), F.col("c").alias("conf"))


def merged_pages(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Native spans with the pages that have recognised ones replaced by those."""
    read = recognised.select("doc_id", "page").distinct()
    return native.join(read, ["doc_id", "page"], "left_anti").unionByName(recognised, allowMissingColumns=True)


def with_recovered(span_table: DataFrame, recovered: DataFrame, least: float = 0.6) -> DataFrame:
    """Spans whose undecodable text a rendering gave back (doc_id, page, o, text, conf), where that is sure enough."""
    sure = recovered.where(F.col("conf") >= least).select("doc_id", "page", "o", F.col("text").alias("__t"), F.col("conf").alias("__c"))
    use: Column = F.col("__t").isNotNull() & (F.col("unmapped") > 0)
    joined = span_table.join(sure, ["doc_id", "page", "o"], "left")
    return joined.withColumn("t", F.when(use, F.col("__t")).otherwise(F.col("t"))).withColumn("repair", F.when(use, "rendered-glyphs")).withColumn("conf", F.when(use, F.col("__c"))).withColumn("unmapped", F.when(use, 0).otherwise(F.col("unmapped"))).drop("__t", "__c")
