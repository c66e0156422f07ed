"""Extracted documents as tables: outlines, file details, stored JSON artifacts and listings, recognised pages.

Nulls and missing parts give nulls or no rows, as each function says; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.stats import half_up

#: Levels of an outline that are read, and entries of one parent.
OUTLINE_DEPTH = 6
#: The details of a file besides its title and author.
DETAILS = ("Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
#: Horizontal slack of a line's box, and the confidence under which a word is doubtful.
SLACK, DOUBTFUL = 4.0, 0.6


def outline_schema(depth: int = OUTLINE_DEPTH) -> str:
    """Nested entries, title, page and children, as deep as outlines are read."""
    entry = "title: string, page: int, y: double"
    kind = f"array<struct<{entry}>>"
    for _ in range(depth - 1):
        kind = f"array<struct<{entry}, children: {kind}>>"
    return kind


def outline(docs: DataFrame, column: str = "outline", depth: int = OUTLINE_DEPTH) -> DataFrame:
    """(doc_id, ord, depth, title, page, y): entries of nested outlines, given as JSON, from the top, parents first.

    Entries without a title are dropped, what they hold is not. Levels below `depth` are not read. A null or malformed outline gives no rows.
    """

    def flat(entries: Column, level: int) -> Column:
        def one(e: Column) -> Column:
            own = F.array(F.struct(F.lit(level).alias("depth"), F.trim(e["title"]).alias("title"), e["page"].alias("page"), e["y"].alias("y")))
            return F.concat(own, flat(e["children"], level + 1)) if level + 1 < depth else own

        held = F.coalesce(entries, F.array().cast(entries_type(level)))
        return F.flatten(F.transform(held, one))

    def entries_type(level: int) -> str:
        return outline_schema(depth - level)

    rows = docs.select("doc_id", F.posexplode(flat(F.from_json(column, outline_schema(depth)), 0)).alias("ord", "e"))
    return rows.select("doc_id", "ord", "e.*").where("title is not null and title != ''")


def details(docs: DataFrame, column: str = "info") -> DataFrame:
    """(doc_id, title, author, details): of a map of a file's details, the title and author and the named others; empty ones go."""
    said = lambda key: F.nullif(F.trim(F.try_element_at(column, F.lit(key))), F.lit(""))
    others = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), said(k).alias("value")) for k in DETAILS]), lambda e: e["value"].isNotNull())
    return docs.select("doc_id", said("Title").alias("title"), said("Author").alias("author"), F.map_from_entries(others).alias("details"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def finished_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page) of stored page files <doc_id>/.../pN.json; other names are none."""
    page = F.regexp_extract("name", r"^p([0-9]+)\.json$", 1)
    doc = F.regexp_extract("path", r"/([0-9]+)/(?:[^/]+/)*[^/]+$", 1)
    return files.where((page != "") & (doc != "")).select(doc.cast("bigint").alias("doc_id"), page.cast("int").alias("page"))


def artifacts(wanted: DataFrame, spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """wanted (path, ...) with `artifact`, the JSON file of that path under a folder; null where there is none or it is malformed."""
    stored = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select(F.input_file_name().alias("__uri"), "value")
    # The folder's own part of a URI is cut off; schemes and hosts differ in how they are written.
    root = "/" + folder.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    held = stored.select(F.regexp_replace(F.url_decode("__uri"), "^.*" + _quoted(root), "").alias("path"), F.from_json("value", schema).alias("artifact"))
    return wanted.join(held, "path", "left")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def words_in_lines(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Recognised words (doc_id, page, n, t, x, y, w, h, c) with the box of their line (ly, lh): of the lines
    (doc_id, page, line, x, y, w, h) whose width, with a little slack, holds a word's centre, the one nearest in height;
    of equals the first. Words without a line keep nulls. A page is the key; a page's words and lines are few.
    """
    cx, cy = F.col("wd.x") + F.col("wd.w") / 2, F.col("wd.y") + F.col("wd.h") / 2
    inside = (cx >= F.col("ln.x") - SLACK) & (cx <= F.col("ln.x") + F.col("ln.w") + SLACK)
    met = words.alias("wd").join(lines.alias("ln"), (F.col("wd.doc_id") == F.col("ln.doc_id")) & (F.col("wd.page") == F.col("ln.page")) & inside)
    away = F.abs(cy - (F.col("ln.y") + F.col("ln.h") / 2))
    near = met.groupBy("wd.doc_id", "wd.page", "wd.n").agg(F.min(F.struct(away.alias("away"), F.col("ln.line").alias("line"), F.col("ln.y").alias("ly"), F.col("ln.h").alias("lh"))).alias("m"))
    return words.join(near.select("doc_id", "page", "n", F.col("m.line").alias("line"), F.col("m.ly").alias("ly"), F.col("m.lh").alias("lh")), ["doc_id", "page", "n"], "left")


def page_confidence(words: DataFrame) -> DataFrame:
    """(doc_id, page, words, confidence, doubtful): how many words a page has, how sure they are on average, to three
    decimals, and how many are doubtful."""
    return words.groupBy("doc_id", "page").agg(F.count("*").alias("words"), (half_up(F.avg("c") * 1000) / 1000).alias("confidence"), F.count_if(F.col("c") < DOUBTFUL).alias("doubtful"))


def with_provenance(blocks: DataFrame, pages: DataFrame, confidence: DataFrame) -> DataFrame:
    """blocks with the method of their page and, for recognised pages, how sure its words are; native where nothing is known."""
    known = pages.select("doc_id", "page", "method").join(confidence.select("doc_id", "page", "confidence"), ["doc_id", "page"], "left")
    return blocks.join(known, ["doc_id", "page"], "left").withColumn("method", F.coalesce("method", F.lit("native"))).withColumn("confidence", F.when(F.col("method") == "ocr", F.col("confidence")))
