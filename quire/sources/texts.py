"""Sources of lines and pages from plain tables: documents by line feeds, conversations by turns, HTML pages by tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import squeezed


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines of each text that hold anything, white space squeezed; line_no from 0."""
    # Asked of the raw line: a condition on the squeezed one would squeeze it twice.
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).where(F.col("raw").rlike(r"\S"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), squeezed(F.col("raw")).alias("line"))


#: The tags that make blocks, and the kinds of block they make.
BLOCK_TAGS = {"h1": "heading", "h2": "heading", "h3": "heading", "p": "paragraph", "li": "list-item", "title": "title"}


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, type, text) of each page's title, headings, paragraphs and list items, in order, without tags."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:h[1-3]|p|li|title)(?:\s[^>]*)?>.*?</(?:h[1-3]|p|li|title)>)"), F.lit(1))
    cut = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    kinds = F.create_map(*[F.lit(x) for kv in BLOCK_TAGS.items() for x in kv])
    return cut.select("page_id", F.col("ord").cast("bigint").alias("ord"), F.try_element_at(kinds, tag).alias("type"), squeezed(F.regexp_replace("raw", r"(?s)<[^>]*>", " ")).alias("text"))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, n, url, external) of each href, in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)href=\"([^\"]*)\""), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("n", "url")).select("page_id", F.col("n").cast("bigint").alias("n"), "url", F.col("url").rlike("^(?i)https?://").alias("external"))
