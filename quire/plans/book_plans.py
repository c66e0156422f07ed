"""Queries that set small books from the rows of a table, so that SQL can say what the document engine must find in them.

Each nation gets a book of its own: the template's lines (bounded, whatever the table) meet every nation, and the engine
reads the books as it reads any spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.common import table
from quire.plans.document import analyse_documents, inline_view, reference_index, table_of

Q, O = {}, {}

WORDS = "river stone window garden letter morning silver branch winter harbour candle meadow thunder journey velvet copper lantern orchard willow marble".split()
LEADING, TOP, SIZE = 14.0, 720.0, 12.0
LEFT, INDENT, WIDTH = 72.0, 90.0, 456.0
TEMPLATE = "page int, o int, x double, y double, w double, s double, t string"
CHAPTERS, PAGES, VERSES = 2, 3, 60


class Template:
    """Lines of print, one after another; {name} stands for the nation's."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.page, self.y, self.said = 0, 0.0, 0

    def turn(self) -> None:
        self.page, self.y = self.page + 1, TOP

    def put(self, text: str, x: float, w: float, drop: float = LEADING, s: float = SIZE, rise: float = 0.0) -> float:
        self.y -= drop
        self.rows.append((self.page, len(self.rows), x, self.y + rise, w, s, text))
        return x + w

    def heading(self, text: str) -> None:
        self.put(text, 200.0, 150.0, 40.0, 18.0)
        self.y -= 26.0

    def words(self, n: int) -> str:
        self.said += 1
        return " ".join(WORDS[(self.said * 7 + k * (3 + self.said % 5)) % len(WORDS)] for k in range(n))

    def paragraph(self, lines: int = 5) -> None:
        for k in range(lines):
            text = self.words(11)
            last = k == lines - 1
            self.put((text[0].upper() + text[1:] if k == 0 else text) + ".", LEFT if k else INDENT, 200.0 if last else WIDTH if k else WIDTH - INDENT + LEFT)


def noted() -> list[tuple]:
    """Chapters with a note on every page, raised in the first and in brackets in the others, and the notes at the end."""
    b, n = Template(), 0
    for chapter in range(1, CHAPTERS + 1):
        for page in range(PAGES):
            b.turn()
            if page == 0:
                b.heading(f"Chapter {chapter}")
            for _ in range(4):
                b.paragraph()
            n += 1
            end = b.put(f"The {WORDS[n]} garden of {{name}} was {WORDS[n + 7]}", INDENT, 260.0)
            if chapter == 1:
                b.put(f"[{n}]", end, 12.0, 0.0, 7.0, 4.0)
            else:
                b.put(f"[{n}] and then they left.", end + 1, 150.0, 0.0)
    b.turn()
    b.heading("Notes")
    for k in range(1, n + 1):
        b.put(f"{k}. This note explains the {WORDS[k]} of {{name}} in full.", LEFT, 300.0, 22.0)
    return b.rows


def versed() -> list[tuple]:
    """Prose, then a book of verse with every fifth line numbered in the margin, then prose that points into it."""
    b = Template()
    b.turn()
    b.heading("Book 1")
    for _ in range(4):
        b.paragraph()
    for n in range(1, VERSES + 1):
        if n % 30 == 1:
            b.turn()
            if n == 1:
                b.heading("Book 2")
        text = f"{verse(n)}{',' if n % 3 else '.'}"
        if n % 5 == 0:
            b.put(str(n), LEFT, 12.0)
        b.put(text, 120.0, 220.0, 0.0 if n % 5 == 0 else LEADING)
    b.turn()
    b.heading("Book 3")
    for _ in range(3):
        b.paragraph()
    b.put("Compare Book 2, line 35 of the poem, and {name} too.", INDENT, 300.0, 24.0)
    return b.rows


def verse(n: int) -> str:
    return " ".join(["{name}", *(WORDS[(n * 7 + k * (2 + n % 3)) % len(WORDS)] for k in range(4))])


def set_for_nations(spark: SparkSession, sf: str, rows: list[tuple]) -> DataFrame:
    """Spans of a template's book for each nation; names as they are written, but for capitals."""
    lines = spark.createDataFrame(rows, TEMPLATE)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.initcap("n_name").alias("name"))
    no = F.lit(False)
    return nations.crossJoin(F.broadcast(lines)).select("doc_id", "page", "o", "x", "y", "w", "s", F.lit("roman").alias("f"), F.replace(F.col("t"), F.lit("{name}"), F.col("name")).alias("t"), no.alias("em"), no.alias("strong"), no.alias("sc"))


def note_edges(spark, sf):
    """Every marker of the books with the note it leads to."""
    model, _, _ = analyse_documents(set_for_nations(spark, sf, noted()))
    blocks = table_of(model, "blocks").select("doc_id", F.col("block_id").alias("to"), "text", "page")
    refs = table_of(model, "refs").where("type = 'endnote'")
    return refs.join(blocks, ["doc_id", "to"]).select("doc_id", "key", "source_text", F.col("page").cast("bigint").alias("dest_page"), F.col("text").alias("note"))


_NAMES = "n as (select n_nationkey::varchar as doc_id, list_aggregate(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') as name from nation)"
_NOTES = ", ".join(f"({k}, '{WORDS[k]}')" for k in range(1, CHAPTERS * PAGES + 1))
Q["note_edges"] = note_edges
O["note_edges"] = f"""with {_NAMES}, k as (select * from (values {_NOTES}) as k(k, word))
    select doc_id, k::varchar as key, '[' || k || ']' as source_text, {CHAPTERS * PAGES + 1}::bigint as dest_page, k || '. This note explains the ' || word || ' of ' || name || ' in full.' as note from n, k"""


def note_index(spark, sf):
    """The reference index of the books: where a note is called, and all that it says."""
    model, _, _ = analyse_documents(set_for_nations(spark, sf, noted()))
    index = reference_index(model).where("type = 'endnote'")
    return index.select("doc_id", "key", F.col("source_page").cast("bigint").alias("source_page"), F.col("dest_page").cast("bigint").alias("dest_page"), "section_label", "dest_text")


Q["note_index"] = note_index
O["note_index"] = f"""with {_NAMES}, k as (select * from (values {_NOTES}) as k(k, word))
    select doc_id, k::varchar as key, k::bigint as source_page, {CHAPTERS * PAGES + 1}::bigint as dest_page, 'Chapter ' || ((k - 1) // {PAGES} + 1) as section_label, k || '. This note explains the ' || word || ' of ' || name || ' in full.' as dest_text from n, k"""


def note_decisions(spark, sf):
    """What the recognition log decided on the books' markers."""
    model, _, _ = analyse_documents(set_for_nations(spark, sf, noted()))
    return table_of(model, "log").where("type = 'endnote'").groupBy("doc_id", "decision").agg(F.count("*").alias("n"))


Q["note_decisions"] = note_decisions
O["note_decisions"] = f"select n_nationkey::varchar as doc_id, 'accepted' as decision, {CHAPTERS * PAGES}::bigint as n from nation"


def book_sections(spark, sf):
    """The sections of both kinds of book."""
    out = None
    for kind, rows in (("noted", noted()), ("versed", versed())):
        model, _, _ = analyse_documents(set_for_nations(spark, sf, rows))
        part = table_of(model, "sections").select(F.lit(kind).alias("kind"), "doc_id", "section_id", "type", "label", F.col("page").cast("bigint").alias("page"), "parent", F.col("depth").cast("bigint").alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


_SECTIONS = [("noted", "s0", "root", "Document", 1, None, 0), ("noted", "s1", "chapter", "Chapter 1", 1, "s0", 1), ("noted", "s2", "chapter", "Chapter 2", 4, "s0", 1), ("noted", "s3", "apparatus", "Notes", 7, "s0", 1), ("versed", "s0", "root", "Document", 1, None, 0), ("versed", "s1", "book", "Book 1", 1, "s0", 1), ("versed", "s2", "book", "Book 2", 2, "s0", 1), ("versed", "s3", "book", "Book 3", 4, "s0", 1)]
Q["book_sections"] = book_sections
O["book_sections"] = "select s.*, n_nationkey::varchar as doc_id from nation, (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::bigint" for v in row) + ")" for row in _SECTIONS) + ") as s(kind, section_id, type, label, page, parent, depth)"


def verse_lines(spark, sf):
    """The lines of the books' verse, numbered from the few numbers in the margin."""
    model, _, _ = analyse_documents(set_for_nations(spark, sf, versed()))
    return table_of(model, "blocks").where("type = 'verse-line'").select("doc_id", F.col("line").cast("bigint").alias("line"), "section", "text")


_VERSES = ", ".join(f"({n}, '{verse(n)}{',' if n % 3 else '.'}')" for n in range(1, VERSES + 1))
Q["verse_lines"] = verse_lines
O["verse_lines"] = f"with {_NAMES}, v as (select * from (values {_VERSES}) as v(line, t)) select doc_id, line::bigint as line, 's2' as section, replace(t, '{{name}}', name) as text from n, v"


def locus_edges(spark, sf):
    """Where the books' prose points into their verse."""
    model, _, _ = analyse_documents(set_for_nations(spark, sf, versed()))
    lines = table_of(model, "blocks").where("type = 'verse-line'").select("doc_id", F.col("block_id").alias("to"), F.col("line").cast("bigint").alias("line"), "text")
    return table_of(model, "refs").join(lines, ["doc_id", "to"]).select("doc_id", "source_text", "line", "text")


Q["locus_edges"] = locus_edges
O["locus_edges"] = f"with {_NAMES} select doc_id, 'Book 2, line 35' as source_text, 35::bigint as line, replace('{verse(35)},', '{{name}}', name) as text from n"


def inline_texts(spark, sf):
    """Blocks put together again from their inline pieces."""
    model, _, _ = analyse_documents(set_for_nations(spark, sf, noted()))
    pieces = inline_view(model).where("kind = 'reference-marker'")
    return pieces.groupBy("doc_id").agg(F.count("*").alias("markers"), F.array_join(F.array_sort(F.collect_list("text")), "").alias("texts"))


Q["inline_texts"] = inline_texts
O["inline_texts"] = f"select n_nationkey::varchar as doc_id, {CHAPTERS * PAGES}::bigint as markers, '{''.join(f'[{k}]' for k in range(1, CHAPTERS * PAGES + 1))}' as texts from nation"
