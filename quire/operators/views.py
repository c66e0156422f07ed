"""Read-side filters, lifecycle tables and small document-level steps, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import chunk_of

SHOWN_REFERENCES, SHOWN_RECORDS = 600, 800
#: Structural kinds of references, which a reader shows with less weight.
STRUCTURAL = ("structural-navigation", "cross-reference", "page-reference", "figure", "table", "appendix", "hyperlink", "external")
CAPS = {"unresolved": 200, "removed": 400, "repaired": 200, "recognition": 4000}


def filter_references(refs: DataFrame, kind: str | None = None, method: str | None = None, label: str = "", shown: int = SHOWN_REFERENCES) -> DataFrame:
    """References of a kind and method whose key holds a text, case aside; the first of them in reading order."""
    hit = F.lit(True)
    for column, value in (("type", kind), ("method", method)):
        hit = hit & (F.col(column) == value if value else F.lit(True))
    return refs.where(hit & F.contains(F.lower("key"), F.lit(label.lower()))).orderBy("doc_id", "from", "start").limit(shown)


def filter_log(log: DataFrame, decision: str | None = None, text: str = "", shown: int = SHOWN_RECORDS) -> DataFrame:
    """The first decisions of a kind, by place, whose method, type or reason holds a text."""
    said = F.lower(F.concat_ws(" ", "method", "type", "reason"))
    return log.where((F.col("decision") == decision if decision else F.lit(True)) & F.contains(said, F.lit(text.lower()))).orderBy(*[c for c in ("doc_id", "from", "start", "method", "type") if c in log.columns]).limit(shown)


def filter_index(index: DataFrame, show: str = "all", text: str = "", sections_count: bool = True) -> DataFrame:
    """Rows of the reference index: all, unresolved or ambiguous ones, with a text in any of what a reader sees.

    sections_count: whether a destination that is only a section counts as one.
    """
    goal = F.coalesce("to", "to_section") if sections_count and "to_section" in index.columns else F.col("to")
    keep = {"all": F.lit(True), "unresolved": goal.isNull(), "ambiguous": F.col("ambiguous")}[show]
    seen = F.lower(F.concat_ws("\n", "key", "type", "system_label", "source_sentence", "dest_text"))
    return index.where(keep & F.contains(seen, F.lit(text.lower())))


def page_view(blocks: DataFrame, page: int) -> DataFrame:
    """Blocks that start on a page, with whether their verse line shows its number (every fifth does)."""
    return blocks.where(F.col("page") == page).withColumn("shows_line", F.coalesce((F.col("type") == "verse-line") & (F.col("line") % 5 == 0), F.lit(False)))


def weighted(refs: DataFrame, active: list[str]) -> DataFrame:
    """References with whether they are dimmed (their system is not among the active ones) and structural."""
    return refs.withColumn("dimmed", ~F.coalesce(F.col("system").isin(active), F.lit(not active))).withColumn("structural", F.col("type").isin(*STRUCTURAL))


def reference_remarks(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, ref_id, tone, code): what is wrong with where a reference is anchored."""
    r = refs.join(blocks.select("doc_id", F.col("block_id").alias("from"), F.length("text").alias("paragraph")), ["doc_id", "from"], "left")
    c = F.col
    mark, said = c("end") - c("start"), c("sentence_end") - c("sentence_start")
    inline = c("type") != "line-note"
    goal = c("to").isNotNull() | c("to_section").isNotNull()
    rules = [
        ("empty-marker", "bad", mark <= 0), ("outside-sentence", "bad", (c("start") < c("sentence_start")) | (c("end") > c("sentence_end"))), ("empty-sentence", "bad", said <= 0), ("short-sentence", "warn", said.between(1, 11) & inline),
        ("sentence-is-paragraph", "warn", (said == c("paragraph")) & (c("paragraph") > 400) & inline), ("ambiguous", "warn", c("ambiguous")), ("unresolved", "bad", ~goal), ("low-confidence", "warn", goal & (c("confidence") < 0.5)), ("no-evidence", "warn", F.size("signals") == 0),
    ]
    return r.select("doc_id", "ref_id", F.inline(F.array_compact(F.array(*[F.when(test, F.struct(F.lit(tone).alias("tone"), F.lit(code).alias("code"))) for code, tone, test in rules]))))


def clipped(pieces: DataFrame, start: Column, end: Column, mark_start: Column, mark_end: Column) -> DataFrame:
    """Inline pieces (start, end, text, ...) cut to a range and at the borders of a mark, each with whether it is marked."""
    inside = F.filter(F.array(mark_start, mark_end), lambda m: (m > F.greatest("start", start)) & (m < F.least("end", end)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.greatest("start", start), F.least("end", end)), inside)))
    bits = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.struct(F.get("cuts", k).alias("a"), F.get("cuts", k + 1).alias("b")))
    rest = [c for c in pieces.columns if c not in ("start", "end", "text")]
    kept = pieces.where(F.least("end", end) > F.greatest("start", start)).withColumn("cuts", cuts).withColumn("bit", F.explode(bits))
    a, b = F.col("bit.a"), F.col("bit.b")
    return kept.select(*rest, a.alias("start"), b.alias("end"), F.substring("text", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("text"), ((a >= mark_start) & (b <= mark_end)).alias("marked"))


def refined_pages(pages: DataFrame, recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, kind of each document) once recognition has run: a scan without an image is an empty page.

    pages (doc_id, page, kind, method, recovered); a missing kind follows from how the page was read.
    recognised (doc_id, page, has_image).
    """
    kind = F.coalesce("kind", F.when(F.col("method") == "native", "native").when(F.col("recovered"), "poor_native").otherwise("scanned"))
    blank = (F.col("kind") == "scanned") & ~F.coalesce("has_image", F.lit(True))
    seen = pages.withColumn("kind", kind).join(recognised.select("doc_id", "page", "has_image"), ["doc_id", "page"], "left")
    done = seen.withColumn("method", F.when(blank, "empty").otherwise(F.col("method"))).withColumn("kind", F.when(blank, "empty").otherwise(F.col("kind"))).drop("has_image")
    native, scanned = F.count_if(F.col("kind") == "native"), F.count_if(F.col("kind").isin("scanned", "poor_native"))
    return done, done.groupBy("doc_id").agg(F.when((native == 0) & (scanned == 0), "empty").when(scanned == 0, "native-text").when(native > 0, "mixed").otherwise("scanned").alias("kind"))


def snapped_sizes(spans: DataFrame, share: float = 0.16) -> DataFrame:
    """Recognised spans whose size is within a share of the document's most frequent one take that; ties go to the first seen."""
    sizes = spans.groupBy("doc_id", "s").agg(F.count("*").alias("n"), F.min(F.struct("page", "o")).alias("first")).groupBy("doc_id").agg(F.min_by("s", F.struct(-F.col("n"), "first")).alias("body"))
    near = (F.col("body") > 0) & (F.abs(F.col("s") - F.col("body")) <= F.col("body") * share)
    return spans.join(sizes, "doc_id").withColumn("s", F.when(near, F.col("body")).otherwise(F.col("s"))).drop("body")


def with_made_systems(systems: DataFrame, blocks: DataFrame, sections: DataFrame, links: DataFrame) -> DataFrame:
    """Systems of all documents with those that come from elsewhere: verse lineation, and links of the file."""
    verse = blocks.where("type = 'verse-line'").groupBy("doc_id").agg(F.count("*").cast("int").alias("entry_count"))
    hosts = sections.where("verse").groupBy("doc_id").agg(F.collect_list("section_id").alias("hosts"))
    made = lambda df, i, kind, label, grammar, scope, sure: df.select("doc_id", F.lit(i).alias("system_id"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(grammar).alias("grammar"), F.lit(scope).alias("key_scope"), F.coalesce("hosts", F.array().cast("array<string>")).alias("hosts"), "entry_count", F.lit(sure).alias("confidence"))
    lines = made(verse.join(hosts, "doc_id", "left"), "sys-lines", "line-numbering", "Verse lineation", "line-keyed", "book", 0.95)
    counted = links.groupBy("doc_id").agg(F.count("*").cast("int").alias("entry_count")).withColumn("hosts", F.lit(None).cast("array<string>"))
    return lines.unionByName(systems.select(lines.columns)).unionByName(made(counted, "sys-links", "internal-link", "Embedded links", "none", "document", 1.0))


def import_summary(measures: DataFrame) -> DataFrame:
    """One row for each document: its measures as a map, for a documents table's summary column."""
    names = [c for c in measures.columns if c != "doc_id"]
    return measures.select("doc_id", F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))]).alias("summary"))


def capped(rows: DataFrame, kind: str, order: str = "ord") -> DataFrame:
    """The first rows of each document, as many as a stored log of a kind holds."""
    w = Window.partitionBy("doc_id").orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= CAPS[kind]).drop("__n")


def write_chunks(blocks: DataFrame, path: str) -> None:
    """Blocks by document and 25-page chunk; a document's partitions are replaced and no others."""
    placed = blocks.withColumn("chunk", chunk_of(F.col("page")).cast("int")).repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "ord")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id", "chunk").parquet(path)


def without_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents that go."""
    return {name: df.join(gone.select("doc_id").distinct(), "doc_id", "left_anti") for name, df in tables.items()}


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "title", "status", "progress", "page_count", "created_at").orderBy(F.desc("created_at"), "doc_id")


def known_files(paths: DataFrame, known: list[str]) -> DataFrame:
    """Those of a short list of paths that are stored."""
    wanted = paths.sparkSession.createDataFrame([(k,) for k in known], "path string")
    return wanted.join(paths.select("path"), "path", "left_semi")




def embedded_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, embedded, n): how many embedded regions of each type a document has."""
    return blocks.where("embedded is not null").groupBy("doc_id", "embedded").agg(F.count("*").alias("n"))


def distinct_values(spans: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, sizes, types, methods, decisions): the distinct sizes of spans, ascending, and what a reader can filter by."""
    sizes = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("sizes"))
    kinds = refs.groupBy("doc_id").agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("type", "method", "decision")])
    return sizes.join(kinds, "doc_id", "full_outer")


def unresolved(refs: DataFrame) -> DataFrame:
    """(doc_id, from, start, key, reason, ord): edges without a destination, by place, as a document's log holds them."""
    left = refs.where(F.coalesce(F.col("to"), F.col("to_section")).isNull() & (F.col("type") != "external"))
    w = Window.partitionBy("doc_id").orderBy("from", "start")
    reason = F.coalesce("reason", F.when(F.col("ambiguous"), "ambiguous").otherwise("no destination"))
    return left.select("doc_id", "from", "start", "key", reason.alias("reason"), F.row_number().over(w).alias("ord"))


def inserted(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents with new rows (doc_id, title, storage_path): queued, without progress; ids that are there already stay as they are.

    A title that is missing is the file's name without its ending.
    """
    name = F.regexp_replace(F.element_at(F.split("storage_path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    fresh = new.dropDuplicates(["doc_id"]).join(documents.select("doc_id"), "doc_id", "left_anti")
    fresh = fresh.select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), name).alias("title"), "storage_path", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error"))
    return documents.unionByName(fresh, allowMissingColumns=True)


def failed(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """documents with those that errors (doc_id, error) name set to failed, with the first message by order; progress stays."""
    first = errors.groupBy("doc_id").agg(F.min("error").alias("__error"), F.lit(True).alias("__failed"))
    joined = documents.join(first, "doc_id", "left")
    held = joined.withColumn("status", F.when(F.col("__failed"), "failed").otherwise(F.col("status"))).withColumn("error", F.coalesce("__error", "error"))
    return held.drop("__error", "__failed")
