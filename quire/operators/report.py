"""What became of a document: ten stages with their measures, issues, readiness; and remarks on single blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.stats import percent

STAGES = ("extraction", "font-unicode", "geometry", "reading-order", "structure", "text-normalization", "reference-extraction", "reference-classification", "reference-resolution", "artifact")
PROSE = ("paragraph", "blockquote", "letter", "list-item")


def page_items(spans: DataFrame) -> DataFrame:
    """(doc_id, page, items, chars, bad): each page's spans, their letters, and those that could not be read."""
    bad = F.length("t") - F.length(F.regexp_replace("t", r"[\x00\x{FFFD}]", ""))
    return spans.groupBy("doc_id", "page").agg(F.count("*").alias("items"), F.sum(F.length("t")).alias("chars"), F.sum(bad).alias("bad"))


def measures(spans: DataFrame, pages: DataFrame, model: DataFrame, removed: DataFrame, lines: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row for each document of pages (doc_id, page, method, mean_confidence, error): all that the stages go by. items: the
    spans' page_items, where they are made already."""
    items = page_items(spans) if items is None else items
    ocr = F.col("method") == "ocr"
    page = pages.join(items, ["doc_id", "page"], "left").groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(F.coalesce("items", F.lit(0)) > 0).alias("with_text"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count_if(ocr).alias("ocr_pages"), F.count_if(ocr & (F.col("error").isNotNull() | F.col("items").isNull())).alias("ocr_failed"), F.coalesce(F.avg(F.when(ocr, F.coalesce("mean_confidence", F.lit(0.0)))), F.lit(0.0)).alias("ocr_conf"),
    )
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    has = lambda test: F.size(F.filter("blocks", test))
    made = model.select(
        "doc_id", size("blocks").alias("blocks"), (size("sections") - 1).alias("sections"), size("refs").alias("refs"), size("rejected").alias("rejected"), size("systems").alias("systems"), size("entries").alias("entries"),
        has(lambda b: b["type"] == "heading").alias("headings"), has(lambda b: b["text"].rlike("[a-z]{2}[.,;!?”][A-Za-z]")).alias("glued"), has(lambda b: b["text"].rlike(r"[\x00\x{FFFD}]")).alias("residue"), has(lambda b: b["text"].rlike(r"[A-Za-z0-9_]-\s[A-Za-z0-9_]")).alias("hyphens"),
        F.size(F.filter("refs", lambda r: r["to"].isNotNull() | r["to_section"].isNotNull())).alias("resolved"), F.size(F.filter("refs", lambda r: r["ambiguous"])).alias("ambiguous"), F.size(F.filter("refs", lambda r: r["provenance"] == "explicit-link")).alias("explicit"),
    )
    gone = removed.groupBy("doc_id").agg(F.count("*").alias("furniture"))
    kept = lines.groupBy("doc_id").agg(F.count("*").alias("lines"))
    full = page.join(made, "doc_id", "left").join(gone, "doc_id", "left").join(kept, "doc_id", "left")
    return full.na.fill(0).withColumn("coverage", percent(F.col("with_text"), F.col("pages"))).withColumn("bad_pct", percent(F.col("bad"), F.col("chars"))).withColumn("resolved_pct", percent(F.col("resolved"), F.col("refs")))


def stages(m: DataFrame) -> DataFrame:
    """(doc_id, n, stage, status, metrics map): the ten stages; those after a failed extraction are skipped."""
    c = F.col
    dead = (c("items") == 0) | (c("coverage") < 50)
    weak = (c("coverage") < 92) | (c("ocr_failed") > 0) | ((c("ocr_pages") > 0) & (c("ocr_conf") > 0) & (c("ocr_conf") < 0.75))
    kept = c("lines") - c("furniture")
    # A document without an error but with a warning anywhere is degraded.
    text_warn = (c("residue") > 0) | (c("glued") > c("blocks") * 0.01)
    status = {
        "extraction": F.when(dead, "failed").when(weak, "warn").otherwise("ok"),
        "font-unicode": F.when(c("bad_pct") > 2, "failed").when(c("bad") > 0, "warn").otherwise("ok"),
        "geometry": F.when((c("items") > 3) & (c("lines") == 0), "warn").otherwise("ok"),
        "reading-order": F.when(c("blocks") == 0, "failed").when((kept > 0) & (c("blocks") / F.greatest(F.lit(1), kept) > 0.9), "warn").otherwise("ok"),
        "structure": F.when((c("sections") <= 0) & (c("pages") > 15), "failed").when((c("sections") < 3) & (c("pages") > 80), "warn").otherwise("ok"),
        "text-normalization": F.when(text_warn, "warn").otherwise("ok"),
        "reference-extraction": F.lit("ok"),
        "reference-classification": F.when(c("rejected") > 0, "warn").otherwise("ok"),
        "reference-resolution": F.when((c("refs") > 0) & (c("resolved_pct") < 60), "failed").when((c("refs") > c("resolved")) | (c("ambiguous") > 0), "warn").otherwise("ok"),
    }
    metrics = {
        "extraction": ("pages", "items", "chars", "with_text", "coverage", "ocr_pages", "ocr_failed", "ocr_conf"), "font-unicode": ("bad", "bad_pct"), "geometry": ("lines",), "reading-order": ("blocks", "furniture"), "structure": ("sections", "headings"),
        "text-normalization": ("blocks", "glued", "residue", "hyphens"), "reference-extraction": ("systems", "entries", "refs", "explicit"), "reference-classification": ("rejected",), "reference-resolution": ("refs", "resolved", "ambiguous", "resolved_pct"), "artifact": ("blocks", "sections", "refs"),
    }
    ready = readiness_of(m)
    rows = []
    for n, name in enumerate(STAGES):
        if name == "artifact":
            s = F.when(ready == "unreadable", "failed").when(ready == "degraded", "warn").otherwise("ok")
        else:
            s = status[name] if name == "extraction" else F.when(dead, "skipped").otherwise(status[name])
        values = F.create_map(*[x for k in metrics[name] for x in (F.lit(k), c(k).cast("double"))])
        rows.append(F.struct(F.lit(n).alias("n"), F.lit(name).alias("stage"), s.alias("status"), values.alias("metrics")))
    return m.select("doc_id", F.inline(F.array(*rows)))


def readiness_of(m: DataFrame):
    """unreadable where an error stands, degraded where a warning does, else ready."""
    return F.when(F.size(F.filter(_issues(), lambda i: i["severity"] == "error")) > 0, "unreadable").when(F.size(_issues()) > 0, "degraded").otherwise("ready")


def _issues():
    """The issues of a row of measures, as array<struct<code, severity, stage>>."""
    c = F.col
    dead = (c("items") == 0) | (c("coverage") < 50)
    share = c("ocr_pages") / F.greatest(F.lit(1), c("pages"))
    rules = [
        ("extraction-failure", "error", "extraction", c("items") == 0),
        ("ocr-required", "error", "extraction", (c("items") > 0) & (c("coverage") < 50)),
        ("ocr-required", "warn", "extraction", (c("items") > 0) & c("coverage").between(50, 91.999)),
        ("ocr-required", "warn", "extraction", (c("ocr_failed") > 0) & (c("items") > 0)),
        ("low-ocr-confidence", "error", "extraction", (c("ocr_pages") > 0) & (c("ocr_conf") > 0) & (c("ocr_conf") < 0.6) & (share >= 0.2)),
        ("low-ocr-confidence", "warn", "extraction", (c("ocr_pages") > 0) & (c("ocr_conf") > 0) & (c("ocr_conf") < 0.75) & ~((c("ocr_conf") < 0.6) & (share >= 0.2))),
        ("malformed-fonts", "error", "font-unicode", ~dead & (c("bad_pct") > 2)),
        ("malformed-fonts", "warn", "font-unicode", ~dead & (c("bad_pct") <= 2) & (c("bad") > 0)),
        ("unsupported-pdf-structure", "error", "reading-order", ~dead & (c("blocks") == 0)),
        ("structure-detection-failure", "error", "structure", ~dead & (c("sections") <= 0) & (c("pages") > 15)),
        ("structure-detection-failure", "warn", "structure", ~dead & c("sections").between(1, 2) & (c("pages") > 80)),
        ("unsupported-reference-system", "warn", "reference-classification", ~dead & (c("rejected") > 0)),
        ("unresolved-references", "warn", "reference-resolution", ~dead & (c("refs") > c("resolved"))),
        ("ambiguous-references", "warn", "reference-resolution", ~dead & (c("ambiguous") > 0)),
    ]
    found = F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(stage).alias("stage"))) for code, severity, stage, test in rules])
    return F.filter(found, lambda i: i.isNotNull())


def issues(m: DataFrame) -> DataFrame:
    """(doc_id, code, severity, stage)."""
    return m.select("doc_id", F.inline(_issues()))


def readiness(m: DataFrame) -> DataFrame:
    return m.select("doc_id", readiness_of(m).alias("readiness"))


def remarks(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, block_id, tone, code): what a reader of single blocks should know; tones ok, warn, bad."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ord")
    out = refs.groupBy("doc_id", F.col("from").alias("block_id")).agg(F.count("*").alias("out"), F.count_distinct("system").alias("systems"), F.count_if(F.col("to").isNull() & F.col("to_section").isNull()).alias("open"), F.count_if((F.col("to").isNotNull() | F.col("to_section").isNotNull()) & (F.col("confidence") < 0.7)).alias("unsure"))
    twice = refs.groupBy("doc_id", F.col("from").alias("block_id"), "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "block_id").distinct().withColumn("twice", F.lit(True))
    into = refs.where(F.col("to").isNotNull()).groupBy("doc_id", F.col("to").alias("block_id")).agg(F.count("*").alias("into"))
    all_ = blocks.withColumn("step", F.when(F.lag("type").over(w) == "verse-line", F.col("line") - F.lag("line").over(w)))
    for t in (out, twice, into):
        all_ = all_.join(t, ["doc_id", "block_id"], "left")
    c = F.col
    prose = c("type").isin(*PROSE)
    rules = [
        ("verse", "ok", c("type") == "verse-line"), ("line-sequence-broken", "bad", (c("type") == "verse-line") & ((c("step") <= 0) | (c("step") > 12))), ("no-line-number", "warn", (c("type") == "verse-line") & c("line").isNull()),
        ("reference-in-heading", "warn", (c("type") == "heading") & (c("out") > 0)), ("very-long", "warn", prose & (F.length("text") > 1400)), ("bare-number", "warn", prose & F.substring("text", 1, 12).rlike(r"(?<![A-Za-z0-9_])[0-9]{1,4}\s{2,}\S")),
        ("entry-referenced", "ok", (c("type") == "entry") & (c("into") > 0)), ("entry-orphaned", "warn", (c("type") == "entry") & c("into").isNull()), ("same-reference-twice", "warn", c("twice")), ("unresolved", "bad", c("open") > 0), ("unsure", "warn", c("unsure") > 0), ("several-systems", "warn", c("systems") > 1),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(tone).alias("tone"), F.lit(code).alias("code"))) for code, tone, test in rules]))
    return all_.select("doc_id", "block_id", F.inline(found))


def worst_tone(remark_table: DataFrame) -> DataFrame:
    """(doc_id, block_id, tone): the worst remark on each block."""
    rank = F.create_map(F.lit("ok"), F.lit(0), F.lit("warn"), F.lit(1), F.lit("bad"), F.lit(2))
    return remark_table.groupBy("doc_id", "block_id").agg(F.max_by("tone", F.element_at(rank, F.col("tone"))).alias("tone"))
