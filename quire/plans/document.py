"""A document from its spans to its reference graph, and the tables that queries read.

Pages are folded to lines in parallel, furniture is found by aggregates and joins over all documents at once, and then
each document is assembled on its own (its order is its meaning). The result is one row for each document with its
tables nested; `blocks`, `sections`, `systems`, `entries`, `references` and `decisions` lay them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from quire.functions.spans import inline_pieces
from quire.functions.stats import first_mode
from quire.operators import layout
from quire.operators.content import ZONE, Profile, assemble
from quire.operators.graph import settled
from quire.operators.lines import build_lines
from quire.operators.references import may_refer, references
from quire.operators.systems import apparatus, page_notes
from quire.operators.verse import verse_input, verse_regions

GATE = 50

_RUN = "struct<t:string,em:boolean,strong:boolean,sup:boolean,sub:boolean,code:boolean,sc:boolean,sources:array<struct<page:int,o:int>>>"
_BOX = "struct<page:int,x:double,y:double,w:double,h:double>"
TABLES = {
    "blocks": f"struct<block_id:string,ord:int,page:int,type:string,level:int,section:string,text:string,runs:array<{_RUN}>,line:int,key:string,system:string,lemma:string,group:string,group_edge:string,pages:array<int>,boxes:array<{_BOX}>>",
    "sections": "struct<section_id:string,type:string,label:string,number:int,title:string,page:int,parent:string,depth:int,start:int,end:int,verse:boolean>",
    "systems": "struct<system_id:string,kind:string,label:string,grammar:string,key_scope:string,hosts:array<string>,entry_count:int,confidence:double>",
    "entries": "struct<block_id:string,system:string,key:string,numeric:int,lemma:string,section:string>",
    "rejected": "struct<label:string,reason:string>",
    "refs": "struct<ref_id:string,type:string,system:string,from:string,start:int,end:int,source_text:string,sentence_start:int,sentence_end:int,key:string,to:string,to_section:string,method:string,confidence:double,signals:array<string>,exact:boolean,provenance:string,url:string,ambiguous:boolean,candidates:array<struct<to:string,key:string,score:double>>,score:double,dest:double>",
    "log": "struct<ref_id:string,block_id:string,start:int,end:int,method:string,type:string,signals:array<string>,recognition:double,destination:string,destination_confidence:double,decision:string,reason:string>",
}
MODEL = "doc_id string, " + ", ".join(f"{k} array<{v}>" for k, v in TABLES.items()) + ", profile struct<body:double,indent:double,left:double,right:double,leading:double>"


def verse_gate(lines: DataFrame) -> DataFrame:
    """(doc_id, verse): which lines (page, idx) of a document may be verse; null where all may, since only verse without numbers
    is proven. Documents of fewer than GATE lines have no row: all of theirs may."""
    long = lines.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= GATE).select("doc_id")
    mine = lines.join(long, "doc_id", "left_semi")
    given = settled(verse_input(mine, line_measures(mine)))
    regions = settled(verse_regions(given).where("proven"))
    numbered = regions.groupBy("doc_id").agg(F.max("chains").alias("chains"))
    covered = regions.select("doc_id", F.explode(F.sequence("start", "end")).alias("pos"))
    allowed = given.select("doc_id", "pos", "page", "idx").join(covered, ["doc_id", "pos"], "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("page", "idx")).alias("allowed"))
    none = F.array().cast("array<struct<page:int,idx:int>>")
    return long.join(numbered, "doc_id", "left").join(allowed, "doc_id", "left").select("doc_id", F.when(F.col("chains") == 0, None).otherwise(F.coalesce("allowed", none)).alias("verse"))


def _zone(lines: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, last, edge, *more): where the last thing begins to the right, and the first of the lines over 40 letters, rounded down."""
    starts = F.array_max(F.concat(F.array("x"), F.transform("runs", lambda r: r["x"])))
    edge = F.floor(F.coalesce(F.min(F.when(F.length("text") > 40, F.col("x"))), F.lit(0.0)))
    return lines.groupBy("doc_id").agg(F.max(starts).alias("last"), edge.alias("edge"), *more)


def zoned(lines: DataFrame) -> DataFrame:
    """(doc_id) of the documents in which a line may lie in a zone of verse: those where something begins a ZONE to the right of
    where the first of the lines over 40 letters does, rounded down, and those without such lines. Elsewhere nothing asks the gate."""
    return _zone(lines).where(F.col("last") >= F.col("edge") + ZONE).select("doc_id")


def document_facts(lines: DataFrame) -> DataFrame:
    """(doc_id, repeats, long, zoned), what tells which steps a document needs, in one pass. repeats: it may have furniture or page
    numbers, for it has two pages, or short lines enough for a shape. long: it has GATE lines. zoned: as `zoned` has it."""
    short = F.count(F.when(F.length("text") <= layout.SHAPE_LETTERS, True))
    repeats = (F.min("page") < F.max("page")) | (short >= layout.SHAPE_LEAST)
    found = _zone(lines, F.coalesce(repeats, F.lit(False)).alias("repeats"), (F.count("*") >= GATE).alias("long"))
    return found.select("doc_id", "repeats", "long", F.coalesce(F.col("last") >= F.col("edge") + ZONE, F.lit(False)).alias("zoned"))


def gated(lines: DataFrame, facts: DataFrame, removed: DataFrame) -> DataFrame:
    """The lines left of the documents that the gate of verse is to be asked for: long and zoned without their furniture. What no
    furniture was taken from is as its facts say; of the rest the long ones are looked at again."""
    taken = removed.select("doc_id").distinct().withColumn("taken", F.lit(True))
    asked = facts.where("long").join(taken, "doc_id", "left").where("zoned or taken").select("doc_id")
    kept = settled(lines.join(asked, "doc_id", "left_semi").join(removed.select("doc_id", "page", "idx"), ["doc_id", "page", "idx"], "left_anti"))
    return kept.join(zoned(kept), "doc_id", "left_semi")


def model_type(tables: dict[str, list[str]] | None) -> StructType:
    """The model's type, of all tables or of those named and their columns."""
    whole = StructType.fromDDL(MODEL)
    if tables is None:
        return whole
    pick = lambda name: StructType([f for f in whole[name].dataType.elementType if f.name in tables[name]])
    return StructType([whole["doc_id"], *[StructField(name, ArrayType(pick(name))) for name in TABLES if name in tables]])


def line_measures(lines: DataFrame) -> DataFrame:
    """(doc_id, body, leading): the most frequent size of lines over 40 letters, 12 where there are none, and gap, to a half; of
    equals the first seen. One pass: each line counts for both."""
    half = lambda c: F.floor(F.col(c) * 2 + 0.5) / 2
    counted = F.array(
        F.when(F.length("text") > 40, F.struct(F.lit("body").alias("kind"), half("size").alias("bin"))),
        F.when((F.col("gap") > 2) & (F.col("gap") < 60), F.struct(F.lit("leading").alias("kind"), half("gap").alias("bin"))),
    )
    bins = lines.select("doc_id", F.struct("page", "idx").alias("at"), F.explode(counted).alias("m")).where("m is not null").groupBy("doc_id", "m.kind", "m.bin").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    most = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("bin")), F.when(F.col("kind") == kind, F.struct(-F.col("n"), F.col("at"))))
    found = bins.groupBy("doc_id").agg(most("body").alias("body"), most("leading").alias("leading"))
    return lines.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("body", F.lit(0.0)), F.lit(12.0)).alias("body"), F.coalesce("leading", F.lit(0.0)).alias("leading"))


def analyse(doc: dict, wanted: frozenset[str] = frozenset(TABLES)) -> dict:
    """One document's tables from {doc_id, title, lines, outline, links, page_map, verse, and removed: (page, idx) of lines that
    are no text}; no step is taken that none of the wanted ones depends on."""
    gone = {(r["page"], r["idx"]) for r in doc.get("removed") or []}
    lines = sorted((line for line in doc["lines"] or [] if (line["page"], line["idx"]) not in gone), key=lambda line: (line["page"], line["idx"]))
    profile = Profile.of(lines)
    outline = sorted(doc["outline"] or [], key=lambda o: o["ord"])
    verse = None if doc["verse"] is None else {(v["page"], v["idx"]) for v in doc["verse"]}
    may_be_verse = lambda line: verse is None or (line["page"], line["idx"]) in verse
    noted = bool(wanted - {"sections"})
    blocks, sections, profile = assemble(lines, outline, doc["title"] or "Document", may_be_verse, profile, noted)
    found = {"doc_id": doc["doc_id"], "sections": sections, "profile": vars(profile)}
    if not noted:
        return found
    systems, entries, rejected = apparatus(blocks, sections, any(b["type"] == "verse-line" for b in blocks))
    more, notes = page_notes(blocks, sections, len(systems))
    systems, entries = systems + more, entries + notes
    found |= {"blocks": blocks, "systems": systems, "entries": entries, "rejected": rejected}
    if wanted & {"refs", "log"}:
        # Without notes, links, headings and raised keys all that may be proposed stands in the words; most texts have none such.
        plain = not (entries or doc["links"] or len(sections) > 1 or any(r.get("sup") for b in blocks for r in b["runs"]))
        if plain and not may_refer("\n".join(b["text"] for b in blocks)):
            return found | {"refs": [], "log": []}
        found["refs"], found["log"] = references(blocks, sections, systems, entries, doc["links"] or [], doc["page_map"] or [])
    return found


def _fit(value, kind):
    """A value with just the fields that an Arrow type has."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _fit(value.get(f.name), f.type) for f in kind}
    if pa.types.is_list(kind):
        return [_fit(v, kind.value_type) for v in value]
    if pa.types.is_floating(kind):
        return float(value)
    return int(value) if pa.types.is_integer(kind) else value


def _values(column: pa.Array) -> list:
    """What to_pylist gives, made leaf by leaf: nested rows are put together from whole columns."""
    kind = column.type
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, v, strict=True)) for v in zip(*map(_values, column.flatten()), strict=True)]
        return [row if held else None for row, held in zip(rows, column.is_valid().to_pylist(), strict=True)] if column.null_count else rows
    if pa.types.is_list(kind):
        items, at, out = _values(column.flatten()), 0, []
        for n in column.value_lengths().to_pylist():
            out.append(None if n is None else items[at : at + n])
            at += n or 0
        return out
    if column.null_count or not (pa.types.is_floating(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _analyser(schema: pa.Schema):
    wanted = frozenset(schema.names) & frozenset(TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [analyse(row, wanted) for row in _values(batch.to_struct_array())]
            yield pa.RecordBatch.from_arrays([pa.array([_fit(found[f.name], f.type) for found in made], f.type) for f in schema], schema=schema)

    return run


def body_profile(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size): the most frequent size, to a half, of lines over 40 letters; 12 where there are none."""
    long = lines.where(F.length("text") > 40).withColumn("pos", F.struct("page", "idx"))
    sizes = first_mode(long, ["doc_id"], "size", "pos", 0.5, "body_size")
    return lines.select("doc_id").distinct().join(sizes, "doc_id", "left").select("doc_id", F.coalesce("body_size", F.lit(12.0)).cast("double").alias("body_size"))


def analyse_documents(spans: DataFrame, outline: DataFrame | None = None, links: DataFrame | None = None, titles: DataFrame | None = None, tables: dict[str, list[str]] | None = None, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, removed lines, page map) of documents.

    spans as quire.operators.lines has them; outline (doc_id, ord, title, page, depth); links (doc_id, page, x, y, w, h,
    text, dest_page, dest_y, url); titles (doc_id, title). The model is one row for each document; tables: those of its tables
    and of their columns that are asked for, all by default. What is not asked for is not made. lines: those of build_lines, settled,
    where the caller has made them already.
    """
    spark = spans.sparkSession
    # Furniture, numbers, verse and texts all read the lines; they are folded once and lie in the shared folder.
    lines = settled(build_lines(spans)) if lines is None else lines
    facts = settled(document_facts(lines))
    # Most documents are too short for anything to repeat in them; their lines are not looked at.
    held = settled(lines.select("doc_id", "page", "idx", "y", "size", "text").join(facts.where("repeats").select("doc_id"), "doc_id", "left_semi"))
    numbers = settled(layout.page_numbers(held))
    removed = settled(layout.furniture(held, body_profile(held), numbers))
    mapped = layout.page_map(removed, numbers)
    by_doc = lambda df, name: df.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias(name))
    # Assembling is work by document, not by byte: as many tasks as a shuffle has, whatever the sizes. All lines are dealt out once;
    # those removed go with them, and are left out where the document is assembled.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = by_doc(lines.repartition(tasks, "doc_id"), "lines").join(by_doc(mapped.select("doc_id", "page", "printed", "roman"), "page_map"), "doc_id", "left")
    gone = by_doc(removed.select("doc_id", "page", "idx"), "removed")
    docs = docs.join(gone, "doc_id", "left").where(F.size("lines") > F.coalesce(F.size(F.array_distinct("removed")), F.lit(0)))
    blank = {"outline": "array<struct<ord:int,title:string,page:int,depth:int>>", "links": "array<struct<page:int,x:double,y:double,w:double,h:double,text:string,dest_page:int,dest_y:double,url:string>>"}
    for name, table in (("outline", outline), ("links", links)):
        docs = docs.join(by_doc(table, name), "doc_id", "left") if table is not None else docs.withColumn(name, F.lit(None).cast(blank[name]))
    docs = docs.join(titles, "doc_id", "left") if titles is not None else docs.withColumn("title", F.lit(None).cast("string"))
    docs = docs.join(verse_gate(gated(lines, facts, removed)), "doc_id", "left")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    kind = model_type(tables)
    model = docs.select("doc_id", "title", "lines", "removed", "outline", "links", "page_map", "verse").mapInArrow(_analyser(to_arrow_schema(kind)), kind)
    return model, removed, mapped


def table_of(model: DataFrame, name: str) -> DataFrame:
    """One of the model's tables, a row for each of its items."""
    return model.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")


PIECES = "doc_id string, block_id string, n int, start int, end int, kind string, ref string, text string"


def inline_view(model: DataFrame) -> DataFrame:
    """(doc_id, block_id, n, start, end, kind, ref, text): every block cut where its format or its references change."""

    schema = to_arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc in batch.to_pylist():
                refs: dict[str, list[dict]] = {}
                for r in doc["refs"]:
                    refs.setdefault(r["from"], []).append({"id": r["ref_id"], "start": r["start"], "end": r["end"], "link": r["provenance"] == "explicit-link"})
                for b in doc["blocks"]:
                    pieces = inline_pieces(b["text"], b["runs"], refs.get(b["block_id"], []))
                    rows += [{"doc_id": doc["doc_id"], "block_id": b["block_id"], "n": k, **p} for k, p in enumerate(pieces)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return model.select("doc_id", "blocks", "refs").mapInArrow(run, PIECES)


def reference_index(model: DataFrame, prose: list[str] | None = None) -> DataFrame:
    """Each reference with its source's page, section and sentence, its system's label and all of its destination's text."""
    from quire.operators.graph import continuation

    model = model.persist(StorageLevel.MEMORY_AND_DISK)  # four of its tables are joined below
    refs, blocks = table_of(model, "refs"), table_of(model, "blocks")
    src = blocks.select("doc_id", F.col("block_id").alias("from"), F.col("page").alias("source_page"), "section", "text")
    labels = table_of(model, "sections").select("doc_id", F.col("section_id").alias("section"), F.col("label").alias("section_label"))
    systems = table_of(model, "systems").select("doc_id", F.col("system_id").alias("system"), F.col("label").alias("system_label"))
    dest = continuation(blocks, prose).join(blocks.select("doc_id", "block_id", F.col("page").alias("dest_page")), ["doc_id", "block_id"]).withColumnRenamed("block_id", "to")
    joined = refs.join(src, ["doc_id", "from"], "left").join(labels, ["doc_id", "section"], "left").join(systems, ["doc_id", "system"], "left").join(dest, ["doc_id", "to"], "left")
    sentence = F.trim(F.expr("substring(text, sentence_start + 1, sentence_end - sentence_start)"))
    return joined.select("doc_id", "ref_id", "type", "system", "system_label", "key", "from", "to", "source_page", "dest_page", F.coalesce("section_label", "section").alias("section_label"), "method", "confidence", "ambiguous", sentence.alias("source_sentence"), F.coalesce("dest_text", F.lit("")).alias("dest_text"))
