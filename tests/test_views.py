from pyspark.sql import functions as F

from quire.operators import views

REF = "doc_id string, ref_id string, from string, start int, end int, sentence_start int, sentence_end int, type string, method string, key string, system string, to string, to_section string, confidence double, ambiguous boolean, signals array<string>"
REFS = [
    ("d", "r0", "b0", 4, 7, 0, 20, "endnote", "marker", "1", "sys0", "b9", None, 0.9, False, ["superscript"]),
    ("d", "r1", "b0", 30, 30, 21, 28, "note", "unresolved", "Note", None, None, None, 0.3, True, []),
    ("d", "r2", "b1", 0, 9, 0, 40, "structural-navigation", "heuristic", "Chapter 2", None, None, "s2", 0.4, False, ["cue"]),
]
BLOCKS = [("d", "b0", 0, 1, "paragraph", None, "x" * 50), ("d", "b1", 1, 26, "verse-line", 5, "y" * 40), ("e", "b0", 0, 51, "verse-line", 6, "z")]


def refs(spark):
    return spark.createDataFrame(REFS, REF)


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "doc_id string, block_id string, ord int, page int, type string, line int, text string")


def test_filters(spark):
    ids = lambda df: [r.ref_id for r in df.collect()]
    assert ids(views.filter_references(refs(spark), kind="endnote")) == ["r0"] and ids(views.filter_references(refs(spark), label="CHAP")) == ["r2"]
    assert ids(views.filter_references(refs(spark), shown=2)) == ["r0", "r1"]
    index = refs(spark).withColumn("system_label", F.lit("Notes")).withColumn("source_sentence", F.lit("A sentence")).withColumn("dest_text", F.lit(""))
    assert ids(views.filter_index(index, "unresolved")) == ["r1"] and ids(views.filter_index(index, "unresolved", sections_count=False)) == ["r1", "r2"]
    assert ids(views.filter_index(index, "ambiguous", "SENTENCE")) == ["r1"] and ids(views.filter_index(index, text="nowhere")) == []
    w = {r.ref_id: (r.dimmed, r.structural) for r in views.weighted(refs(spark), ["sys0"]).collect()}
    assert w == {"r0": (False, False), "r1": (True, False), "r2": (True, True)}
    assert [(r.block_id, r.shows_line) for r in views.page_view(blocks(spark), 26).collect()] == [("b1", True)]
    log = spark.createDataFrame([("d", "r0", "marker", "note", "accepted", "destination-fits"), ("d", "r1", "heuristic", "figure", "rejected", "weak-recognition")], "doc_id string, ref_id string, method string, type string, decision string, reason string")
    assert ids(views.filter_log(log, "rejected", "WEAK")) == ["r1"]


def test_remarks_on_anchors(spark):
    got = {}
    for r in views.reference_remarks(refs(spark), blocks(spark)).collect():
        got.setdefault(r.ref_id, set()).add((r.tone, r.code))
    assert got == {"r1": {("bad", "empty-marker"), ("bad", "outside-sentence"), ("warn", "short-sentence"), ("warn", "ambiguous"), ("bad", "unresolved"), ("warn", "no-evidence")}, "r2": {("warn", "low-confidence")}}


def test_clipping(spark):
    pieces = spark.createDataFrame([(0, 5, "hello", "text"), (5, 11, " world", "strong")], "start int, end int, text string, kind string")
    got = views.clipped(pieces, F.lit(2), F.lit(9), F.lit(4), F.lit(7)).orderBy("start").collect()
    assert [(r.text, r.kind, r.marked) for r in got] == [("ll", "text", False), ("o", "text", True), (" w", "strong", True), ("or", "strong", False)]


def test_pages_after_recognition(spark):
    pages = spark.createDataFrame([("a", 1, "scanned", "ocr", False), ("a", 2, "native", "native", False), ("b", 1, None, "ocr", True), ("c", 1, "scanned", "ocr", False)], "doc_id string, page int, kind string, method string, recovered boolean")
    seen = spark.createDataFrame([("a", 1, False), ("c", 1, False), ("b", 1, True)], "doc_id string, page int, has_image boolean")
    done, kinds = views.refined_pages(pages, seen)
    assert {(r.doc_id, r.page): r.kind for r in done.collect()} == {("a", 1): "empty", ("a", 2): "native", ("b", 1): "poor_native", ("c", 1): "empty"}
    assert {r.doc_id: r.kind for r in kinds.collect()} == {"a": "native-text", "b": "scanned", "c": "empty"}


def test_sizes_snap_to_the_documents(spark):
    spans = spark.createDataFrame([("d", 1, k, s) for k, s in enumerate([10.0, 11.0, 11.0, 10.0, 9.0, 30.0])], "doc_id string, page int, o int, s double")
    assert [r.s for r in views.snapped_sizes(spans).orderBy("o").collect()] == [10.0, 10.0, 10.0, 10.0, 10.0, 30.0]


def test_made_systems(spark):
    systems = spark.createDataFrame([("d", "sys0", "endnote", "Notes", "sequential", "document", ["s1"], 3, 0.9)], "doc_id string, system_id string, kind string, label string, grammar string, key_scope string, hosts array<string>, entry_count int, confidence double")
    sections = spark.createDataFrame([("d", "s1", True), ("d", "s2", False)], "doc_id string, section_id string, verse boolean")
    got = {(r.doc_id, r.system_id): (r.hosts, r.entry_count) for r in views.with_made_systems(systems, blocks(spark), sections, spark.createDataFrame([("d",), ("d",)], "doc_id string")).collect()}
    assert got == {("d", "sys-lines"): (["s1"], 1), ("e", "sys-lines"): ([], 1), ("d", "sys0"): (["s1"], 3), ("d", "sys-links"): ([], 2)}


def test_chunks_and_deletion(spark, tmp_path):
    path = str(tmp_path / "c")
    for _ in range(2):
        views.write_chunks(blocks(spark), path)
    got = spark.read.parquet(path)
    assert {(r.doc_id, r.block_id): r.chunk for r in got.collect()} == {("d", "b0"): 0, ("d", "b1"): 1, ("e", "b0"): 2} and got.count() == 3
    left = views.without_documents({"blocks": blocks(spark), "refs": refs(spark)}, spark.createDataFrame([("d",)], "doc_id string"))
    assert [r.doc_id for r in left["blocks"].collect()] == ["e"] and left["refs"].count() == 0
    assert views.capped(blocks(spark), "removed").count() == 3
    assert [r.path for r in views.known_files(spark.createDataFrame([("a",), ("b",)], "path string"), ["b", "c"]).collect()] == ["b"]
    summary = views.import_summary(spark.createDataFrame([("d", 3, 0.5)], "doc_id string, pages int, conf double")).first().summary
    assert summary == {"pages": "3", "conf": "0.5"}
