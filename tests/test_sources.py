from pyspark.sql import functions as F

from quire.operators import graph, lexicon
from quire.sources import glyphs
from quire.streaming import resume


def chars(spark, runs, page=1):
    rows, i, x = [], 0, 72.0
    for text, font, size in runs:
        for ch in text:
            rows.append(("d", page, i, ch, 0 if ch == "\x00" else ord(ch), x, 700.0, 5.0, 10.0, 702.0, font, size))
            i, x = i + 1, x + 5
    return spark.createDataFrame(rows, "doc_id string, page int, i int, ch string, code int, x double, y double, w double, h double, oy double, font_id string, size double")


FONTS = [("d", "ABCDEF+Garamond-Italic", 1 << 6, 400), ("d", "Plain", 1, 400), ("d", "Heavy-Bold", 0, 400)]


def test_fonts(spark):
    got = {r.font_id: r for r in glyphs.fonts(spark.createDataFrame(FONTS, "doc_id string, ps_name string, flags int, weight int")).collect()}
    it = got["ABCDEF+Garamond-Italic|64|400"]
    assert (it.family, it.subset, it.italic, it.bold, it.mono) == ("Garamond-Italic", "ABCDEF", True, False, False)
    assert got["Plain|1|400"].mono and got["Heavy-Bold|0|400"].bold


def test_runs_and_spans(spark):
    table = glyphs.fonts(spark.createDataFrame(FONTS, "doc_id string, ps_name string, flags int, weight int"))
    c = chars(spark, [("\x00\x00 was born\n", "Plain|1|400", 10.0), ("oﬃce", "ABCDEF+Garamond-Italic|64|400", 10.0), (" ", "Plain|1|400", 10.04), ("big", "Plain|1|400", 12.0)])
    runs = glyphs.runs(c)
    assert runs.agg(F.max("run")).first()[0] == 4
    got = glyphs.spans(runs, table).orderBy("o").collect()
    assert [(r.t, r.unmapped, r.s) for r in got] == [("\x00\x00", 2, 10.0), (" was born", 0, 10.0), ("office", 0, 10.0), ("big", 0, 12.0)]
    assert got[2].em and got[2].t0 == "oﬃce" and got[2].y == 702.0
    fixed = glyphs.with_recovered(glyphs.spans(runs, table), spark.createDataFrame([("d", 1, 0, "He", 0.9), ("d", 1, 3, "no", 0.9)], "doc_id string, page int, o int, text string, conf double")).orderBy("o").collect()
    assert [(r.t, r.repair) for r in fixed][:2] == [("He", "rendered-glyphs"), (" was born", None)]


def test_links_take_the_characters_they_cover(spark):
    c = chars(spark, [("see note 6 here", "Plain|1|400", 10.0)])
    links = spark.createDataFrame([("d", 1, "a", 91.0, 699.0, 21.0, 12.0), ("d", 1, "b", 400.0, 699.0, 10.0, 10.0)], "doc_id string, page int, link_id string, x double, y double, w double, h double")
    got = {r.link_id: (r.start, r.end, r.text) for r in glyphs.link_text(links, c).collect()}
    assert got == {"a": (4, 8, "note"), "b": (None, None, None)}


def test_recognised_words_become_spans(spark):
    words = spark.createDataFrame([("d", 1, k, t, 100.0 * k, 200.0, 80.0, 30.0, 0.9, 235.0, h) for k, (t, h) in enumerate((("one", 30.0), ("two", 32.0), ("BIG", 80.0), ("more", 30.0)))], "doc_id string, page int, n int, t string, x double, y double, w double, h double, c double, ly double, lh double")
    pages = spark.createDataFrame([("d", 1, 1200, 1600, 600.0, 800.0)], "doc_id string, page int, img_width int, img_height int, pdf_width double, pdf_height double")
    got = glyphs.recognised_spans(words, pages).orderBy("o").collect()
    assert [(r.t, r.x, r.y, r.s) for r in got] == [("one ", 0.0, 682.5, 15.0), ("two ", 50.0, 682.5, 15.0), ("BIG ", 100.0, 682.5, 40.0), ("more ", 150.0, 682.5, 15.0)]
    native = spark.createDataFrame([("d", 1, 0, "bad"), ("d", 2, 0, "good")], "doc_id string, page int, o int, t string")
    assert sorted(r.t for r in glyphs.merged_pages(native, glyphs.recognised_spans(words, pages)).collect()) == ["BIG ", "good", "more ", "one ", "two "]


def test_fused_words_part_on_the_corpus_own_evidence(spark):
    rows = [("d", k, "the great window was open") for k in range(5)] + [("d", 9, "in greatwindow light"), ("d", 10, "greatmountain everyday")]
    lines = spark.createDataFrame(rows, "doc_id string, line_no bigint, line string")
    assert [(r.word, r.left, r.right, r.n) for r in lexicon.fused_words(lines, ["doc_id"]).collect()] == [("greatwindow", "great", "window", 5)]


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "x", 1), ("a", 5, "y", 1), ("a", 5, "z", 2), ("b", 9, "w", 1)], "k string, at int, v string, t int")
    assert sorted((r.k, r.at, r.v) for r in graph.as_of(left, right, ["k"], "at", "v", "t").collect()) == [("a", 1, None), ("a", 5, "z"), ("b", 3, None)]
    near = spark.createDataFrame([("a", 2, 20), ("a", 4, 40), ("b", 9, 90)], "k string, at int, v int")
    ask = spark.createDataFrame([("a", 3), ("a", 4), ("b", 3), ("c", 1)], "k string, at int")
    assert sorted((r.k, r.at, r.v, r.distance) for r in graph.nearest(ask, near, ["k"], "at", "v").collect()) == [("a", 3, 20, 1), ("a", 4, 40, 0), ("b", 3, 90, 6), ("c", 1, None, None)]


def test_page_state():
    state = resume.fold_pages(None, [(1, 10, None), (2, 0, "bad"), (3, 0, "bad"), (4, 0, None), (5, 0, "bad")])
    assert state == ([1, 4], [2, 3, 5], 3, False)
    state = resume.fold_pages(state, [(2, 5, None), (6, 0, "x"), (7, 0, "x")])
    assert state == ([1, 2, 4], [3, 5, 6, 7], 2, False)
    state = resume.fold_pages(state, [(8, 0, "x"), (9, 0, "x"), (10, 0, "x"), (11, 9, None)])
    assert state[3] and 11 not in state[0]


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    schema = "doc_id string, page int, words int, error string, at int"
    source, out = str(tmp_path / "in"), []

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = resume.progress(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination(120)

    run([("a", 1, 5, None, 1), ("a", 2, 0, "bad", 2), ("b", 1, 5, None, 1)])
    run([("a", 2, 7, None, 3)])
    last = {r.doc_id: (r.done, r.failed) for r in out}
    assert last == {"a": ([1, 2], []), "b": ([1], [])}


def test_pending_pages_and_shares(spark):
    scan = spark.createDataFrame([("a", 1, "ocr"), ("a", 2, "ocr"), ("a", 3, "native"), ("a", 4, "ocr")], "doc_id string, page int, method string")
    done = spark.createDataFrame([("a", 1, None), ("a", 2, "bad")], "doc_id string, page int, error string")
    assert [r.page for r in resume.pending(scan, done).collect()] == [4]
    assert sorted(r.page for r in resume.pending(scan, done, retry=True).collect()) == [2, 4]
    assert spark.range(1).select(resume.share_done("ocr", F.lit(1), F.lit(2)), resume.share_done("classify", F.lit(0), F.lit(0))).first()[:] == (43, 0)


def test_partitions_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    resume.write_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), path)
    for _ in range(2):
        resume.write_partitions(spark.createDataFrame([("a", 2)], "doc_id string, v int"), path)
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]
