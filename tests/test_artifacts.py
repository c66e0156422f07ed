"""Outlines, details, stored artifacts, recognised words, and the tables a document's page shows."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import graph, views
from quire.sources import artifacts as A


def test_outlines_are_flattened_parents_first(spark):
    deep = {"title": "x6", "children": [{"title": "x7"}]}
    for k in range(5, 0, -1):
        deep = {"title": f"x{k}", "page": k, "children": [deep]}
    nested = [{"title": " One ", "page": 1, "y": 2.5, "children": [{"title": "1.1", "page": 2}, {"title": "", "children": [{"title": "1.2.1", "page": 3}]}]}, deep]
    docs = spark.createDataFrame([(1, json.dumps(nested)), (2, None), (3, "no json"), (4, "[]")], "doc_id bigint, outline string")
    got = [tuple(r) for r in A.outline(docs).orderBy("doc_id", "ord").select("doc_id", "depth", "title", "page").collect()]
    assert got == [(1, 0, "One", 1), (1, 1, "1.1", 2), (1, 2, "1.2.1", 3), *[(1, k - 1, f"x{k}", k) for k in range(1, 6)], (1, 5, "x6", None)]
    assert A.outline(docs.limit(0)).count() == 0


def test_details_without_empty_ones(spark):
    docs = spark.createDataFrame([(1, {"Title": " A book ", "Author": "", "Producer": "p", "Other": "x", "Keywords": " "}), (2, None)], "doc_id bigint, info map<string,string>")
    assert [tuple(r) for r in A.details(docs).orderBy("doc_id").collect()] == [(1, "A book", None, {"Producer": "p"}), (2, None, None, {})]


def test_stored_pages_are_listed_and_read_back(spark, tmp_path):
    for name, text in (("7/ocr/p1.json", '{"items": 3}'), ("7/ocr/p12.json", "broken"), ("8/ocr/p2.json", '{"items": 5}'), ("8/model.json", '{"items": 9}'), ("8/ocr/px.json", "{}")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = A.listing(spark, str(tmp_path), "*.json")
    assert files.count() == 5
    assert sorted(tuple(r) for r in A.finished_pages(files).collect()) == [(7, 1), (7, 12), (8, 2)]
    wanted = spark.createDataFrame([("7/ocr/p1.json",), ("7/ocr/p12.json",), ("9/ocr/p1.json",), ("8/model.json",)], "path string")
    got = {r.path: r.artifact and r.artifact["items"] for r in A.artifacts(wanted, spark, str(tmp_path), "items int").collect()}
    assert got == {"7/ocr/p1.json": 3, "7/ocr/p12.json": None, "9/ocr/p1.json": None, "8/model.json": 9}


def test_words_find_their_lines_and_pages_their_confidence(spark):
    words = spark.createDataFrame([(1, 1, 0, "a", 10.0, 10.0, 10.0, 8.0, 0.9), (1, 1, 1, "b", 10.0, 33.0, 10.0, 8.0, 0.5), (1, 1, 2, "c", 300.0, 10.0, 10.0, 8.0, 0.55), (1, 2, 0, "d", 10.0, 10.0, 10.0, 8.0, 1.0)], "doc_id bigint, page int, n int, t string, x double, y double, w double, h double, c double")
    lines = spark.createDataFrame([(1, 1, 0, 8.0, 9.0, 100.0, 10.0), (1, 1, 1, 8.0, 30.0, 100.0, 10.0), (1, 1, 2, 200.0, 9.0, 20.0, 10.0)], "doc_id bigint, page int, line int, x double, y double, w double, h double")
    got = {(r.page, r.n): (r.line, r.ly, r.lh) for r in A.words_in_lines(words, lines).collect()}
    assert got == {(1, 0): (0, 9.0, 10.0), (1, 1): (1, 30.0, 10.0), (1, 2): (None, None, None), (2, 0): (None, None, None)}
    sure = A.page_confidence(words)
    assert sorted(tuple(r) for r in sure.collect()) == [(1, 1, 3, 0.65, 2), (1, 2, 1, 1.0, 0)]
    blocks = spark.createDataFrame([(1, 1, "b1"), (1, 2, "b2"), (1, 3, "b3")], "doc_id bigint, page int, block_id string")
    pages = spark.createDataFrame([(1, 1, "ocr"), (1, 2, "native")], "doc_id bigint, page int, method string")
    got = {r.block_id: (r.method, r.confidence) for r in A.with_provenance(blocks, pages, sure).collect()}
    assert got == {"b1": ("ocr", pytest.approx(0.65)), "b2": ("native", None), "b3": ("native", None)}


def test_what_a_documents_page_lists(spark):
    blocks = spark.createDataFrame([(1, "b1", "quote", 1, 0, "s1"), (1, "b2", "quote", 26, 1, "s1"), (1, "b3", None, 51, 2, "s2"), (2, "b1", "verse", 1, 0, "s1")], "doc_id bigint, block_id string, embedded string, page int, ord int, section string")
    assert sorted(tuple(r) for r in views.embedded_counts(blocks).collect()) == [(1, "quote", 2), (2, "verse", 1)]
    assert sorted(tuple(r) for r in graph.first_in_section(blocks).collect()) == [(1, "s1", "b1"), (1, "s2", "b3"), (2, "s1", "b1")]
    assert {(r.doc_id, r.block_id) for r in graph.chunk_window(blocks, 60).collect()} == {(1, "b2"), (1, "b3")}
    kind = "doc_id bigint, from string, start int, key string, to string, to_section string, type string, method string, decision string, ambiguous boolean, reason string"
    refs = spark.createDataFrame([(1, "b1", 3, "1", None, None, "footnote", "marker", "accepted-unresolved", True, None), (1, "b1", 1, "2", None, "s2", "footnote", "cue", "accepted", False, None), (1, "b2", 0, "u", None, None, "external", "link", "accepted", False, None), (1, "b2", 5, "3", None, None, "endnote", "marker", "accepted-unresolved", False, "no entry")], kind)
    assert [tuple(r) for r in views.unresolved(refs).orderBy("ord").collect()] == [(1, "b1", 3, "1", "ambiguous", 1), (1, "b2", 5, "3", "no entry", 2)]
    spans = spark.createDataFrame([(1, 12.0), (1, 9.5), (1, 12.0), (2, 7.0)], "doc_id bigint, s double")
    got = {r.doc_id: (r.sizes, r.types, r.methods, r.decisions) for r in views.distinct_values(spans, refs).collect()}
    assert got == {1: ([9.5, 12.0], ["endnote", "external", "footnote"], ["cue", "link", "marker"], ["accepted", "accepted-unresolved"]), 2: ([7.0], None, None, None)}


def test_documents_are_inserted_once_and_failures_kept(spark):
    kind = "doc_id bigint, title string, storage_path string, status string, progress int, error string"
    docs = spark.createDataFrame([(1, "A", "u/a.pdf", "ready", 99, None)], kind)
    new = spark.createDataFrame([(1, "B", "u/b.pdf"), (2, None, "u/The Book.pdf"), (3, " ", "c.pdf"), (3, " ", "c.pdf")], "doc_id bigint, title string, storage_path string")
    held = views.inserted(docs, new)
    assert sorted((r.doc_id, r.title, r.status, r.progress) for r in held.collect()) == [(1, "A", "ready", 99), (2, "The Book", "queued", 0), (3, "c", "queued", 0)]
    errors = spark.createDataFrame([(2, "late"), (2, "bad page"), (9, "x")], "doc_id bigint, error string")
    got = {r.doc_id: (r.status, r.error, r.progress) for r in views.failed(held, errors).collect()}
    assert got == {1: ("ready", None, 99), 2: ("failed", "bad page", 0), 3: ("queued", None, 0)}
    assert views.failed(held, errors.where(F.lit(False))).where("status = 'failed'").count() == 0
