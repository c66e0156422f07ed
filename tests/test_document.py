import random

import pytest
from pyspark.sql import functions as F

from quire.operators import graph, layout, report
from quire.operators.content import heading_of, joiner, repair_words
from quire.operators.lines import build_lines
from quire.operators.references import Document, recognition, reconcile
from quire.operators.systems import apparatus, census, longest_count, match_entry, opening_lemma, page_notes, Tree
from quire.operators.verse import chain_members, smoothed, verse_input, verse_regions
from quire.plans.document import analyse, analyse_documents, body_profile, inline_view, line_measures, reference_index, table_of, verse_gate
from tests import books


def document(spark, book, links=None, outline=None):
    lines = build_lines(books.frame(spark, book)).cache()
    gate = verse_gate(lines).first()
    rows = [r.asDict(recursive=True) for r in lines.orderBy("page", "idx").collect()]
    return {"doc_id": book.doc_id, "title": "A Book", "lines": rows, "outline": outline, "links": links, "page_map": None, "verse": gate and gate.asDict(recursive=True)["verse"]}


def page_lines(spark, spans):
    names = [c.split()[0] for c in books.SPANS.split(", ")]
    df = spark.createDataFrame([tuple({"doc_id": "d", "page": 1, **s}[c] for c in names) for s in spans], books.SPANS)
    return [r.asDict(recursive=True) for r in build_lines(df).orderBy("idx").collect()]


def span(x, y, t, w=None, s=10.0, f="r", **more):
    return {"x": float(x), "y": float(y), "w": len(t) * 5.0 if w is None else w, "s": s, "f": f, "t": t, "o": None, "em": None, "strong": None, "sc": None, **more}


def test_lines_restore_spaces_and_fold_raised_markers(spark):
    lines = page_lines(spark, [span(72, 700, "want"), span(96, 700.5, "of a wife,and"), span(161, 704, "[2]", s=6.0), span(72, 686, "second line here"), span(72, 672, "")])
    assert [x["text"] for x in lines] == ["want of a wife, and[2]", "second line here"]
    assert [r["t"] for r in lines[0]["runs"] if r["sup"]] == ["[2]"] and lines[1]["gap"] == 14.5


def test_a_small_passage_is_no_superscript(spark):
    lines = page_lines(spark, [span(72, 700, "Body text of the page goes here"), span(72, 686, "Body text of the page goes on"), *[span(90, 670 - 9 * k, "short", s=7.0) for k in range(4)], span(72, 620, "Body text again and again")])
    assert len(lines) == 7 and not any(r["sup"] for x in lines for r in x["runs"])


def test_headings_and_joiners():
    assert heading_of("CHAPTER IV. The Storm") == {"type": "chapter", "label": "Chapter 4", "number": 4, "title": "The Storm"}
    assert heading_of("Book twenty-one")["number"] == 21 and heading_of("Notes on the Text")["type"] == "apparatus"
    assert heading_of("Introduction")["type"] == "frontmatter" and heading_of("Chapter of accidents")["type"] == "section"
    assert [joiner("a well-", "known man", {"well-known"}), joiner("the hyphen-", "ated", set()), joiner("it was t", "oo late", set()), joiner("it is", "of use", set()), joiner("End.", "Next", set())] == ["-", "", "", " ", " "]


def test_words_are_mended_on_the_documents_own_evidence():
    lines = [{"text": t} for t in ["the great window", "a great window", "great window", "great window", "his knowledge grew", "everyday nobleman", "a well-known man"]]
    blocks = [block(0, "The greatwindow of know- ledge, everyday, well- known.")]
    assert repair_words(blocks, lines) == [("know- ledge", "knowledge"), ("greatwindow", "great window")]
    assert blocks[0]["text"] == "The great window of knowledge, everyday, well- known."


def test_noted_book(spark):
    m = analyse(document(spark, books.noted_book()))
    assert [s["label"] for s in m["sections"]] == ["A Book", "Chapter 1", "Chapter 2", "Notes"]
    assert [(s["grammar"], s["kind"], s["entry_count"]) for s in m["systems"]] == [("sequential", "endnote", 6)]
    notes = [r for r in m["refs"] if r["type"] == "endnote"]
    assert [(r["source_text"], r["key"]) for r in notes] == [(f"[{k}]", str(k)) for k in range(1, 7)]
    by_id = {b["block_id"]: b for b in m["blocks"]}
    assert all(by_id[r["to"]]["key"] == r["key"] and by_id[r["from"]]["text"][r["start"] : r["end"]] == r["source_text"] for r in notes)
    see = [r for r in m["refs"] if r["type"] == "structural-navigation"]
    assert [r["source_text"] for r in see] == ["Chapter 2"] * 2 and {r["to_section"] for r in see} == {"s2"}
    assert {x["decision"] for x in m["log"]} == {"accepted"} and len(m["log"]) == len(m["refs"])
    assert "".join(r["t"] for r in by_id[notes[0]["from"]]["runs"]) == by_id[notes[0]["from"]]["text"]


def test_verse_book(spark):
    m = analyse(document(spark, books.verse_book()))
    verse = [b for b in m["blocks"] if b["type"] == "verse-line"]
    assert [b["line"] for b in verse] == list(range(1, 61)) and {b["section"] for b in verse} == {"s2"}
    assert not any(b["text"][0].isdigit() for b in verse)
    ref = next(r for r in m["refs"] if r["source_text"].startswith("Book 2"))
    assert next(b for b in verse if b["block_id"] == ref["to"])["line"] == 35
    assert [r["method"] for r in m["refs"] if r["source_text"] == "see below"] == ["unresolved"]


def test_links_anchor_exactly_and_land_where_they_say(spark):
    b = books.noted_book()
    doc = document(spark, b)
    first = next(x for x in doc["lines"] if "[1]" in x["text"])
    notes = [x for x in doc["lines"] if x["text"].startswith("3. ")][0]
    links = [
        {"page": first["page"], "x": 270.0, "y": first["y"], "w": 12.0, "h": 7.0, "text": "1", "dest_page": notes["page"], "dest_y": notes["y"] + 12, "url": None},
        {"page": first["page"], "x": 90.0, "y": first["y"], "w": 60.0, "h": 10.0, "text": "stone garden", "dest_page": None, "dest_y": None, "url": "http://x.example"},
    ]
    m = analyse({**doc, "links": links})
    linked = [r for r in m["refs"] if r["provenance"] == "explicit-link"]
    assert [(r["source_text"], r["type"]) for r in sorted(linked, key=lambda r: r["start"])] == [("stone garden", "external"), ("[1]", "endnote")]
    # An entry with the marker's own key among the next three goes before the one at the place; 1 stands above 3.
    by_id = {x["block_id"]: x for x in m["blocks"]}
    assert by_id[next(r for r in linked if r["source_text"] == "[1]")["to"]]["key"] == "3"


def block(k, text, kind="paragraph", section="s1", page=1, runs=None, **more):
    return {"block_id": f"b{k}", "ord": k, "page": page, "type": kind, "section": section, "text": text, "runs": runs or [{"t": text}], "key": None, "system": None, "lemma": None, "line": None, "boxes": [], **more}


SECTIONS = [
    {"section_id": "s0", "type": "root", "label": "Doc", "number": None, "title": "Doc", "page": 1, "parent": None, "depth": 0, "start": 0, "end": 99},
    {"section_id": "s1", "type": "chapter", "label": "Chapter 1", "number": 1, "title": "", "page": 1, "parent": "s0", "depth": 1, "start": 0, "end": 10},
    {"section_id": "s2", "type": "apparatus", "label": "Notes", "number": None, "title": "Notes", "page": 9, "parent": "s0", "depth": 1, "start": 10, "end": 99},
]


def test_entries_of_every_printing():
    assert [(m["key"], m["cls"]) for t in ("12. A note here", "† Symbol note", "(b) lettered note", "iv. roman note") if (m := match_entry(block(0, t)))] == [("12", "numeric"), ("†", "symbol"), ("b", "alphabetic"), ("iv", "roman")]
    assert match_entry(block(0, "Plain prose here")) is None
    raised = match_entry(block(0, "3The note", runs=[{"t": "3", "sup": True}, {"t": "The note"}]))
    glued = match_entry(block(0, "326he sang: of it", runs=[{"t": "326"}, {"t": "he sang", "em": True}, {"t": ": of it"}]))
    assert (raised["key"], glued["key"], glued["lemma"]) == ("3", "326", "he sang")
    assert [opening_lemma(block(0, t)) for t in ("“the Guide”: he leads", "the slayer: an epithet", "It was late. And: so")] == ["the Guide", "the slayer", None]


def test_systems_of_several_kinds():
    notes = [block(10 + k, f"{k}. Numbered note on it", section="s2", page=9) for k in range(1, 6)] + [block(20 + k, f"{s} Symbol note on it", section="s2", page=9) for k, s in enumerate("*†‡")]
    systems, entries, _ = apparatus(notes, SECTIONS, False)
    assert {(s["grammar"], s["entry_count"]) for s in systems} == {("sequential", 5), ("symbol", 3)} and len(entries) == 8
    books_ = [block(10 + k, f"{n}, Ann. A Title of a Book. Place, 19{50 + k}.", section="s2") for k, n in enumerate(("Ash", "Birch", "Cedar", "Elm"))]
    assert apparatus(books_, SECTIONS, False)[0][0]["grammar"] == "author-date"
    phrases = [block(10 + k, f"“the {w} of it”: a remark on that.", section="s2") for k, w in enumerate(("ship", "sail", "mast", "oar"))]
    systems, entries, _ = apparatus(phrases, SECTIONS, False)
    assert systems[0]["grammar"] == "lemma-keyed" and entries[0]["lemma"] == "the ship of it"
    assert apparatus([block(10, "1. alone", section="s2")], SECTIONS, False)[2][0]["label"] == "Notes"


def test_page_notes_pair_with_earlier_callers():
    body = [block(0, "A word† here."), block(1, "Text[1] and text[2] there."), block(2, "† The symbol note."), block(3, "1 First note."), block(4, "2 Second note.", page=2), block(5, "7 No caller for it.")]
    systems, entries = page_notes(body, SECTIONS, 4)
    assert {(s["grammar"], s["entry_count"]) for s in systems} == {("symbol", 1), ("sequential", 2)} and systems[0]["system_id"] == "sys4"
    assert {e["key"] for e in entries} == {"†", "1", "2"} and body[5]["type"] == "paragraph"


def test_census_confirms_parentheses_by_counting():
    assert [longest_count(x) for x in ([1, 2, 3], [4, 9, 2], [1, 2, 1, 2, 3], [])] == [3, 0, 3, 0]
    tree = Tree(SECTIONS)
    assert "parenthesized" in census([block(k, f"A claim ({k + 1}) made.") for k in range(3)], tree)["confirmed"]
    assert "parenthesized" not in census([block(0, "A claim (7) made.")], tree)["confirmed"]


@pytest.mark.parametrize("text", ["the first chapter of his life", "he wrote a book on it", "this is a part of it", "I see it above all", "the note on this argument", "2 + 2 = 4 [4] = x"])
def test_words_that_are_no_references(text):
    doc = Document([block(0, text)], SECTIONS, [], [])
    doc.find_markers()
    doc.find_internal()
    assert reconcile(doc)[0] == []


def test_lists_pages_and_directions():
    captions = [block(1, "Figure 2.3 The map", kind="caption"), block(2, "Appendix A", kind="heading")]
    sections = [*SECTIONS, {**SECTIONS[1], "section_id": "s3", "type": "appendix", "label": "Appendix A", "number": None, "title": "", "start": 2, "end": 3}]
    doc = Document([block(0, "See Chapter 1, Figure 2.3, and Appendix A; cf. p. 6 and see above."), *captions], sections, [], [], page_map=[{"page": 1, "printed": 6, "roman": False}])
    doc.find_internal()
    edges, log = reconcile(doc)
    assert [(e["source_text"], e["type"], e["to"]) for e in edges] == [("Chapter 1", "structural-navigation", "b0"), ("Figure 2.3", "figure", "b1"), ("Appendix A", "appendix", "b2"), ("p. 6", "page-reference", "b0"), ("see above", "cross-reference", None), ("Figure 2.3", "figure", "b1")]
    assert len(log) == len(doc.proposals) == len({x["ref_id"] for x in log})


def test_two_notes_with_one_key_are_told_apart_by_chapter():
    sections = [SECTIONS[0], {**SECTIONS[1], "section_id": "c1", "start": 0, "end": 1}, {**SECTIONS[1], "section_id": "c2", "number": 2, "label": "Chapter 2", "start": 1, "end": 2}, SECTIONS[2], {**SECTIONS[1], "section_id": "n1", "parent": "s2"}, {**SECTIONS[1], "section_id": "n2", "parent": "s2", "number": 2}]
    body = [block(0, "First[1] here.", section="c1"), block(1, "Second[1] there.", section="c2")]
    ends = [block(10, "1. one", kind="entry", section="n1", key="1", system="sys0"), block(11, "1. two", kind="entry", section="n2", key="1", system="sys0")]
    system = {"system_id": "sys0", "kind": "endnote", "label": "Notes", "grammar": "sequential"}
    doc = Document(body + ends, sections, [system], [{"block_id": b["block_id"], "system": "sys0", "key": "1", "numeric": 1, "lemma": None, "section": b["section"]} for b in ends])
    doc.find_markers()
    assert [e["to"] for e in reconcile(doc)[0]] == ["b10", "b11"]


def test_phrase_line_and_citation_keys():
    sections = [SECTIONS[0], {**SECTIONS[1], "type": "book"}, SECTIONS[2]]
    body = [block(k, f"the {w} went over the water", kind="verse-line", line=k + 1) for k, w in enumerate(("ship", "gull", "wind"))] + [block(5, "As shown (Ash, 1950) by others, the slayer of Argos came.")]
    notes = [block(10, "n", kind="entry", section="s2", key="3", system="L"), block(11, "n", kind="entry", section="s2", key="endnote-auto-001", system="P"), block(12, "n", kind="entry", section="s2", key="Ash 1950", system="B")]
    systems = [{"system_id": s, "kind": k, "label": "Notes", "grammar": g} for s, k, g in (("L", "line-commentary", "line-keyed"), ("P", "endnote", "lemma-keyed"), ("B", "bibliography", "author-date"))]
    entries = [{"block_id": "b10", "system": "L", "key": "3", "numeric": 3, "lemma": "the gull", "section": "s2"}, {"block_id": "b11", "system": "P", "key": "endnote-auto-001", "numeric": None, "lemma": "The Slayer of Argos", "section": "s2"}, {"block_id": "b12", "system": "B", "key": "Ash 1950", "numeric": None, "lemma": None, "section": "s2"}]
    doc = Document(body + notes, sections, systems, entries)
    for find in (doc.find_line_keys, doc.find_phrases, doc.find_citations):
        find()
    got = {e["method"]: (e["from"], e["source_text"], e["to"]) for e in reconcile(doc)[0]}
    assert got == {"line-key": ("b1", "the gull", "b10"), "lemma-match": ("b5", "the slayer of Argos", "b11"), "author-date": ("b5", "(Ash, 1950)", "b12")}


def test_recognition_is_bounded():
    assert recognition(["superscript", "math-context"]) == 0.21 and recognition([]) == 0.0 and recognition(["explicit-link", "lemma"]) <= 1


def likeliest(evidence, switch):
    """The best course by trying states one line at a time, all courses kept by their last state; of equals that which stays."""
    best = [(0, (0,)), (evidence[0] - switch, (1,))]
    for e in evidence[1:]:
        prose = best[0] if best[0][0] >= best[1][0] - switch else (best[1][0] - switch, best[1][1])
        verse = best[1] if best[1][0] >= best[0][0] - switch else (best[0][0] - switch, best[0][1])
        best = [(prose[0], (*prose[1], 0)), (verse[0] + e, (*verse[1], 1))]
    return list(best[1][1] if best[1][0] > best[0][0] else best[0][1])


def test_smoothing_equals_the_likeliest_course(spark):
    r = random.Random(3)
    cases = [[30] * 5, [10] * 5, [-20, 30, 30, 30, 30, 30, -90, -90], [60, 0, -60, 120, 0], [0] * 700]
    cases += [[r.choice((-35, -22, -16, -1, -1, 24, 29, 54)) for _ in range(r.choice((1, 7, 255, 256, 257, 900)))] for _ in range(40)]
    df = spark.createDataFrame([(str(k), i, e) for k, c in enumerate(cases) for i, e in enumerate(c)], "doc_id string, pos long, e long")
    got = {}
    for row in smoothed(df).orderBy("doc_id", "pos").collect():
        got.setdefault(int(row.doc_id), []).append(int(row.verse))
    assert got == {k: likeliest(c, 60) for k, c in enumerate(cases)}


def test_smoothing_of_one_document_of_many_blocks(spark):
    """A long course of blocks of blocks: states by a rule that a fold over 150,000 lines must give."""
    e = F.when(F.floor(F.col("id") / 1000) % 2 == 0, 10).otherwise(-10).cast("long")
    out = smoothed(spark.range(150_000, numPartitions=8).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), e.alias("e")))
    wrong = out.where(F.col("verse") != (F.floor(F.col("pos") / 1000) % 2 == 0))
    assert out.count() == 150_000 and wrong.count() == 0


def chains_in_turn(numbers):
    """Chains of one side's (pos, number), taken in turn: a number goes on with the open chain or opens one."""
    out, now, step = [], [], None
    for pos, n in [*numbers, (None, None)]:
        more = n - now[-1][1] if now and pos is not None else None
        fits = more in (1, 5, 10) and step in (None, more) and 0.9 * more <= pos - now[-1][0] <= 1.8 * more
        if not fits:
            out += [(step, now)] if len(now) >= 3 else []
            now, step = [], None
        elif step is None:
            step = more
        now = [*now, (pos, n)]
    return out


def test_chains_equal_those_taken_in_turn(spark):
    r = random.Random(5)
    cases = [[(4, 5), (9, 10), (14, 15)], [(7, 1912), (30, 1913)], [(1, 1), (2, 2), (7, 7), (12, 12), (13, 13), (14, 14)]]
    for _ in range(60):
        at, n, c = 0, 0, []
        for _ in range(r.randint(1, 40)):
            more = r.choice((1, 1, 5, 5, 10, 2))
            at, n = at + r.choice((more, more, more, more + 1, 3 * more)), n + more
            c.append((at, n))
        cases.append(c)
    df = spark.createDataFrame([(str(k), p, n, "left") for k, c in enumerate(cases) for p, n in c], "doc_id string, pos long, number int, side string")
    got = {}
    for row in chain_members(df).orderBy("doc_id", "chain", "pos").collect():
        got.setdefault(int(row.doc_id), {}).setdefault((row.chain, row.step), []).append((row.pos, row.number))
    want = {k: [(step, c) for step, c in chains_in_turn(case)] for k, case in enumerate(cases)}
    assert {k: [(step, c) for (_, step), c in v.items()] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_prose_is_no_verse(spark):
    spans = spark.createDataFrame([("p", 1 + k // 40, k % 40, 72.0, 720.0 - 14 * (k % 40), 450.0, 12.0, "r", "the words run on and on", None, None, None) for k in range(80)], books.SPANS)
    lines = build_lines(spans)
    assert verse_regions(verse_input(lines, line_measures(lines))).where("proven").count() == 0


def test_ancestors_of_deep_trees_and_circles(spark):
    kind = "doc_id string, section_id int, parent int"
    deep = spark.range(2000).select(F.concat(F.lit("d"), F.col("id") % 2).alias("doc_id"), F.floor(F.col("id") / 2).cast("int").alias("section_id")).withColumn("parent", F.expr("nullif(section_id, 0) - 1"))
    got = graph.ancestors(deep).agg(F.count("*").alias("n"), F.sum((F.col("distance") != F.col("section_id") - F.col("ancestor")).cast("int")).alias("wrong"), F.max("distance").alias("deepest")).first()
    assert tuple(got) == (1000 * 1001, 0, 999)
    r = random.Random(2)
    rows = [(d, k, r.randrange(k) if k and r.random() < 0.9 else r.choice((None, 999))) for d in "ab" for k in range(120)]
    up = {(d, k): p for d, k, p in rows}
    want = set()
    for d, k, _ in rows:
        at, n = k, 0
        while (d, at) in up:
            want.add((d, k, at, n))
            at, n = up[d, at], n + 1
    found = [tuple(x) for x in graph.ancestors(spark.createDataFrame([*rows, *rows[:5]], kind)).collect()]
    assert len(found) == len(want) and set(found) == want
    for circle in ([("a", 0, 1), ("a", 1, 0)], [("a", 0, 0)], [("a", k, (k + 1) % 3) for k in range(3)] + [("a", 5, 0), *[("b", k, k - 1 if k else None) for k in range(40)]]):
        with pytest.raises(ValueError, match="circle"):
            graph.ancestors(spark.createDataFrame(circle, kind))
    assert graph.ancestors(spark.createDataFrame([], kind)).count() == 0


def test_furniture_and_page_numbers(spark):
    spans = books.frame(spark, books.numbered_book())
    lines = build_lines(spans).cache()
    numbers = {r.page: (r.printed, r.how) for r in layout.page_numbers(lines).collect()}
    assert {p: n for p, (n, _) in numbers.items()} == {p: p - 2 for p in range(3, 31)}
    assert numbers[15][1] == "noisy" and numbers[20][1] == "misread" and numbers[10][1] == "sequence"
    gone = layout.furniture(lines, body_profile(lines)).collect()
    assert sum(r.classification == "running-head" for r in gone) == 30 and sum(r.classification == "printed-page-number" for r in gone) == 28
    assert len({(r.page, r.idx) for r in gone}) == len(gone)
    mapped = {r.page: (r.printed, r.roman) for r in layout.page_map(layout.furniture(lines, body_profile(lines)), layout.page_numbers(lines)).collect()}
    assert mapped[20] == (18, False) and mapped[3] == (1, False)


def test_documents_side_by_side(spark):
    spans = books.frame(spark, books.noted_book(), books.verse_book(), books.numbered_book())
    outline = spark.createDataFrame([("noted", 0, "Chapter One", 1, 0), ("noted", 1, "Chapter Two", 4, 0), ("noted", 2, "Notes", 7, 0)], "doc_id string, ord int, title string, page int, depth int")
    model, removed, mapped = analyse_documents(spans, outline=outline)
    model = model.cache()
    got = {r.doc_id: r for r in model.collect()}
    assert set(got) == {"noted", "verse", "numbered"}
    assert [s.label for s in got["noted"].sections] == ["Document", "Chapter 1", "Chapter 2", "Notes"]
    assert sum(r.type == "endnote" for r in got["noted"].refs) == 6
    assert sum(b.type == "verse-line" for b in got["verse"].blocks) == 60
    assert not any(b.text.isdigit() for b in got["numbered"].blocks)
    index = {r.ref_id: r for r in reference_index(model).where("doc_id = 'noted'").collect()}
    one = next(r for r in index.values() if r.key == "1")
    assert one.dest_text.startswith("1. This note") and one.system_label == "Notes" and one.section_label == "Chapter 1" and "[1]" in one.source_sentence
    pages = spans.select("doc_id", "page").distinct().select("doc_id", "page", F.lit("native").alias("method"), F.lit(None).cast("double").alias("mean_confidence"), F.lit(None).cast("string").alias("error"))
    m = report.measures(spans, pages, model, removed, build_lines(spans).select("doc_id", "page", "idx")).cache()
    stages = report.stages(m).where("doc_id = 'noted'").orderBy("n").collect()
    assert [s.stage for s in stages] == list(report.STAGES) and stages[0].status == "ok" and stages[4].metrics["sections"] == 3
    assert {r.doc_id: r.readiness for r in report.readiness(m).collect()}["noted"] == "ready"
    tones = report.worst_tone(report.remarks(table_of(model, "blocks"), table_of(model, "refs"))).where("doc_id = 'noted'").collect()
    assert {t.tone for t in tones} <= {"ok", "warn", "bad"} and any(t.tone == "ok" for t in tones)
    pieces = inline_view(model).where("doc_id = 'noted'").orderBy("block_id", "n").collect()
    for b in got["noted"].blocks:
        assert "".join(p.text for p in pieces if p.block_id == b.block_id) == b.text
    assert sum(p.kind == "reference-marker" for p in pieces) == len(got["noted"].refs)
    hits = graph.search(table_of(model, "blocks"), "this note explains the STONE").collect()
    assert len(hits) == 1 and "explains" in hits[0].snippet


def test_scans_without_text_are_unreadable(spark):
    spans = books.frame(spark, books.noted_book("thin"))
    pages = spark.createDataFrame([("thin", p, "native" if p < 3 else "ocr", 0.5, None if p % 2 else "failed") for p in range(1, 201)] + [("bare", 1, "empty", None, None)], "doc_id string, page int, method string, mean_confidence double, error string")
    model, removed, _ = analyse_documents(spans)
    m = report.measures(spans, pages, model, removed, build_lines(spans).select("doc_id", "page", "idx"))
    assert {r.doc_id: r.readiness for r in report.readiness(m).collect()} == {"thin": "unreadable", "bare": "unreadable"}
    assert {r.code for r in report.issues(m).where("doc_id = 'bare'").collect()} == {"extraction-failure"}
    assert {r.status for r in report.stages(m).where("doc_id = 'thin' and n between 1 and 8").collect()} == {"skipped"}
