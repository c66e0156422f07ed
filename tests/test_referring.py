"""Where may_refer is false, assembling finds no reference: texts of forms, torn at any place, over lines of which some are furniture."""

import random
import re
from unittest import mock

from quire.operators import report
from quire.operators.references import may_refer
from quire.plans import document, document_plans
from tests.test_document_scale import lines_of

FORMS = ["see above", "See Chapter IV", "(Part 3)", "compare ch. 2", "cf. Vol. II, lines 3", "see pp. 12-14", "p. 7", "notes on l. 12", "note to 3a", "(3.14)", "described in 2.5", "set out in 7 ff.", "refer to Figs. 2, 3 and 4", "see also Appendix B", "[12]", "word* next", "* a note", "[1] another note", "1 a keyed note",
         "overlookChapter VIII", "Bibliography", "NOTES", "see Sections IX, X", "reproduced in § 4", "ActS", "in Table\xa05", "se- e below", "†dagger"]
PLAIN = ["the river stone", "and the window", "of garden.", "Letters were", "morning, silver", "a", "to", "in", "it’s", "über", "chapter", "Version 2.0", "12", "3.5", "well-known", "'quoted'", "A longer line of prose that goes on past forty letters"]


def text_of(r: random.Random) -> str:
    parts = [r.choice(PLAIN) for _ in range(r.randrange(2, 12))]
    for _ in range(r.randrange(3)):
        form = r.choice(FORMS)
        if r.random() < 0.7:
            k = r.randrange(len(form) + 1)
            form = form[:k] + r.choice(["\n", "-\n", " 14\n", "\n7\n", " ", "", "  \n ", "- "]) + form[k:]
        parts.insert(r.randrange(len(parts) + 1), form)
    return "".join(p + r.choice([" ", "\n", " ", ".\n"]) for p in parts) * r.choice((1, 1, 1, 5))


def laid(text: str) -> list[dict]:
    """What build_lines makes of the text as laid_out sets it."""
    out, last = [], {}
    for n, raw in enumerate(text.split("\n")):
        t = re.sub("[ \t\x0b\f\r]+", " ", raw).strip(" ")
        if not t:
            continue
        page, y = n // 40 + 1, 720.0 - n % 40 * 14.0
        right = 72.0 + min(456.0, len(t) * 6.0)
        t = re.sub("([,;:])(?=[A-Za-zÀ-ɏͰ-Ͽ])", r"\1 ", t)
        t = re.sub("([a-zß-ɏ’'”\"])([.!?]+)(?=[\"“'‘]?[A-ZÀ-Þ])", r"\1\2 ", t)
        t = re.sub("([”’])(?=[A-Za-zÀ-ɏͰ-Ͽ])", r"\1 ", t)
        k, above = last.get(page, (-1, y))
        last[page] = (k + 1, y)
        run = {"t": t, "f": "roman", "s": 12.0, "x": 72.0, "sup": False, "em": False, "sc": False, "strong": False, "o": n % 40}
        out.append({"page": page, "idx": k + 1, "y": y, "x": 72.0, "right": right, "size": 12.0, "gap": above - y, "text": " ".join(t.split()), "runs": [run]})
    return out


def found(text: str, removed=(), verse=None) -> list:
    blank = {"doc_id": "d", "title": None, "outline": None, "links": None, "page_map": None, "verse": verse}
    with mock.patch.object(document, "may_refer", lambda text: True):
        made = document.analyse({**blank, "lines": laid(text), "removed": list(removed)}, frozenset(("refs", "log")))
    return made["refs"] + made["log"]


def holds(rounds: int, seed: int) -> tuple[int, int]:
    r, refers, spared = random.Random(seed), 0, 0
    for _ in range(rounds):
        text = text_of(r)
        removed = [{"page": x["page"], "idx": x["idx"]} for x in laid(text) if r.random() < 0.15]
        any_ = bool(found(text) or found(text, removed) or found(text, removed, []))
        assert may_refer(text) or not any_, text
        refers += any_
        spared += not may_refer(text)
    return refers, spared


def test_nothing_is_found_where_nothing_may_refer():
    refers, spared = holds(1500, 5)
    assert refers > 100 and spared > 50


def test_each_form_may_refer():
    for form in ("see above", "see Chapter IV", "(Part 3)", "p. 7", "note on l. 12", "(3.14)", "[12]", "and see\nbelow", "des-\ncribed in 2.5", "compare 12\nff.", "ActS", "see 12\nabove"):
        assert may_refer(f"The {form} x"), form
    assert not may_refer("The river stone, version 2.0.\nA window acted; chapter and verse of the notebook. Seen above."), "prose"


def test_laid_lines_are_those_of_the_engine(spark):
    texts = [text_of(random.Random(k)) for k in range(30)]
    rows = lines_of(spark, texts).orderBy("page", "idx").collect()
    for k, text in enumerate(texts):
        assert [r.asDict(recursive=True) | {"doc_id": None} for r in rows if r.doc_id == str(k)] == [x | {"doc_id": None} for x in laid(text)]


def test_only_documents_that_may_refer_are_laid_out(spark, tmp_path, monkeypatch):
    docs = [(1, "The river stone.\nMorning, silver."), (2, "A stone, see above, and the river. " * 3), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    laid_out, seen = document_plans.laid_out, []
    monkeypatch.setattr(document_plans, "laid_out", lambda d: seen.append(sorted(r.doc_id for r in d.collect())) or laid_out(d))
    rows = {name: document_plans.Q[name](spark, str(tmp_path)).collect() for name in ("reference_edges", "recognition_log", "reference_index")}
    assert seen == [[2]] * 3
    assert [len(rows[n]) for n in rows] == [3, 3, 3] and {r.doc_id for n in rows for r in rows[n]} == {"2"}


def test_detectors_are_asked_only_where_something_may_be_proposed(monkeypatch):
    asked = []
    monkeypatch.setattr(document, "references", lambda blocks, *more: asked.append(len(blocks)) or ([], []))
    blank = {"doc_id": "d", "title": None, "outline": None, "links": None, "page_map": None, "verse": None}
    wanted = frozenset(("blocks", "refs"))
    assert document.analyse({**blank, "lines": laid("The river stone and the window.")}, wanted)["refs"] == [] and not asked
    document.analyse({**blank, "lines": laid("The river stone, see above, and the window.")}, wanted)
    raised = laid("The river stone and the window.")
    raised[0]["runs"].append({**raised[0]["runs"][0], "t": "1", "sup": True})
    document.analyse({**blank, "lines": raised}, wanted)
    document.analyse({**blank, "lines": laid("The river stone."), "links": [{"page": 1, "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "text": "", "dest_page": None, "dest_y": None, "url": "u"}]}, wanted)
    assert len(asked) == 3


def test_a_report_makes_lines_and_page_facts_once(spark, tmp_path, monkeypatch):
    docs = [(1, "The river\x00 stone.\n\nMorning, silver��."), (2, "A stone, see above, and the river. " * 3), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    facts = report.page_items(document_plans.laid_out(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    assert {(r.doc_id, r.page, r.items, r.chars, r.bad) for r in facts.collect()} == {("1", 1, 2, 35, 3), ("2", 1, 1, 104, 0)}
    build, made = document_plans.build_lines, []
    monkeypatch.setattr(document_plans, "build_lines", lambda spans: made.append(1) or build(spans))
    monkeypatch.setattr(document, "build_lines", lambda spans: made.append(1) or build(spans))
    rows = {(r.stage, r.status): r.documents for r in document_plans.stage_reports(spark, str(tmp_path)).collect()}
    assert made == [1] and rows["font-unicode", "failed"] == 1 and rows["reference-resolution", "failed"] == 1
