"""Steps that most documents do not need are not taken for them, with the results unchanged."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from quire.operators import content, lines as L
from quire.operators.content import repair_words
from quire.operators.lines import build_lines
from quire.plans import document
from quire.plans.document import document_facts
from quire.plans.document_plans import laid_out
from tests import books


def test_pages_of_plain_lines_are_not_gathered(spark):
    docs = spark.createDataFrame([(1, "one,two  three\n \nfour  five.Six"), (2, "\n".join(f"line {k}" for k in range(90)))], "doc_id long, text string")
    assert L._told(laid_out(docs)).where("not plain").count() == 0
    assert [r.text for r in build_lines(laid_out(docs)).where("doc_id = '1'").orderBy("idx").collect()] == ["one, two three", "four five. Six"]


def test_plain_pages_are_as_gathering_makes_them(spark):
    r = random.Random(3)
    texts = ["word", "a,b  c", " ", " ", "x.Y", "end-", "", "tab\tbed "]
    rows = []
    for page in range(150):
        y, even = 700.0, page % 3
        for _ in range(r.randrange(1, 8)):
            size, font = (10.0, "r") if even else (r.choice((0.0, 6.0, 10.0)), r.choice(("r", "i", None)))
            rows.append((f"d{page % 7}", page, r.choice((None, 3)), r.choice((72.0, 90.0)), y, r.choice((20.0, 44.0)), size, font, r.choice(texts), r.choice((None, True)), None, r.choice((None, False, True))))
            y -= r.choice((0.0, 1.0, 1.6, 9.0, 14.0)) if page % 2 else 14.0
        if page % 10 == 9:
            rows[-1] = (*rows[-1][:4], r.choice((None, float("nan"))), *rows[-1][5:])
    spans = spark.createDataFrame(rows, books.SPANS)
    told = L._told(spans).cache()
    assert told.where("plain").count() > 100 and told.where("not plain").count() > 100
    plain = told.where("plain")
    one, all_ = L._single(plain), L._gathered(plain)
    assert one.count() == all_.count() > 0 and one.exceptAll(all_).count() == 0


def lines_of(spark, texts):
    return build_lines(laid_out(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).cache()


def test_furniture_is_sought_where_something_may_repeat(spark):
    page = [f"prose {k} " + "and more of it " * 6 for k in range(39)]
    books_ = ["\n".join(line for p in range(6) for line in (str(p + 1), *page)), "\n".join(["same"] * 5), "\n".join(["same"] * 4), "\n".join(page), "one line"]
    lines = lines_of(spark, books_)
    repeats = {r.doc_id for r in document_facts(lines).where("repeats").collect()}
    assert repeats == {"0", "1"}


def test_removed_lines_are_left_out_of_a_document(spark):
    lines = [r.asDict(recursive=True) for r in lines_of(spark, ["running head\nA sentence that is long enough to be prose, surely.\nAnother one."]).collect()]
    doc = {"doc_id": "d", "title": None, "outline": None, "links": None, "page_map": None, "verse": None}
    cut = document.analyse({**doc, "lines": lines, "removed": [{"page": 1, "idx": 0}]})
    assert cut == document.analyse({**doc, "lines": [x for x in lines if x["idx"]]}) and "running head" not in cut["blocks"][0]["text"]


def test_pairs_are_counted_only_where_a_word_may_be_fused(monkeypatch):
    counted = []
    monkeypatch.setattr(content, "Counter", lambda x: counted.append(1) or Counter(x))
    lines = [{"text": "the great window and the great window of the house"}] * 6
    repair_words([{"text": x["text"], "runs": [{"t": x["text"]}]} for x in lines], lines)
    assert len(counted) == 1
    assert repair_words([{"text": "a Greatwindow", "runs": [{"t": "a Greatwindow"}]}], lines) == [("Greatwindow", "Great window")] and len(counted) == 3


@pytest.mark.parametrize("cut", [slice(0, 9), slice(2, 5), slice(3, 3)])
def test_nested_rows_are_read_leaf_by_leaf(cut):
    item = pa.struct([("a", pa.int32()), ("b", pa.float64()), ("c", pa.bool_()), ("d", pa.string()), ("e", pa.list_(pa.struct([("f", pa.float64())])))])
    rows = [[{"a": 1, "b": 2.5, "c": True, "d": "x", "e": [{"f": 1.0}, None]}], None, [], [None, {"a": None, "b": None, "c": None, "d": None, "e": None}], [{"a": 3, "b": 0.0, "c": False, "d": "", "e": []}] * 2]
    column = pa.array(rows, pa.list_(item))[cut]
    assert document._values(column) == column.to_pylist()
