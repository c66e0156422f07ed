"""What keeps large inputs within their limits, with the results unchanged."""

import random
from collections import Counter

import pytest
import regex as re
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.content import FUSED, HALF, SEEN, WORD, compounds_of, repair_words
from quire.operators.lines import build_lines
from quire.plans import document
from quire.plans.document import TABLES, analyse, analyse_documents, zoned
from quire.sources.texts import document_lines
from tests import books


def nested(spark, book):
    lines = [r.asDict(recursive=True) for r in build_lines(books.frame(spark, book)).collect()]
    return {"doc_id": book.doc_id, "title": None, "lines": lines, "outline": None, "links": None, "page_map": None, "verse": None}


def test_no_step_is_taken_that_nothing_asked_for_depends_on(spark, monkeypatch):
    docs = [nested(spark, b) for b in (books.noted_book(), books.verse_book(), books.numbered_book())]
    whole = [analyse(d) for d in docs]
    for name in TABLES:
        assert [analyse(d, frozenset([name]))[name] for d in docs] == [w[name] for w in whole]

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(document, "references", never)
    assert [analyse(d, frozenset(["blocks"]))["blocks"] for d in docs] == [w["blocks"] for w in whole]
    monkeypatch.setattr(document, "apparatus", never)
    assert [analyse(d, frozenset(["sections"]))["sections"] for d in docs] == [w["sections"] for w in whole]


def test_a_model_of_few_columns_is_part_of_the_whole(spark):
    spans = books.frame(spark, books.noted_book(), books.verse_book())
    whole = analyse_documents(spans)[0].orderBy("doc_id").collect()
    part = analyse_documents(spans, tables={"blocks": ["ord", "type", "text"], "log": ["decision"]})[0].orderBy("doc_id").collect()
    assert part[0].asDict().keys() == {"doc_id", "blocks", "log"} and set(part[0].blocks[0].asDict()) == {"ord", "type", "text"}
    for p, w in zip(part, whole, strict=True):
        assert [(b.ord, b.type, b.text) for b in p.blocks] == [(b.ord, b.type, b.text) for b in w.blocks]
        assert [x.decision for x in p.log] == [x.decision for x in w.log]


def test_the_verse_gate_is_asked_only_where_a_zone_may_lie(spark):
    plain = books.Book("plain").new_page()
    for _ in range(30):
        plain.line(plain.sentence(12))
    lines = build_lines(books.frame(spark, plain, books.verse_book()))
    assert [r.doc_id for r in zoned(lines).collect()] == ["verse"]


def repaired_plainly(blocks, lines):
    """repair_words with every pair and every split counted."""
    words, pairs, compounds = Counter(), Counter(), compounds_of(lines)
    for line in lines:
        seq = re.findall("[a-zÀ-ɏ']+", line["text"].lower())
        words.update(w for w in seq if len(w) >= 2)
        pairs.update(zip(seq, seq[1:], strict=False))

    def part(m):
        w = m[0].lower()
        if not FUSED[0] <= len(w) <= FUSED[1] or words[w] > 1:
            return m[0]
        n, k = max((pairs[w[:k], w[k:]], -k) for k in range(HALF, len(w) - HALF + 1))
        return m[0] if n < SEEN else f"{m[0][:-k]} {m[0][-k:]}"

    def join(m):
        a, b = m[1].lower(), m[2].lower()
        return m[0] if not words[a + b] or pairs[a, b] or f"{a}-{b}" in compounds else m[1] + m[2]

    return [[re.sub(f"{WORD}{{7,}}", part, re.sub(f"({WORD}{{2,}})[-‐] +([a-zÀ-ɏ]{{2,}})", join, r["t"])) for r in b["runs"]] for b in blocks]


@pytest.mark.parametrize("seed", range(40))
def test_words_are_repaired_as_by_counting_all(seed):
    r = random.Random(seed)
    some = ["garden", "window", "mor", "ning", "élan", "vital", "O'er", "rest", "lessly", "ab", "gardenwindow", "Windowgarden", "élanvitals", "restlessly", "mor-ning", "rest- lessly", "mor‐ ning", "garden- window"]
    lines = [{"text": " ".join(r.choices(some, k=12))} for _ in range(r.choice((2, 6, 20)))]
    blocks = [{"text": x["text"], "runs": [{"t": x["text"]}]} for x in lines]
    want = repaired_plainly(blocks, lines)
    repair_words(blocks, lines)
    assert [[x["t"] for x in b["runs"]] for b in blocks] == want


def test_texts_of_lines_are_made_once(spark):
    lines = build_lines(books.frame(spark, books.noted_book())).groupBy("doc_id").agg(F.sum(F.length("text")))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("trim(regexp_replace(") == 1


def test_texts_without_a_place_to_mend_are_left_alone(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(" \t\n\x0b\x1c  ab,;.!?”’\"'ZÄé1", k=r.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    letter = T.LETTER
    plain = F.regexp_replace("t", f"([,;:])(?=[{letter}])", "$1 ")
    plain = F.regexp_replace(plain, r"([a-zß-ɏ’'”\"])([.!?]+)(?=[\"“'‘]?[A-ZÀ-Þ])", "$1$2 ")
    plain = F.regexp_replace(plain, rf"([”’])(?=[{letter}])", "$1 ")
    same = df.select((T.respaced(F.col("t")) == plain).alias("a"), (T.squeezed(F.col("t")) == F.trim(F.regexp_replace("t", r"\s+", " "))).alias("b"))
    assert same.where("not (a and b)").count() == 0
    docs = df.select(F.monotonically_increasing_id().alias("doc_id"), F.col("t").alias("text"))
    every = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("line")).where("line != ''")
    got = document_lines(docs)
    assert got.exceptAll(every).count() == every.exceptAll(got).count() == 0
