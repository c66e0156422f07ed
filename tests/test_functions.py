import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import numerals as N
from quire.functions import spans as S
from quire.functions import stats, text


def values(spark, expr, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in enumerate(rows[0])))
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_numerals(spark):
    c = F.col("c0")
    words = [("iv",), ("IIII",), ("VX",), ("12",), ("twenty-one",), ("forty two",), ("fourth",), ("",)]
    assert values(spark, N.roman_value(c), *words) == [4, 4, 5, None, None, None, None, None]
    assert values(spark, N.number_value(c), *words) == [4, 4, 5, 12, 21, 42, None, None]
    pages = [("— 12 —",), ("[xii]",), ("12 a",), ("12345",), ("",)]
    assert [None if v is None else tuple(v) for v in values(spark, N.page_numeral(c), *pages)] == [(12, False), (12, True), None, None, None]


def test_scores_and_decisions(spark):
    df = spark.createDataFrame([(1, ["superscript", "system-key"]), (2, ["superscript", "math-context"]), (3, []), (4, ["explicit-link"])], "i int, s array<string>")
    assert [r[0] for r in df.orderBy("i").select(N.recognition_score(F.col("s"))).collect()] == [0.85, 0.21, 0.0, 0.99]
    rows = spark.createDataFrame([(0.5, 0.9, False, 0), (0.3, 0.9, False, 0), (0.5, 0.0, True, 2), (0.5, 0.0, True, 1), (0.7, 0.0, False, 0)], "s double, d double, a boolean, n int")
    assert [r[0] for r in rows.select(N.decision(F.col("s"), F.col("d"), F.col("a"), F.col("n"))).collect()] == ["accepted", "rejected", "accepted-unresolved", "rejected", "accepted-unresolved"]


def test_order_statistics(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([5.0],)], "v array<double>")
    v = F.col("v")
    got = df.select(stats.upper_median(v), stats.top_percentile(v, 0.9), stats.low_quantile(v, 0.9), stats.top_percentile(v, 0.5)).collect()
    assert [tuple(r) for r in got] == [(3.0, 4.0, 3.0, 3.0), (5.0, 5.0, 5.0, 5.0)]
    tied = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 2), ("a", 2.2, 3), ("a", 0.8, 4), ("b", -2.5, 1)], "k string, v double, p int")
    assert {r.k: r.m for r in stats.first_mode(tied, ["k"], "v", "p", 1.0, "m").collect()} == {"a": 2.0, "b": -2.0}
    assert spark.range(1).select(stats.percent(F.lit(1), F.lit(3)), stats.percent(F.lit(1), F.lit(0)), stats.half_up(F.lit(-2.5))).first()[:] == (33.3, 0.0, -2)


def test_text_normal_forms(spark):
    c = F.col("c0")
    assert values(spark, text.normal_text(c), ("oﬃce naı̈ve",), ("so­ft x​",), ("é",), (None,)) == ["office naı̈ve", "soft x", "é", None]
    assert values(spark, text.respaced(c), ("one,two 1,000 a.b",), ("year.What J.D.",), ("he said”and",), ("end.“Then",)) == ["one, two 1,000 a.b", "year. What J.D.", "he said” and", "end. “Then"]
    assert values(spark, text.quality(c), ("",), ("the quick brown fox",), ("xzq wrt",), ("����",)) == [0.0, 0.94, 0.54, 0.0]
    assert values(spark, text.page_kind(F.length(c), text.quality(c)), ("short",), ("the quick brown fox " * 5,), ("xzqw " * 20,)) == ["scanned", "native", "poor_native"]
    assert values(spark, text.head_key(c), ("  CHAPTER 12 — The End!",)) == ["chapter # the end"]
    assert values(spark, text.first_word_case(c), ("The end",), ("the end",), ("THE END",), ("“Quote",), ("A tale",)) == ["upper", "lower", None, None, "upper"]


def test_markers(spark):
    c = F.col("c0")
    assert values(spark, text.marker_key(c), ("[12]",), ("(B).",), (" † ",), ("iv.",)) == ["12", "b", "†", "iv"]
    assert values(spark, text.marker_class(c), ("12",), ("1234",), ("**",), ("iv",), ("b",), ("word",), ("",)) == ["numeric", None, "symbol", "roman", "alphabetic", None, None]
    assert values(spark, text.glued_symbols(c), ("word† and said.** but * alone†x",)) == [["†", "**"]]
    assert values(spark, text.within_one_edit(c, F.col("c1")), ("18", "13"), ("18", "1"), ("18", "31")) == [True, True, False]


@pytest.mark.parametrize(
    ("given_text", "want"),
    [
        ("One here. Two there! Three?", ["One here.", "Two there!", "Three?"]),
        ("Mr. Ash met Dr. Elm. They spoke.", ["Mr. Ash met Dr. Elm.", "They spoke."]),
        ("See Od. 1.10 and Il. 24.5 for it.", ["See Od. 1.10 and Il. 24.5 for it."]),
        ("It ended.[3] She left.", ["It ended.[3]", "She left."]),
        ("no end at all", ["no end at all"]),
        ("", [""]),
        ("He said “Go.” Then he left.", ["He said “Go.”", "Then he left."]),
    ],
)
def test_sentences(given_text, want):
    assert [given_text[a:b] for a, b in S.sentences(given_text)] == want


@given(st.text(alphabet="ab .!?AB1[]”\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_sentences_are_in_order_and_cover_all_but_space(t):
    found = S.sentences(t)
    assert found
    at = 0
    for a, b in found:
        assert at <= a <= b <= len(t) and not t[at:a].strip()
        at = b
    assert not t[at:].strip()
    assert all(S.sentence_at(t, a) == (a, b) for a, b in found if b > a)


def test_phrases_and_markers_in_text():
    t = "The sense and conduct[6] of Elizabeth, at 6 o'clock"
    assert S.phrase_span(t, "sense — and CONDUCT") == (4, 21, 1.0)
    assert S.phrase_span(t, "conduct of nobody")[2] == pytest.approx(1 / 3)
    assert S.phrase_span(t, "ens") is None and S.phrase_span(t, " ") is None
    assert t[slice(*S.marker_span(t, "6"))] == "[6]" and S.marker_span(t, "word") is None
    assert [S.is_marker(m) for m in ("[6]", "1.136–40", "†", "a", "two words")] == [True, True, True, True, False]
    assert S.literal_span("a well known man", "well-\nknown") == (2, 12) and S.literal_span("abc", "x") is None
    assert S.opening_span("  one two three") == (2, 15) and S.opening_span("  ") is None
    assert S.snapped("hello, world", 2, 12) == (7, 12) and S.snapped("hello", 1, 3) is None


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.floats(0, 1), st.booleans()), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ranges_come_out_disjoint_and_inside(items):
    t = "some words, in a row; of thirty letters or so"
    ranges = [{"start": a, "end": a + n, "confidence": c, "exact": e and k == 0} for k, (a, n, c, e) in enumerate(items)]
    out = S.disjoint(ranges, t)
    for x, r in enumerate(out):
        if len(ranges) > 1:
            assert all(r["end"] <= o["start"] or o["end"] <= r["start"] for o in out[:x])
        assert any(r["start"] >= o["start"] and r["end"] <= o["end"] for o in ranges)
    assert [r for r in out if r.get("exact")] == [r for r in ranges if r.get("exact")]


@given(st.lists(st.tuples(st.text(alphabet="ab c", min_size=1, max_size=6), st.sampled_from(["", "em", "sup", "strong"])), max_size=6), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 9)), max_size=4))
@settings(max_examples=150, deadline=None)
def test_inline_pieces_are_the_text(runs, refs):
    t = "".join(r for r, _ in runs)
    pieces = S.inline_pieces(t, [{"t": r, f: True} if f else {"t": r} for r, f in runs], [{"id": k, "start": a, "end": a + n} for k, (a, n) in enumerate(refs)])
    assert "".join(p["text"] for p in pieces) == t
    named = [p["ref"] for p in pieces if p["ref"] is not None]
    assert len(named) == len(set(named))
    assert all(a["end"] == b["start"] for a, b in zip(pieces, pieces[1:], strict=False))


def test_span_columns(spark):
    df = spark.createDataFrame([("One. Two.", "two"), (None, "x"), ("a", None)], "t string, p string")
    rows = df.select(S.sentence_spans(F.col("t")).alias("s"), S.phrase_spans(F.col("t"), F.col("p")).alias("h")).collect()
    assert [[tuple(x) for x in r.s] if r.s else None for r in rows] == [[(0, 4), (5, 9)], None, [(0, 1)]]
    assert (rows[0].h.start, rows[0].h.end, rows[1].h.start) == (5, 8, None)
