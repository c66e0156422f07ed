import hashlib
import random
import re
import time

import pytest

from pyspark.sql import functions as F

from quire.llm.pii import CONTEXT, KINDS, PHONE, SpanClassifier, _matches, add_accepted, add_clear, candidates, find_private, fit, redact
from tests.llm import corpus

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(RULES[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a.b+c@d-e.co.uk, x@y and q@r.s+t@u.v.",
    "é😀 ip 1.2.3.4 and 256.1.1.1 1.2.3.4.5 001.002.003.0255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111 5 55 555",
    "call +1 (743) 555-3824 now, +12 3, +1-2-3-4-5-6-7-8.",
    "tel 743-555-3824 and write me: joe(at)mail(dot)example.org",
    "a@b.c_x@d.e ++49 170 1234567 1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "9" * 40_000,
    "1 " * 20_000,
    "a." * 20_000 + "@x.y",
    "@@@ +++ ... 1.1.1 +1",
    "+4 1111 1111 1111 1111 23",
]


@pytest.fixture(scope="module")
def data():
    return corpus.rows() + [(200 + i, t, "aa", "s", len(t)) for i, t in enumerate(TEXTS)]


def test_base_spans_are_the_rules(spark, data):
    got = {}
    for r in find_private(corpus.frame(spark, data)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in data:
        want = base(text)
        row = next(r for r in got[i] if i is not None or r.base_sha256)
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, row.spans)
        assert set(want) <= set(row.spans.split(",")) or not want
        assert [row[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        spans = [(KINDS.index(a), int(b), int(c)) for a, b, c in (s.split(":") for s in row.spans.split(",") if s)]
        assert spans == sorted(spans)


def test_redaction_takes_every_span_and_nothing_else(spark, data):
    docs = corpus.frame(spark, data)
    out = redact(docs)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    got = {r.doc_id: r for r in out.collect()}
    assert got[200].text == "mail <EMAIL>, x@y and <EMAIL><EMAIL>."
    assert got[203].text.startswith("call <PHONE> now")
    assert got[50].text is None and got[51].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None and r.doc_id is not None)
    plain = {i: t for i, t, *_ in data}
    assert got[3].text == plain[3]


def test_empty_table(spark):
    assert find_private(corpus.empty(spark)).count() == 0
    assert redact(corpus.empty(spark)).count() == 0


def test_model_tells_good_labelers_from_bad():
    # The rule and the shape agree and are right; the gazetteer votes at random.
    patterns = []
    for truth, n in ((1, 60), (0, 40)):
        for g in (0, 1):
            patterns.append(("phone", False, truth, g, -1, truth, n // 2))
    m = SpanClassifier(patterns)
    assert min(m.reliability["rule"]) > 0.85 and max(m.reliability["gazetteer"]) < 0.75
    assert SpanClassifier([]).weights[0] < 0


def test_spans_clear_of_others_are_those_of_brute_force(spark):
    r = random.Random(6)
    span = lambda: (a := r.randint(0, 400), a + r.randint(1, 12))
    rows = [(k, [span() for _ in range(r.choice((0, 1, 5, 90)))], [span() for _ in range(r.choice((0, 1, 30, 150)))]) for k in range(60)]
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    named = [(k, [("ip", *s) for s in own], [("card", *s) for s in others]) for k, own, others in rows]
    got = add_clear(spark.createDataFrame(named, f"k int, own {kind}, others {kind}"), "c", F.col("own"), F.col("others")).select("k", "c").collect()
    for k, c in got:
        own, others = rows[k][1:]
        assert sorted(tuple(s) for s in c) == sorted(("ip", a, b) for a, b in own if not any(a < d and x < b for x, d in others))


def test_what_stands_before_a_match(spark):
    t = "é" * 40 + "+12345678 a +87654321b+11111111 c " + "x" * 50 + "+22222222"
    got = spark.createDataFrame([(t,)], "t string").select(_matches(F.col("t"), PHONE).alias("m")).first().m
    assert len(got) == 4 and all(t[m.start : m.end] == m.hit and m.ahead == t[max(0, m.start - CONTEXT) : m.start] for m in got)


def test_added_spans_are_those_taken_one_by_one(spark, data):
    """The method's part: the classifier's loose spans, in order of kind and start, each clear of all held before."""
    held = corpus.frame(spark, data).select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("c")).cache()
    model = fit(held, "c")
    rows = add_accepted(held.withColumn("p", F.transform("c", model.probability)), "a", "c", model).select("c", "p", "a").collect()
    added = 0
    for r in rows:
        taken = [(s.kind, s.start, s.end) for s in r.c if s.base]
        n = len(taken)
        for s, p in sorted(((s, p) for s, p in zip(r.c, r.p, strict=True) if s.loose and p >= 0.5), key=lambda x: (KINDS.index(x[0].kind), x[0].start)):
            if not any(s.start < b and a < s.end for _, a, b in taken):
                taken.append((s.kind, s.start, s.end))
        added += len(taken) - n
        assert [tuple(x) for x in r.a] == sorted(taken, key=lambda x: (KINDS.index(x[0]), *x[1:]))
    assert added > 0


def test_a_hundred_thousand_candidates_in_one_text(spark):
    one = "+49 170 1234567, tel 743-555-3824 x; "  # one by the rule, one by the classifier
    text = one * 34_000
    docs = corpus.frame(spark, [(1, text, "aa", "s", len(text)), (2, one, "aa", "s", len(one))])
    start = time.monotonic()
    got = {r.doc_id: r for r in find_private(docs).collect()}
    assert got[1].n_phone == 34_000 and got[1].n_added == 34_000
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[1] == clean[2] * 34_000 and clean[2] == "<PHONE>, tel <PHONE> x; "
    assert time.monotonic() - start < 200


def planted():
    """(text, loose spans that are personal data, loose spans that are not) with base spans around them."""
    r = random.Random(11)
    num = lambda k: "".join(r.choice("23456789") for _ in range(k))

    def checked(head, size):
        body = head + num(size - 1 - len(head))
        return next(body + d for d in "0123456789" if luhn(body + d))

    true = [
        lambda: ("phone", r.choice(("tel ", "call me on ", "mobile: ", "fax ", "or ")), f"0{num(2)}-{num(3)}-{num(4)}"),
        lambda: ("phone", r.choice(("phone ", "call ", "and ")), f"({num(1)}3{num(1)}) {num(3)}-{num(4)}"),
        lambda: ("email", r.choice(("write to ", "mail ", "contact ", "by ")), f"jo{num(2)}(at)mail(dot)example.org"),
        lambda: ("ip", r.choice(("server ", "host ", "login from ", "at ")), f"2001:0db8:{num(2)}a0:{num(3)}b:c{num(3)}:{num(4)}:{num(4)}:{num(4)}"),
        lambda: ("card", r.choice(("amex ", "card ", "with ")), checked("37", 15)),
    ]
    false = [
        lambda: ("phone", r.choice(("part no. ", "serial number ", "order #")), f"{num(2)}.{num(4)} {num(3)}"),
        lambda: ("phone", r.choice(("invoice ", "section ", "isbn ")), f"1{num(1)}-{num(3)}-{num(3)}"),
        lambda: ("ip", r.choice(("version ", "release ")), ":".join(num(1) for _ in range(8))),
        lambda: ("email", r.choice(("chapter ", "page ")), f"see(at)row.{num(1)}-{num(1)}"),
        lambda: ("card", r.choice(("serial ", "order number ")), checked("9", 14)),
    ]
    strict = [lambda: f"call +49 170 {num(7)}", lambda: f"+1 (743) {num(3)}-{num(4)}", lambda: f"mail a{num(2)}@mail.example.com", lambda: f"host 1{num(1)}.2.{num(2)}.7", lambda: f"card {checked('4', 16)}", lambda: f"part 999.{num(3)}.1.1"]
    for _ in range(400):
        text, good, bad = "", [], []
        for _ in range(r.randint(0, 4)):
            which, out = r.choice(((true, good), (false, bad)))
            kind, ahead, hit = r.choice(which)()
            text += f"some words, {ahead}"
            out.append(f"{kind}:{len(text)}:{len(text) + len(hit)}")
            text += f"{hit}; {r.choice(strict)()} é. "
        yield text, good, bad


def test_the_classifier_adds_planted_spans_and_refuses_look_alikes(spark):
    rows = list(planted())
    docs = corpus.frame(spark, [(i, t, "aa", "s", len(t)) for i, (t, _, _) in enumerate(rows)])
    found, wrong, good, bad, other = 0, 0, 0, 0, 0
    for r in find_private(docs).collect():
        text, yes, no = rows[r.doc_id]
        added = set(filter(None, r.spans.split(","))) - set(base(text))
        assert len(added) == r.n_added
        good, bad = good + len(yes), bad + len(no)
        found, wrong, other = found + len(added & set(yes)), wrong + len(added & set(no)), other + len(added - set(yes) - set(no))
    assert min(good, bad) > 300 and found >= 0.9 * good and wrong <= 0.05 * bad and other == 0, (found, good, wrong, bad, other)


def test_loose_forms_are_sought_outside_base_spans_only(spark):
    texts = ["+1 (743) 555-3824", "+49 170 123 4567 and 030-123-4567", "4111 1111 1111 1111", "1.2.3.4 a@b.c", "+4 1111 1111 1111 1111 23"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.filter(candidates(F.col("t")), lambda s: s["loose"]).alias("c")).collect()
    assert {r.t: [r.t[s.start : s.end] for s in r.c] for r in got} == {t: ["030-123-4567"] if "030" in t else [] for t in texts}
