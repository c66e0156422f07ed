"""Personal data by weak supervision, in DataFrame functions only.

Candidates are spans of four kinds (email, ip, card, phone): all matches of the base rules, those that fail their test
included, and looser forms, sought in the text with all base spans masked. Four labelers vote yes, no or abstain on each: the base rule itself, a gazetteer (address
endings, issuer prefixes, calling codes, reserved networks), the words before the span, and the span's shape. What a labeler asks
of a loose form differs from what it asks of a strict one (a national number has a trunk or area code in place of a calling
code). Counts of vote patterns (at most 4 * 2 * 81 rows, whatever the input) reach the driver; there expectation-maximisation estimates
each labeler's reliability without labels, and a logistic span classifier is trained on the posteriors. It is applied
as a column expression. Spans that pass the base rules always stay; looser ones join where the classifier accepts them
and they overlap no span found before. Offsets are code points, ends exclusive.

Nulls and empty texts: no spans. A null doc_id stays a row. Repeated rows are answered each. Ties: of loose spans that
overlap, the first by kind stays. Long texts: work grows with the text and its spans (and their number squared / 64 in
sums of blocks). An empty table gives no rows, and a classifier that accepts nothing. Other columns of docs are never read
by find_private; redact packs a row into one struct, so their names cannot clash with its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
#: Code points before a span in which the context labeler looks.
CONTEXT = 32
EM_ROUNDS, EM_SMOOTH = 40, 1.0
BLOCK = 64

# The base rules. Each is the stated rule with possessive loops, which need no stack for long runs; a
# match may start only at the start of a run or where the last match ended, as a leftmost match would.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser forms.
LOOSE_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"
LOOSE_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
LOOSE_PHONE = r"(?<![0-9A-Za-z.+(-])(?<![0-9]\x20)(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\x20.-]?[0-9])"
#: What stands for each code point of a base span where loose forms are sought: no form holds it.
MASK = "\u0001"

# Gazetteers and context words.
ENDINGS = r"(?i)\.(com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|us|ca|eu|ch|at|nl|be|mx|ar|example|test)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
GLOBAL_V6 = r"(?i)^([23][0-9a-f]{3}|f[cde][0-9a-f]{2}):"
SHORT_ISSUERS = r"^(3[47][0-9]{13}|3(0[0-5]|[68][0-9])[0-9]{11}|4[0-9]{12}|(2131|1800)[0-9]{11})$"
NATIONAL = r"^(0[1-9]|[2-9][0-8][0-9][2-9])"
#: A context word may be followed by a few others ("call me on"), but by no number or end of a sentence.
_NEAR = r"\b[^.!?0-9]{0,16}[.:]?\s*$"
YES_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo|courriel|kontakt)" + _NEAR,
    "ip": r"(?i)\b(ip|address|host|server|login|client|adresse)" + _NEAR,
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|karte|tarjeta|carte|account)" + _NEAR,
    "phone": r"(?i)\b(tel|telephone|phone|call|mobile|fax|telefon|teléfono|téléphone)" + _NEAR,
}
NO_WORDS = r"(?i)\b(version|release|isbn|order|invoice|part|section|serial|page|chapter)\W*(no\b\.?|number|#)?\W*$"


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,loose:boolean,rule:int,gazetteer:int,context:int,shape:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _running_max(values: Column) -> Column:
    """Of each place of an array of bigint, the greatest value before it (null at first), by blocks of O(BLOCK) each."""
    top = lambda xs: F.array_max(xs)

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: top(F.slice(v, b * BLOCK + 1, BLOCK)))

    def placed(p: Column) -> Column:
        return F.transform(p["v"], lambda x, i: F.greatest(F.get(p["before"], F.floor(i / BLOCK).cast("int")), top(F.slice(p["v"], (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK).cast("int")))))

    def whole(v: Column) -> Column:
        before = _let(blocks(v), lambda m: F.transform(m, lambda x, i: top(F.slice(m, F.lit(1), i))))
        return _let(F.struct(v.alias("v"), before.alias("before")), placed)

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<bigint>")))


_HITS = "array<struct<start:bigint,end:bigint,hit:string,ahead:string>>"


def _matches(text: Column, pattern: str, least: int = 1) -> Column:
    """array<struct<start, end, hit, ahead>> of the leftmost non-overlapping matches of at least so many code points.

    Offsets are code points. Starts are running sums of what lies between and in the matches, by blocks, so that they take
    O(BLOCK) each; ahead is the CONTEXT code points before a match, put together from what lies just before it, so that
    no match walks through the text.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def spans(f: Column) -> Column:
        gaps = F.transform(f["gaps"], lambda x: F.length(x).cast("bigint"))
        steps = F.zip_with(F.slice(gaps, 1, F.size(f["hits"])), f["hits"], lambda g, h: g + F.length(h))
        return _let(F.struct(gaps.alias("gaps"), f["gaps"].alias("between"), f["hits"].alias("hits"), steps.alias("steps")), placed)

    def placed(p: Column) -> Column:
        n = F.size(p["hits"])
        add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: add(F.slice(p["steps"], b * BLOCK + 1, BLOCK)))
        before = _let(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: add(F.slice(s, F.lit(1), b))))

        def ahead(i: Column) -> Column:
            # A match and what is before it have two code points at least, so half of CONTEXT of them reach CONTEXT back.
            k = F.least(i, F.lit(CONTEXT // 2))
            near = F.zip_with(F.slice(p["between"], i - k + 1, k), F.slice(p["hits"], i - k + 1, k), lambda g, h: F.concat(_last(g), h))
            return _last(F.concat(F.array_join(near, ""), _last(F.get(p["between"], i))))

        def one(b: Column) -> Column:
            def at(h: Column, i: Column) -> Column:
                start = F.get(b, F.floor(i / BLOCK).cast("int")) + add(F.slice(p["steps"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)) + F.get(p["gaps"], i)
                return _let(start, lambda s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("hit"), F.when(F.length(h) >= least, ahead(i)).alias("ahead")))

            return F.filter(F.transform(p["hits"], at), lambda s: s["end"] - s["start"] >= least)

        return F.when(n > 0, _let(before, one)).otherwise(F.array().cast(_HITS))

    return _let(found, spans)


def _last(x: Column) -> Column:
    """The last CONTEXT code points."""
    return F.when(F.length(x) > CONTEXT, F.right(x, F.lit(CONTEXT))).otherwise(x)


def _if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_HITS))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def worth(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(hit: Column) -> Column:
    """Whether all dotted parts are at most 255, leading zeros or not."""
    return F.forall(F.split(hit, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: F.when(F.length(q) > 3, False).otherwise(F.when(q == "", F.lit(0)).otherwise(q.try_cast("int")) <= 255)))


def _vote(yes: Column, no: Column) -> Column:
    """1, 0 or -1 for abstaining."""
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _either(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(0)


def _masked(text: Column, pattern: str, test: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern that passes its test replaced by as many code points of MASK."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(test(h), F.repeat(F.lit(MASK), F.length(h))).otherwise(h))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, h: F.concat(gap, F.coalesce(h, F.lit("")))), "")


def _masking(pattern: str, test: Callable[[Column], Column], may: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.when(may(t), _masked(t, pattern, test)).otherwise(t)


def _labeled(kind: str, spans: Column, base: Callable[[Column], Column], loose: bool, gazetteer, shape) -> Column:
    def one(s: Column) -> Column:
        def seen(x: Column) -> Column:
            passed = x["passed"]
            rule = F.lit(-1) if loose else F.when(passed, 1).otherwise(0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(False) if loose else passed).alias("base"), F.lit(loose).alias("loose"), rule.alias("rule"), gazetteer(s["hit"], x["digits"]).alias("gazetteer"), _vote(x["ahead"].rlike(YES_WORDS[kind]), x["ahead"].rlike(NO_WORDS)).alias("context"), shape(s["hit"], x["digits"]).alias("shape"))

        return _let(F.struct(s["ahead"].alias("ahead"), _digits(s["hit"]).alias("digits"), base(s["hit"]).alias("passed")), seen)

    return F.transform(spans, one).cast(_SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes, strict ones before loose ones, then by kind and start."""
    n = F.length
    gaz = {
        "email": lambda h, d: _vote(h.rlike(ENDINGS), F.lit(False)),
        "ip": lambda h, d: _vote(~h.rlike(RESERVED), h.rlike(RESERVED)),
        "card": lambda h, d: _vote(d.rlike(ISSUERS), ~d.rlike(ISSUERS)),
        "phone": lambda h, d: _vote(d.rlike(CALLING), F.lit(False)),
    }
    shape = {
        "email": lambda h, d: _vote(h.rlike(r"(?i)[.)\]]\x20?[a-z]{2,24}$") & ~h.rlike(r"\.\."), h.rlike(r"\.\.|^[.]")),
        "ip": lambda h, d: _vote((n(h) >= 7) & (n(h) <= 39), n(h) > 39),
        "card": lambda h, d: _vote(h.rlike(r"^[0-9]{4}([\x20-])[0-9]{4,6}\1|^[0-9]{15,16}$"), (n(d) < 13) | (n(d) > 19)),
        "phone": lambda h, d: _vote((n(d) >= 9) & (n(d) <= 13), (n(d) < 8) | (n(d) > 15)),
    }
    loose_gaz = {
        "email": lambda h, d: _either(F.regexp_replace(h, r"\x20?[(\[]dot[)\]]\x20?", ".").rlike(ENDINGS)),
        "ip": lambda h, d: _either(h.rlike(GLOBAL_V6)),
        "card": lambda h, d: _either(d.rlike(SHORT_ISSUERS)),
        "phone": lambda h, d: _either(d.rlike(NATIONAL)),
    }
    loose_shape = {
        "email": lambda h, d: _vote(h.rlike(r"(?i)[a-z]{2,24}$"), h.rlike(r"[0-9-]$|^[.]")),
        "ip": lambda h, d: _either(h.rlike(r"[0-9A-Fa-f]{3}") & h.rlike("[A-Fa-f]")),
        "card": lambda h, d: _either(h.rlike(r"^[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{4,5}$|^[0-9]{13,15}$")),
        "phone": lambda h, d: _either(h.rlike(r"^\(|^[0-9]+([\x20.-])[0-9]+\1[0-9]+$") & n(d).between(9, 11)),
    }
    has = lambda t, s: F.contains(t, F.lit(s))
    is_card = lambda h: n(_digits(h)).between(16, 19) & _luhn(_digits(h))
    is_phone = lambda h: n(_digits(h)).between(8, 15)
    never = lambda h: F.lit(False)
    digit = text.rlike("[0-9]")
    strict = [
        _labeled("email", _if(has(text, "@"), _matches(text, EMAIL)), lambda h: F.lit(True), False, gaz["email"], shape["email"]),
        _labeled("ip", _if(digit, _matches(text, IP)), _octets, False, gaz["ip"], shape["ip"]),
        _labeled("card", F.filter(_if(digit, _matches(text, DIGITS, 13)), lambda s: n(_digits(s["hit"])).between(16, 19)), is_card, False, gaz["card"], shape["card"]),
        _labeled("phone", _if(has(text, "+"), _matches(text, PHONE)), is_phone, False, gaz["phone"], shape["phone"]),
    ]

    def loose(t: Column) -> Column:
        digit = t.rlike("[0-9]")
        return F.concat(
            _labeled("email", _if(has(t, "(at)") | has(t, "[at]"), _matches(t, LOOSE_EMAIL)), never, True, loose_gaz["email"], loose_shape["email"]),
            _labeled("ip", _if(digit & has(t, ":"), _matches(t, LOOSE_IP)), never, True, loose_gaz["ip"], loose_shape["ip"]),
            _labeled("card", F.filter(_if(digit, _matches(t, DIGITS, 13)), lambda s: n(_digits(s["hit"])).between(13, 15) & _luhn(_digits(s["hit"]))), never, True, loose_gaz["card"], loose_shape["card"]),
            _labeled("phone", _if(digit, _matches(t, LOOSE_PHONE)), never, True, loose_gaz["phone"], loose_shape["phone"]),
        )

    # Each rule masks what the ones before left of it: the longest forms first. What then still reaches into a base span is
    # refused by add_accepted.
    masked = text
    for pattern, test, may in ((PHONE, is_phone, lambda t: has(t, "+")), (EMAIL, lambda h: F.lit(True), lambda t: has(t, "@")), (IP, _octets, lambda t: has(t, ".")), (DIGITS, is_card, lambda t: t.rlike("[0-9]{4}"))):
        masked = _let(masked, _masking(pattern, test, may))
    return F.concat(*strict, _let(F.when(digit | has(text, "@"), masked).otherwise(text), loose))


VOTERS = ("rule", "gazetteer", "context", "shape")


class SpanClassifier:
    """Labeler reliabilities by expectation-maximisation, then a logistic model of votes and kind on its posteriors."""

    def __init__(self, patterns: list[tuple]):
        """patterns: (kind, loose, rule, gazetteer, context, shape, count)."""
        self.weights = np.zeros(1 + len(KINDS) + 1 + 2 * len(VOTERS))
        self.reliability: dict[str, tuple[float, float]] = {}
        if not patterns:
            self.weights[0] = -1.0
            return
        patterns = sorted(patterns)
        votes = np.array([[int(v) for v in p[2:6]] for p in patterns])
        kind = np.array([KINDS.index(p[0]) for p in patterns])
        group = kind + len(KINDS) * np.array([int(p[1]) for p in patterns])
        count = np.array([float(p[6]) for p in patterns])
        cast = (votes >= 0).sum(1)
        q = np.clip(np.where(cast > 0, (votes == 1).sum(1) / np.maximum(1, cast), 0.5), 0.1, 0.9)
        for _ in range(EM_ROUNDS):
            w = np.stack([count * (1 - q), count * q])
            prior = np.stack([[(w[c][group == g].sum() + EM_SMOOTH) for g in range(2 * len(KINDS))] for c in (0, 1)])
            prior = prior / prior.sum(0)
            # Smoothed towards a labeler that is right four times in five.
            table = np.array([[[w[c][votes[:, v] == o].sum() + EM_SMOOTH * (2.0 if o < 0 else 4.0 if o == c else 1.0) for o in (-1, 0, 1)] for v in range(len(VOTERS))] for c in (0, 1)])
            table = table / table.sum(2, keepdims=True)
            log = np.log(prior[:, group]) + sum(np.log(table[:, v, votes[:, v] + 1]) for v in range(len(VOTERS)))
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        self.reliability = {v: (float(table[1, i, 2]), float(table[0, i, 1])) for i, v in enumerate(VOTERS)}
        x = np.stack([self._features(p) for p in patterns])
        share = count / count.sum()
        for _ in range(60):  # Newton's steps on a ridge-penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            grad = x.T @ (share * (p - q)) + 1e-3 * self.weights
            hess = (x.T * (share * p * (1 - p))) @ x + 1e-3 * np.eye(x.shape[1])
            step = np.linalg.solve(hess, grad)
            self.weights = self.weights - step
            if np.abs(step).max() < 1e-9:
                break

    @staticmethod
    def _features(p: tuple) -> np.ndarray:
        return np.array([1.0, *(float(p[0] == k) for k in KINDS), float(p[1]), *(float(int(v) == o) for v in p[2:6] for o in (0, 1))])

    def probability(self, s: Column) -> Column:
        w = [float(v) for v in self.weights]
        terms = [F.lit(w[0])] + [F.when(s["kind"] == k, w[1 + i]).otherwise(0.0) for i, k in enumerate(KINDS)] + [F.when(s["loose"], w[1 + len(KINDS)]).otherwise(0.0)]
        at = 2 + len(KINDS)
        for i, v in enumerate(VOTERS):
            terms.append(F.when(s[v] == 0, w[at + 2 * i]).when(s[v] == 1, w[at + 2 * i + 1]).otherwise(0.0))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return 1 / (1 + F.exp(-total))


def fit(held: DataFrame, column: str = "spans") -> SpanClassifier:
    """Train on the vote patterns of a column of candidates; only their counts come to the driver."""
    votes = held.select(F.explode(column).alias("s")).select("s.kind", "s.loose", *[f"s.{v}" for v in VOTERS])
    return SpanClassifier([tuple(r) for r in votes.groupBy("kind", "loose", *VOTERS).count().collect()])


def add_clear(df: DataFrame, name: str, spans: Column, others: Column) -> DataFrame:
    """df with a column of those of spans that overlap none of others.

    In order of starts, no other that began before may reach into a span, and the next other begins at its end or later.
    Steps are columns of their own, for Spark resolves nested functions a level at a time.
    """
    low, plain = F.lit(-1).cast("bigint"), F.array().cast("array<struct<start:bigint,mine:boolean,end:bigint,kind:string>>")

    def marked(xs: Column, mine: bool) -> Column:
        return F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), s["kind"].alias("kind")))

    # Others come before spans of the same start, for they then reach into them. Nothing to compare: nothing is sorted.
    both = F.when((F.size(spans) > 0) & (F.size(others) > 0), F.array_sort(F.concat(marked(others, False), marked(spans, True)))).otherwise(plain)
    df = df.withColumns({"_spans": spans, "_all": both})
    df = df.withColumn("_reach", _running_max(F.transform("_all", lambda s: F.when(s["mine"], low).otherwise(s["end"]))))
    df = df.withColumn("_next", F.reverse(_running_max(F.transform(F.reverse("_all"), lambda s: F.when(~s["mine"], -s["start"])))))
    # Bound, or the optimiser would put the running values' whole expressions where each element asks for its own.
    free = _let(F.struct(F.col("_all").alias("all"), F.col("_reach").alias("reach"), F.col("_next").alias("next")), lambda p: F.transform(p["all"], lambda s, i: F.when(s["mine"] & (F.coalesce(F.get(p["reach"], i), low) <= s["start"]) & F.coalesce(-F.get(p["next"], i) >= s["end"], F.lit(True)), F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    alone = F.transform("_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn(name, F.when(F.size("_all") > 0, F.filter(free, lambda s: s.isNotNull())).otherwise(alone))
    return df.drop("_spans", "_all", "_reach", "_next")


def add_accepted(df: DataFrame, name: str, cands: str, model: SpanClassifier) -> DataFrame:
    """df with the base spans and the loose ones that the classifier accepts, by kind as listed, then by start.

    Loose spans are taken kind by kind; each that overlaps no base span and no loose one taken before joins. Spans of one
    kind do not overlap one another, so a rejected span keeps no other out.
    """
    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumns({"_held": plain(F.filter(cands, lambda s: s["base"])), "_extra": plain(F.filter(cands, lambda s: s["loose"] & (model.probability(s) >= ACCEPT)))})
    for kind in KINDS:
        df = add_clear(df, "_more", F.filter("_extra", lambda s: s["kind"] == kind), F.col("_held"))
        df = df.withColumn("_held", F.concat("_held", "_more")).drop("_more")
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = F.sort_array(F.transform("_held", lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return df.withColumn(name, plain(ordered)).drop("_held", "_extra")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, ...) for every row of docs(doc_id, text, ...)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select("doc_id", candidates(F.col("text")).alias("cands")), "pii-candidates")
    model = fit(held, "cands")
    base = F.filter("cands", lambda s: s["base"])
    count = lambda k: F.size(F.filter("cands", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    done = add_accepted(held, "found", "cands", model)
    return done.select("doc_id", *[count(k) for k in KINDS], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("bigint").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by <KIND>; n_chars follows where docs has it. A null text stays null."""
    names = docs.columns
    held = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text")).select("row", "text", candidates(F.coalesce("text", F.lit(""))).alias("cands")), "pii-redaction")
    model = fit(held, "cands")
    found = add_accepted(held, "found", "cands", model)
    by_start = F.sort_array(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(spans: Column) -> Column:
        """Spans by start; the text is cut a BLOCK of spans at a time, and each such stretch at its spans."""
        reach = _running_max(F.transform(spans, lambda s: s["end"]))
        done = lambda p, i: F.coalesce(F.get(p["reach"], i), F.lit(0).cast("bigint"))

        def stretch(p: Column, b: Column) -> Column:
            low = done(p, b * BLOCK)
            last = F.least((b + 1) * BLOCK, F.size(p["spans"])) - 1
            part = F.substring(F.col("text"), (low + 1).cast("int"), F.greatest(F.lit(0), F.get(p["spans"], last)["start"] - low).cast("int"))

            def tag(q: Column, s: Column, i: Column) -> Column:
                at = done(p, b * BLOCK + i)
                return F.when(s["start"] >= at, F.concat(F.substring(q, (at - low + 1).cast("int"), (s["start"] - at).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

            return _let(part, lambda q: F.array_join(F.transform(F.slice(p["spans"], b * BLOCK + 1, BLOCK), lambda s, i: tag(q, s, i)), ""))

        def whole(p: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p["spans"]) - 1) / BLOCK).cast("int")), lambda b: stretch(p, b))
            end = F.array_max(F.transform(p["spans"], lambda s: s["end"]))
            return F.concat(F.array_join(blocks, ""), F.substring(F.col("text"), (end + 1).cast("int"), F.length("text")))

        return _let(F.struct(spans.alias("spans"), reach.alias("reach")), whole)

    clean = found.withColumn("found", by_start).withColumn("clean", F.when(F.size("found") > 0, _let(F.col("found"), cut)).otherwise(F.col("text")))
    out = [F.col("clean").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.when(F.size("found") > 0, F.length("clean")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names]
    return clean.select(*out)
