import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import conversations as C

ROWS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(turns):
    """(cost, audit, lines) by a plain walk over the turns; turns: (role, text, fault or None)."""

    def insert(states):
        for _ in range(3):
            for i, (cost, audit, lines) in list(states.items()):
                way = (cost + 2, audit + "I", lines + (("user", "assistant")[NEXT[i] - 2] + ":",))
                if NEXT[i] not in states or way[:2] < states[NEXT[i]][:2]:
                    states[NEXT[i]] = way
        return states

    states = insert({0: (0, "", ())})
    for role, text, fault in turns:
        new = {}

        def put(to, way, new=new):
            if to not in new or way[:2] < new[to][:2]:
                new[to] = way

        for i, (cost, audit, lines) in states.items():
            put(i, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            put(NEXT[i], (cost + 2 + more, audit + "R", lines + (("user", "assistant")[NEXT[i] - 2] + ":" + text,)))
            said = {"s": 1, "u": 2, "a": 3}.get(role[:1])
            if said == NEXT[i] or (said == 1 and i == 0):
                put(said, (cost + more, audit + "K", lines + (role + ":" + text,)))
        states = insert(new)
    return min((states[i] for i in (0, 3) if i in states), key=lambda way: way[:2])


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: "".join(ch for ch in x if ch not in ".!?")}.get(k, x)
        if k:
            convs[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    out = []
    for c, turns in convs.items():
        digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), digest(t[1], t[2])))
        seen, faults = set(), []
        for _, r, x in turns:
            said = x.rstrip(WHITE)
            faults.append("blank" if not said else "duplicate" if (r, x) in seen else None if said[-1] in ".!?" else "truncated")
            seen.add((r, x))
        numbers = {t[0] for t in turns if t[0] is not None}
        initials = [r[:1] for _, r, _ in turns]
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(turns, faults, strict=True)])
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, C.structure(df).collect()), key=str)


def test_awkward_turns_equal_a_plain_walk(spark):
    r = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "agent"], ["Yes.", "no", "", "  \n", None, "Hm!", "What?\n", "ok\x1f", "é.\x0b", "....", "x" * 50_000]
    rows = [(c, r.choice([None, i, i, i, i // 2]), r.choice(roles), r.choice(texts)) for c in [None, *range(60)] for i in range(r.randint(1, 25))]
    rows += [(70, t, "user", "Dropped.") for t in range(200) if zlib.crc32(f"70:{t}".encode()) % 20 == 0]  # loses every turn
    rows += [(80, None, None, None)] * 3
    r.shuffle(rows)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for name in ("conv", "at", "block", "copies", "line"):
        df = df.withColumn(name, F.lit("clash"))
    got = found(df)
    assert got == brute(rows) and len(got) == 63
    assert next(x for x in got if x[0] == 70)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_joined_over_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "WIDTH", 4)
    r = random.Random(9)
    rows = [(5, i, r.choice(["system", "user", "assistant", "user", "assistant"]), f"turn {i if r.random() < 0.8 else 1}{r.choice(['.', '', ' '])}") for i in range(3000)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"{c} {i}.") for c in range(6, 12) for i in range(20)]
    assert found(spark.createDataFrame(rows, ROWS).repartition(7)) == brute(rows)


def test_no_conversations(spark):
    assert found(spark.createDataFrame([], ROWS)) == []


letters = st.text(alphabet="suaxSUAX1234", min_size=1, max_size=14)


def turns_of(word):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    return [(names[C.initials_of(c)], "t", "blank" if c in C.GOES else "truncated" if c.isupper() else None) for c in word]


@settings(max_examples=150, deadline=None)
@given(letters)
def test_the_matrix_of_a_word_has_the_cheapest_repair(word):
    matrix = C.word_matrix(word)
    assert min(matrix[C.NOTHING], matrix[C.ASSISTANT]) == cheapest(turns_of(word))[:2]


@settings(max_examples=100, deadline=None)
@given(letters, letters, letters)
def test_the_product_is_associative(a, b, c):
    x, y, z = map(C.word_matrix, (a, b, c))
    assert C.times(C.times(x, y), z) == C.times(x, C.times(y, z)) == C.word_matrix(a + b + c)


@pytest.mark.parametrize(("word", "audit"), [("ua", "KK"), ("sua", "KKK"), ("s", "D"), ("a", "IK"), ("uu", "KR"), ("au", "IKKI"), ("uau", "KKKI"), ("uaa", "KKIK"), ("U", "D"), ("1ua", "DKK"), ("xa", "RK")])
def test_small_repairs(word, audit):
    matrix = C.word_matrix(word)
    assert min(matrix[C.NOTHING], matrix[C.ASSISTANT])[1] == audit
