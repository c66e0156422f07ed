import random

import pytest

from quire.operators.phrases import contained


def brute(texts, phrases, least):
    out = {}
    for t, text in texts:
        hay = (text or "").split()
        for p, phrase in phrases:
            words, best = (phrase or "").split(), None
            for k in range(len(words)):
                for at in range(len(hay)):
                    n = 0
                    while k + n < len(words) and at + n < len(hay) and words[k + n] == hay[at + n]:
                        n += 1
                    if n and n >= least * len(words) - 1e-9 and (best is None or (-n, k, at) < best):
                        best = (-n, k, at)
            if best:
                out[p, t] = (len(words), -best[0], best[1], best[2])
    return out


@pytest.mark.parametrize("least", [0.6, 0.85, 1.0])
def test_runs_are_those_of_brute_force(spark, least):
    r = random.Random(int(least * 100))
    say = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    texts = [(i, say(r.choice((0, 1, 3, 60)))) for i in range(60)] + [(60, None), (61, "a " * 500)]
    phrases = [(i, say(r.choice((1, 2, 3, 4, 7, 8)))) for i in range(40)] + [(40, None), (41, ""), (42, "a a a"), (43, "e")]
    got = contained(spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(phrases, "p int, phrase string"), "t", "p", least).collect()
    assert len(got) == len({(x.p, x.t) for x in got}) > 100
    assert {(x.p, x.t): tuple(x[2:]) for x in got} == brute(texts, phrases, least)


def test_marks_case_repeats_and_missing_ids(spark):
    texts = [(1, "The Old—man; ÉTÉ, and"), (1, "old man été"), (None, "old man"), (2, "household mans")]
    phrases = [(1, "old MAN (été)"), (1, "old MAN (été)"), (None, "old man"), (3, "old")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = sorted(tuple(x) for x in contained(frame(texts, "t int, text string"), frame(phrases, "p int, phrase string"), "t", "p").collect())
    assert got == [(1, 1, 3, 3, 0, 0), (3, 1, 1, 1, 0, 0)]
    assert contained(frame([], "t int, text string"), frame(phrases, "p int, phrase string"), "t", "p").count() == 0
    assert contained(frame(texts, "t int, text string"), frame([], "p int, phrase string"), "t", "p").count() == 0
    with pytest.raises(ValueError):
        contained(frame(texts, "t int, text string"), frame(phrases, "p int, phrase string"), "t", "p", 0.5)


def test_a_common_seed_is_dealt_over_tasks(spark):
    """One word that a phrase of one word asks for stands in every text, many times."""
    texts = [(i, "the " * 200 + f"w{i}") for i in range(500)]
    got = contained(spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame([(1, "the"), (2, "the w7")], "p int, phrase string"), "t", "p").collect()
    assert sorted((x.p, x.t, x.at_word) for x in got) == [(1, i, 0) for i in range(500)] + [(2, 7, 199)]
