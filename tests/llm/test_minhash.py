import random
import re

import numpy as np
import pytest

from quire.llm import minhash
from quire.llm.minhash import band_keys, drop_near_duplicates, links_within, near_duplicates, permutation, signature
from tests.llm import corpus

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def expected(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t, size))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_same_groups_as_brute_force(spark, size, percent):
    rows = corpus.rows()
    want = expected(rows, size, percent)
    got = near_duplicates(corpus.frame(spark), size, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingles(t, size)) for i, t, *_ in rows if i is not None}


def test_one_of_each_group_stays_with_its_columns(spark):
    docs = corpus.frame(spark)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = expected(corpus.rows(), 5, 80)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, c in want.items() if i == c}


def test_empty_table(spark):
    assert near_duplicates(corpus.empty(spark)).count() == 0


def test_a_doc_id_with_several_texts_is_one_document(spark):
    r = random.Random(9)
    a, b, c = (" ".join(corpus.words(r, 30)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, ""), (11, ""), (12, None), (6, a + " end"), (20, c + " x"), (20, b)]
    rows = [(i, t, "aa", "s", 0) for i, t in rows]
    want = expected(rows, 3, 85)
    got = near_duplicates(corpus.frame(spark, rows), 3, 85).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.component_id) for x in got} == set(want.items())
    assert want[5] == 3 and want[7] == 3 and want[9] == 3
    assert {x.doc_id for x in drop_near_duplicates(corpus.frame(spark, rows), 3, 85).collect()} == {i for i, x in want.items() if i == x}


def test_hubs_of_many_and_blocks_of_few_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY", 2)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 4)
    r = random.Random(10)
    base = corpus.words(r, 60)
    rows = []
    for k in range(90):  # a noisy group: each has lost some words of the base, and some got others
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = r.choice("uvwxyz") * 4
        rows.append((k, " ".join(w), "aa", "s", 0))
    got = near_duplicates(corpus.frame(spark, rows), 3, 85).collect()
    assert {x.doc_id: x.component_id for x in got} == expected(rows, 3, 85)


def test_signature_is_the_shifted_permutation():
    p, k = permutation(160), 160
    s = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    from quire.llm.words import mix

    sigma = permutation(0)
    assert (np.sort(sigma) == np.arange(1 << 22)).all() and (np.sort(p[:-k]) == np.arange(1 << 22)).all()
    places = sigma[(mix(s) >> np.uint64(42)).astype(int)].astype(int)
    assert all(signature(s, k)[j] == min(p[(q + j) % (1 << 22)] for q in places) for j in range(0, k, 13))
    assert len(set(band_keys(signature(s, k), 32, 5).tolist())) == 32


def test_block_links_join_what_pairs_join():
    r = np.random.Generator(np.random.PCG64(3))
    base = np.sort(r.choice(10_000, 200, replace=False))
    sets = [np.sort(np.unique(np.concatenate([base[: 200 - 4 * (i % 9)], r.integers(10_000, 20_000, 3 * (i % 9))]))) for i in range(60)]
    sizes = np.array([len(s) for s in sets])
    got = links_within(sizes, np.concatenate(sets), np.arange(60), None, 85)
    pairs = {(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert set(got) <= pairs

    def parts(links):
        p = list(range(60))
        for a, b in links:
            x, y = p[a], p[b]
            p = [min(x, y) if v in (x, y) else v for v in p]
        return p

    assert parts(got) == parts(pairs)
