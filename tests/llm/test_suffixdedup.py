import hashlib
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.suffixdedup import ANCHOR, LENGTH, BlindTrie, anchors, bucket_of, deep_shallow, leftmost_least, multikey_quicksort, remove_repeats
from tests.llm import corpus


def brute(rows):
    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - 49):
                g = b[k : k + 50]
                firsts[g] = min(i, firsts.get(g, i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if firsts[b[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    rows = corpus.rows()
    r = random.Random(8)
    passage = " ".join(corpus.words(r, 40))
    for i in range(100, 140):  # one passage in many documents, whole or cut, at any place
        cut = passage[r.randint(0, 60) : len(passage) - r.randint(0, 60)]
        rows.append((i, " ".join(corpus.words(r, r.randint(0, 20))) + cut + " ".join(corpus.words(r, r.randint(0, 20))), "aa", "s", 0))
    rows = [x for x in rows if x[0] != 56 or len(x[1]) < 10**6]
    got = remove_repeats(corpus.frame(spark, rows)).collect()
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got], key=str) == brute(rows)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got)


def test_empty_table(spark):
    assert remove_repeats(corpus.empty(spark)).count() == 0


def test_every_window_has_an_anchor_that_its_bytes_alone_fix():
    r = np.random.Generator(np.random.PCG64(1))
    for alphabet in (2, 4, 200):
        text = r.integers(0, alphabet, 4000).astype(np.uint8)
        h, p = anchors(text)
        where = dict(zip(p.tolist(), h.tolist(), strict=True))
        for k in range(0, 4000 - LENGTH + 1, 7):
            inside = [q for q in range(k, k + LENGTH - ANCHOR + 1) if q in where]
            assert inside
            own = anchors(text[k : k + LENGTH])
            assert own[1][0] + k in inside and own[0][0] == where[own[1][0] + k]


@given(st.lists(st.tuples(st.integers(0, 3), st.binary(min_size=0, max_size=30)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_deep_shallow_orders_each_group(items):
    groups = np.array([g for g, _ in items])
    texts, lengths = np.zeros((len(items), 30), np.uint8), np.array([len(t) for _, t in items])
    for i, (_, t) in enumerate(items):
        texts[i, : len(t)] = list(t)
    order, lcp = deep_shallow(groups, texts, lengths)
    assert sorted(order.tolist()) == list(range(len(items)))
    for k in range(1, len(items)):
        (g, a), (h, b) = items[order[k - 1]], items[order[k]]
        if g != h:
            assert lcp[k] == -1
        else:
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n
    # Texts of one group that share a prefix of any length stand together.
    for n in range(31):
        seen, last = set(), None
        for i in order:
            key = (items[i][0], items[i][1][:n]) if len(items[i][1]) >= n else None
            if key != last and key is not None:
                assert key not in seen
                seen.add(key)
            last = key


@given(st.sets(st.binary(max_size=12), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_blind_trie_sorts(strings):
    items = list(strings)
    trie = BlindTrie(0, items)
    for k in range(1, len(items)):
        trie.insert(k)
    assert [items[i] for i in trie.ordered()] == sorted(items)


def test_buckets_are_sparks(spark):
    ids = [0, 1, -1, 5, 2**62, -(2**63), 123456789]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").selectExpr("pmod(xxhash64(i), 97)").collect()]
    assert bucket_of(np.array(ids, np.int64), 97).tolist() == want


def test_leftmost_least_of_every_run():
    r = np.random.Generator(np.random.PCG64(3))
    for width in (1, 2, 5, 16, 31, 33):
        h = r.integers(0, 9, 400).astype(np.uint64)
        assert leftmost_least(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]


def test_multikey_quicksort_parts_groups_by_their_words():
    r = np.random.Generator(np.random.PCG64(4))
    for n in (0, 1, 2, 50, 900):
        groups, words = r.integers(0, 6, n), r.integers(0, 3, (n, 4)).astype(np.uint64)
        words[: n // 2] = 7
        for depth in (0, 1, 2):
            order, run = multikey_quicksort(groups, words, depth)
            keys = [(int(groups[i]), *words[i, :depth].tolist()) for i in order]
            assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
            assert [a == b for a, b in zip(keys, keys[1:])] == (np.diff(run) == 0).tolist()


def test_texts_that_repeat_themselves_take_time_by_their_length(spark):
    line = ("".join(random.Random(5).choices("abcdefgh ", k=99)) + "\n").encode()
    start = time.process_time()
    h, p = anchors(np.frombuffer(line * 100_000, np.uint8))
    assert time.process_time() - start < 20 and len(np.unique(h)) < 40 and len(p) > 100_000
    text = line.decode() * 3000
    rows = [(1, "x" + text, "aa", "s", 0), (2, text + "y", "aa", "s", 0), (None, text, "aa", "s", 0), (None, text, "aa", "s", 0)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(corpus.frame(spark, rows)).collect()}
    assert got == {1: (0, 0), 2: (300_000, 1), None: (0, 0)}
