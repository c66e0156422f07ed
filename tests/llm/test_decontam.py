import random
import re
from collections import Counter

import numpy as np

from quire.llm import decontam
from quire.llm.decontam import BITS, RADIUS, Benchmark, BlockIndex, contaminated, decontaminate, pack
from tests.llm import corpus


def items(spark):
    r = random.Random(12)
    texts = [" ".join(corpus.words(r, n)) for n in (15, 22, 40, 40, 57, 4, 1)] + [None, "", "   "]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id bigint, text string, doc_id string")


def planted(texts):
    r = random.Random(13)
    fill = lambda: " ".join(corpus.words(r, r.randint(30, 60)))
    w = texts[4].split()
    return [
        (300, f"{fill()} {texts[0].upper()}\n{fill()}", "aa", "s", 0),
        (301, f"{texts[1]} {fill()} {texts[3]}", "aa", "s", 0),
        (302, f"{fill()} {' '.join(w[:-3])} {fill()}", "aa", "s", 0),  # the end is gone
        (303, f"{fill()} {' '.join(w[:28] + ['zzz'] + w[29:])} {fill()}", "aa", "s", 0),  # one word of 57 differs
        (304, f"{fill()} {' '.join(w[:25])} {fill()}", "aa", "s", 0),  # not enough of it
        (305, f"{fill()} {texts[5]} {fill()}", "aa", "s", 0),  # four words: one shingle
    ]


def test_finds_whole_and_near_passages(spark):
    texts, bench = items(spark)
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(corpus.frame(spark, corpus.rows() + planted(texts)), bench).collect()}
    assert set(got) >= {(300, 0), (301, 1), (301, 3), (302, 4), (303, 4), (305, 5)}
    assert not [k for k in got if k[1] in (7, 8, 9) or k[0] == 304 and k[1] != 6]
    assert got[300, 0] == 1.0 and 0.8 <= got[303, 4] < 1


def test_clean_documents_stay_with_their_columns(spark):
    texts, bench = items(spark)
    docs = corpus.frame(spark, corpus.rows() + planted(texts))
    kept = decontaminate(docs, bench.where("item_id < 5"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {300, 301, 302, 303} and ids >= {r[0] for r in corpus.rows()} | {304, 305}


def test_empty_tables(spark):
    _, bench = items(spark)
    assert contaminated(corpus.empty(spark), bench).count() == 0
    assert contaminated(corpus.frame(spark), bench.limit(0)).count() == 0
    assert decontaminate(corpus.frame(spark), bench.limit(0)).count() == len(corpus.rows())


def test_index_finds_all_within_the_radius():
    r = np.random.Generator(np.random.PCG64(2))
    bits = r.integers(0, 2, (50, BITS)).astype(bool)
    queries = bits[np.arange(400) % 50]
    for k in range(400):
        at = r.choice(BITS, k % 70, replace=False)
        queries[k, at] = ~queries[k, at]
    prints, queries = pack(bits), pack(queries)
    far = np.bitwise_count(queries[:, None] ^ prints[None, :]).sum(2)
    for radius in (0, 3, 17, 40, RADIUS):
        q, i = BlockIndex(prints, radius=radius).search(queries)
        assert set(zip(q.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))


def test_index_is_small_and_meets_few_unrelated_items():
    r = np.random.Generator(np.random.PCG64(7))
    index = BlockIndex(pack(r.integers(0, 2, (20_000, BITS))))
    assert sum(h.nbytes + i.nbytes for _, h, i in index.lists) < 64 * 20_000 + (5 << 20)
    q, _ = index.met(pack(r.integers(0, 2, (20, BITS))))
    assert len(q) < 0.2 * 20 * 20_000


def test_same_as_all_windows_by_brute_force(spark):
    """Every window of every document against every item, weighted Jaccard on counted shingles."""
    texts, bench = items(spark)
    r = random.Random(14)
    rows = planted(texts) + [x for x in corpus.rows() if x[1] and len(x[1]) < 3000]
    for k in range(40):  # items with some words changed or gone, among others
        w = texts[r.choice((0, 1, 2, 3, 4))].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(("zzz", w[0], w[-1]))
        rows.append((500 + k, " ".join(corpus.words(r, r.randint(0, 30)) + w[r.randint(0, 2) :] + corpus.words(r, r.randint(0, 30))), "aa", "s", 0))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def shingles(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    want = {}
    for i, t, *_ in rows:
        words = split(t)
        for item, text in enumerate(texts):
            w = split(text)
            n = min(5, len(w))
            if not w or len(words) < n:
                continue
            length, own = min(len(w), len(words)), shingles(w, n)
            for k in range(len(words) - length + 1):
                here = shingles(words[k : k + length], n)
                both = sum((own & here).values())
                like = both / (sum(own.values()) + sum(here.values()) - both)
                if like >= 0.8 and like > want.get((i, item), (0, 0, -1.0))[2]:
                    want[i, item] = (k, length, like)
    got = {(x.doc_id, x.item_id): (x.first_word, x.n_words, x.similarity) for x in contaminated(corpus.frame(spark, rows), bench).collect()}
    assert len(want) > 20 and got == want


def test_runs_of_the_benchmark_give_what_one_run_gives(spark, monkeypatch):
    texts, bench = items(spark)
    docs = corpus.frame(spark, corpus.rows() + planted(texts))
    one = sorted(map(str, contaminated(docs, bench).collect()))
    kept = decontaminate(docs, bench.where("item_id < 5")).count()
    monkeypatch.setattr(decontam, "MOST_ITEMS", 3)
    assert sorted(map(str, contaminated(docs, bench).collect())) == one
    assert decontaminate(docs, bench.where("item_id < 5")).count() == kept


def test_most_windows_at_the_threshold_are_within_the_radius():
    r = random.Random(30)
    missed = 0
    for k in range(120):
        w = corpus.words(r, 40)
        bench = Benchmark([0], [" ".join(w)])
        # Four words of each end replaced: 0.8 or a little above.
        text = ["qq"] * 2 + w[2:-2] + ["qq"] * 2
        from quire.llm.words import text_rows
        import pyarrow as pa

        words = next(text_rows(pa.array([" ".join(text)])))[1]
        missed += not bench.matches(words)
    assert missed <= 1


def test_a_text_shorter_than_the_item_is_one_window(spark):
    texts, bench = items(spark)
    bench = bench.where("item_id < 5")
    w, x = texts[4].split(), texts[0].split()
    cut = [
        (400, " ".join(w[:-3]), "aa", "s", 0),  # 50 of 53 shingles
        (401, " ".join(w[5:]).upper(), "aa", "s", 0),  # 48 of 53
        (402, " ".join(w[:40]), "aa", "s", 0),  # 36 of 53: not enough
        (403, " ".join(x[:-2]), "aa", "s", 0),  # 9 of 11
        (404, " ".join(x[:-3]), "aa", "s", 0),  # 8 of 11: not enough
        (405, " ".join(w[:20] + ["zzz"] + w[21:-1]), "aa", "s", 0),  # 47 of 52 and 53
    ]
    docs = corpus.frame(spark, cut + corpus.rows())
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, round(r.similarity, 6)) for r in contaminated(docs, bench).collect() if r.doc_id is not None and r.doc_id >= 400}
    want = {(400, 4): (0, 54, round(50 / 53, 6)), (401, 4): (0, 52, round(48 / 53, 6)), (403, 0): (0, 13, round(9 / 11, 6)), (405, 4): (0, 56, round(47 / 58, 6))}
    assert got == want
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} & set(range(400, 406)) == {402, 404}


def test_no_short_text_of_four_shingles_in_five_is_lost():
    from quire.llm.words import text_rows
    import pyarrow as pa

    r = random.Random(31)
    texts = [" ".join(corpus.words(r, 9)) + f" {k}" for k in range(3000)]
    bench = Benchmark(list(range(3000)), [t.rsplit(" ", 1)[0] for t in texts])
    short = pa.array([" ".join(t.split()[:8]) for t in texts[::10]])
    for k, words in text_rows(short):
        assert (10 * k, 0, 8, 0.8) in bench.matches(words)
