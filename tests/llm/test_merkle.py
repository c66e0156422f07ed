import hashlib
import zlib

from quire.llm import merkle
from tests.llm.corpus import DOCS, empty, frame, rows


def brute(data):
    h = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            n = levels[-1]
            levels.append([h(*n[i : i + 8]) for i in range(0, len(n), 8)])
        return levels

    def climb(levels, i, digest, siblings):
        for nodes in levels[:-1]:
            low = i // 8 * 8
            run = nodes[low : low + 8]
            siblings += run[: i - low] + run[i - low + 1 :]
            digest = h(*run[: i - low], digest, *run[i - low + 1 :])
            i //= 8
        return digest

    groups = {}
    for d, t, lang, s, n in data:
        groups.setdefault(lang, []).append((d, h(*map(field, (d, s, lang, n, t))), h(*map(field, (d, s, lang, n, low(t))))))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([r[1] for r in groups[lang]]) for lang in langs]
    crown = tree([t[-1][0] for t in trees])
    out = []
    for g, lang in enumerate(langs):
        for i, (d, leaf, bad) in enumerate(groups[lang]):
            siblings = []
            hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
            end = climb(crown, g, climb(trees[g], i, bad if hit else leaf, siblings), siblings)
            out.append((d, leaf, trees[g][-1][0], crown[-1][0], h(*siblings), end, end == crown[-1][0]))
    return out


def found(df):
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


def test_nulls_ties_repeats_long_texts_and_clashing_columns_equal_brute_force(spark):
    assert found(frame(spark)) == sorted(brute(rows()), key=str)


def test_many_groups_of_uneven_sizes_over_many_partitions(spark):
    data = []
    for g in range(75):  # sizes 1, 8, 9, 64, 65 and one large group; more groups than two levels of the crown hold
        n = [1, 8, 9, 2, 1][g % 5] if g else 700
        data += [(1000 * g + i, f"Text {g} {i}", f"l{g}", None, i) for i in range(n)]
    data += [(7, "A", None, None, None), (None, "a", None, "s", None)]
    assert found(spark.createDataFrame(data, DOCS).repartition(13)) == sorted(brute(data), key=str)


def test_one_row_one_group_and_no_rows(spark):
    one = [(3, "Only ÀB", "x", "s", 7)]
    assert found(spark.createDataFrame(one, DOCS)) == brute(one)
    two = [(i, str(i), "x", None, None) for i in range(9)]
    assert found(spark.createDataFrame(two, DOCS)) == sorted(brute(two), key=str)
    assert found(empty(spark)) == []


def test_starts_follow_groups_over_partitions():
    ends = {0: ("a", 3, "b", 2, 2), 2: ("b", 4, "b", 4, 1), 3: ("b", 1, "d", 5, 3), 5: ("e", 1, "e", 1, 1)}
    assert merkle._starts(ends) == ({0: (0, 0, True), 2: (1, 2, True), 3: (1, 6, False), 5: (4, 0, False)}, 5)
