import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from quire.llm import fingerprint as fp
from tests.llm import corpus

M = (1 << 64) - 1
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def turn(x, r):
    return ((x << r) | (x >> (64 - r))) & M


def hash_long(v, seed):
    h = (seed + 0x27D4EB2F165667C5 + 8) & M
    h ^= turn(v * 0xC2B2AE3D27D4EB4F & M, 31) * 0x9E3779B185EBCA87 & M
    h = (turn(h, 27) * 0x9E3779B185EBCA87 + 0x85EBCA77C2B2AE63) & M
    h = (h ^ (h >> 33)) * 0xC2B2AE3D27D4EB4F & M
    h = (h ^ (h >> 29)) * 0x165667B19E3779F9 & M
    return h ^ (h >> 32)


def hashes(text):
    w = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for v in w[i : i + 5]:
            h = hash_long(v, h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def hexed(s):
    return "".join(f"{x & M:016x}" for x in sorted(s)[:64])


def like(a, b):
    u = sorted(set(a) | set(b))[:64]
    return 1.0 if not u else len(set(u) & set(a) & set(b)) / len(u)


def test_same_as_brute_force(spark):
    rows = [r for r in corpus.rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    texts = {i: t or "" for i, t, *_ in rows}
    got = {r.doc_id: r for r in fp.fingerprints(corpus.frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        j = ids[(k + 1) % len(ids)]
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[j][:third]
        own, other, near, r = sorted(hashes(texts[i]))[:64], sorted(hashes(edited))[:64], sorted(hashes(texts[j]))[:64], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(other))
        assert abs(r.near_edited - like(own, other)) < 1e-12 and abs(r.near_next - like(own, near)) < 1e-12


def test_nulls_and_repeated_rows_keep_their_number(spark):
    rows = corpus.rows()
    got = fp.fingerprints(corpus.frame(spark)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2


def test_one_document_is_its_own_neighbour(spark):
    r = fp.fingerprints(corpus.frame(spark, [(4, "a b c d e f g h i", "aa", "s", 17)])).collect()[0]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d e f" + b" a b ").hexdigest()[:64] or r.n_chars == 17


def test_parts_merge_into_the_whole(spark):
    a, b = "a b c d e f g h i j k l", "x y z a b c d e f g"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = row.select(fp.merge(F.col("a"), F.col("b")).alias("m"), fp.distinct_count(F.col("a")).alias("n"), fp.containment(F.col("b"), F.col("a")).alias("c")).first()
    assert r.m == sorted(hashes(a) | hashes(b)) and r.n == len(hashes(a))
    assert abs(r.c - len(hashes(a) & hashes(b)) / len(hashes(b))) < 1e-9


def test_count_estimate_is_near(spark):
    import random

    words = corpus.words(random.Random(2), 5000)
    r = spark.createDataFrame([(" ".join(words),)], "t string").select(fp.distinct_count(fp.sketch(F.col("t"), 256), 256).alias("n")).first()
    assert abs(r.n / len(hashes(" ".join(words))) - 1) < 0.25


def test_empty_table(spark):
    assert fp.fingerprints(corpus.empty(spark)).count() == 0
