"""A small corpus with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r: random.Random, n: int) -> list[str]:
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]


def rows() -> list[tuple]:
    r = random.Random(5)
    out = []
    base = words(r, 120)
    for i in range(30):
        out.append((i, " ".join(words(r, r.randint(20, 90))), "aa", "s", 0))
    for i in range(30, 45):  # near copies of one text, at its ends, so that links form chains
        k = (i - 30) * 2
        out.append((i, " ".join(base[k:] + words(r, k)), "aa", "s", 0))
    for i in range(45, 50):  # exact copies
        out.append((i, " ".join(base), "aa", "s", 0))
    out += [
        (50, None, None, None, None),
        (51, "", "aa", "s", 0),
        (52, "one two", "aa", "s", 0),
        (53, "one two", "bb", "s", 0),
        (54, "   \n\t ", "bb", "s", 0),
        (55, "ONE two Three", None, "s", 0),
        (56, " ".join(words(r, 40_000)), "bb", "s", 0),
        (57, "word " * 3000, "bb", "s", 0),
        (58, "é€😀 " * 40 + "\U0001f600", "bb", "s", 0),
        (59, "x" * 90_000, "bb", "s", 0),
        (60, "1234 !?", "bb", "s", 0),
        (None, " ".join(base), "aa", "s", 0),
        (None, None, None, None, None),
        (61, out[0][1] + " tail", "aa", "s", 0),
        (61, out[0][1] + " tail", "aa", "s", 0),
        (-7, out[3][1], "aa", "s", 0),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in out]


def frame(spark, data=None, extra=True):
    """The corpus as a frame, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, DOCS).repartition(5)
    if extra:
        for name in ("key", "id", "row", "node", "cands", "score", "bucket", "own"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
