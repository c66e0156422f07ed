"""Phrases in texts: a containment join by a positional index of word runs, in place of every phrase against every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import settled

#: Words of a seed at most: the run by which a phrase is looked up.
SEED = 3


def folded_words(s: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, size: Column, first: Column, last: Column) -> Column:
    """array<struct<at, gram>> of the runs of so many words that start from first to last (none where last is before first)."""
    one = lambda i: F.struct(i.alias("at"), F.xxhash64(size, F.slice(words, i + 1, size)).alias("gram"))
    return F.when(first <= last, F.transform(F.sequence(first, last), one)).otherwise(F.array().cast("array<struct<at:int,gram:bigint>>"))


def contained(texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str, least: float = 0.85) -> DataFrame:
    """(phrase_id, text_id, n_words, n_matched, from_word, at_word): of each phrase the longest run of its words that stands in
    each text, where that is at least the share `least` of them.

    texts: (text_id, text), phrases: (phrase_id, phrase). from_word is the run's place in the phrase, at_word in the text, by
    words from 0; of runs as long the first in the phrase, and of its places the first in the text.

    Any run of m of n words holds the words from n - m to m, so one short run of those, the rarest in all texts, finds
    every match of a phrase; the words around each place of it are then compared. Texts are cut into runs once; only runs that
    phrases have travel on, and a text's words meet its candidates in one join. Nothing is compared pair by pair.

    Nulls, empty texts and phrases, and rows without an id match nothing. Of rows that repeat an id the best match is given.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be over a half: below it a match need hold no word in particular")
    t = texts.select(F.col(text_id).alias("t"), folded_words(F.col("text").cast("string")).alias("hay"))
    p = phrases.select(F.col(phrase_id).alias("p"), folded_words(F.col("phrase").cast("string")).alias("words")).where("size(words) > 0 and p is not null").distinct()
    p = p.withColumn("n", F.size("words")).withColumn("m", F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int"))
    p = p.withColumn("size", F.least(F.lit(SEED), 2 * F.col("m") - F.col("n")))
    core = p.select("p", "size", F.explode(_runs(F.col("words"), F.col("size"), F.col("n") - F.col("m"), F.col("m") - F.col("size"))).alias("r")).select("p", "size", "r.at", "r.gram")

    sizes = [r[0] for r in p.select("size").distinct().collect()]  # SEED rows at most
    cut = [_runs(F.col("hay"), F.lit(k), F.lit(0), F.size("hay") - k) for k in sorted(sizes)]
    runs = t.where("t is not null").select("t", F.explode(F.concat(*cut) if cut else F.array().cast("array<struct<at:int,gram:bigint>>")).alias("r")).select("t", "r.at", "r.gram")
    places = settled(runs.join(core.select("gram").distinct(), "gram", "left_semi"))

    often = core.join(places.groupBy("gram").agg(F.count("*").alias("often")), "gram", "left").fillna(0, "often")
    seed = often.groupBy("p").agg(F.min(F.struct("often", F.col("at").alias("seed"), "gram")).alias("s")).select("p", "s.seed", "s.gram")
    found = places.join(seed.join(p, "p"), "gram").select("t", "p", "words", "n", "m", "seed", (F.col("at") - F.col("seed")).alias("start"))

    same = F.transform("words", lambda w, k: F.coalesce(F.get("hay", F.col("start") + k) == w, F.lit(False)))
    both = found.join(t, "t").select("t", "p", "n", "m", "seed", "start", same.alias("same"))
    after = F.array_position(F.expr("slice(same, seed + 1, n)"), F.lit(False)).cast("int")
    before = F.array_position(F.reverse(F.expr("slice(same, 1, seed)")), F.lit(False)).cast("int")
    both = both.withColumn("end", F.when(after == 0, F.col("n")).otherwise(F.col("seed") + after - 1))
    both = both.withColumn("first", F.when(before == 0, 0).otherwise(F.col("seed") - before + 1))
    both = both.where("end - first >= m").groupBy("p", "t", "n").agg(F.min(F.struct((F.col("first") - F.col("end")).alias("less"), "first", (F.col("start") + F.col("first")).alias("at"))).alias("b"))
    say = lambda c, name: c.cast("bigint").alias(name)
    return both.select(F.col("p").alias(phrase_id), F.col("t").alias(text_id), say(F.col("n"), "n_words"), say(-F.col("b.less"), "n_matched"), say(F.col("b.first"), "from_word"), say(F.col("b.at"), "at_word"))
