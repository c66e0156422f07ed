"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the K least distinct hashes of a text's shingles (SHINGLE words, A-Z lower-cased, words parted by space and
0x09-0x0D; of fewer words, the whole sequence; of none, no shingle). Sketches of parts merge into that of the whole.
From two sketches follow estimates of resemblance, containment and distinct shingle count; exact while sets are smaller
than K. Equal texts have equal fingerprints; two empty sketches resemble each other with 1, an empty and another with 0.

Whole texts are shuffled once, with their sketches; what a text lends its neighbour is shuffled besides.

Nulls: a null text is empty; a null doc_id stays in the result, after all others, its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 64
SHINGLE = 5
#: Ranges of doc_id within which neighbours are found; a bound on what is broadcast, not on the rows of a range.
RANGES = 256


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k least distinct hashes of the text's shingles, ascending, as array<bigint>."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    # A struct keeps the words' hashes as one value, computed once.
    return F.transform(F.array(words), lambda w: _least(w, k, size))[0]


def _least(w: Column, k: int, size: int) -> Column:
    n = F.size(w)
    short = F.array(F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(size)]))
    every = F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, short).otherwise(runs)
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets."""
    both = F.array_intersect(a, b)
    joined = merge(a, b, k)
    return F.when(F.size(joined) == 0, 1.0).otherwise(F.size(F.array_intersect(joined, both)) / F.size(joined)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th least hash as a share of the range."""
    share = (F.element_at(a, -1).cast("double") + 9.223372036854775808e18) / 1.8446744073709551616e19
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that b's holds, from the resemblance and the two counts."""
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, next_id, prev_id, prev_chars) over ids(id, n_chars): next is the next smaller id, of the least the largest.

    Ids are distinct. Ranges of about equal size come from approximate quantiles; windows run within a range, and one
    row of each range (at most RANGES) tells its neighbours across the border.
    """
    bounds = ids.agg(F.percentile_approx("id", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    cuts = sorted(set(bounds or []))
    place = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    from pyspark.sql import Window

    inner = Window.partitionBy("range").orderBy(F.col("id").desc())
    whole = Window.orderBy(F.col("top").desc())
    ranged = ids.withColumn("range", place)
    ends = ranged.groupBy("range").agg(F.max("id").alias("top"), F.min("id").alias("low"), F.min_by("n_chars", "id").alias("low_chars"))
    # At most RANGES rows from here on.
    ends = ends.select("range", F.coalesce(F.lead("top").over(whole), F.first("top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"), F.struct(F.coalesce(F.lag("low").over(whole), F.last("low").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("id"), F.coalesce(F.lag("low_chars").over(whole), F.last("low_chars").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("n_chars")).alias("before"))
    near = ranged.select("id", "range", F.lead("id").over(inner).alias("next"), F.lag(F.struct("id", "n_chars")).over(inner).alias("prev")).join(F.broadcast(ends), "range")
    prev = F.coalesce("prev", "before")
    return near.select("id", F.coalesce("next", "after").alias("next_id"), prev["id"].alias("prev_id"), prev["n_chars"].alias("prev_chars"))


def fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """For every row of docs(doc_id, text, ...): its fingerprint and that of its edited text, and what they resemble.

    The edited text has the last third of the code points (rounded down) replaced by the first as many of the next
    document's in descending doc_id order. Rows repeated under one doc_id: each is edited with, and compared with, the
    least text of the next doc_id.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = plain.withColumn("n_chars", F.length("text").cast("bigint"))
    ids = marked.where("id is not null").groupBy("id").agg(F.max("n_chars").alias("n_chars"))
    order = neighbours(ids)
    # Both sides below read the same rows dealt by id, so whole texts are shuffled once. A left join and a coalesced key
    # keep either side from filtering nulls before the exchange, which would make two exchanges of it.
    held = plain.withColumn("own", sketch(F.col("text"), k, size))
    lend = held.join(order.select("id", F.col("prev_id").alias("to"), (F.col("prev_chars") / 3).cast("bigint").alias("take")), "id", "left")
    lend = lend.select(F.coalesce("to", "id").alias("to"), F.expr("substring(text, 1, cast(coalesce(take, 0) as int))").alias("head"), F.col("own").alias("next_own"))
    lend = lend.groupBy("to").agg(F.min(F.struct("head", "next_own")).alias("got")).select("to", "got.*")
    both = held.join(lend, held["id"] == lend["to"], "left").select("id", "text", "own", F.coalesce("head", F.col("text")).alias("head"), F.coalesce("next_own", F.col("own")).alias("next_own"))
    both = both.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("third", (F.col("n_chars") / 3).cast("int"))
    edited = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - third), substring(head, 1, third))")).drop("text", "head")
    done = edited.withColumn("other", sketch(F.col("edited"), k, size))
    return done.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"), distinct_count(F.col("own"), k).alias("distinct_shingles"), containment(F.col("own"), F.col("other"), k).alias("contained_in_edited"))
