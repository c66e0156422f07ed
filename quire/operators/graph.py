"""Sections as a tree and references as edges: ancestors, as-of and nearest look-ups, continuation, adjacency, search."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import snippet

PAGES_PER_CHUNK, HITS = 25, 200


def ancestors(nodes: DataFrame, node: str = "section_id", parent: str = "parent", by: str = "doc_id") -> DataFrame:
    """(by, node, ancestor, distance) of a forest, each node its own ancestor at distance 0.

    First the leaps double: where one step leads, where two, four and so on, each a join of nodes with nodes, checkpointed.
    A tree of depth d takes log2(d) rounds. In each, nodes nearer to the top than the leap drop out; a round that loses none
    has met a circle, which is refused before any path is made. Then the paths double: those of less than 2**i steps and the
    leaps of 2**i give those of 2**i to 2**(i + 1) - 1, checkpointed on their own, so that a plan is no longer than its round.

    Parents that are no nodes, or null, end a path. Rows repeated whole count once; a node with several parents has the paths
    by each of them. Nodes whose `by` is null have only themselves.
    """
    tree = settled(nodes.select(F.col(by).alias("k"), F.col(node).alias("node"), F.col(parent).alias("up")).distinct())
    names = tree.select("k", "node").distinct()
    step = tree.where("up is not null").join(names.select("k", F.col("node").alias("up")), ["k", "up"], "left_semi").select("k", "node", "up")
    leaps, left = [], None
    while True:
        step = settled(step)
        still = step.select("k", "node").distinct().count()
        if not still:
            break
        if still == left:
            raise ValueError(f"{still} sections lie on or under a circle")
        leaps, left = [*leaps, step], still
        on = step.select("k", F.col("node").alias("up"), F.col("up").alias("next"))
        step = step.join(on, ["k", "up"]).select("k", "node", F.col("next").alias("up")).distinct()
    parts = [names.select("k", "node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))]
    for i, leap in enumerate(leaps):
        on = leap.select("k", F.col("node").alias("ancestor"), "up")
        further = [p.join(on, ["k", "ancestor"]).select("k", "node", F.col("up").alias("ancestor"), (F.col("distance") + 2**i).alias("distance")) for p in parts]
        parts.append(settled(reduce(DataFrame.unionByName, further).distinct()))
    paths = reduce(DataFrame.unionByName, parts)
    return paths.select(F.col("k").alias(by), F.col("node").alias(node), "ancestor", "distance")


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed into spark.checkpoint.dir; on one machine, where that is unset, into a folder of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that all of them share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="quire-steps-"))
    return df.checkpoint()


def shared_keys(keys: DataFrame) -> DataFrame:
    """(system, shares_with): of each system in (system, key), how many others hold a key of its own."""
    own = keys.select("system", "key").distinct()
    others = own.select("key", F.col("system").alias("other"))
    return own.join(others, "key").where("system != other").groupBy("system").agg(F.count_distinct("other").alias("shares_with"))


def first_on_page(blocks: DataFrame, page: str = "page", order: str = "ord", value: str = "block_id") -> DataFrame:
    """(page, value) of the first block of each page; of equal orders the least value."""
    return blocks.groupBy(page).agg(F.min_by(value, F.struct(order, value)).alias(value))


def first_in_section(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, block_id): where a link to a section leads."""
    return blocks.groupBy("doc_id", "section").agg(F.min_by("block_id", F.struct("ord", "block_id")).alias("block_id"))


def chunk_window(blocks: DataFrame, page: int, around: int = 1) -> DataFrame:
    """The blocks of a page's chunk and of the chunks next to it."""
    here = (max(page, 1) - 1) // PAGES_PER_CHUNK
    return blocks.where(chunk_of(F.col("page")).between(here - around, here + around))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, ties: str) -> DataFrame:
    """left with the right row whose `at` is the greatest not above its own; of equals that with the greatest `ties`.

    One union and one window over both sides, in place of a range join.
    """
    l = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__t", F.lit(None).cast(right.schema[ties].dataType))
    r = right.select(*by, at, F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(ties).alias("__t"))
    w = Window.partitionBy(*by).orderBy(at, "__side", "__t").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__side", "__v", "__t")


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the right row whose `at` is nearest; of two as near the one below, of equals the least value."""
    l = left.withColumn("__side", F.lit(1))
    r = right.select(*by, at, F.lit(0).alias("__side"), F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("__r"))
    both = l.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).unionByName(r, allowMissingColumns=True)
    low = Window.partitionBy(*by).orderBy(F.col(at), F.col("__side"), F.col("__r.value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    high = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col("__side"), F.col("__r.value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__lo", F.last("__r", ignorenulls=True).over(low)).withColumn("__hi", F.last("__r", ignorenulls=True).over(high)).where("__side = 1")
    closer = F.when(F.col("__lo").isNull() | (F.col("__hi.at") - F.col(at) < F.col(at) - F.col("__lo.at")), F.col("__hi")).otherwise(F.col("__lo"))
    return both.withColumn(value, closer["value"]).withColumn("distance", F.abs(closer["at"] - F.col(at))).drop("__side", "__r", "__lo", "__hi")


def continuation(blocks: DataFrame, prose: list[str] | None = None) -> DataFrame:
    """(doc_id, block_id, dest_text): each block with those that follow it in its section until a heading, an entry, a keyed
    block or no prose; heads other than entries and paragraphs stand alone.

    blocks: (doc_id, block_id, ord, section, type, key, text). prose: the types that continue, paragraphs by default.
    """
    prose = prose or ["paragraph"]
    w = Window.partitionBy("doc_id", "section").orderBy("ord")
    goes_on = F.col("type").isin(prose) & F.col("key").isNull()
    # A block that continues belongs to the run that the last block which does not has opened, or the section's first.
    run = blocks.withColumn("__on", goes_on).withColumn("__gap", F.col("ord") - F.lag("ord").over(w))
    run = run.withColumn("__new", (~F.col("__on") | F.coalesce(F.col("__gap") > 1, F.lit(True))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    rest = Window.partitionBy("doc_id", "section", "__run").orderBy("ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.array_join(F.collect_list("text").over(rest), "\n\n")
    return run.select("doc_id", "block_id", F.when(F.col("type").isin("entry", "paragraph"), whole).otherwise(F.col("text")).alias("dest_text"))


def search(blocks: DataFrame, query: str, limit: int = HITS) -> DataFrame:
    """(doc_id, block_id, snippet): first hit of each block, in reading order, at most `limit`; none for queries under two letters."""
    q = query.strip().lower()
    at = F.instr(F.lower("text"), q) - 1
    hits = blocks.withColumn("__at", at).where(F.col("__at") >= 0) if len(q) >= 2 else blocks.withColumn("__at", at).limit(0)
    return hits.orderBy("doc_id", "ord").limit(limit).select("doc_id", "block_id", snippet(F.col("text"), F.col("__at"), len(q)).alias("snippet"))


def chunk_of(page: Column) -> Column:
    """The 25-page chunk of a page; pages below 1 are in the first."""
    return F.floor((F.greatest(page, F.lit(1)) - 1) / PAGES_PER_CHUNK)


def adjacency(edges: DataFrame) -> DataFrame:
    """(doc_id, block_id, outgoing, incoming): ids of the edges of each block, each list in order of the ids."""
    out = edges.groupBy("doc_id", F.col("from").alias("block_id")).agg(F.sort_array(F.collect_list("ref_id")).alias("outgoing"))
    inc = edges.where(F.col("to").isNotNull()).groupBy("doc_id", F.col("to").alias("block_id")).agg(F.sort_array(F.collect_list("ref_id")).alias("incoming"))
    empty = F.array().cast("array<string>")
    return out.join(inc, ["doc_id", "block_id"], "full_outer").select("doc_id", "block_id", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))


def merge_updates(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents with progress updates folded in: the latest word for each column, summaries merged key by key.

    table and updates: (id, status, progress, error, summary map<string,string>, updated_at). Progress is held in 0..99.
    """
    bounded = updates.withColumn("progress", F.when(F.col("progress").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(99), F.col("progress")))))
    rows = table.unionByName(bounded)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c)
    pairs = rows.select("id", "updated_at", F.explode(F.coalesce("summary", F.create_map().cast("map<string,string>")))).groupBy("id", "key").agg(F.max_by("value", "updated_at").alias("value"))
    summary = pairs.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("summary"))
    return rows.groupBy("id").agg(last("status"), last("progress"), last("error"), F.max("updated_at").alias("updated_at")).join(summary, "id", "left")
