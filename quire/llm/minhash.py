"""Near-duplicate grouping by circulant MinHash, banding and exact Jaccard verification.

A shingle's hash has a place in a universe of D = 2**UNIVERSE_BITS. sigma and pi are two random permutations of the
universe. Coordinate k of a signature is the least pi[(sigma[place] + k) mod D] over the document's shingles: sigma breaks
up what structure the places have, pi, shifted circularly, gives every coordinate, and a shingle's K values are one slice
of pi.

Bands propose links, exact sets confirm them. Documents with equal sets are one node. Every node is compared with
its buckets' hubs, the nodes that share most buckets; nodes of buckets that then still hold several components are
compared in full, in blocks of bounded size. So only links that no band proposes can be missed: with 32 bands of 5 rows a pair at Jaccard 0.8 shares none with probability 3e-6, at 0.85 with 7e-9.

Nulls, empty texts: no shingles, linked with nothing. A null doc_id: never linked, kept. Rows repeated under one
doc_id: one document, linked by any of its texts; all of them stay or go. Ties: the least doc_id stays. Fewer words than
the shingle size: the whole sequence is one shingle. Long texts: sets are built BLOCK shingles at a time from whole texts.
An empty table gives no rows. Other columns of docs are never read by near_duplicates; drop_near_duplicates keeps them, and
its own column's name starts with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import grouped_arrow, map_arrow, small_batches, written
from quire.llm.components import components
from quire.llm.words import mix, text_rows, shingle_hashes

UNIVERSE_BITS = 22
SEED = 20240229
BANDS, ROWS = 32, 5
#: Bounds of a block of sets: nodes, and shingles of all.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles of a slice of the incidence matrix.
COLUMNS = 2048
#: Shingles whose slices of pi are held at a time.
BLOCK = 4096

#: Members of a hub after which its set goes to several tasks, and over how many a hot key's rows are spread.
HEAVY, SPREAD = 1000, 64

_pi: dict[int, np.ndarray] = {}


def permutation(k: int) -> np.ndarray:
    """pi, with its first k places again at its end; for 0, sigma."""
    if k not in _pi:
        p = np.random.Generator(np.random.PCG64(SEED + (k == 0))).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _pi[k] = np.concatenate([p, p[:k]])
    return _pi[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """K coordinates of a set of shingle hashes, which is not empty."""
    rows = np.lib.stride_tricks.sliding_window_view(permutation(k), k)
    places = permutation(0).take((mix(shingles) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64))
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), BLOCK):
        np.minimum(out, rows[places[i : i + BLOCK]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in sig.reshape(bands, rows).T:
        h = mix(h ^ column.astype(np.uint64))
    return h.view(np.int64)


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys: list = [None] * n
            for row, words in text_rows(batch.column(1)):
                s = np.unique(shingle_hashes(words, size))
                count[row] = len(s)
                if len(s):
                    h1[row] = int(s.sum(dtype=np.uint64).view(np.int64))
                    h2[row] = int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F))).view(np.int64))
                    keys[row] = band_keys(signature(s, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(count), pa.array(h1), pa.array(h2), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "h1", "h2", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(w, size)).view(np.int64) for _, w in text_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _spread_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with few keyed rows, a hot key's rows over SPREAD tasks by what `by` hashes to."""
    salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union, on whole sets; the set of a b of many goes to several tasks."""
    pairs = written(pairs, "minhash-pairs")
    heavy = pairs.groupBy("b").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("parts")).where("parts > 1")
    dealt = _spread_join(pairs, heavy, "b", "a", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.join(heavy.withColumnRenamed("b", "node"), "node", "left").select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = F.size(F.array_intersect("x", "y"))
    near = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent
    return dealt.join(left, "a").join(right, ["b", "part"]).where(near).where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...)."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    sig = written(map_arrow(plain, _signatures(size, bands, rows), "id bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>"), "minhash-signatures")
    classes = written(sig.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("node")), "minhash-classes")
    # One row of each class speaks for it.
    nodes = sig.where("n > 0").join(classes.withColumnRenamed("node", "id"), ["id", "n", "h1", "h2"], "left_semi").dropDuplicates(["id", "n", "h1", "h2"])
    banded = nodes.select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(banded.join(shared, "key"), "minhash-buckets")
    mass = buckets.groupBy("node").agg(F.sum("size").alias("mass"))
    hubs = buckets.join(mass, "node").groupBy("key").agg(F.max_by("node", F.struct("mass", -F.col("node"))).alias("hub"))
    members = buckets.join(hubs, "key").select("key", "node", "hub")
    held = buckets.count()
    links = None
    if held:
        wanted = members.select(F.col("node").alias("id")).distinct()
        texts = plain.where("id is not null").join(wanted, "id", "left_semi").dropDuplicates(["id", "text"])
        sets = written(map_arrow(texts, _sets(size), "node bigint, shingles array<bigint>"), "minhash-sets")
        links = _links(members, sets, percent, held)
    out = sig.join(classes, ["n", "h1", "h2"], "left")
    # A doc_id with several texts joins what each of them belongs to.
    several = written(sig.where("id is not null").groupBy("id").agg(F.min(F.struct("n", "h1", "h2")).alias("lo"), F.max(F.struct("n", "h1", "h2")).alias("hi")).where("lo != hi").select("id"), "minhash-several")
    mixed = not several.isEmpty()
    if mixed:
        own = out.join(several, "id").where("node is not null").select("id", "node").distinct()
        tied = own.join(own.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b").where("a != b")
        links = tied if links is None else links.union(tied)
        held = held + own.count()
    if links is not None:
        out = out.join(components(links, "minhash-components", held), "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("bigint"))
    component = F.coalesce("component", "node", "id")
    if mixed:
        whole = out.join(several, "id").groupBy("id").agg(F.min(component).alias("all_of_it"))
        out, component = out.join(whole, "id", "left"), F.coalesce("all_of_it", "component", "node", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.when(F.col("id").isNotNull(), F.col("id") == component).otherwise(F.lit(True)).alias("kept"))


def _open_clusters(members: DataFrame, links: DataFrame, held: int) -> DataFrame | None:
    """(node, cluster, c): nodes whose buckets still hold several components, clustered by shared buckets; None if there are none."""
    placed = members.join(components(links, "minhash-components", held), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("node").alias("least")).where("c0 != c1").select("key", "least")
    left = written(placed.join(open_keys, "key"), "minhash-open", held)
    if left.isEmpty():
        return None
    chains = components(left.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "minhash-clusters", held)
    return written(left.groupBy("node").agg(F.min("c").alias("c")).join(chains.select("node", F.col("component").alias("cluster")), "node"), "minhash-clusters", held)


def _links(members: DataFrame, sets: DataFrame, percent: int, held: int) -> DataFrame:
    """Confirmed links enough to join all nodes that links between nodes of one bucket join.

    First every node meets its buckets' hubs: of a tight group that joins all, at a cost in proportion to its size. Nodes
    whose buckets are then not yet of one component meet in blocks of bounded size, every two blocks of a cluster once.
    """
    pairs = members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(_confirmed(pairs, sets, percent), "minhash-links")
    left = _open_clusters(members, links, held)
    if left is None:
        return links
    sizes = left.join(sets.select("node", F.size("shingles").alias("n")), "node")
    blocks = sizes.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"))
    dealt = _spread_join(left, blocks, "cluster", "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "shingles")
    small_batches(sets.sparkSession)
    more = dealt.groupBy("cluster", "i", "j").applyInArrow(grouped_arrow(_block_links(percent)), "a bigint, b bigint")
    return written(links.union(more), "minhash-links")


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        nodes, comps, own = (table.column(c).to_numpy() for c in ("node", "c", "own"))
        column = table.column("shingles").chunk(0)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        sizes = np.diff(offsets)
        values = values[offsets[0] : offsets[-1]]
        found = links_within(sizes, values, comps, own if i != j else None, percent)
        return pa.table({"a": pa.array([int(nodes[x]) for x, _ in found], pa.int64()), "b": pa.array([int(nodes[y]) for _, y in found], pa.int64())})

    return run


def links_within(sizes: np.ndarray, values: np.ndarray, comps: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links (x, y) that join all sets which links between sets of different components join.

    Set x is the next sizes[x] of values. sides: only pairs of different sides count. Intersections of all pairs come
    from products of slices of the incidence matrix, COLUMNS shingles at a time.
    """
    m = len(sizes)
    _, place, held = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = held[place] > 1
    row, place = row[shared], place[shared]
    places = np.flatnonzero(held > 1)
    renumber = np.zeros(len(held), np.int64)
    renumber[places] = np.arange(len(places))
    place = renumber[place]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((m, m), np.float32)
    for at in range(0, len(places), COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[row[lo:hi], place[lo:hi] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    hit = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    hit &= comps[:, None] != comps[None, :]
    if sides is not None:
        hit &= sides[:, None] != sides[None, :]
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    out = []
    for x in range(m):
        for y in np.flatnonzero(hit[x, :x]):
            a, b = top(int(comps[x])), top(int(comps[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, int(y)))
    return out


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group left, that of the least doc_id; its own columns."""
    gone = near_duplicates(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["__gone"], "left_anti")
