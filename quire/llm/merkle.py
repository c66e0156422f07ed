"""A Merkle manifest of a table by Pregel-style supersteps over RDDs: digests climb to the root, sibling paths come down.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value. Leaves of a
group ascend by key (nulls first, of equal keys by digest); every `FANOUT` consecutive nodes become the hash of their
digests as hex text until one is left, the group's subroot; subroots, by group (null first, bytewise), become the root.

One range sort puts leaves in order. What the driver learns of it is the first and last group of each partition and their
counts, from which every leaf has its rank. A vertex is (group's rank, level, index), or (CROWN, level, index) above the
subroots. Superstep up: children message their parent; a parent with all its children (eight, or up to the one marked as
the last) hashes them and messages upward, and one that lacks some waits. Superstep down: a parent sends each child the
path it had itself, with the child's siblings put before it. No vertex has more than eight children, so that no group is
hot. Messages of each superstep up are checkpointed in spark.checkpoint.dir; steps down can be run again from them.

Nulls: a null group is a group, a null key comes first. Rows repeated whole have equal leaves, each with its own place.
Empty and very long texts are hashed whole, in the JVM; only digests travel. An empty table gives no rows. Columns that are
not named are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import shared_dir, written

FANOUT, CROWN = 8, -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOFS = "key bigint, leaf binary, carried binary, subroot binary, root binary, proof array<struct<before:binary,after:binary>>"


def leaf_digest(fields: list[Column]) -> Column:
    """The hash of a row's fields, told apart by their lengths."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a proof, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(_hex(step["before"]), _hex(step["after"]))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to: each step hashes it between its siblings."""
    return F.aggregate(proof, _hex(leaf), lambda at, step: F.sha2(F.concat(_hex(step["before"]), at, _hex(step["after"])), 256))


def _h(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _ends(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of one sorted partition: first group and its rows, last group and its rows, number of groups."""
    first = last = None
    n_first = n_last = groups = 0
    for group, *_ in rows:
        if groups and group == last:
            n_last += 1
        else:
            groups, last, n_last = groups + 1, group, 1
        if groups == 1:
            first, n_first = group, n_last
    if groups:
        yield first, n_first, last, n_last, groups


def _starts(ends: dict[int, tuple]) -> tuple[dict[int, tuple[int, int, bool]], int]:
    """For each partition the rank of its first group, how many leaves of it lie before, whether its last group goes on; and the number of groups."""
    out, rank, carry, before = {}, -1, 0, None
    for part in sorted(ends):
        first, _, last, n_last, groups = ends[part]
        goes_on = before is not None and ends[before][2] == first
        if before is not None:
            out[before] = (*out[before][:2], goes_on)
        start = carry if goes_on else 0
        at = rank if goes_on else rank + 1
        out[part] = (at, start, False)
        rank, carry, before = at + groups - 1, n_last + (start if groups == 1 else 0), part
    return out, rank + 1


def _placed(part: int, rows: Iterator[tuple], starts: dict[int, tuple[int, int, bool]]) -> Iterator[tuple]:
    """(home, (place in its run, last?, key, leaf, carried)) of each row; home is the vertex whose path the leaf needs: its
    parent, or where it is its group's only leaf, its place among the subroots."""
    if part not in starts:
        return
    rank, index, goes_on = starts[part]
    held = None

    def place(row: tuple, last: bool) -> tuple:
        _, key, leaf, carried = row
        home = (CROWN, 0, rank) if last and index == 0 else (rank, 1, index // FANOUT)
        return home, (index % FANOUT, last, key, leaf, carried)

    for row in rows:
        if held is not None:
            new = row[0] != held[0]
            yield place(held, new)
            rank, index = (rank + 1, 0) if new else (rank, index + 1)
        held = row
    yield place(held, not goes_on)


def _sent(vertex: tuple, digest: bytes, last: bool, groups: int) -> tuple:
    """What a finished vertex sends: ("send", parent, message), or ("root", ...) where none is above it."""
    tree, level, i = vertex
    if tree != CROWN and i == 0 and last:
        tree, level, i, last = CROWN, 0, tree, tree == groups - 1
    if tree == CROWN and i == 0 and last:
        return "root", (CROWN, level, 0), digest
    return "send", (tree, level + 1, i // FANOUT), (i % FANOUT, last, digest)


def _own(vertex: tuple, last: bool) -> tuple:
    """Where a vertex's path arrives: a group's root has it as a subroot."""
    return (CROWN, 0, vertex[0]) if vertex[0] != CROWN and vertex[2] == 0 and last else vertex


def _first_step(groups: int):
    def run(item: tuple) -> Iterator[tuple]:
        home, leaves = item
        run = sorted(leaves)
        last = run[-1][1]
        if home[0] == CROWN:
            yield _sent(home, run[0][3], home[2] == groups - 1, groups)
            return
        digest = _h(leaf for _, _, _, leaf, _ in run)
        if _own(home, last) != home:
            yield "link", _own(home, last), (home, digest)
        yield _sent(home, digest, last, groups)

    return run


def _step(groups: int):
    def run(item: tuple) -> Iterator[tuple]:
        vertex, inbox = item
        inbox = sorted(inbox)
        place, last, _ = inbox[-1]
        if len(inbox) < FANOUT and not (last and len(inbox) == place + 1):
            for message in inbox:  # wait for the others
                yield "send", vertex, message
            return
        digests = [d for _, _, d in inbox]
        digest = _h(digests)
        subroot = digest if vertex[0] != CROWN and vertex[2] == 0 and last else None
        yield "family", _own(vertex, last), ((vertex[0], vertex[1] - 1, vertex[2] * FANOUT), digests, subroot)
        yield _sent(vertex, digest, last, groups)

    return run


def _steps(run: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    whole = b"".join(run)
    for k in range(len(run)):
        yield whole[: 32 * k], whole[32 * (k + 1) :]


def _down(item: tuple) -> Iterator[tuple]:
    """Paths on their way: to the children of the vertex, or on to the step that finds them."""
    vertex, met = item
    families = path = None
    for kind, what in met:
        if kind == "path":
            path = what
        else:
            families = (kind, what)
    proof, subroot = path
    if families is None:
        yield vertex, ("path", path)
    elif families[0] == "link":
        home, digest = families[1]
        yield home, ("path", (proof, digest))
    else:
        (tree, level, first), digests, own = families[1]
        for k, step in enumerate(_steps(digests)):
            yield (tree, level, first + k), ("path", ([step, *proof], own or subroot))


def _rows(root: bytes):
    def run(item: tuple) -> Iterator[tuple]:
        home, met = item
        leaves, path = [], None
        for kind, what in met:
            if kind == "path":
                path = what
            else:
                leaves.append(what)
        if path is None:
            return
        leaves.sort()
        proof, subroot = path
        steps = [None] if home[0] == CROWN else list(_steps([leaf for _, _, _, leaf, _ in leaves]))
        for (_, _, key, leaf, carried), step in zip(leaves, steps, strict=True):
            yield key, leaf, carried, subroot or leaf, root, ([step] if step else []) + proof

    return run


def inclusion_proofs(leaves: DataFrame) -> DataFrame:
    """(key, leaf, carried, subroot, root, proof) of every leaf of (group string, key bigint, leaf binary, carried binary).

    proof: an element for each level from the leaf to the root, with the digests of its siblings that stand before and after.
    """
    spark = leaves.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("key"), F.asc("leaf")]
    # Rows are hashed once: the range sort samples its input before it deals it out.
    leaves = written(leaves.select("group", "key", "leaf", "carried"), "merkle-leaves")
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ordered.rdd.map(lambda r: (r[0], r[1], bytes(r[2]), None if r[3] is None else bytes(r[3])))
    rows.checkpoint()
    ends = dict(rows.mapPartitionsWithIndex(lambda part, it: [(part, e) for e in _ends(it)]).collect())
    if not ends:
        return spark.createDataFrame([], PROOFS)
    starts, groups = _starts(ends)
    parts = rows.getNumPartitions()
    homes = rows.mapPartitionsWithIndex(lambda part, it: _placed(part, it, starts)).partitionBy(parts)

    step = homes.groupByKey(parts).flatMap(_first_step(groups))
    found = []
    while True:
        step.checkpoint()
        kinds = step.map(lambda s: s[0]).countByValue()
        if kinds["link"] or kinds["family"]:
            found.append((step.filter(lambda s: s[0] in ("link", "family")).map(lambda s: (s[1], (s[0], s[2]))), parts))
        if not kinds["send"]:
            break
        parts = max(1, parts // FANOUT)
        step = step.filter(lambda s: s[0] == "send").map(lambda s: (s[1], s[2])).groupByKey(parts).flatMap(_step(groups))
    ((_, top, root),) = step.filter(lambda s: s[0] == "root").collect()

    paths = context.parallelize([(top, ("path", ([], None)))], 1)
    for families, width in reversed(found):
        paths = families.union(paths).groupByKey(width).flatMap(_down)
    met = homes.mapValues(lambda leaf: ("leaf", leaf)).union(paths.partitionBy(homes.getNumPartitions())).groupByKey(homes.getNumPartitions())
    return spark.createDataFrame(met.flatMap(_rows(root)), StructType.fromDDL(PROOFS), verifySchema=False)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, grouped by lang.

    Where 3 divides the crc32 of its doc_id a document is tampered with: the A-Z of its text are lower-cased before its leaf is
    hashed again. folded_root follows that leaf, or else the original, up its own proof; verified says whether it is the root.
    """
    fields = [F.col(c) for c in FIELDS]
    fold = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest([*fields[:-1], fold]))
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("bigint").alias("key"), leaf_digest(fields).alias("leaf"), tampered.alias("carried"))
    out = inclusion_proofs(leaves).withColumn("end", folded(F.coalesce("carried", "leaf"), F.col("proof")))
    return out.select(
        F.col("key").alias("doc_id"), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), F.col("end").alias("folded_root"), (F.col("end") == _hex(F.col("root"))).alias("verified"),
    )
