"""Conversation structure repair by a min-plus scan: turns are 4x4 matrices over (cost, audit), combined as a tree.

The states are what a repaired conversation may have said last: nothing, system, user, assistant; it ends with nothing or an
assistant. A turn's matrix says for each pair of states the cheapest way from one to the other over this turn, as a cost and
an audit, the initials of the edits: Keep (0), Rerole (2), Delete (3), each with Inserts (2) before and after it as need be
(the insert closure). A kept or reroled turn that is truncated costs 1 more; blank and duplicate turns can only be deleted.
The product of two matrices takes the least sum over the state between them, of equal costs the ASCII-least audit. Ways of
equal cost over the same turns never are beginnings of one another (a longer one has more inserts), so that the order of
audits survives what is put after them and the product is associative. An audit says all: from its first state on, each
edit leads to one state only, so the repaired roles follow from it.

Turns lie in one range sort by conversation, turn (nulls first), role and digest, without their texts. Runs of `BLOCK` turns
become words of one letter a turn, words become matrices, and rounds of `WIDTH` neighbours a conversation's matrix; a long
conversation spreads over as many tasks as it has blocks. The audit is cut into the blocks' pieces, these give the repaired
lines, and kept lines fetch their texts by content. Lines are put together in blocks; only the digest of a conversation
of several blocks reads these one after another, in one task, as its definition asks, holding one batch at a time.

Nulls: a null role or text is one space; a null turn comes first and is in no gap; null conv_ids are one conversation. Turns
of equal number and role stand in order of their digests. Rows repeated whole are duplicates. Empty texts are blank;
very long ones are hashed in the JVM and travel twice. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.common import map_arrow, written

#: Turns of a block, neighbours that meet in a round of the tree, and letters of a word whose matrix a worker remembers.
BLOCK, WIDTH, SHORT = 256, 32, 8
#: States: nothing said, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: From each state the state that a further user or assistant turn leads to.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: A turn's letter: its role's initial (x for any other), upper case where it is truncated, a digit where it must go.
ROLES, GOES = "suax", "1234"

Matrix = tuple  # of 16 cells, from state * 4 + to state; (cost, audit) or None


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of conversations with faults put in, by crc32 of `conv_id:turn` modulo 20."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    cut = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).cast("int")
    text = F.when(F.col("cut") == 1, "").when(F.col("cut") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"), cut.alias("cut"))
        .where("cut != 0")
        .select("conv", "turn", F.when(F.col("cut") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("cut") == 3, 2).otherwise(1).alias("copies"))
    )


def _content(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _place(conv: Column, turn: Column, content: Column) -> Column:
    """What rows that are equal in all columns share, and no others."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit("-")), F.coalesce(turn.cast("string"), F.lit("-")), F.hex(content)), 256))


@lru_cache(maxsize=1)
def _closure() -> Matrix:
    cells: list = [None] * 16
    for i in range(4):
        state, audit = i, ""
        while cells[4 * i + state] is None:
            cells[4 * i + state] = (INSERT * len(audit), audit)
            state, audit = NEXT[state], audit + "I"
    return tuple(cells)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: over the state between, the least cost, then the least audit."""
    out: list = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            ways = [(a[i + k][0] + b[4 * k + j][0], k) for k in range(4) if a[i + k] and b[4 * k + j]]
            if not ways:
                out.append(None)
                continue
            least = min(ways)[0]
            out.append((least, min(a[i + k][1] + b[4 * k + j][1] for cost, k in ways if cost == least)))
    return tuple(out)


def turn_matrix(letter: str) -> Matrix:
    """One turn with the inserts around it."""
    cells: list = [None] * 16
    more = CUT_SHORT if letter.isupper() else 0
    for i in range(4):
        cells[5 * i] = (DELETE, "D")
        if letter in GOES:
            continue
        said = ROLES.index(letter.lower()) + 1
        cells[4 * i + NEXT[i]] = (REROLE + more, "R")
        if said == NEXT[i] or (said == SYSTEM and i == NOTHING):
            cells[4 * i + said] = (more, "K")
    return times(times(_closure(), tuple(cells)), _closure())


@lru_cache(maxsize=100_000)
def _remembered(word: str) -> Matrix:
    return _tree(word)


def _tree(word: str) -> Matrix:
    if len(word) == 1:
        return turn_matrix(word)
    half = len(word) // 2
    return times(word_matrix(word[:half]), word_matrix(word[half:]))


def word_matrix(word: str) -> Matrix:
    """The product of a word's turns, by halves."""
    return _remembered(word) if len(word) <= SHORT else _tree(word)


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def initials_of(word: str) -> str:
    return "".join(ROLES[GOES.index(c)] if c in GOES else c.lower() for c in word)


ELEMENT = "conv bigint, block bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, ends string, cost array<bigint>, audit array<string>"
PIECE = "lo bigint, piece string, before bigint, total bigint"
LINE = "conv bigint, line bigint, role string, place binary, total bigint"
DIGEST = "conv bigint, repaired_sha256 string"


def _cells(matrix: Matrix) -> dict:
    return {"cost": [c and c[0] for c in matrix], "audit": [c and c[1] for c in matrix]}


def _elements(schema: pa.Schema):
    """Words to matrices, with what else of a block is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                word = row.pop("word")
                said = initials_of(word)
                out.append({**row, "turns": len(word), "illegal": _illegal(said), "ends": said[0] + said[-1], **_cells(word_matrix(word))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _product(run: list[Matrix]) -> Matrix:
    half = len(run) // 2
    return run[0] if len(run) == 1 else times(_product(run[:half]), _product(run[half:]))


def _joined(schema: pa.Schema):
    """Neighbouring elements of a conversation to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                near = sorted(row["run"], key=lambda e: e["block"])
                matrix = _product([tuple(None if c is None else (c, a) for c, a in zip(e["cost"], e["audit"], strict=True)) for e in near])
                summed = {k: sum(e[k] for e in near) for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
                summed["illegal"] += sum(_illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(near, near[1:], strict=False))
                out.append({"conv": row["conv"], "block": row["block"], **summed, "ends": near[0]["ends"][0] + near[-1]["ends"][1], **_cells(matrix)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def reduced(elements: DataFrame) -> DataFrame:
    """One element for each conversation, by rounds of WIDTH neighbouring blocks; each round is written."""
    step = _joined(to_arrow_schema(StructType.fromDDL(ELEMENT)))
    while not elements.groupBy("conv").count().where("count > 1").isEmpty():
        near = F.collect_list(F.struct(*[c for c in elements.columns if c != "conv"])).alias("run")
        groups = elements.groupBy("conv", F.shiftright("block", WIDTH.bit_length() - 1).alias("block")).agg(near)
        elements = written(map_arrow(groups, step, ELEMENT), "conversation-round")
    return elements


def _pieces(schema: pa.Schema):
    """A conversation's audit cut at its blocks' ends; inserts go with the turn that follows, the last ones with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit, at, before = row["audit"], 0, 0
                total = len(audit) - audit.count("D")
                blocks = sorted(row["blocks"], key=lambda b: b["lo"])
                for k, block in enumerate(blocks):
                    end, left = at, block["turns"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    piece = audit[at : end if k + 1 < len(blocks) else None]
                    out.append({"lo": block["lo"], "piece": piece, "before": before, "total": total})
                    at, before = end, before + len(piece) - piece.count("D")
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _lines(schema: pa.Schema):
    """The repaired lines of a block; an inserted line has no place to take its text from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, line, turns = [], row["before"], iter(row["turns"])
                odd = row["total"] % 2  # a system turn comes before the pairs
                for edit in row["piece"]:
                    turn = None if edit == "I" else next(turns)
                    if edit == "D":
                        continue
                    role = turn["role"] if edit == "K" else ("user", "assistant")[(line - odd) % 2]
                    out.append({"conv": row["conv"], "line": line, "role": role, "place": turn and turn["place"], "total": row["total"]})
                    line += 1
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _digests(schema: pa.Schema):
    """The hash of each conversation whose blocks follow one another in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher = None, None
        for batch in batches:
            out = []
            for row_conv, text in zip(batch.column(0), batch.column(1), strict=True):
                if hasher is not None and row_conv.as_py() == conv:
                    hasher.update(b"\n")
                else:
                    if hasher is not None:
                        out.append({"conv": conv, "repaired_sha256": hasher.hexdigest()})
                    conv, hasher = row_conv.as_py(), hashlib.sha256()
                hasher.update(text.as_py().encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if hasher is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": hasher.hexdigest()}], schema=schema)

    return run


def _step(df: DataFrame, fn, ddl: str) -> DataFrame:
    return map_arrow(df, fn(to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def turn_blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, lo, word, blank, duplicate, truncated, turns) of turns (conv, turn, role, text, copies): each conversation in
    order, in blocks of BLOCK turns, a letter for each; blocks ascend with a conversation's turns. turns: (role, place) of each."""
    ending = F.rtrim("text", F.lit(SPACE))
    blank, cut_short = ending == "", ~F.right(ending, F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    content = _content(F.col("role"), F.col("text"))
    light = turns.select("conv", "turn", "role", content.alias("content"), blank.alias("blank"), (~blank & cut_short).alias("cut_short"), letter.alias("letter"), F.explode(F.sequence(F.lit(1), "copies")))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("content")]
    placed = light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = placed.select("conv", "role", "content", _place(F.col("conv"), F.col("turn"), F.col("content")).alias("place"), "blank", "cut_short", "letter", "at")
    placed = written(placed, "conversation-turns")
    # Partitions number their rows from 0; without the empty numbers between them, blocks are dense and the tree is low.
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    width = max(BLOCK - 1, placed.agg(F.max(within)).first()[0] or 0).bit_length()
    dense = F.shiftleft(F.shiftright("at", 33), width).bitwiseOR(within)
    first = placed.where("not blank").groupBy("conv", "content").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    seen = ~F.col("blank") & F.col("first").isNull()
    final = F.when(F.col("blank") | seen, F.translate("letter", ROLES, GOES)).when(F.col("cut_short"), F.upper("letter")).otherwise(F.col("letter"))
    count = lambda c: F.sum(c.cast("long"))
    items = F.sort_array(F.collect_list(F.struct("at", final.alias("letter"), "role", "place")))
    return (
        placed.join(first, "at", "left").groupBy("conv", F.shiftright(dense, BLOCK.bit_length() - 1).alias("block"))
        .agg(items.alias("items"), count(F.col("blank")).alias("blank"), count(seen).alias("duplicate"), count(F.col("cut_short") & ~seen).alias("truncated"))
        .select("conv", "block", F.col("items")[0]["at"].alias("lo"), F.array_join(F.transform("items", lambda x: x["letter"]), "").alias("word"), "blank", "duplicate", "truncated",
                F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["place"].alias("place"))).alias("turns"))
    )


def repairs(blocks: DataFrame) -> DataFrame:
    """(conv, turns, blank, duplicate, truncated, illegal, cost, audit): the cheapest repair of each conversation of blocks."""
    elements = reduced(written(_step(blocks.select("conv", "block", "blank", "duplicate", "truncated", "word"), _elements, ELEMENT), "conversation-blocks"))
    end = lambda state: F.struct(F.col("cost")[state].alias("cost"), F.col("audit")[state].alias("audit"))
    best = elements.select("conv", "turns", "blank", "duplicate", "truncated", "illegal", F.least(end(NOTHING), end(ASSISTANT)).alias("best"))
    return best.select("conv", "turns", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def repaired_lines(turns: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, line, role, text, total): the repaired conversations, line by line; total is the number of a conversation's lines."""
    sizes = blocks.select("conv", F.struct("lo", F.length("word").alias("turns")).alias("block"), F.lit(None).cast("string").alias("audit"))
    audits = found.select("conv", F.lit(None).cast("struct<lo:bigint,turns:int>").alias("block"), "audit")
    cut = _step(sizes.union(audits).groupBy("conv").agg(F.max("audit").alias("audit"), F.collect_list("block").alias("blocks")), _pieces, PIECE)
    lines = written(_step(blocks.select("conv", "lo", "turns").join(cut, "lo"), _lines, LINE), "conversation-lines")
    texts = turns.select(_place(F.col("conv"), F.col("turn"), _content(F.col("role"), F.col("text"))).alias("place"), "text").groupBy("place").agg(F.first("text").alias("text"))
    kept = lines.where("place is not null").join(texts, "place").select("conv", "line", "role", "text", "total")
    return kept.union(lines.where("place is null").select("conv", "line", "role", F.lit("").alias("text"), "total"))


def line_digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of lines, `role:text` with a newline between two."""
    said = F.sort_array(F.collect_list(F.struct("line", F.concat("role", F.lit(":"), "text").alias("said"))))
    blocks = lines.groupBy("conv", (F.col("total") > BLOCK).alias("long"), F.shiftright("line", BLOCK.bit_length() - 1).alias("block")).agg(F.array_join(F.transform(said, lambda x: x["said"]), "\n").alias("text"))
    short = blocks.where("not long").select("conv", F.sha2("text", 256).alias("repaired_sha256"))
    long = blocks.where("long").repartition("conv").sortWithinPartitions("conv", "block").select("conv", "text")
    return short.union(_step(long, _digests, DIGEST))


def structure(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations (conv_id, turn, role,
    text) after `damaged` has put faults in. A conversation that loses all turns has zeros and the hash of no text."""
    turns = damaged(rows)
    blocks = written(turn_blocks(turns), "conversation-words")
    found = written(repairs(blocks), "conversation-repairs")
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    parts = [rows.select(F.col("conv_id").cast("bigint").alias("conv")).distinct(), gaps, found.drop("turns"), line_digests(repaired_lines(turns, blocks, found))]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    sums = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return union.groupBy(F.col("conv").alias("conv_id")).agg(*sums, *texts)
