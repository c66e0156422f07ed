"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a SimHash fingerprint of BITS bits over its weighted word shingles; so has every run of words of
a document that is as long as an item, from running sums of its shingles' bits. A document of fewer words than the item
is one window, whole. Item fingerprints are indexed by BLOCKS
blocks of bits: a fingerprint within RADIUS differs by at most RADIUS // BLOCKS bits in one block, and all values of a
block within that distance are entered, so no fingerprint within the radius is missed. Candidates are verified exactly
by the weighted Jaccard similarity of shingle counts. A shingle's weight is how often it occurs.

Windows have the lengths that items have, or a shorter document's own, and are looked at only where they can matter: a
window of weight v that reaches similarity s with an item of weight w shares at least s / (1 + s) of v + w with it, so
windows without that many shingles of items of their length cannot pass and are not fingerprinted; nor can a document that weighs less
than s of the item. A fingerprint's distance is a random
quantity: at similarity 0.8 it averages 39 bits of 256 with a deviation of 5.7; the default radius lies 3.7 deviations
above and keeps more than 99.9 per cent of such windows, all exact copies (distance 0) among them. Where a whole
document meets items of no more shingles than a shingle has words, signs tie too often for that; those items are all
verified.

The benchmark is broadcast with its index after its size is checked: MOST_ITEMS items of MOST_WORDS words in all, beyond
which items are taken in runs of that size, each over all documents.

Items of fewer words than a shingle are one shingle, compared with windows of their own length; items without words are
never found. Nulls and empty texts: no match. A null id: reported as it is. Rows repeated: each is answered. Ties: of
windows equally like an item, the first is reported. Long texts: sums are held for STRETCH words at a time. An empty table
of documents or items gives no match. Other columns of docs and items are never read by contaminated; decontaminate packs
a row into one struct, so their names cannot clash with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, written
from quire.llm.words import MASK, mix, shingle_hashes, text_rows

BITS, BLOCKS, RADIUS = 256, 16, 60
SHINGLE, SIMILARITY = 5, 0.8
MOST_ITEMS, MOST_WORDS = 20_000, 2_000_000
#: Windows fingerprinted together, and words of text whose bits are summed at a time.
WINDOWS, STRETCH = 512, 8192


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the bits of each shingle's hash, 64 to a word of it."""
    words = [mix(shingles ^ np.uint64((0x5851F42D4C957F2D * (2 * k + 1)) & MASK)) for k in range(BITS // 64)]
    bits = np.unpackbits(np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits.view(np.int8) * np.int8(2) - np.int8(1)


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from the sums of signs, a row of 16-bit blocks each."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.uint16)


class BlockIndex:
    """Finds every indexed fingerprint within the radius of a query.

    Of BLOCKS blocks, a fingerprint within the radius lies within radius // BLOCKS bits in one of the first
    radius % BLOCKS + 1, or within one bit less in one of the others. Items are listed by each block's value, four bytes a
    block, with where each value's list starts (4 MB in all, whatever the items); a query looks up all values near its own.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(BLOCKS):
            near = radius // BLOCKS - (b > radius % BLOCKS)
            masks = np.array([sum(1 << i for i in some) for k in range(near + 1) for some in combinations(range(16), k)], np.uint16)
            heads = np.concatenate([[0], np.cumsum(np.bincount(prints[:, b], minlength=1 << 16))]).astype(np.int32)
            self.lists.append((masks, heads, np.argsort(prints[:, b], kind="stable").astype(np.int32)))

    def met(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs that share a near block, each once."""
        found = [np.zeros(0, np.int64)]
        for b, (masks, heads, items) in enumerate(self.lists):
            tried = (queries[:, b][:, None] ^ masks[None, :]).reshape(-1).astype(np.int64)
            start = heads.take(tried)
            size = heads.take(tried + 1) - start
            hit = np.flatnonzero(size)
            start, size = start[hit], size[hit]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            found.append(np.repeat(hit // max(1, len(masks)), size) * np.int64(max(1, len(self.prints))) + items[at])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius, each once."""
        q, i = self.met(queries)
        near = np.bitwise_count(queries[q] ^ self.prints[i]).sum(1) <= self.radius
        return q[near], i[near]


class Benchmark:
    """Items by number of words, with their shingles, fingerprints and indexes; made on the driver, sent with the task."""

    def __init__(self, ids: list, texts: list[str | None], size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.size, self.similarity = size, similarity
        #: Of each length: its items' ids and counted shingles, and the number of its first fingerprint.
        self.lengths: dict[int, tuple[list, list[dict[int, int]], int]] = {}
        self.known_of: dict[int, np.ndarray] = {}
        prints, at = [np.zeros((0, BLOCKS), np.uint16)], 0
        by_length: dict[int, list] = {}
        every = []
        for (_, words), item in zip(text_rows(pa.array(texts, pa.string())), ids, strict=True):
            if len(words):
                s = shingle_hashes(words, size)
                by_length.setdefault(len(words), []).append((item, s))
                every.append(s)
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        for n, items in sorted(by_length.items()):
            prints.append(pack(np.stack([bit_signs(s).sum(0, dtype=np.int32) for _, s in items])))
            weights = []
            for _, s in items:
                v, c = np.unique(s, return_counts=True)
                weights.append(dict(zip(v.tolist(), c.tolist(), strict=True)))
            self.lengths[n] = ([i for i, _ in items], weights, at)
            self.known_of[n] = np.unique(np.concatenate([s for _, s in items]))
            at += len(items)
        self.prints, self.radius = np.concatenate(prints), radius
        self._index: BlockIndex | None = None

    @property
    def index(self) -> BlockIndex:
        """The index of all items; each worker makes its own, so that only fingerprints travel."""
        if self._index is None:
            self._index = BlockIndex(self.prints, radius=self.radius)
        return self._index

    def matches(self, words: np.ndarray) -> list[tuple]:
        """(item id, first word, words, similarity) of each item's best window in a text."""
        best: dict = {}
        n = len(words)
        if not n or not len(self.known):
            return []
        for size in {self.size} | {k for k in self.lengths if k < self.size}:
            if n < size:
                continue
            shingles = shingle_hashes(words, size)
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            shared = self.known[at] == shingles
            if not shared.any():
                continue
            count = np.concatenate([[0], np.cumsum(shared)])
            places = np.flatnonzero(shared)
            for length, (ids, weights, base) in self.lengths.items():
                if (size == self.size) != (length >= self.size) or (length < self.size and length != size):
                    continue
                # A text shorter than the item is one window.
                held_item, words_here = length - size + 1, min(length, n)
                held = words_here - size + 1
                if held < self.similarity * held_item - 1e-9:
                    continue
                # Shared shingles that a window needs, of its weight and the item's.
                need = max(1, int(np.ceil(self.similarity / (1 + self.similarity) * (held + held_item) - 1e-9)))
                start = np.flatnonzero(count[held:] - count[:-held] >= need)
                if len(start):
                    # The same of the shingles that items of this length have.
                    mine = self.known_of[length]
                    own = mine[np.minimum(np.searchsorted(mine, shingles[places]), len(mine) - 1)] == shingles[places]
                    near = places[own]
                    start = start[np.searchsorted(near, start + held) - np.searchsorted(near, start) >= need]
                if not len(start):
                    continue
                lo = 0
                while lo < len(start):
                    # Windows that lie near one another, from running sums over their stretch alone.
                    hi = min(lo + WINDOWS, int(np.searchsorted(start, start[lo] + STRETCH)))
                    here = start[lo:hi]
                    lo = hi
                    if held < held_item <= self.size:
                        q, item = np.zeros(len(ids), np.int64), np.arange(len(ids))
                    else:
                        first = int(here[0])
                        signs = np.zeros((int(here[-1]) + held - first + 1, BITS), np.int32)
                        np.cumsum(bit_signs(shingles[first : int(here[-1]) + held]), axis=0, dtype=np.int32, out=signs[1:])
                        q, item = self.index.search(pack(signs[here + held - first] - signs[here - first]))
                        own = (item >= base) & (item < base + len(ids))
                        q, item = q[own], item[own] - base
                    for k, i in zip(here[q].tolist(), item.tolist(), strict=True):
                        like = _weighted(shingles[k : k + held], weights[i], held + held_item)
                        if like >= self.similarity and like > best.get(ids[i], (0, 0, -1.0))[2]:
                            best[ids[i]] = (k, words_here, like)
        return [(i, *v) for i, v in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def _weighted(window: np.ndarray, item: dict[int, int], total: int) -> float:
    """Weighted Jaccard similarity of shingle counts; the two sides weigh `total` together."""
    left = dict(item)
    both = 0
    for s in window.tolist():
        if left.get(s, 0):
            left[s] -= 1
            both += 1
    return both / (total - both)


def _finder(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0)
            for k, words in text_rows(batch.column(1)):
                found = bench.matches(words)
                if found:
                    doc = ids[k].as_py()
                    rows += [(doc, *m) for m in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def _benchmarks(items: DataFrame, size: int, similarity: float) -> Iterator[Benchmark]:
    """The benchmark in runs of bounded size; items reach the driver a run at a time."""
    held, words, ids = [], 0, []
    for r in items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((r["text"] or "").split())
        if held and (len(held) >= MOST_ITEMS or words + n > MOST_WORDS):
            yield Benchmark(ids, held, size, similarity)
            held, words, ids = [], 0, []
        held.append(r["text"])
        ids.append(r["item_id"])
        words += n
    yield Benchmark(ids, held, size, similarity)


def contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each item found in each document."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = part = None
    for bench in _benchmarks(items, size, similarity):
        if part is not None:  # another run follows: this one ends first, so that one run's items are held at a time
            part = written(part, "contaminated")
            out = part if out is None else out.union(part)
        part = map_arrow(plain, _finder(bench), "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double")
    return part if out is None else out.union(part)


def _clean(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, words in text_rows(batch.column(1)):
                keep[k] = not bench.matches(words)
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their own columns."""
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.col("text").cast("string").alias("text"))
    schema = wide.schema  # as it is: names of columns may hold what DDL would not take
    for k, bench in enumerate(_benchmarks(items, size, similarity)):
        wide = map_arrow(wide if k == 0 else written(wide, "clean"), _clean(bench), schema)
    return wide.select("key.*")
