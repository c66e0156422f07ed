"""Removal of repeated 50-byte strings, over a sparse suffix array sorted by the deep-shallow method.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Every such
string holds an anchor: the least hash among the ANCHOR-byte strings that start in its first LENGTH - ANCHOR + 1 bytes.
Equal strings hold equal anchors at equal offsets, so only suffixes that start at anchors are sorted, together with
what stands before them, read backwards.

1. Exact copies answer to the document of their class with the least doc_id and take no further part.
2. Anchors are dealt by hash; those that occur in two documents make candidates.
3. Of a candidate, the LENGTH - ANCHOR bytes on either side are dealt by the anchor's hash. Anchored suffixes are
   ordered by their first SHALLOW bytes in a multikey quicksort whose characters are 8-byte words, all groups a round at
   a time; blind tries order the runs that still share their prefix, one of each equal text. Common prefixes of
   neighbours then tell, for every length, which suffixes and which reversed prefixes agree; a string is the pair of the
   two, and its least doc_id decides.
4. Covered ranges go back to their documents.

Copies in one batch settle there: of equal contexts only that of the least doc_id travels, of an anchor only one
occurrence, so a passage in a third of all documents costs each bucket one row for each batch. Contexts and texts are
compared byte for byte; only anchors (64-bit hashes of 20 bytes, whose surroundings must agree too) and exact copies (md5
and length) are known by hash.

Nulls and empty texts: nothing removed. A null doc_id: neither removed from nor a source. Rows repeated under one doc_id
are no source for one another; of ties on the least doc_id no one row is chosen. Texts are handled as bytes, whole, and
never joined; time grows with their length, however much of itself a text repeats. An empty table gives no rows. Other
columns of docs are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import grouped_arrow, small_batches
from quire.llm.words import MASK, column_bytes, mix, powers

LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR
#: Bytes of text of a bucket, and bytes of the right-hand context that the shallow sort looks at.
BUCKET, SHALLOW = 4 << 20, 16
#: Anchors at a time when a document is longer.
PIECE = 1 << 20


def anchors(data: np.ndarray, width: int = SIDE + 1, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the anchors of one text: the leftmost least hash of each run of `width` size-byte strings."""
    out_h, out_p = [], []
    n, at, last = len(data), 0, -1
    while n - at >= width + size - 1:
        part = data[at : at + PIECE + width + size - 2]
        p, q = powers(len(part) + 1)
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=c[1:])
        h = mix((c[size:] - c[:-size]) * q[: len(c) - size])
        pos = leftmost_least(h, width) + at
        new = np.concatenate([[pos[0] != last], pos[1:] != pos[:-1]])
        pos = pos[new]
        out_p.append(pos)
        out_h.append(h[pos - at])
        if len(pos):
            last = int(pos[-1])
        at += len(h) - width + 1
    if not out_p:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_p)


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each run [i, i + width), the first position that holds its least value; runs double, so all are found in few passes."""
    least, where, span = h, np.arange(len(h), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)  # two runs of `span`, the last pair overlapping, make one of span + step
        later = least[step:] < least[:-step]
        where = np.where(later, where[step:], where[:-step])
        least = np.minimum(least[step:], least[:-step])
        span += step
    return where


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(id), buckets), as Spark computes it for a bigint."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    k = turn(ids.view(np.uint64) * p2, 31) * p1
    h = turn((np.uint64(42) + p5 + np.uint64(8)) ^ k, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), buckets).astype(np.int64)


class BlindTrie:
    """Orders distinct byte strings by the places where they branch; only one string is compared on each insertion."""

    def __init__(self, first: int, strings: list[bytes]):
        self.strings, self.root = strings, first  # a leaf is a number, an inner node (depth, {byte: child})

    def insert(self, new: int) -> None:
        text, node = self.strings[new], self.root
        while not isinstance(node, int):  # blindly, by the branching bytes alone
            depth, sons = node
            key = text[depth] if depth < len(text) else -1
            node = sons[key] if key in sons else next(iter(sons.values()))
        other = self.strings[node]
        depth = _common(text, other)
        mine, its = (text[depth] if depth < len(text) else -1), (other[depth] if depth < len(other) else -1)
        above, key, node = None, None, self.root
        while not isinstance(node, int) and node[0] < depth:
            above, key = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][key]
        if not isinstance(node, int) and node[0] == depth:
            node[1][mine] = new
            return
        made = (depth, {its: node, mine: new})
        if above is None:
            self.root = made
        else:
            above[1][key] = made

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def multikey_quicksort(groups: np.ndarray, words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the run) by the first `depth` words within groups, in ascending order of groups.

    A string's characters are its 8-byte words. Every run that is not settled is parted into those below, at and above a
    pivot, the median of its first, middle and last word; those at it go on with the next word. All runs of a round are
    parted together, each by counting.
    """
    m = len(groups)
    order = np.argsort(groups, kind="stable")
    first = np.concatenate([[True], groups[order][1:] != groups[order][:-1]]) if m else np.zeros(0, bool)
    start = np.flatnonzero(first)
    level = np.zeros(len(start), np.int64)
    while True:
        size = np.diff(np.concatenate([start, [m]]))
        todo = np.flatnonzero((size > 1) & (level < depth))
        if not len(todo):
            return order, np.repeat(np.arange(len(start)), size)
        lo, n = start[todo], size[todo]
        run = np.repeat(np.arange(len(todo)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(lo, n) + at
        key = words[order[place], level[todo][run]]
        edge = np.cumsum(n) - n
        pivot = np.sort(np.stack([key[edge], key[edge + n // 2], key[edge + n - 1]]), axis=0)[1]
        side = (key > pivot[run]).astype(np.int8) - (key < pivot[run]) + np.int8(1)
        counts = np.stack([np.add.reduceat((side == k).astype(np.int64), edge) for k in range(3)])
        base = np.stack([np.zeros_like(lo), counts[0], counts[0] + counts[1]]) + lo
        moved = np.empty_like(place)
        for k in range(3):
            mine = side == k
            rank = np.cumsum(mine) - mine
            moved[mine] = base[k][run[mine]] + (rank - rank[edge][run])[mine]
        order[moved] = order[place]
        # The runs of the next round: three for each that was parted, where there is anything in them.
        parts = base.T.reshape(-1)[(counts > 0).T.reshape(-1)]
        deeper = np.stack([level[todo], level[todo] + 1, level[todo]]).T.reshape(-1)[(counts > 0).T.reshape(-1)]
        others = np.setdiff1d(np.arange(len(start)), todo, assume_unique=True)
        start = np.concatenate([start[others], parts])
        level = np.concatenate([level[others], deeper])
        by = np.argsort(start, kind="stable")
        start, level = start[by], level[by]


def deep_shallow(groups: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before; -1 at the start of a group) of texts[i, :lengths[i]] within groups."""
    m, width = texts.shape
    shown = np.where(np.arange(width)[None, :] < lengths[:, None], texts, 0).astype(np.uint8)
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = shown
    words = padded.view(">u8").astype(np.uint64)
    order, tied = multikey_quicksort(groups, words, SHALLOW // 8)
    # Deep: equal texts stand together, and one of each goes into its run's blind trie. Equal ones are gathered by a hash
    # and then compared; where a hash meets two texts, the run is gathered by the texts themselves.
    rest = np.full(m, 0x51ED270B, np.uint64) + lengths.astype(np.uint64)
    for w in range(SHALLOW // 8, words.shape[1]):
        rest = mix(rest ^ words[:, w])
    order = order[np.lexsort((rest[order], tied))]
    if m:
        alike = (tied[1:] == tied[:-1]) & (rest[order][1:] == rest[order][:-1])
        equal = (words[order[1:]] == words[order[:-1]]).all(1) & (lengths[order[1:]] == lengths[order[:-1]])
        if (alike & ~equal).any():
            order = order[np.lexsort((lengths[order], *(words[order, w] for w in range(words.shape[1])), tied))]
            equal = (words[order[1:]] == words[order[:-1]]).all(1) & (lengths[order[1:]] == lengths[order[:-1]])
        same = np.concatenate([[False], (tied[1:] == tied[:-1]) & equal])
        first = np.flatnonzero(~same)
        group = tied[first]
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        many = np.flatnonzero(np.diff(edges) > 1)
        rank = np.arange(len(first))
        for g in many:
            lo, hi = edges[g], edges[g + 1]
            strings = [shown[order[f], : lengths[order[f]]].tobytes() for f in first[lo:hi]]
            trie = BlindTrie(0, strings)
            for k in range(1, hi - lo):
                trie.insert(k)
            rank[lo + np.array(trie.ordered())] = np.arange(lo, hi)
        order = order[np.lexsort((np.arange(m), rank[np.cumsum(~same) - 1]))]
    before, here = order[:-1], order[1:]
    differ = shown[before] != shown[here]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.minimum(lcp, np.minimum(lengths[before], lengths[here]))
    lcp[groups[before] != groups[here]] = -1
    return order, np.concatenate([[-1], lcp]) if m else np.zeros(0, np.int64)


def repeated_windows(groups: np.ndarray, docs: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """hit[i, o]: whether the string from o bytes before anchor i, of LENGTH bytes, is also in a smaller document here.

    left holds the bytes before each anchor, nearest first; right those after it.
    """
    m = len(groups)
    hit = np.zeros((m, SIDE + 1), bool)
    if m < 2:
        return hit
    r_order, r_lcp = deep_shallow(groups, right, n_right)
    l_order, l_lcp = deep_shallow(groups, left, n_left)
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(SIDE + 1):
        r = SIDE - o
        fits = np.flatnonzero((n_left >= o) & (n_right >= r))
        if len(fits) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < r)
        l_class[l_order] = np.cumsum(l_lcp < o)
        key = r_class[fits] * np.int64(m + 1) + l_class[fits]
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.minimum.reduceat(docs[fits[by]], start)
        size = np.diff(np.concatenate([start, [len(by)]]))
        hit[fits[by], o] = docs[fits[by]] > np.repeat(least, size)
    return hit


def _ranges(hit: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that runs of repeated windows cover."""
    flat = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    flat[:, 1:-1] = hit
    step = np.diff(flat, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, pos[row] - (last - 1), pos[row] - first + LENGTH


#: pos of a text: the number of the text among those of its doc_id, times this, and the byte.
TEXT = 1 << 40


class _Group:
    """The rows of one bucket of documents: whole texts by (doc_id, number), and which stand for their class."""

    def __init__(self, texts: pa.Table, side: pa.Table):
        texts = texts.combine_chunks()
        self.data, self.offsets = (np.zeros(0, np.uint8), np.zeros(1, np.int64)) if not texts.num_rows else column_bytes(texts.column("text").chunk(0))
        self.ids = texts.column("id").to_pylist()
        keep = {(i, d) for i, d in zip(side.column("id").to_pylist(), side.column("digest").to_pylist(), strict=True) if d is not None}
        self.number, self.stands = [0] * len(self.ids), [False] * len(self.ids)
        seen: dict[int, dict[bytes, int]] = {}
        digests = [hashlib.md5(self.text(k)).digest() for k in range(len(self.ids))]
        for k in sorted(range(len(self.ids)), key=lambda k: digests[k]):
            if self.ids[k] is not None:
                self.number[k] = seen.setdefault(self.ids[k], {}).setdefault(digests[k], len(seen[self.ids[k]]))
                self.stands[k] = (self.ids[k], digests[k]) in keep

    def text(self, k: int) -> np.ndarray:
        return self.data[self.offsets[k] : self.offsets[k + 1]]

    def speakers(self) -> Iterator[int]:
        """One row of each text that stands for its class and is long enough."""
        done = set()
        for k, on in enumerate(self.stands):
            if on and (self.ids[k], self.number[k]) not in done and self.offsets[k + 1] - self.offsets[k] >= LENGTH:
                done.add((self.ids[k], self.number[k]))
                yield k


BLOBS = ("bucket", "known", "h", "d", "p", "l", "r")
BLOB_SCHEMA = "bucket int, known boolean, h binary, d binary, p binary, l binary, r binary"
SIDE_SCHEMA = "bucket int, id bigint, digest binary, d binary, s binary, e binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(BLOBS))


def _sides(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "id", "digest", "d", "s", "e"])


def _pack(column: np.ndarray) -> bytes:
    """A column's bytes, deflated but for hashes, which do not get smaller."""
    return column.tobytes() if column.dtype == np.uint64 else zlib.compress(column.tobytes(), 1)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, packed rows of each column of that bucket), rows in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(bucket) else [0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        take = order[lo:hi]
        yield (int(bucket[take[0]]), *[_pack(c[take]) for c in columns])


def _find_anchors(buckets: int):
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        g = _Group(texts, side)
        hs, ds, ps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in g.speakers():
            h, p = anchors(g.text(k))
            hs.append(h)
            ds.append(np.full(len(h), g.ids[k], np.int64))
            ps.append(p + g.number[k] * TEXT)
        h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
        # An anchor in two documents here is settled here; one occurrence of each travels, that of the least doc_id.
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        size = np.diff(np.concatenate([start, [len(h)]]))
        least, most = d[start], d[start + size - 1] if len(start) else d[start]
        known = np.repeat(least != most, size)
        lone = ~known
        out = [(b, True, None, x, y, None, None) for b, x, y in _dealt(bucket_of(d[known], buckets), d[known], p[known])]
        send = first | lone
        sent = np.argsort(d[send], kind="stable")  # documents in order pack well
        h, d, p = h[send][sent], d[send][sent], p[send][sent]
        out += [(b, False, x, y, z, None, None) for b, x, y, z in _dealt((h % np.uint64(buckets)).astype(np.int64), h, d, p)]
        return _blobs(out)

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [x for x in table.column(name).to_pylist() if x]
    return np.frombuffer(b"".join(parts if kind is np.uint64 else map(zlib.decompress, parts)), kind)


def _find_candidates(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        known = table.filter(table.column("known"))
        if known.num_rows:
            out.append((table.column("bucket")[0].as_py(), True, None, _pack(_joined(known, "d", np.int64)), _pack(_joined(known, "p", np.int64)), None, None))
        other = table.filter(pa.compute.invert(table.column("known")))
        h, d, p = _joined(other, "h", np.uint64), _joined(other, "d", np.int64), _joined(other, "p", np.int64)
        order = np.lexsort((d, h))
        h, d, p = h[order], d[order], p[order]
        if len(h):
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([start, [len(h)]]))
            many = np.repeat(d[start] != d[start + size - 1], size)
            d, p = d[many], p[many]
            out += [(b, True, None, x, y, None, None) for b, x, y in _dealt(bucket_of(d, buckets), d, p)]
        return _blobs(out)

    return run


def _around(data: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(before, nearest first; after; how many bytes of each there are) of anchors at pos."""
    n = len(data)
    step = np.arange(SIDE)
    before, after = pos[:, None] - 1 - step, pos[:, None] + ANCHOR + step
    left = np.where(before >= 0, data[np.maximum(before, 0)], 0).astype(np.uint8)
    right = np.where(after < n, data[np.minimum(after, n - 1)], 0).astype(np.uint8)
    return left, np.minimum(pos, SIDE), right, np.minimum(n - pos - ANCHOR, SIDE)


def _cut_contexts(buckets: int):
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        keep = side.filter(pa.compute.is_valid(side.column("digest")))
        g = _Group(texts, keep)
        d, p = _joined(side, "d", np.int64), _joined(side, "s", np.int64)
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        # Settled here or elsewhere, an anchor may be named twice.
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])]) if len(d) else np.zeros(0, bool)
        d, p = d[new], p[new]
        hs, ds, ps, ls, rs = [], [], [], [], []
        for k in g.speakers():
            at = g.number[k] * TEXT
            lo, hi = np.searchsorted(d, g.ids[k], "left"), np.searchsorted(d, g.ids[k], "right")
            lo, hi = lo + np.searchsorted(p[lo:hi], at), lo + np.searchsorted(p[lo:hi], at + TEXT)
            if lo == hi:
                continue
            data, pos = g.text(k), p[lo:hi] - at
            left, n_left, right, n_right = _around(data, pos)
            whole = data[pos[:, None] + np.arange(ANCHOR)]
            hs.append(_row_hash(whole))
            ds.append(d[lo:hi])
            ps.append(p[lo:hi])
            ls.append(np.concatenate([n_left.astype(np.uint8)[:, None], left], axis=1))
            rs.append(np.concatenate([n_right.astype(np.uint8)[:, None], right], axis=1))
        if not hs:
            return _blobs([])
        h, d, p, l, r = (np.concatenate(x) for x in (hs, ds, ps, ls, rs))
        # Of equal contexts all but that of the least doc_id are settled: every string that fits is in it.
        key = mix(h ^ mix(_row_hash(l) ^ mix(_row_hash(r))))
        order = np.lexsort((d, key))
        start = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        head = order[np.flatnonzero(start)[np.cumsum(start) - 1]]
        alike = (h[order] == h[head]) & (l[order] == l[head]).all(1) & (r[order] == r[head]).all(1)
        settled = (d[order] > d[head]) & alike
        out = []
        if settled.any():
            i = order[settled]
            o = np.arange(SIDE + 1)
            fits = (l[i, :1].astype(int) >= o) & (r[i, :1].astype(int) >= SIDE - o)
            row, s, e = _ranges(fits, p[i])
            docs = d[i][row]
            out += [(b, True, None, x, y, z, None) for b, x, y, z in _dealt(bucket_of(docs, buckets), docs, s, e)]
        i = np.sort(order[~settled])
        out += [(b, False, *x) for b, *x in _dealt((h[i] % np.uint64(buckets)).astype(np.int64), h[i], d[i], p[i], l[i], r[i])]
        return _blobs(out)

    return run


def _row_hash(rows: np.ndarray) -> np.ndarray:
    p, _ = powers(rows.shape[1])
    return mix(((rows.astype(np.uint64) + np.uint64(1)) * p[: rows.shape[1]]).sum(1, dtype=np.uint64))


def _settle(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        known = table.filter(table.column("known"))
        if known.num_rows:
            out += [(table.column("bucket")[0].as_py(), None, None, *(_pack(_joined(known, c, np.int64)) for c in ("d", "p", "l")))]
        other = table.filter(pa.compute.invert(table.column("known")))
        h, d, p = _joined(other, "h", np.uint64), _joined(other, "d", np.int64), _joined(other, "p", np.int64)
        left, right = (_joined(other, c, np.uint8).reshape(-1, SIDE + 1) for c in ("l", "r"))
        if len(h):
            order = np.argsort(h, kind="stable")
            size = np.diff(np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]])))
            order = order[np.repeat(size > 1, size)]
            h, d, p, left, right = h[order], d[order], p[order], left[order], right[order]
            hit = repeated_windows(h, d, left[:, 1:], left[:, 0].astype(np.int64), right[:, 1:], right[:, 0].astype(np.int64))
            row, s, e = _ranges(hit, p)
            docs = d[row]
            out += [(b, None, None, x, y, z) for b, x, y, z in _dealt(bucket_of(docs, buckets), docs, s, e)]
        return _sides(out)

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _remove(with_text: bool):
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        g = _Group(texts, side)
        d, s, e = (_joined(side, c, np.int64) for c in ("d", "s", "e"))
        order = np.lexsort((s, d))
        d, s, e = d[order], s[order], e[order]
        rows = []
        for k, doc in enumerate(g.ids):
            data = g.text(k)
            n, kept, removed, spans = len(data), None, 0, 0
            if doc is not None and n >= LENGTH and not g.stands[k]:
                kept, removed, spans = b"", n, 1
            elif doc is not None and n >= LENGTH:
                at = g.number[k] * TEXT
                lo, hi = np.searchsorted(d, doc, "left"), np.searchsorted(d, doc, "right")
                lo, hi = lo + np.searchsorted(s[lo:hi], at), lo + np.searchsorted(s[lo:hi], at + TEXT)
                if lo < hi:
                    mark = np.zeros(n + 1, np.int32)
                    np.add.at(mark, s[lo:hi] - at, 1)
                    np.add.at(mark, e[lo:hi] - at, -1)
                    gone = np.cumsum(mark[:n]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = data[~gone].tobytes()
            kept = data.tobytes() if kept is None else kept
            rows.append((doc, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), body.alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")

    # Rows without a doc_id meet no other; they are dealt by their texts.
    texts = plain.select(F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(buckets)).cast("int").alias("bucket"), "id", "text")
    none = F.lit(None).cast("binary")
    keepers = plain.where("id is not null").groupBy(F.unhex(F.md5("text")).alias("digest"), F.octet_length("text")).agg(F.min("id").alias("id")).select(place("id"), "id", "digest", none.alias("d"), none.alias("s"), none.alias("e"))
    grouped = texts.groupBy("bucket")
    found = grouped.cogroup(keepers.groupBy("bucket")).applyInArrow(grouped_arrow(_find_anchors(buckets)), BLOB_SCHEMA)
    # Known ones keep their documents' bucket, the others are dealt by their hash.
    candidates = found.groupBy("bucket").applyInArrow(grouped_arrow(_find_candidates(buckets)), BLOB_SCHEMA)
    named = keepers.union(candidates.select("bucket", F.lit(None).cast("bigint"), none, "d", F.col("p"), none))
    contexts = grouped.cogroup(named.groupBy("bucket")).applyInArrow(grouped_arrow(_cut_contexts(buckets)), BLOB_SCHEMA)
    ranges = contexts.groupBy("bucket").applyInArrow(grouped_arrow(_settle(buckets)), SIDE_SCHEMA)
    out = grouped.cogroup(keepers.union(ranges).groupBy("bucket")).applyInArrow(grouped_arrow(_remove(with_text)), RESULT)
    return out if with_text else out.drop("kept")
