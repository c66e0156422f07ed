"""Token ids as files: tokenized whole texts, coded by an adaptive context-mixing range coder.

Three predictors share each id's probability. Orders 1 and 2 each predict one id, the last that followed the same one or
two ids of the block, and count how often in turn they were right. Those counts, and whether the two agree, choose the
pair of weights they get; each such pair follows how often they were right, within the block. What the two leave goes to
order 0, the section's own shares of all its ids, which its header holds. An id is coded in the part of the highest order
that says it: the weights' part first, and within order 0's part the id's share. All arithmetic is in integers, so any
machine decodes alike.

Ids are cut into blocks of BLOCK. Each block starts from fresh tables, weights and coder and carries the checksum of its
ids, so any block can be read without the others; the blocks of a section are coded in step, one lane each, LANES of them
at a time. A section holds whole documents (about SECTION ids):

    b"QTK2", uint32 length, zlib of (doc ids as int64, null flags as uint8, counts as int64),
    uint32 length, zlib of (present ids as uint16, their shares as uint32),
    uint32 blocks, then of each block uint32 ids, uint32 bytes, uint32 crc32; then the bytes of all blocks

Numbers are little-endian; crc32 is of the ids as unsigned 32-bit integers. Ids of 65,536 and more are refused.

Nulls: a null text is empty, and stands as its end id alone; documents with a null doc_id come first. Rows repeated under
one doc_id are one document each, in the order of their texts; ties on both are equal rows. An empty table gives no
section and no row. Long texts: a document's ids are held whole, two bytes each; the coder's own memory is that of LANES
blocks. Other columns of docs are never read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import fresh_path, map_arrow, written
from quire.llm.store import new_file, open_range
from quire.llm.words import LOWER, column_bytes

BLOCK, LANES, SECTION = 2048, 4096, 8 << 20
MAGIC = b"QTK2"
#: Slots of each order's table of a lane.
SLOTS = 512
#: Weights are of FIRST, shares of WHOLE. The coder's window has 63 bits and lets go of 32 at a time.
FIRST, ZEROTH = 1 << 16, 18
WHOLE = 1 << ZEROTH
SMALL, LOW31, WINDOW, WORD = 1 << 31, (1 << 31) - 1, (1 << 63) - 1, (1 << 32) - 1
#: Two weights in one integer, order 2's in the upper half; a step of the weights takes a sixteenth and adds one of these.
FIELDS = (0xFFFF << 32) | 0xFFFF
STEP, LEAST, MOST = 4, 32, FIRST - 4096
GAIN = np.array([(a << 32 | b) >> STEP for a, b in ((LEAST, LEAST), (LEAST, MOST), (MOST, LEAST))], np.int64)
#: Words held by a worker, bytes whose new words are tokenized together, and plain words to a call.
CACHE, RUN, LINE = 1_200_000, 16 << 20, 500


def first_weights() -> np.ndarray:
    """Of each (agreement, order 2's count, order 1's count), what a block starts from."""
    sure = np.array([LEAST * 16, 20000, 36000, 52000])
    two = np.repeat(sure, 4)
    one = (FIRST - two) * np.tile(sure * 2 // 3, 4) >> 16
    agreed = np.minimum(two + (FIRST - two) // 3, MOST)
    return np.concatenate([two << 32 | np.maximum(one, LEAST), agreed << 32 | LEAST])


class _Orders:
    """What orders 1 and 2 of all lanes say of the id at hand. The first n lanes take part in a step."""

    def __init__(self, lanes: int):
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)  # an id and how often in turn it was right
        self.weights = np.tile(first_weights(), lanes)
        self.last, self.key = np.zeros(lanes, np.int64), np.zeros((2, lanes), np.int64)
        self.home, self.states = np.arange(2 * lanes).reshape(2, lanes) * SLOTS, np.arange(lanes) * 32

    def predict(self, n: int) -> None:
        key = self.key[:, :n]
        np.multiply(key[0], 23, out=key[1])
        np.multiply(self.last[:n], 40503, out=key[0])
        key[1] += key[0]
        self.slot = key >> 5
        self.slot &= SLOTS - 1
        self.slot += self.home[:, :n]
        held = self.table.take(self.slot)
        self.guess = held >> 2
        held &= 3
        self.sure = held
        state = held[1] << 2
        state |= held[0]
        state |= (self.guess[0] == self.guess[1]).view(np.int8) << np.int8(4)
        self.state = self.states[:n] + state
        self.pair = self.weights.take(self.state)
        self.two = self.pair >> 32
        self.both = (self.pair & WORD) + self.two

    def learn(self, n: int, ids: np.ndarray, right: np.ndarray, one: np.ndarray) -> None:
        """right: which guesses were; one: where order 1 alone was right."""
        held = self.sure + 1
        np.minimum(held, 3, out=held)
        held *= right
        held += ids << 2
        self.table[self.slot] = held
        kept = self.pair >> STEP
        kept &= FIELDS
        np.subtract(self.pair, kept, out=kept)
        kept += GAIN.take((right[1].view(np.int8) << np.int8(1)) + one.view(np.int8))
        self.weights[self.state] = kept
        self.last[:n] = ids


def shares(ids: np.ndarray) -> np.ndarray:
    """Order 0 of a section: of WHOLE, at least one for every id that is there."""
    counts = np.bincount(ids, minlength=1 << 16)
    there = int((counts > 0).sum())
    out = np.where(counts > 0, 1 + counts * (WHOLE - there) // max(1, len(ids)), 0)
    out[np.argmax(out)] += WHOLE - out.sum()
    return out


def _lookup(share: np.ndarray) -> np.ndarray:
    """Where each id's part of WHOLE starts, and its size, in one integer."""
    return (np.cumsum(share) - share) << 20 | share


def encode_blocks(ids: np.ndarray, share: np.ndarray) -> list[bytes]:
    """Each BLOCK of ids, coded on its own."""
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("ids are below 65,536")
    parts, out = _lookup(share), []
    for at in range(0, len(ids), BLOCK * LANES):
        out += _encode_lanes(ids[at : at + BLOCK * LANES], parts)
    return out


def _encode_lanes(ids: np.ndarray, parts: np.ndarray) -> list[bytes]:
    lanes = -(-len(ids) // BLOCK)
    short = len(ids) - (lanes - 1) * BLOCK
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    m = _Orders(lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, WINDOW, np.int64)
    words, at = np.zeros((256, lanes), np.uint32), np.zeros(lanes, np.int64)
    for t in range(BLOCK if lanes > 1 else short):
        n = lanes if t < short else lanes - 1  # only the last block is short
        if t % 64 == 0 and at.max() + 66 > len(words):
            words = np.concatenate([words, np.zeros_like(words)])
        m.predict(n)
        now = grid[t, :n]
        right = m.guess == now
        two = right[1]
        one = right[0] > two
        rest = np.flatnonzero(~(right[0] | two))
        start = np.where(one, m.two, m.both)
        size = np.where(one, m.both, FIRST)
        np.copyto(size, m.two, where=two)
        start *= ~two
        size -= start
        room = span[:n] >> 16
        start *= room
        room *= size
        part, inner = parts.take(now.take(rest)), room.take(rest) >> ZEROTH
        room[rest] = (part & 0xFFFFF) * inner
        part >>= 20
        part *= inner
        part += start.take(rest)
        start[rest] = part
        base = low[:n]
        base += start
        over = np.flatnonzero(base < 0)  # past the window: one is carried into the words already let go
        if len(over):
            base[over] &= WINDOW
            back = at[over] - 1
            while len(over):
                more = words[back, over] + np.uint32(1)
                words[back, over] = more
                over, back = over[more == 0], back[more == 0] - 1
        done = np.flatnonzero(room < SMALL)
        settled, where = base.take(done), at.take(done)
        words[where, done] = settled >> 31
        base[done] = (settled & LOW31) << 32
        room[done] = room.take(done) << 32
        at[done] = where + 1
        span[:n] = room
        m.learn(n, now, right, one)
    if at.max() + 2 > len(words):
        words = np.concatenate([words, np.zeros((2, lanes), np.uint32)])
    every = np.arange(lanes)
    words[at, every], words[at + 1, every] = low >> 31, (low & LOW31) << 1
    rows = np.ascontiguousarray(words.T)
    return [rows[i, : at[i] + 2].astype("<u4").tobytes() for i in range(lanes)]


def decode_blocks(blocks: list[bytes], sizes: list[int], share: np.ndarray) -> np.ndarray:
    """The ids of blocks of the sizes given; all but the last have BLOCK."""
    parts, which = _lookup(share), np.repeat(np.arange(len(share)), share).astype(np.uint16)
    out = [_decode_lanes(blocks[i : i + LANES], sizes[i : i + LANES], parts, which) for i in range(0, len(blocks), LANES)]
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _decode_lanes(blocks: list[bytes], sizes: list[int], parts: np.ndarray, which: np.ndarray) -> np.ndarray:
    lanes, short = len(blocks), sizes[-1]
    words = np.frombuffer(b"".join(blocks) + bytes(8), "<u4")
    end = np.cumsum([len(b) // 4 for b in blocks])
    at = np.concatenate([[0], end[:-1]])
    m = _Orders(lanes)
    span = np.full(lanes, WINDOW, np.int64)
    # The window has 63 bits, so what is taken in lies one bit across the words.
    code = words[at].astype(np.int64) << 31 | words[at + 1] >> np.uint32(1)
    at += 1
    grid = np.zeros((BLOCK, lanes), np.uint16)
    for t in range(BLOCK if lanes > 1 else short):
        n = lanes if t < short else lanes - 1
        m.predict(n)
        room, place = span[:n] >> 16, code[:n]
        edge2, edge1 = m.two * room, m.both * room
        two, one = place < edge2, place < edge1
        rest = np.flatnonzero(~one)
        one &= ~two
        now = np.where(two, m.guess[1], m.guess[0])
        start = np.where(one, edge2, edge1)
        start *= ~two
        size = np.where(one, m.both - m.two, FIRST - m.both)
        np.copyto(size, m.two, where=two)
        room *= size
        place -= start
        left, inner = place.take(rest), room.take(rest) >> ZEROTH
        ids = which.take(np.clip(left // np.maximum(inner, 1), 0, WHOLE - 1))
        now[rest] = ids
        part = parts.take(ids)
        room[rest] = (part & 0xFFFFF) * inner
        part >>= 20
        part *= inner
        left -= part
        place[rest] = left
        done = np.flatnonzero(room < SMALL)
        where = np.minimum(at.take(done), len(words) - 2)
        fresh = (words.take(where).astype(np.int64) << 32 | words.take(where + 1)) >> 1 & WORD
        place[done] = place.take(done) << 32 | fresh
        room[done] = room.take(done) << 32
        at[done] = where + 1
        span[:n] = room
        grid[t, :n] = now
        m.learn(n, now, m.guess == now, one)
    return np.ascontiguousarray(grid.T).reshape(-1)[: sum(sizes)]


def _packed(data: bytes) -> bytes:
    data = zlib.compress(data)
    return struct.pack("<I", len(data)) + data


def _unpacked(f) -> bytes:
    return zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0]))


def pack_section(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    share = shares(ids) if len(ids) and ids.max() <= 0xFFFF else np.zeros(1 << 16, np.int64)
    blocks = encode_blocks(ids, share)
    there = np.flatnonzero(share)
    head = np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + np.array(counts, "<i8").tobytes()
    table = b"".join(struct.pack("<III", len(part := ids[i * BLOCK : (i + 1) * BLOCK]), len(b), zlib.crc32(part.astype("<u4").tobytes())) for i, b in enumerate(blocks))
    return MAGIC + _packed(head) + _packed(there.astype("<u2").tobytes() + share[there].astype("<u4").tobytes()) + struct.pack("<I", len(blocks)) + table + b"".join(blocks)


def unpack_section(f) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, counts, ids) of the section at an open file's place; raises where a block does not have its checksum."""
    if f.read(4) != MAGIC:
        raise ValueError("not a section of token ids")
    raw = _unpacked(f)
    n = len(raw) // 17
    docs, null, counts = np.frombuffer(raw[: 8 * n], "<i8"), raw[8 * n : 9 * n], np.frombuffer(raw[9 * n :], "<i8")
    raw = _unpacked(f)
    k = len(raw) // 6
    share = np.zeros(1 << 16, np.int64)
    share[np.frombuffer(raw[: 2 * k], "<u2")] = np.frombuffer(raw[2 * k :], "<u4")
    blocks = struct.unpack("<I", f.read(4))[0]
    table = np.frombuffer(f.read(12 * blocks), "<u4").reshape(blocks, 3)
    ids = decode_blocks([f.read(size) for size in table[:, 1].tolist()], table[:, 0].tolist(), share)
    at = 0
    for k, _, crc in table.tolist():
        if zlib.crc32(ids[at : at + k].astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids does not have its checksum")
        at += k
    return [None if null[i] else int(docs[i]) for i in range(n)], counts, ids


#: Kinds of bytes: white space, letters, digits, other ASCII, the apostrophe, the rest.
_KIND = np.full(256, 5, np.uint8)
_KIND[:128] = 3
_KIND[[32, *range(9, 14)]] = 0
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[39] = 4
#: Between which kinds a text is cut. Past white space always; the others only where a pre-tokenizer tells letters, digits
#: and the rest apart, and never before a letter that an apostrophe may take with it, nor beside what is not ASCII.
_CUT = np.zeros((2, 8, 8), bool)
_CUT[:, 0, 1:6] = True
_CUT[1, 1, 2:5] = _CUT[1, 2, [1, 3, 4]] = _CUT[1, 3, 1:3] = _CUT[1, 4, 2] = True
PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Fixed value: the pre-tokenizing pattern whose pieces are letters, single digits, runs of the rest, and contractions.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of whole texts; a word is tokenized once for each worker while the worker holds it.

    Texts are cut where no piece of the tokenizer crosses: past white space, and between letters, digits and other ASCII
    where its pattern keeps them apart. Letter case is dropped first where the tokenizer drops it. For a tokenizer whose
    pieces never cross white space this equals encoding each text as a whole. A text that spells out a special token, in
    any case, is given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        apart = json.dumps(LETTERS_APART) in json.dumps(spec.get("pre_tokenizer"))
        self.cut = _CUT[int(apart)].reshape(-1)
        self.fold = LOWER if '"Lowercase"' in json.dumps(spec.get("normalizer")) else np.arange(256, dtype=np.uint8)
        self.plain, mark = None, spec["model"].get("end_of_word_suffix")
        if apart and mark:
            # A word of small letters is one piece of the pattern and its own normal form; nothing but bytes is left to do.
            from tokenizers import normalizers, pre_tokenizers

            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.inner.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
        self.special = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Tokenize words that are not held: plain ones many to a call, each up to the id that ends a word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [bool(PLAIN_WORD(t)) for t in texts] if self.plain else [False] * len(texts)
        order = [w for w, p in zip(words, plain, strict=True) if p] + [w for w, p in zip(words, plain, strict=True) if not p]
        ready = [t for t, p in zip(texts, plain, strict=True) if p]
        other = [t for t, p in zip(texts, plain, strict=True) if not p]
        lines = [" ".join(ready[i : i + LINE]) for i in range(0, len(ready), LINE)]
        fresh = [np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)] if lines else []
        ends = np.concatenate([[0], np.flatnonzero(self.ends[np.concatenate(fresh)]) + 1]) if fresh else np.zeros(1, np.int64)
        size = [np.diff(ends)]
        if len(size[0]) != len(ready):
            raise ValueError("a plain word does not end with a piece that ends words")
        found = [e.ids for e in self.inner.encode_batch_fast(other, add_special_tokens=False)]
        size.append(np.fromiter(map(len, found), np.int64, len(found)))
        fresh.append(np.fromiter((i for ids in found for i in ids), np.int32, int(size[1].sum())))
        ids, size = np.concatenate(fresh), np.concatenate(size)
        n = len(self.words)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.size) < n + len(words):
            self.size, self.first = (np.concatenate([a, np.zeros_like(a)]) for a in (self.size, self.first))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)], self.first[n : n + len(words)] = size, self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.words.update(zip(order, range(n, n + len(words)), strict=True))

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.inner.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the texts between the offsets, the end id after each; runs of RUN bytes go together."""
        ids, counts, at, n = [], [], 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN, "right")) - 1)
            got = self._run(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], end)
            ids.append(got[0])
            counts.append(got[1])
            at = to
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _run(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        raw = self.fold[data].tobytes()
        kind = _KIND[data]
        pair = kind[:-1] << 3
        pair |= kind[1:]
        cut = self.cut[pair]
        inside = offsets[1:-1]
        cut[inside[(inside > 0) & (inside < len(data))] - 1] = True
        # White space is left out; what is between edges is then all of a word.
        solid = kind != 0
        before = np.concatenate([[0], np.cumsum(solid, dtype=np.int32)])
        edges = before[np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]])]
        edges = edges[np.concatenate([[True], edges[1:] > edges[:-1]])].astype(np.int32)
        keys = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.fold[data[solid]])]).dictionary_encode()
        spelt = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) + len(spelt) > CACHE or self.used > 8 * CACHE:
            self.clear()
        known = list(map(self.words.get, spelt))
        if None in known:
            self.learn([w for w, k in zip(spelt, known, strict=True) if k is None])
            known = list(map(self.words.get, spelt))
        word = np.array(known, np.int64)[keys.indices.to_numpy()]
        size = self.size[word]
        first = self.first[word]
        # Where each text's words end; a text spelling out a special token is put in whole, in place of its words.
        stops = np.searchsorted(edges, before[offsets])
        lasts = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(lasts[stops])
        total = int(lasts[-1])
        ids = self.ids[np.repeat(first - lasts[:-1], size) + np.arange(total)] if total else np.zeros(0, np.int32)
        odd = self._special_texts(raw, offsets)
        if odd:
            pieces = np.split(ids, lasts[stops[1:-1]]) if n > 1 else [ids]
            for k in odd:
                pieces[k] = self.whole(data[offsets[k] : offsets[k + 1]].tobytes())
                counts[k] = len(pieces[k])
            ids = np.concatenate(pieces)
        out = np.full(len(ids) + n, end, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = ids
        return out, counts + 1

    def _special_texts(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        odd: set[int] = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                odd.add(k)
                at = raw.find(token, int(offsets[k + 1]))
        return sorted(odd)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, with the words that it holds."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _writer(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = tokenizer_of(path)
        part = TaskContext.get().partitionId()
        uri = out = None
        at, done, docs, counts, held, waiting = 0, [], [], [], [], 0

        def flush() -> None:
            nonlocal uri, out, at, docs, counts, held, waiting
            if out is None:
                uri, out = new_file(folder, ".tok")
            data = pack_section(docs, counts, np.concatenate(held))
            out.write(data)
            done.append((uri, at, part, len(done), sum(counts)))
            at += len(data)
            docs, counts, held, waiting = [], [], [], 0

        for batch in batches:
            ids, sizes = tokenizer.encode(*column_bytes(batch.column(1)), end)
            if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
                raise ValueError("ids are below 65,536")
            doc, to = batch.column(0).to_pylist(), np.cumsum(sizes)
            first = 0
            while first < len(doc):  # whole documents up to a section's ids
                last = max(first + 1, int(np.searchsorted(to, (to[first - 1] if first else 0) + SECTION - waiting)))
                last = min(last, len(doc))
                lo, hi = (int(to[first - 1]) if first else 0), int(to[last - 1])
                docs += doc[first:last]
                counts += sizes[first:last].tolist()
                held.append(ids[lo:hi].astype(np.uint16))
                waiting += hi - lo
                first = last
                if waiting >= SECTION:
                    flush()
        if docs:
            flush()
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["uri", "offset", "part", "section", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end: int = 2) -> DataFrame:
    """Tokenize docs(doc_id, text, ...) in ascending doc_id order into files; the manifest (uri, offset, part, section, ids)."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = plain.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(map_arrow(ordered, _writer(folder, path, end), "uri string, offset bigint, part int, section int, ids bigint"), "tokens-manifest")


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                with open_range(m["uri"], m["offset"]) as f:
                    docs, counts, ids = unpack_section(f)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(m["base"] + ends - counts), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the files that a manifest lists; start counts over all files.

    Only a sum for each file comes to the driver.
    """
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    bases = spark.createDataFrame(base, "part int, before bigint")
    inner = Window.partitionBy("part").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("inside", F.coalesce(F.sum("ids").over(inner), F.lit(0))).join(F.broadcast(bases), "part").select("uri", "offset", (F.col("before") + F.col("inside")).alias("base"))
    spread = placed.repartition(max(1, manifest.count()))
    return map_arrow(spread, _reader(with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def token_round_trip(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every row of docs, as read back from the files."""
    return read_tokens(write_tokens(docs, path, end=end), with_ids=False)
