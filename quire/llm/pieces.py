"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is escaped by markers (a space becomes the marker, one more goes in front) and segmented into the pieces whose
log scores have the greatest sum. Characters that no piece covers fall back to their UTF-8 bytes. Decoding joins the
pieces, turns markers to spaces and drops the first; decode(encode(text)) is the text, byte for byte: a marker that
stands in the text itself goes through bytes.

Scores: those of a unigram model's file. A BPE model's file has merge ranks instead; a piece of rank r then scores
-ln(r + 1) - ln(sum of 1 / (i + 1)), a Zipf law over its ranks. Of equal sums, the segmentation found first stays: for
each end, the one with the longest last piece.

No piece of such models has a marker after another character, nor a line feed, so texts part at those places without
changing the best segmentation, and equal stretches are segmented once for each worker (CACHE of them are held).

Nulls: null ids and null text; the query counts a null text as empty. Empty texts: no ids.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow
from quire.llm.words import column_bytes

MARK = "▁"
MARK_BYTES = MARK.encode()
CACHE = 200_000
#: Characters of a text that are parted at a time, and bytes of a stretch that goes through the vectorised search.
SLICE, LANE = 1 << 19, 64
#: What a character outside all pieces costs, below the least score.
PENALTY = 10.0
STRETCH = re.compile(r" *[^ \n]+|\n| +")


class DoubleArray:
    """A trie in two arrays: the son of s by byte c is t = base[s] + c if check[t] == s; value[t] is the piece, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        sons: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys:
            s = 0
            for c in key:
                if c not in sons[s]:
                    sons[s][c] = len(sons)
                    sons.append({})
                    values.append(-1)
                s = sons[s][c]
            values[s] = value
        size = 2 * len(sons) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[:257] = bytes([1]) * 257  # places that no base of at least 1 reaches by a high byte stay unused
        # Nodes of one son fill the first free place, those of several look on from where the last one was put.
        free, hint, todo = 257, 257, [(0, 0)]
        self.value[0] = values[0]
        while todo:
            node, place = todo.pop()
            marks = sorted(sons[node])
            if not marks:
                continue
            while taken[free]:
                free += 1
            at = max(1, (free if len(marks) == 1 else hint) - marks[0])
            while any(taken[at + c] for c in marks):
                at += 1
                if at + 256 >= len(taken):
                    taken.extend(bytes(len(taken)))
                    self.base, self.check, self.value = np.concatenate([self.base, np.zeros_like(self.base)]), np.concatenate([self.check, np.full_like(self.check, -1)]), np.concatenate([self.value, np.full_like(self.value, -1)])
            if len(marks) > 1:
                hint = at + marks[0]
            self.base[place] = at
            for c in marks:
                taken[at + c] = 1
                self.check[at + c] = place
                self.value[at + c] = values[sons[node][c]]
                todo.append((sons[node][c], at + c))
        end = int(np.flatnonzero(np.frombuffer(taken, np.uint8))[-1]) + 257
        fit = lambda x, fill: np.concatenate([x[:end], np.full(max(0, end - len(x)), fill, np.int32)])
        self.base, self.check, self.value = fit(self.base, 0), fit(self.check, -1), fit(self.value, -1)


class PieceModel:
    """Pieces, scores and trie of a model file; small enough to travel with a task (about 3 MB for 32,000 pieces)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        raw = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        self._set(raw, score, special, byte)

    @classmethod
    def of(cls, raw: list[str], score, special, byte) -> PieceModel:
        self = cls.__new__(cls)
        self._set(raw, np.asarray(score, float), np.asarray(special, bool), np.asarray(byte, bool))
        return self

    def _set(self, raw: list[str], score: np.ndarray, special: np.ndarray, byte: np.ndarray) -> None:
        usual = ~special & ~byte
        held = score[usual]
        if len(held) and np.all(held == np.floor(held)) and held.max() <= 0 and len(set(held.tolist())) == len(held):
            rank = np.arange(len(held))[np.argsort(np.argsort(-held))]
            score = score.copy()
            score[usual] = -np.log(rank + 1.0) - np.log(np.sum(1.0 / (np.arange(len(held)) + 1.0)))
        self.score = score
        self.fallback = float(score[usual].min() - PENALTY) if usual.any() else -PENALTY
        self.byte_id = np.full(256, -1, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_id[int(raw[i][1:-1], 16)] = i
        # Markers stand as spaces; a piece with a space of its own would be no marker and is left out.
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if byte[i] else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(raw)]
        pieces = [(self.bytes_of[i], i) for i in np.flatnonzero(usual) if " " not in raw[i]]
        self.trie = DoubleArray(pieces)
        self.parted = not any(re.search(r"[^ ] |\n", p.decode()) for p, _ in pieces)
        self.whole_chars = {p.decode() for p, _ in pieces if len(p.decode()) == 1}

    # -- encoding -----------------------------------------------------------------------------------------------

    def segment(self, text: str) -> list[int]:
        """Ids of one stretch, in plain steps."""
        data = text.encode("utf-8", "surrogateescape")
        n, base, check, value = len(data), self.trie.base, self.trie.check, self.trie.value
        best, back = np.full(n + 1, -np.inf), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for start, end in _chars(data):
            if best[start] == -np.inf:
                continue
            s, at = 0, start
            while at < n:
                t = int(base[s]) + data[at]
                if check[t] != s:
                    break
                s, at = t, at + 1
                if value[s] >= 0 and best[start] + self.score[value[s]] > best[at]:
                    best[at], back[at] = best[start] + self.score[value[s]], (start, int(value[s]))
            if data[start:end].decode("utf-8", "surrogateescape") not in self.whole_chars and best[start] + self.fallback > best[end]:
                best[end], back[end] = best[start] + self.fallback, (start, -1)
        out, at = [], n
        while at:
            start, piece = back[at]
            out.append([piece] if piece >= 0 else self.byte_id[list(data[start:at])].tolist())
            at = start
        return [i for ids in reversed(out) for i in ids]

    def segment_all(self, stretches: list[str]) -> list[bytes]:
        """Ids of many stretches, as little-endian 32-bit integers, all searched in step."""
        data = [s.encode("utf-8", "surrogateescape") for s in stretches]
        out: list[bytes] = [b""] * len(data)
        size = np.array([len(d) for d in data])
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= LANE]
        for i in order[len(short) :]:
            out[i] = np.array(self.segment(stretches[i]), "<i4").tobytes()
        at = 0
        while at < len(short):
            # Lanes of like length together, for little padding.
            top = max(4, int(size[short[at]] * 1.25))
            end = min(int(np.searchsorted(size[short], top, "right")), at + 16384)
            lanes = short[at:end]
            for i, ids in zip(lanes, self._lanes([data[i] for i in lanes], size[lanes]), strict=True):
                out[i] = ids
            at = end
        return out

    def _lanes(self, data: list[bytes], size: np.ndarray) -> list[bytes]:
        m, n = len(data), int(size.max())
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        text = np.zeros((m, n + 1), np.uint8)
        text[np.repeat(np.arange(m), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(data), np.uint8)
        best = np.full((n + 1, m), -np.inf)
        back, piece = np.zeros((n + 1, m), np.int16), np.full((n + 1, m), -1, np.int32)
        best[0] = 0
        lead = (text & 0xC0) != 0x80
        for start in range(n):
            lane = np.flatnonzero((size > start) & lead[:, start] & (best[start] > -np.inf))
            if not len(lane):
                continue
            from_here = best[start]
            state, live, at, covered = np.zeros(len(lane), np.int32), lane, start, np.zeros(m, bool)
            width = _width(text[lane, start])
            char_end = np.zeros(m, np.int64)
            char_end[lane] = start + width
            while len(live):
                t = base[state] + text[live, at]
                ok = (check[t] == state) & (size[live] > at)
                live, state = live[ok], t[ok]
                at += 1
                if not len(live):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    w, p = live[hit], v[hit]
                    covered[w[char_end[w] == at]] = True
                    new = from_here[w] + self.score[p]
                    up = new > best[at, w]
                    w, p = w[up], p[up]
                    best[at, w], back[at, w], piece[at, w] = new[up], start, p
            lone = lane[~covered[lane]]
            if len(lone):
                end = np.minimum(char_end[lone], size[lone])
                new = from_here[lone] + self.fallback
                up = new > best[end, lone]
                w, end = lone[up], end[up]
                best[end, w], back[end, w], piece[end, w] = new[up], start, -1
        return self._trace(text, size, back, piece)

    def _trace(self, text: np.ndarray, size: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        m = len(size)
        lanes, at = np.arange(m), size.astype(np.int64)
        # Ids from the last to the first; a fallback takes as many places as it has bytes.
        ids, length = np.zeros((m, int(size.max())), "<i4"), np.zeros(m, np.int64)
        while len(lanes):
            p, start = piece[at, lanes], back[at, lanes].astype(np.int64)
            known = p >= 0
            ids[lanes[known], length[lanes[known]]] = p[known]
            length[lanes[known]] += 1
            for k in np.flatnonzero(~known):
                i = lanes[k]
                for b in text[i, start[k] : at[k]][::-1]:
                    ids[i, length[i]] = self.byte_id[b]
                    length[i] += 1
            more = start > 0
            lanes, at = lanes[more], start[more]
        return [ids[i, :n][::-1].tobytes() for i, n in enumerate(length.tolist())]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The stretches of an escaped text, a slice at a time."""
        if not self.parted:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            if end < len(text):
                space = text.find("\n", end)
                end = len(text) if space < 0 else space
            yield STRETCH.findall(text, at, end)
            at = end

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; new stretches of about SLICE characters are segmented together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            new = set().union(*(found for _, found in held)).difference(cache)
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = set().union(*(found for _, found in held))
            fresh = list(new)
            cache.update(zip(fresh, self.segment_all(fresh), strict=True))
            for k, found in held:
                out[k].append(b"".join(map(cache.__getitem__, found)))
            held.clear()
            size = 0

        for k, text in enumerate(texts):
            if text:
                for found in self.stretches(" " + text):
                    held.append((k, found))
                    size += len(found) * 6
                    if size >= SLICE:
                        settle()
        settle()
        return [b"".join(x) for x in out]

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.bytes_of.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


def _chars(data: bytes) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(data) + 1):
        if i == len(data) or data[i] & 0xC0 != 0x80:
            yield start, i
            start = i


def _width(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def _texts(column: pa.Array) -> list[str | None]:
    data, offsets = column_bytes(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "surrogateescape") if valid[k] else None for k in range(len(column))]


def _encoder(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}
        for batch in batches:
            texts = _texts(batch.column(1))
            ids = model.encode([t or "" for t in texts], cache)
            valid = [t is not None for t in texts]
            count = np.array([len(x) // 4 for x in ids], np.int64)
            where = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(where, pa.array(np.frombuffer(b"".join(ids), "<i4")), mask=pa.array([not v for v in valid]))
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, crc], ["key", "ids", "ids_crc32"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, ids_crc32) for every row of docs(key, text, ...); the crc is of the ids as little-endian 32-bit integers."""
    plain = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return map_arrow(plain, _encoder(PieceModel(path)), f"key {kind}, ids array<int>, ids_crc32 bigint").withColumnRenamed("key", key)


def _decoder(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.binary())], [*names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(..., ids array<int>) with the text as UTF-8 bytes in place of the ids."""
    rest = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "decoded binary"])
    return map_arrow(encoded, _decoder(PieceModel(path)), schema)


def _coder(model: PieceModel):
    """Encode, decode what came out, and say what that is; one worker for both."""
    encoder = _encoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoder(batches):
            sizes, digests = [], []
            for ids in batch.column(1):
                text = model.decode(ids.values.to_numpy().tolist()) if ids.is_valid else b""
                sizes.append(len(text))
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "n_bytes", "decoded_sha256"])

    return run


def encoded_corpus(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, n_bytes, decoded_sha256) for every row of docs, the last two of what the ids decode to."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = map_arrow(plain, _coder(PieceModel(path)), "key bigint, ids array<int>, ids_crc32 bigint, n_bytes bigint, decoded_sha256 string")
    return done.select(F.col("key").alias("doc_id"), "ids", F.size("ids").cast("bigint").alias("n_tokens"), "ids_crc32", "n_bytes", "decoded_sha256")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The same without the ids."""
    return encoded_corpus(docs, path).drop("ids")
