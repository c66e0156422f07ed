"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword of CODE_BITS bits; one logistic classifier per bit, over square-rooted frequencies of
hashed byte trigrams of the lower-cased text, predicts it. Decoding weighs each classifier's loss by how well it did on
the learning documents of the language in question and takes the nearest codeword; a document is flagged ambiguous
where the two nearest are closer than MARGIN.

Learned from a bounded sample: about QUOTA documents of each language (SAMPLE in all), chosen by hash of doc_id, of
each its whole text. Text that is null or has no letter: `und`, score 0. Without anything learned: `und` too. Rows repeated
under one doc_id are answered each. Ties between codewords go to the language that comes first by name. Long texts are
counted whole, a segment at a time. An empty table gives no rows. Other columns of docs are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow
from quire.llm.quality import fold
from quire.llm.words import LOWER, column_bytes, segments

DIM = 4096
CODE_BITS = 15
QUOTA, SAMPLE = 800, 6400
MARGIN = 0.5
STEPS, RATE, DECAY = 60, 0.08, 1e-5

#: Bytes as the n-grams see them: letters in lower case, UTF-8 bytes as they are, all else a space.
SEEN = LOWER.copy()
SEEN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, counts[rows, DIM]) for runs of rows of a text column."""
    data, offsets = column_bytes(column)
    for i, j in segments(offsets):
        for a in range(i, j, 512):
            b = min(j, a + 512)
            lo, bounds = offsets[a], offsets[a : b + 1] - offsets[a]
            s = SEEN[data[lo : offsets[b]]].astype(np.uint32)
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            if len(s) < 3:
                yield a, b, np.zeros((b - a, DIM), np.float32)
                continue
            h = (s[:-2] * np.uint32(0x9E3779B1)) ^ (s[1:-1] * np.uint32(0x85EBCA6B)) ^ (s[2:] * np.uint32(0xC2B2AE35))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
            inside = row[:-2] == row[2:]
            yield a, b, np.bincount(row[:-2][inside] * DIM + h[inside].astype(np.int64), minlength=(b - a) * DIM).reshape(b - a, DIM).astype(np.float32)


def _normal(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def codewords(classes: int, bits: int = CODE_BITS, seed: int = 5) -> np.ndarray:
    """+1/-1 codewords, rows of the best of many random draws by least distance; no column is constant."""
    if classes == 1:
        return np.ones((1, 1), np.int8)
    bits = max(bits, 4 * int(np.ceil(np.log2(classes))))
    r = np.random.Generator(np.random.PCG64(seed))
    best, best_least = None, -1
    for _ in range(200):
        m = np.where(r.random((classes, bits)) < 0.5, 1, -1).astype(np.int8)
        for b in np.flatnonzero(np.abs(m.sum(0)) == classes):
            m[r.integers(classes), b] *= -1
        gap = (bits - m.astype(int) @ m.T.astype(int)) // 2
        least = int(gap[np.triu_indices(classes, 1)].min())
        if least > best_least:
            best, best_least = m, least
    return best


class CodeModel:
    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        target = self.code[y].astype(np.float32)
        w = np.zeros((DIM, target.shape[1]), np.float32)
        bias = np.zeros(target.shape[1], np.float32)
        share = 1 / np.bincount(y, minlength=len(langs))[y].astype(np.float32)
        share /= share.sum()
        m, v, mb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias)
        for step in range(1, STEPS + 1):
            d = -target / (1 + np.exp(np.clip(target * (x @ w + bias), -30, 30))) * share[:, None]
            g = x.T @ d + DECAY * w
            m, v, mb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * d.sum(0)
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            bias = bias - mb
        self.w, self.bias = w.astype(np.float32), bias.astype(np.float32)
        right = (x @ self.w + self.bias) * target > 0
        weight = np.stack([right[y == c].mean(0) for c in range(len(langs))]) + 1e-6
        self.weight = (weight / weight.sum(1, keepdims=True) * self.code.shape[1]).astype(np.float32)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row of counts."""
        f = _normal(counts) @ self.w + self.bias
        z = self.code[None] * f[:, None, :]
        loss = (self.weight[None] * np.logaddexp(0, -z)).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        two = np.sort(loss, 1)[:, :2]
        return loss.argmin(1), p.max(1) / p.sum(1), (two[:, 1] - two[:, 0] < MARGIN) if loss.shape[1] > 1 else np.zeros(len(f), bool)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [row.clip(0, 65535).astype(np.uint16).tobytes() for _, _, c in grams(batch.column(1)) for row in c]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])


def train(docs: DataFrame, held_fold: int | None = 1, folds: int = 3) -> CodeModel | None:
    """Fit on a bounded sample of the documents that have a language and a letter and are not held out."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    if held_fold is not None:
        known = known.where(fold("id", folds) != held_fold)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    quota = max(20, min(QUOTA, SAMPLE // len(sizes)))
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40))
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < int((1 << 40) * min(1.0, quota / n))))
    # Rows repeated under one doc_id and language teach once, by the least of their texts.
    once = known.where(chosen).where(F.col("text").rlike(r"\p{L}")).groupBy("lang", "id").agg(F.min("text").alias("text"))
    rows = map_arrow(once.select("lang", "text"), _counted, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    x = _normal(np.stack([np.frombuffer(r["x"], np.uint16) for r in rows]).astype(np.float32))
    return CodeModel(langs, x, np.array([langs.index(r["lang"]) for r in rows]))


def _predictor(model: CodeModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, unsure = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model is not None:
                lettered = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
                for i, j, counts in grams(batch.column(1)):
                    k, s, u = model.decode(counts)
                    on = lettered[i:j]
                    lang[i:j][on] = np.array(model.langs, object)[k[on]]
                    score[i:j][on], unsure[i:j][on] = s[on], u[on]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of docs(doc_id, text, ...)."""
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return map_arrow(plain, _predictor(model), "id bigint, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", "doc_id")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learned from the rows of docs outside fold 1 of 3."""
    return identify(docs, train(docs)).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
