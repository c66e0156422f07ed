"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes, every passage of the whole text among them. Each passage becomes
a feature vector (frequencies of byte-class pairs, repeats of recent words), an encoder layer h, and a gated attention
weight a = softmax(w . (tanh(V h) * sigmoid(U h))); the document's score is a logistic function of sum(a h). Encoder,
gates and output are learned together from document labels alone, by Adam on a bounded sample of labelled documents: the
SAMPLE least by hash of doc_id, of those the ones that fit, in that order, into FIT_PASSAGES passages in all, where no one
takes more than a FIT_SHARE-th. The bounds take rows or leave them: of each row learned from, every passage is encoded.

Nulls and empty texts: one passage of zeros, so the same score for all. Rows repeated under one doc_id are scored each. Ties
on the sample's hash go to the lesser doc_id. Long texts: all passages are scored, a segment at a time. An empty table gives
no rows. Other columns of docs are never read, and keep_good packs a row into one struct, so their names cannot clash. Labels that are null, not 0 or 1, or that
contradict one another for one doc_id are not learned from; without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import map_arrow, written
from quire.llm.words import column_bytes, hash_words, segments, word_spans

PASSAGE = 512
SAMPLE, FIT_PASSAGES, FIT_SHARE = 2500, 400_000, 10
THRESHOLD = 0.7
HIDDEN, GATE, EPOCHS, RATE, BATCH = 24, 12, 14, 0.01, 64
LAGS = (1, 2, 3, 4)


def _classes() -> tuple[np.ndarray, int]:
    table = np.zeros(256, np.int64)
    groups = [b" ", b"\n\r\t\v\f", b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"AEIOUYBCDFGHJKLMNPQRSTVWXZ", b"0123456789", b".,;:", b"!?", b"\"'()[]{}", b"#$%&*@^~", b"|_<>=+-/\\`", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
    for i, g in enumerate(groups, 1):
        table[list(g)] = i
    return table, len(groups) + 1


CLASS, CLASSES = _classes()
FEATURES = CLASSES * CLASSES + len(LAGS) + 1


def passages(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, passage count of each, feature matrix) for runs of rows of a text column."""
    data, offsets = column_bytes(column)
    for i, j in segments(offsets):
        lo, bounds = offsets[i], offsets[i : j + 1] - offsets[i]
        part = data[lo : offsets[j]]
        sizes = np.diff(bounds)
        counts = np.maximum(1, -(-sizes // PASSAGE))
        first = np.concatenate([[0], np.cumsum(counts)])
        total = int(first[-1])
        x = np.zeros((total, FEATURES), np.float32)
        if len(part):
            row = np.repeat(np.arange(j - i), sizes)
            at = first[row] + (np.arange(len(part)) - bounds[row]) // PASSAGE
            kinds = CLASS[part]
            pair = kinds[:-1] * CLASSES + kinds[1:]
            inside = row[:-1] == row[1:]
            grams = np.bincount(at[:-1][inside] * (CLASSES * CLASSES) + pair[inside], minlength=total * CLASSES * CLASSES).reshape(total, -1)
            held = np.bincount(at, minlength=total)
            x[:, : CLASSES * CLASSES] = np.sqrt(grams / np.maximum(1, held)[:, None])
            words, where = hash_words(part, bounds)
            if len(words):
                starts, _ = word_spans(part, bounds)
                of = at[starts]
                doc = np.repeat(np.arange(j - i), np.diff(where))
                n = np.maximum(1, np.bincount(of, minlength=total))
                for k, lag in enumerate(LAGS):
                    same = np.zeros(len(words), bool)
                    same[lag:] = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag])
                    x[:, CLASSES * CLASSES + k] = np.bincount(of, weights=same, minlength=total) / n
            x[:, -1] = np.log1p(held) / 7
        yield i, j, counts, x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gated attention and output layer; parameters are plain arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        put = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": put(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": put(HIDDEN, GATE), "U": put(HIDDEN, GATE), "w": put(GATE, 1), "c": put(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        doc = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((t * g) @ p["w"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": _sigmoid(z @ p["c"] + p["d"])[:, 0], "doc": doc, "at": at}

    def gradients(self, f: dict, y: np.ndarray) -> dict:
        p, doc = self.p, f["doc"]
        ds = (f["s"] - y)[:, None] / len(y)
        dz = ds @ p["c"].T
        dh = f["a"][:, None] * dz[doc]
        da = (f["h"] * dz[doc]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[doc])
        dtg = de[:, None] * p["w"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = dh + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de[:, None], "c": f["z"].T @ ds, "d": ds.sum(0)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 11) -> AttentionModel:
        r = np.random.Generator(np.random.PCG64(seed))
        first = np.concatenate([[0], np.cumsum(counts)])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH):
                take = order[i : i + BATCH]
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in take])
                grad = self.gradients(self.forward(x[rows], counts[take]), y[take])
                step += 1
                for k, d in grad.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fold(doc_id, parts: int):
    """crc32 of the doc_id's text modulo the number of folds; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], []]
        for _, _, counts, x in passages(batch.column(1)):
            at = np.concatenate([[0], np.cumsum(counts)])
            for k, n in enumerate(counts.tolist()):
                out[0].append(n)
                out[1].append(x[at[k] : at[k + 1]].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["y", "n", "x"])


def train(docs: DataFrame, labels: DataFrame, held_fold: int | None = 2, folds: int = 4, sample: int = SAMPLE, fit_passages: int = FIT_PASSAGES) -> AttentionModel | None:
    """Fit on at most `sample` labelled documents outside the held-out fold, of `fit_passages` passages in all; None without
    labels of both kinds. All passages of each reach the driver, as vectors; 400,000 are 140 MB."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held_fold is not None:
        usable = usable.where(fold("id", folds) != held_fold)
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # Rows repeated under one doc_id teach once, by the least of their texts.
    texts = written(texts.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")), "quality-sample")
    # Which rows fit is decided on their sizes alone: at most `sample` pairs of numbers in one task.
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    sizes = texts.select("id", n.alias("n")).where(F.col("n") <= fit_passages // FIT_SHARE)
    fits = sizes.withColumn("all", F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))).where(F.col("all") <= fit_passages).select("id")
    rows = map_arrow(texts.join(F.broadcast(fits), "id", "left_semi").select("y", "text"), _features, "y int, n int, x binary").collect()
    y = np.array([r.y for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    # The same order whatever the partitions were.
    rows.sort(key=lambda r: (r.n, bytes(r.x), r.y))
    x = np.concatenate([np.frombuffer(r.x, np.float16).reshape(r.n, FEATURES) for r in rows]).astype(np.float32)
    return AttentionModel().fit(x, np.array([r.n for r in rows]), np.array([r.y for r in rows], np.float32))


def _scorer(model: AttentionModel | None):
    """Score the last column of each batch and hand on the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                for i, j, counts, x in passages(batch.column(1)):
                    score[i:j] = model.forward(x, counts)["s"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["key", "score"])

    return run


def quality_scores(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text, ...)."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, _scorer(model), "key bigint, score double").withColumnRenamed("key", "doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    scored = quality_scores(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their own columns; all rows where nothing can be learned."""
    model = train(docs, labels)
    if model is None:
        return docs
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.col("text").cast("string").alias("text"))
    schema = StructType([wide.schema["key"], StructField("score", DoubleType())])  # names of columns may hold what DDL would not take
    return map_arrow(wide, _scorer(model), schema).where(F.col("score") >= THRESHOLD).select("key.*")
