"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: words, and 1- to 3-grams of word shapes (final character's
class, capitals, equal to the word before). Each indicator is scaled by the log-ratio of its smoothed
class counts, each vector by its length; a linear L2-loss hinge model is fitted by dual coordinate
descent; its margins become scores by a sigmoid fitted on rows kept out of the descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlens.llm.textkernel import U, Words, as_text, chunks, mix, release, released, words

#: Classes of a word's last byte: 0 letters and all else, 1 stops and commas, 2 ! and ?, 3 |, 4 marks, 5 digits.
_LAST = np.zeros(256, np.int64)
for _class, _chars in enumerate(("", ".,;:", "!?", "|", "#$%&*@^~=+_<>{}[]\\/`", "0123456789")):
    _LAST[[ord(c) for c in _chars]] = _class
_CODES = 24


def shapes(w: Words) -> np.ndarray:
    """A small code for each word."""
    last = _LAST[w.raw[w.end - 1]]
    upper = (w.raw >= 65) & (w.raw <= 90)
    caps = upper[w.start] & upper[np.minimum(w.start + 1, w.end - 1)] & (w.end - w.start > 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return last * 4 + caps * 2 + same


def features(w: Words, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every indicator that is set, in order, without repeats."""
    code = shapes(w).astype(U) if len(w.hash) else np.zeros(0, U)
    found = [(w.doc, w.hash)]
    gram = np.zeros(len(code), U)
    for order in range(1, 4):
        if len(code) < order:
            break
        gram = gram[: len(code) - order + 1] * U(_CODES) + code[order - 1 :] + U(1)
        inside = w.doc[: len(gram)] == w.doc[order - 1 :]
        found.append((w.doc[: len(gram)][inside], mix(gram[inside], 40 + order)))
    doc = np.concatenate([d for d, _ in found])
    key = np.unique(doc.astype(np.int64) * dims + (np.concatenate([h for _, h in found]) & U(dims - 1)).astype(np.int64))
    return key // dims, key % dims


@dataclass
class QualityModel:
    dims: int
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, w: Words) -> np.ndarray:
        n = len(w.offsets) - 1
        doc, f = features(w, self.dims)
        r = self.ratio[f]
        norm = np.sqrt(np.bincount(doc, r * r, n))
        return np.bincount(doc, r * self.weight[f], n) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, w: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(w) + self.offset, -35, 35)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dims: int, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i)^2 over sparse rows (index, value)."""
    w, alpha = np.zeros(dims), np.zeros(len(rows))
    diagonal = 0.5 / cost
    square = np.array([v @ v for _, v in rows]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v) - 1 + diagonal[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            new = max(alpha[i] - slope / square[i], 0.0)
            w[at] += (new - alpha[i]) * y[i] * v
            alpha[i] = new
        if worst < 1e-3:
            break
    return w


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (b - [1, 0]))
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(texts: list[np.ndarray], label: np.ndarray, dims: int, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 20) -> QualityModel:
    """Fit on rows of feature indices with labels 0 and 1. With one class only, the score is that class's share."""
    label = np.asarray(label)
    if len(set(label.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return QualityModel(dims, np.zeros(dims), np.zeros(dims), 0.0, 1.0, float(np.log(share / (1 - share))))
    count = np.full((2, dims), smoothing)
    for t, y in zip(texts, label, strict=True):
        count[y, t] += 1  # a text's features don't repeat
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[(count[0] + count[1]) <= 2 * smoothing] = 0.0
    y = np.where(label == 1, 1.0, -1.0)
    rows = []
    for t in texts:
        v = ratio[t]
        rows.append((np.r_[t, dims].astype(np.int32), np.r_[v / max(float(np.sqrt(v @ v)), 1e-12), 1.0].astype(np.float32)))
    weight_of = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * cost
    kept_out = np.arange(len(y)) % 5 == 4
    inner = np.flatnonzero(~kept_out) if len(set(y[kept_out])) == 2 == len(set(y[~kept_out])) else np.arange(len(y))
    outer = np.flatnonzero(kept_out) if len(inner) < len(y) else inner
    w = dual_coordinate_descent([rows[i] for i in inner], y[inner], weight_of[inner], dims + 1, epochs)
    slope, offset = _sigmoid(np.array([w[rows[i][0]] @ rows[i][1] for i in outer]), y[outer])
    return QualityModel(dims, ratio.astype(np.float32), w[:dims].astype(np.float32), float(w[dims]), slope, offset)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _feature_rows(dims: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text = as_text(batch.column(2))
            for lo, hi in chunks(text):
                doc, f = features(words(text.slice(lo, hi - lo)), dims)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                cells = [f[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(cells, pa.binary())], names=["doc_id", "label", "f"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, dims: int = 1 << 18, max_rows: int = 12_000, max_bytes: int = 64 << 20, label: str = "quality") -> QualityModel:
    """Fit on labelled rows outside the held-out fold.

    About ``max_rows`` labels at most, chosen by a hash of doc_id, and of their documents' rows about as
    many, with about ``max_bytes`` of text, chosen by a hash of id and text, take part; that bounds the
    broadcast join and the driver's memory. Labels that are null or neither 0 nor 1 and null ids are
    left out; repeated rows count each time. Without labelled rows every score is one half.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, max_rows / max(rows.count(), 1))
    rows = rows.groupBy("doc_id", "label").agg(F.count("*").alias("times")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text.join(F.broadcast(rows), "doc_id").withColumn("times", F.sequence(F.lit(1), F.least("times", F.lit(max_rows)).cast("int"))).select("doc_id", "label", "text", F.explode("times").alias("time"))
    many, size = found.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    share = min(1.0, max_rows / max(many, 1), max_bytes / max(size or 0, 1))
    found = found.filter(F.pmod(F.xxhash64("doc_id", "text", "time"), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "label", "text")
    got = sorted(found.mapInArrow(_feature_rows(dims), "doc_id long, label int, f binary").collect(), key=lambda r: (r.doc_id, r.label, len(r.f), bytes(r.f)))
    model = fit([np.frombuffer(r.f, np.int32) for r in got], np.array([r.label for r in got], int), dims)
    del got
    release()
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with two more columns: score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Whole texts are scored; null and empty texts get the score of a text without features. Other
    columns pass through; columns already called ``score`` or ``predicted`` are replaced.
    """
    docs = docs.drop(score, predicted)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text = as_text(batch.column(at).cast(pa.string()))
            s = np.concatenate([np.zeros(0), *(model.scores(words(text.slice(lo, hi - lo))) for lo, hi in chunks(text))])
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, score, predicted])

    return docs.mapInArrow(run, schema)
