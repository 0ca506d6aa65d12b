"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its byte trigrams (hashed, case kept, digits as one) and a few habits of its words: repeating the last
word or the one before it, capitals only, marks without letters, marks behind letters, the same line again. Term
frequencies (square roots of shares, weighted by inverse document frequency) are projected on the leading singular
vectors of a bounded, labelled sample. The projected labelled vectors are broadcast: `SAMPLE` rows for each label at most,
times `RANK` floats, under 3 MB. Each document then takes exact cosine products with all of them, in blocks, and its
`NEIGHBOURS` nearest vote for their label, weighted by a power of the similarity; labels are weighted to count alike.

The score is the vote for label 1, shrunk towards one half for texts with little similarity to anything known. Defined
results: null and empty texts have no vector and score 0.5. Equal texts score alike. Ties among neighbours go to the
earlier labelled row. If no labels are there, every text scores 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_blocks, words, written

#: Labelled rows that a fit may use for each label, the first by hash of their id.
SAMPLE = 2000
RANK = 64
NEIGHBOURS = 31
BUCKETS = 4096
HABITS = 8
#: How much the habits' shares count beside the trigrams'.
HABIT_WEIGHT = 3.0
POWER = 8
ROWS = 256

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 124, 126]] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of terms of each text: rows x (BUCKETS + HABITS), float32."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS + HABITS), np.float32)
    if len(data) >= 3:
        x = _CLASS[data].astype(np.uint32)
        code = ((((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        lengths = np.maximum(np.diff(offsets) - 2, 0)
        owner = np.repeat(np.arange(n), lengths)
        at = np.arange(lengths.sum()) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        total = np.bincount(owner * BUCKETS + code[at], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, :BUCKETS] = total / np.maximum(lengths, 1)[:, None]
    found, owner, start = words(data, offsets, lower=False)
    if not len(found):
        return out
    many = np.maximum(np.bincount(owner, minlength=n), 1)
    ends = np.append(start[1:], len(data))
    letters, small, marks = (np.concatenate(([0], np.cumsum(mask[data]))) for mask in (_LETTER, _SMALL, _MARK))
    a, b, m = letters[ends] - letters[start], small[ends] - small[start], marks[ends] - marks[start]
    same = np.zeros((2, len(found)), bool)
    for k in (1, 2):
        same[k - 1, k:] = (found[k:] == found[:-k]) & (owner[k:] == owner[:-k])
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[start] + owner
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    lines = np.add.reduceat(found * (np.arange(len(found), dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, len(found)))).astype(np.uint64) + np.uint64(1)), heads)
    size = np.diff(np.append(heads, len(found)))
    key = lines ^ (owner[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(heads), bool)
    again[first] = False
    for k, hit in enumerate((same[0], same[1], (a > 1) & (b == 0), (a == 0) & (m > 0), (a > 0) & (m > 0), (a == 0) & (m == 0))):
        out[:, BUCKETS + k] = np.bincount(owner, weights=hit, minlength=n) / many
    out[:, BUCKETS + 6] = np.bincount(owner[heads], weights=np.where(again, size, 0), minlength=n) / many
    _, at = np.unique(found ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out[:, BUCKETS + 7] = np.maximum(0, 0.5 - np.bincount(owner[at], minlength=n) / many)
    return out


@dataclass
class Model:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray

    def project(self, shares: np.ndarray) -> np.ndarray:
        x = np.sqrt(shares) * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        y = x @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        texts = texts.fill_null("")
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), ROWS):
            part = texts.slice(at, ROWS)
            for first, end, data, offsets in text_blocks(part):
                shares = np.zeros((ROWS, BUCKETS + HABITS), np.float32)  # always as many rows: a product's last bits don't hang on a row's neighbours
                shares[: end - first] = counts(data, offsets)
                near = (self.project(shares) @ self.vectors.T)[: end - first]
                order = np.argpartition(-near, k - 1, axis=1)[:, :k]
                cosine = np.maximum(np.take_along_axis(near, order, 1), 0).astype(np.float64)
                w = cosine**POWER * self.votes[order]
                good = (w * self.labels[order]).sum(1)
                prior = 0.02 * self.votes.mean()
                out[at + first : at + end] = np.where(np.diff(offsets) > 0, (good + prior) / (w.sum(1) + 2 * prior), 0.5)
        return out


def _basis(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    rng = np.random.default_rng(7)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, :rank]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, rank: int = RANK, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most `sample` labelled rows of each label (0 or 1), the first by hash of the id.

    The chosen ids are few and broadcast, so the texts aren't shuffled; rows without text are left out.
    """
    ranked = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(label).cast("int").alias("label"), F.xxhash64(doc_id, F.lit(5)).alias("h"), F.col(doc_id).alias("chosen")).distinct()
    chosen = written(ranked.where("label = 0").orderBy("h", "chosen").limit(sample).union(ranked.where("label = 1").orderBy("h", "chosen").limit(sample)), "chosen")
    found = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("chosen"), F.col(text).alias("text")).join(F.broadcast(chosen), "chosen")
    found = written(found, "labelled")
    shares, kinds = [], []
    for value in (0, 1):
        batch: list[str] = []
        for r in [*found.where(F.col("label") == value).orderBy("h", "chosen", "text").limit(sample).select("text").toLocalIterator(), None]:
            if r is not None:
                batch.append(r[0])
            if batch and (r is None or len(batch) == ROWS):
                shares += [counts(d, o) for _, _, d, o in text_blocks(pa.array(batch))]
                kinds += [value] * len(batch)
                batch = []
    if not kinds:
        none = np.zeros((0, rank), np.float32)
        return Model(np.ones(BUCKETS + HABITS, np.float32), np.zeros((BUCKETS + HABITS, rank), np.float32), none, np.zeros(0), np.zeros(0))
    x, y = np.concatenate(shares), np.array(kinds)
    del shares
    weight = np.log1p(len(x) / (1.0 + (x > 0).sum(0))).astype(np.float32)
    weight[BUCKETS:] = HABIT_WEIGHT
    x = np.sqrt(x, out=x)
    x *= weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = _basis(x, min(rank, *x.shape))
    v = x @ basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    share = np.array([max((y == 0).mean(), 1e-9), max((y == 1).mean(), 1e-9)])
    return Model(weight, basis, v.astype(np.float32), y.astype(np.float64), 0.5 / share[y])


def score(model: Model, spark, text: Column) -> Column:
    """The score of each text, as a column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return scored(text)
