"""A factorisation machine that scores text quality.

Features are hashed words (share of the text's words), structure statistics and
metadata of the text itself (its length). Pairs of features interact through
low-rank factors; the sum over all pairs is half the difference of the squared
sum and the sum of squares, so a text is scored in time linear in its features.
Training runs in numpy on a bounded sample of labelled rows.

Defined cases: a null text is empty; an empty text is scored by the intercept
and the structure statistics. Without labels every score is 0.5. Rows with a
null id, repeated rows and extra columns are ordinary; a document with several
labels is learnt once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, per_row

BUCKETS = 4096
FACTORS = 8
#: Labelled rows that are learnt from, about; chosen by hash of the id.
LEARN_ROWS = 8000
EPOCHS = 12
BATCH = 256
RATE = 0.05
DECAY = 1e-4
SEED = 7
THRESHOLD = 0.7
#: Words whose bucket a Python worker remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 1_000_000

_known: dict[bytes, int] = {}
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:", b"!?", b"\n", b"@/\\_=+-")


def _bucket(word: bytes) -> int:
    import zlib

    return zlib.crc32(word.lower()) % BUCKETS


@dataclass
class Features:
    """Hashed words as (row, bucket, share); statistics as a dense matrix."""

    rows: np.ndarray
    buckets: np.ndarray
    shares: np.ndarray
    stats: np.ndarray


def featurize(texts: list[bytes | None]) -> Features:
    if len(_known) > REMEMBERED_WORDS:
        _known.clear()
    count = len(texts)
    split = [t.split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, count)
    for words in split:
        for w in set(words).difference(_known):
            _known[w] = _bucket(w)
    hashed = np.concatenate([np.fromiter(map(_known.__getitem__, words), np.int64, len(words)) for words in split]) if count else np.zeros(0, np.int64)
    keys, times = np.unique(np.repeat(np.arange(count), sizes) * BUCKETS + hashed, return_counts=True)
    rows, buckets = np.divmod(keys, BUCKETS)
    shares = times / np.maximum(sizes, 1)[rows]
    texts = [t or b"" for t in texts]
    length = np.fromiter(map(len, texts), np.float64, count)
    classes = np.array([[len(t) - len(t.translate(None, c)) for c in _CLASSES] for t in texts], float).reshape(count, len(_CLASSES))
    distinct = np.fromiter((len(set(w)) for w in split), np.float64, count)
    pairs = np.fromiter((len(set(zip(w, w[1:]))) for w in split), np.float64, count)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.float64, count)
    own_lines = np.fromiter((len(set(x)) for x in lines), np.float64, count)
    most = per_row(shares**2, rows, count)
    stats = np.column_stack([
        np.sqrt(classes / np.maximum(length, 1)[:, None]),
        np.log1p(length) / 10,
        np.log1p(sizes) / 10,
        np.minimum(length / np.maximum(sizes, 1), 20) / 20,
        distinct / np.maximum(sizes, 1),
        pairs / np.maximum(sizes - 1, 1),
        own_lines / np.maximum(n_lines, 1),
        np.sqrt(most),
        length == 0,
    ])
    return Features(rows, buckets, shares, stats)


STATISTICS = len(_CLASSES) + 8


@dataclass
class FactorizationMachine:
    intercept: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    word_scale: float

    def margin(self, f: Features) -> np.ndarray:
        """Linear part plus all pairs: (squared sum - sum of squares) / 2."""
        n = len(f.stats)
        dense = np.clip((f.stats - self.centre) / self.scale, -6, 6)
        x = f.shares * self.word_scale
        v, u = self.factors[f.buckets], self.factors[BUCKETS:]
        out = self.intercept + dense @ self.linear[BUCKETS:] + np.bincount(f.rows, weights=x * self.linear[f.buckets], minlength=n)
        for k in range(self.factors.shape[1]):
            xv = x * v[:, k]
            sums = np.bincount(f.rows, weights=xv, minlength=n) + dense @ u[:, k]
            squares = np.bincount(f.rows, weights=xv**2, minlength=n) + dense**2 @ u[:, k] ** 2
            out += (sums**2 - squares) / 2
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(featurize(texts)), -40, 40)))


def fit(f: Features, labels: np.ndarray) -> FactorizationMachine:
    """Adagrad on the logistic loss, in mini-batches of dense rows; seeded."""
    random = np.random.default_rng(SEED)
    n, width = len(labels), BUCKETS + f.stats.shape[1]
    centre, scale = f.stats.mean(0), f.stats.std(0) + 1e-6
    word_scale = 4.0
    dense = np.clip((f.stats - centre) / scale, -6, 6)
    starts = np.searchsorted(f.rows, np.arange(n + 1))
    linear, factors = np.zeros(width), random.normal(0, 0.02, (width, FACTORS))
    intercept = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    g_linear, g_factors, g_intercept = np.full(width, 1e-6), np.full((width, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            pick = order[at : at + BATCH]
            x = np.zeros((len(pick), width))
            for i, r in enumerate(pick):
                s = slice(starts[r], starts[r + 1])
                x[i, f.buckets[s]] = f.shares[s] * word_scale
            x[:, BUCKETS:] = dense[pick]
            sums = x @ factors
            margin = intercept + x @ linear + ((sums**2).sum(1) - ((x**2) @ (factors**2)).sum(1)) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[pick]) / len(pick)
            d_linear = x.T @ error + DECAY * linear
            d_factors = x.T @ (error[:, None] * sums) - ((x**2).T @ error)[:, None] * factors + DECAY * factors
            d_intercept = error.sum()
            g_linear += d_linear**2
            g_factors += d_factors**2
            g_intercept += d_intercept**2
            linear -= RATE * d_linear / np.sqrt(g_linear)
            factors -= RATE * d_factors / np.sqrt(g_factors)
            intercept -= RATE * d_intercept / np.sqrt(g_intercept)
    return FactorizationMachine(intercept, linear, factors, centre, scale, word_scale)


def train(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS) -> FactorizationMachine | None:
    """Learn from the texts of labels (doc_id, label 0/1), about learn_rows of them; features are made on the executors.

    The drawn labels alone are broadcast: learn_rows bounds them.
    """
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("label").cast("int"))
    share = min(1.0, learn_rows / max(1, labels.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 40)) / float(1 << 40)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            f = featurize(part.column("text").to_pylist())
            cuts = np.searchsorted(f.rows, np.arange(part.num_rows + 1))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists(f.buckets, pa.int32()), lists(f.shares, pa.float32()), pa.array(list(f.stats), pa.list_(pa.float64()))], names=["doc_id", "label", "buckets", "shares", "stats"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(labels.filter(draw < share)), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(features, "doc_id long, label int, buckets array<int>, shares array<float>, stats array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    labels = got.column("label").to_numpy().astype(float)
    if not len(labels) or labels.min() == labels.max():
        return None
    buckets, shares = got.column("buckets").combine_chunks(), got.column("shares").combine_chunks()
    rows_of = np.repeat(np.arange(len(labels)), buckets.value_lengths().to_numpy())
    return fit(Features(rows_of, buckets.flatten().to_numpy().astype(np.int64), shares.flatten().to_numpy().astype(float), np.array(got.column("stats").to_pylist())), labels)


def score(docs: DataFrame, model: FactorizationMachine | None, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; the text alone decides."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            s = shared.value.score(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
