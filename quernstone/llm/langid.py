"""Language identification by interpolated Kneser-Ney character models.

Each language's model is learnt from a bounded sample of labelled rows: counts
are gathered on the executors, discounts and interpolation weights follow in
numpy. Log-probabilities of every known n-gram lie beside its 64-bit hash in one
sorted array for each order, one column for each language; a text goes to the
language of the lowest cross-entropy per symbol. A second sample fits the
sharpness of the confidence and the cross-entropy beyond which a prediction
counts as rejected.

Defined cases: texts that are null or hold no letter are ``und`` with score 0,
and so is everything if no labelled row exists. Equal cross-entropies go to the
alphabetically first language. Rows are drawn by hash of id and text: repeated rows
are learnt once, rows that share an id, or have none, are different draws, and every
language with a row keeps one. Extra columns are ignored; no rows give no rows. A long
text is measured whole, in one numpy step, some 200 bytes a letter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, mix, per_row

ORDER = 4
#: Labelled rows for each language, about, that are learnt from and that calibrate.
LEARN_ROWS = 2000
CALIBRATE_ROWS = 400
#: Share of the calibration rows whose cross-entropy a prediction may not exceed.
ACCEPTED_SHARE = 0.995
UNKNOWN = "und"
SPACE = 32

#: Powers of the hash's multiplier, for each symbol back from the latest.
_POWERS = [np.uint64(pow(0x5851F42D4C957F2D, n, 1 << 64)) for n in range(ORDER)]


@cache
def _letters() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a space."""
    table = np.full(sys.maxunicode + 1, SPACE, np.int32)
    for i in range(0x40, sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def symbols(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, ORDER - 1 spaces before each; rows; where texts' symbols are."""
    plain = [t.decode("utf-8", "replace") if t else "" for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    codes = _letters()[np.frombuffer("".join(plain).encode("utf-32-le", "replace"), np.uint32)]
    rows = np.repeat(np.arange(len(plain)), sizes)
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    before = np.r_[np.int32(SPACE), codes[:-1]] if len(codes) else codes
    keep = (codes != SPACE) | ((before != SPACE) & ~first)
    codes, rows = codes[keep], rows[keep]
    out = np.full(len(codes) + (ORDER - 1) * len(plain), SPACE, np.int32)
    at = np.arange(len(codes)) + (ORDER - 1) * (rows + 1)
    out[at] = codes
    return out, rows, at


@cache
def _coded() -> np.ndarray:
    """A 64-bit hash for every code point."""
    return mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))


def hashes(coded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n symbols that end at each place; coded has the hash of every symbol."""
    h = coded[at]
    for back in range(1, n):
        h += coded[at - back] * _POWERS[back]
    return h


def _hash_rows(grams: np.ndarray) -> np.ndarray:
    """The same hashes for rows of symbols, the last column being the latest."""
    h = np.zeros(len(grams), np.uint64)
    for column, power in zip(grams.T[::-1], _POWERS, strict=False):
        h += _coded()[column] * power
    return h


class SortedHashes:
    """A sorted array of hashes; their leading bits tell where the search begins."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, np.uint64(np.iinfo(np.uint64).max)]
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        place = self.first[(keys >> self.shift).astype(np.int64)]
        got = self.keys[place]
        todo = np.flatnonzero(got < keys)
        known = got == keys
        while len(todo):
            place[todo] += 1
            got = self.keys[place[todo]]
            known[todo] = got == keys[todo]
            todo = todo[got < keys[todo]]
        return place, known


@dataclass
class KneserNey:
    """Sorted hashes and log-probabilities of n-grams, and of back-off weights of contexts, by order."""

    languages: list[str]
    grams: list[SortedHashes]
    logp: list[np.ndarray]
    contexts: list[SortedHashes | None]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    sharpness: float = 1.0
    limit: float = float("inf")

    def cross_entropy(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol by text and language; the number of letters of each text."""
        codes, rows, at = symbols(texts)
        coded = _coded()[codes]
        total = np.zeros((len(at), len(self.languages)), np.float32)
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            place, known = self.grams[n - 1].find(hashes(coded, at[todo], n))
            total[todo[known]] += self.logp[n - 1][place[known]]
            todo = todo[~known]
            if not len(todo):
                break
            if n > 1:
                place, known = self.contexts[n - 1].find(hashes(coded, at[todo] - 1, n - 1))
                total[todo[known]] += self.backoff[n - 1][place[known]]
            else:
                total[todo] += self.unseen
        count = np.bincount(rows, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        there = np.flatnonzero(count)
        if len(there):
            sums[there] = np.add.reduceat(total, (np.cumsum(count) - count)[there], axis=0, dtype=np.float64)
        return -sums / np.maximum(count, 1)[:, None], per_row((codes[at] != SPACE).astype(np.int64), rows, len(texts))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and rejection of each text."""
        entropy, letters = self.cross_entropy(texts)
        best = entropy.argmin(1)
        least = entropy.min(1)
        confidence = 1 / np.exp(np.minimum((least[:, None] - entropy) * self.sharpness, 0)).sum(1)
        none = letters == 0
        return [UNKNOWN if x else self.languages[k] for k, x in zip(best, none, strict=True)], np.where(none, 0.0, confidence), none | (least > self.limit)


def fit(counts: pd.DataFrame) -> KneserNey:
    """From counts (lang, c0..c3, n) of the longest n-grams."""
    languages = sorted(counts["lang"].unique())
    columns = [f"c{i}" for i in range(ORDER)]
    grams, inverse = np.unique(counts[columns].to_numpy(), axis=0, return_inverse=True)
    table = np.zeros((len(grams), len(languages)))
    np.add.at(table, (inverse.ravel(), counts["lang"].map(languages.index).to_numpy()), counts["n"].to_numpy(float))
    levels = [(grams, table)]
    for _ in range(ORDER - 1):  # shorter n-grams count the different symbols before them
        grams, table = levels[-1]
        shorter, inverse = np.unique(grams[:, 1:], axis=0, return_inverse=True)
        seen = np.zeros((len(shorter), len(languages)))
        np.add.at(seen, inverse.ravel(), (table > 0).astype(float))
        levels.append((shorter, seen))
    levels.reverse()
    model = KneserNey(languages, [], [], [None], [np.zeros((0, len(languages)), np.float32)], np.zeros(len(languages)))
    vocabulary = len(levels[0][0]) + 1
    lower = np.full((1, len(languages)), 1 / vocabulary)
    for n, (grams, table) in enumerate(levels, 1):
        once, twice = (table == 1).sum(0), (table == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        contexts, of = np.unique(grams[:, :-1], axis=0, return_inverse=True) if n > 1 else (np.zeros((1, 0), np.int64), np.zeros(len(grams), np.int64))
        of = of.ravel()
        totals, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(totals, of, table)
        np.add.at(kinds, of, (table > 0).astype(float))
        weight = np.where(totals > 0, discount * kinds / np.maximum(totals, 1), 1.0)
        if n > 1:
            shorter = _hash_rows(grams[:, 1:])
            below = lower[model.grams[-1].find(shorter)[0]]
            order = np.argsort(keys := _hash_rows(contexts))
            model.contexts.append(SortedHashes(keys[order]))
            model.backoff.append(np.log(weight[order]).astype(np.float32))
        else:
            below = lower
            model.unseen = np.log(weight[0] / vocabulary)
        p = np.maximum(table - discount, 0) / np.maximum(totals[of], 1) + weight[of] * below
        order = np.argsort(keys := _hash_rows(grams))
        model.grams.append(SortedHashes(keys[order]))
        lower = p[order]
        model.logp.append(np.log(lower).astype(np.float32))
    return model


def calibrate(model: KneserNey, entropy: np.ndarray, truth: np.ndarray) -> None:
    """Sharpness by likelihood of the true languages; the limit by the accepted share."""
    if not len(entropy):
        return
    gap = entropy.min(1, keepdims=True) - entropy
    grid = np.geomspace(1, 300, 60)
    fits = [np.mean((s * gap)[np.arange(len(truth)), truth] - np.log(np.exp(s * gap).sum(1))) for s in grid]
    model.sharpness = float(grid[int(np.argmax(fits))])
    model.limit = float(np.quantile(entropy.min(1), ACCEPTED_SHARE))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches):
        frame = pd.DataFrame({"lang": part.column("lang").to_pylist(), "text": part.column("text").to_pylist()})
        for lang, own in frame.groupby("lang"):
            codes, _, at = symbols(own["text"].tolist())
            if not len(at):
                continue
            _, first, n = np.unique(hashes(_coded()[codes], at, ORDER), return_index=True, return_counts=True)
            grams = [codes[at[first] - ORDER + 1 + k].astype(np.int32) for k in range(ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *map(pa.array, grams), pa.array(n.astype(np.int64))], names=["lang", *(f"c{k}" for k in range(ORDER)), "n"])


def train(labelled: DataFrame, learn_rows: int = LEARN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> KneserNey | None:
    """Learn from labelled rows (doc_id, text, lang): about learn_rows of each language, chosen by hash of id and text."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    drawn = labelled.select("lang", F.col("text").cast("binary").alias("text"), draw.alias("draw"))
    sizes = {r["lang"]: r for r in drawn.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"), F.min("draw").alias("least")).collect()}
    if not sizes:
        return None
    by_lang = lambda value: F.coalesce(*(F.when(F.col("lang") == k, F.lit(value(r))) for k, r in sizes.items()))
    # at least the language's first draw; a language that has hardly more rows than wanted is learnt whole
    bound = lambda rows: by_lang(lambda r: 2.0 if r["n"] <= rows * 1.1 else max(rows / r["n"], r["least"] + 1e-12))
    rows = drawn.select("*", bound(learn_rows).alias("learn"), bound(learn_rows + calibrate_rows).alias("most"))
    once = lambda sample: sample.groupBy("lang", "draw").agg(F.first("text").alias("text")).select("lang", "text")
    columns = [f"c{k}" for k in range(ORDER)]
    schema = "lang string, " + ", ".join(f"{c} int" for c in columns) + ", n long"
    counts = once(rows.filter("draw < learn")).mapInArrow(_grams, schema).groupBy("lang", *columns).agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    model = fit(counts)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    at = {k: i for i, k in enumerate(model.languages)}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            entropy, letters = shared.value.cross_entropy(part.column("text").to_pylist())
            use = letters > 0
            langs = [k for k, x in zip(part.column("lang").to_pylist(), use, strict=True) if x]
            yield pa.RecordBatch.from_arrays([pa.array([at.get(k, -1) for k in langs], pa.int32()), pa.array(list(entropy[use]), pa.list_(pa.float64()))], names=["truth", "entropy"])

    held = once(rows.filter("(draw >= learn and draw < most) or (learn >= 1 and draw > 0.9)"))
    sample = held.mapInArrow(measured, "truth int, entropy array<double>").filter("truth >= 0").toPandas()
    if len(sample):
        calibrate(model, np.array(sample["entropy"].tolist()), sample["truth"].to_numpy())
    shared.unpersist()
    return model


def identify(docs: DataFrame, model: KneserNey | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (confidence, 0 to 1), rejected for every row; the text alone decides."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            languages, score, rejected = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
