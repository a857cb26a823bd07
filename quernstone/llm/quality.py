"""Quality rules by repetition coverage.

For every text, rolling hashes of several n-gram lengths find the words that lie
inside an n-gram already seen in the same text; the characters of those words,
as a share of all word characters, are the coverage of that length. Duplicate
lines are measured the same way. A text is kept while no coverage and no
symbol share exceeds its limit.

Defined cases: a null or empty text has no words, fails the base rule and is not
kept. Repeated rows are judged one by one; of equal lines and n-grams the first
is the original. No rows give no rows. A long text is judged whole, in one numpy
step of some 100 bytes a word. Extra columns pass through ``keep_documents``
untouched and are ignored by ``repetition_report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, mix, per_row

#: Largest share of word characters inside repeated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Most symbol characters for each word character.
SYMBOL_LIMIT = 0.10
MIN_WORDS = 50
REPEAT_WINDOW = 3
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

REPORT_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup{n}_chars long" for n in NGRAM_LIMITS)
)


def _chars(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _windows(grams: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of n-word windows that lie in one text, and their keys (text and hash)."""
    inside = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return inside, mix(grams[inside] + rows[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key occurs more than once; it does so and this isn't its first place."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(keys)])
    many = np.repeat(sizes > 1, sizes)
    every = np.zeros(len(keys), bool)
    every[order[many]] = True
    later = every.copy()
    later[np.minimum.reduceat(order, starts)] = False
    return every, later


def _covered(positions: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any of the n-word windows that begin at positions."""
    edge = np.zeros(size + 1, np.int64)
    edge[positions] += 1
    np.add.at(edge, positions + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition_stats(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Word, symbol and repetition figures of each text."""
    count = len(texts)
    split = [t.split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, count)
    total = int(sizes.sum())
    ids: dict[bytes, int] = {}
    for words in split:
        for w in set(words).difference(ids):
            ids[w] = len(ids)
    words = np.empty(total, np.int64)
    at = 0
    for found in split:
        words[at : at + len(found)] = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
        at += len(found)
    lengths = np.fromiter(map(_chars, ids), np.int64, len(ids))[words] if total else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(count), sizes)
    stats = {
        "n_words": sizes,
        "word_chars": per_row(lengths, rows, count),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts], np.int64),
    }
    dup_lines, dup_line_chars = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for i, t in enumerate(texts):
        if t and b"\n" in t:
            seen: set[bytes] = set()
            for line in t.split(b"\n"):
                if line and not line.isspace():
                    if line in seen:
                        dup_lines[i] += 1
                        dup_line_chars[i] += sum(map(_chars, line.split()))
                    else:
                        seen.add(line)
    stats |= {"n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars}
    grams, n = mix(words.astype(np.uint64) + np.uint64(1)), 1
    base = grams.copy()
    for length in (REPEAT_WINDOW, *NGRAM_LIMITS):
        while n < length and len(grams) > 1:
            grams = grams[:-1] * np.uint64(0x5851F42D4C957F2D) + base[n:]
            n += 1
        covered = np.zeros(total, bool)
        if n == length and len(grams):
            places, keys = _windows(grams, rows, n)
            if len(keys):
                every, later = _repeats(keys)
                covered = _covered(places[every if length == REPEAT_WINDOW else later], n, total)
        if length == REPEAT_WINDOW:
            stats["n_repeat_words"] = per_row(covered.astype(np.int64), rows, count)
        else:
            stats[f"dup{length}_chars"] = per_row(lengths * covered, rows, count)
    stats["base_failed"] = (sizes < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * sizes)
    chars = stats["word_chars"]
    over = (dup_line_chars > LINE_LIMIT * chars) | (stats["n_symbols"] > SYMBOL_LIMIT * chars)
    for n, limit in NGRAM_LIMITS.items():
        over |= stats[f"dup{n}_chars"] > limit * chars
    stats["kept"] = ~stats["base_failed"] & ~over
    return stats


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT_SCHEMA.split(", ")]
    for part in byte_slices(batches):
        stats = repetition_stats(part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(stats[k]) for k in names[1:])], names=names)


def repetition_report(docs: DataFrame) -> DataFrame:
    """One row per input row: the figures, the base rule and the verdict."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_report, REPORT_SCHEMA)


def _verdicts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in columns:
        rows = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [repetition_stats(part.column("text").to_pylist())["kept"] for part in byte_slices(iter([rows]))]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The input rows whose text is kept, all columns unchanged; one pass, no shuffle, and only texts leave the JVM."""
    bound_batches(docs.sparkSession)
    return docs.filter(F.arrow_udf(_verdicts, "boolean")(F.col("text").cast("binary")))
