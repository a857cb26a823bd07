"""Best-two-fit packing of token sequences.

A bin is filled greedily, each time with the longest piece that fits; then its
shortest piece is taken out again if two unpacked pieces fill the widened gap
more tightly. Only lengths matter to that, and a bin repeats unchanged until one
of its lengths runs short, so the packing of the whole corpus is planned on the
histogram of piece lengths: at most ``capacity`` numbers, whatever the input.
Each length's pieces are then numbered and read their place off the plan.

Defined cases: a null text is empty and packs as the separator alone; repeated
rows are packed each; null ids are kept as null; no rows give no sequences;
pieces of equal length are interchangeable and placed in the order of their
numbers; other columns, of whatever name, are ignored. A long text is encoded
whole, at some 4 bytes an id, and cut afterwards.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, materialize

CAPACITY = 2048
#: Words whose ids a Python worker remembers; beyond it those not met of late are forgotten.
REMEMBERED_WORDS = 200_000
LONGEST_REMEMBERED = 64

#: ASCII marks that a tokenizer cuts, as one run, from the letter or digit before them.
_MARKS = b".,;:!?|*$%&#()[]{}<>=+-_/\\\"~^@"
#: Letters a-z and those of Latin-1 and Latin Extended-A and -B, which need no normalising once in lower case.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\u024f]+")
#: Words of those and digits, with marks after them.
_MARKED = re.compile("([0-9a-z\xdf-\xf6\xf8-\u024f]+)([" + re.escape(_MARKS.decode()) + "]+)")


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as its Latin-1 character if that is visible, else as one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(enumerate(map(chr, range(256)))) | dict(zip((b for b in range(256) if b not in visible), map(chr, range(256, 512)), strict=False))


class _Words(dict):
    """Words, A-Z lower-cased, to their ids as little-endian unsigned 32-bit; unknown words are encoded when asked for.

    Once half of what may be remembered is new, what hasn't been asked for since is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.bytewise = str.maketrans(_byte_names())
        self.older: dict[bytes, bytes] = {}
        self.long: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if word[-1] in _MARKS and text.lower() == text and (parts := _MARKED.fullmatch(text)):
                ids = self[parts[1].encode()] + self[parts[2].encode()]
            elif _PLAIN.fullmatch(text) and text.lower() == text:
                names = text if text.isascii() else word.decode("latin-1").translate(self.bytewise)
                ids = _packed([t.id for t in self.merge(names)])
            else:
                ids = self.whole(text)
        if len(word) > LONGEST_REMEMBERED:
            self.long.append(word)
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        for word in self.long:
            self.pop(word, None)
        self.long.clear()
        if len(self) > REMEMBERED_WORDS // 2:
            self.older = dict(self)
            self.clear()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[str, _Words] = {}


def _encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Texts to little-endian unsigned 32-bit ids; one memory for each worker and tokenizer file.

    The tokenizer lower-cases, drops white space, and lets no token span it or
    the end of a run of letters; so A-Z are lower-cased first and words are
    encoded one by one and remembered, those of plain letters and digits without
    the marks at their ends. Two things come before the tokenizer's lower-casing:
    names of special tokens, so a text that may hold one goes to it whole, and
    accents join the letter before them, so words with an accent of its own
    (U+0300 to U+037F, bytes CC and CD) keep their case.
    """
    if path not in _loaded:
        _loaded[path] = _Words(path)
    words = _loaded[path]
    get = words.__getitem__

    def encode(texts: list[bytes]) -> list[bytes]:
        out = []
        for t in texts:
            if b"<|" in t:
                out.append(words.whole(t.decode("utf-8", "replace")))
            elif b"\xcc" in t or b"\xcd" in t:
                out.append(b"".join(words.whole(w.decode("utf-8", "replace")) if b"\xcc" in w or b"\xcd" in w else get(w.lower()) for w in t.split()))
            else:
                out.append(b"".join(map(get, t.lower().split())))
        words.forget()
        return out

    return encode


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, task int, slot long"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Every text as pieces of at most capacity ids (little-endian unsigned 32-bit), separator at its end.

    task and slot number the pieces of one length: slot counts them within the task.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        end = np.array([separator], "<u4").tobytes()
        for part in byte_slices(batches):
            texts = [t or b"" for t in part.column("text").to_pylist()]
            ids, piece, start, length, data, slot = [], [], [], [], [], []
            for doc_id, found in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                found += end
                for k, at in enumerate(range(0, len(found), 4 * capacity)):
                    chunk = found[at : at + 4 * capacity]
                    n = len(chunk) // 4
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    data.append(chunk)
                    slot.append(int(used[n]))
                    used[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array([task] * len(ids), pa.int32()), pa.array(slot, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "task", "slot"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(pieces, PIECE_SCHEMA)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, sequence, each, offset): pieces number first..last-1 of that length.

    Piece r lies in sequence + (r - first) // each, at offset + length * ((r - first) % each).
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    given = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    lengths = np.arange(capacity + 1)
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return rows
        best = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest that fits each gap
        used: dict[int, int] = {}
        gap = capacity
        while gap:  # greedily, the longest that fits
            n = int(best[gap])
            while n and left[n] <= used.get(n, 0):
                n = int(best[n - 1])
            if not n:
                break
            fit = min(int(left[n]) - used.get(n, 0), gap // n)
            used[n] = used.get(n, 0) + fit
            gap -= fit * n
        if gap:
            small = min(used)
            room = gap + small
            rest = left.copy()
            for n, k in used.items():
                rest[n] -= k
            fits = there[(there < room) & (rest[there] > 0)]
            if len(fits):
                longest = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
                partner = longest[room - fits]
                alone = (partner == fits) & (rest[fits] < 2)
                partner[alone] = longest[fits[alone] - 1]
                sums = np.where(partner > 0, fits + partner, 0)
                k = int(sums.argmax())
                if sums[k] > small:
                    used[small] -= 1
                    for n in (int(fits[k]), int(partner[k])):
                        used[n] = used.get(n, 0) + 1
        used = {n: k for n, k in used.items() if k}
        times = min(int(left[n]) // k for n, k in used.items())
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            first = int(given[n])
            rows.append((n, first, first + times * k, sequence, k, offset))
            given[n] += times * k
            left[n] -= times * k
            offset += n * k
        sequence += times


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length, task, slot and any other columns) with sequence_id and offset.

    The plan's size depends on capacity only; the pieces never leave the executors.
    """
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(plan_bins(histogram, capacity)) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    names = [c for c in pieces.columns if c not in ("task", "slot")]
    numbered = pieces.join(bases, ["task", "length"]).select(*names, (F.col("base") + F.col("slot")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            row = plan[np.searchsorted(keys, length << 48 | number, "right") - 1]
            turn = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(row[:, 3] + turn // row[:, 4]), pa.array(row[:, 5] + length * (turn % row[:, 4]))],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Place every piece of every text; with_ids also returns the ids themselves."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "task", "slot"]
    return pack_pieces(materialize(pieces.select(*names), "pieces"), capacity)


def crc32_of(ids: list[int]) -> int:
    """The digest of a list of ids, as returned with each piece."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
