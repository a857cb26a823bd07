"""Language-model scoring by prediction by partial matching (PPM).

A trie of byte contexts, up to ORDER bytes long, is learnt from the training
texts. How likely a context is to meet a new symbol is estimated from all
contexts alike in order, count and number of symbols: with any one occurrence
left out, was its symbol new? Symbols seen in a longer context are excluded from
the shorter one. As a
context's symbols all occur in its suffix too, what is excluded depends on the
one context escaped from, so the code length of a symbol needs a few look-ups
and no loop over symbols. A text is its bytes, A-Z in lower case, and an end
symbol; its score is the sum of log10 probabilities.

The trie is cut into shards by the last SHARED context bytes, which all longer
contexts of a place have in common: a shard holds every context of order SHARED
and more that ends so, is of bounded size, and is all that scoring such a place
needs, besides the counts of the orders below.

The unigram base scores words against counts of the whole corpus. Each chunk of
texts sends the hashes of its different words, in ranges, to the task that sums
that range, and gets the sums back in the same order. A chunk deals by DEAL_BITS
of the hash at most, so rows are chunks times 2^DEAL_BITS; where that leaves
ranges too large for a task, chunks of one range are summed to larger ones, which
deal by the next bits, and the sums go back the same way.

Defined cases: a null text is empty and scores its end alone; without training
texts all symbols are equally likely; repeated rows are scored each; rows with a
null id belong to the remainder of the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize

ORDER = 5
SHARED = ORDER - 2
_ENDING = (1 << 8 * SHARED) - 1
END = 0xFF  # no byte of UTF-8
ALPHABET = 256
#: Different (context, symbol) pairs of one shard; one ending alone has ALPHABET ** 3 at most.
SHARD_PAIRS = 4_000_000
#: Different pairs that a task sums up before it sends them on.
HELD_PAIRS = 2_000_000
#: Text bytes of one chunk.
CHUNK_BYTES = 4 << 20
#: Different words, about, whose sums one task makes at a time.
RANGE_WORDS = 1_000_000
#: Bits of the hash that one exchange deals by.
DEAL_BITS = 10
#: Chunks, about, that one range's part of an exchange is put together to.
PART_CHUNKS = 16


def pair_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol ORDER context bytes and itself in the lowest byte, as one integer; row of each."""
    lead = bytes(ORDER)
    data = np.frombuffer(b"".join([x for t in texts for x in (lead, (t or b"").lower(), b"\xff")]), np.uint8)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    rows = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(rows)) + ORDER * (rows + 1)
    keys = np.zeros(len(data), np.int64)
    for back in range(ORDER + 1):
        keys[back:] |= data[: len(data) - back].astype(np.int64) << (8 * back)
    return keys[at], rows


class Index:
    """Open addressing over unique integer keys: find() gives each key's number, or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * max(len(keys), 1)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        self.probes = 1
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # the last of those that meet stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._home(keys)
        got = self.slots[at]
        hit = (got >= 0) & (self.keys[got] == keys)
        out[hit] = got[hit]
        todo = np.flatnonzero((got >= 0) & ~hit)
        for step in range(1, self.probes):
            if not len(todo):
                break
            got = self.slots[(at[todo] + step) & ((1 << self.bits) - 1)]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            todo = todo[(got >= 0) & ~hit]
        return out


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1)).astype(np.float32)


#: Classes of counts, and of numbers of symbols, for the estimate of escapes.
CLASSES = 40


def _class(x: np.ndarray) -> np.ndarray:
    """1, 2, 3 by themselves, then halves of powers of two."""
    return np.minimum(np.where(x < 4, x, 2 * np.log2(np.maximum(x, 1)) + 0.5), CLASSES - 1).astype(np.int64)


def _contexts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted pairs, how many symbols each has, and each pair's context."""
    context, first, of = np.unique(pairs >> 8, return_index=True, return_inverse=True)
    return context, np.diff(np.r_[first, len(pairs)]), of


def _levels(keys: np.ndarray, counts: np.ndarray, orders: range) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pairs and their counts for shorter contexts."""
    out = {}
    for order in orders:
        short, at = np.unique(keys & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        out[order] = (short, np.bincount(at, weights=counts, minlength=len(short)).astype(np.int64))
    return out


def escape_events(levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """By order, count class and symbol class: how often a left-out occurrence was new, and how often not."""
    out = np.zeros((ORDER + 1, CLASSES, CLASSES, 2))
    for order, (pairs, n) in levels.items():
        _, kinds, of = _contexts(pairs)
        total = np.bincount(of, weights=n, minlength=len(kinds)).astype(np.int64)
        once = np.bincount(of, weights=n == 1, minlength=len(kinds))
        some = total > 1
        np.add.at(out[order, :, :, 0], (_class(total - 1)[some], _class(kinds - 1)[some]), once[some])
        np.add.at(out[order, :, :, 1], (_class(total - 1)[some], _class(kinds)[some]), (total - once)[some])
    return out


def escape_table(events: np.ndarray) -> np.ndarray:
    """Escape probabilities; a class that was hardly met leans to half its symbols over its count."""
    low = np.maximum(np.where(np.arange(CLASSES) < 4, np.arange(CLASSES), 2 ** ((np.arange(CLASSES) - 0.5) / 2)), 1)
    prior = np.clip(low[None, :] / 2 / low[:, None], 0.001, 0.5)
    return np.clip((events[..., 0] + 2 * prior) / (events.sum(-1) + 2), 1e-4, 1 - 1e-4)


class Trie:
    """Contexts of some endings, of order SHARED and more, besides all of the orders below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray, escapes: np.ndarray):
        """keys, counts: pairs of the longest contexts; low_keys, low_counts: all pairs of contexts of SHARED - 1 bytes."""
        self.pairs: dict[int, tuple[Index, np.ndarray]] = {}
        self.contexts: dict[int, tuple[Index, ...]] = {}
        levels = _levels(low_keys, low_counts, range(SHARED)) | _levels(keys, counts, range(SHARED, ORDER + 1))
        shorter = None
        for order, (pairs, n) in levels.items():
            context, kinds, of = _contexts(pairs)
            total = np.bincount(of, weights=n, minlength=len(context)).astype(np.int64)
            index = Index(pairs)
            left, new = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
            if shorter:  # what of the shorter context isn't excluded
                pair_index, pair_n, context_index, context_total, context_kinds = shorter
                mask = (1 << (8 * (order - 1))) - 1
                below = context_index.find(context & mask)
                parent = pair_index.find(((pairs >> 8 & mask) << 8) | (pairs & 0xFF))
                left = context_total[below] - np.bincount(of, weights=pair_n[parent], minlength=len(context)).astype(np.int64)
                new = context_kinds[below] - kinds
            self.pairs[order] = (index, _log(n))
            context_index = Index(context)
            here = escapes[order][_class(total), _class(kinds)]
            after = np.where(new > 0, escapes[max(order - 1, 0)][_class(left), _class(new)], 0.5)
            self.contexts[order] = (
                context_index, _log(total) - np.log10(1 - here).astype(np.float32), np.log10(here).astype(np.float32),
                _log(left) - np.log10(1 - after).astype(np.float32), np.where(new > 0, np.log10(after), 0).astype(np.float32),
            )
            shorter = (index, n, context_index, total, kinds)
        pairs, n = levels[ORDER]
        self.direct = self.pairs[ORDER][1] - self.contexts[ORDER][1][self.contexts[ORDER][0].find(pairs >> 8)] if len(pairs) else np.zeros(0, np.float32)
        self.symbols = len(levels[0][0])

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        out = np.zeros(len(keys), np.float32)
        got = self.pairs[ORDER][0].find(keys)
        hit = got >= 0
        out[hit] = self.direct[got[hit]]
        todo = np.flatnonzero(~hit)
        source = np.full(len(todo), -1, np.int64)  # the longer context that was escaped from, if any
        for order in range(ORDER, -1, -1):
            if not len(todo):
                return out
            short = keys[todo] & ((1 << (8 * (order + 1))) - 1)
            index, total, escape, _, _ = self.contexts[order]
            context = index.find(short >> 8)
            pair_index, logs = self.pairs[order]
            pair = pair_index.find(short)
            found, inner, known = pair >= 0, source >= 0, context >= 0
            _, _, _, rest, further = self.contexts[min(order + 1, ORDER)]
            out[todo[found]] += logs[pair[found]]
            use = found & inner
            out[todo[use]] -= rest[source[use]]
            use = found & ~inner
            out[todo[use]] -= total[context[use]]
            use = ~found & inner
            out[todo[use]] += further[source[use]]
            use = ~found & ~inner & known
            out[todo[use]] += escape[context[use]]
            todo, source = todo[~found], np.where(known, context, -1)[~found]
        out[todo] -= np.log10(max(ALPHABET - self.symbols, 1))
        return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

    def batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    for part in byte_slices(batches):
        held.append(np.unique(pair_keys(part.column("text").to_pylist())[0], return_counts=True))
        if sum(len(k) for k, _ in held) > HELD_PAIRS:
            held = [merged()]
            if len(held[0][0]) > HELD_PAIRS // 2:
                yield batch(*held.pop())
    if held:
        yield batch(*merged())


def train(texts: DataFrame, shard_pairs: int = SHARD_PAIRS) -> list[tuple[int, int, Broadcast]]:
    """texts has the binary column text. Each shard's first and last ending and its broadcast Trie."""
    context = texts.sparkSession.sparkContext
    pairs = materialize(texts.select("text").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "ppm-pairs")
    low = pairs.groupBy(F.col("pair").bitwiseAND(_ENDING).alias("pair")).agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    sizes = pairs.groupBy(F.shiftright("pair", 8).bitwiseAND(_ENDING).alias("ending")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("ending")
    bounds, first, filled = [], 0, 0
    for ending, n in zip(sizes.column("ending").to_pylist(), sizes.column("n").to_pylist(), strict=True):
        if filled and filled + n > shard_pairs:
            bounds.append((first, ending - 1))
            first, filled = ending, 0
        filled += n
    bounds.append((first, _ENDING))

    def shard(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        own = pairs.filter(F.shiftright("pair", 8).bitwiseAND(_ENDING).between(first, last)).toArrow()
        return own.column("pair").to_numpy(), own.column("n").to_numpy()

    below = (low.column("pair").to_numpy(), low.column("n").to_numpy())
    events = escape_events(_levels(*below, range(SHARED)))
    held = None
    for first, last in bounds:
        held = shard(first, last)
        events += escape_events(_levels(*held, range(SHARED, ORDER + 1)))
    escapes = escape_table(events)
    out = []
    for first, last in bounds:
        own = held if len(bounds) == 1 else shard(first, last)
        out.append((first, last, context.broadcast(Trie(*own, *below, escapes))))
    discard(pairs)
    return out


def score_texts(texts: list[bytes | None], tries: list[tuple[int, int, Broadcast]]) -> np.ndarray:
    """log10 probability of each text; one shard in memory at a time."""
    keys, rows = pair_keys(texts)
    out = np.zeros(len(keys), np.float32)
    ending = keys >> 8 & _ENDING
    for first, last, trie in tries:
        at = np.flatnonzero((ending >= first) & (ending <= last))
        out[at] = trie.value.score(keys[at])
        if len(tries) > 1 and hasattr(trie, "_value") and hasattr(trie, "_path"):
            del trie._value  # on a worker it is read again from the executor's copy
    return np.bincount(rows, weights=out, minlength=len(texts))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


CHUNK_SCHEMA = "chunk long, range int, words binary, counts binary, ids binary, held binary, sizes binary, places binary, times binary, scores binary"
_CHUNK_FIELDS = ["chunk", "range", "words", "counts", "ids", "held", "sizes", "places", "times", "scores"]


def _chunk_rows(chunk: int, bits: int, doc_ids: list, held: np.ndarray, texts: list[bytes | None], scores: np.ndarray) -> Iterator[list]:
    """One row for each range of word hashes, and one (range -1) with the chunk's texts as places in its word list."""
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids: dict[bytes, int] = {}
    for words in split:
        for w in set(words).difference(ids):
            ids[w] = len(ids)
    flat = np.concatenate([np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in split])
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat, hashes = rank[flat], hashes[order]
    rows = np.repeat(np.arange(len(split)), sizes)
    learnt = np.bincount(flat[~held[rows]], minlength=len(hashes)).astype(np.uint32)
    keys, times = np.unique(rows * max(len(hashes), 1) + flat, return_counts=True)
    rows, places = np.divmod(keys, max(len(hashes), 1))
    of = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(of, np.arange((1 << bits) + 1))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[r], cuts[r + 1])
        yield [chunk, r, _pack(hashes[s]), _pack(learnt[s].astype(np.uint64)), None, None, None, None, None, None]
    nothing = np.iinfo(np.int64).min
    known = np.array([nothing if x is None else x for x in doc_ids], np.int64)
    steps = np.diff(places, prepend=0).astype(np.int32)
    yield [chunk, -1, None, None, _pack(known), _pack(held), _pack(np.bincount(rows, minlength=len(split)).astype(np.uint32)), _pack(steps), _pack(times.astype(np.uint32)), _pack(scores)]


def _requests(rows: DataFrame, bits: int, tries: list[tuple[int, int, Broadcast]]) -> DataFrame:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, held, texts, scores, size = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            made = list(_chunk_rows(number, bits, doc_ids, np.array(held, bool), texts, np.concatenate(scores)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), [pa.int64(), pa.int32(), *[pa.binary()] * 8], strict=True)], names=_CHUNK_FIELDS)

        for part in byte_slices(batches):
            new = part.column("text").to_pylist()
            doc_ids += part.column("doc_id").to_pylist()
            held += part.column("held_out").to_pylist()
            texts += new
            scores.append(score_texts(new, tries))
            size += sum(len(t or b"") + 32 for t in new)
            if size >= CHUNK_BYTES:
                yield flush()
                number, doc_ids, held, texts, scores, size = number + 1, [], [], [], [], 0
        if texts:
            yield flush()

    return rows.mapInArrow(chunks, CHUNK_SCHEMA)


def _sum_range(part: pa.Table) -> pa.Table:
    """Counts of every word of one range over all chunks, back to each chunk in its order; chunk -1 gets the totals."""
    words = [_unpack(x, np.uint64) for x in part.column("words").to_pylist()]
    counts = [_unpack(x, np.uint64) for x in part.column("counts").to_pylist()]
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
    cuts = np.cumsum([len(w) for w in words])[:-1]
    replies = [_pack(total[x]) for x in np.split(at, cuts)]
    r = part.column("range")[0].as_py()
    return pa.table({
        "chunk": pa.array([*part.column("chunk").to_pylist(), -1], pa.int64()), "range": pa.array([r] * (len(words) + 1), pa.int32()),
        "counts": pa.array([*replies, None], pa.binary()), "tokens": pa.array([*[0] * len(words), int(total.sum())], pa.int64()), "kinds": pa.array([*[0] * len(words), int((total > 0).sum())], pa.int64()),
    })


_WORDS = "chunk long, range int, words binary, counts binary, chunks binary, sizes binary, places binary"


def _dealt_again(bits: int, seen: int):
    """Rows of one range after another, summed to larger chunks and dealt by bits more; seen bits are dealt by.

    A chunk's row of range -1 keeps what it was made of: chunks, their numbers of
    words (sizes) and each word's place.
    """

    def chunk_rows(number: int, r: int, chunks: list[int], words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        found, places = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(places, weights=np.concatenate(counts), minlength=len(found)).astype(np.uint64)
        ranges = (found >> np.uint64(64 - seen - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = [(number, -1, None, _pack(np.array([r], np.int64)), _pack(np.array(chunks, np.int64)), _pack(sizes), _pack(places.astype(np.uint32)))]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append((number, int(ranges[a]), _pack(found[a:b]), _pack(total[a:b]), None, None, None))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "range", "words", "counts", "chunks", "sizes", "places"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, chunks, words, counts, size = TaskContext.get().partitionId() << 32, None, [], [], [], 0
        for batch in batches:
            for chunk, r, w, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "range", "words", "counts")), strict=True):
                if chunks and (r != at or size >= CHUNK_BYTES):
                    yield chunk_rows(number, at, chunks, words, counts)
                    number, chunks, words, counts, size = number + 1, [], [], [], 0
                at = r
                chunks.append(chunk)
                words.append(_unpack(w, np.uint64))
                counts.append(_unpack(n, np.uint64))
                size += len(words[-1]) * 8
        if chunks:
            yield chunk_rows(number, at, chunks, words, counts)

    return deal


def _taken_apart(part: pa.Table) -> pa.Table:
    """Sums for a chunk that was put together, as sums for the chunks that it was made of."""
    part = part.sort_by("range")  # -1 first
    get = lambda c, kind: _unpack(part.column(c)[0].as_py(), kind)
    chunks, sizes, places, r = get("chunks", np.int64), get("sizes", np.int64), get("places", np.uint32), int(get("counts", np.int64)[0])
    total = np.concatenate([_unpack(x, np.int64) for x in part.column("counts").to_pylist()[1:]])
    replies = [_pack(x) for x in np.split(total[places], np.cumsum(sizes)[:-1])]
    nothing = pa.array([0] * len(chunks), pa.int64())
    return pa.table({"chunk": pa.array(chunks), "range": pa.array([r] * len(chunks), pa.int32()), "counts": pa.array(replies, pa.binary()), "tokens": nothing, "kinds": nothing})


_SUMS = "chunk long, range int, counts binary, tokens long, kinds long"


def _word_sums(sent: DataFrame, seen: int, left: int, behind: list[DataFrame]) -> DataFrame:
    """The sums of the words of every row of sent, which is dealt by seen bits, and rows of chunk -1 with totals; left bits are to come."""
    if not left:
        return sent.groupBy("range").applyInArrow(_sum_range, _SUMS)
    bits = min(left, DEAL_BITS)
    parts = 1 << max(0, left - PART_CHUNKS.bit_length() + 1)  # a range's rows go to several tasks
    placed = sent.repartition(F.col("range"), F.pmod(F.xxhash64("chunk"), F.lit(parts))).sortWithinPartitions("range")
    again = materialize(placed.mapInArrow(_dealt_again(bits, seen), _WORDS), "ppm-ranges")
    behind.append(again)
    inner = materialize(_word_sums(again.filter("range >= 0").select("chunk", "range", "words", "counts"), seen + bits, left - bits, behind), "ppm-range-sums")
    behind.append(inner)
    whole = again.filter("range = -1").select("chunk", "range", "counts", "chunks", "sizes", "places")
    replies = inner.filter("chunk >= 0").select("chunk", "range", "counts", *(F.lit(None).cast("binary").alias(c) for c in ("chunks", "sizes", "places")))
    return inner.filter("chunk = -1").unionByName(whole.unionByName(replies).groupBy("chunk").applyInArrow(_taken_apart, _SUMS))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size, learnt = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    tries = train(rows.filter("not held_out"))
    bits = max(4, (size // (4 * RANGE_WORDS)).bit_length())  # if a fourth of all bytes were words new to their chunk
    first, behind = min(bits, DEAL_BITS), []
    chunks = materialize(_requests(rows, first, tries), "ppm-chunks")
    sums = materialize(_word_sums(chunks.filter("range >= 0").select("chunk", "range", "words", "counts"), first, bits - first, behind), "ppm-sums")
    for used in behind:
        discard(used)
    tokens, kinds = sums.filter("chunk = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total, vocabulary = tokens + learnt, kinds + (learnt > 0)
    base = float(np.log10(total + vocabulary + 1))
    end = float(np.log10(learnt + 1))

    def finish(part: pa.Table) -> pa.Table:
        part = part.sort_by("range")
        own = part.column("range").to_pylist().index(-1)
        get = lambda name, kind: _unpack(part.column(name)[own].as_py(), kind)
        replies = [_unpack(x, np.int64) for k, x in enumerate(part.column("counts").to_pylist()) if k != own]
        counts = np.concatenate(replies) if replies else np.zeros(0, np.int64)
        ids, held, sizes, times = get("ids", np.int64), get("held", bool), get("sizes", np.uint32), get("times", np.uint32)
        got = counts[np.cumsum(get("places", np.int32), dtype=np.int64)] if len(times) else counts[:0]
        of, n = np.repeat(np.arange(len(ids)), sizes), len(ids)
        n_words = np.bincount(of, weights=times, minlength=n)
        known = np.bincount(of, weights=times * (got > 0), minlength=n) + (learnt > 0)
        logs = np.bincount(of, weights=times * np.log10(got + 1), minlength=n) + end
        return pa.table({
            "doc_id": pa.array(ids, mask=ids == np.iinfo(np.int64).min), "held_out": held, "n_tokens": n_words.astype(np.int64) + 1, "n_known": known.astype(np.int64),
            "train_tokens": np.full(n, total, np.int64), "base_score": logs - (n_words + 1) * base, "score": get("scores", np.float64),
        })

    parts = ["chunk", "range", "counts", "ids", "held", "sizes", "places", "times", "scores"]
    replies = sums.filter("chunk >= 0").select("chunk", "range", "counts", *(F.lit(None).cast("binary").alias(c) for c in parts[3:]))
    texts = chunks.filter("range = -1").select(*parts)
    return texts.unionByName(replies).groupBy("chunk").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
