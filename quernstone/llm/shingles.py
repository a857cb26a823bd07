"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with
equal texts are one node, whose set is made once. Two nodes link when their Jaccard
similarity reaches the threshold; documents of one connected component get its least id.

1. Nodes send their shingles, in hash ranges, to tasks that count in how many
   nodes each occurs; only those of two nodes or more come back. A node with too
   few of them to reach the threshold with anything is finished. Equal sets come
   back whole and are one node from then on. Chunks of nodes
   deal by DEAL_BITS of the hash at most: rows are chunks times 2^DEAL_BITS. If
   that leaves ranges too large for a task, rows of one range are put together to
   chunks again, which deal by the next bits, and replies go back the same way.
2. Shingles are ordered by that frequency. Two sets that link share one of the
   first ``n - ceil(t * n) + 1`` of either. Nodes of equal prefix and size form
   a group; groups that share a prefix shingle, directly or by way of others,
   form a candidate family.
3. A family is split into cells of bounded size, by pairs of blocks if need be. A
   family of more than DIRECT_BLOCKS blocks, and more than its prefixes are long, is
   first taken apart again by prefix shingle: groups then meet for each shingle they
   share, not all with all. In a cell, groups whose prefixes meet and whose sizes
   allow a link expand to their members, and a member is verified on the sets with
   many others at a time that it isn't yet connected to. Links that connect
   something are returned, at most one for each member.

Every pair that can link is verified, unless it is connected already, so no
link between different components is lost; pairs are never rows of a table.

Defined cases: null and empty texts, and those without a word, have an empty
set and are their own component; shorter texts than a shingle are one shingle;
equal rows fall together; rows without an id take part, and a component of such
rows alone has no id; rows that share an id are told apart by their texts; of
equal sets the least id names the component; extra columns are ignored; no rows
give no rows. A long text's set is made in one numpy step, some 100 bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize, mix, whole_row
from .components import connected_components

WORDS = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
CHUNK_BYTES = 8 << 20
CHUNK_DOCUMENTS = 60_000
#: Shingles, about, whose frequency one task counts at a time; before the text is dealt a second time, RANGE_MOST times as many.
RANGE_SHINGLES = 1_000_000
RANGE_MOST = 3
#: Bytes of text, about, for each distinct shingle.
SHINGLE_BYTES = 7
#: Bits of the hash that one exchange deals by.
DEAL_BITS = 10
#: Bits of a shingle that are sent; those of its first range come on top.
SENT_BITS = 48
#: Chunks, about, that one range's part of an exchange is put together to.
PART_CHUNKS = 16
#: Shingles, about, of one cell of verification.
CELL_SHINGLES = 1 << 18
#: Blocks up to which a family's blocks meet each other in any case, wherever their groups' shingles lie.
DIRECT_BLOCKS = 16

_NO_ID = -(1 << 63)
_POWERS = [np.uint64(pow(0x5851F42D4C957F2D, n, 1 << 64)) for n in range(WORDS)]

_SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(b"[" + _SPACES + b"]")
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
#: A byte's value in a word, times a power of _STEP by its place, is summed up.
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = 0xD1342543DE82EF95
_BLOCK_BYTES = 1 << 20
_step_powers: list[np.ndarray] = []


def _step_tables(n: int) -> list[np.ndarray]:
    """The first n powers of _STEP, and of its inverse."""
    if not _step_powers or len(_step_powers[0]) < n:
        size = max(n, 2 * _BLOCK_BYTES)
        _step_powers[:] = [np.r_[np.uint64(1), np.cumprod(np.full(size - 1, step, np.uint64))] for step in (_STEP, pow(_STEP, -1, 1 << 64))]
    return [x[:n] for x in _step_powers]


def _block_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(data, np.uint8)
    powers, back = _step_tables(len(text))
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _IS_SPACE[text]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[text] * powers, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts]), starts


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of lower-cased text, made block by block; a word longer than a block is one step."""
    hashes, places, a = [], [], 0
    while a < len(data):
        b = min(a + _BLOCK_BYTES, len(data))
        if b < len(data):
            cut = _SPACE.search(data, b)
            b = cut.start() if cut else len(data)
        h, starts = _block_words(data[a:b])
        hashes.append(h)
        places.append(starts + a)
        a = b
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[bytes | str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lowered = [(t.encode() if isinstance(t, str) else t or b"").lower() for t in texts]
    hashes, places = _words(b"\n".join(lowered))
    cuts = np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in lowered)])).tolist()
    grams = mix(sum(hashes[k : len(hashes) - WORDS + 1 + k] * _POWERS[k] for k in range(WORDS))) if len(hashes) >= WORDS else hashes
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= WORDS:
            h = np.sort(grams[a : b - WORDS + 1])
            new = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            out.append(h[new])
        elif b > a:
            out.append(mix(np.array([b - a], np.uint64) + sum(hashes[a + k : a + k + 1] * _POWERS[k] for k in range(b - a))))
        else:
            out.append(hashes[:0])
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed integers."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _sent(bits: int):
    """Rows (range, chunk, nodes, sizes, per_node, low, high): a chunk's shingles of one hash range, node after node."""

    def chunk_rows(chunk: int, nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        count = len(nodes)
        hashes = np.concatenate(sets)
        sizes = np.fromiter(map(len, sets), np.int64, count)
        rows = np.repeat(np.arange(count), sizes)
        ranges = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
        order = np.argsort(ranges, kind="stable")  # of short integers, a radix sort; nodes stay in order
        hashes, rows = hashes[order], rows[order]
        cuts = np.r_[0, np.cumsum(np.bincount(ranges, minlength=1 << bits))]
        first = int(np.flatnonzero(np.diff(cuts))[0])
        out = []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[r], cuts[r + 1])
            whole = (_pack(np.array(nodes, np.int64)), _pack(sizes)) if r == first else (None, None)
            out.append((r, chunk, *whole, _pack(np.bincount(rows[s], minlength=count).astype(np.uint32)), *_halves(hashes[s])))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["range", "chunk", "nodes", "sizes", "per_node", "low", "high"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, nodes, sets, size, last = TaskContext.get().partitionId() << 32, [], [], 0, None
        for part in byte_slices(batches):
            for node, s in zip(part.column("node").to_pylist(), shingle_sets(part.column("text").to_pylist()), strict=True):
                if node != last:  # rows of equal id and text come one after another
                    last = node
                    nodes.append(node)
                    sets.append(s)
                    size += len(s) * 8
                if len(nodes) >= CHUNK_DOCUMENTS:
                    yield chunk_rows(chunk, nodes, sets)
                    chunk, nodes, sets, size = chunk + 1, [], [], 0
            if size >= CHUNK_BYTES:
                yield chunk_rows(chunk, nodes, sets)
                chunk, nodes, sets, size = chunk + 1, [], [], 0
        if nodes:
            yield chunk_rows(chunk, nodes, sets)

    return send


def _per_node_rows(data: bytes) -> np.ndarray:
    """Node numbers of shingles that lie node after node, from their number by node."""
    n = _unpack(data, np.uint32)
    return np.repeat(np.arange(len(n), dtype=np.uint32), n)


def _rising(data: bytes) -> np.ndarray:
    """Rising numbers from their steps."""
    return np.cumsum(_unpack(data, np.uint32), dtype=np.uint32)


def _steps(x: np.ndarray) -> bytes:
    return _pack(np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32))


def _joined(low: bytes, high: bytes) -> np.ndarray:
    """The SENT_BITS of shingles."""
    return np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)


def _halves(hashes: np.ndarray) -> tuple[bytes, bytes]:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (hashes >> np.uint64(32)).astype(np.uint32).astype(np.uint16).tobytes()


def _count_range(first: int, later: int, rows_of):
    """For each chunk its shingles that two nodes have or more: node numbers, shingles, frequencies. A range has first bits, and later ones."""

    def count(part: pa.Table) -> pa.Table:
        sent = [_joined(a, b) for a, b in zip(part.column("low").to_pylist(), part.column("high").to_pylist(), strict=True)]
        top = np.uint64(part.column("range")[0].as_py() >> later << (64 - first))
        hashes = np.concatenate(sent)
        order = np.argsort(hashes)
        ordered = hashes[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sizes = np.diff(np.r_[starts, len(ordered)])
        frequency = np.empty(len(hashes), np.uint32)
        frequency[order] = np.repeat(sizes, sizes)
        cuts = np.cumsum([0, *map(len, sent)])
        out = []
        for chunk, nodes, sizes, rows, a, b in zip(*(part.column(c).to_pylist() for c in ("chunk", "nodes", "sizes", "per_node")), cuts[:-1], cuts[1:], strict=True):
            keep = frequency[a:b] > 1
            if nodes is not None or keep.any():
                out.append((chunk, nodes, sizes, _pack(rows_of(rows)[keep]), (hashes[a:b][keep] | top).tobytes(), _pack(frequency[a:b][keep])))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table({k: pa.array(c, kind) for k, c, kind in zip(["chunk", "nodes", "sizes", "rows", "shingles", "frequency"], columns, kinds, strict=True)})

    return count


def _dealt_again(bits: int, seen: int, rows_of):
    """Rows of one range after another, put together to chunks and dealt by bits more; seen of those sent are dealt by.

    A chunk's row of range -1 keeps which chunk (nodes, with their numbers of
    shingles as sizes) and which node of it (per_node) each shingle came from.
    """

    def chunk_rows(number: int, r: int, chunks: list[int], rows: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(sets)
        ranges = (hashes >> np.uint64(SENT_BITS - seen - bits)).astype(np.int64) & ((1 << bits) - 1)
        order = np.argsort(ranges, kind="stable")
        cuts = np.searchsorted(ranges[order], np.arange((1 << bits) + 1))
        out = [(-1, number, _pack(np.array(chunks, np.int64)), _pack(np.fromiter(map(len, sets), np.int64, len(sets))), _pack(np.concatenate(rows)), None, None)]
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            places = order[cuts[k] : cuts[k + 1]]
            out.append((r << bits | k, number, None, None, _steps(places), *_halves(hashes[places])))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["range", "chunk", "nodes", "sizes", "per_node", "low", "high"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, chunks, rows, sets, size = TaskContext.get().partitionId() << 32, None, [], [], [], 0
        for batch in batches:
            for r, chunk, row, low, high in zip(*(batch.column(c).to_pylist() for c in ("range", "chunk", "per_node", "low", "high")), strict=True):
                if chunks and (r != at or size >= CHUNK_BYTES):
                    yield chunk_rows(number, at, chunks, rows, sets)
                    number, chunks, rows, sets, size = number + 1, [], [], [], 0
                at = r
                chunks.append(chunk)
                rows.append(rows_of(row))
                sets.append(_joined(low, high))
                size += len(sets[-1]) * 8
        if chunks:
            yield chunk_rows(number, at, chunks, rows, sets)

    return deal


def _taken_apart(part: pa.Table) -> pa.Table:
    """Replies to a chunk that was put together, as replies to the chunks that it was made of."""
    own = part.column("nodes").is_valid().to_pylist().index(True)
    get = lambda c, kind: _unpack(part.column(c)[own].as_py(), kind)
    chunks, sizes, rows = get("nodes", np.int64), get("sizes", np.int64), get("rows", np.uint32)
    replies = [k for k in range(part.num_rows) if k != own]
    of = lambda c: [part.column(c)[k].as_py() for k in replies]
    out = []
    if replies:
        places = np.concatenate([_unpack(x, np.uint32) for x in of("rows")])
        order = np.argsort(places)
        places = places[order]
        shingles = np.concatenate([np.frombuffer(x, np.int64) for x in of("shingles")])[order]
        frequency = np.concatenate([_unpack(x, np.uint32) for x in of("frequency")])[order]
        cuts = np.searchsorted(places, np.r_[0, np.cumsum(sizes)])
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[k], cuts[k + 1])
            out.append((int(chunks[k]), None, None, _pack(rows[places[s]]), shingles[s].tobytes(), _pack(frequency[s])))
    kinds = [pa.int64(), *[pa.binary()] * 5]
    columns = zip(*out, strict=True) if out else [[]] * 6
    return pa.table({k: pa.array(c, kind) for k, c, kind in zip(["chunk", "nodes", "sizes", "rows", "shingles", "frequency"], columns, kinds, strict=True)})


_REPLY = "chunk long, nodes binary, sizes binary, rows binary, shingles binary, frequency binary"
_SENT = "range int, chunk long, nodes binary, sizes binary, per_node binary, low binary, high binary"


def _replies(sent: DataFrame, first: int, seen: int, left: int, behind: list[DataFrame]) -> DataFrame:
    """Shared shingles of the chunks of sent, which is dealt by first bits and seen more; left bits are to come."""
    rows_of = _rising if seen else _per_node_rows
    if not left:
        return sent.groupBy("range").applyInArrow(_count_range(first, seen, rows_of), _REPLY)
    bits = min(left, DEAL_BITS)
    sent = materialize(sent, "shingle-ranges")
    parts = 1 << max(0, left - PART_CHUNKS.bit_length() + 1)  # a range's rows go to several tasks
    placed = sent.repartition(F.col("range"), F.pmod(F.xxhash64("chunk"), F.lit(parts))).sortWithinPartitions("range")
    again = materialize(placed.mapInArrow(_dealt_again(bits, seen, rows_of), _SENT), "shingle-ranges")
    behind += [sent, again]
    inner = _replies(again.filter("range >= 0"), first, seen + bits, left - bits, behind)
    whole = again.filter("range = -1").select("chunk", "nodes", "sizes", F.col("per_node").alias("rows"), *(F.lit(None).cast("binary").alias(c) for c in ("shingles", "frequency")))
    back = whole.unionByName(inner).groupBy("chunk").applyInArrow(_taken_apart, _REPLY)
    if seen:
        return back
    # a chunk's nodes, which no reply brings along here
    nothing = [F.lit(_pack(np.zeros(0, np.uint32))).alias("rows"), F.lit(b"").alias("shingles"), F.lit(_pack(np.zeros(0, np.uint32))).alias("frequency")]
    return sent.filter("nodes is not null").select("chunk", "nodes", "sizes", *nothing).unionByName(back)


def _needed(n: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-PERCENT * n // 100)


def _survivors(part: pa.Table) -> pa.Table:
    """All nodes with their sizes. Those that can link: key of their group, prefix, shared shingles by rising frequency, and the signature of a set that is shared whole."""
    get = lambda c: [x for x in part.column(c).to_pylist() if x is not None]
    nodes, sizes = _unpack(get("nodes")[0], np.int64), _unpack(get("sizes")[0], np.int64)
    rows = np.concatenate([_unpack(x, np.uint32) for x in get("rows")])
    shingles = np.concatenate([np.frombuffer(x, np.int64) for x in get("shingles")])
    frequency = np.concatenate([_unpack(x, np.uint32) for x in get("frequency")])
    order = np.lexsort((shingles, frequency, rows))
    shingles = shingles[order]
    cuts = np.searchsorted(rows[order], np.arange(len(nodes) + 1))
    out = []
    for node, n, a, b in zip(nodes.tolist(), sizes.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= _needed(n):
            prefix = n - _needed(n) + 1 - (n - (b - a))  # shingles of this node alone come first
            key = xxhash.xxh3_64_intdigest(shingles[a : a + prefix].tobytes(), n) - (1 << 63)
            out.append((node, n, key, shingles[a : a + prefix].tolist(), shingles[a:b].tobytes(), *(_signature(shingles[a:b].view(np.uint64)) if b - a == n else (None, None))))
        else:
            out.append((node, n, *[None] * 5))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
    columns = zip(*out, strict=True) if out else [[]] * 7
    return pa.table({k: pa.array(c, kind) for k, c, kind in zip(["node", "n", "grp", "prefix", "shingles", "mark", "check"], columns, kinds, strict=True)})


def family_links(nodes: list[int], sizes: list[int], groups: list[int], prefixes: list[np.ndarray], sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the members of one family; with sides, only pairs of different sides are verified.

    Members lie by rising size and by group. A member is verified with those before
    it whose groups share a prefix shingle, many at a time, and leaves out what it
    is connected to meanwhile.
    """
    order = sorted(range(len(nodes)), key=lambda i: (sizes[i], groups[i], nodes[i]))
    size, side = np.array([sizes[i] for i in order]), np.array([sides[i] for i in order]) if sides else None
    own = [sets[i] for i in order]
    cuts = np.cumsum([0, *map(len, own)])
    places, ids = np.unique(np.concatenate(own), return_inverse=True)
    marked = np.zeros(len(places), bool)
    label = np.arange(len(order))
    links = []

    def common(i: int, others: np.ndarray) -> np.ndarray:
        a, b = others[0], others[-1] + 1
        if cuts[b] - cuts[a] <= 4 * (cuts[others + 1] - cuts[others]).sum():
            held, starts, pick = ids[cuts[a] : cuts[b]], cuts[a:b] - cuts[a], others - a
        else:
            held, starts, pick = np.concatenate([ids[cuts[j] : cuts[j + 1]] for j in others.tolist()]), np.r_[0, np.cumsum(cuts[others + 1] - cuts[others])[:-1]], slice(None)
        marked[ids[cuts[i] : cuts[i + 1]]] = True
        found = np.add.reduceat(marked[held], starts, dtype=np.int32)[pick]
        marked[ids[cuts[i] : cuts[i + 1]]] = False
        return found

    def verify(i: int, others: np.ndarray) -> None:
        if side is not None:
            others = others[side[others] != side[i]]
        step = 16
        while len(others := others[label[others] != label[i]]):
            now, others = others[:step], others[step:]
            step *= 4
            shared = common(i, now)
            linked = now[100 * shared >= PERCENT * (size[i] + size[now] - shared)]
            for j in linked[np.unique(label[linked], return_index=True)[1]].tolist():
                links.append((nodes[order[i]], nodes[order[j]]))
                label[label == label[j]] = label[i]

    group = np.array([groups[i] for i in order])
    heads = np.r_[np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (size[1:] != size[:-1])]), len(order)]
    number = np.repeat(np.arange(len(heads) - 1), np.diff(heads))  # of each member's group
    # groups of each prefix shingle, one list after another; where a group's own entries are, and where their lists begin
    own_prefixes = [prefixes[order[h]] for h in heads[:-1]]
    ends = np.cumsum([0, *map(len, own_prefixes)])
    entry_group, entry = np.repeat(np.arange(len(own_prefixes)), np.diff(ends)), np.concatenate(own_prefixes)
    by_shingle = np.argsort(entry, kind="stable")
    lists, ordered = entry_group[by_shingle], entry[by_shingle]
    at = np.empty(len(entry), np.int64)
    at[by_shingle] = np.arange(len(entry))
    begin = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(len(entry)), 0))[at]
    met = np.zeros(len(own_prefixes), bool)
    for g, (first, last) in enumerate(zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)):
        to, since = at[ends[g] : ends[g + 1]], begin[ends[g] : ends[g + 1]]
        some = to > since
        others = np.zeros(0, np.int64)
        if some.any():
            for a, b in zip(since[some].tolist(), to[some].tolist(), strict=True):
                met[lists[a:b]] = True
            low = np.searchsorted(size, _needed(int(size[first])))
            others = low + np.flatnonzero(met[number[low:first]])
            met[:] = False
        for i in range(first, last):
            verify(i, np.r_[others, first:i])
    return links


def _verify_cell(part: pa.Table) -> pa.Table:
    """All units (families, or groups with one shingle) of a cell; a cell of two blocks verifies pairs across them only."""
    part = part.sort_by([("unit", "ascending"), ("node", "ascending"), ("side", "ascending")])
    unit = part.column("unit").to_numpy()
    sizes, nodes, groups, sides = (part.column(c).to_pylist() for c in ("n", "node", "grp", "side"))
    prefixes = [np.array(x, np.int64) for x in part.column("prefix").to_pylist()]
    sets = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
    across = part.column("across")[0].as_py()
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]).tolist()
    links = []
    for a, b in zip(starts, [*starts[1:], len(unit)], strict=True):
        links += family_links(nodes[a:b], sizes[a:b], groups[a:b], prefixes[a:b], sets[a:b], sides[a:b] if across else None)
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def _weighed(rows: DataFrame) -> DataFrame:
    """unit, weight, blocks and mean prefix of the units of rows (unit, members, weight, reach) that have two members or more."""
    weights = rows.groupBy("unit").agg(F.sum("members").alias("members"), F.sum("weight").alias("weight"), F.sum("reach").alias("reach")).filter("members > 1")
    return weights.select("unit", "weight", F.ceil(F.col("weight") / CELL_SHINGLES).cast("int").alias("blocks"), (F.col("reach") / F.col("members")).alias("reach"))


def _cells(survivors: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """survivors with unit, cell, side and across: what is verified together, of bounded size; and the tables behind it. Sets are shuffled once their units are known."""
    sized = survivors.select("grp", "prefix", F.lit(1).alias("members"), "weight", F.size("prefix").alias("reach"))
    groups = sized.groupBy("grp").agg(F.first("prefix").alias("prefix"))
    tokens = groups.select(F.explode("prefix").alias("shingle"), "grp")
    least = tokens.groupBy("shingle").agg(F.min("grp").alias("hub"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    edges = tokens.join(least, "shingle").select(F.col("grp").alias("u"), F.col("hub").alias("v")).filter("u <> v").distinct()
    families = connected_components(edges).withColumnRenamed("node", "grp").withColumnRenamed("component", "unit")
    by_group = sized.groupBy("grp").agg(*(F.sum(c).alias(c) for c in ("members", "weight", "reach")))
    placed = materialize(by_group.join(families, "grp", "left").withColumn("unit", F.coalesce("unit", "grp")), "family-groups")
    weights = materialize(_weighed(placed), "families")
    # a member comes once for each block, or once for each shingle of its prefix, whichever are fewer
    apart = F.col("blocks") > F.greatest(F.lit(DIRECT_BLOCKS), F.col("reach"))
    kept = ["node", "n", "grp", "prefix", "shingles"]
    where = placed.select("grp", "unit").join(weights.select("unit", "blocks", apart.alias("apart")), "unit")
    units, bounded, behind = survivors.join(where.filter("not apart"), "grp").select("unit", "blocks", *kept), weights.filter(~apart), [placed, weights]
    if not weights.filter(apart).isEmpty():
        giant = survivors.join(where.filter("apart").select("grp"), "grp", "left_semi").withColumn("unit", F.explode("prefix"))
        shingles = materialize(_weighed(giant.select("unit", F.lit(1).alias("members"), "weight", F.lit(0).alias("reach"))), "family-shingles")
        units, bounded = units.unionByName(giant.join(shingles.select("unit", "blocks"), "unit").select(*units.columns)), bounded.unionByName(shingles)
        behind.append(shingles)
    small = bounded.filter("blocks = 1").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    bins = int(small // CELL_SHINGLES) + 1
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = units.withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit"), F.lit(bins))).otherwise(F.col("unit"))
    # in cell (i, j) of two blocks every member comes once: those of block i by other = j, those of block j by other = i
    return dealt.select(cell.alias("cell"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "unit", *kept, "side", (F.col("side") != F.col("other")).alias("across")), behind


def _worded() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t-\\r]")


def _labelled(docs: DataFrame) -> DataFrame:
    """k (-2^63 for null ids), version (hash of the text), n, component_id and lone of every row of docs; lone: the least version of a component of rows without an id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64("text").alias("version"), "text")
    marks = materialize(rows.select("k", "version", F.octet_length("text").alias("size"), _worded().alias("worded")), "texts")
    real = F.when(F.col("k") != _NO_ID, F.col("k"))
    # of each text the row that sends its set, and its least id
    nodes = materialize(marks.filter("worded").groupBy(F.col("version").alias("node")).agg(F.min("k").alias("k"), F.min(real).alias("id"), F.max("size").alias("size")), "nodes")
    total = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // SHINGLE_BYTES
    bits = max(4, min(DEAL_BITS, int(total // RANGE_SHINGLES).bit_length()), int(total // (RANGE_MOST * RANGE_SHINGLES)).bit_length())
    texts = rows.withColumnRenamed("version", "node").join(nodes.select("k", "node"), ["k", "node"]).select("node", F.col("text").cast("binary").alias("text"))
    first, dealt = min(bits, DEAL_BITS), []
    known = _replies(texts.mapInArrow(_sent(first), _SENT), first, 0, bits - first, dealt)
    found = materialize(known.groupBy("chunk").applyInArrow(_survivors, "node long, n long, grp long, prefix array<long>, shingles binary, mark long, check long"), "survivors")
    whole = found.filter("mark is not null")
    least = whole.groupBy("mark", "check", "n").agg(F.min("node").alias("twin"))
    twins = materialize(whole.select("node", "mark", "check", "n").join(least, ["mark", "check", "n"]).filter("node <> twin").select("node", "twin").distinct(), "twins")
    survivors = materialize(found.filter("prefix is not null").drop("mark", "check").join(twins, "node", "left_anti").withColumn("weight", F.octet_length("shingles") / 8), "survivors")
    cells, behind = _cells(survivors)
    links = cells.groupBy("cell", "i", "j", "across").applyInArrow(_verify_cell, "u long, v long")
    joined = connected_components(links.unionByName(twins.select(F.col("node").alias("u"), F.col("twin").alias("v"))))
    sizes = materialize(found.select("node", "n").distinct(), "shingle-sets")
    for used in (found, twins, survivors, *behind, *dealt):
        discard(used)
    own = nodes.join(joined, "node", "left").select("node", "id", F.coalesce("component", "node").alias("root"))
    named = own.groupBy("root").agg(F.min("id").alias("component_id"), F.min("node").alias("lone"))
    labels = own.select("node", "root").join(named, "root").join(sizes, "node").select(F.col("node").alias("version"), "n", "component_id", "lone")
    worded = marks.filter("worded").join(labels, "version", "left").select("k", "version", "n", "component_id", "lone")
    return worded.unionByName(marks.filter("not worded").select("k", "version", F.lit(0).cast("long").alias("n"), real.alias("component_id"), F.col("version").alias("lone")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    return _labelled(docs).select(F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of its least id; if no row has an id, one of them.

    Rows that repeat an id and text count as one, and so do rows without an id that
    repeat a text; rows without shingles all stay.
    """
    found = _labelled(docs)
    gone = found.filter(F.col("k") != F.coalesce("component_id", F.lit(_NO_ID))).filter(F.col("k") != _NO_ID).select(F.col("k").alias("_k")).distinct()
    worded = _worded()
    keyed = lambda rows: rows.select(whole_row(rows).alias("row"), F.col("doc_id").cast("long").alias("_k"), F.xxhash64("text").alias("_t"))
    copy = F.row_number().over(Window.partitionBy("_k", "_t").orderBy("_t"))
    kept = keyed(docs.filter(worded & F.col("doc_id").isNotNull())).join(gone, "_k", "left_anti").withColumn("_copy", copy).filter("_copy = 1").select("row.*")
    # without an id: those of components without any, which their least version stands for; copies meet before the shuffle
    alone = found.filter((F.col("k") == _NO_ID) & F.col("component_id").isNull() & (F.col("version") == F.col("lone"))).select(F.col("version").alias("_t")).distinct()
    nameless = keyed(docs.filter(worded & F.col("doc_id").isNull())).join(alone, "_t", "left_semi").groupBy("_t").agg(F.first("row").alias("row")).select("row.*")
    return docs.filter(~worded).unionByName(kept).unionByName(nameless)
