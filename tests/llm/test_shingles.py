from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from quernstone.llm import shingles
from quernstone.llm.components import connected_components

from . import helpers


def sets_of(text):
    w = helpers.lower_split(text)
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, n, component) by comparing all pairs of rows."""
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return sorted(((k, len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingles.jaccard_components(df).collect()), key=str)


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    assert found(docs) == brute(helpers.texts_of(docs))


def near_copies(seed, groups, size, length):
    random.seed(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 4, 6])):
                text[random.randrange(length)] = f"z{random.randrange(10**6)}"
            rows.append(" ".join(text[: random.choice([length, length, length - 9])]))
    shared = " ".join(f"p{i}" for i in range(55))
    rows += [f"{helpers.words(120, 10_000 * i)} {shared}" for i in range(40)]
    random.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies_against_brute_force(spark):
    rows = near_copies(3, 4, 40, 90)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CELL_SHINGLES", 500)
    rows = near_copies(4, 2, 40, 60)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_giant_families_are_taken_apart_by_shingle(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CELL_SHINGLES", 200)
    monkeypatch.setattr(shingles, "DIRECT_BLOCKS", 2)
    rows = near_copies(5, 3, 40, 60)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_many_hash_ranges(spark, monkeypatch):
    """More than 2^16 ranges, as a corpus of hundreds of GB has."""
    monkeypatch.setattr(shingles, "RANGE_SHINGLES", 1 / 100)
    rows = near_copies(6, 2, 6, 40)[:40]
    total = sum(len(sets_of(t)) for _, t in rows) * 100
    assert total.bit_length() > 16
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_ranges_dealt_in_several_exchanges(spark, monkeypatch):
    """Hash ranges beyond the bits of one exchange, with many chunks in a unit and many units."""
    monkeypatch.setattr(shingles, "CHUNK_DOCUMENTS", 7)
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(shingles, "DEAL_BITS", 3)
    monkeypatch.setattr(shingles, "RANGE_SHINGLES", 40)
    made = []
    monkeypatch.setattr(shingles, "materialize", lambda df, name, real=shingles.materialize: made.append((name, real(df, name))) or made[-1][1])
    monkeypatch.setattr(shingles, "discard", lambda df: None)
    rows = near_copies(7, 3, 30, 60)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)
    dealt = [df for name, df in made if name == "shingle-ranges"]
    assert len(dealt) == 4  # three exchanges: two are dealt again
    for df in dealt:  # no chunk has more rows than one exchange deals to, and units hold many chunks
        assert df.filter("range >= 0").groupBy("chunk").count().agg(F.max("count")).first()[0] <= 8
    assert dealt[1].filter("range = -1").count() > 8
    docs = helpers.awkward(spark)
    assert found(docs) == brute(helpers.texts_of(docs))


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(k, helpers.words(30, 100 * i) + " end") for k in (None, 4) for i in range(3)] + [(None, helpers.words(30, 100)), (9, helpers.words(30, 200) + " end")]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    # rows without an id are copies of rows with one, which stand for them
    assert [r.doc_id for r in shingles.keep_representatives(df).collect()] == [4, 4, 4]


def test_chunks_hold_no_more_nodes_than_their_numbers(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(shingles, "TaskContext", Context)
    monkeypatch.setattr(shingles, "CHUNK_DOCUMENTS", 30)
    texts = [f"a{i} b c" for i in range(100)]
    nodes = [shingles._signature(s)[0] for s in shingles.shingle_sets(texts)]
    batches = [pa.RecordBatch.from_pydict({"node": nodes[a:b], "text": texts[a:b]}) for a, b in ((0, 29), (29, 100))]
    rows = pa.Table.from_batches(shingles._sent(2)(iter(batches))).to_pylist()
    sent = [np.frombuffer(zstandard.decompress(r["nodes"]), np.int64).tolist() for r in rows if r["nodes"]]
    assert sum(sent, []) == nodes and max(map(len, sent)) <= 30


def test_representatives(spark):
    docs = helpers.awkward(spark)
    out = shingles.keep_representatives(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 2, 3, 4, 5, 7, 8, 10] and ids.count(None) == 2


def test_no_rows(spark):
    assert found(helpers.empty(spark)) == []
    assert shingles.keep_representatives(helpers.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_each_text_is_read_into_shingles_once(spark, monkeypatch):
    """Copies of a text, and other texts with the same set, fall together without a pass over all texts before."""
    passes, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, real=frame.mapInArrow, **b: passes.append(f) or real(self, f, *a, **b))
    one, other = helpers.words(30, 500), helpers.words(12, 900)
    texts = [one, one, one.upper(), one.replace(" ", "\n\t "), f"{other} {other} {other}", f"{other}  {other} {other} {other}", other, "A b", "a B ", "a", " ", None, f"{one} {helpers.words(4, 700)}"]
    rows = list(enumerate(texts)) + [(None, one.upper()), (None, other)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert len(passes) == 1


def test_words_across_blocks(monkeypatch):
    """A word's hash depends on its bytes alone, wherever blocks of a text end."""
    random.seed(8)
    texts = [None, b"", b" \t\n", b"Ab c\x0bD\x0ce  f\rg", b"ab C d e f g ", b"x" * 300 + b" y z", b"x" * 299 + b" y z", b"a b c d", b"a b c d e", "é à é à é à é à".encode()]
    texts += [" ".join(random.choices(["aa", "b", "ccc", "é", "A"], k=k)).encode() for k in range(0, 90, 3)]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(sets_of(t.decode() if t else "")) for t in texts]
    assert (sets[3] == sets[4]).all() and sets[5] != sets[6]
    monkeypatch.setattr(shingles, "_BLOCK_BYTES", 16)
    assert all((a == b).all() for a, b in zip(sets, shingles.shingle_sets(texts), strict=True))


def test_families_of_fewer_blocks_than_prefix_shingles_stay_whole(spark, monkeypatch):
    """Taken apart, they would come once for each shingle of a prefix, and be verified as often."""
    monkeypatch.setattr(shingles, "CELL_SHINGLES", 500)
    monkeypatch.setattr(shingles, "DIRECT_BLOCKS", 1)
    made = {}
    monkeypatch.setattr(shingles, "materialize", lambda df, name, real=shingles.materialize: made.update({name: real(df, name)}) or made[name])
    monkeypatch.setattr(shingles, "discard", lambda df: None)
    rows = near_copies(9, 1, 40, 90)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    most = made["families"].orderBy(F.desc("blocks")).first()
    assert 2 < most.blocks < most.reach and "family-shingles" not in made


def test_links_of_a_family_against_brute_force():
    random.seed(10)
    for sided in (False, True):
        for _ in range(20):
            count = random.randrange(2, 60)
            base = random.sample(range(1000), random.randrange(4, 40))
            sets = [np.array(sorted({random.randrange(1000) if random.random() < random.choice([0, 0.05, 0.2]) else x for x in base}), np.int64) for _ in range(count)]
            sizes = [len(s) + random.choice([0, 0, 1]) for s in sets]
            groups = [hash((n, *s.tolist())) for n, s in zip(sizes, sets)]
            sides = [random.randrange(2) for _ in sets] if sided else None
            links = shingles.family_links(list(range(count)), sizes, groups, sets, sets, sides)
            up = list(range(count))

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            linked = lambda i, j: 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 75 * (sizes[i] + sizes[j] - len(set(sets[i].tolist()) & set(sets[j].tolist())))
            assert all(linked(i, j) and (not sides or sides[i] != sides[j]) for i, j in links) and len(links) < count
            for i, j in links:
                up[root(i)] = root(j)
            assert all(root(i) == root(j) for i in range(count) for j in range(i) if linked(i, j) and (not sides or sides[i] != sides[j]))
