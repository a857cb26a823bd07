from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import ppm
from quernstone.llm.common import id_remainder

from . import helpers


def brute_table(learnt):
    """Escape events, context by context and occurrence by occurrence."""
    events = np.zeros((ppm.ORDER + 1, ppm.CLASSES, ppm.CLASSES, 2))
    one = lambda x: int(ppm._class(np.array([x]))[0])
    for order, table in enumerate(learnt):
        for counts in table.values():
            n, kinds = sum(counts.values()), len(counts)
            if n > 1:
                for c in counts.values():
                    if c == 1:
                        events[order, one(n - 1), one(kinds - 1), 0] += 1
                    else:
                        events[order, one(n - 1), one(kinds), 1] += c
    return ppm.escape_table(events)


def brute_score(learnt, text):
    one = lambda x: int(ppm._class(np.array([x]))[0])
    tables = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in learnt:
        b = bytes(ppm.ORDER) + t.lower() + b"\xff"
        for i in range(ppm.ORDER, len(b)):
            for o in range(ppm.ORDER + 1):
                tables[o][b[i - o : i]][b[i]] += 1
    escapes = brute_table(tables)
    total, b = 0.0, bytes(ppm.ORDER) + text.lower() + b"\xff"
    for i in range(ppm.ORDER, len(b)):
        out = set()
        for o in range(ppm.ORDER, -1, -1):
            live = {s: n for s, n in tables[o].get(b[i - o : i], {}).items() if s not in out}
            n, kinds = sum(live.values()), len(live)
            if not live:
                continue
            escape = escapes[o, one(n), one(kinds)]
            if b[i] in live:
                total += math.log10(live[b[i]] / n * (1 - escape))
                break
            total += math.log10(escape)
            out |= set(live)
        else:
            total -= math.log10(max(ppm.ALPHABET - len(tables[0][b""]), 1))
    return total


def rows(spark, docs):
    return ppm.score_documents(docs, id_remainder("doc_id", 7) == 2).collect()


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(spark, docs, got):
    texts = helpers.texts_of(docs)
    learnt = [(t or "").encode() for k, t in texts if not held(k)]
    counts = Counter(w for t in learnt for w in t.lower().split())
    total, kinds = sum(counts.values()) + len(learnt), len(counts) + bool(learnt)
    want = Counter()
    for k, t in texts:
        w = helpers.lower_split(t)
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((len(learnt) + 1) / (total + kinds + 1))
        score = brute_score(learnt, (t or "").encode()) if len(t or "") < 3000 else None
        want[k, held(k), len(w) + 1, sum(counts[x] > 0 for x in w) + bool(learnt), total, round(base, 5), None if score is None else round(score, 2)] += 1
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 2)) for r in got)
    assert sum(have.values()) == len(texts)
    for key, n in want.items():
        close = [h for h in have if h[:5] == key[:5] and abs(h[5] - key[5]) < 1e-4 and (key[6] is None or abs(h[6] - key[6]) < 0.05)]
        assert sum(have[h] for h in close) >= n, (key, [h for h in have if h[0] == key[0]])


def test_against_brute_force(spark):
    docs = helpers.awkward(spark)
    check(spark, docs, rows(spark, docs))


def test_word_ranges_dealt_in_several_exchanges(spark, monkeypatch):
    """Hash ranges beyond the bits of one exchange: the same figures, and no chunk with more rows than one exchange deals to."""
    docs = helpers.awkward(spark).unionByName(helpers.awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    once = sorted(map(tuple, rows(spark, docs)), key=str)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 400)
    monkeypatch.setattr(ppm, "DEAL_BITS", 3)
    monkeypatch.setattr(ppm, "RANGE_WORDS", 100)
    made = []
    monkeypatch.setattr(ppm, "materialize", lambda df, name, real=ppm.materialize: made.append((name, real(df, name))) or made[-1][1])
    monkeypatch.setattr(ppm, "discard", lambda df: None)
    again = sorted(map(tuple, rows(spark, docs)), key=str)
    assert len(once) == len(again)
    for a, b in zip(once, again, strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)
    dealt = [df for name, df in made if name == "ppm-ranges"]
    assert len(dealt) > 2
    for df in dealt:
        assert df.filter("range >= 0").groupBy("chunk").count().agg(F.max("count")).first()[0] <= 8


def test_only_held_out_rows(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(60) if held(k)], "doc_id long, text string")
    for r in rows(spark, docs):
        assert (r.n_known, r.train_tokens) == (0, 0) and math.isclose(r.score, -10 * math.log10(256), abs_tol=1e-3)


def test_no_rows(spark):
    assert rows(spark, helpers.empty(spark)) == []


def test_shards_add_up(spark):
    texts = [helpers.words(200, i).encode() for i in range(0, 2000, 100)]
    df = spark.createDataFrame([(t,) for t in texts], "text binary")
    one, many = ppm.train(df), ppm.train(df, shard_pairs=500)
    assert len(one) == 1 and len(many) > 3
    assert np.allclose(ppm.score_texts(texts, one), ppm.score_texts(texts, many), rtol=1e-5)


def test_held_out_texts_are_predicted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ppm.score_documents(docs, id_remainder("doc_id", 7) == 2).filter("held_out").join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id")
    score, size = got.agg(F.sum("score"), F.sum("size")).first()
    assert -score * math.log2(10) / size < 2.6  # bits a byte


def test_probabilities_of_a_context_sum_to_one(spark):
    learnt = [helpers.words(80, i).encode() for i in range(5)]
    keys, n = np.unique(ppm.pair_keys(learnt)[0], return_counts=True)
    short, at = np.unique(keys & ppm._ENDING, return_inverse=True)
    low = (short, np.bincount(at, weights=n).astype(np.int64))
    escapes = ppm.escape_table(ppm.escape_events(ppm._levels(*low, range(ppm.SHARED))) + ppm.escape_events(ppm._levels(keys, n, range(ppm.SHARED, ppm.ORDER + 1))))
    trie = ppm.Trie(keys, n, *low, escapes)
    for context in (b"w12 w", b"  w79", b"zzzzz", b"zzzw1"):
        value = int.from_bytes(context, "big")
        p = 10 ** trie.score(np.array([value << 8 | s for s in range(256)])).astype(float)
        assert math.isclose(p.sum(), 1.0, abs_tol=1e-4)


def test_index_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    index = ppm.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
