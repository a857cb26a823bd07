"""Language identification, mixing, sharding, search and the classifier."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.llm import factorization, langid, mixing, queries, sharding, topk
from quernstone.llm.common import id_remainder

from . import helpers


def held():
    return id_remainder("doc_id", 4) == 2


# language identification


def test_probabilities_sum_to_one():
    """For a context, all known symbols and the unknown one share the whole mass."""
    codes, _, at = langid.symbols([b"abra cadabra abba", b"cab"])
    window = pd.DataFrame({f"c{k}": codes[at - langid.ORDER + 1 + k] for k in range(langid.ORDER)}).assign(lang="x")
    model = langid.fit(window.value_counts().rename("n").reset_index())
    alphabet = sorted({*"abrcd "})
    for context in ("abr", "zzz", " ca", "bbb"):
        total = 0.0
        for c in [*alphabet, "z"]:
            padded = np.array([ord(x) for x in context + c])
            coded = langid._coded()[padded]
            todo, p = np.array([3]), 0.0
            for n in range(langid.ORDER, 0, -1):
                place, known = model.grams[n - 1].find(langid.hashes(coded, todo, n))
                if known[0]:
                    p += model.logp[n - 1][place[0], 0]
                    break
                if n > 1:
                    place, known = model.contexts[n - 1].find(langid.hashes(coded, todo - 1, n - 1))
                    p += model.backoff[n - 1][place[0], 0] if known[0] else 0.0
                else:
                    p += model.unseen[0]
            total += math.exp(p)
        assert math.isclose(total, 1.0, abs_tol=1e-4)


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(docs, langid.train(docs.filter(~held())), held()).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.count()


@pytest.mark.parametrize("doc_id", [7, None])
def test_languages_of_rows_that_share_an_id(spark, doc_id):
    """Draws tell texts apart, bound the sample and leave no language without a row."""
    text = lambda lang, k: " ".join(f"{lang}{'abcdefghij'[int(c)]}" for c in str(k + 1000))
    rows = [(doc_id, text(lang, k), lang) for lang in ("xu", "yo") for k in range(900)] + [(doc_id, "zizi zaza zuzu", "za")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, learn_rows=200, calibrate_rows=50)
    assert model.languages == ["xu", "yo", "za"]
    out = langid.identify(docs, model, F.lit(False)).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in out} == {"xu": 900, "yo": 900, "za": 500}


def test_awkward_languages(spark):
    docs = helpers.awkward(spark)
    out = langid.identify(docs, langid.train(docs.filter(~held())), held()).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0
    assert by[0].lang_pred in {"en", "de", "fr", "xx"}
    none = langid.identify(docs, langid.train(helpers.empty(spark)), held()).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(helpers.empty(spark), None, held()).count() == 0


# mixing


def test_shortages_go_to_siblings_first():
    tree = mixing.MixTree({"a": 1.0, "b": 1.0}, {"a": ["s1", "s2"], "b": ["s3"]}, {"en": 1.0})
    tokens = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("b", "en", "s3"): 1000}
    assert mixing.leaf_budgets(tokens, tree, 400, 1) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("b", "en", "s3"): 200}
    tokens["a", "en", "s2"] = 20
    assert mixing.leaf_budgets(tokens, tree, 400, 1) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 370}


def test_fill_spends_the_budget():
    random.seed(1)
    for _ in range(200):
        children = {str(i): (random.random() + 0.01, random.random() * 10) for i in range(random.randint(1, 8))}
        capacity = sum(c for _, c in children.values())
        budget = random.random() * capacity
        out = mixing.fill(budget, children)
        assert math.isclose(sum(out.values()), budget, rel_tol=1e-9) and all(out[k] <= c + 1e-9 for k, (_, c) in children.items())


def duck(sql, documents):
    c = duckdb.connect()
    c.register("documents", documents)
    return c.execute(sql).df()


def test_mix_matches_sql_on_awkward_rows(spark):
    docs = helpers.awkward(spark).filter("doc_id is not null")
    got = queries.mix_documents(docs).select("row.doc_id", "domain", "language", "origin", "n_tokens", "epoch").toPandas()
    want = duck(queries.ORACLE_SQL["op7_source_mixing"], docs.select("doc_id", "text", "lang", "source").toPandas())
    key = ["doc_id", "domain", "language", "origin", "n_tokens", "epoch"]
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))
    whole = queries.mix_documents(helpers.awkward(spark))
    assert whole.select("row.*").columns == docs.columns and whole.count() > 0
    assert queries.mix_documents(helpers.empty(spark)).count() == 0


def test_mix_prefixes_fit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.mix_documents(docs)
    taken = {(r.domain, r.language, r.origin): r.n for r in out.groupBy(*mixing.LEAF).agg(F.sum("n_tokens").alias("n")).collect()}
    leaf = queries.MIX_TREE.leaf(F.col("lang"), F.col("source"))
    totals = {(r.domain, r.language, r.origin): r.n for r in docs.select(*leaf, mixing.n_words(F.col("text")).alias("w")).groupBy(*mixing.LEAF).agg(F.sum("w").alias("n")).collect()}
    budgets = mixing.leaf_budgets(totals, queries.MIX_TREE, queries.MIX_SHARE * sum(totals.values()), queries.MIX_EPOCHS)
    assert all(taken.get(k, 0) <= b for k, b in budgets.items())
    assert "Python" not in out._jdf.queryExecution().toString()


# sharding


def test_store_keeps_every_row_and_version(spark, tmp_path):
    docs = helpers.awkward(spark)
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=20_000, fanout=2, smallest_bytes=1)
    assert store.read_placed().count() == 0 if store.manifest().schema else True
    for k in range(5):
        store.append(docs.withColumn("n", F.lit(k).cast("long")))
        store.compact()
    store.append(helpers.empty(spark))
    now = store.manifest()
    assert store.read().count() == 5 * docs.count()
    assert sorted(map(str, store.read().collect())) == sorted(str(r) for k in range(5) for r in docs.withColumn("n", F.lit(k).cast("long")).collect())
    assert store.read(1).count() == docs.count()
    tiers = Counter(store.tier(r) for r in now.runs if not store.full(r))
    assert all(n < 2 for n in tiers.values())
    placed = store.read_placed().select("row.doc_id", "shard", "tier", "version")
    assert placed.filter(F.col("version") == now.version).count() == 5 * docs.count()
    store.vacuum()
    assert store.versions() == [now.version] and store.read().count() == 5 * docs.count()


def test_vacuum_leaves_runs_about_to_be_committed(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), fanout=2)
    base = store.append(spark.range(3).toDF("id"))
    run = store._write(spark.range(5).toDF("id"))
    store.vacuum()
    store._commit(base, [*base.runs, run], base.schema)
    assert store.read().count() == 8
    lost = store._write(spark.range(5).toDF("id"))
    store.vacuum(grace_seconds=-60)
    assert store.read().count() == 8 and lost.name not in [s.getPath().getName() for s in store._list("data")]


def test_arrivals_keep_the_stored_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([(1, "a")], "id long, t string"))
    for wrong in ("id long", "id int, t string", "id long, T string"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], wrong))
    store.append(spark.createDataFrame([("b", 2.5, 2)], "t string, x double, id long"))
    assert sorted((tuple(r) for r in store.read().collect()), key=str) == [(1, "a", None), (2, "b", 2.5)]


def test_lost_race(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    base = store.manifest()
    store.append(spark.range(3).toDF("id"))
    with pytest.raises(sharding.CommitConflict):
        store._commit(base, [], "{}")
    assert store.versions() == [1]


# search


def brute_top(rows, k):
    out = []
    sound = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    for q, x in sound:
        if q % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def test_search_against_brute_force(spark, monkeypatch):
    random.seed(6)
    rows = [(i, [random.choice([0.0, 0.0, random.uniform(-1, 1)]) for _ in range(6)]) for i in range(220)]
    rows += [(300, None), (350, []), (400, [1.0, None]), (450, [float("nan")]), (500, [float("inf"), 1.0]), (None, [1.0] * 6), (600, [0.5, 0.5]), (221, rows[3][1]), (222, rows[3][1]), (222, rows[3][1])]
    df = spark.createDataFrame([(i, x, 1, "q") for i, x in rows], "vec_id long, embedding array<float>, rank int, score string")
    as_float = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    asks = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    for candidates, asked in ((8192, 2048), (20, 2)):
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", candidates)
        monkeypatch.setattr(topk, "QUERY_BLOCK", asked)
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, asks).collect())
        assert got == brute_top(as_float, 5)


def test_empty_vectors_take_part(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, []), (2, [-1.0]), (50, [])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0), (0, 2, 50, 0), (0, 3, 2, -65536), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]


def test_search_large_components_and_long_vectors(spark):
    big = spark.createDataFrame([(50, [1e9, 1.0]), (1, [1e9, 2.0])], "vec_id long, embedding array<double>")
    for value in (1e9, 1e300):
        with pytest.raises(OverflowError, match="64 bits"):
            topk.top_k(big.withColumn("embedding", F.array(F.lit(value), F.lit(1.0))), F.col("vec_id") % 50 == 0)
    rows = [(50, [0.0] * 200_000 + [3.0])] + [(k, [float(k), -1.0]) for k in range(1, 40)] + [(100, [2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(k, 2 * k * 256 * 256) for k in range(39, 34, -1)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 50] == [(k, 0) for k in range(1, 6)]


def test_search_small_tables(spark):
    asks = F.col("vec_id") % 50 == 0
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), asks).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), asks).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), asks).count() == 1


# classifier


def test_sum_of_squares_identity():
    random = np.random.default_rng(2)
    texts = [b"some words here and some there", b"", b"UPPER!! ###"]
    f = factorization.featurize(texts)
    width = factorization.BUCKETS + factorization.STATISTICS
    m = factorization.FactorizationMachine(0.3, random.normal(size=width), random.normal(size=(width, 4)), np.zeros(factorization.STATISTICS), np.ones(factorization.STATISTICS), 4.0)
    x = np.zeros((3, width))
    x[f.rows, f.buckets] = f.shares * 4.0
    x[:, factorization.BUCKETS :] = f.stats
    for i in range(3):
        at = np.flatnonzero(x[i])
        pairs = sum(x[i, a] * x[i, b] * (m.factors[a] @ m.factors[b]) for k, a in enumerate(at) for b in at[:k])
        assert math.isclose(m.margin(f)[i], 0.3 + x[i] @ m.linear + pairs, rel_tol=1e-9)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has a handful of labels
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = factorization.train(docs, labels.filter(~held()))
    out = factorization.score(docs, model, held()).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = out[out.label == 1].score.to_numpy(), out[out.label == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_awkward_quality(spark):
    docs = helpers.awkward(spark)
    labels = spark.createDataFrame([(0, 1), (50, 1), (7, 0), (8, 0), (None, 1), (3, None), (6, 5)], "doc_id long, label int")
    model = factorization.train(docs, labels)
    for m in (model, None):
        out = factorization.score(docs, m, held()).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert factorization.train(docs, labels.filter("label = 1")) is None
    assert factorization.score(helpers.empty(spark), model, held()).count() == 0


def test_every_operator_has_one_query():
    by = defaultdict(list)
    for name in queries.QUERIES:
        by[name.split("_")[0]].append(name)
    assert sorted(by, key=lambda x: int(x[2:])) == [f"op{n}" for n in range(1, 14)] and all(len(v) == 1 for v in by.values())
