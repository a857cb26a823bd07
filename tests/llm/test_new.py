"""Spelling variants, log reassembly and URL filters against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.llm import queries, txlog, urlfilter, variants

from .helpers import awkward, empty


def damaged(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def brute_words(rows, least_count=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = damaged(doc, run.encode().lower().decode())
            if len(word) >= 6:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_groups(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def groups(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_spelling_variants(spark, sf).collect()
    want = brute_groups(brute_words(docs))
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    assert len(got) == len(want) and any(v[2] for v in want.values())


@pytest.mark.parametrize("shard", [40, 1 << 15])
def test_variants_of_dense_words(spark, monkeypatch, shard):
    """Words over two letters share halves and are near many others; small shards take halves apart."""
    monkeypatch.setattr(variants, "SHARD_WORDS", shard)
    rng = random.Random(shard)
    letters = ["ab", "aé"][shard > 100]
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 8]))): rng.choice([5, 6, 25, 30, 150, 800]) for _ in range(400)}
    words |= {f"common{w}": n for w, n in list(words.items())[:200]}
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert groups(got) == brute_groups(words)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "", "tab"})
    automaton = variants.Automaton(words)
    assert [automaton.walk(w, automaton.root, 0)[1] for w in words] == list(range(len(words)))
    assert automaton.walk("x", automaton.root, 0) is None
    # equal right languages: the distinct sets of endings of all prefixes
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(automaton.next) == len(endings)
    assert automaton.near("taps", 2) == {words.index("tap")}


def test_variants_awkward(spark):
    docs = awkward(spark)
    got = groups(variants.group_variants(variants.word_counts(docs, least_length=3, least_count=1)))
    assert all(re.fullmatch("[a-zÀ-ÿ]{3,}", w) for w in got)
    assert variants.group_variants(variants.word_counts(empty(spark), damage=199)).count() == 0
    rows = spark.createDataFrame([(None, "Straße straßen" * 5), (1, None), (1, "\x00"), (2, "ÀÉÎõü" + "x" * 100_000)], "doc_id long, text string")
    assert {r.word: r.n for r in variants.word_counts(rows, damage=199, least_count=1).collect()} == brute_words([(r.doc_id, r.text) for r in rows.collect()], 1)


def brute_log(log, per_epoch, deletions=()):
    """(undone, states): changes undone as (seq, reason, by, key), and the store after each epoch."""
    open_txs, store, commits, states, undone = {}, {}, 0, [], []
    for seq, source, kind, key, value in sorted(log, key=lambda r: r[0]):
        changes, marks = open_txs.setdefault(source, ([], []))
        if kind == "change":
            changes.append((seq, key, None if seq in deletions else value))
        elif kind == "savepoint":
            marks.append(len(changes))
        elif kind == "rollback":
            at = min(marks.pop() if marks else 0, len(changes))
            undone += [(s, "rollback", seq, k) for s, k, _ in changes[at:]]
            del changes[at:]
        elif kind == "abort":
            undone += [(s, "abort", seq, k) for s, k, _ in changes]
            del open_txs[source]
        elif kind == "commit":
            for _, k, v in changes:
                store.pop(k, None)
                if v is not None:
                    store[k] = v
            del open_txs[source]
            commits += 1
            if commits % per_epoch == 0:
                states.append(dict(store))
    if commits % per_epoch:
        states.append(dict(store))
    for changes, _ in open_txs.values():
        undone += [(s, "abort", None, k) for s, k, _ in changes]
    return undone, states


def crc_sum(state):
    return sum(zlib.crc32(f"{k}:{v}".encode()) for k, v in state.items())


def test_log_query_equals_brute_force(spark, sf):
    kinds = ["commit"] * 2 + ["abort"] + ["savepoint"] * 2 + ["rollback"] * 2 + ["change"] * 16
    h = lambda d: zlib.crc32(str(d).encode())
    log = [(r.doc_id, r.source, kinds[h(r.doc_id) % 23], h(r.doc_id) // 100 % 300, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic == 1}
    undone, states = brute_log(log, 4, toxic)
    want = Counter([("state", k, len(s), crc_sum(s)) for k, s in enumerate(states, 1)] + [(why, s, by, key) for s, why, by, key in undone])
    got = queries.op12_transaction_log(spark, sf)
    assert Counter(map(tuple, got.select("kind", "id", "n", "value").collect())) == want
    assert {"state", "abort", "rollback"} == {k[0] for k in want}


@pytest.mark.parametrize("seed", range(3))
def test_log_of_long_transactions(spark, monkeypatch, seed):
    """Few ends, many savepoints and rollbacks, in many blocks and more than one level of them."""
    monkeypatch.setattr(txlog, "LEAST_BLOCKS", 23)
    monkeypatch.setattr(txlog, "BRANCH_BITS", 2)
    monkeypatch.setattr(txlog, "EPOCH_BITS", 1)
    rng = random.Random(seed)
    kinds = rng.choices(["change", "savepoint", "rollback", "commit", "abort", "note"], [60, 20, 18, 4 - seed, 1, 2], k=1200)
    log = [(seq, rng.choice([None, "", "a", "a", "a", "b"]), kind, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "", "x", "y" * seq])) for seq, kind in enumerate(kinds, -600)]
    undone, states = brute_log(log, 3)
    rows = spark.createDataFrame(log + log[:100], "seq long, source string, kind string, key long, value string")
    found = txlog.reassemble(rows, 3)
    assert Counter(map(tuple, found.undone.select("seq", "reason", "undone_by", "key").collect())) == Counter(undone)
    store = {}
    versions = {}
    for r in found.versions.collect():
        versions.setdefault(r.epoch, []).append(r)
    told = {r.epoch: (r.keys, r.total) for r in txlog.store_after_epochs(found, F.length("value") + F.coalesce("key", F.lit(7))).select("epoch", F.col("keys").alias("keys"), "total").toPandas().itertuples(index=False)}
    assert set(told) == set(range(1, len(states) + 1))
    for k, state in enumerate(states, 1):
        for r in versions.get(k, []):
            store.pop(r.key, None)
            if not r.deleted:
                store[r.key] = r.value
        assert store == state
        assert told[k] == (len(state), sum(len(v) + (7 if key is None else key) for key, v in state.items()))


def test_log_awkward(spark):
    log = queries.document_log(awkward(spark))
    found = txlog.reassemble(log, 4)
    assert found.undone.filter("seq IS NULL").count() == 0
    assert txlog.store_after_epochs(found, F.length("value")).count() == found.epochs.count()
    none = txlog.reassemble(queries.document_log(empty(spark)), 4)
    assert none.undone.count() == none.versions.count() == txlog.store_after_epochs(none, F.length("value")).count() == 0


def brute_judge(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.encode().lower().decode()
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(((*f[:3], f[3], f[4]) for f in fits if host), default=None)
    return host, path, best[3] if best else None, best[4] if best else otherwise


RULES = [*queries.URL_RULES, ("block", "example.org", ""), ("allow", "a.example.org", "/x"), ("block", "a.example.org", "/xy"), ("block", "b.c.d.e", "/1/2/3/4"), ("allow", "c.d.e", "/1/2/3/45"), ("block", "port.com:80", "/"), ("block", "both.com", "/q/"), ("allow", "both.com", "/q/"), ("allow", "ex", "/a//b/")]
URLS = [
    None, "", "example.com/en/", "http://", "http://com", "http://com/", "http://COM/", "http://x.com?/en/", "http://example.com/en/", "https://WWW.Example.com/en/a?b://c", "http://www.example.com/EN/", "http://xexample.com/en/",
    "http://example.com/en", "http://net/es/", "ftp://a.net/fr/x#y", "http://a.net/fr#/", "http://example.org", "http://example.org#a", "http://a.example.org/xyz", "http://a.example.org/x/y", "http://b.a.example.org/", "http://z.b.c.d.e/1/2/3/4",
    "http://b.c.d.e/1/2/3/456/7/8/9", "http://port.com:80/a", "http://user@port.com:80/a", "http://both.com/q/", "http://.com/", "http://com./", "http://..com/", "http://ex/a//b/", "http://ex/a/b/", "://net/es/é", "http://É.COM/\n/en/", "http://example.com/en/\nx?y", "x" * 50_000 + "://net/fr/" + "/" * 50_000,
]


@pytest.mark.parametrize("limit", [0, 50_000])
def test_urls_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "RULE_LIMIT", limit)
    pages = spark.createDataFrame([(k % 7, u, "h", "p") for k, u in enumerate(URLS * 2)], "page_id int, url string, host string, `a.b` string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, [*RULES, ("block", "", "/"), (None, "com", "/en/")]))
    want = Counter((k % 7, u, *brute_judge(u, RULES)) for k, u in enumerate(URLS * 2))
    assert Counter(map(tuple, got.select("row.page_id", "row.url", "host", "path", "rule", "verdict").collect())) == want
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, RULES)).count() == 0
    none = urlfilter.judge(pages, urlfilter.rule_table(spark, RULES).limit(0), otherwise="block")
    assert {r.verdict for r in none.collect()} == {"block"} and none.count() == len(URLS) * 2


def test_url_query_equals_sql_and_is_native(spark, sf):
    got = queries.op13_url_filters(spark, sf)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op13_url_filters']})").fetchall()
    assert Counter(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == Counter(want)
    assert {"allow", "block"} == {w[4] for w in want}
