"""Queries over all rows: what a filter on ids, a cap or a prefix would lose."""

from __future__ import annotations

import datetime
import difflib
import random

from quernstone.operators import matching
from quernstone.plans import catalog_media, catalog_text


def test_every_interval_of_a_day(spark):
    d = datetime.date
    rows = [("a", d(2024, 1, 1), d(2024, 1, 10), 1), ("b", d(2024, 1, 1), d(2024, 1, 10), 1), ("c", d(2024, 1, 9), d(2024, 1, 11), 1), ("d", d(2024, 1, 10), d(2024, 1, 10), 2)]
    iv = spark.createDataFrame(rows, "k string, s date, e date, g int")
    got = {(r.day.day, r.first, r.second) for r in matching.overlapping_intervals(iv, "k", "s", "e").collect()}
    assert got == {(i, "a", "b") for i in range(1, 11)} | {(9, "b", "c"), (10, "b", "c"), (10, "c", "d")}
    inside = matching.overlapping_intervals(iv, "k", "s", "e", ("g",)).collect()
    assert {(r.g, r.day.day, r.first, r.second) for r in inside} == {(1, i, "a", "b") for i in range(1, 11)} | {(1, 9, "b", "c"), (1, 10, "b", "c")}


def test_references_of_every_order(spark, tmp_path):
    spark.createDataFrame([(1, 1, "1-URGENT"), (2, 2, "1-URGENT"), (500, 1, "1-URGENT"), (9000, 2, "2-HIGH"), (9001, 3, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(101, 5.0), (102, -5.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.o_orderkey, r.ref, r.problem) for r in catalog_text.reference_check(spark, str(tmp_path)).collect()}
    assert got == {(2, 102, "unverified_reference"), (9000, 102, "unverified_reference"), (9001, 103, "unknown_reference")}


def test_images_of_every_customer(spark, tmp_path):
    spark.createDataFrame([(3, 299), (4, 300), (6, 300), (10, 5000), (11, 5000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.article, r.position, r.number, r.status) for r in catalog_media.image_mapping(spark, str(tmp_path)).collect()}
    assert got == {(299, 1, 3, "ratio_conflict"), (300, 1, 4, "ratio_conflict"), (300, 2, 6, "order_and_ratio"), (5000, 1, 11, "count_mismatch"), (5000, 2, -1, "missing_local")}


def test_whole_first_lines_are_compared(spark, tmp_path):
    head = " ".join(f"word{i}" for i in range(16))
    lines = {2: head + " " + "alpha beta " * 6, 4: head + " " + "gamma delta " * 5, 6: "short one", 8: head, 10: ""}
    lines |= {1: head + " " + "alpha beta " * 6 + "x", 3: head + " " + "0123456789 " * 6, 5: "short ones", 7: "0" * 60 + head}
    docs = [(k, "en", "s", t + "\nmore") for k, t in lines.items()]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {k: "".join(t.lower().split()) for k, t in lines.items()}
    want = {}
    for i in (k for k in plain if k % 2 == 0):
        ratios = sorted(((-round(difflib.SequenceMatcher(None, plain[i], plain[k]).ratio(), 9), k) for k in plain if k % 2), key=lambda x: x)
        ratios = [(-r, k) for r, k in ratios if -r >= 0.72]
        status = "none" if not ratios else "ambiguous" if len(ratios) > 1 and ratios[0][0] - ratios[1][0] < 0.03 else "matched"
        want[i] = (status, ratios[0][1] if status == "matched" else None)
    got = {r.doc_id: (r.status, r.other_id) for r in catalog_text.near_title_match(spark, str(tmp_path)).collect()}
    assert got == want and got[2] == ("matched", 1) and got[6] == ("matched", 5)


def test_whole_turns_are_compared(spark, tmp_path):
    long = "the same forty characters and a few more "
    turns = [(1, 0, long + "yes"), (1, 1, long + "no"), (2, 0, long + "yes"), (2, 1, long + "yes")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.path: r.repeated for r in catalog_media.transcript_screen(spark, str(tmp_path)).collect()} == {1: 0, 2: 2}


def test_whole_titles(spark, tmp_path):
    spark.createDataFrame([(1, "A b. " * 40 + "End")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog_text.compact_titles(spark, str(tmp_path)).first().title == "ab" * 40 + "end"


def test_titles_of_a_hot_block_in_cells(spark, monkeypatch):
    monkeypatch.setattr(matching, "CELL_TITLES", 4)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde字") for _ in range(rng.randint(0, 9)))
    base = [word() for _ in range(12)]
    side = lambda first: [(first + 2 * i, "hot" if i < 20 else rng.choice(["x", None]), None if i == 7 else rng.choice(base)[: rng.randint(0, 9)] + rng.choice(["", "a"])) for i in range(30)]
    items, groups = side(0), side(1)
    groups.append(groups[0])  # a repeated row is no runner-up of itself
    want = {}
    for k, block, title in items:
        ratios = sorted((-difflib.SequenceMatcher(None, title, t).ratio(), g) for g, other, t in set(groups) if block is not None and other == block and title is not None and t is not None)
        ratios = [(-r, g) for r, g in ratios if -r >= 0.72]
        status = "none" if not ratios else "ambiguous" if len(ratios) > 1 and round(ratios[0][0] - ratios[1][0], 9) < 0.03 else "matched"
        want[k] = (status, ratios[0][1] if status == "matched" else None, round(ratios[0][0], 6) if ratios else None)
    a, b = spark.createDataFrame(items, "id long, day string, title string"), spark.createDataFrame(groups, "g long, day string, other string")
    found = matching.fuzzy_match(a, b, ["day"], "id", "title", "g", "other")
    assert {r.id: (r.status, r.g, r.ratio) for r in found.collect()} == want and len({x[0] for x in want.values()}) == 3
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_customers_of_any_order_are_matched(spark, tmp_path):
    """An order of any price matches its customer."""
    spark.createDataFrame([(k,) for k in range(5)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 400_000.0), (3, 20.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog_text.unmatched_customers(spark, str(tmp_path))
    assert sorted(r.key for r in got.collect()) == [0, 2, 4]
