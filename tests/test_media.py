from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import corpus, media


def test_ocr(spark):
    head = "\t".join(media.TSV_FIELDS)
    row = lambda level, line, word, left, conf, text: f"{level}\t1\t1\t1\t{line}\t{word}\t{left}\t5\t10\t8\t{conf}\t{text}"
    text = "\n".join([head, row(4, 1, 0, 0, -1, ""), row(5, 1, 1, 0, 90, 'say "hi'), row(5, 1, 2, 12, 80, "there"), row(5, 2, 1, 0, 50, " ")])
    words = media.ocr_words(spark.createDataFrame([("f", text)], "path string, text string"))
    line = media.ocr_lines(words).first()
    assert words.count() == 2 and (line.line, line.mean_confidence, line.left, line.width, line.height) == ('say "hi there', 85.0, 0, 22, 8)
    runs = spark.createDataFrame([("f", 3, 90.0, 5), ("f", 6, 60.0, 40), ("f", 4, 60.0, 40)], "path string, mode int, mean_confidence double, characters int")
    assert media.best_ocr_run(runs).first().mode == 4
    box = media.polygon_boxes(spark.createDataFrame([([[1.0, 2.0], [5.0, 2.0], [4.0, 9.0]],), ([[0.0, 0.0]],)], "polygon array<array<double>>")).collect()
    assert (box[0].left, box[0].top, box[0].width, box[0].height) == (1.0, 2.0, 4.0, 7.0) and not box[1].valid


def test_transcripts(spark):
    segs = [{"start": 0, "end": 1.5, "text": " Hi there", "avg_logprob": -0.2, "no_speech_prob": 0.1}, {"start": 3, "end": 4, "text": "hi  there"}, {"start": 2, "end": 3, "text": "", "no_speech_prob": 0.9}]
    s = media.transcript_segments(spark.createDataFrame([("f", json.dumps({"segments": segs}))], "path string, text string"), 1000)
    assert [(r.start_ms, r.end_ms) for r in s.orderBy("segment").collect()] == [(1000, 2500), (4000, 5000), (3000, 4000)]
    r = media.transcript_screen(s).first()
    assert (r.segments, r.empty, r.flagged, r.out_of_order, r.repeated) == (3, 1, 1, 1, 2)


def test_pages(spark):
    pages = spark.createDataFrame([("a", 1, 600.0, 2500.0), ("a", 2, 600.0, 800.0), ("b", 1, 600.0, 800.0), ("c", 1, 600.0, 800.0), ("c", 2, 600.0, 801.0)], "path string, page int, width double, height double")
    by = {r.path: r for r in media.page_units(media.page_geometry(pages)).collect()}
    assert (by["a"].status, by["b"].status, by["c"].status, by["c"].provisional_units) == ("provisional_page_units", "single_page_source", "internal_units_unresolved", None)
    assert media.page_plan(0) == [] and media.page_plan(5, 2) == [1, 5] and media.page_plan(4, 12) == [1, 2, 3, 4]
    plan = media.page_plan(100, 8, [50, 51])
    assert len(plan) == 8 and {1, 2, 3, 100} <= set(plan) and {50, 51} & set(plan)
    assert media.parse_pages("1, 3-5", 9, 9) == [1, 3, 4, 5]
    for bad in ("5-3", "0", "10", "", "x"):
        with pytest.raises(ValueError):
            media.parse_pages(bad, 9, 9)
    assert media.spaced_pages(10, 3) == [1, 5, 10] and media.spaced_timestamps(1000, 3) == [250, 500, 750]
    assert media.clip_bounds(60_000, 1) == (0, 60_000)
    with pytest.raises(ValueError):
        media.clip_bounds(120_000, 1)


def test_images(spark):
    rows = [("a", 1, "x"), ("a", 2, "t"), ("a", 3, "t"), ("b", 1, "t"), ("b", 2, "t"), ("c", 1, "t"), ("c", 2, "y")]
    assert [(r.sha256, r.occurrences) for r in media.fixed_endings(spark.createDataFrame(rows, "article string, number int, sha256 string")).collect()] == [("t", 4)]
    refs = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 2.0), ("b", 1, 1.0), ("b", 2, 1.0)], "article string, position int, ratio double")
    images = spark.createDataFrame([("a", 4, 100, 50), ("a", 9, 100, 50), ("b", 1, 10, 10)], "article string, number int, width int, height int")
    assert {(r.article, r.position): r.status for r in media.map_images(refs, images).collect()} == {("a", 1): "order_and_ratio", ("a", 2): "ratio_conflict", ("b", 1): "count_mismatch", ("b", 2): "missing_local"}


def test_spread(spark):
    assert media.spread_order(5) == [2, 0, 3, 1, 4] and media.spread_order(0) == []
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(5)], "g string, i int")
    assert sorted((r.g, r.i) for r in media.spread_sample(df, ["g"], ["i"], 3).collect()) == [("a", 0), ("a", 2), ("b", 2)]


def test_blocks_exports_and_bodies(spark):
    cells = [("p", "s", 1, 2, "day"), ("p", "s", 1, 3, "n"), ("p", "s", 2, 2, "d1"), ("p", "s", 2, 3, "5"), ("p", "s", 4, 2, "d2"), ("p", "s", 40, 2, "far")]
    out = media.sheet_blocks(spark.createDataFrame(cells, "path string, sheet string, row_no int, col_no int, cell string"), {"daily": ["day", "n"]}).orderBy("row_no").collect()
    assert [(r.row_no, list(r["values"])) for r in out] == [(2, ["d1", "5"]), (4, ["d2", None])]
    files = spark.createDataFrame([("a", '{"meta": {}, "messages": []}'), ("b", '{"x": 1}'), ("c", "{")], "path string, text string")
    assert {r.path: r.status for r in media.discover_exports(files, ["meta", "messages"]).collect()} == {"a": "recognized", "b": "ignored", "c": "failed"}
    docs = spark.createDataFrame([(1, "x<<body>>y"), (2, "x<<tail"), (3, "plain")], "k int, text string")
    assert {r.k: (r.body, r.status) for r in media.article_bodies(docs, "k", "<<", ">>").collect()} == {1: ("body", "bounded"), 2: ("tail", "no_end"), 3: ("plain", "no_start")}


def test_capture_units(spark):
    paths = {
        "A/Screenshot_2024-01-05_101112.png": 2, "a/screen-shot 2024_01_05 105959.png": 2, "a/截图2024-01-05-110000.png": 1, "b/Screenshot_2024-01-05_101112.png": 1, "b/Report page 1.png": 3, "b/report_P2.png": 3, "B/Report（3）.png": 3,
        "b/report.png": 1, "c/Report page 1.png": 1, "page 3.png": 1, "b/第1页.png": 1,
    }
    got = {r.path: (r.unit, r.members) for r in corpus.capture_units(spark.createDataFrame([(p,) for p in [*paths, "b/report.png"]], "path string")).collect()}
    assert {p: n for p, (_, n) in got.items()} == paths
    assert got["a/screen-shot 2024_01_05 105959.png"][0] == "a/screen-shot 2024_01_05 105959.png" and got["b/report_P2.png"][0] == "b/Report page 1.png"
    exports = {"x/sales_2024-01-05.csv": "sales", "sales export_12.csv": "sales", "20240105.csv": "unnamed_export", "订单1月5日.csv": "订单", "sales1234567890.csv": "sales"}
    for path, want in exports.items():
        assert spark.createDataFrame([(path,)], "p string").select(corpus.export_stem(F.col("p"))).first()[0] == want, path


def test_capture_keys_are_made_once(spark):
    """What follows the keys reads them, instead of trying the patterns on every name again."""
    paths = ["a/Screenshot_2024-01-05_101112.png", "a/Screenshot_2024-01-05_100000 page 2.png", "a/ x page 2.png", "a/X-P3.png", "a/page 2.png", None]
    found = corpus.capture_units(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {(r.path, r.members) for r in found.collect()} == {(p, 1 if p == "a/page 2.png" else 2) for p in paths if p}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "_nfkc" not in plan


def test_best_ocr_run_rounds_as_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(1, "view", v) for v in (64.95, 64.965)] + [(2, "click", 0.04996)] * 25 + [(3, "view", 57.9025)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sql = entry.oracle_sql()["best_ocr_run"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()["best_ocr_run"](spark, str(tmp_path)).select("path", "mode", "mean_confidence", "characters", "score").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())
