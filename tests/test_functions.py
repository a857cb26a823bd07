"""Casts, predicates and text functions on hand-made values."""

from __future__ import annotations

import datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as ft
from quernstone.functions import types as ty
from quernstone.functions.predicates import SpecError, predicate


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize("value,want", [("1,234.5", 1234.5), (" 7 ", 7.0), ("", None), (None, None), ("nan", None), ("inf", None), ("1_000", None), ("1d", None), ("-.5", -0.5), ("1e3", 1000.0), ("1e999", None), ("12%", None)])
def test_lenient_number(spark, value, want):
    assert one(spark, value, ty.lenient_number) == want


def test_strict_number_takes_percent(spark):
    assert one(spark, "12%", ty.strict_number) == 12.0
    assert one(spark, "x", ty.is_invalid_number) is True
    assert one(spark, " ", ty.is_invalid_number) is False


@pytest.mark.parametrize("value,want", [("20240229", datetime.date(2024, 2, 29)), ("20240229.0", datetime.date(2024, 2, 29)), ("2024/3/1 10:00", datetime.date(2024, 3, 1)), ("2026-02-30", None), ("hello", None), (None, None)])
def test_lenient_date(spark, value, want):
    assert one(spark, value, ty.lenient_date) == want


def test_temporal_end_of_day(spark):
    assert one(spark, "2024-01-31", lambda c: ty.temporal(c, end_of_day=True)) == datetime.datetime(2024, 1, 31, 23, 59, 59, 999999)
    assert one(spark, "2024-01-31", ty.temporal) == datetime.datetime(2024, 1, 31)


def test_group_key_and_truthy(spark):
    assert one(spark, "  ", ty.group_key) == "__MISSING__"
    assert one(spark, " YES ", ty.truthy) is True
    assert one(spark, None, ty.truthy) is False


@pytest.mark.parametrize(
    "value,spec,want",
    [
        ("5", {"operator": "between", "value": [5, 6]}, True), ("2024-01-31", {"operator": "between", "value": ["2024-01-01", "2024-01-31"]}, True), ("2024-02-01", {"operator": "outside", "value": ["2024-01-01", "2024-01-31"]}, True),
        ("1,000", {"operator": "eq", "value": 1000}, True), (" a ", {"operator": "eq", "value": "a"}, True), ("a", {"operator": "neq", "value": "b"}, True), ("-4", {"operator": "abs_gte", "value": 3}, True),
        ("9.4", {"operator": "approx_eq", "value": 9, "tolerance": 0.5}, True), ("x", {"operator": "gt", "value": 1}, None),
    ],
)
def test_predicate(spark, value, spec, want):
    assert one(spark, value, lambda c: predicate(c, spec)) == want


def test_predicate_specs_are_checked(spark):
    with pytest.raises(SpecError):
        predicate(F.lit("1"), {"operator": "like", "value": 1})
    with pytest.raises(SpecError):
        predicate(F.lit("1"), {"operator": "between", "value": 1})


def test_tokens_and_titles(spark):
    assert one(spark, "Ab_1 你好吗 x", ft.tokens) == ["ab_1", "你", "好", "吗", "x", "你好", "好吗"]
    assert one(spark, "ＡＢ-Ｃ １2!", ft.normalize_title) == "abc12"
    date, title = ft.publish_stamp(F.lit("[20240102]A title"))
    assert spark.range(1).select(date, title).first()[:] == (datetime.date(2024, 1, 2), "A title")
    assert one(spark, "1.2万 reads", ft.numeric_count) == 12000.0
    assert one(spark, "a10b2", ft.natural_key) < one(spark, "a10b10", ft.natural_key)
    assert one(spark, "a999999999999", ft.natural_key) < one(spark, "a1234567890123", ft.natural_key) < one(spark, "a" + "9" * 40, ft.natural_key)
    assert one(spark, "a007", ft.natural_key) == one(spark, "A7", ft.natural_key) < one(spark, "a8", ft.natural_key)
    assert one(spark, "x\r\n\r\n\r\ny  z", ft.clean_text) == "x\n\ny z"


def test_message_key(spark):
    blank = F.lit(None).cast("string")
    key = lambda pid: ft.message_key(pid, F.lit("a"), F.lit(1), F.lit(0), F.lit("hi"))
    a, b = spark.range(1).select(key(F.lit("7")).alias("a"), key(blank).alias("b")).first()
    assert a == "platform:7" and b.startswith("fallback:")


@pytest.mark.parametrize("value,want", [(None, "empty_or_negligible"), ("short", "empty_or_negligible"), ("plain readable words go here", "usable_candidate"), ("#$%&/()=?*+~^|<>@!{}[]", "garbled_candidate"), ("readable words but also \ue000\ue001 \ue002", "garbled_candidate")])
def test_text_state(spark, value, want):
    assert one(spark, value, ft.text_state) == want


def test_strip_is_linear_in_inner_white_space(spark):
    inner = "x" + "\u3000 " * 200_000 + "y"
    assert one(spark, "\u2028\t " + inner + "\x1f\xa0\n", ty.strip) == inner
    assert one(spark, " \u3000\x85", ty.strip) == ""


def test_nfkc_sends_only_other_scripts_to_python(spark):
    assert one(spark, "Ａ１ Plain", ft.nfkc) == "A1 Plain" and one(spark, "Plain", ft.nfkc) == "Plain" and one(spark, None, ft.nfkc) is None


def test_numbers_are_not_read_as_text(spark):
    from quernstone.functions.predicates import OPERATORS, predicate
    from quernstone.functions.types import strict_number, strict_number_of

    values = [None, 0.0, -0.0, 12.0, 11.5, -4.0, 1e-7, 1.5e300, float("nan"), float("inf"), 0.1]
    df = spark.createDataFrame([(v,) for v in values], "d double").select("d", F.col("d").cast("float").alias("f"), F.when(F.abs("d") < 1000, F.col("d")).cast("decimal(12,3)").alias("m"))
    for c in df.columns:
        number = strict_number_of(df, c)
        assert "regexp" not in str(number) or c == "f"
        pairs = [(strict_number(F.col(c)), number)]
        for o in OPERATORS:
            spec = {"operator": o, "value": [3, 12] if o in ("between", "outside") else 12, "tolerance": 0.5}
            pairs.append((predicate(F.col(c), spec), predicate(F.col(c), spec, number)))
        assert df.filter(~reduce(lambda a, b: a & b, (a.eqNullSafe(b) for a, b in pairs))).count() == 0


def test_predicate_matrix_has_a_row_for_each_operator_of_an_empty_table(spark, tmp_path):
    from quernstone.plans.catalog import PREDICATES, predicate_matrix

    spark.createDataFrame([], "value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in predicate_matrix(spark, str(tmp_path)).collect()} == {(k, 0, 0) for k in PREDICATES}


def test_slices_of_a_batch_are_bounded():
    import pyarrow as pa

    from quernstone import session

    texts = ["x" * 700_000, None, "y" * 700_000, "", "z" * 3_000_000] + ["w"] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    parts = list(session.bounded_slices(batch, 1))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(len(texts)))
    for p in parts:
        assert len(p) <= session.SLICE_ROWS and (len(p) == 1 or sum(sizes := [len(t or "") for t in p.column(1).to_pylist()]) - max(sizes) <= session.SLICE_BYTES)
    assert list(session.bounded_slices(batch.slice(0, 0), 1)) == []
