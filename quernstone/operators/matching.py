"""Record matching, containment and rule joins, set checks."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINIMUM_RATIO = 0.72
AMBIGUOUS_GAP = 0.03


#: Titles and characters of a cell, in the mean; cells of a block meet as rows, titles only inside them.
CELL_TITLES = 512
CELL_CHARS = 1 << 20
#: Characters are counted in so many classes for the bound on the ratio; classes that share characters only loosen it.
CLASSES = 64


def _profile(titles: list[str]) -> np.ndarray:
    out = np.zeros((len(titles), CLASSES), dtype=np.int32)
    for i, t in enumerate(titles):
        codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % CLASSES
        out[i] = np.bincount(codes, minlength=CLASSES)
    return out


def cell_ratios(a: list[str], b: list[str], minimum: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of the pairs that reach minimum: only those whose lengths and common characters let them are compared."""
    left, right = _profile(a), _profile(b)
    sizes = left.sum(1)
    matcher = difflib.SequenceMatcher(None)
    for j, other in enumerate(b):
        total = sizes + len(other)
        common = np.minimum(left, right[j]).sum(1)
        matcher.set_seq2(other)
        for i in np.flatnonzero(2 * common >= minimum * total - 1e-9):
            matcher.set_seq1(a[i])
            ratio = matcher.ratio()
            if ratio >= minimum:
                yield int(i), j, ratio


def _cells(rows: DataFrame, block: list[str], key: str, title: str, name: str) -> DataFrame:
    """(block, name, name_n, name_rows): the different (key, title) of every block, dealt by hash to cells of bounded mean size."""
    rows = rows.filter(F.col(title).isNotNull()).select(*block, F.col(key).alias("k"), F.col(title).alias("t")).distinct()
    size = F.greatest(F.count(F.lit(1)) / CELL_TITLES, F.sum(F.length("t")) / CELL_CHARS)
    counts = rows.groupBy(*block).agg(F.ceil(F.greatest(size, F.lit(1.0))).cast("int").alias(f"{name}_n"))
    dealt = rows.join(counts, block).withColumn(name, F.pmod(F.xxhash64("k", "t"), F.col(f"{name}_n")).cast("int"))
    return dealt.groupBy(*block, name, f"{name}_n").agg(F.collect_list(F.struct("k", "t")).alias(f"{name}_rows"))


def exact_match(items: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join of items on the normalised keys."""
    return items.join(groups, keys, "left")


def fuzzy_match(items: DataFrame, groups: DataFrame, block: list[str], item_key: str, item_title: str, group_key: str, group_title: str, minimum: float = MINIMUM_RATIO, gap: float = AMBIGUOUS_GAP) -> DataFrame:
    """The best title inside the block, if similar enough; ambiguous if the runner-up is as good and close.

    Blocks are equi-join keys (a date). The titles of a block lie in cells; each cell of
    items is copied to the block's cells of groups, so a hot block is spread over as
    many tasks as it has cells, and only pairs that reach minimum become rows. Inside a
    pair of cells, counts of characters bound the ratio before it is computed.
    Null titles match nothing, two empty ones match.
    """
    left, right = _cells(items, block, item_key, item_title, "a"), _cells(groups, block, group_key, group_title, "b")

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("ratio", T.DoubleType())])))
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j, "ratio": r} for i, j, r in cell_ratios(list(x), list(y), minimum)] for x, y in zip(a, b, strict=True)], dtype="object")

    spread = left.join(right.select(*block, "b_n").distinct(), block).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("b_n") - 1))).drop("b_n")
    met = spread.join(right.drop("b_n"), [*block, "b"])
    named = lambda p: F.struct(F.get("a_rows", p["i"])["k"].alias("x"), F.get("b_rows", p["j"])["k"].alias("y"), p["ratio"].alias("ratio"))
    found = met.withColumn("p", ratios(F.col("a_rows.t"), F.col("b_rows.t"))).select(F.explode(F.transform("p", named)).alias("p"))  # pairs alone are exploded, not their cells
    scored = found.select(F.col("p.x").alias(item_key), F.col("p.y").alias(group_key), "p.ratio")
    w = Window.partitionBy(item_key).orderBy(F.desc("ratio"), group_key)
    best = scored.select(item_key, group_key, "ratio", F.row_number().over(w).alias("n"), F.lead("ratio").over(w).alias("next")).filter("n = 1")
    status = F.when(F.col("next").isNotNull() & (F.round(F.col("ratio") - F.col("next"), 9) < gap), "ambiguous").otherwise("matched")
    found = best.select(item_key, F.when(status == "matched", F.col(group_key)).alias(group_key), F.round("ratio", 6).alias("ratio"), status.alias("status"))
    return items.select(item_key).join(found, item_key, "left").withColumn("status", F.coalesce("status", F.lit("none")))


def last_row_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The lookup side of a join in which later rows replace earlier ones."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order)))).filter("_n = 1").drop("_n")


def unmatched(groups: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return groups.join(matches.filter(F.col(key).isNotNull()).select(key), key, "left_anti")


def rule_join(sheets: DataFrame, key: str, text: str, rules: list[tuple[str, int, str]]) -> DataFrame:
    """(key, rule, status): the rule of the highest priority whose pattern matches; several such are ambiguous, none unmatched.

    rules (id, priority, pattern) are a short literal list, so each row tests them in place of a theta join.
    """
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(priority).alias("priority"), F.lit(rule).alias("rule"))) for rule, priority, p in rules)))
    top = F.filter("hits", lambda h: h["priority"] == F.array_max("hits")["priority"])
    out = sheets.select(key, hits.alias("hits")).withColumn("top", top)
    status = F.when(F.size("top") == 0, "unmatched").when(F.size("top") > 1, "ambiguous").otherwise("matched")
    return out.select(key, F.when(F.size("top") == 1, F.get("top", F.lit(0))["rule"]).alias("rule"), status.alias("status"))


def deepest_root(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """The longest root that contains the path, found by its ancestors: an equi-join, not a prefix theta join."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = paths.select(path, F.explode(ancestors).alias("_a"))
    hit = spread.join(roots.select(F.col(root).alias("_a")).distinct(), "_a").groupBy(path).agg(F.max_by("_a", F.length("_a")).alias(root))
    return paths.select(path).join(hit, path, "left")


def reference_check(wanted: DataFrame, owner: str, ref: str, evidence: DataFrame, status: str) -> DataFrame:
    """(owner, ref, problem): references that are unknown or not verified; wanted has a row for each reference of an owner."""
    found = wanted.select(owner, ref).distinct().join(evidence.select(ref, status), ref, "left")
    problem = F.when(F.col(status).isNull(), "unknown_reference").when(F.col(status) != "verified", "unverified_reference")
    return found.select(owner, ref, problem.alias("problem")).filter("problem is not null")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def set_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def is_subset(members: DataFrame, whole: DataFrame, key: str) -> bool:
    return members.select(key).join(whole.select(key), key, "left_anti").isEmpty()


def multiset_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every occurrence of a key in a beyond its occurrences in b."""
    return a.select(key).exceptAll(b.select(key))


def overlapping_intervals(intervals: DataFrame, key: str, start: str, end: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, day, first, second): on every day that intervals share, each against the one before it by key.

    Intervals meet inside the columns of within only. Days are exploded, so the rows grow with the days covered and not with pairs.
    """
    days = intervals.select(*within, F.col(key).alias("second"), F.explode(F.sequence(start, end)).alias("day")).distinct()
    before = F.lag("second").over(Window.partitionBy(*within, "day").orderBy("second"))
    return days.withColumn("first", before).filter("first is not null").select(*within, "day", "first", "second")


def referential_integrity(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column, value, rows) of values that the parent lacks; keys are (child, column, parent, column)."""
    out = None
    for child, column, parent, other in keys:
        values = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        lost = values.join(tables[parent].select(F.col(other).cast("string").alias("value")), "value", "left_anti")
        rows = lost.select(F.lit(child).alias("child"), F.lit(column).alias("column"), "value", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def reconcile(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """Keys whose values differ by more than the tolerance or are on one side only."""
    both = a.select(*key, F.col(value).alias("left_value")).join(b.select(*key, F.col(value).alias("right_value")), key, "full_outer")
    problem = F.when(F.col("left_value").isNull() != F.col("right_value").isNull(), "one_side").when(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, "different")
    return both.withColumn("problem", problem).filter("problem is not null")
