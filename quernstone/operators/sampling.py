"""Deterministic sampling, batching, and reference selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import numbered


def evenly_spaced(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """count rows at round(i * (n - 1) / (count - 1)), half to even; the middle one for a count of 1."""
    n = df.count()
    picks = [n // 2] if count == 1 else [round(i * (n - 1) / (count - 1)) for i in range(count)] if n > count else list(range(n))
    return numbered(df, order, "_i").filter(F.col("_i").isin(sorted(set(picks)))).drop("_i")


def stratified(df: DataFrame, strata: list[str], order: list[str], count: int) -> DataFrame:
    """Round robin over strata, the largest first: every first row, then every second, until count."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    ranked = sizes.withColumn("_group", F.row_number().over(Window.orderBy(F.desc("_size"), *strata)))
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    # no stratum can give more rows than count, so the rest never reaches the final sort
    rows = df.withColumn("_turn", turn).filter(F.col("_turn") <= count).join(F.broadcast(ranked.filter(F.col("_group") <= count)), strata)
    return rows.orderBy("_turn", "_group").limit(count).drop("_turn", "_group", "_size")


def cursor_reset_order(sizes: list[int], count: int) -> list[int]:
    """Groups in the order of picks when they take turns and the turn restarts once a group has run out."""
    left, picks, at = list(sizes), [], 0
    live = [i for i, n in enumerate(left) if n]
    while live and len(picks) < count:
        at %= len(live)
        g = live[at]
        picks.append(g)
        left[g] -= 1
        if left[g]:
            at += 1
        else:
            live.pop(at)
            at = 0
    return picks


def balanced(df: DataFrame, topic: list[str], order: list[str], count: int) -> DataFrame:
    """Turns over topics with the cursor reset; the sequence depends on the topics' sizes alone, up to count each."""
    sizes = df.groupBy(*topic).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.least("n", F.lit(count))).orderBy(F.desc("n"), *topic).limit(count).collect()
    picks = cursor_reset_order([r["n"] for r in sizes], count)
    taken: dict[int, int] = {}
    rows = []
    for number, g in enumerate(picks):
        taken[g] = taken.get(g, 0) + 1
        rows.append((*(sizes[g][t] for t in topic), taken[g], number))
    spark = df.sparkSession
    schema = df.select(*topic).schema.add("_turn", T.IntegerType()).add("pick_number", T.IntegerType())
    turn = F.row_number().over(Window.partitionBy(*topic).orderBy(*order))
    return df.withColumn("_turn", turn).join(F.broadcast(spark.createDataFrame(rows, schema)), [*topic, "_turn"]).drop("_turn")


def contrast(df: DataFrame, score: str, tie: list[str], count: int) -> DataFrame:
    """The high and low halves of count by score, and the middle row if count is odd, each with its band.

    Where count is not below the number of rows, every row comes once, in the band of its side of the middle.
    """
    n = df.count()
    rising = [F.asc(score), *(F.desc(t) for t in tie)]
    if count < n:
        half = count // 2
        out = df.orderBy(F.desc(score), *tie).limit(half).withColumn("band", F.lit("high")).unionByName(df.orderBy(*rising).limit(half).withColumn("band", F.lit("low")))
        if count % 2 == 0:
            return out
    ranked = numbered(df, rising, "_i")
    if count < n:
        return out.unionByName(ranked.filter(F.col("_i") == n - 1 - n // 2).drop("_i").withColumn("band", F.lit("middle")))
    side = F.col("_i") * 2 - (n - 1)
    return ranked.withColumn("band", F.when(side > 0, "high").when(side < 0, "low").otherwise("middle")).drop("_i")


def recommended_count(n: int) -> int:
    """All of up to 40, else four times the root, between 20 and 60."""
    return n if n <= 40 else min(n, 60, max(20, math.ceil(4 * math.sqrt(n))))


def batches(df: DataFrame, groups: list[str], order: list[str], size: int) -> DataFrame:
    """batch number (from 0) of fixed size within every group."""
    at = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(at / size))


def next_batch(candidates: DataFrame, selected: DataFrame, key: str, groups: list[str], order: list[str], count: int) -> DataFrame:
    """The next rows of each group that aren't selected yet."""
    rest = candidates.join(selected.select(key), key, "left_anti")
    return rest.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_n") <= count).drop("_n")


def first_occurrences(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Order-preserving distinct: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def round_robin_references(cards: DataFrame, owner: str, refs: str) -> DataFrame:
    """(ref, owner, position, rank): references taken in turns over owners, each at its first place only."""
    spread = cards.select(owner, F.posexplode(refs).alias("position", "ref"))
    first = first_occurrences(spread, ["ref"], ["position", owner])
    return numbered(first, ["position", owner], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def greedy_budget(cards: list[tuple[str, int]], most_cards: int, most_chars: int) -> list[str]:
    """Cards in order while they fit; one that doesn't fit is skipped and the next is tried. A bounded control-plane list."""
    out, chars = [], 0
    for key, size in cards:
        if len(out) < most_cards and chars + size <= most_chars:
            out.append(key)
            chars += size
    return out


def coverage(eligible: DataFrame, selected: DataFrame, groups: list[str]) -> DataFrame:
    """Eligible and selected rows of every group; none selected is zero."""
    a = eligible.groupBy(*groups).agg(F.count(F.lit(1)).alias("eligible"))
    b = selected.groupBy(*groups).agg(F.count(F.lit(1)).alias("selected"))
    return a.join(b, groups, "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def hash_sample(df: DataFrame, key: Column, seed: str, per_group: int, groups: list[str]) -> DataFrame:
    """per_group rows of every group by a seeded hash of the key."""
    draw = F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(draw))).filter(F.col("_n") <= per_group).drop("_n")


def two_batch_stability(batches_done: DataFrame, family: str, order: str, added: str) -> DataFrame:
    """Families whose last two batches both brought nothing new."""
    last = batches_done.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(F.desc(order)))).filter("_n <= 2")
    return last.groupBy(family).agg(F.count(F.lit(1)).alias("batches"), (F.bool_and(~F.col(added)) & (F.count(F.lit(1)) == 2)).alias("stable"))


def cover_in_turn(levels: list[list[tuple[str, list[str]]]], count: int) -> list[str]:
    """Ids that cover every group of every level before any group is taken up again.

    Each level is groups (name, ids in order of preference), the most important
    level first. A group gets its first id that isn't taken; then the groups of
    the second level (families) take turns until count.
    """
    taken: dict[str, None] = {}
    total = len({i for groups in levels for _, ids in groups for i in ids})

    def by_size(groups: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
        return sorted(groups, key=lambda g: (-len(g[1]), g[0]))

    def take(ids: list[str], always: bool) -> bool:
        if len(taken) >= min(count, total):
            return False
        pick = next((i for i in (ids[:1] if always else ids) if i not in taken), None)
        if pick is not None:
            taken[pick] = None
        return pick is not None

    for depth, groups in enumerate(levels):
        for _, ids in by_size(groups):
            take(ids, depth == 0)
    turns = by_size(levels[min(1, len(levels) - 1)])
    while any([take(ids, False) for _, ids in turns]):
        pass
    return list(taken)


def family_stratified(df: DataFrame, key: str, levels: list[str], order: list[str], count: int) -> DataFrame:
    """Covers directories, then families, then projects and components, then takes turns over families.

    Only the first count ids of every group reach the driver: no group can give more.
    """
    held = []
    for column in levels:
        rank = F.row_number().over(Window.partitionBy(column).orderBy(*order))
        size = F.count(F.lit(1)).over(Window.partitionBy(column))
        rows = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("g"), F.col(key).cast("string").alias("id"), rank.alias("n"), size.alias("size")).filter(F.col("n") <= count)
        groups: dict[str, list[str]] = {}
        for r in rows.orderBy(F.desc("size"), "g", "n").limit(count * count).collect():
            groups.setdefault(str(r["g"]), []).append(r["id"])
        held.append(list(groups.items()))
    picks = cover_in_turn(held, count)
    table = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(picks)], "_key string, pick_number int")
    return df.join(F.broadcast(table), F.col(key).cast("string") == F.col("_key")).drop("_key")


STRATEGIES = ("auto", "latest", "earliest", "full_census", "pilot", "stratified", "balanced_topic", "family_stratified", "contrast")


def select(df: DataFrame, strategy: str, count: int, key: str, group: str, time: str, score: str | None = None) -> tuple[DataFrame, list[str]]:
    """Rows by a named strategy, and warnings about what such a sample can't show."""
    if strategy not in STRATEGIES:
        raise ValueError(f"invalid strategy: {strategy}")
    if count < 1:
        raise ValueError("count must be positive")
    if strategy == "auto":
        strategy = "contrast" if score else "stratified"
    if strategy == "contrast":
        if not score:
            raise ValueError("contrast needs a score")
        n = df.count()
        return contrast(df, score, [key], min(count, n)).drop("band"), ["a contrast gives leads, not causes"] + (["under twelve comparable rows"] if n < 12 else [])
    if strategy == "full_census":
        return df, []
    if strategy in ("latest", "earliest"):
        return df.orderBy(F.desc(time) if strategy == "latest" else F.asc(time), key).limit(count), [f"{strategy} rows show one end of the period only"]
    if strategy == "balanced_topic":
        return balanced(df, [group], [key], count).drop("pick_number"), []
    if strategy == "family_stratified":
        return family_stratified(df, key, [group], [key], count).drop("pick_number"), ["families are provisional"]
    return stratified(df, [group], [key], count), ["a pilot is for methods, not results"] if strategy == "pilot" else []
