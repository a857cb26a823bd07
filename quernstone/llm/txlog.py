"""Transaction log reassembly: which changes a log's commits make, and which it undoes.

Records (seq, source, kind, key, value) are read by ascending seq. Each source runs
one transaction after another, ended by ``commit``, ``abort`` or the end of the log,
which aborts. A ``change`` sets its key to its value, or deletes the key where the
value is null. ``rollback`` undoes its transaction's remaining changes since its latest
``savepoint``, or all of them without one, and removes that savepoint. A commit applies
its transaction's remaining changes, in log order, to one store; every ``per_epoch``
commits end an epoch, and so does the last one.

1. Records are dealt by range of seq into blocks of bounded size. A running figure of a
   group (a source, a transaction, a key, the whole log) is a window within each block
   and what is carried over from the blocks before, which is itself found block by
   block, BRANCH at a time. No source, transaction or key has to fit in one task.
2. The last end before a record names its transaction. Savepoints and rollbacks count
   up and down a depth that stops at zero. A rollback's target is the last savepoint of
   its level; a rollback at depth zero reaches back to the one before it, or the start.
   These are the undo intervals.
3. Intervals of one level of one transaction don't overlap, and a change's depth is the
   level of the innermost interval around it, which is the one of the earliest rollback.
   So the range join of changes and intervals is on transaction, level and the place
   where the interval begins, and gives each change one interval at most.
4. What remains is reduced to the last change of each key and epoch.

Defined cases: records without seq have no place in the log and take no part; records
equal in every column are one that was delivered twice, others of one seq are ordered
by a hash; a null source is a source, a null key a key; kinds other than the five do
nothing; extra columns are ignored; an empty log has no rows and no epochs. Values of
any length are compared by hash and are only shuffled once, for the changes that remain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Records of a block, about, and the least number of blocks.
BLOCK_ROWS = 1 << 18
LEAST_BLOCKS = 64
#: Epochs of a block of epochs.
EPOCH_BITS = 10
#: Blocks among which one window carries figures on, as a power of two.
BRANCH_BITS = 10

_START = -(1 << 63)
_HOW = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}
_TX = ["source", "tx_seq", "tx_mark"]


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A shuffled join in which null keys meet, with the right side's further columns."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys)).hint("merge")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return left.join(other, same, how).drop(*(f"_{k}" for k in keys))


def _carried(totals: DataFrame, keys: Sequence[str], columns: dict[str, str], last_block: int) -> DataFrame:
    """totals (keys, block, columns) with the columns over all earlier blocks of the group instead; columns: name to sum, max or min."""
    earlier = lambda parts: Window.partitionBy(*parts).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    if last_block < 1 << BRANCH_BITS:
        return totals.select(*keys, "block", *(_HOW[how][0](c).over(earlier(keys)).alias(c) for c, how in columns.items()))
    nested = totals.withColumn("above", F.shiftright("block", BRANCH_BITS))
    upper = nested.groupBy(*keys, F.col("above").alias("block")).agg(*(_HOW[how][0](c).alias(c) for c, how in columns.items()))
    upper = _carried(upper, keys, columns, last_block >> BRANCH_BITS).select(*keys, F.col("block").alias("above"), *(F.col(c).alias(f"{c}_above") for c in columns))
    inner = nested.select(*keys, "above", "block", *(_HOW[how][0](c).over(earlier([*keys, "above"])).alias(c) for c, how in columns.items()))
    return _joined(inner, upper, [*keys, "above"]).select(*keys, "block", *(_HOW[how][1](F.col(c), F.col(f"{c}_above")).alias(c) for c, how in columns.items()))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, how: str, name: str, last_block: int, inclusive: bool) -> DataFrame:
    """rows (with block, which rises with order) with name: sum, max or min of value over the group's rows before each, or up to it."""
    within = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = rows.withColumn("_value", value)
    totals = own.groupBy(*keys, "block").agg(_HOW[how][0]("_value").alias("_before"))
    local = own.withColumn("_local", _HOW[how][0]("_value").over(within)).drop("_value")
    found = _joined(local, _carried(totals, keys, {"_before": how}, last_block), [*keys, "block"])
    return found.withColumn(name, _HOW[how][1](F.col("_local"), F.col("_before"))).drop("_local", "_before")


@dataclass
class Reassembly:
    """undone: seq, key, reason (rollback or abort) and undone_by (null: the log's end) of each change that does not remain.
    versions: epoch, key, seq, deleted and value of the last change to each key in each epoch.
    epochs: each epoch's number, also of those without changes."""

    undone: DataFrame
    versions: DataFrame
    epochs: DataFrame


def _mark() -> Column:
    """What tells records of one seq apart."""
    return F.xxhash64("source", "kind", "key", "value", F.col("source").isNull(), F.col("key").isNull())


def _records(log: DataFrame, deletions: DataFrame | None) -> DataFrame:
    """Narrow records in blocks: mark tells those of one seq apart."""
    own = log.select(F.col("seq").cast("long").alias("seq"), _mark().alias("mark"), "source", "kind", "key", F.col("value").isNull().alias("deleted"))
    own = own.filter("seq IS NOT NULL").distinct()
    if deletions is not None:
        gone = deletions.select(F.col("seq").cast("long").alias("seq"), F.lit(True).alias("gone")).filter("seq IS NOT NULL").distinct()
        own = _joined(own, gone, ["seq"]).withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).drop("gone")
    blocks = max(LEAST_BLOCKS, -(-log.count() // BLOCK_ROWS))
    return materialize(own.repartitionByRange(blocks, "seq", "mark").withColumn("block", F.spark_partition_id()), "log-records")


def reassemble(log: DataFrame, per_epoch: int, deletions: DataFrame | None = None) -> Reassembly:
    """What log (seq, source, kind, key, value) does; changes whose seq is in deletions (seq) delete their key."""
    order = ["seq", "mark"]
    at = F.struct(*order)
    records = _records(log, deletions)
    last = records.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    is_end = F.col("kind").isin("commit", "abort")

    # each record's transaction: its source and the end before it
    placed = running(records, ["source"], order, F.when(is_end, at), "max", "begin", last, inclusive=False)
    placed = placed.withColumn("tx_seq", F.coalesce("begin.seq", F.lit(_START))).withColumn("tx_mark", F.coalesce("begin.mark", F.lit(_START))).drop("begin")
    placed = materialize(placed, "log-transactions")

    # the depth: a running sum less the least it has been, from zero down
    within = Window.partitionBy(*_TX, "block").orderBy(*order)
    step = F.when(F.col("kind") == "savepoint", 1).when(F.col("kind") == "rollback", -1).otherwise(0)
    inner = placed.filter(~is_end).withColumn("x", F.sum(step).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    totals = inner.groupBy(*_TX, "block").agg(F.sum(step).alias("sum"), F.min("x").alias("least"))
    sums = _carried(totals, _TX, {"sum": "sum"}, last).withColumnRenamed("sum", "before")
    lows = _joined(totals, sums, [*_TX, "block"]).withColumn("before", F.coalesce("before", F.lit(0)))
    lows = lows.select(*_TX, "block", "before", (F.col("before") + F.col("least")).alias("low"))
    carried = _joined(_carried(lows.drop("before"), _TX, {"low": "min"}, last), lows.drop("low"), [*_TX, "block"])
    inner = inner.withColumn("low_here", F.min("x").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    inner = _joined(inner, carried, [*_TX, "block"])
    x, low = F.col("x") + F.col("before"), F.least(F.lit(0), F.col("low"), F.col("low_here") + F.col("before"))
    # of a savepoint the depth after it, of a rollback the depth before it, of a change the depth around it
    level = F.when(F.col("kind") == "rollback", x + 1 - low).otherwise(x - low)
    levels = inner.withColumn("level", level).drop("x", "low", "low_here", "before").filter(F.col("kind").isin("change", "savepoint", "rollback"))
    levels = materialize(levels, "log-levels")

    # where the innermost interval around a record begins
    opens = (F.col("kind") == "savepoint") | ((F.col("kind") == "rollback") & (F.col("level") == 0))
    parts = running(levels, [*_TX, "level"], order, F.when(opens, at), "max", "opened", last, inclusive=False)
    parts = parts.withColumn("open_seq", F.coalesce("opened.seq", F.lit(_START))).withColumn("open_mark", F.coalesce("opened.mark", F.lit(_START))).drop("opened", "block")
    parts = materialize(parts.filter("kind <> 'savepoint'"), "log-intervals")
    interval = [*_TX, "level", "open_seq", "open_mark"]
    intervals = parts.filter("kind = 'rollback'").select(*interval, F.col("seq").alias("undone_by"))
    changes = _joined(parts.filter("kind = 'change'").drop("kind"), intervals, interval)

    # the ends, commits numbered over the whole log
    ends = running(placed.filter(is_end), [], order, (F.col("kind") == "commit").cast("long"), "sum", "rank", last, inclusive=True)
    ends = ends.select(*_TX, F.col("kind").alias("end"), F.col("seq").alias("end_seq"), F.when(F.col("kind") == "commit", F.col("rank")).alias("rank"))
    ends = materialize(ends.withColumn("epoch", F.floor((F.col("rank") + per_epoch - 1) / per_epoch)), "log-ends")
    changes = materialize(_joined(changes, ends, _TX).select(*order, "key", "deleted", "undone_by", "end", "end_seq", "rank", "epoch"), "log-changes")

    by_rollback, committed = F.col("undone_by").isNotNull(), F.coalesce(F.col("end") == "commit", F.lit(False))
    undone = changes.filter(by_rollback | ~committed).select(
        "seq", "key", F.when(by_rollback, "rollback").otherwise("abort").alias("reason"), F.when(by_rollback, F.col("undone_by")).otherwise(F.col("end_seq")).alias("undone_by"),
    )
    final = changes.filter(~by_rollback & committed).groupBy("epoch", "key").agg(F.max(F.struct("rank", *order, "deleted")).alias("last"))
    final = final.select("epoch", "key", "last.seq", "last.mark", "last.deleted")
    values = log.filter("kind = 'change' AND value IS NOT NULL").select(F.col("seq").cast("long").alias("seq"), _mark().alias("mark"), "value")
    # a record delivered twice is joined once; neither side has nulls here
    found = final.filter("NOT deleted").join(values.dropDuplicates(order).hint("merge"), order)
    versions = found.unionByName(final.filter("deleted").withColumn("value", F.lit(None).cast(log.schema["value"].dataType))).drop("mark")
    for used in (records, placed, levels, parts):
        discard(used)
    return Reassembly(undone, versions, ends.filter("epoch IS NOT NULL").select("epoch").distinct())


def store_after_epochs(found: Reassembly, measure: Column) -> DataFrame:
    """epoch, keys (how many are stored after it) and total (their sum of measure, a whole number of key and value)."""
    kept = materialize(found.versions.select("epoch", "key", F.when(F.col("deleted"), F.lit(None)).otherwise(measure).cast("long").alias("m"), F.shiftright("epoch", EPOCH_BITS).alias("block")), "log-versions")
    last = found.epochs.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0] >> EPOCH_BITS
    told = running(kept, ["key"], ["epoch"], F.struct("epoch", "m"), "max", "was", last, inclusive=False)
    present = lambda c: F.col(c).isNotNull().cast("long")
    moves = told.groupBy("epoch").agg(F.sum(present("m") - present("was.m")).alias("keys"), F.sum(F.coalesce("m", F.lit(0)) - F.coalesce("was.m", F.lit(0))).alias("total"))
    moves = materialize(_joined(found.epochs, moves, ["epoch"]).na.fill(0, ["keys", "total"]).withColumn("block", F.shiftright("epoch", EPOCH_BITS)), "log-epochs")
    discard(kept)
    out = running(moves, [], ["epoch"], F.col("keys"), "sum", "stored", last, inclusive=True)
    out = running(out, [], ["epoch"], F.col("total"), "sum", "summed", last, inclusive=True)
    return out.select("epoch", F.col("stored").alias("keys"), F.col("summed").alias("total"))
