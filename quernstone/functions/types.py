"""Casts that keep missing, invalid and zero apart, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number once commas are gone; "nan", "inf" and "1_000" don't.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: What a yes looks like.
TRUTHY = ("1", "true", "yes", "y", "是", "有")
MISSING_KEY = "__MISSING__"


#: White space of every script, and what information separators count as.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; one pass, however much there is inside."""
    return F.btrim(c, F.lit(WHITE))


def text(c: Column) -> Column:
    """c as text, stripped; texts that begin and end with a visible ASCII character are left alone."""
    plain = c.cast("string")
    return F.when(F.ascii(plain).between(33, 126) & F.ascii(F.right(plain, F.lit(1))).between(33, 126), plain).otherwise(strip(plain))


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (text(c) == "")


def finite(c: Column) -> Column:
    return F.when((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), c)


def lenient_number(c: Column) -> Column:
    """The number in a text with thousands commas; null if there is none."""
    plain = F.regexp_replace(text(c), ",", "")
    return finite(F.when(plain.rlike(NUMBER), plain.try_cast("double")))


def strict_number(c: Column) -> Column:
    """As lenient_number, and a trailing percent sign is dropped."""
    plain = F.regexp_replace(F.regexp_replace(text(c), ",", ""), "%$", "")
    return finite(F.when(plain.rlike(NUMBER), plain.try_cast("double")))


def strict_number_of(df: DataFrame, column: str) -> Column:
    """strict_number of a column; one that holds numbers needn't be read as text. Floats are: their text is another double."""
    if isinstance(df.schema[column].dataType, (T.IntegralType, T.DoubleType, T.DecimalType)):
        return finite(F.col(column).cast("double"))
    return strict_number(F.col(column))


def is_invalid_number(c: Column) -> Column:
    """Present, but not a number: an error where a strict operator needs one."""
    return ~is_missing(c) & strict_number(c).isNull()


def lenient_date(c: Column) -> Column:
    """YYYYMMDD with an optional .0, or a Y-M-D or Y/M/D prefix; null unless the calendar has that day."""
    raw = text(c)
    compact = F.regexp_replace(raw, r"\.0$", "")
    parts = F.regexp_extract(raw, r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", 1)
    return F.when(compact.rlike("^[0-9]{8}$"), F.try_to_date(compact, "yyyyMMdd")).when(parts != "", F.try_to_date(F.replace(parts, F.lit("/"), F.lit("-")), "yyyy-M-d"))


def iso_date(c: Column) -> Column:
    """Strictly YYYY-MM-DD."""
    raw = text(c)
    return F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))


def temporal(c: Column, end_of_day: bool = False) -> Column:
    """A timestamp; a bare date is its midnight, or its last microsecond as the end of a window."""
    raw = F.regexp_replace(text(c), "Z$", "+00:00")
    at = F.try_to_timestamp(raw).cast("timestamp_ntz")
    if end_of_day:
        last = F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")
        at = F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), at + last).otherwise(at)
    return at


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(text(c)).isin(*TRUTHY), F.lit(False))


def group_key(c: Column) -> Column:
    """The trimmed text, or MISSING_KEY for a missing one."""
    return F.coalesce(F.nullif(text(c), F.lit("")), F.lit(MISSING_KEY))


def scaled_round(c: Column, digits: int) -> Column:
    """A double rounded as C does, from the scaled double; F.round goes by its shortest decimal text, which differs where that ends in a 5."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def exact_sum(c: Column) -> Column:
    """Aggregate: the sum of doubles that are decimals of at most ten places, the same in any order; else their plain sum."""
    cell = c.try_cast("decimal(28,10)")
    held = F.count_if(c.isNotNull() & ~F.coalesce(cell.cast("double") == c, F.lit(False))) == 0
    return F.coalesce(F.when(held, F.try_sum(cell).cast("double")), F.sum(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is zero."""
    return F.try_divide(a, b)


def pct_change(before: Column, after: Column) -> Column:
    return F.try_divide(after - before, before)
