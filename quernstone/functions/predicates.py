"""The eleven predicate operators over one observed value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import strict_number, temporal, text

OPERATORS = ("gt", "gte", "lt", "lte", "eq", "neq", "between", "outside", "abs_lte", "abs_gte", "approx_eq")


class SpecError(ValueError):
    """A declared spec can't be executed."""


def _is_number(value: Any) -> bool:
    if isinstance(value, bool) or value is None:
        return False
    try:
        float(str(value).replace(",", "").rstrip("%"))
    except ValueError:
        return False
    return True


def _num(value: Any) -> Column:
    if not _is_number(value):
        raise SpecError(f"not a number: {value!r}")
    return F.lit(float(str(value).replace(",", "").rstrip("%")))


def predicate(observed: Column, spec: dict[str, Any], number: Column | None = None) -> Column:
    """Whether observed satisfies spec {operator, value, tolerance}; null where it is no valid operand.

    between is inclusive, and numeric if its bounds are, else temporal with the
    upper bound at the day's end. eq compares numbers, else times, else trimmed text.
    number is observed's strict_number, where the caller has it.
    """
    operator, value = spec.get("operator"), spec.get("value")
    if operator not in OPERATORS:
        raise SpecError(f"unsupported predicate operator: {operator!r}")
    number = strict_number(observed) if number is None else number
    if operator in ("between", "outside"):
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise SpecError(f"{operator} requires two values")
        if all(map(_is_number, value)):
            inside = number.between(_num(value[0]), _num(value[1]))
        else:
            at = temporal(observed)
            inside = (at >= temporal(F.lit(value[0]))) & (at <= temporal(F.lit(value[1]), end_of_day=True))
        return inside if operator == "between" else ~inside
    if operator in ("eq", "neq"):
        same = text(observed) == text(F.lit(str(value)))
        equal = F.coalesce(temporal(observed) == temporal(F.lit(str(value))), same)
        if _is_number(value):
            equal = F.coalesce(number == _num(value), same)
        equal = F.coalesce(equal, F.lit(False))
        return equal if operator == "eq" else ~equal
    target = _num(value)
    if operator == "approx_eq":
        return F.abs(number - target) <= _num(spec.get("tolerance"))
    return {
        "gt": number > target, "gte": number >= target, "lt": number < target, "lte": number <= target,
        "abs_lte": F.abs(number) <= F.abs(target), "abs_gte": F.abs(number) >= F.abs(target),
    }[operator]
