"""The operator registry and the envelope that every operator's result comes in."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

STATUSES = ("invalid_spec", "unverifiable", "inconclusive", "completed")


@dataclass(frozen=True)
class Operator:
    """What an operator is for, when it may be used, and what its results don't show."""

    id: str
    version: str
    run: Callable[..., Any]
    questions: tuple[str, ...] = ()
    eligibility: str = ""
    boundaries: tuple[str, ...] = ()


@dataclass
class Result:
    """A DataFrame, or none, with its status; a data problem is a status and a diagnostic, not an exception."""

    operator: str
    status: str
    data: DataFrame | None = None
    diagnostics: dict[str, Any] = field(default_factory=dict)
    boundaries: tuple[str, ...] = ()


OPERATORS: dict[str, Operator] = {}


def operator(id: str, version: str = "1.0.0", **about: Any) -> Callable:
    def register(f: Callable) -> Callable:
        if not re.fullmatch(r"[a-z][a-z0-9-]*", id) or not re.fullmatch(r"\d+\.\d+\.\d+", version):
            raise ValueError(f"bad operator id or version: {id}@{version}")
        if id in OPERATORS:
            raise ValueError(f"operator {id} is registered twice")
        OPERATORS[id] = Operator(id, version, f, **about)
        return f

    return register


def parse_reference(text: str) -> tuple[str, str]:
    """id@version."""
    id, _, version = text.partition("@")
    if not id or not version:
        raise ValueError(f"not an operator reference: {text!r}")
    return id, version


def execute(reference: str, *args: Any, **options: Any) -> Result:
    """Run a registered operator of exactly this version; its ValueErrors become a status."""
    id, version = parse_reference(reference)
    found = OPERATORS.get(id)
    if found is None or found.version != version:
        return Result(id, "invalid_spec", diagnostics={"error": f"no operator {reference}"})
    try:
        data = found.run(*args, **options)
    except ValueError as error:
        return Result(id, "unverifiable", diagnostics={"error": str(error)}, boundaries=found.boundaries)
    return Result(id, "completed", data, {"version": version}, found.boundaries)


def self_check() -> list[str]:
    """Problems of the registry: operators that say nothing of their questions or boundaries."""
    return [f"{o.id}: {what} missing" for o in OPERATORS.values() for what, given in (("questions", o.questions), ("boundaries", o.boundaries)) if not given]


def _register_all() -> None:
    from ..operators import operational, table

    operator("table-profile", questions=("what is in each column",), eligibility="a header and a row", boundaries=("inferred types are candidates",))(table.profile)
    operator("grouped-descriptive", questions=("how do groups differ",), eligibility="a group and a metric", boundaries=("differences are descriptive",))(table.grouped)
    operator("robust-anomaly", questions=("which rows are unusual",), eligibility="five values", boundaries=("unusual is not wrong",))(table.robust_anomalies)
    operator("change-point", questions=("where does the level shift",), eligibility="two segments", boundaries=("a shift is not its cause",))(table.change_point)
    operator("period-comparison", questions=("what changed between two periods",), eligibility="facts in both periods", boundaries=("effects are an exact split, not causes",))(operational.compare_periods)


_register_all()
