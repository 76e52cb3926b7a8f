"""Catalogue of operators: name, category, parameters and the function from tables to a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Op:
    name: str
    category: str
    run: Callable
    description: str
    params: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    sql: str | None = None


OPS: dict[str, Op] = {}


def op(name: str, category: str, sql: str | None = None) -> Callable:
    """Registers a query ``f(spark, folder, **params)`` with its description and reflected parameters."""
    def add(f: Callable) -> Callable:
        found = list(inspect.signature(f).parameters.values())[2:]
        OPS[name] = Op(name, category, f, (inspect.getdoc(f) or "").split("\n")[0], {p.name: str(p.annotation) for p in found}, tuple(p.name for p in found if p.default is p.empty), sql)
        return f
    return add


def run(spark: SparkSession, name: str, folder: str, **params) -> DataFrame:
    """Dispatches a call by name; unknown names and missing parameters are errors."""
    if name not in OPS:
        raise KeyError(f"no operator {name}")
    missing = [p for p in OPS[name].required if p not in params]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return OPS[name].run(spark, folder, **params)


def describe(spark: SparkSession) -> DataFrame:
    """One row for each operator: name, category, description, params."""
    rows = [(o.name, o.category, o.description, sorted(o.params)) for o in OPS.values()]
    return spark.createDataFrame(rows, "name string, category string, description string, params array<string>")
