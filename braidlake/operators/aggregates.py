"""Aggregates and groups over a filtered relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.errors import RequestError
from braidlake.plans.predicates import Scope

#: Sums and means of doubles are added up as they come, those of whole numbers and decimals exactly.
_NUMERIC = {
    "sum": lambda c, k: F.sum(c),
    "average": lambda c, k: F.avg(c),
    "stddevSample": lambda c, k: F.stddev_samp(c.cast("double")),
    "stddevPopulation": lambda c, k: F.stddev_pop(c.cast("double")),
    "varianceSample": lambda c, k: F.var_samp(c.cast("double")),
    "variancePopulation": lambda c, k: F.var_pop(c.cast("double")),
    "min": lambda c, k: F.min(c),
    "max": lambda c, k: F.max(c),
}
FUNCTIONS = ("distinctCount", *_NUMERIC)


def columns(scope: Scope, wanted: dict[str, list[str]]) -> list[Column]:
    """Aggregate columns, named function_column: only those asked for. Sums of whole numbers don't overflow."""
    out = []
    for name, fields in wanted.items():
        if name == "count":
            out.append(F.count(F.lit(1)).alias("count"))
            continue
        if name not in FUNCTIONS:
            raise RequestError(f"no aggregate {name!r}")
        for f in fields:
            column = scope.entity.column(f)
            c, kind = scope.col(column), scope.entity.kind(column)
            if name == "distinctCount":
                c = F.to_json(c) if isinstance(kind, (T.MapType, T.VariantType)) else c
                out.append(F.count_distinct(c).alias(f"{name}_{column}"))
                continue
            if column not in scope.entity.numeric:
                raise RequestError(f"{name} needs a number; {f} is none")
            if name in ("sum", "average") and isinstance(kind, T.LongType):
                c = c.cast("decimal(20,0)")
            out.append(_NUMERIC[name](c, kind).alias(f"{name}_{column}"))
    return out


def aggregate(scope: Scope, rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """One row. rows: the filtered relation, without order, page or distinct."""
    return rows.agg(*columns(scope, wanted))


def group_key(scope: Scope, item: str) -> tuple[str, Column]:
    """(column name, key) of a group item: a column, or a time column cut to HOUR or DAY."""
    e = scope.entity
    by_item = {c.upper(): c for c in e.columns}
    if item in by_item:
        return by_item[item], scope.col(by_item[item])
    for unit in ("HOUR", "DAY"):
        suffix = f"_TRUNCATED_TO_{unit}"
        if item.endswith(suffix) and (c := by_item.get(item[: -len(suffix)])):
            if not isinstance(e.kind(c), (T.TimestampType, T.TimestampNTZType)):
                raise RequestError(f"{c} is no time")
            return f"{c}_{unit.lower()}", F.date_trunc(unit, scope.col(c)).cast(e.kind(c))
    raise RequestError(f"{e.type_name} can't be grouped by {item!r}")


def grouped(scope: Scope, rows: DataFrame, keys: list[str], wanted: dict[str, list[str]]) -> DataFrame:
    """A row for each group, in order of the keys, nulls last; without keys one row for all."""
    made = [group_key(scope, k) for k in keys]
    aggs = columns(scope, wanted) or [F.count(F.lit(1)).alias("count")]
    if not made:
        return rows.agg(*aggs)
    out = rows.groupBy(*(c.alias(n) for n, c in made)).agg(*aggs)
    return out.orderBy(*(F.col(n).asc_nulls_last() for n, _ in made))
