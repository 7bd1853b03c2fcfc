"""Traversal of relations: one plan for all parents of a level, however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.errors import RequestError
from braidlake.operators import aggregates
from braidlake.plans.connection import Page
from braidlake.plans.ordering import Term, beyond, with_order
from braidlake.plans.predicates import Scope, predicate
from braidlake.sources.catalog import Relation

#: Up to so many keys are put into the scan's filter; more are joined.
IN_FILTER = 1000
PARENT = "__parent"


def _linked(scope: Scope, relation: Relation, keys: DataFrame | list) -> tuple[Scope, DataFrame]:
    """(scope of the other side, its valid rows with the parent's key as PARENT). keys: a column of keys, or their values."""
    other = scope.to(relation.table)
    frame = other.frame()
    if relation.junction is None:
        return other, _restricted(frame, other.path(relation.there), keys).withColumn(PARENT, other.col(relation.there))
    table, own, far = relation.junction
    j = scope.to(table)
    pairs = _restricted(j.frame(), j.path(own), keys).select(j.col(own).alias(PARENT), j.col(far).alias("__far")).distinct()
    return other, frame.join(pairs, other.col(relation.there) == F.col("__far")).drop("__far")


def _restricted(df: DataFrame, path: str, keys: DataFrame | list) -> DataFrame:
    column = F.col(path)
    if isinstance(keys, list):
        if keys and len(keys) <= IN_FILTER and all(type(k) is int for k in keys):
            return df.where(f"{path} IN ({', '.join(map(str, keys))})")  # one text takes less time to build than a literal for each
        if len(keys) <= IN_FILTER:
            return df.where(column.isin(*keys) if keys else F.lit(False))
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], ["__key"])
    name = keys.columns[0]
    return df.join(keys.select(F.col(name).alias("__key")), column == F.col("__key"), "left_semi")


def forward(scope: Scope, relation: Relation, keys: DataFrame | list, select: list[str]) -> DataFrame:
    """Parents of the keys, a row each: the key as PARENT and the columns. A key that no valid row has is missing."""
    other, rows = _linked(scope, relation, keys)
    return rows.select(PARENT, *(other.col(c).alias(c) for c in select))


def with_parent(rows: DataFrame, scope: Scope, relation: Relation, select: dict[str, str]) -> DataFrame:
    """rows with columns of the parent, null where there is none; select: column of the parent to its new name."""
    other = scope.to(relation.table)
    side = other.frame().select(other.col(relation.there).alias("__there"), *(other.col(c).alias(n) for c, n in select.items()))
    return rows.join(side, scope.col(relation.here) == F.col("__there"), "left").drop("__there")


def children(scope: Scope, relation: Relation, keys: DataFrame | list, where: dict | None = None, order: list[str] | None = None, nulls: str | None = None,
             distinct: list[str] | None = None, page: Page | None = None, select: list[str] | None = None, limit: int | None = 100, more: int = 0, cursors: dict | None = None) -> tuple[DataFrame, list, Scope]:
    """(rows with PARENT and __rank, terms, scope): the page of each parent, ranked in page order from 1.

    A page from the end is ranked from its end. Rows beyond a page by up to `more` are kept for the flags.
    """
    page = page or Page()
    other, rows = _linked(scope, relation, keys)
    condition = predicate(other, where)
    rows = rows if condition is None else rows.where(condition)
    rows, terms = with_order(other, rows, order, nulls)
    if distinct:
        by_item = {c.upper(): c for c in other.entity.columns}
        if bad := [d for d in distinct if d not in by_item]:
            raise RequestError(f"{other.entity.type_name} has no distinct item {bad[0]!r}")
        columns = [by_item[d] for d in distinct]
        w = Window.partitionBy(PARENT, *columns).orderBy(*(t.sort() for t in terms))
        rows = rows.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
        terms = [Term(c) for c in columns] + [t for t in terms if t.column not in columns]
    if page.backward:
        terms = [t.flipped() for t in terms]
    for values in ([cursors] if cursors else []):
        rows = rows.where(beyond(terms if page.after is not None or page.backward else [t.flipped() for t in terms], [values[t.column] for t in terms], [rows.schema[t.column].dataType for t in terms]))
    size = page.size(limit)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(PARENT).orderBy(*(t.sort() for t in terms))))
    if page.offset:
        rows = rows.where(F.col("__rank") > page.offset)
    if size is not None:
        rows = rows.where(F.col("__rank") <= page.offset + size + more)
    wanted = dict.fromkeys([*(select if select is not None else other.entity.columns), *other.entity.declared.key, *(t.column for t in terms)])
    cols = [F.col(c) if c.startswith("__order") else other.col(c).alias(c) for c in wanted]
    return rows.select(PARENT, (F.col("__rank") - page.offset).alias("__rank"), *cols), terms, other


def counts(scope: Scope, relation: Relation, keys: DataFrame | list, where: dict | None = None) -> DataFrame:
    """(PARENT, total_count) of parents that have a row that meets the filter."""
    other, rows = _linked(scope, relation, keys)
    condition = predicate(other, where)
    rows = rows if condition is None else rows.where(condition)
    return rows.groupBy(PARENT).agg(F.count(F.lit(1)).alias("total_count"))


def child_aggregates(scope: Scope, relation: Relation, keys: DataFrame | list, wanted: dict[str, list[str]], where: dict | None = None, groups: list[str] | None = None) -> tuple[DataFrame, Scope]:
    """Aggregates of each parent's rows, or of its groups."""
    other, rows = _linked(scope, relation, keys)
    condition = predicate(other, where)
    rows = rows if condition is None else rows.where(condition)
    made = [aggregates.group_key(other, g) for g in groups or []]
    out = rows.groupBy(PARENT, *(c.alias(n) for n, c in made)).agg(*(aggregates.columns(other, wanted) or [F.count(F.lit(1)).alias("count")]))
    return out, other
