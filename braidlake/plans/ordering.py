"""Order items as sort keys, and the keyset conditions that cursors need."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.errors import RequestError
from braidlake.functions import naming
from braidlake.functions.types import literal
from braidlake.plans.predicates import Scope

_AGGREGATES = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max}


@dataclass(frozen=True)
class Term:
    """A sort key: a column of the frame, its direction and where nulls stand."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def flipped(self) -> Term:
        return replace(self, descending=not self.descending, nulls_first=not self.nulls_first)

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def items(scope: Scope) -> dict[str, tuple]:
    """Every order item of the entity, without its direction: what it stands for."""
    e = scope.entity
    out: dict[str, tuple] = {naming.enum_item(c): ("column", c) for c in e.columns if not isinstance(e.kind(c), (T.MapType, T.VariantType))}
    for r in e.relations.values():
        other = scope.catalog.entity(r.table)
        if r.kind == "forward":
            for c in other.columns:
                out[f"{naming.singular(r.table)}_by_{r.here}__{c}".upper()] = ("parent", r, c)
        elif r.kind == "backward":
            prefix = f"{r.table}_by_{r.there}".upper()
            out[f"{prefix}_COUNT"] = ("count", r)
            for name in _AGGREGATES:
                for c in other.numeric:
                    out[f"{prefix}_{name}_{c}".upper()] = ("child", r, name, c)
    return out


def with_order(scope: Scope, df: DataFrame, order: list[str] | None, nulls: str | None) -> tuple[DataFrame, list[Term]]:
    """df with the columns that the order needs, and the terms: those asked for and then the columns that tell rows apart.

    Parents are joined by a column that is unique there, children by one row for each key, so no row doubles.
    Without `nulls` they stand last in ascending and first in descending terms.
    """
    known, terms, n = items(scope), [], 0
    if nulls not in (None, "NULLS_FIRST", "NULLS_LAST"):
        raise RequestError(f"unknown null order {nulls!r}")
    for item in order or []:
        if item in ("NATURAL", "PRIMARY_KEY_ASC"):
            continue
        if item == "PRIMARY_KEY_DESC":
            terms += [Term(c, True, nulls != "NULLS_LAST") for c in scope.entity.declared.key]
            continue
        m = re.fullmatch(r"(.*)_(ASC|DESC)", item)
        if not m or m[1] not in known:
            raise RequestError(f"{scope.entity.type_name} has no order {item!r}")
        what, down = known[m[1]], m[2] == "DESC"
        if what[0] == "column":
            name = what[1]
        else:
            name = f"__order{n}"
            n += 1
            df = _joined(scope, df, what, name)
        terms.append(Term(name, down, down if nulls is None else nulls == "NULLS_FIRST"))
    have = {t.column for t in terms}
    terms += [Term(c) for c in scope.entity.tiebreak if c not in have]
    return df, terms


def _joined(scope: Scope, df: DataFrame, what: tuple, name: str) -> DataFrame:
    r = what[1]
    other = scope.to(r.table)
    key = f"{name}_key"
    if what[0] == "parent":
        side = other.frame().select(other.col(r.there).alias(key), other.col(what[2]).alias(name))
    else:
        value = F.count(F.lit(1)) if what[0] == "count" else _AGGREGATES[what[2]](other.col(what[3]))
        side = other.frame().groupBy(other.col(r.there).alias(key)).agg(value.alias(name))
    df = df.join(side, scope.col(r.here) == F.col(key), "left").drop(key)
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(0))) if what[0] == "count" else df


def beyond(terms: list[Term], values: list, kinds: list[T.DataType]) -> Column:
    """Rows that stand after the given key, for any mix of directions and null places."""
    parts = []
    for i, (term, value) in enumerate(zip(terms, values, strict=True)):
        c = F.col(term.column)
        if value is None:
            after = c.isNotNull() if term.nulls_first else F.lit(False)
        else:
            v = literal(value, kinds[i])
            after = c < v if term.descending else c > v
            after = after if term.nulls_first else after | c.isNull()
        same = [F.col(t.column).isNull() if values[j] is None else F.col(t.column) == literal(values[j], kinds[j]) for j, t in enumerate(terms[:i])]
        parts.append(reduce(lambda a, b: a & b, [*same, after]))
    return reduce(lambda a, b: a | b, parts)
