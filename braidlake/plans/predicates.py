"""Filter objects as Columns."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.errors import RequestError
from braidlake.functions.types import OPERATORS, literal, scalar_of
from braidlake.sources.catalog import Catalog, Entity, Relation, as_of

_alias = itertools.count()


@dataclass(frozen=True)
class Scope:
    """An entity under an alias, at a point of its history."""

    catalog: Catalog
    entity: Entity
    alias: str
    point: int | None = None
    historical: bool = True

    @classmethod
    def of(cls, catalog: Catalog, name: str, point: int | None = None, historical: bool = True) -> Scope:
        return cls(catalog, catalog.entity(name), f"t{next(_alias)}", point, historical)

    def to(self, name: str) -> Scope:
        return Scope.of(self.catalog, name, self.point, self.historical)

    def path(self, column: str) -> str:
        return f"{self.alias}.`{column}`"

    def col(self, column: str) -> Column:
        return F.col(self.path(column))

    def valid(self) -> Column | None:
        return as_of(self.entity, self.alias, self.point) if self.historical else None

    def frame(self, condition: Column | None = None) -> DataFrame:
        """The rows at the point that meet the condition."""
        df = self.catalog.frame(self.entity.name, self.alias)
        for c in (self.valid(), condition):
            df = df if c is None else df.where(c)
        return df


def _text(f: Callable[[Column, Column], Column], insensitive: bool = False, negated: bool = False) -> Callable:
    def make(c: Column, v: Column) -> Column:
        out = f(F.lower(c), F.lower(v)) if insensitive else f(c, v)
        return ~out if negated else out

    return make


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "equalTo": lambda c, v: c == v,
    "notEqualTo": lambda c, v: c != v,
    "lessThan": lambda c, v: c < v,
    "lessThanOrEqualTo": lambda c, v: c <= v,
    "greaterThan": lambda c, v: c > v,
    "greaterThanOrEqualTo": lambda c, v: c >= v,
    "distinctFrom": lambda c, v: ~c.eqNullSafe(v),
    "notDistinctFrom": lambda c, v: c.eqNullSafe(v),
}
_INSENSITIVE = {f"{k}Insensitive": (lambda f: lambda c, v: f(F.lower(c), F.lower(v)))(f) for k, f in _BINARY.items()}
for _name, _f in (("startsWith", lambda c, v: c.startswith(v)), ("endsWith", lambda c, v: c.endswith(v)), ("includes", lambda c, v: c.contains(v))):
    for _ci in (False, True):
        _BINARY[_name + "Insensitive" * _ci] = _text(_f, _ci)
        _BINARY["not" + _name[0].upper() + _name[1:] + "Insensitive" * _ci] = _text(_f, _ci, True)
_BINARY |= _INSENSITIVE


def all_of(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def _values(value) -> list:
    return value if isinstance(value, list) else [value]


def scalar_predicate(c: Column, kind: T.DataType, scalar: str, operators: dict, enum: tuple[str, ...] = ()) -> Column | None:
    """All operators of one field. Null operands are as if they weren't there, but for isNull, where null is true."""
    parts: list[Column] = []
    written = literal
    if scalar == "JSON":
        c, written = json_form(c if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else F.to_json(c)), json_literal
    elif scalar in ("Interval", "Point") and isinstance(kind, T.StructType):
        c, written = (interval_form(c, kind), interval_literal) if scalar == "Interval" else (point_form(c), point_literal)
    for name, value in operators.items():
        if name not in OPERATORS[scalar]:
            raise RequestError(f"{scalar} has no operator {name!r}")
        if name == "isNull":
            parts.append(c.isNull() if value in (True, None) else c.isNotNull())
        elif value is None:
            continue
        elif name in ("some", "none", "every", "isEmpty"):
            parts += _list_predicate(c, kind, name, value)
        elif name in ("in", "notIn", "inInsensitive", "notInInsensitive"):
            values = [v for v in _values(value) if v is not None]
            _check_enum(values, enum)
            negated, lower = name.startswith("not"), name.endswith("Insensitive")
            if values:
                found = [F.lower(written(v, kind)) if lower else written(v, kind) for v in values]
                inside = (F.lower(c) if lower else c).isin(*found)
                parts.append(~inside if negated else inside)
            elif not negated:
                parts.append(F.lit(False))
        elif name in ("like", "notLike", "likeInsensitive", "notLikeInsensitive"):
            if not isinstance(value, str):
                raise RequestError(f"{name} takes a string")
            found = c.ilike(value) if name.endswith("Insensitive") else c.like(value)
            parts.append(~found if name.startswith("not") else found)
        else:
            _check_enum([value], enum)
            parts.append(_BINARY[name](c, written(value, kind)))
    return all_of(parts)


def json_form(text: Column) -> Column:
    """JSON with its fields in order and without white space, numbers without trailing zeros; what is no JSON stays as it is."""
    plain = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|(?<=[0-9])(\.[0-9]*[1-9])0+(?![0-9eE])|(?<=[0-9])\.0+(?![0-9eE])', "$1$2")
    return F.coalesce(F.to_json(F.try_parse_json(plain)), text)


def json_literal(value, kind: T.DataType) -> Column:
    """A value, or a string that holds the JSON of an object or a list, as json_form."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        return json_form(F.lit(value))
    return json_form(F.lit(json.dumps(value)))


_UNITS = ("years", "months", "days", "hours", "minutes", "seconds")


def interval_form(c: Column, kind: T.StructType) -> Column:
    """An interval's parts; those that it doesn't have are 0."""
    return F.when(c.isNotNull(), F.struct(*((F.coalesce(c[u].cast("double"), F.lit(0.0)) if u in kind.names else F.lit(0.0)).alias(u) for u in _UNITS)))


def interval_literal(value, kind: T.DataType) -> Column:
    if not isinstance(value, dict) or set(value) - set(_UNITS) or not all(v is None or isinstance(v, (int, float)) and not isinstance(v, bool) for v in value.values()):
        raise RequestError(f"{value!r} is no interval of {', '.join(_UNITS)}")
    return F.struct(*(F.lit(float(value.get(u) or 0)).alias(u) for u in _UNITS))


def point_form(c: Column) -> Column:
    """A point as (x,y), whole numbers without a fraction."""
    number = lambda x: F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")
    return F.concat(F.lit("("), number(c["x"]), F.lit(","), number(c["y"]), F.lit(")"))


def point_literal(value, kind: T.DataType) -> Column:
    """A point as its text, or as {x, y}."""
    if isinstance(value, str):
        return F.lit(value.replace(" ", ""))
    if not isinstance(value, dict) or set(value) != {"x", "y"} or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value.values()):
        raise RequestError(f"{value!r} is no point")
    return point_form(F.struct(F.lit(float(value["x"])).alias("x"), F.lit(float(value["y"])).alias("y")))


def _check_enum(values: list, enum: tuple[str, ...]) -> None:
    if enum and (bad := [v for v in values if v not in enum]):
        raise RequestError(f"{bad[0]!r} is none of {', '.join(enum)}")


def _list_predicate(c: Column, kind: T.ArrayType, name: str, value) -> list[Column]:
    if name == "isEmpty":
        return [F.size(c) == 0 if value else F.size(c) > 0]
    element = kind.elementType
    test = lambda e: scalar_predicate(e, element, scalar_of(element)[0], value)
    if test(F.lit(None).cast(element)) is None:
        return []
    # An element that the condition is null for doesn't meet it, and violates it as little.
    if name == "every":
        return [~F.exists(c, lambda e: F.coalesce(~test(e), F.lit(False)))]
    found = F.exists(c, lambda e: F.coalesce(test(e), F.lit(False)))
    return [~found if name == "none" else found]


def related(scope: Scope, relation: Relation, condition: Callable[[Scope], Column | None]) -> DataFrame:
    """Rows of the relation's other side that belong to the row of `scope` outside, and meet the condition."""
    other = scope.to(relation.table)
    link = (other.col(relation.there) == scope.col(relation.here).outer()) if relation.junction is None else None
    if link is not None:
        return other.frame(all_of([x for x in (link, condition(other)) if x is not None]))
    table, own, far = relation.junction
    j = scope.to(table)
    inner = other.frame(all_of([x for x in (other.col(relation.there) == j.col(far).outer(), condition(other)) if x is not None]))
    return j.frame((j.col(own) == scope.col(relation.here).outer()) & inner.exists())


def predicate(scope: Scope, where: dict | None) -> Column | None:
    """A filter object on the scope's entity; None where it sets no condition."""
    parts: list[Column] = []
    entity = scope.entity
    for name, value in (where or {}).items():
        if name in ("and", "or"):
            members = [p for p in (predicate(scope, m) for m in _values(value or [])) if p is not None]
            if members:
                parts.append(reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), members))
        elif name == "not":
            if (inner := predicate(scope, value)) is not None:
                parts.append(~inner)
        elif name in entity.fields:
            column = entity.fields[name]
            if value is not None and (p := scalar_predicate(scope.col(column), entity.kind(column), entity.scalar(column), value, entity.declared.enums.get(column, ()))) is not None:
                parts.append(p)
        elif name in entity.relations:
            parts += _relation_predicate(scope, entity.relations[name], value)
        elif name.endswith("Exists") and (r := entity.relations.get(name[: -len("Exists")])):
            if value is not None:
                there = scope.col(r.here).isNotNull() if r.kind == "forward" else related(scope, r, lambda o: None).exists()
                parts.append(there if value else (scope.col(r.here).isNull() if r.kind == "forward" else ~there))
        else:
            raise RequestError(f"{entity.type_name} has no filter {name!r}")
    return all_of(parts)


def has_relation(scope: Scope, where: dict | None) -> bool:
    """Whether a filter object looks at other rows than the entity's own."""
    inner = [m for name, value in (where or {}).items() if name in ("and", "or", "not") for m in _values(value or [])]
    own = {*scope.entity.fields, "and", "or", "not"}
    return any(name not in own for name in where or {}) or any(has_relation(scope, m) for m in inner)


def _constant(where: dict | None) -> bool | None:
    """False for a filter that an empty `in` can never let pass."""
    for name, value in (where or {}).items():
        if name == "and" and any(_constant(m) is False for m in _values(value or [])):
            return False
        if isinstance(value, dict) and name not in ("and", "or", "not") and any(value.get(k) == [] for k in ("in", "inInsensitive")):
            return False
    return None


def _relation_predicate(scope: Scope, relation: Relation, value: dict | None) -> list[Column]:
    if value is None:
        return []
    inside = lambda where: lambda other: predicate(other, where)
    if relation.kind in ("forward", "single"):
        if predicate(scope.to(relation.table), value) is None:
            return []
        return [related(scope, relation, inside(value)).exists()]
    parts = []
    for quantifier, where in value.items():
        if where is None:
            continue
        if quantifier not in ("some", "none", "every"):
            raise RequestError(f"{relation.name} takes some, none or every, not {quantifier!r}")
        if _constant(where) is False:
            # No row can meet it: some is false; none and every set no condition.
            parts += [F.lit(False)] if quantifier == "some" else []
        elif quantifier == "some":
            parts.append(related(scope, relation, inside(where)).exists())
        elif quantifier == "none":
            parts.append(~related(scope, relation, inside(where)).exists())
        elif predicate(scope.to(relation.table), where) is not None:
            parts.append(~related(scope, relation, lambda other: ~predicate(other, where)).exists())  # noqa: B023
    return parts
