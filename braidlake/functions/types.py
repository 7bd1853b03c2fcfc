"""Spark types as API scalars: names, literals and wire forms."""

from __future__ import annotations

import datetime
import decimal
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.errors import RequestError

_COMPARE = ("isNull", "equalTo", "notEqualTo", "in", "notIn", "lessThan", "lessThanOrEqualTo", "greaterThan", "greaterThanOrEqualTo", "distinctFrom", "notDistinctFrom")
_EQUAL = ("isNull", "equalTo", "notEqualTo", "distinctFrom", "notDistinctFrom")
# Names of the API.
_TEXT = (
    "like", "notLike", "likeInsensitive", "notLikeInsensitive",
    "startsWith", "startsWithInsensitive", "notStartsWith", "notStartsWithInsensitive",
    "endsWith", "endsWithInsensitive", "notEndsWith", "notEndsWithInsensitive",
    "includes", "includesInsensitive", "notIncludes", "notIncludesInsensitive",
)
_INSENSITIVE = (
    "equalToInsensitive", "notEqualToInsensitive", "distinctFromInsensitive", "notDistinctFromInsensitive",
    "lessThanInsensitive", "lessThanOrEqualToInsensitive", "greaterThanInsensitive", "greaterThanOrEqualToInsensitive",
    "inInsensitive", "notInInsensitive",
)
OPERATORS = {
    "String": (*_COMPARE, *_TEXT, *_INSENSITIVE), "Boolean": _EQUAL, "JSON": _EQUAL, "Interval": _EQUAL, "Point": (*_COMPARE, *_TEXT, *_INSENSITIVE),
    "List": ("some", "none", "every", "isEmpty"), "Enum": ("isNull", "equalTo", "notEqualTo", "in", "notIn"),
    **{k: _COMPARE for k in ("Int", "BigInt", "Float", "BigFloat", "Date", "Datetime", "UUID", "Time", "BitString", "InternetAddress")},
}
#: Scalars that a column's metadata may name for a type that Spark has no own type for.
NAMED = ("UUID", "Time", "BitString", "InternetAddress", "JSON", "Interval", "Point", "Datetime", "Date")


def scalar_of(kind: T.DataType, named: str | None = None) -> tuple[str, bool]:
    """(API scalar, whether it counts as a number)."""
    if named in NAMED:
        return named, False
    if isinstance(kind, T.BooleanType):
        return "Boolean", False
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "Int", True
    if isinstance(kind, T.LongType):
        return "BigInt", True
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "Float", True
    if isinstance(kind, T.DecimalType):
        return "BigFloat", True
    if isinstance(kind, T.DateType):
        return "Date", False
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "Datetime", False
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
        return "String", False
    return "JSON", False


def literal(value, kind: T.DataType) -> Column:
    """A typed literal, so that no cast stands between the column and the scan. Values that don't fit are the request's error."""
    try:
        if isinstance(kind, T.BooleanType):
            if not isinstance(value, bool):
                raise ValueError
            return F.lit(value)
        if isinstance(kind, T.IntegralType):
            number = decimal.Decimal(str(value))
            if isinstance(value, bool) or number != number.to_integral_value():
                raise ValueError
            bits = {"byte": 8, "short": 16, "integer": 32, "long": 64}[kind.typeName()]
            if not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
                raise ValueError
            return F.lit(int(number)).cast(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.lit(float(value)).cast(kind)
        if isinstance(kind, T.DecimalType):
            number = decimal.Decimal(str(value))
            if not number.is_finite():
                raise ValueError
            return F.lit(format(number, "f")).cast(f"decimal({min(38, max(len(number.as_tuple().digits), kind.precision))},{max(0, -number.as_tuple().exponent, kind.scale) if max(0, -number.as_tuple().exponent, kind.scale) <= 37 else 37})")
        if isinstance(kind, T.DateType):
            return F.lit(datetime.date.fromisoformat(str(value)[:10]).isoformat()).cast(kind)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(datetime.datetime.fromisoformat(str(value).replace("Z", "+00:00")).isoformat()).cast(kind)
        if isinstance(kind, T.BinaryType):
            return F.lit(bytes.fromhex(value))
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            return F.lit(value if isinstance(value, str) else json.dumps(value, separators=(",", ":")))
    except (ValueError, TypeError, ArithmeticError) as e:
        raise RequestError(f"{value!r} is not a value of type {kind.simpleString()}") from e
    return F.lit(json.dumps(value, separators=(",", ":")))


def wire(value, kind: T.DataType, named: str | None = None):
    """A value as JSON carries it: 64-bit and decimal numbers as strings, sub-second parts dropped."""
    if value is None:
        return None
    if isinstance(kind, (T.LongType, T.DecimalType)):
        return format(value, "f") if isinstance(value, decimal.Decimal) else str(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value if math.isfinite(value) else None
    if isinstance(kind, T.TimestampNTZType):
        return value.strftime("%Y-%m-%dT%H:%M:%S")
    if isinstance(kind, T.TimestampType):
        value = value if value.tzinfo else value.replace(tzinfo=datetime.UTC)
        return value.isoformat()
    if isinstance(kind, T.DateType):
        return value.isoformat()
    if isinstance(kind, T.BinaryType):
        return bytes(value).hex()
    if isinstance(kind, T.ArrayType):
        return [wire(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {str(k): wire(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType):
        return {f.name: wire(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.VariantType):
        return value.toPython()
    if named == "JSON" and isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value
