"""The generated API as SDL text and as introspection data."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from braidlake.functions import naming
from braidlake.functions.types import OPERATORS, scalar_of
from braidlake.operators.aggregates import FUNCTIONS
from braidlake.operators.metadata import FIELDS
from braidlake.plans.ordering import items
from braidlake.plans.predicates import Scope
from braidlake.sources.catalog import Catalog, Entity

SCALARS = ("Int", "Float", "String", "Boolean", "ID", "BigInt", "BigFloat", "Date", "Datetime", "Time", "UUID", "JSON", "Cursor", "BitString", "InternetAddress")
_INT, _BOOL = {"lastProcessedHeight", "targetHeight", "startHeight", "lastFinalizedVerifiedHeight", "lastCreatedPoiHeight", "latestSyncedPoiHeight"}, {"indexerHealthy"}


def search_field(table: str) -> str:
    return f"search_{table}"


def enum_name(e: Entity, column: str) -> str:
    return naming.enum_type(f"{naming.singular(e.name)}_{column}")


def _scalar(e: Entity, column: str) -> str:
    return enum_name(e, column) if column in e.declared.enums else "JSON" if isinstance(e.kind(column), T.ArrayType) else e.scalar(column)


def _filter(e: Entity, column: str) -> str:
    if column in e.declared.enums:
        return f"{enum_name(e, column)}Filter"
    if isinstance(e.kind(column), T.ArrayType):
        return f"{scalar_of(e.kind(column).elementType)[0]}ListFilter"
    return f"{e.scalar(column)}Filter"


def types(catalog: Catalog, options) -> list[dict]:
    """Every type: kind, name, and fields {name: (type text, {argument: type text})} or values."""
    out: dict[str, dict] = {s: {"kind": "SCALAR", "name": s} for s in SCALARS}

    def add(kind: str, name: str, fields: dict | None = None, values: list[str] | None = None) -> None:
        out.setdefault(name, {"kind": kind, "name": name, "fields": fields or {}, "values": values or []})

    point = {options.point_argument: "String"}
    obj = lambda fields: {k: (v, {}) for k, v in fields.items()}
    add("OBJECT", "PageInfo", obj({"hasNextPage": "Boolean!", "hasPreviousPage": "Boolean!", "startCursor": "Cursor", "endCursor": "Cursor"}))
    add("INTERFACE", "Node", obj({"nodeId": "ID!"}))
    add("ENUM", "NullOrder", values=["NULLS_FIRST", "NULLS_LAST"])
    add("ENUM", "MutationType", values=["INSERT", "UPDATE", "DELETE"])
    add("OBJECT", "Interval", obj({k: "Int" for k in ("years", "months", "days", "hours", "minutes", "seconds")}))
    add("OBJECT", "Point", obj({"x": "Float!", "y": "Float!"}))
    add("INPUT_OBJECT", "IntervalInput", obj({k: "Float" for k in ("years", "months", "days", "hours", "minutes", "seconds")}))
    add("OBJECT", "TableEstimate", obj({"table": "String", "estimate": "Int"}))
    add("OBJECT", "_Metadata", obj({f: "Int" if f in _INT else "Boolean" if f in _BOOL else "[TableEstimate]" if f == "rowCountEstimate" else "JSON" if f in ("dynamicDatasources", "deployments") else "String" for f in FIELDS}))
    add("OBJECT", "_MetadatasEdge", obj({"cursor": "Cursor", "node": "_Metadata"}))
    add("OBJECT", "_Metadatas", obj({"totalCount": "Int!", "nodes": "[_Metadata]!", "edges": "[_MetadatasEdge]!"}))
    for scalar, names in OPERATORS.items():
        if scalar in ("List", "Enum"):
            continue
        add("INPUT_OBJECT", f"{scalar}Filter", obj({n: "Boolean" if n == "isNull" else f"[{scalar}!]" if n.startswith(("in", "notIn")) and n in ("in", "notIn", "inInsensitive", "notInInsensitive") else {"Point": "String", "Interval": "IntervalInput"}.get(scalar, scalar) for n in names}))
        add("INPUT_OBJECT", f"{scalar}ListFilter", obj({"some": f"{scalar}Filter", "none": f"{scalar}Filter", "every": f"{scalar}Filter", "isEmpty": "Boolean"}))
    query: dict = {"query": ("Query!", {}), "nodeId": ("ID!", {}), "node": ("Node", {"nodeId": "ID!"}), "_metadata": ("_Metadata", {"chainId": "String"}), "_metadatas": ("_Metadatas", {"after": "Cursor", "before": "Cursor"})}
    stream: dict = {}
    for name, e in catalog.entities.items():
        many, one = naming.plural_type_name(name), e.type_name
        connection = lambda other: {
            "first": "Int", "last": "Int", "after": "Cursor", "before": "Cursor", "offset": "Int", "filter": f"{naming.type_name(other)}Filter",
            "orderBy": f"[{naming.plural_type_name(other)}OrderBy!]", "orderByNull": "NullOrder", "distinct": f"[{other}_distinct_enum]"}
        fields = {"nodeId": ("ID!", {})} | {f: (_scalar(e, c), {}) for f, c in e.fields.items()}
        where = {f: _filter(e, c) for f, c in e.fields.items()} | {"and": f"[{one}Filter!]", "or": f"[{one}Filter!]", "not": f"{one}Filter"}
        for r in e.relations.values():
            other = catalog.entity(r.table)
            if r.kind in ("forward", "single"):
                fields[r.name] = (other.type_name, {})
                where |= {r.name: f"{other.type_name}Filter", f"{r.name}Exists": "Boolean"}
            else:
                fields[r.name] = (f"{naming.plural_type_name(r.table)}Connection!", connection(r.table))
                quantified = f"{one}ToMany{other.type_name}Filter"
                add("INPUT_OBJECT", quantified, obj({q: f"{other.type_name}Filter" for q in ("some", "none", "every")}))
                where |= {r.name: quantified, f"{r.name}Exists": "Boolean"}
        add("OBJECT", one, fields)
        add("INPUT_OBJECT", f"{one}Filter", obj(where))
        add("OBJECT", f"{many}Edge", obj({"cursor": "Cursor", "node": one}))
        body = {"nodes": (f"[{one}]!", {}), "edges": (f"[{many}Edge!]!", {}), "pageInfo": ("PageInfo!", {}), "totalCount": ("Int!", {})}
        if options.aggregates:
            body |= {"aggregates": (f"{one}Aggregates", {}), "groupedAggregates": (f"[{one}AggregateGroup!]", {"groupBy": f"[{one}GroupBy!]!"})}
            parts = {"keys": "[String!]"}
            for fn in FUNCTIONS:
                columns = e.columns if fn == "distinctCount" else e.numeric
                if columns:
                    sub = f"{one}{fn[0].upper()}{fn[1:]}Aggregates"
                    kept = {c: "BigInt" if fn == "distinctCount" else e.scalar(c) if fn in ("min", "max") else "BigFloat" for c in columns}
                    add("OBJECT", sub, obj({naming.camel(c): k for c, k in kept.items()}))
                    parts[fn] = sub
            add("OBJECT", f"{one}Aggregates", obj({"count": "BigInt"} | parts))
            add("OBJECT", f"{one}AggregateGroup", obj({"count": "BigInt"} | parts))
            times = [c for c in e.columns if isinstance(e.kind(c), (T.TimestampType, T.TimestampNTZType))]
            add("ENUM", f"{one}GroupBy", values=[naming.enum_item(c) for c in e.columns] + [f"{c.upper()}_TRUNCATED_TO_{u}" for c in times for u in ("HOUR", "DAY")])
        add("OBJECT", f"{many}Connection", body)
        add("ENUM", f"{many}OrderBy", values=["NATURAL", "PRIMARY_KEY_ASC", "PRIMARY_KEY_DESC", *(f"{i}_{d}" for i in items(Scope.of(catalog, name)) for d in ("ASC", "DESC"))])
        add("ENUM", f"{name}_distinct_enum", values=[naming.enum_item(c) for c in e.columns])
        for c, values in e.declared.enums.items():
            add("ENUM", enum_name(e, c), values=[re.sub(r"\W", "_", v) for v in values])
            add("INPUT_OBJECT", f"{enum_name(e, c)}Filter", obj({n: "Boolean" if n == "isNull" else f"[{enum_name(e, c)}!]" if n in ("in", "notIn") else enum_name(e, c) for n in OPERATORS["Enum"]}))
        versions = point if e.declared.versions and options.historical else {}
        query[naming.connection_field(name)] = (f"{many}Connection!", connection(name) | versions)
        if e.declared.key:
            query[naming.single_field(name)] = (one, {naming.camel(k): f"{e.scalar(k)}!" for k in e.declared.key} | versions)
            query[f"{naming.single_field(name)}ByNodeId"] = (one, {"nodeId": "ID!"} | versions)
            add("OBJECT", f"{one}SubscriptionPayload", obj({"id": "ID!", "mutation_type": "MutationType!", "_entity": one}))
            stream[naming.connection_field(name)] = (f"{one}SubscriptionPayload", {"id": "[ID!]", "mutation": "[MutationType!]"})
        if e.declared.search or e.declared.finder:
            query[search_field(name)] = (f"{many}Connection!", {"search": "String!", "first": "Int", "offset": "Int", "after": "Cursor"})
    add("OBJECT", "Query", query)
    add("OBJECT", "Subscription", stream)
    return list(out.values())


def sdl(catalog: Catalog, options) -> str:
    lines = []
    for t in types(catalog, options):
        if t["kind"] == "SCALAR":
            if t["name"] not in ("Int", "Float", "String", "Boolean", "ID"):
                lines.append(f"scalar {t['name']}\n")
        elif t["kind"] == "ENUM":
            lines.append(f"enum {t['name']} {{\n" + "".join(f"  {v}\n" for v in t["values"]) + "}\n")
        elif t["fields"]:
            word = {"OBJECT": "type", "INPUT_OBJECT": "input", "INTERFACE": "interface"}[t["kind"]]
            args = lambda a: f"({', '.join(f'{k}: {v}' for k, v in a.items())})" if a else ""
            lines.append(f"{word} {t['name']} {{\n" + "".join(f"  {n}{args(a)}: {k}\n" for n, (k, a) in t["fields"].items()) + "}\n")
    return "\n".join(lines)


def introspection(catalog: Catalog, options) -> dict:
    all_types = types(catalog, options)
    kinds = {t["name"]: t["kind"] for t in all_types}

    def ref(text: str) -> dict:
        if text.endswith("!"):
            return {"kind": "NON_NULL", "name": None, "ofType": ref(text[:-1])}
        if text.startswith("["):
            return {"kind": "LIST", "name": None, "ofType": ref(text[1:-1])}
        return {"kind": kinds.get(text, "SCALAR"), "name": text, "ofType": None}

    def value(n: str, k: str) -> dict:
        return {"name": n, "description": None, "type": ref(k), "defaultValue": None}

    def whole(t: dict) -> dict:
        k = t["kind"]
        fields = [{"name": n, "description": None, "args": [value(*x) for x in a.items()], "type": ref(r), "isDeprecated": False, "deprecationReason": None} for n, (r, a) in t.get("fields", {}).items()]
        return {
            "kind": k, "name": t["name"], "description": None, "interfaces": [ref("Node")] if k == "OBJECT" and any(f["name"] == "nodeId" for f in fields) and t["name"] != "Query" else [] if k == "OBJECT" else None,
            "fields": fields if k in ("OBJECT", "INTERFACE") else None, "inputFields": [value(f["name"], t["fields"][f["name"]][0]) for f in fields] if k == "INPUT_OBJECT" else None,
            "enumValues": [{"name": v, "description": None, "isDeprecated": False, "deprecationReason": None} for v in t["values"]] if k == "ENUM" else None, "possibleTypes": None, "ofType": None}

    return {"queryType": {"name": "Query"}, "mutationType": None, "subscriptionType": {"name": "Subscription"}, "types": [whole(t) for t in all_types], "directives": [{"name": n, "description": None, "locations": ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"], "args": [value("if", "Boolean!")]} for n in ("skip", "include")]}
