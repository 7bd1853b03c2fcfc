"""GraphQL operations on a catalog: each level of a selection is one plan for all rows of the level above."""

from __future__ import annotations

import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.errors import RequestError
from braidlake.functions import codec, naming
from braidlake.functions.types import wire
from braidlake.gql import schema as sdl
from braidlake.gql.parser import Document, Enum, Field, Inline, Operation, Spread, Variable
from braidlake.operators import metadata, relations, search
from braidlake.operators.aggregates import group_key
from braidlake.plans.connection import Connection, Fetched, Page, cursor_value
from braidlake.plans.predicates import Scope, predicate
from braidlake.sources.catalog import Entity, Relation
from braidlake.streaming import changes

_PAGE = ("first", "last", "after", "before", "offset")


class Executor:
    def __init__(self, engine, catalog, doc: Document, op: Operation, variables: dict):
        self.engine, self.catalog, self.doc, self.op = engine, catalog, doc, op
        self.variables = {}
        for name, (kind, default, given) in op.variables.items():
            if name in variables:
                self.variables[name] = variables[name]
            elif given:
                self.variables[name] = self.plain(default)
            if kind.endswith("!") and self.variables.get(name) is None:
                raise RequestError(f"variable ${name} of type {kind} is missing")

    # Values and selections

    def plain(self, value):
        """A value without variables; object fields and list items that are absent variables are left out."""
        if isinstance(value, Variable):
            if value.name not in self.op.variables:
                raise RequestError(f"variable ${value.name} isn't declared")
            return self.variables.get(value.name)
        if isinstance(value, Enum):
            return value.name
        if isinstance(value, list):
            return [self.plain(v) for v in value]
        if isinstance(value, dict):
            return {k: self.plain(v) for k, v in value.items() if not (isinstance(v, Variable) and v.name not in self.variables)}
        return value

    def arguments(self, f: Field) -> dict:
        return self.plain(f.arguments)

    def included(self, directives: list) -> bool:
        for name, arguments in directives:
            if name not in ("skip", "include"):
                raise RequestError(f"unknown directive @{name}")
            if bool(self.plain(arguments.get("if"))) == (name == "skip"):
                return False
        return True

    def fields(self, selection: list | None, on: tuple[str, ...]) -> list[Field]:
        """Fields of a selection on types of these names, fragments opened, equal response names merged."""
        out: dict[str, Field] = {}

        def walk(items: list, seen: tuple[str, ...]) -> None:
            for item in items:
                if not self.included(item.directives):
                    continue
                if isinstance(item, Field):
                    if item.alias in out:
                        known = out[item.alias]
                        if known.name != item.name or known.arguments != item.arguments:
                            raise RequestError(f"{item.alias!r} stands for two different fields")
                        both = [*(known.selection or []), *(item.selection or [])]
                        out[item.alias] = Field(item.name, item.alias, item.arguments, [], both or None)
                    else:
                        out[item.alias] = item
                    continue
                if isinstance(item, Spread):
                    if item.name in seen:
                        raise RequestError(f"fragment {item.name!r} contains itself")
                    if item.name not in self.doc.fragments:
                        raise RequestError(f"no fragment {item.name!r}")
                    inner: Inline = self.doc.fragments[item.name]
                    below = (*seen, item.name)
                else:
                    inner, below = item, seen
                if inner.on is None or inner.on in on:
                    walk(inner.selection, below)

        walk(selection or [], ())
        if not out:
            raise RequestError(f"{on[0]} needs a selection of fields")
        return list(out.values())

    # Root

    def run(self) -> dict:
        if self.op.kind != "query":
            raise RequestError(f"{self.op.kind} operations have no single answer; subscribe() gives their stream")
        return self.root(self.op.selection)

    def subscription(self, feeds: dict) -> DataFrame:
        """The changes of one entity that the arguments ask for, each with the selected fields as the JSON of an answer."""
        fields = self.fields(self.op.selection, ("Subscription",)) if self.op.kind == "subscription" else []
        if len(fields) != 1:
            raise RequestError("a subscription has one field")
        f, a = fields[0], self.arguments(fields[0])
        name = self.catalog.by_connection.get(f.name)
        if name is None or not self.catalog.entity(name).declared.key:
            raise RequestError(f"Subscription has no field {f.name!r}")
        if name not in feeds:
            raise RequestError(f"there is no feed of {name}")
        scope = self.scope(name, {})
        as_list = lambda v: v if isinstance(v, list) or v is None else [v]
        ids = as_list(a.get("id"))
        rows = changes.enriched(changes.changes(feeds[name], [str(i) for i in ids] if ids is not None else None, as_list(a.get("mutation"))), scope)
        e, made = scope.entity, []
        for x in self.fields(f.selection, (f"{e.type_name}SubscriptionPayload",)):
            if x.name == "__typename":
                made.append(F.lit(f"{e.type_name}SubscriptionPayload").alias(x.alias))
            elif x.name in ("id", "mutation_type"):
                made.append(F.col(x.name).alias(x.alias))
            elif x.name == "_entity":
                row = F.from_json("_entity", T.StructType([e.schema[c] for c in e.columns]))
                inner = []
                for y in self.fields(x.selection, (e.type_name,)):
                    if y.name == "__typename":
                        inner.append(F.lit(e.type_name).alias(y.alias))
                    else:
                        c = e.column(y.name)
                        text = isinstance(e.kind(c), (T.LongType, T.DecimalType))
                        inner.append((row[c].cast("string") if text else row[c]).alias(y.alias))
                made.append(F.when(F.col("_entity").isNotNull(), F.struct(*inner)).alias(x.alias))
            else:
                raise RequestError(f"{e.type_name}SubscriptionPayload has no field {x.name!r}")
        answer = F.struct(F.struct(F.struct(*made).alias(f.alias)).alias("data"))
        return rows.select(F.to_json(answer, {"ignoreNullFields": "false"}).alias("payload"))

    def root(self, selection: list) -> dict:
        out = {}
        for f in self.fields(selection, ("Query", "Node")):
            out[f.alias] = self.root_field(f)
        return out

    def root_field(self, f: Field):
        a, c = self.arguments(f), self.catalog
        if f.name == "__typename":
            return "Query"
        if f.name in ("__schema", "__type"):
            return self.introspect(f, a)
        if f.name == "query":
            return self.root(f.selection)
        if f.name == "nodeId":
            return codec.encode(["query"])
        if f.name == "_bigIntFilters":
            return None
        if f.name == "_metadata":
            return self.metadata(f, a)
        if f.name == "_metadatas":
            return self.shaped(f.selection, metadata.metadatas(c), ("_Metadatas", "_MetadatasEdge", "_Metadata"))
        if f.name == "node":
            return self.node(f, a)
        if f.name in c.by_connection:
            return self.connection(f, a, c.by_connection[f.name])
        if f.name in c.by_single:
            return self.single(f, a, c.by_single[f.name])
        if f.name.endswith("ByNodeId") and f.name[: -len("ByNodeId")] in c.by_single:
            return self.node(f, a, c.by_single[f.name[: -len("ByNodeId")]])
        for name, e in c.entities.items():
            if (e.declared.search or e.declared.finder) and f.name == sdl.search_field(name):
                return self.search(f, a, name)
        raise RequestError(f"Query has no field {f.name!r}")

    def introspect(self, f: Field, a: dict):
        whole = sdl.introspection(self.catalog, self.engine.options)
        if f.name == "__type":
            return self.shaped(f.selection, next((t for t in whole["types"] if t["name"] == a.get("name")), None), ("__Type",))
        return self.shaped(f.selection, whole, ("__Schema",))

    def shaped(self, selection: list | None, value, on: tuple[str, ...]):
        """Plain data in the shape of a selection; what it doesn't have is null."""
        if isinstance(value, list):
            return [self.shaped(selection, v, on) for v in value]
        if selection is None or not isinstance(value, dict):
            return value
        return {f.alias: on[0] if f.name == "__typename" else self.shaped(f.selection, value.get(f.name), (*on, "__Type", "__Field", "__InputValue", "__EnumValue", "TableEstimate")) for f in self.fields(selection, (*on, "__Type", "__Field", "__InputValue", "__EnumValue", "PageInfo"))}

    def metadata(self, f: Field, a: dict):
        wanted = {x.name for x in self.fields(f.selection, ("_Metadata",))}
        return self.shaped(f.selection, metadata.metadata(self.catalog, a.get("chainId"), wanted, self.engine.external_metadata), ("_Metadata",))

    # Single rows

    def point(self, a: dict) -> int | None:
        """The point of history that an argument asks for; what is no number asks for the latest."""
        value = a.get(self.engine.options.point_argument)
        return int(value) if value is not None and re.fullmatch(r"-?\d+", str(value)) else None

    def scope(self, name: str, a: dict) -> Scope:
        return Scope.of(self.catalog, name, self.point(a), self.engine.options.historical)

    def single(self, f: Field, a: dict, name: str):
        key = self.catalog.entity(name).declared.key
        given = [a.get(naming.camel(k), a.get("id") if len(key) == 1 else None) for k in key]
        if not key or any(v is None for v in given):
            raise RequestError(f"{f.name} needs {', '.join(naming.camel(k) for k in key) or 'a key'}")
        return self.by_key(f, self.scope(name, a), given)

    def node(self, f: Field, a: dict, name: str | None = None):
        got = codec.decode(str(a.get("nodeId", "")), list)
        table = got[0] if got and isinstance(got[0], str) else None
        if table not in self.catalog.entities or (name is not None and table != name) or len(got) != 1 + len(self.catalog.entity(table).declared.key):
            raise RequestError(f"{a.get('nodeId')!r} is no node id" + (f" of {name}" if name else ""))
        return self.by_key(f, self.scope(table, a), got[1:])

    def by_key(self, f: Field, scope: Scope, values: list):
        where = {naming.camel(k): {"equalTo": v} for k, v in zip(scope.entity.declared.key, values, strict=True)}
        rows = scope.frame(predicate(scope, where)).select(*(scope.col(c).alias(c) for c in self.needed(scope.entity, f.selection))).limit(1)
        made = self.complete(scope, rows.schema, rows.collect(), f.selection)
        return made[0] if made else None

    # Connections

    def request(self, scope: Scope, a: dict, select: list[str]) -> Connection:
        order = a.get("orderBy")
        page = Page(**{k: a[k] for k in _PAGE if a.get(k) is not None})
        as_list = lambda v: v if isinstance(v, list) or v is None else [v]
        return Connection(scope, a.get("filter"), as_list(order), a.get("orderByNull"), as_list(a.get("distinct")), page, select, self.engine.limit)

    def connection(self, f: Field, a: dict, name: str):
        scope = self.scope(name, a)
        e = scope.entity
        types = (f"{naming.plural_type_name(name)}Connection",)
        fields = self.fields(f.selection, types)
        request = self.request(scope, a, self.node_columns(e, fields))
        # Rows, count, aggregates and groups are separate jobs on one relation: they run side by side.
        jobs = {"": request.fetch} if any(x.name in ("nodes", "edges", "pageInfo") for x in fields) else {}
        for x in fields:
            if x.name == "totalCount":
                jobs[x.alias] = lambda: request.total().first()[0]
            elif x.name == "aggregates" and self.engine.options.aggregates:
                jobs[x.alias] = lambda x=x: self.aggregates(scope, request, x)
            elif x.name == "groupedAggregates" and self.engine.options.aggregates:
                jobs[x.alias] = lambda x=x: self.groups(scope, x, lambda keys, wanted: self.bounded(request.grouped(keys, wanted)))
        done = self.side_by_side(jobs)
        out, fetched = {}, done.pop("", None)
        for x in fields:
            if x.name == "__typename":
                out[x.alias] = types[0]
            elif x.alias in done:
                out[x.alias] = done[x.alias]
            elif x.name == "pageInfo":
                out[x.alias] = self.shaped(x.selection, fetched.page_info(), ("PageInfo",))
            elif x.name == "nodes":
                out[x.alias] = self.complete(scope, fetched.schema, fetched.rows, x.selection)
            elif x.name == "edges":
                out[x.alias] = self.edges(scope, x, fetched.schema, fetched.rows, fetched.order)
            else:
                raise RequestError(f"{types[0]} has no field {x.name!r}")
        return out

    def aggregates(self, scope: Scope, request: Connection, f: Field) -> dict:
        wanted, shape = self.aggregate_shape(scope, f)
        return self.aggregate_row(scope, shape, request.aggregates(wanted).first() if wanted else None)

    def bounded(self, groups: DataFrame) -> list:
        """The groups on the driver; more than the limit are an error, not cut off."""
        if self.engine.options.unsafe:
            return groups.collect()
        most = self.engine.options.group_limit
        got = groups.limit(most + 1).collect()
        if len(got) > most:
            raise RequestError(f"there are more than {most} groups; group by less, or filter")
        return got

    def side_by_side(self, jobs: dict) -> dict:
        """Results of the functions, each in a thread of its own if there are several; job tags go along."""
        if len(jobs) < 2:
            return {k: f() for k, f in jobs.items()}
        with ThreadPoolExecutor(len(jobs)) as pool:
            running = {k: pool.submit(inheritable_thread_target(self.catalog.spark)(f)) for k, f in jobs.items()}
            return {k: r.result() for k, r in running.items()}

    def node_columns(self, e: Entity, fields: list[Field]) -> list[str]:
        """Columns that the nodes and edges of a connection need."""
        out: dict[str, None] = {}
        for x in fields:
            if x.name == "nodes":
                out |= dict.fromkeys(self.needed(e, x.selection))
            elif x.name == "edges":
                for y in self.fields(x.selection, (f"{naming.plural_type_name(e.name)}Edge",)):
                    if y.name == "node":
                        out |= dict.fromkeys(self.needed(e, y.selection))
        return list(out)

    def edges(self, scope: Scope, f: Field, schema, rows: list, order: list[str]) -> list[dict]:
        on = f"{naming.plural_type_name(scope.entity.name)}Edge"
        fields = self.fields(f.selection, (on,))
        out: list[dict] = [{} for _ in rows]
        for x in fields:
            if x.name == "cursor":
                made = [codec.encode({c: cursor_value(r[c]) for c in order}) for r in rows]
            elif x.name == "node":
                made = self.complete(scope, schema, rows, x.selection)
            elif x.name == "__typename":
                made = [on] * len(rows)
            else:
                raise RequestError(f"{on} has no field {x.name!r}")
            for o, m in zip(out, made, strict=True):
                o[x.alias] = m
        return out

    def search(self, f: Field, a: dict, name: str):
        scope = self.scope(name, a)
        asked, offset = a.get("first"), a.get("offset") or 0
        size = Page(first=asked).size(self.engine.limit or 100)
        fields = self.fields(f.selection, (f"{naming.plural_type_name(name)}Connection",))
        query = a.get("search") or ""
        after = codec.decode(str(a["after"]), dict) if a.get("after") is not None else None
        rows = search.ranked(scope, query, size + 1, offset, after)
        select = self.node_columns(scope.entity, fields)
        key = [k for k in scope.entity.declared.key if k not in select]
        page = rows.select("__score", *(scope.col(c).alias(c) for c in [*select, *key])) if rows is not None else None
        got = page.collect() if page is not None and any(x.name in ("nodes", "edges", "pageInfo") for x in fields) else []
        out = {}
        order = ["__score", *scope.entity.declared.key]
        fetched = Fetched(None, got[:size], order, page.schema if page is not None else None, len(got) > size, offset > 0)
        for x in fields:
            if x.name == "totalCount":
                all_rows = search.search(scope, query)
                out[x.alias] = all_rows.count() if all_rows is not None else 0
            elif x.name == "nodes":
                out[x.alias] = self.complete(scope, fetched.schema, fetched.rows, x.selection)
            elif x.name == "edges":
                out[x.alias] = self.edges(scope, x, fetched.schema, fetched.rows, order)
            elif x.name == "pageInfo":
                out[x.alias] = self.shaped(x.selection, fetched.page_info(), ("PageInfo",))
            elif x.name == "__typename":
                out[x.alias] = f"{naming.plural_type_name(name)}Connection"
            else:
                raise RequestError(f"a search has no field {x.name!r}")
        return out

    # Rows

    def needed(self, e: Entity, selection: list | None) -> list[str]:
        """Columns for the selection of a row: its fields, and the keys its relations start from."""
        out = dict.fromkeys(e.declared.key)
        for f in self.fields(selection, (e.type_name, "Node")):
            if f.name in e.fields:
                out[e.fields[f.name]] = None
            elif f.name in e.relations:
                out[e.relations[f.name].here] = None
            elif f.name not in ("__typename", "nodeId"):
                raise RequestError(f"{e.type_name} has no field {f.name!r}")
        return list(out) or e.columns[:1]

    def complete(self, scope: Scope, schema, rows: list, selection: list | None) -> list[dict]:
        e = scope.entity
        out: list[dict] = [{} for _ in rows]
        fields = self.fields(selection, (e.type_name, "Node"))
        # Relations of a level don't need each other.
        related = self.side_by_side({f.alias: lambda f=f: self.relation(scope, e.relations[f.name], f, rows) for f in fields if f.name in e.relations and f.name not in e.fields})
        for f in fields:
            if f.name == "__typename":
                made = [e.type_name] * len(rows)
            elif f.name == "nodeId":
                made = [codec.node_id(e.name, [cursor_value(r[k]) for k in e.declared.key]) for r in rows]
            elif f.name in e.fields:
                c = e.fields[f.name]
                made = [wire(r[c], e.kind(c), e.declared.scalars.get(c)) for r in rows]
            else:
                made = related[f.alias]
            for o, m in zip(out, made, strict=True):
                o[f.alias] = m
        return out

    def relation(self, scope: Scope, r: Relation, f: Field, rows: list) -> list:
        keys = list(dict.fromkeys(row[r.here] for row in rows if row[r.here] is not None))
        other = self.catalog.entity(r.table)
        if r.kind in ("forward", "single"):
            select = self.needed(other, f.selection)
            found = relations.forward(scope, r, keys, select) if keys else None
            got = found.collect() if found is not None else []
            made = dict(zip((g[relations.PARENT] for g in reversed(got)), reversed(self.complete(scope.to(r.table), found.schema, got, f.selection)), strict=True)) if got else {}
            return [made.get(row[r.here]) for row in rows]
        return self.children(scope, r, f, rows, keys)

    def children(self, scope: Scope, r: Relation, f: Field, rows: list, keys: list) -> list[dict]:
        a = self.arguments(f)
        other = self.catalog.entity(r.table)
        on = f"{naming.plural_type_name(r.table)}Connection"
        fields = self.fields(f.selection, (on,))
        request = self.request(scope.to(r.table), a, self.node_columns(other, fields))
        page, size = request.page, request.page.size(self.engine.limit)
        by_parent: dict = defaultdict(list)
        order, schema = [], None
        totals, aggs, groups = {}, {}, {}

        def page_rows() -> None:
            nonlocal order, schema
            cursor = codec.decode(page.after or page.before, dict) if page.after or page.before else None
            df, terms, _ = relations.children(scope, r, keys, request.where, request.order, request.nulls, a.get("distinct") and [d.upper() for d in request.distinct], page, request.select, self.engine.limit, 1, cursor)
            schema, order = df.schema, [t.column for t in terms]
            for row in sorted(df.collect(), key=lambda x: x["__rank"]):
                by_parent[row[relations.PARENT]].append(row)

        def figures(x: Field) -> None:
            if x.name == "totalCount":
                totals.update((t[0], t[1]) for t in relations.counts(scope, r, keys, request.where).collect())
            elif x.name == "aggregates":
                wanted, _ = self.aggregate_shape(request.scope, x)
                aggs[x.alias] = {t[relations.PARENT]: t for t in relations.child_aggregates(scope, r, keys, wanted, request.where)[0].collect()} if wanted else {}
            else:
                items = self.arguments(x).get("groupBy") or []
                wanted, _ = self.aggregate_shape(request.scope, x)
                got = relations.child_aggregates(scope, r, keys, wanted, request.where, items)[0]
                names = [c for c in got.columns if c != relations.PARENT][: len(items)]
                groups[x.alias] = defaultdict(list)
                for t in self.bounded(got.orderBy(*(F.col(n).asc_nulls_last() for n in names)) if names else got):
                    groups[x.alias][t[relations.PARENT]].append(t)

        jobs = {"": page_rows} if any(x.name in ("nodes", "edges", "pageInfo") for x in fields) else {}
        jobs |= {x.alias: lambda x=x: figures(x) for x in fields if x.name == "totalCount" or x.name in ("aggregates", "groupedAggregates") and self.engine.options.aggregates}
        self.side_by_side(jobs if keys else {})
        # All children of the level are completed at once, then dealt to their parents.
        flat = [row for k in keys for row in self.cut(by_parent[k], size, page)]
        made = {x.alias: self.complete(request.scope, schema, flat, x.selection) if x.name == "nodes" else self.edges(request.scope, x, schema, flat, order) for x in fields if x.name in ("nodes", "edges")}
        place, at = {}, 0
        for k in keys:
            n = len(self.cut(by_parent[k], size, page))
            place[k], at = (at, at + n), at + n
        return [self.one(fields, on, request, row[r.here], by_parent, place, made, totals, aggs, groups, order, size) for row in rows]

    @staticmethod
    def cut(rows: list, size: int | None, page: Page) -> list:
        rows = rows[:size] if size is not None else rows
        return rows[::-1] if page.backward else rows

    def one(self, fields, on, request, key, by_parent, place, made, totals, aggs, groups, order, size) -> dict:
        out = {}
        a, b = place.get(key, (0, 0))
        for x in fields:
            if x.name in ("nodes", "edges"):
                out[x.alias] = made[x.alias][a:b]
            elif x.name == "totalCount":
                out[x.alias] = totals.get(key, 0)
            elif x.name == "pageInfo":
                rows = self.cut(by_parent.get(key, []), size, request.page)
                over = size is not None and len(by_parent.get(key, [])) > size
                page = request.page
                flags = (page.before is not None, over or page.after is not None) if page.backward else (over, page.offset > 0 or page.after is not None)
                out[x.alias] = self.shaped(x.selection, Fetched(request, rows, order, None, *flags).page_info(), ("PageInfo",))
            elif x.name == "aggregates":
                out[x.alias] = self.aggregate_row(request.scope, self.aggregate_shape(request.scope, x)[1], aggs.get(x.alias, {}).get(key))
            elif x.name == "groupedAggregates":
                out[x.alias] = self.groups(request.scope, x, lambda keys, wanted, x=x: groups.get(x.alias, {}).get(key, []))
            elif x.name == "__typename":
                out[x.alias] = on
            else:
                raise RequestError(f"{on} has no field {x.name!r}")
        return out

    # Aggregates

    def aggregate_shape(self, scope: Scope, f: Field) -> tuple[dict[str, list[str]], list]:
        """({function: columns} to compute, [(response name, function, [(response name, column)])])."""
        wanted: dict[str, list[str]] = {}
        shape: list = []
        e = scope.entity
        for x in self.fields(f.selection, (f"{e.type_name}Aggregates", f"{e.type_name}AggregateGroup")):
            if x.name == "count":
                wanted["count"] = []
                shape.append((x.alias, "count", None))
            elif x.name in ("__typename", "keys"):
                shape.append((x.alias, x.name, None))
            else:
                cols = [(y.alias, e.column(y.name)) for y in self.fields(x.selection, (f"{e.type_name}{x.name[0].upper()}{x.name[1:]}Aggregates",)) if y.name != "__typename"]
                wanted.setdefault(x.name, []).extend(c for _, c in cols if c not in wanted.get(x.name, []))
                shape.append((x.alias, x.name, cols))
        return wanted, shape

    def aggregate_row(self, scope: Scope, shape: list, row, keys: list | None = None) -> dict:
        e = scope.entity
        out: dict = {}
        for alias, name, cols in shape:
            if name == "keys":
                out[alias] = keys
            elif name == "__typename":
                out[alias] = f"{e.type_name}Aggregates" if keys is None else f"{e.type_name}AggregateGroup"
            elif name == "count":
                out[alias] = str(row["count"]) if row is not None else "0"
            else:
                out[alias] = {a: self.aggregate_value(e, name, c, row[f"{name}_{c}"] if row is not None else None) for a, c in cols}
        return out

    @staticmethod
    def aggregate_value(e: Entity, name: str, column: str, value):
        """Counts, sums and means are strings; least and greatest keep the column's form."""
        if name == "distinctCount":
            return str(value or 0)
        if value is None:
            return None
        if name in ("min", "max"):
            return wire(value, e.kind(column))
        return format(value, "f").rstrip("0").rstrip(".") if hasattr(value, "as_tuple") and "." in format(value, "f") else str(value)

    def groups(self, scope: Scope, f: Field, rows) -> list[dict]:
        items = self.arguments(f).get("groupBy") or []
        items = items if isinstance(items, list) else [items]
        wanted, shape = self.aggregate_shape(scope, f)
        return [self.aggregate_row(scope, shape, r, [key_text(r[self.key_name(scope, i)]) for i in items]) for r in rows(items, wanted)]

    @staticmethod
    def key_name(scope: Scope, item: str) -> str:
        return group_key(scope, item)[0]


def key_text(value) -> str:
    """A group's key as text; null is empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return value.isoformat() if hasattr(value, "isoformat") else str(value)
