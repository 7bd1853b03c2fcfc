"""A connection: filter, order, distinct, page, counts and aggregates of one entity, all from one filtered relation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.errors import RequestError
from braidlake.functions import codec
from braidlake.functions.types import wire
from braidlake.operators import aggregates
from braidlake.plans.ordering import Term, beyond, with_order
from braidlake.plans.predicates import Scope, has_relation, predicate


@dataclass
class Page:
    """Arguments of a page. first or last of 0 or less count as absent."""

    first: int | None = None
    last: int | None = None
    after: str | None = None
    before: str | None = None
    offset: int = 0

    def __post_init__(self):
        self.first = self.first if self.first and self.first > 0 else None
        self.last = self.last if self.last and self.last > 0 else None
        self.offset = self.offset or 0
        if self.first and self.last:
            raise RequestError("first and last can't be given together")
        if self.last and self.offset:
            raise RequestError("offset and last can't be given together")
        if self.offset < 0:
            raise RequestError("offset can't be negative")

    @property
    def backward(self) -> bool:
        return self.last is not None

    def size(self, limit: int | None) -> int | None:
        """Rows of the page: as asked for, `limit` at most; without limit and argument, all."""
        asked = self.first or self.last
        return asked if limit is None else min(asked or limit, limit)


@dataclass
class Connection:
    """A request for rows of an entity. select: columns wanted; None for all public ones."""

    scope: Scope
    where: dict | None = None
    order: list[str] | None = None
    nulls: str | None = None
    distinct: list[str] | None = None
    page: Page = field(default_factory=Page)
    select: list[str] | None = None
    limit: int | None = 100

    def __post_init__(self):
        e = self.scope.entity
        self.distinct = [self._distinct_column(d) for d in self.distinct or []]
        self.select = [e.column(s) for s in self.select] if self.select is not None else e.columns

    def _distinct_column(self, item: str) -> str:
        by_item = {c.upper(): c for c in self.scope.entity.columns}
        if item not in by_item:
            raise RequestError(f"{self.scope.entity.type_name} has no distinct item {item!r}")
        return by_item[item]

    def filtered(self) -> DataFrame:
        """The relation that rows, count and aggregates share."""
        return self.scope.frame(predicate(self.scope, self.where))

    def ordered(self) -> tuple[DataFrame, list[Term]]:
        """Rows before paging, and the order they are paged in. Of each distinct key, nulls too, the first row by the order."""
        relation = self.filtered()
        size = self.page.size(self.limit)
        if self.distinct and size is not None and not self.page.backward and self.page.after is None and self.page.before is None and not has_relation(self.scope, self.where):
            # The page is ordered by the distinct keys, so only rows of the first ones are ranked: a page of keys at most.
            # Where the filter is a join, one pass over it costs less than two.
            names = [f"__key{i}" for i in range(len(self.distinct))]
            keys = relation.select(*(self.scope.col(c).alias(n) for c, n in zip(self.distinct, names, strict=True))).distinct()
            keys = keys.orderBy(*(Term(n).sort() for n in names)).limit(self.page.offset + size + 1)
            same = [self.scope.col(c).eqNullSafe(F.col(n)) for c, n in zip(self.distinct, names, strict=True)]
            relation = relation.join(F.broadcast(keys), reduce(lambda a, b: a & b, same), "left_semi")
        df, terms = with_order(self.scope, relation, self.order, self.nulls)
        if self.distinct:
            keys = [Term(c) for c in self.distinct]
            w = Window.partitionBy(*self.distinct).orderBy(*(t.sort() for t in terms))
            df = df.withColumn("__first", F.row_number().over(w)).where(F.col("__first") == 1).drop("__first")
            terms = keys + [t for t in terms if t.column not in self.distinct]
        wanted = dict.fromkeys([*self.select, *self.scope.entity.declared.key, *(t.column for t in terms)])
        return df.select(*(F.col(c) if c.startswith("__order") else self.scope.col(c).alias(c) for c in wanted)), terms

    def rows(self, more: int = 0) -> tuple[DataFrame, list[Term]]:
        """The page as a DataFrame, in page order unless it is read from the end, with up to `more` rows beyond it."""
        df, terms = self.ordered()
        page = self.page
        if page.after is not None:
            df = df.where(self._beyond(df, terms, page.after))
        elif page.before is not None and not page.backward:
            df = df.where(self._beyond(df, [t.flipped() for t in terms], page.before))
        if page.backward:
            terms = [t.flipped() for t in terms]
            if page.before is not None:
                df = df.where(self._beyond(df, terms, page.before))
        df = df.orderBy(*(t.sort() for t in terms))
        if page.offset:
            df = df.offset(page.offset)
        size = page.size(self.limit)
        return (df if size is None else df.limit(size + more)), terms

    def _beyond(self, df: DataFrame, terms: list[Term], cursor: str) -> Column:
        got = codec.decode(cursor, dict)
        if set(got) != {t.column for t in terms}:
            raise RequestError("the cursor is from another order")
        return beyond(terms, [got[t.column] for t in terms], [df.schema[t.column].dataType for t in terms])

    def fetch(self) -> Fetched:
        """The page's rows on the driver; one more than asked for tells whether there are others."""
        size = self.page.size(self.limit)
        df, terms = self.rows(more=1)
        got = df.collect()
        over = size is not None and len(got) > size
        got = got[:size] if size is not None else got
        if self.page.backward:
            got, terms = got[::-1], [t.flipped() for t in terms]
            following, previous = self.page.before is not None, over or self.page.after is not None
        else:
            following, previous = over, self.page.offset > 0 or self.page.after is not None
        return Fetched(self, got, [t.column for t in terms], df.schema, following, previous)

    def total(self) -> DataFrame:
        """How many rows meet the filter, whatever the page or distinct."""
        return self.filtered().agg(F.count(F.lit(1)).alias("total_count"))

    def aggregates(self, wanted: dict[str, list[str]]) -> DataFrame:
        return aggregates.aggregate(self.scope, self.filtered(), wanted)

    def grouped(self, keys: list[str], wanted: dict[str, list[str]]) -> DataFrame:
        return aggregates.grouped(self.scope, self.filtered(), keys, wanted)


@dataclass
class Fetched:
    connection: Connection
    rows: list
    order: list[str]
    schema: object
    has_next: bool
    has_previous: bool

    def cursor(self, row) -> str:
        return codec.encode({c: cursor_value(row[c]) for c in self.order})

    def node(self, row) -> dict:
        e = self.connection.scope.entity
        return {c: wire(row[c], self.schema[c].dataType, e.declared.scalars.get(c)) for c in self.connection.select}

    def page_info(self) -> dict:
        return {
            "hasNextPage": self.has_next, "hasPreviousPage": self.has_previous,
            "startCursor": self.cursor(self.rows[0]) if self.rows else None, "endCursor": self.cursor(self.rows[-1]) if self.rows else None,
        }


def cursor_value(value):
    """A sort key as JSON holds it exactly."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, dict)):
        return json.loads(json.dumps(value, default=str))
    return str(value)
