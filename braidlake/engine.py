"""The engine: requests on a catalog, from Python or as GraphQL text."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.errors import RequestError
from braidlake.gql import schema as sdl
from braidlake.gql.execute import Executor
from braidlake.gql.parser import Document, Operation, parse
from braidlake.gql.validate import Limits, check, check_batch
from braidlake.operators.metadata import metadata
from braidlake.operators.search import ranked
from braidlake.plans.connection import Connection, Page
from braidlake.plans.predicates import Scope
from braidlake.sources.catalog import Catalog
from braidlake.streaming import changes as feeds

#: Seconds that requests are counted by.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@dataclass(frozen=True)
class Options:
    """query_limit: rows of a page at most, and by default. group_limit: groups of one answer at most. unsafe: no default
    limit and no request limits, so a request may bring whole tables. point_argument: None: as the metadata tell."""

    query_limit: int = 100
    group_limit: int = 10_000
    unsafe: bool = False
    aggregates: bool = True
    historical: bool = True
    point_argument: str | None = "blockHeight"
    timeout_s: float | None = 10.0
    limits: Limits = Limits()


class Engine:
    def __init__(self, catalog: Catalog, options: Options | None = None, external_metadata: Callable[[], dict] | None = None):
        self.catalog, self.options, self.external_metadata = catalog, options or Options(), external_metadata
        if self.options.point_argument is None:
            told = metadata(catalog, wanted=set()) or {}
            self.options = replace(self.options, point_argument="timestamp" if told.get("historicalStateEnabled") == "timestamp" else "blockHeight")
        #: requests, errors, ms, and le_<seconds>: requests that took so long at most.
        self.metrics: Counter = Counter()
        self.closing = False

    @property
    def limit(self) -> int | None:
        return None if self.options.unsafe else self.options.query_limit

    # Python requests

    def scope(self, entity: str, point: int | None = None) -> Scope:
        return Scope.of(self.catalog, entity, point, self.options.historical)

    def connection(self, entity: str, where: dict | None = None, order: list[str] | None = None, nulls: str | None = None, distinct: list[str] | None = None,
                   select: list[str] | None = None, point: int | None = None, **page) -> Connection:
        return Connection(self.scope(entity, point), where, order, nulls, distinct, Page(**page), select, self.limit)

    def search(self, entity: str, query: str, first: int | None = None, offset: int = 0) -> DataFrame | None:
        return ranked(self.scope(entity), query, Page(first=first).size(self.limit or self.options.query_limit), offset)

    def changes(self, feed: DataFrame, entity: str, ids: list | None = None, kinds: list[str] | None = None) -> DataFrame:
        """A stream of changes to an entity, completed from its current rows."""
        return feeds.enriched(feeds.changes(feed, ids, kinds), self.scope(entity))

    def refresh(self) -> None:
        """Reads the tables' list and schemas again. Requests that run keep the snapshot they began with."""
        self.catalog = self.catalog.refresh()

    def follow(self, notices: DataFrame, column: str = "value"):
        """A running query that refreshes the catalog for each batch of a text stream in which a line says schema_updated."""
        said = notices.where(F.col(column).cast("string").contains("schema_updated"))
        return said.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else self.refresh())

    def subscribe(self, query: str, feeds_of: dict[str, DataFrame], variables: dict | None = None, operation: str | None = None) -> DataFrame:
        """A GraphQL subscription as a DataFrame with a column `payload`, a JSON answer for each change; a stream where the entity's feed is one."""
        doc = parse(query)
        op = self._operation(doc, operation)
        check(doc, op, Limits() if self.options.unsafe else self.options.limits)
        return Executor(self, self.catalog, doc, op, variables or {}).subscription(feeds_of)

    # GraphQL

    def graphql(self, query: str, variables: dict | None = None, operation: str | None = None) -> dict:
        """{"data": ...} or {"errors": [...]}, with the complexity under extensions."""
        catalog, began = self.catalog, time.monotonic()
        self.metrics["requests"] += 1
        cost = None
        try:
            doc = parse(query)
            op = self._operation(doc, operation)
            cost = check(doc, op, Limits() if self.options.unsafe else self.options.limits)
            data = self._timed(lambda: Executor(self, catalog, doc, op, variables or {}).run())
            out = {"data": data}
        except RequestError as e:
            self.metrics["errors"] += 1
            out = {"data": None, "errors": [{"message": str(e)}]}
        except (PySparkException, Py4JJavaError) as e:
            self.metrics["errors"] += 1
            out = {"data": None, "errors": [{"message": "db error: " + str(e).splitlines()[0]}]}
        took = time.monotonic() - began
        self.metrics["ms"] += int(took * 1000)
        self.metrics.update(f"le_{b:g}" for b in BUCKETS if took <= b)
        return out | ({"extensions": {"complexity": cost}} if cost is not None else {})

    @staticmethod
    def _operation(doc: Document, operation: str | None) -> Operation:
        ops = [o for o in doc.operations if operation in (None, o.name)]
        if len(ops) != 1:
            raise RequestError("the document has several operations; name one" if ops else f"no operation {operation!r}")
        return ops[0]

    def batch(self, requests: list[dict]) -> list[dict]:
        """Requests of a batch, one after another."""
        if not self.options.unsafe:
            check_batch(len(requests), self.options.limits)
        return [self.graphql(r.get("query", ""), r.get("variables"), r.get("operationName")) for r in requests]

    def _timed(self, run: Callable[[], dict]) -> dict:
        """run(), whose jobs are cancelled when the time is over."""
        if self.options.timeout_s is None or self.options.unsafe:
            return run()
        sc, tag, over = self.catalog.spark.sparkContext, f"request-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            over.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.options.timeout_s, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            return run()
        except (PySparkException, Py4JJavaError) as e:
            if over.is_set():
                raise RequestError(f"the request took more than {self.options.timeout_s:g} s") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def sdl(self) -> str:
        return sdl.sdl(self.catalog, self.options)

    def health(self) -> dict:
        """healthy; degraded: tables came, went or changed since the schema was built; unhealthy: they can't be read."""
        if self.closing:
            return {"status": "shutting down"}
        try:
            changed = self.catalog.drift()
        except PySparkException as e:
            return {"status": "unhealthy", "reason": str(e).splitlines()[0]}
        out = {"status": "degraded" if changed else "healthy", "tables": len(self.catalog.entities)}
        return out | ({"changed": changed} if changed else {})


def payloads(subscription: DataFrame, checkpoint: str, seconds: float, once: bool = False) -> Iterator[str]:
    """Payloads of a streaming subscription as they come, until the time is over (once: until what is there now is done)."""
    got: queue.Queue = queue.Queue(64)

    def give(batch: DataFrame, _) -> None:
        for r in batch.toLocalIterator():
            got.put(r["payload"])

    writer = subscription.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint)
    running, end = (writer.trigger(availableNow=True) if once else writer).start(), time.monotonic() + seconds
    try:
        while time.monotonic() < end and (running.isActive or not got.empty()):
            try:
                yield got.get(timeout=0.1)
            except queue.Empty:
                continue
    finally:
        running.stop()
