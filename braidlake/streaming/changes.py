"""Change feeds: streams of {id, mutation_type, _entity}, filtered and completed from the current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.errors import RequestError
from braidlake.operators.metadata import channel
from braidlake.plans.predicates import Scope

KINDS = ("INSERT", "UPDATE", "DELETE")
PAYLOAD = "id string, mutation_type string, _entity string"


def parsed(stream: DataFrame, column: str = "value", table: tuple[str, str] | None = None, topic: str = "topic") -> DataFrame:
    """Payloads of a text stream (files, Kafka, sockets). What is no payload is dropped. table: (schema, table) whose channel alone is read, by the column of topics."""
    if table is not None:
        stream = stream.where(F.col(topic) == channel(*table, "entity_change"))
    got = stream.select(F.from_json(F.col(column).cast("string"), PAYLOAD, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")
    return got.where(F.col("id").isNotNull() & F.col("mutation_type").isin(*KINDS))


def changes(feed: DataFrame, ids: list | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The feed's changes to the given ids and of the given kinds; None: any."""
    if kinds and (bad := [k for k in kinds if k not in KINDS]):
        raise RequestError(f"unknown kind of change {bad[0]!r}")
    out = feed
    if ids is not None:
        out = out.where(F.col("id").isin(*ids) if ids else F.lit(False))
    if kinds is not None:
        out = out.where(F.col("mutation_type").isin(*kinds) if kinds else F.lit(False))
    return out


def enriched(feed: DataFrame, scope: Scope) -> DataFrame:
    """The feed with _entity as JSON: the payload's own, else the current row's unless it was deleted."""
    e = scope.entity
    if len(e.declared.key) != 1:
        raise RequestError(f"{e.type_name} has no single key")
    now = scope.frame().select(scope.col(e.declared.key[0]).cast("string").alias("__id"), F.to_json(F.struct(*(scope.col(c).alias(c) for c in e.columns))).alias("__now"))
    joined = feed.join(now, feed["id"].cast("string") == F.col("__id"), "left")
    own = feed["_entity"] if "_entity" in feed.columns else F.lit(None).cast("string")
    return joined.select(feed["id"], feed["mutation_type"], F.coalesce(own, F.when(feed["mutation_type"] != "DELETE", F.col("__now"))).alias("_entity"))


def windowed_counts(events: DataFrame, time: Column, keys: list[str], unit: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and key of a stream, closed when the watermark passes."""
    at = events.withColumn("__at", time.cast("timestamp")).withWatermark("__at", late)
    return at.groupBy(F.window("__at", unit).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
