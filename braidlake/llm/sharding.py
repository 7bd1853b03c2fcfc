"""Balanced shards: longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm.common import fresh, stage, table
from braidlake.llm.ranks import cell_of, cells, rank_within

SHARDS = 8


def schedule(runs: Iterable[tuple[int, int]], shards: int) -> Iterable[list[int]]:
    """LPT of runs (size, groups of that size), largest size first: for each run, the groups that each shard gets.

    Each group goes to the least-loaded shard, ties to the lower one, from a heap. Groups of one size are
    alike, so a long run is dealt at once as far as that is what the heap would do: every shard gets the
    groups that find it under a load that all of them reach; the few that are left go through the heap.
    """
    load = [0] * shards
    for size, n in runs:
        got = [0] * shards
        if n > 4 * shards and size > 0:
            before = lambda level: [max(0, -(-(level - x) // size)) for x in load]  # noqa: B023, E731  groups that find a shard under the level
            low, high = min(load), max(load) + size * (n + 1)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sum(before(middle)) <= n else (low, middle)
            got = before(low)
            load = [x + size * g for x, g in zip(load, got, strict=True)]
        elif size == 0:
            got[min(range(shards), key=lambda k: (load[k], k))] = n  # they weigh nothing, so the heap's top stays
            yield got
            continue
        heap = [(x, k) for k, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(n - sum(got)):
            x, k = heap[0]
            heapq.heapreplace(heap, (x + size, k))
            load[k] = x + size
            got[k] += 1
        yield got


def assign(docs: DataFrame, group: str, size: str, shards: int = SHARDS) -> DataFrame:
    """docs with a last column `shard` (with _ before it where docs has that name): the rows of a group together, by LPT over all groups.

    group is a column without nulls, size one of longs; null sizes count as 0. Groups are counted by
    their size; the heap on the driver deals one run of equal groups after the other, and a group finds
    its shard by its rank within its run (ties by hash and name, so reruns agree). The driver holds a row
    for each different size of a group: their sum is within the total T, so they are sqrt(2 T) at most,
    and in text corpora some ten thousands. A group larger than a shard's share is not split, as groups
    stay together. Groups of size 0 all go to the shard that is least loaded at the end. Ties and
    repeated rows need no special case; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shard, total, place, coarse, cell = fresh([*docs.columns], "shard", "lpt_size", "lpt_rank", "lpt_bin", "lpt_cell")
    groups = stage(docs.groupBy(group).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(total)))
    counts = groups.groupBy(total).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(total))
    runs = counts.toArrow()
    sizes, n = runs[total].to_numpy(), runs["n"].to_numpy()
    ends = np.cumsum(np.array(list(schedule(zip(sizes.tolist(), n.tolist(), strict=True), shards)), np.int64).reshape(-1, shards), axis=1)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * shards), pa.array(ends.reshape(-1)))
    plan = spark.createDataFrame(pa.table({total: pa.array(sizes, pa.int64()), "ends": flat}), f"`{total}` long, ends array<long>")
    m = cells(int(n.sum()))
    keyed = groups.withColumn(cell, cell_of(F.col(group), m)).withColumn(coarse, F.floor(F.col(cell) / 32).cast("int"))
    ranked = rank_within(keyed, total, coarse, cell, [group], place).join(plan, total)
    # The first shard that has more groups of the run, with those before it, than the rank.
    found = stage(ranked.select(group, F.size(F.filter("ends", lambda e: e <= F.col(place))).alias(shard)))
    return docs.join(found, group).select(*(F.col(f"`{c}`") for c in docs.columns), shard)


def with_slots(placed: DataFrame, id_col: str, rows: int, shard: str = "shard", name: str = "slot") -> DataFrame:
    """placed with each row's place in its shard: 0 and up, without gaps."""
    coarse, cell = fresh([*placed.columns, name], "slot_bin", "slot_cell")
    n = cells(rows)
    keyed = placed.withColumn(coarse, F.floor(cell_of(F.col(id_col), n) / 32).cast("int")).withColumn(cell, cell_of(F.col(id_col), n))
    return rank_within(keyed, shard, coarse, cell, [id_col], name).select(*(F.col(f"`{c}`") for c in placed.columns), name)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards; equal texts (all null ones too) are a group, of text bytes plus 1 a row."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("grouped"))
    docs = stage(docs)
    placed = with_slots(assign(docs, "grouped", "size"), "doc_id", docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# LPT over all groups, largest first; then groups of one size are dealt by rank to the shards that the run fills.
OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, coalesce(md5(text), 'null') AS g,
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes
  FROM documents
), crc AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t
  FROM range(256) AS r(k)
), gs AS (
  SELECT g, sum(size)::BIGINT AS total FROM d GROUP BY g
), n AS (
  SELECT greatest(1, ceil(sqrt(count(*)) / 2)::BIGINT) AS of_groups, (SELECT greatest(1, ceil(sqrt(count(*)) / 2)::BIGINT) FROM d) AS of_docs FROM gs
), o AS (
  SELECT total, row_number() OVER (ORDER BY total DESC, g) AS i FROM gs
), lpt AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS total, -1::BIGINT AS shard
  UNION ALL
  SELECT o.i, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + o.total ELSE x END), o.total,
    list_position(load, list_min(load))::BIGINT - 1
  FROM lpt JOIN o ON o.i = lpt.i + 1
), runs AS (
  SELECT total, shard, sum(count(*)) OVER (PARTITION BY total ORDER BY shard) AS upto FROM lpt WHERE shard >= 0 GROUP BY total, shard
), ranked AS (
  SELECT g, total, row_number() OVER (PARTITION BY total ORDER BY ('0x' || substr(md5(g), 1, 8))::BIGINT % (SELECT of_groups FROM n), g) AS r FROM gs
), placed AS (
  SELECT g, min(shard)::INT AS shard FROM ranked JOIN runs ON ranked.total = runs.total AND upto >= r GROUP BY g
)
SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], list_transform(bytes, lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT of_docs FROM n), doc_id) - 1)::BIGINT AS slot,
  NULL::INT AS grown_shard
FROM d JOIN placed ON d.g = placed.g, crc
"""
