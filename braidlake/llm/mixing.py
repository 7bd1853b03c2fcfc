"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.llm.common import fresh, stage, table
from braidlake.llm.ranks import cell_of, cells, rank_within
from braidlake.llm.words import blocks, word_counts

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def with_word_count(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the number of words of the text (null: 0) as a long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.concat_arrays([pa.array(word_counts(x)) for _, x in blocks(b.column(text))] or [pa.array([], pa.int64())])
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, name])

    return docs.mapInArrow(count, schema)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target of each source: share of all sizes by weight, cap times the source's size at most.

    Weights repeat over the sources by code point, null last. The excess over a cap goes to the others
    by weight, until none is above: the capped ones are those with the smallest cap for their weight.
    """
    named = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(cap * n, weights[i % len(weights)], s) for i, (s, n) in enumerate(named)]
    left, weight, out = share * sum(n for _, n in sizes), sum(w for _, w, _ in rows), {}
    level = None
    for most, w, s in sorted(rows, key=lambda x: (x[0] / x[1], x[2] is None, x[2] or "")):
        if level is None and most / w > left / weight:
            level = left / weight
        out[s] = most if level is None else level * w
        left, weight = left - most, weight - w
    return out


def offset_of(source: str | None, seed: str = SEED) -> float:
    """The one random offset of a source, from 0 to below 1."""
    return int(hashlib.md5(f"{seed}|{'n' if source is None else 's' + source}".encode()).hexdigest()[:13], 16) / 16**13


def mix(docs: DataFrame, size: str, source: str = "source", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with source_size, target and copies as last columns; where docs has such a name, the new one takes _ before it.

    Within a source the documents stand by the magnitude of their size, so that the sample is spread over
    short and long ones. The prefix sum of expected copies (target / source size) is rank times that rate;
    a document gets a copy for each integer that the sum, shifted by the source's offset, crosses on it:
    the rate rounded down or up. Null sources are one source; documents of size 0 count as rows of their
    source and take 0 words; a source of size 0 has target 0 and no copies; an empty table gives no rows.
    Rows that are equal stay apart. The driver holds a total for each source, nothing for each document.
    """
    spark = docs.sparkSession
    names = fresh(docs.columns, "source_size", "target", "copies")
    key, coarse, cell, rank, rate, shift = fresh([*docs.columns, *names], "mix_key", "mix_bin", "mix_cell", "mix_rank", "mix_rate", "mix_shift")
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    totals = keyed.groupBy(key).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    named = [(r[0][1:] if r[0] != "n" else None, int(r["size"] or 0)) for r in totals]
    goal = targets(named, weights, share, cap)
    plan = [("n" if s is None else "s" + s, n, float(goal[s]), float(goal[s] / n) if n else 0.0, offset_of(s, seed)) for s, n in named]
    plan = spark.createDataFrame(plan, f"`{key}` string, `{names[0]}` long, `{names[1]}` double, `{rate}` double, `{shift}` double")
    keyed = keyed.withColumn(coarse, F.floor(F.log2(F.col(size) + 1.0) * 2).cast("int"))
    keyed = keyed.withColumn(cell, cell_of(F.col(id_col), cells(sum(r["n"] for r in totals))))
    ranked = rank_within(keyed, key, coarse, cell, [size, id_col], rank).join(plan, key)
    at = lambda x: F.floor(x * F.col(rate) + F.col(shift))
    copies = (at(F.col(rank) + 1.0) - at(F.col(rank).cast("double"))).cast("int")
    return ranked.select(*(F.col(f"`{c}`") for c in docs.columns), names[0], names[1], copies.alias(names[2]))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = stage(with_word_count(docs, "text", "size").drop("text"))
    return mix(sized, "size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), c AS (
  SELECT *, sum(most) OVER o - most AS before, sum(weight) OVER (ORDER BY most / weight DESC, source DESC NULLS FIRST) AS rest,
    (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
), cut AS (
  SELECT coalesce(arg_min((total - before) / rest, most / weight), 1e300) AS level FROM c WHERE most / weight > (total - before) / rest
), t AS (
  SELECT source, source_size, least(most, level * weight) AS target,
    ('0x' || substr(md5('mix-1|' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
  FROM c, cut
), r AS (
  SELECT d.doc_id, d.size, d.source, row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(d.size + 1) * 2)::INT,
    ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % greatest(1, ceil(sqrt((SELECT count(*) FROM d)) / 2)::BIGINT), d.size, d.doc_id) - 1 AS rank
  FROM d
)
SELECT r.doc_id, r.size, t.source_size, t.target,
  (r.size * (floor((r.rank + 1) * coalesce(t.target / nullif(t.source_size, 0), 0) + t.shift) - floor(r.rank * coalesce(t.target / nullif(t.source_size, 0), 0) + t.shift)))::BIGINT AS taken,
  (floor((r.rank + 1) * coalesce(t.target / nullif(t.source_size, 0), 0) + t.shift) - floor(r.rank * coalesce(t.target / nullif(t.source_size, 0), 0) + t.shift))::INT AS copies,
  r.source
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
