"""Sums in a table of fixed size over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.words import blocks

SLICES = 64


def _pack(total: np.ndarray) -> bytes:
    at = np.flatnonzero(total).astype(np.uint32)
    return at.tobytes() + total[at].astype(np.int64).tobytes()


def _unpack(data: bytes, into: np.ndarray) -> None:
    n = len(data) // 12
    into[np.frombuffer(data, np.uint32, n)] += np.frombuffer(data[4 * n :], np.int64)


def counted(docs: DataFrame, text: str, of, bits: int) -> np.ndarray:
    """Sums of 2^bits slots over all rows; of(part of a batch) gives (slots, whole amounts), which add up alike in any order.

    Tasks give the slots they have, in slices; slices add up in two steps, so that no task reads those
    of all others. The driver gets 2^bits sums at most.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots, amounts, held = np.zeros(size, np.int64), [], [], 0
        for batch in batches:
            for start, part in blocks(batch.column(text), 1 << 18):
                s, x = of(batch.slice(start, len(part)))
                slots.append(s)
                amounts.append(x)
                held += len(s)
                if held > 1 << 20:
                    np.add.at(total, np.concatenate(slots), np.concatenate(amounts))
                    slots, amounts, held = [], [], 0
        if slots:
            np.add.at(total, np.concatenate(slots), np.concatenate(amounts))
        kept = [(i, _pack(x)) for i, x in enumerate(np.split(total, SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([x for _, x in kept], pa.binary())], names=["slice", "sums"])

    def add(key, group):
        total = np.zeros(size // SLICES, np.int64)
        for x in group["sums"]:
            _unpack(x.as_py(), total)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([_pack(total)], pa.binary())})

    parts = docs.mapInArrow(count, "slice int, sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = parts.groupBy("slice", "part").applyInArrow(add, "slice int, sums binary")
    out = np.zeros(size, np.int64)
    for r in some.groupBy("slice").applyInArrow(add, "slice int, sums binary").collect():
        _unpack(r["sums"], out[r["slice"] * (size // SLICES) : (r["slice"] + 1) * (size // SLICES)])
    return out
