"""Gapless ranks within keys of which one may hold a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.common import fresh


def cells(rows: int) -> int:
    """Cells for so many rows: about the root, so that neither the rows of a cell nor the cells of a key grow in proportion."""
    return max(1, math.ceil(math.sqrt(rows) / 2))


def cell_of(col: Column, n: int) -> Column:
    """0 to n-1, by the first 32 bits of the md5 of the value as text (null: as empty)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def rank_within(df: DataFrame, key: str, coarse: str, cell: str, order: list[str], name: str) -> DataFrame:
    """df with a column `name`: the row's rank from 0 among the rows with its key, by coarse, cell and then order.

    key, coarse and cell are columns without nulls. Only counts leave their cell: the rows of a cell are
    ranked in one place, cells are summed within (key, coarse) and these within key, so no task holds a key.
    """
    n, in_cell, in_coarse, r = fresh(df.columns, "n_rows", "before_cell", "before_coarse", "in_cell_rank")
    counts = df.groupBy(key, coarse, cell).agg(F.count(F.lit(1)).alias(n))
    by_cell = counts.withColumn(in_cell, F.sum(n).over(Window.partitionBy(key, coarse).orderBy(cell)) - F.col(n))
    by_coarse = counts.groupBy(key, coarse).agg(F.sum(n).alias(n))
    by_coarse = by_coarse.withColumn(in_coarse, F.sum(n).over(Window.partitionBy(key).orderBy(coarse)) - F.col(n))
    before = by_cell.drop(n).join(by_coarse.drop(n), [key, coarse])
    before = before.select(key, coarse, cell, (F.col(in_cell) + F.col(in_coarse)).alias(in_cell))
    ranked = df.withColumn(r, F.row_number().over(Window.partitionBy(key, coarse, cell).orderBy(*order)))
    out = ranked.join(before, [key, coarse, cell])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(in_cell) + F.col(r) - 1).cast("long").alias(name))
