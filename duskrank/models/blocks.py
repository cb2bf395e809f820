"""Shared layout of the matrix models: cells of a bounded number of entries.

The weighted set is a sparse matrix with one entry per (user, item). Users and items are numbered densely, items
are cut into blocks of fixed size, and a block's entries into cells of bounded size, however active a user is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskrank.session import cut

# entries of one training cell: a cell is one task's input
ROWS_PER_CELL = 1 << 22
_SLICES = 1024


@dataclass(frozen=True)
class Cells:
    entries: DataFrame  # q (item block), c (cell of the block), u, i, weight
    members: DataFrame  # q, c, u: which users a cell needs
    cells: DataFrame  # q, c


def balanced_cells(entries: DataFrame, block: int, rows_per_cell: int = ROWS_PER_CELL) -> Cells:
    """Cut the entries (u, i, weight) of every item block into cells of at most about ``rows_per_cell`` entries.

    A user's entries in a block stay together unless they are more than a quarter of a cell; then they are
    cut into parts by a hash, and the user has a copy in several cells. Parts are put into cells in the order of
    their hashes by a running total (inside hash slices, shifted by the totals of the earlier slices), so cells
    depend on the entries and ``rows_per_cell`` only and no cell follows a user's or an item's popularity.
    """
    part_rows = max(1, rows_per_cell // 4)
    placed = entries.withColumn("q", F.floor(F.col("i") / block).cast("int"))
    counts = placed.groupBy("q", "u").agg(F.count(F.lit(1)).alias("_n"))
    # half-full parts on average, so that hardly any is above a quarter of a cell
    wide = counts.filter(F.col("_n") > part_rows).select("q", "u", F.ceil(2 * F.col("_n") / part_rows).alias("_parts"))
    share = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("i", "u"), F.col("_parts")))
    placed = cut(placed.join(wide, ["q", "u"], "left").withColumn("s", share.cast("int")).drop("_parts"), "placed")

    order = F.xxhash64("u", "s")
    parts = placed.groupBy("q", "u", "s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_order", order)
    parts = parts.withColumn("_slice", F.pmod(F.shiftright("_order", 40), F.lit(_SLICES)))
    sums = parts.groupBy("q", "_slice").agg(F.sum("_n").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("q").orderBy("_slice")) - F.col("_sum")
    sums = sums.select("q", "_slice", earlier.alias("_earlier"))
    inside = Window.partitionBy("q", "_slice").orderBy("_order", "u", "s").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_n").over(inside) - F.col("_n") + F.col("_earlier")
    room = max(1, rows_per_cell - part_rows)
    parts = parts.join(sums, ["q", "_slice"]).select("q", "u", "s", F.floor(before / room).alias("c"))
    parts = cut(parts, "parts")
    filled = cut(placed.join(parts, ["q", "u", "s"]).select("q", "c", "u", "i", "weight"), "entries")
    return Cells(filled, parts.select("q", "c", "u").distinct(), parts.select("q", "c").distinct())


def restore_ids(vectors: DataFrame, index: DataFrame, key: str, number: str) -> DataFrame:
    """(number, features, bias) -> (id, features, bias) with the original ids."""
    rest = [c for c in vectors.columns if c != number]
    return vectors.join(index, number).select(F.col(key).alias("id"), *rest)


def stack(column: pd.Series) -> np.ndarray:
    """Array column of a pandas frame as one matrix."""
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 0))
