"""Truncated SVD of the user-item matrix by randomised block Krylov iteration (Musco and Musco, 2015).

Every pass multiplies the sparse matrix with a thin one: tasks hold a cell of a bounded number of entries and
exchange only thin vectors, each of which goes to the cells that have entries for it. The driver sees nothing larger than the square of the basis width,
(rank + oversample) * (passes + 1), whatever the number of users and items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.models.als import indexed
from duskrank.models.blocks import ROWS_PER_CELL, Cells, balanced_cells, restore_ids, stack
from duskrank.session import cut


def _partial_products(entries: pd.DataFrame, thin: pd.DataFrame, out: str, by: str) -> pd.DataFrame:
    """Rows of (sparse block) x (thin block): weighted sums of ``thin`` vectors per ``out`` number."""
    if entries.empty or thin.empty:
        return pd.DataFrame({out: pd.Series(dtype="int32"), "features": pd.Series(dtype=object)})
    order = np.argsort(thin[by].to_numpy())
    numbers, matrix = thin[by].to_numpy()[order], stack(thin["features"])[order]
    at = np.minimum(np.searchsorted(numbers, entries[by].to_numpy()), len(numbers) - 1)
    known = numbers[at] == entries[by].to_numpy()
    targets, slot = np.unique(entries[out].to_numpy()[known], return_inverse=True)
    total = np.zeros((len(targets), matrix.shape[1]))
    weights = entries["weight"].to_numpy()[known]
    rows = at[known]
    for start in range(0, len(rows), 100_000):
        part = slice(start, start + 100_000)
        np.add.at(total, slot[part], matrix[rows[part]] * weights[part, None])
    return pd.DataFrame({out: targets.astype("int32"), "features": list(total)})


@dataclass(frozen=True)
class Grid:
    """The matrix in cells, and which users and items each cell has entries for (written once)."""

    cells: Cells
    users: DataFrame  # q, c, u
    items: DataFrame  # q, c, i

    def sent(self, thin: DataFrame, by: str) -> DataFrame:
        """The vectors of ``thin`` with the cells they go to: one copy per (vector, cell) with an entry."""
        return (self.items if by == "i" else self.users).join(thin, by)


def grid(entries: DataFrame, block: int, rows_per_cell: int) -> Grid:
    cells = balanced_cells(entries, block, rows_per_cell)
    return Grid(cells, cut(cells.members, "svd_users_of"), cut(cells.entries.select("q", "c", "i").distinct(), "svd_items_of"))


def _multiply(matrix: Grid, thin: DataFrame, by: str) -> DataFrame:
    """Sparse matrix times ``thin`` (keyed by item for ``by='i'``), or its transpose (``by='u'``)."""
    out = "u" if by == "i" else "i"
    partial = (
        matrix.cells.entries.groupBy("q", "c")
        .cogroup(matrix.sent(thin, by).groupBy("q", "c"))
        .applyInPandas(lambda e, t: _partial_products(e, t, out, by), f"{out} int, features array<double>")
    )
    return partial.groupBy(out).agg(
        vector_to_array(Summarizer.sum(array_to_vector("features"))).alias("features")
    )


def _gram(thin: DataFrame, width: int) -> np.ndarray:
    """Transpose(thin) x thin: a width x width matrix summed over partitions."""

    def part(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = stack(batch["features"])
            if m.size:
                total += m.T @ m
        yield pd.DataFrame({"k": np.arange(width * width), "v": total.ravel()})

    rows = (
        thin.select("features").mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    )
    out = np.zeros(width * width)
    for r in rows:
        out[r["k"]] = r["v"]
    return out.reshape(width, width)


def _apply(thin: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """thin x matrix, batch by batch."""

    def part(batches):
        for batch in batches:
            m = stack(batch["features"])
            if m.size:
                yield pd.DataFrame({key: batch[key].to_numpy(), "features": list(m @ matrix)})

    return thin.select(key, "features").mapInPandas(part, f"{key} int, features array<double>")


def _orthonormal(thin: DataFrame, key: str, width: int) -> DataFrame:
    """Orthonormal basis of the columns: thin x V / sqrt(eigenvalues), vanishing directions zeroed."""
    values, vectors = np.linalg.eigh(_gram(thin, width))
    keep = values > max(values.max(), 0.0) * 1e-12
    scale = np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    return _apply(thin, key, vectors * scale)


def fit_svd(
    train: DataFrame,
    n_factors: int = 10,
    oversample: int = 10,
    passes: int = 3,
    seed: int = 42,
    block: int = 65536,
    rows_per_cell: int = ROWS_PER_CELL,
) -> dict[str, DataFrame]:
    """Factor tables with user = U and item = V * sigma, so that their dot is the rank-k value.

    More ``passes`` sharpen a slowly falling spectrum; the basis grows by one block with each.
    """
    entries, users_of, items_of, _ = indexed(train)
    matrix = grid(entries, block, rows_per_cell)
    width = min(n_factors + oversample, items_of.count(), users_of.count())
    rank = min(n_factors, width)
    def uniform(k: Column) -> Column:
        return (F.pmod(F.xxhash64(F.col("i"), F.lit(seed), k), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

    # standard normals, each from two hashed uniforms
    normals = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda k: F.sqrt(-2 * F.log(uniform(2 * k))) * F.cos(2 * np.pi * uniform(2 * k + 1)),
    )
    start = items_of.select("i", normals.alias("features"))
    newest = cut(_orthonormal(cut(start, "svd_start"), "i", width), "svd_items")
    basis, columns = newest, width
    for _ in range(passes):
        users = _multiply(matrix, newest, "i")
        products = cut(_multiply(matrix, cut(users, "svd_users"), "u"), "svd_items")
        newest = cut(_orthonormal(products, "i", width), "svd_items")
        basis = basis.join(newest.withColumnRenamed("features", "_new"), "i").select(
            "i", F.concat("features", "_new").alias("features")
        )
        columns += width
    basis = cut(_orthonormal(cut(basis, "svd_basis"), "i", columns), "svd_basis")
    image = cut(_multiply(matrix, basis, "i"), "svd_users")
    # image = X Q; the eigenvectors of its Gram matrix rotate Q onto the right singular vectors
    values, rotation = np.linalg.eigh(_gram(image, columns))
    top = np.argsort(values)[::-1][:rank]
    sigma = np.sqrt(np.maximum(values[top], 0.0))
    inverse = np.divide(1.0, sigma, out=np.zeros_like(sigma), where=sigma > 1e-9 * max(sigma.max(), 1e-300))
    return {
        "users": restore_ids(_apply(image, "u", rotation[:, top] * inverse), users_of, "user_id", "u"),
        "items": restore_ids(_apply(basis, "i", rotation[:, top] * sigma), items_of, "item_id", "i"),
    }
