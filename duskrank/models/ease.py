"""Item-item linear model: B = -P / diag(P) with P = inverse(X'X + lambda I), diagonal 0.

The Gram matrix is summed inside tasks (item pairs never travel one by one, only sums do), inverted as a
table of square blocks, and scored with one row per (pair, block of the history).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import dense_index
from duskrank.operators.split import keep_frequent_items
from duskrank.session import cut

_PAIRS_AT_ONCE = 2_000_000
_SUMS_HELD = 4_000_000
# items of a user that pair up in one task
USER_CHUNK = 2048


def _sum_by_code(codes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(values), minlength=len(code))


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """First row of every cell (u, a, b); rows of a cell stand together."""
    keys = [rows[c].to_numpy() for c in ("u", "a", "b")]
    return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def _cell_products(rows: pd.DataFrame, n_items: int):
    """Codes j * n + i (j <= i) and weight products of the pairs of every cell, in bounded portions.

    In a cell of one chunk (a = b) a row pairs with itself and the rows behind it, in a cell of two chunks the rows
    of the first (which stand first) pair with those of the second.
    """
    items, weights = rows["i"].to_numpy().astype("int64"), rows["weight"].to_numpy()
    second, across = rows["second"].to_numpy(), rows["a"].to_numpy() != rows["b"].to_numpy()
    first = _starts(rows)
    length = np.diff(np.r_[first, len(rows)])
    end = np.repeat(first + length, length)
    firsts = np.repeat(np.add.reduceat((~second).astype("int64"), first) + first, length)
    begin = np.where(across, np.where(second, end, firsts), np.arange(len(rows)))
    ahead = end - begin
    ends = np.cumsum(ahead)
    start = 0
    while start < len(rows):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PAIRS_AT_ONCE, side="right")))
        count = ahead[start:stop]
        left = np.repeat(np.arange(start, stop), count)
        right = np.repeat(begin[start:stop], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if len(left):
            a, b = items[left], items[right]
            yield np.minimum(a, b) * n_items + np.maximum(a, b), weights[left] * weights[right]
        start = stop


def _gram_of_partition(n_items: int):
    def run(batches):
        held_codes: list[np.ndarray] = []
        held_values: list[np.ndarray] = []
        held = 0
        rest: pd.DataFrame | None = None

        def emit(codes, values):
            code, value = _sum_by_code(codes, values)
            return pd.DataFrame({"j": (code // n_items).astype("int32"), "i": (code % n_items).astype("int32"), "g": value})

        def fold(rows: pd.DataFrame):
            nonlocal held, held_codes, held_values
            for code, value in _cell_products(rows, n_items):
                c, v = _sum_by_code([code], [value])
                held_codes.append(c)
                held_values.append(v)
                held += len(c)
                if held > _SUMS_HELD:
                    c, v = _sum_by_code(held_codes, held_values)
                    held_codes, held_values, held = [c], [v], len(c)
                    if held > _SUMS_HELD // 2:
                        yield emit(held_codes, held_values)
                        held_codes, held_values, held = [], [], 0

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows.empty:
                continue
            # the last cell of a batch may go on in the next one
            cut_at = int(_starts(rows)[-1])
            rest = rows.iloc[cut_at:]
            if cut_at:
                yield from fold(rows.iloc[:cut_at])
        if rest is not None and len(rest):
            yield from fold(rest)
        if held_codes:
            yield emit(held_codes, held_values)

    return run


def user_cells(entries: DataFrame, chunk: int = USER_CHUNK) -> DataFrame:
    """The entries (u, i, weight) in cells (u, a, b) of pairs of a user's chunks, ``second`` marking rows of chunk b.

    A user's items are hashed into chunks of about ``chunk``; nearly all users have one chunk, one cell and no
    copies. A user of n chunks has a row in n cells, so its pairs spread over n(n+1)/2 groups of bounded size.
    """
    counts = entries.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk)
    chunks = counts.select("u", F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks"))
    many = F.coalesce("_chunks", F.lit(1))
    placed = entries.select("u", "i", "weight").join(chunks, "u", "left").withColumn("_own", F.pmod(F.xxhash64("i"), many).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), many - 1)))
    return met.select(
        "u", "i", "weight",
        F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), (F.col("_own") > F.col("_other")).alias("second"),
    )


def gram(entries: DataFrame, n_items: int, chunk: int = USER_CHUNK) -> DataFrame:
    """Upper triangle (j <= i) of X'X from one row per (u, i).

    Each task sums its cells' products before anything is shuffled; a very active user's pairs are spread over
    many tasks, and the products are formed in portions of fixed size.
    """
    key = ["u", "a", "b"]
    by_cell = user_cells(entries, chunk).repartition(*key).sortWithinPartitions(*key, "second", "i")
    sums = by_cell.mapInPandas(_gram_of_partition(n_items), "j int, i int, g double")
    return sums.groupBy("j", "i").agg(F.sum("g").alias("g"))


def gram_table(train: DataFrame, max_items: int | None = None) -> DataFrame:
    """Full symmetric Gram matrix (item_j, item_i, g), zero sums left out."""
    entries, items, n = _entries(train, max_items)
    upper = gram(entries, n)
    lower = upper.filter("j <> i").select(F.col("i").alias("j"), F.col("j").alias("i"), "g")
    full = upper.unionByName(lower).filter("g <> 0")
    return (
        full.join(items.withColumnsRenamed({"i": "j", "item_id": "item_j"}), "j")
        .join(items.withColumnRenamed("item_id", "item_i"), "i")
        .select("item_j", "item_i", "g")
    )


def _entries(train: DataFrame, max_items: int | None) -> tuple[DataFrame, DataFrame, int]:
    kept = train.dropna(subset=["user_id", "item_id"])
    kept = kept if max_items is None else keep_frequent_items(kept, max_items)
    sums = cut(kept.groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight")), "ease_weights")
    items = cut(dense_index(sums, "item_id", "i"), "ease_items")
    entries = sums.join(items, "item_id").select(F.col("user_id").alias("u"), "i", "weight")
    return entries, items, items.count()


def _dense_blocks(upper: DataFrame, n: int, size: int, regularization: float) -> DataFrame:
    """Square blocks (bi, bj, m) of X'X + lambda I, padded with an identity; m is row-major."""

    def block_of(column: str) -> Column:
        return F.floor(F.col(column) / size).cast("int")

    lower = upper.filter("j <> i").select(F.col("i").alias("j"), F.col("j").alias("i"), "g")
    cells = upper.unionByName(lower).select(
        block_of("j").alias("bi"), block_of("i").alias("bj"), (F.col("j") % size).alias("r"), (F.col("i") % size).alias("c"), "g"
    )
    count = -(-n // size)
    grid = upper.sparkSession.range(count * count).select(
        F.floor(F.col("id") / count).cast("int").alias("bi"),
        (F.col("id") % count).cast("int").alias("bj"),
    )

    def fill(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[0]), int(key[1])
        m = np.zeros((size, size))
        m[right["r"].to_numpy(), right["c"].to_numpy()] = right["g"].to_numpy()
        if bi == bj:
            real = np.arange(size) + bi * size < n
            m[np.diag_indices(size)] += np.where(real, regularization, 1.0)
        return pd.DataFrame({"bi": [bi], "bj": [bj], "m": [m.ravel()]})

    return (
        grid.groupBy("bi", "bj")
        .cogroup(cells.groupBy("bi", "bj"))
        .applyInPandas(fill, "bi int, bj int, m array<double>")
    )


def invert_blocks(blocks: DataFrame, count: int, size: int) -> DataFrame:
    """Inverse of a symmetric positive definite matrix stored as blocks, by block Gauss-Jordan steps.

    Step k scales the pivot row by the inverse of the pivot block, then joins every block with one block
    of that row and one of the pivot column: a task holds three blocks at a time, and the table is
    written after every step.
    """

    def matrix(values) -> np.ndarray:
        return values.reshape(size, size)

    def inverted(batches):
        for batch in batches:
            yield pd.DataFrame({"bi": batch["bi"], "p": [np.linalg.inv(matrix(m)).ravel() for m in batch["m"]]})

    def scaled(k: int):
        def run(batches):
            for batch in batches:
                rows = batch[["bj", "m", "p"]].itertuples(index=False)
                out = [(bj, p if bj == k else (matrix(p) @ matrix(m)).ravel()) for bj, m, p in rows]
                yield pd.DataFrame(out, columns=["bj", "row"])

        return run

    def updated(k: int):
        def run(batches):
            for batch in batches:
                out = []
                for bi, bj, own, col, row in batch[["bi", "bj", "m", "col", "row"]].itertuples(index=False):
                    if bi == k:
                        m = row
                    elif bj == k:
                        m = -(matrix(own) @ matrix(row)).ravel()
                    else:
                        m = own - (matrix(col) @ matrix(row)).ravel()
                    out.append((bi, bj, m))
                yield pd.DataFrame(out, columns=["bi", "bj", "m"])

        return run

    for k in range(count):
        pivot = blocks.filter((F.col("bi") == k) & (F.col("bj") == k)).select("bi", "m")
        row = blocks.filter(F.col("bi") == k).join(pivot.mapInPandas(inverted, "bi int, p array<double>"), "bi")
        row = row.select("bj", "m", "p").mapInPandas(scaled(k), "bj int, row array<double>")
        column = blocks.filter(F.col("bj") == k).select("bi", F.col("m").alias("col"))
        joined = blocks.join(column, "bi").join(row, "bj")
        blocks = cut(joined.mapInPandas(updated(k), "bi int, bj int, m array<double>"), "ease_blocks")
    return blocks


def fit_ease(
    train: DataFrame,
    regularization: float = 500.0,
    max_items: int | None = None,
    block: int = 1024,
) -> dict[str, DataFrame]:
    """``items``: number of every kept item; ``columns``: per candidate and history block its weights.

    ``columns`` has one row (i, jb, b) per candidate item number and block of history items; ``b`` holds
    the weights of the block's items, in order.
    """
    entries, items, n = _entries(train, max_items)
    size = max(1, min(block, n))
    count = -(-n // size)
    blocks = cut(_dense_blocks(gram(entries, n), n, size, regularization), "ease_blocks")
    inverse = invert_blocks(blocks, count, size)

    def diagonal(batches):
        for batch in batches:
            yield pd.DataFrame({"bj": batch["bi"], "d": [np.diag(m.reshape(size, size)).copy() for m in batch["m"]]})

    diag = inverse.filter("bi = bj").mapInPandas(diagonal, "bj int, d array<double>")

    def columns(batches):
        for batch in batches:
            for bi, bj, m, d in batch[["bi", "bj", "m", "d"]].itertuples(index=False):
                b = -m.reshape(size, size) / d[None, :]
                if bi == bj:
                    np.fill_diagonal(b, 0.0)
                candidates = np.arange(size) + bj * size
                keep = candidates < n
                yield pd.DataFrame(
                    {
                        "i": candidates[keep].astype("int32"),
                        "jb": np.full(keep.sum(), bi, dtype="int32"),
                        "b": list(b.T[keep].astype("float32")),
                    }
                )

    weights = inverse.join(diag, "bj").mapInPandas(columns, "i int, jb int, b array<float>")
    return {"items": items.withColumn("block", F.lit(size)), "columns": cut(weights, "ease_columns")}


def weight_table(model: dict[str, DataFrame]) -> DataFrame:
    """The matrix as rows (item_j = history item, item_i = candidate, b)."""
    items = model["items"]
    cells = (
        model["columns"]
        .select("i", "jb", F.posexplode("b").alias("c", "b"))
        .join(items.select("i", F.col("item_id").alias("item_i"), "block"), "i")
        .withColumn("j", F.col("jb") * F.col("block") + F.col("c"))
    )
    return cells.join(items.select(F.col("i").alias("j"), F.col("item_id").alias("item_j")), "j").select(
        "item_j", "item_i", F.col("b").cast("double").alias("b")
    )


def score_ease(
    pairs: DataFrame,
    history: DataFrame,
    model: dict[str, DataFrame],
    name: str = "predict",
    cold: float | None = -1.0,
) -> DataFrame:
    """Sum over the user's history of the weight from history item to candidate; weights of the history ignored.

    The history is kept as one short array per (user, block), so a candidate meets the history in at
    most as many rows as there are blocks, never item by item. Repeated history items count repeatedly.
    """
    items = model["items"]
    seen = (
        history.groupBy("user_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(items, "item_id")
        .groupBy("user_id", F.floor(F.col("i") / F.col("block")).cast("int").alias("jb"))
        .agg(F.collect_list(F.struct((F.col("i") % F.col("block")).cast("int").alias("c"), "n")).alias("_seen"))
    )
    total = F.aggregate(
        "_seen", F.lit(0.0), lambda acc, s: acc + F.get("b", s["c"]).cast("double") * s["n"]
    )
    hot = (
        pairs.select("user_id", "item_id")
        .join(items.select("item_id", "i"), "item_id")
        .join(seen, "user_id")
        .join(model["columns"], ["i", "jb"])
        .groupBy("user_id", "item_id")
        .agg(F.sum(total).alias("_score"))
    )
    scored = pairs.select("user_id", "item_id").join(hot, ["user_id", "item_id"], "left")
    return scored.select(
        "user_id",
        "item_id",
        F.coalesce("_score", F.lit(cold).cast("double")).alias(name),
        F.col("_score").isNull().alias("is_cold"),
    )
