"""Order-dependent primitives that stay exact when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(x)`` puts a whole key into one task. Here a key with more
than ``limit`` rows is cut into consecutive slices of its order column (of fixed width for positions,
by quantiles of the key's own values for running totals), every slice is ranked on its own, and the
totals of the earlier slices of the key are added. Keys below the limit form a single slice and cost no
extra shuffle of the big side. The list of hot keys has at most rows/limit entries, which bounds what is
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskrank.session import cut

HOT_ROWS = 1 << 20
_BUCKETS = 1024
# slices by value of a hot key
SLICES = 256

# How a caller says which keys are hot: True = find them inside the plan, False = known to have none,
# a DataFrame = these keys (a superset does no harm).
Hot = DataFrame | bool


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows: at most rows/limit of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > limit).select(*keys)


def detect_hot(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> Hot:
    """Look once, before planning: False if no key is hot, else the written list of hot keys.

    A key that is hot in some part of ``df`` is hot in ``df``, so one look at the raw log serves every
    operator that works on a part of it and keeps their plans free of the slicing.
    """
    found = hot_keys(df, keys, limit)
    return cut(found, "hot_keys") if found.limit(1).count() else False


def _mark_hot(df: DataFrame, keys: Sequence[str], hot: Hot, slice_of: Column, limit: int):
    """(df with ``_slice``, the rows of hot keys with ``_slice``)."""
    found = hot_keys(df, keys, limit) if hot is True else hot
    on = [k for k in found.columns if k in keys]
    found = found.select(*on).distinct()
    marked = df.join(F.broadcast(found.withColumn("_hot", F.lit(True))), on, "left").withColumn(
        "_slice", F.when(F.col("_hot"), slice_of).otherwise(F.lit(0))
    )
    hot_rows = df.join(F.broadcast(found), on).withColumn("_slice", slice_of)
    return marked.drop("_hot"), hot_rows


def integer_slice(order: Column, width: int) -> Column:
    """Monotone slice number of an integer order column: at most ``width`` distinct values each."""
    return order - F.pmod(order, F.lit(width))


def _mark_by_value(df: DataFrame, keys: Sequence[str], hot: Hot, order: str, limit: int):
    """As ``_mark_hot``, with slices of about equal size: their limits are quantiles of the hot key's own rows.

    Nulls are in the first slice, NaN in the last. A hot key brings ``SLICES`` limits; they are approximate
    and written once, so that both results are cut alike.
    """
    found = hot_keys(df, keys, limit) if hot is True else hot
    on = [k for k in found.columns if k in keys]
    hot_rows = df.join(F.broadcast(found.select(*on).distinct()), on)
    value = F.col(order).cast("double")
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    limits = hot_rows.groupBy(*keys).agg(
        F.percentile_approx(F.when(~F.isnan(value), value), shares, F.lit(10 * SLICES)).alias("_limits")
    )

    limits = cut(limits, "limits")

    def sliced(rows: DataFrame) -> DataFrame:
        place = F.when(value.isNull(), -1).when(F.isnan(value), SLICES)
        place = place.otherwise(F.size(F.filter("_limits", lambda x: x < value)))
        rows = rows.join(F.broadcast(limits), list(keys), "left")
        return rows.withColumn("_slice", F.when(F.col("_limits").isNotNull(), place).otherwise(0)).drop("_limits")

    return sliced(df), sliced(hot_rows)


def positions(
    df: DataFrame, key: str = "user_id", pos: str = "pos", hot: Hot = True, limit: int = HOT_ROWS
) -> DataFrame:
    """Add ``seq`` (1-based, in ``pos`` order), ``n_rows`` and ``rn`` (1 = last row) per key.

    ``pos`` must be an integer that is unique within a key.
    """

    def number(rows: DataFrame, keys: list[str]) -> DataFrame:
        within = Window.partitionBy(*keys)
        return rows.withColumn("seq", F.row_number().over(within.orderBy(pos))).withColumn(
            "n_rows", F.count(F.lit(1)).over(within)
        )

    if hot is False:
        return number(df, [key]).withColumn("rn", F.col("n_rows") - F.col("seq") + 1)
    marked, hot_rows = _mark_hot(df, [key], hot, integer_slice(F.col(pos), limit), limit)
    sizes = hot_rows.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _slice_offsets(sizes, [key], ["_n"])
    return (
        number(marked, [key, "_slice"])
        .join(offsets, [key, "_slice"], "left")
        .withColumn("seq", F.col("seq") + F.coalesce("_n_earlier", F.lit(0)))
        .withColumn("n_rows", F.coalesce("_n_all", "n_rows"))
        .withColumn("rn", F.col("n_rows") - F.col("seq") + 1)
        .drop("_slice", "_n_earlier", "_n_all")
    )


def _slice_offsets(sizes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per slice: totals of the key's earlier slices and of all of them (a row per slice)."""
    by_key = Window.partitionBy(*keys)
    preceding = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(m).over(preceding), F.lit(0)).alias(f"{m}_earlier") for m in measures],
        *[F.sum(m).over(by_key).alias(f"{m}_all") for m in measures],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    hot: Hot = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """For each measure add ``<m>_before`` (rows of the key with a smaller ``order``) and ``<m>_total``.

    ``df`` has one row per (keys, order): collapse ties with ``groupBy`` first, which also
    pre-aggregates hot keys on the map side.
    """
    keys, measures = list(keys), list(measures)

    def total(rows: DataFrame, by: list[str]) -> DataFrame:
        within = Window.partitionBy(*by)
        preceding = within.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        before = {f"{m}_before": F.coalesce(F.sum(m).over(preceding), F.lit(0)) for m in measures}
        return rows.withColumns(before).withColumns({f"{m}_total": F.sum(m).over(within) for m in measures})

    if hot is False:
        return total(df, keys)
    marked, hot_rows = _mark_by_value(df, keys, hot, order, limit)
    sizes = hot_rows.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    out = total(marked, [*keys, "_slice"]).join(
        _slice_offsets(sizes, keys, measures), [*keys, "_slice"], "left"
    )
    out = out.withColumns(
        {f"{m}_before": F.col(f"{m}_before") + F.coalesce(f"{m}_earlier", F.lit(0)) for m in measures}
    ).withColumns({f"{m}_total": F.coalesce(f"{m}_all", f"{m}_total") for m in measures})
    return out.drop("_slice", *[f"{m}_{part}" for m in measures for part in ("earlier", "all")])


def neighbours(
    df: DataFrame,
    key: str,
    orders: Sequence[str],
    tie: str,
    own: Sequence[str],
    hot: Hot = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """For the k-th of ``orders`` add ``_prev<k>`` and ``_next<k>`` (structs of ``own`` of the neighbouring rows; null at
    the ends) and ``_place<k>`` (from 1).

    Rows of a key stand in the order of a double column (no nulls), then of ``tie``. The slices of a hot key are
    ordered on their own; each slice's first and last row and its length, one row per slice, give the neighbours
    across slices and the shift of the places.
    """

    def found(k: int, by: list[str]) -> dict[str, Column]:
        within = Window.partitionBy(*by).orderBy(orders[k], tie)
        row = F.struct(*own)
        return {f"_prev{k}": F.lag(row).over(within), f"_next{k}": F.lead(row).over(within), f"_place{k}": F.row_number().over(within)}

    if hot is False:
        return df.withColumns({name: c for k in range(len(orders)) for name, c in found(k, [key]).items()})
    for k, order in enumerate(orders):
        marked, hot_rows = _mark_by_value(df, [key], hot, order, limit)
        place = F.struct(order, tie)
        ends = hot_rows.groupBy(key, "_slice").agg(
            F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*own), place).alias("_first"), F.max_by(F.struct(*own), place).alias("_last")
        )
        slices = Window.partitionBy(key).orderBy("_slice")
        ends = ends.select(
            key,
            "_slice",
            (F.sum("_n").over(slices) - F.col("_n")).alias("_earlier"),
            F.lag("_last").over(slices).alias("_before"),
            F.lead("_first").over(slices).alias("_after"),
        )
        # a row without a neighbour in its slice is the slice's first or last
        df = (
            marked.withColumns(found(k, [key, "_slice"]))
            .join(ends, [key, "_slice"], "left")
            .withColumns(
                {
                    f"_prev{k}": F.coalesce(f"_prev{k}", "_before"),
                    f"_next{k}": F.coalesce(f"_next{k}", "_after"),
                    f"_place{k}": F.col(f"_place{k}") + F.coalesce("_earlier", F.lit(0)),
                }
            )
            .drop("_slice", "_earlier", "_before", "_after")
        )
    return df


def nearest_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Sequence[int]],
    exact: bool = True,
    hot: Hot = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Quantiles without interpolation: the sorted non-null value at index floor((n-1)*q + 0.5).

    ``columns`` maps a column to percents; the output columns are ``<column>_q<percent>``.
    ``exact=False`` uses Spark's mergeable sketch, which needs one aggregation and no ordering.
    """
    keys = list(keys)
    if not exact:
        return df.groupBy(*keys).agg(
            *[
                F.percentile_approx(c, F.lit(p / 100.0), 10000).alias(f"{c}_q{p}")
                for c, percents in columns.items()
                for p in percents
            ]
        )
    names = list(columns)
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)])
        ).alias("_mv"),
    ).select(*keys, F.col("_mv.m").alias("_m"), F.col("_mv.v").alias("_v"))
    counts = long.filter(F.col("_v").isNotNull()).groupBy(*keys, "_m", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    # Key columns may hold null groups; a null-safe stand-in keeps them through the joins.
    shadow = [f"_k{i}" for i in range(len(keys))]
    for k, s in zip(keys, shadow):
        counts = counts.withColumn(s, F.struct(F.col(k)))
    if isinstance(hot, DataFrame):
        hot = hot.select(*[F.struct(F.col(k)).alias(s) for k, s in zip(keys, shadow) if k in hot.columns])
    ranked = running_totals(counts.drop(*keys), [*shadow, "_m"], "_v", ["_c"], hot, limit)
    picks = []
    for i, c in enumerate(names):
        for p in columns[c]:
            index = F.floor((F.col("_c_total") - 1) * F.lit(p / 100.0) + 0.5)
            hit = (F.col("_m") == i) & (F.col("_c_before") <= index) & (index < F.col("_c_before") + F.col("_c"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"{c}_q{p}"))
    out = ranked.groupBy(*shadow).agg(*picks)
    return out.select(
        *[F.col(s)[k].alias(k) for k, s in zip(keys, shadow)],
        *[f"{c}_q{p}" for c in names for p in columns[c]],
    )


def _counts_and_tops(df: DataFrame, key: str, value: str, names: dict[str, Column | None]) -> tuple[DataFrame, DataFrame]:
    """Long counts (_key, value, name, _c) of the values, and their maximum per (_key, name); zero where all are null."""
    known = F.col(value).isNotNull()
    counts = df.groupBy(key, value).agg(
        *[
            F.count(F.when(known if p is None else known & p, F.lit(1))).alias(f"_c{k}")
            for k, p in enumerate(names.values())
        ]
    )
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_c{k}").alias("c")) for k, name in enumerate(names)])
    # a null key is a key of its own
    long = counts.select(F.struct(key).alias("_key"), F.col(value), F.explode(each).alias("_n"))
    long = long.select("_key", value, "_n.name", F.col("_n.c").alias("_c"))
    return long.filter(F.col("_c") > 0), long.groupBy("_key", "name").agg(F.max("_c").alias("_c"))


def mode_rows(df: DataFrame, key: str, value: str, names: dict[str, Column | None]) -> DataFrame:
    """All most frequent non-null values per key, a row each: (key, name, value).

    ``names`` maps a name to the predicate its rows must satisfy (None: all rows). Counts per (key, value) are made
    first. The maximum per key is an aggregation with partial maxima in every task, and the counts meet it in a
    join, whose skewed side is the counts': so the values of a hot key spread over many tasks and none is held as
    an array.
    """
    long, top = _counts_and_tops(df, key, value, names)
    return long.join(top, ["_key", "name", "_c"]).select(F.col("_key")[key].alias(key), "name", value)


def tied_modes(df: DataFrame, key: str, value: str, names: dict[str, Column | None]) -> DataFrame:
    """``mode_rows`` as sorted arrays, a column per name; a key without modes has empty arrays."""
    long, top = _counts_and_tops(df, key, value, names)
    lists = long.join(top, ["_key", "name", "_c"]).groupBy("_key").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("name") == name, F.col(value)))).alias(name) for name in names]
    )
    none = F.array().cast(lists.schema[next(iter(names))].dataType)
    return top.select("_key").distinct().join(lists, "_key", "left").select(
        F.col("_key")[key].alias(key), *[F.coalesce(name, none).alias(name) for name in names]
    )


def dense_index(ids: DataFrame, column: str, name: str) -> DataFrame:
    """Number the distinct values of ``column`` 0..n-1 without a global sort or a driver-side list.

    Values are hashed into a fixed number of buckets, numbered inside each, and shifted by the sizes
    of the earlier buckets (a table with one row per bucket).
    """
    distinct = (
        ids.select(column)
        .filter(F.col(column).isNotNull())
        .distinct()
        .withColumn("_b", F.pmod(F.xxhash64(column), F.lit(_BUCKETS)).cast("int"))
    )
    sizes = distinct.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket: _BUCKETS rows at most
    offsets = sizes.select(
        "_b",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(column))
    return (
        distinct.withColumn("_r", rank)
        .join(F.broadcast(offsets), "_b")
        .select(column, (F.col("_before") + F.col("_r") - 1).cast("int").alias(name))
    )
