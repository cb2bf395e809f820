"""Regression trees on rows that are binned once, grown level by level from gradient sums.

Bin limits are quantiles of every feature, computed once; a row then carries one byte per feature. A level of
a tree is one pass over the rows: a task finds each row's node by the splits chosen so far and adds its
gradients up by (node, feature, bin). The sums of a feature meet in one task, which scans them for the
feature's best split of every node; the driver picks among the features. What travels depends on features, bins
and nodes, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BINS = 255
# points of a feature's summary
_POINTS = 4096


@dataclass(frozen=True)
class Tree:
    """A binary tree as a heap: node k has the children 2k+1 and 2k+2; a leaf has feature -1.

    A row goes left if its value is at most the threshold (its bin at most ``bins[k]``); NaN goes right.
    """

    feature: np.ndarray
    bins: np.ndarray
    threshold: np.ndarray
    depth: int

    def leaf_of(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype="int64"), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            right = ~(x[rows, np.maximum(f, 0)] <= limits[node])
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return node

    def leaf_of_values(self, x: np.ndarray) -> np.ndarray:
        return self.leaf_of(x, self.threshold)

    def leaf_of_bins(self, x: np.ndarray) -> np.ndarray:
        return self.leaf_of(x, self.bins)

    def expression(self, bins: str, values: Sequence[float], node: int = 0) -> str:
        """SQL text of the leaf's value for the bytes of a row's bins."""
        f = int(self.feature[node])
        if f < 0:
            return f"{float(values[node])!r}D"
        left, right = (self.expression(bins, values, 2 * node + k) for k in (1, 2))
        return f"CASE WHEN substring({bins}, {f + 1}, 1) <= X'{int(self.bins[node]):02X}' THEN {left} ELSE {right} END"


def _reduced(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``_POINTS`` weighted values that stand for the given ones (NaN left out); exact if they are few."""
    known = ~np.isnan(values)
    values, weights = values[known], weights[known]
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) > _POINTS:
        up_to = np.cumsum(weights)
        part = up_to[-1] / _POINTS
        at = np.searchsorted(up_to, (np.arange(_POINTS) + 0.5) * part)
        values, weights = values[at], np.full(_POINTS, part)
    return values, weights


class _Summary:
    """A mergeable summary of one feature: parts of equal rank are merged two by two, so errors add up per rank only."""

    def __init__(self):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, values: np.ndarray, weights: np.ndarray) -> None:
        rank, part = 0, _reduced(values, weights)
        while rank in self.parts:
            held = self.parts.pop(rank)
            part = _reduced(np.concatenate([held[0], part[0]]), np.concatenate([held[1], part[1]]))
            rank += 1
        self.parts[rank] = part

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return _reduced(*(np.concatenate(c) for c in zip(*self.parts.values(), strict=True)))


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[_Summary] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        found = found or [_Summary() for _ in range(x.shape[1])]
        for f, summary in enumerate(found):
            summary.add(x[:, f], np.ones(len(x)))
    if found:
        rows = [s.whole() for s in found]
        columns = [pa.array(range(len(rows)), pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "points", "weights"])


def _limits(bins: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, _Summary] = {}
        for batch in batches:
            for f, points, weights in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                merged.setdefault(f, _Summary()).add(np.frombuffer(points), np.frombuffer(weights))
        out = []
        for f in sorted(merged):
            values, weights = merged[f].whole()
            up_to = np.cumsum(weights)
            # the least value with at least k / bins of the rows up to it
            at = np.searchsorted(up_to, np.arange(1, bins) * (up_to[-1] / bins) * (1 - 1e-12)) if len(values) else []
            out.append((f, np.unique(values[at]).tolist() if len(values) else []))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["feature", "limits"]
        )

    return run


def bin_limits(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Per feature the ascending distinct values that end a bin (quantiles of the values that are no NaN).

    They are exact up to ``_POINTS`` rows a task and else off by about the share 1 / _POINTS per merge rank.
    """
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be from 2 to {MAX_BINS}, not {bins}")
    parts = df.select(vector_to_array(features).alias("x")).mapInArrow(_summaries, "feature int, points binary, weights binary")
    # one row per feature
    rows = parts.repartition("feature").mapInArrow(_limits(bins), "feature int, limits array<double>").collect()
    return [np.array(r["limits"], dtype="float64") for r in sorted(rows, key=lambda r: r["feature"])]


def with_bins(df: DataFrame, features: str, limits: Sequence[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``bins``: the number of limits below each value, a byte per feature (NaN is above all)."""
    rows = df.select(*keep, vector_to_array(features).alias("_x"))

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.empty(x.shape, dtype="uint8")
            for f, limit in enumerate(limits):
                codes[:, f] = np.searchsorted(limit, x[:, f], "left")
            rows = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], rows], [*keep, "bins"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(binned, f"{schema}, bins binary")


def byte_rows(column: pa.BinaryArray) -> np.ndarray:
    """Binary values of one length as a matrix of bytes, without a copy."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "int32")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "uint8")[ends[0] : ends[-1]].reshape(len(column), -1)


def _summed(tree: Tree, level: int, bins: int):
    """Per task and feature the sums of grad, hess and rows by (node of the level, bin), as bytes."""
    first, width = 2**level - 1, 2**level

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = byte_rows(batch.column("bins"))
            g, h = batch.column("grad").to_numpy(), batch.column("hess").to_numpy()
            if total is None:
                total = np.zeros((x.shape[1], 3, width * bins))
            node = tree.leaf_of_bins(x) - first
            here = node >= 0
            x, g, h, node = x[here], g[here], h[here], node[here] * bins
            for f in range(x.shape[1]):
                at = node + x[:, f]
                for k, weight in enumerate((g, h, None)):
                    total[f, k] += np.bincount(at, weight, width * bins)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["feature", "sums"]
            )

    return run


_SPLITS = "feature int, node int, bin int, gain double, g double, h double, left_g double, left_h double"


def _scanned(width: int, bins: int, l2: float, min_rows: int):
    """Per feature and node: the best split of the added sums, and the node's totals; no split has gain null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, raw in zip(batch.column("feature").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums = np.frombuffer(raw).reshape(3, width, bins)
                added[f] = added[f] + sums if f in added else sums.copy()
        rows = []
        for f in sorted(added):
            g, h, n = added[f]
            lg, lh, ln = (np.cumsum(a, axis=1)[:, :-1] for a in (g, h, n))
            tg, th, tn = (a.sum(axis=1, keepdims=True) for a in (g, h, n))
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            gain = np.where((ln >= min_rows) & (tn - ln >= min_rows), gain, -np.inf)
            best = gain.argmax(axis=1)
            for node in np.flatnonzero(tn[:, 0] > 0):
                b = best[node]
                found = gain[node, b] if np.isfinite(gain[node, b]) else None
                rows.append((f, node, b, found, tg[node, 0], th[node, 0], lg[node, b], lh[node, b]))
        if rows:
            kinds = [pa.int32()] * 3 + [pa.float64()] * 5
            names = [part.split()[0] for part in _SPLITS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


# a gain below this share of the sums it comes from is rounding
_ROUNDING = 1e-12


def grow(graded: DataFrame, limits: Sequence[np.ndarray], depth: int, bins: int, l2: float, min_rows: int = 1) -> tuple[Tree, np.ndarray]:
    """A tree of the rows (bins, grad, hess) and grad / (hess + l2) of every node.

    A split maximises the sum of grad^2 / (hess + l2) over its sides; ties go to the first feature, then the first bin.
    """
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, dtype="int64"), np.zeros(size), depth)
    value = np.zeros(size)
    rows = graded.select("bins", "grad", "hess")
    for level in range(depth):
        width = 2**level
        parts = rows.mapInArrow(_summed(tree, level, bins), "feature int, sums binary")
        # at most features x nodes rows reach the driver
        found = parts.repartition("feature").mapInArrow(_scanned(width, bins, l2, min_rows), _SPLITS).collect()
        by_node: dict[int, list] = {}
        for s in found:
            by_node.setdefault(s["node"], []).append(s)
        split = False
        for k, splits in by_node.items():
            node = width - 1 + k
            s = min(splits, key=lambda s: (-(s["gain"] if s["gain"] is not None else -np.inf), s["feature"], s["bin"]))
            value[node] = s["g"] / (s["h"] + l2)
            if s["gain"] is None or s["gain"] <= _ROUNDING * max(1.0, s["g"] ** 2 / (s["h"] + l2)) or s["bin"] >= len(limits[s["feature"]]):
                continue
            split = True
            tree.feature[node], tree.bins[node] = s["feature"], s["bin"]
            tree.threshold[node] = limits[s["feature"]][s["bin"]]
            value[2 * node + 1] = s["left_g"] / (s["left_h"] + l2)
            value[2 * node + 2] = (s["g"] - s["left_g"]) / (s["h"] - s["left_h"] + l2)
        if not split:
            break
    return tree, value


def summed_leaves(trees: Sequence[Tree], leaves: Sequence[Sequence[float]], features: str) -> Column:
    """The sum of all trees' leaf values for a vector column, in one pass over the rows."""
    trees, values = list(trees), [np.asarray(v, dtype="float64") for v in leaves]

    @F.pandas_udf("double")
    def add(x: pd.Series) -> pd.Series:
        rows = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        total = np.zeros(len(rows))
        for tree, value in zip(trees, values, strict=True):
            total += value[tree.leaf_of_values(rows)]
        return pd.Series(total)

    return add(vector_to_array(features))
