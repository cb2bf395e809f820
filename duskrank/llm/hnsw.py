"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt to shards by a hash of the vector, each shard builds a hierarchical graph in one task
and stores it as flat arrays (vectors, ids, and per level a node list and a padded neighbour table).
The largest inner product is turned into the least angle by one more component that brings all vectors to
the same norm; the queries get zero there. Every query block meets every shard (a stated query set
against all rows, in blocks); a search walks the graph for the whole block at once, and the shards'
results are merged by a window.

Equal vectors are one node, since copies that fill each other's neighbour lists would cut a graph in
pieces. A node keeps its ``k + 1`` least ids: no answer can hold more of them, because ties go to the
smaller id and only the query itself is left out.

Vectors that are null, zero, empty, of another length than most (the most frequent length), or hold null
or non-finite components take no part, nor do rows without an id. A repeated (id, vector) counts once.
If there are fewer than ``k`` candidates a query gets them all. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskrank.session import cut

SHARD_ROWS = 4096
QUERY_BLOCK = 256
LINKS = 16  # per node on the upper levels; twice as many on the lowest
EF_BUILD, EF_SEARCH = 64, 80
_INSERT = 128  # nodes that enter a graph together

_INDEX = "shard int, dims int, ids binary, vectors binary, levels binary, neighbours binary"


# --- graph of one shard -------------------------------------------------------------------------


def _merge_beam(near: np.ndarray, score: np.ndarray, new: np.ndarray, new_score: np.ndarray, width: int):
    near, score = np.concatenate([near, new], axis=1), np.concatenate([score, new_score], axis=1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)


def walk(points: np.ndarray, table: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int):
    """Best-first search for all rows of ``queries`` at once: (nodes, scores) of the ``width`` best, -1 padded.

    ``table`` holds each node's neighbours (-1 padded), ``start`` (queries x any) the entry nodes.
    """
    n = len(points)
    seen = np.zeros((len(queries), n + 1), dtype=bool)
    seen[:, n] = True  # where padding points
    near = np.full((len(queries), width), -1, dtype=np.int64)
    score = np.full((len(queries), width), -np.inf, dtype=np.float32)
    expanded = np.zeros((len(queries), n + 1), dtype=bool)
    expanded[:, n] = True

    def visit(who: np.ndarray, found: np.ndarray):
        found = np.where(found < 0, n, found)
        # the first of equal entries in a row counts
        found = np.sort(found, axis=1)
        twice = np.zeros(found.shape, dtype=bool)
        twice[:, 1:] = found[:, 1:] == found[:, :-1]
        fresh = ~seen[who[:, None], found] & ~twice
        seen[who[:, None], found] = True
        found = np.where(fresh, found, n)
        values = np.einsum("qd,qkd->qk", queries[who], points[np.minimum(found, n - 1)], optimize=False)
        return np.where(fresh, found, -1), np.where(fresh, values, -np.inf)

    active = np.arange(len(queries))
    new, new_score = visit(active, start)
    near, score = _merge_beam(near, score, new, new_score, width)
    while len(active):
        pool = np.where(near[active] < 0, n, near[active])
        open_ = ~expanded[active[:, None], pool]
        some = open_.any(axis=1)
        active, pool, open_ = active[some], pool[some], open_[some]
        if not len(active):
            break
        # the beam is sorted: the two best nodes that were not expanded yet
        first = open_.argmax(axis=1)
        place = np.arange(len(active))
        open_[place, first] = False
        second = np.where(open_.any(axis=1), open_.argmax(axis=1), first)
        chosen = np.stack([pool[place, first], pool[place, second]], axis=1)
        expanded[active[:, None], chosen] = True
        new, new_score = visit(active, table[chosen].reshape(len(active), -1))
        near[active], score[active] = _merge_beam(near[active], score[active], new, new_score, width)
    return near, score


def diverse(points: np.ndarray, near: np.ndarray, score: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 padded) those nearer to the row's point than to any chosen one.

    Free places are filled with the best of the others, so that no node stays poor in links.
    """
    q, c = near.shape
    among = np.einsum("qad,qbd->qab", points[np.maximum(near, 0)], points[np.maximum(near, 0)], optimize=False)
    valid = near >= 0
    chosen = np.zeros((q, c), dtype=bool)
    closest = np.full((q, c), -np.inf, dtype=np.float32)  # similarity to the nearest chosen candidate
    for k in range(c):
        take = valid[:, k] & (score[:, k] > closest[:, k]) & (chosen.sum(axis=1) < links)
        chosen[:, k] = take
        closest = np.where(take[:, None], np.maximum(closest, among[:, k]), closest)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :links]
    picked = np.take_along_axis(near, order, 1)
    if picked.shape[1] < links:
        picked = np.pad(picked, ((0, 0), (0, links - picked.shape[1])), constant_values=-1)
    return picked


def build_level(points: np.ndarray, links: int, width: int) -> np.ndarray:
    """Neighbour table of a small-world graph over ``points``, built by inserting portions of nodes."""
    n = len(points)
    table = np.full((n, links), -1, dtype=np.int64)
    done = 0
    while done < n:
        size = min(n - done, max(16, min(_INSERT, done)))
        new = np.arange(done, done + size)
        if done:
            entry = np.unique(np.linspace(0, done - 1, 4).astype(np.int64))
            starts = np.broadcast_to(entry, (size, len(entry)))
            near, score = walk(points[:done], table[:done], points[new], starts, min(width, done))
        else:
            near = np.full((size, 1), -1, dtype=np.int64)
            score = np.full((size, 1), -np.inf, dtype=np.float32)
        # nodes of one portion see each other directly
        mates = points[new] @ points[new].T
        np.fill_diagonal(mates, -np.inf)
        mate_ids = np.where(np.isfinite(mates), np.broadcast_to(new, mates.shape), -1)
        near, score = _merge_beam(near, score, mate_ids, mates, width)
        table[new] = diverse(points, near, score, links)
        # links back, thinned out where a node has too many
        source = np.repeat(new, links)
        target = table[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max() if len(count) else 0), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for at in range(0, len(nodes), 256):
            part = nodes[at : at + 256]
            both = np.concatenate([table[part], extra[at : at + 256]], axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            values = np.einsum("qd,qkd->qk", points[part], points[np.maximum(both, 0)], optimize=False)
            values = np.where(both >= 0, values, -np.inf)
            keep = min(both.shape[1], 2 * links)
            both, values = _merge_beam(both[:, :0], values[:, :0], both, values, keep)
            table[part] = diverse(points, both, values, links)
        done += size
    return table


def build(points: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(node lists, neighbour tables) from the lowest level up; an upper level has one in LINKS nodes of the one below."""
    rng = np.random.default_rng(seed)
    nodes, tables = [np.arange(len(points))], [build_level(points, 2 * LINKS, EF_BUILD)]
    while len(nodes[-1]) > LINKS * LINKS:
        chosen = np.sort(rng.choice(nodes[-1], len(nodes[-1]) // LINKS, replace=False))
        nodes.append(chosen)
        tables.append(build_level(points[chosen], LINKS, EF_BUILD // 2))
    return nodes, tables


def search(points: np.ndarray, nodes: list[np.ndarray], tables: list[np.ndarray], queries: np.ndarray, width: int):
    """Goes down the levels with a narrow beam, then searches the lowest with ``width``."""
    top = len(nodes) - 1
    entry = np.broadcast_to(np.arange(len(nodes[top])), (len(queries), len(nodes[top])))[:, : LINKS * LINKS]
    for level in range(top, 0, -1):
        near, _ = walk(points[nodes[level]], tables[level], queries, entry, 8)
        found = np.where(near < 0, near[:, :1], near)
        entry = np.searchsorted(nodes[level - 1], nodes[level][found])
    if top == 0:
        entry = entry[:, :8]
    return walk(points, tables[0], queries, entry, min(width, len(points)))


# --- Spark side ---------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _packed(shard_norm: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_id")
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
        rest = np.sqrt(np.maximum(shard_norm**2 - (vectors.astype(np.float64) ** 2).sum(axis=1), 0.0))
        points = np.concatenate([vectors, rest[:, None].astype(np.float32)], axis=1)
        nodes, tables = build(points, int(pdf["shard"].iloc[0]))
        counts = np.array([len(i) for i in pdf["ids"]], dtype=np.int64)
        ids = np.concatenate([counts, *[np.sort(np.asarray(i, dtype=np.int64)) for i in pdf["ids"]]])
        shape = np.array([len(nodes), *(len(x) for x in nodes)], dtype=np.int64)
        return pd.DataFrame(
            {
                "shard": [int(pdf["shard"].iloc[0])],
                "dims": [points.shape[1]],
                "ids": [ids.tobytes()],
                "vectors": [points.tobytes()],
                "levels": [np.concatenate([shape, *nodes]).tobytes()],
                "neighbours": [np.concatenate([t.ravel() for t in tables]).astype(np.int32).tobytes()],
            }
        )

    return run


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, as flat arrays, from (vec_id long, vector array<double>) of usable vectors."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    # a row number with a limit is applied before the shuffle too, so a very common vector costs k + 1 rows a task
    few = vectors.distinct().withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.collect_list("vec_id").alias("ids"), F.min("vec_id").alias("first_id"))
    nodes = cut(nodes, "nodes")
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    n, norm = nodes.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    shards = max(1, -(-n // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInPandas(_packed(norm or 0.0), _INDEX), "index")


def _searched(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("shard", "query_ids", "query_vectors")}
                if row["shard"] != last:
                    last, state = row["shard"], _unpacked({c: batch.column(c)[r].as_py() for c in _INDEX_COLUMNS})
                ids, starts, counts, points, nodes, tables = state
                own = np.asarray(row["query_ids"], dtype=np.int64)
                exact = np.asarray(row["query_vectors"], dtype=np.float64).reshape(len(own), -1)
                queries = np.concatenate([exact, np.zeros((len(own), 1))], axis=1).astype(np.float32)
                near, _ = search(points, nodes, tables, queries, EF_SEARCH)
                originals = points[:, :-1].astype(np.float64)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q in range(len(own)):
                    found = near[q][near[q] >= 0]
                    score = (originals[found] * exact[q]).sum(axis=1)
                    each = np.repeat(np.arange(len(found)), counts[found])
                    names = np.concatenate([ids[starts[f] : starts[f] + counts[f]] for f in found])
                    value = score[each]
                    value, names = value[names != own[q]], names[names != own[q]]
                    best = np.lexsort((names, -value))[:k]
                    out.append((np.full(len(best), own[q]), names[best], value[best]))
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


_INDEX_COLUMNS = ("dims", "ids", "vectors", "levels", "neighbours")


def _unpacked(row: dict):
    points = np.frombuffer(row["vectors"], dtype=np.float32).reshape(-1, row["dims"])
    flat = np.frombuffer(row["ids"], dtype=np.int64)
    counts, ids = flat[: len(points)], flat[len(points) :]
    starts = np.cumsum(counts) - counts
    levels = np.frombuffer(row["levels"], dtype=np.int64)
    sizes, rest = levels[1 : levels[0] + 1], levels[levels[0] + 1 :]
    links = np.frombuffer(row["neighbours"], dtype=np.int32).astype(np.int64)
    nodes, tables = [], []
    for level, size in enumerate(sizes.tolist()):
        width = LINKS if level else 2 * LINKS
        nodes.append(rest[:size])
        tables.append(links[: size * width].reshape(size, width))
        rest, links = rest[size:], links[size * width :]
    return ids, starts, counts, points, nodes, tables


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found of each query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    rows = rows.filter(F.size("vector") == (common["dims"] if common else 0))
    index = build_index(rows, k, shard_rows)
    queries = rows.filter(is_query).distinct()
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "vector")).alias("rows")
    )
    blocks = blocks.select(
        "block", F.col("rows.vec_id").alias("query_ids"), F.flatten("rows.vector").alias("query_vectors")
    )
    n_shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    dealt = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    met = dealt.join(index, "shard").select("shard", "query_ids", "query_vectors", *_INDEX_COLUMNS)
    # a task takes a few pairs of a block and a shard, whatever the number of shards
    found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
