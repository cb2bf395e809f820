"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction; a vector belongs to it if their inner product is at least the cap's height. The
directions of one code are a rotated product: the rotated space is cut into two blocks, each with its own
list of random words, and a direction is one word of either block. So a vector meets all exceeding
directions without looking at them one by one: it is compared with the words of the first block, words
that even the best word of the second could not lift over the height are dropped, and only the others are
combined. ``CODES`` codes with rotations of their own are used; a pair at the threshold shares a filter
of one code with chance 0.44, of any with 1 - 8e-7 (vectors of 64 components; wider ones do better).

Vectors of one label that share a filter meet in that filter's bucket, where their cosine is computed in
double precision; a pair counts in the least filter it shares, so no pair counts twice and no pair is
emitted: a bucket returns each member's number of links and a spanning forest. A bucket of more than
``TILE`` members is cut into tiles that meet two by two in tasks of their own.

Equal vectors of a label are one node with a number of copies. Vectors that are null, zero or hold null
or non-finite components, and rows with a null label, link with nothing. Vectors of different length
never link. Rows that repeat a vec_id are vectors of their own; a component is named by its least vec_id
that is not null, and a row without a vec_id is not kept unless it links with nothing. Other columns are
not used. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.llm.components import components
from duskrank.session import cut

THRESHOLD = 0.98
# codes, words per block, and the height of a cap; the height falls with the dimension, the words for small ones
CODES, WORDS, HEIGHT = 24, 500, 0.5
# filters of one code that a vector belongs to, on average
FILTERS = 2.8
TILE = 512
SEED = 11
_ROWS = 2048


def cap_share(height: float, dims: int) -> float:
    """Share of the sphere's directions that a cap of this height holds."""
    if dims == 1:
        return 0.5
    angle = np.linspace(0.0, np.pi, 20_001)
    ring = np.sin(angle) ** (dims - 2)
    return float(ring[angle <= np.arccos(height)].sum() / ring.sum())


@lru_cache(maxsize=64)
def code_shape(dims: int) -> tuple[int, int, float]:
    """(blocks, words per block, height) of the codes for vectors of ``dims`` components."""
    blocks = 1 if dims < 8 else 2
    low, height = 0.0, HEIGHT
    if cap_share(height, dims) * WORDS**blocks < FILTERS and blocks == 2:
        for _ in range(40):  # the height at which the code's words give the wanted number of filters
            middle = (low + height) / 2
            low, height = (middle, height) if cap_share(middle, dims) * WORDS**blocks > FILTERS else (low, middle)
        return blocks, WORDS, height
    return blocks, int(np.ceil((FILTERS / cap_share(height, dims)) ** (1 / blocks))), height


@lru_cache(maxsize=64)
def code(dims: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and the words of each block, one column a word."""
    blocks, words, _ = code_shape(dims)
    rng = np.random.default_rng([SEED, dims, number])
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    lists = []
    for part in np.array_split(np.arange(dims), blocks):
        w = rng.standard_normal((len(part), words))
        lists.append(w / np.linalg.norm(w, axis=0) / np.sqrt(blocks))
    return rotation, lists


def exceeding(unit: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter of code ``number`` that a row of ``unit`` (unit vectors) belongs to."""
    dims = unit.shape[1]
    blocks, words, height = code_shape(dims)
    rotation, lists = code(dims, number)
    turned, scores, start = unit @ rotation, [], 0
    for w in lists:
        scores.append(turned[:, start : start + len(w)] @ w)
        start += len(w)
    base = number * words**blocks
    if blocks == 1:
        row, word = np.nonzero(scores[0] >= height)
        return row, base + word
    row, first = np.nonzero(scores[0] + scores[1].max(axis=1)[:, None] >= height)
    at, second = np.nonzero(scores[1][row] >= (height - scores[0][row, first])[:, None])
    return row[at], base + first[at].astype(np.int64) * words + second


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for very large or small components."""
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            nodes, dims = batch.column("node").to_numpy(), batch.column("dims").to_numpy()
            for d in np.unique(dims):
                here = np.flatnonzero(dims == d)
                unit = unit_rows(_matrix(batch.column("embedding").take(pa.array(here))))
                for number in range(CODES):
                    row, found = exceeding(unit, number)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[here[row]]), pa.array(found, pa.int64())], ["node", "filter"]
                    )


def _forest(linked: np.ndarray) -> np.ndarray:
    """For every node of a symmetric matrix the least node it reaches."""
    reach, size = np.arange(len(linked)), len(linked)
    while True:
        best = np.minimum(reach, np.where(linked, reach[None, :], size).min(axis=1, initial=size))
        best = best[best]
        if (best == reach).all():
            return reach
        reach = best


def _met(threshold: float):
    """Per bucket (or pair of tiles): members with links counted here, how many, and the forest's root."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            members, own = batch.column("members"), batch.column("filter").to_pylist()
            across = (np.array(batch.column("i")) != np.array(batch.column("j"))).tolist()
            for k in range(batch.num_rows):
                rows = members[k].values
                unit = unit_rows(_matrix(rows.field("embedding")))
                linked = unit @ unit.T >= threshold
                np.fill_diagonal(linked, False)
                if across[k]:
                    tile = rows.field("tile").to_numpy()
                    linked &= tile[:, None] != tile[None, :]
                if not linked.any():
                    continue
                lists = rows.field("filters")
                ids = lists.flatten().to_numpy()
                holder = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
                lower = ids < own[k]
                if lower.any():
                    names, at = np.unique(ids[lower], return_inverse=True)
                    held = np.zeros((len(rows), len(names)), np.float32)
                    held[holder[lower], at] = 1.0
                    linked &= held @ held.T == 0
                some = np.flatnonzero(linked.any(axis=1))
                if len(some):
                    nodes = rows.field("node").to_numpy()
                    counts = linked.astype(np.float64) @ rows.field("copies").to_numpy().astype(np.float64)
                    out.append([nodes[some], counts[some].astype(np.int64), nodes[_forest(linked)][some]])
            if out:
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "root"])

    return run


def _nodes(vectors: DataFrame) -> DataFrame:
    """One row per distinct (label, vector) that can link: node, label, dims, embedding, copies, first_id."""

    def usable(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    valid = (
        F.col("label").isNotNull()
        & F.forall("embedding", lambda x: F.coalesce(usable(x), F.lit(False)))
        & F.exists("embedding", lambda x: x != 0)
    )
    found = vectors.filter(valid).groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")
    )
    return cut(found.withColumn("dims", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _buckets(nodes: DataFrame, tile: int) -> DataFrame:
    """One row per bucket or pair of tiles, with its members (at most two tiles of them)."""
    decoded = nodes.select("node", "dims", "embedding").mapInArrow(_decoded, "node long, filter long")
    keyed = cut(decoded.join(nodes.select("node", "label", "dims"), "node"), "filters")
    keys = ["label", "dims", "filter"]
    shared = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = cut(keyed.join(shared, keys), "shared")
    lists = shared.groupBy("node").agg(F.collect_list("filter").alias("filters"))
    payload = cut(nodes.join(lists, "node").select("node", "copies", "embedding", "filters"), "payload")
    tiles = F.ceil(F.col("_n") / tile).cast("int")
    placed = shared.withColumn("_tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    placed = placed.select(
        "node", *keys, "tile", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j")
    )
    members = placed.join(payload, "node")
    member = F.struct("node", "tile", "copies", "embedding", "filters")
    return members.groupBy(*keys, "i", "j").agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    nodes = _nodes(rows)
    buckets = _buckets(nodes, tile).select("filter", "i", "j", "members")
    found = cut(buckets.mapInArrow(_met(threshold), "node long, n long, root long"), "found")
    named = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = (
        nodes.join(found.groupBy("node").agg(F.sum("n").alias("_n")), "node", "left")
        .join(named, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("_links", F.coalesce("_n", F.lit(0)) + F.col("copies") - 1)
    )
    known = cut(known.select("label", "embedding", "component", "first_id", "_links"), "known")
    least = known.groupBy("component").agg(F.min("first_id").alias("_least"))
    known = known.join(least, "component").select("label", "embedding", "_links", "_least")
    component = F.when(F.col("_links").isNull(), F.col("vec_id")).otherwise(F.col("_least"))
    alone = F.coalesce(F.col("_links"), F.lit(0)) == 0
    return rows.join(known, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, alone).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, label,
         coalesce(label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS ok
  FROM embeddings),
links AS (
  SELECT a.r, b.r AS other, b.vec_id AS other_id
  FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (
  SELECT r, r AS goal, vec_id AS goal_id FROM v
  UNION
  SELECT reached.r, l.other, l.other_id FROM reached JOIN links l ON l.r = reached.goal)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.r = v.r)::BIGINT AS n_links,
       min(goal_id) AS component_id, v.vec_id = min(goal_id) AS kept
FROM v JOIN reached ON reached.r = v.r GROUP BY v.r, v.vec_id
"""
