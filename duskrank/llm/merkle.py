"""Merkle manifest of the documents by a butterfly exchange of subtree roots.

Every row is a leaf; a source's leaves, in the order of their ids, are the lowest level of its tree, every
run of ``FANOUT`` nodes becomes one node of the next level, and the sources' roots are the leaves of one
more tree. The leaves of a source are cut into aligned blocks of FANOUT^BLOCK_LEVELS, each a whole
subtree that one task hashes. Above the blocks there is no upward and no downward pass: in round r every
block holds the root of its ancestor FANOUT^r blocks wide and swaps it with the two blocks that differ
from it in digit r of their numbers only; each of the three then hashes the same common ancestor for itself.
After the last round each block has the tree's root and all siblings on its way. Missing blocks of the last
run take part as empty ones (at most twice as many as there are blocks), so every block sends to exactly
two others in a round and no block is asked by many.

Ids ascend with null first; rows that repeat an id are leaves of their own, ordered by their digests, and
equal rows stand next to each other. A null column counts as ``-``. A null source is a source of its own and
the first. A row without an id is not tampered with. An empty table gives no rows. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from duskrank.llm.common import crc32_sql, same_key
from duskrank.session import cut

FANOUT = 3
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each with its length before it (``-`` for null)."""
    parts = [
        F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
        for c in fields
    ]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The levels of a tree from its leaves upwards: ``most`` of them above the leaves, or up to a single node."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[k : k + FANOUT])) for k in range(0, len(last), FANOUT)])
    return out


def runs_of(tree: list[list[str]], place: int) -> list[list[str]]:
    """The run that holds the leaf at ``place``, level by level; its own node's index is the place's digit."""
    out = []
    for level in tree[:-1]:
        first = place // FANOUT * FANOUT
        out.append(level[first : first + FANOUT])
        place //= FANOUT
    return out


def siblings(runs: Iterable[Sequence[str]], place: int) -> str:
    """The runs' nodes but the own ones, joined."""
    out = []
    for run in runs:
        own, place = place % FANOUT, place // FANOUT
        out += run[:own]
        out += run[own + 1 :]
    return "".join(out)


def fold(node: str, runs: Iterable[Sequence[str]], place: int) -> str:
    """The root that a node and its siblings give."""
    for run in runs:
        own, place = place % FANOUT, place // FANOUT
        node = digest("".join([*run[:own], node, *run[own + 1 :]]))
    return node


def _blocks(rows: DataFrame, group: str, order: Sequence[str], payload: Sequence[str], width: int) -> DataFrame:
    """One row per aligned block of a group: group, block, n (leaves of the group), entries in order.

    Rows have ``copies``. They are cut into ranges of (group, order), numbered inside each range and shifted
    by the totals of the earlier ranges, so a group of any size is spread over many tasks.
    """
    ranged = rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    inside = Window.partitionBy("_range", group).orderBy(*order)
    placed = ranged.withColumn("_start", F.sum("copies").over(inside) - F.col("copies"))
    totals = ranged.groupBy("_range", group).agg(F.sum("copies").alias("_total"))
    by_group = Window.partitionBy(group)
    earlier = F.sum("_total").over(by_group.orderBy("_range")) - F.col("_total")
    shifts = totals.select(
        F.col("_range").alias("_r"), F.col(group).alias("_g"), earlier.alias("_shift"), F.sum("_total").over(by_group).alias("n")
    )
    placed = placed.join(shifts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    placed = placed.withColumn("_start", F.col("_start") + F.col("_shift"))
    end = F.col("_start") + F.col("copies")
    first, last = F.floor(F.col("_start") / width), F.floor((end - 1) / width)
    placed = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("_start", F.col("block") * width)
    held = F.least(end, (F.col("block") + 1) * width) - begin
    entry = F.struct(begin.alias("place"), held.cast("int").alias("copies"), *payload)
    return placed.groupBy(group, "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("entries"))


def _expanded(values: list, copies: list[int]) -> list:
    return [v for v, c in zip(values, copies, strict=True) for _ in range(c)]


def _most(n: int, block_levels: int) -> int | None:
    """Levels inside a block: a fixed number, or up to the root where the block is the whole tree."""
    return block_levels if n > FANOUT**block_levels else None


def _block_roots(block_levels: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for k in range(batch.num_rows):
                nodes = _expanded(batch.column("nodes")[k].as_py(), batch.column("copies")[k].as_py())
                roots.append(levels(nodes, _most(batch.column("n")[k].as_py(), block_levels))[-1][0])
            columns = [batch.column("name"), batch.column("block"), batch.column("n"), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "block", "n", "root"])

    return run


def butterfly(roots: DataFrame, width: int) -> DataFrame:
    """name, block, runs (one per round), top from the blocks' roots (name, block, n, root)."""
    most = roots.agg(F.max("n")).first()[0] or 0
    rounds, power = 0, width
    while power < most:
        rounds, power = rounds + 1, power * FANOUT
    powers = F.array(*[F.lit(FANOUT**r).cast("long") for r in range(rounds + 1)])
    blocks = F.ceil(F.col("n") / width)
    state = roots.withColumn("_blocks", blocks).withColumn("_grid", F.element_at(F.filter(powers, lambda p: p >= blocks), 1))
    copies = F.array(*[F.col("block") + k * F.col("_blocks") for k in range(FANOUT)])
    state = (
        state.withColumn("_at", F.explode(F.filter(copies, lambda b: b < F.col("_grid"))))
        .withColumn("root", F.when(F.col("_at") == F.col("block"), F.col("root")))
        .withColumn("block", F.col("_at"))
        .withColumn("runs", F.array().cast("array<array<string>>"))
        .select("name", "block", "_blocks", "_grid", "root", "runs")
    )
    for r in range(rounds):
        step = FANOUT**r
        active = F.col("_grid") > step
        digit = F.pmod(F.floor(F.col("block") / step), F.lit(FANOUT))
        goals = F.array(*[F.col("block") + (F.lit(d) - digit) * step for d in range(FANOUT)])
        sent = state.withColumn("_digit", digit).withColumn(
            "_to", F.explode(F.when(active, goals).otherwise(F.array("block")))
        )
        own = F.col("_to") == F.col("block")
        met = sent.groupBy("name", F.col("_to").alias("block"), "_blocks", "_grid").agg(
            F.array_sort(F.collect_list(F.struct("_digit", "root"))).alias("_met"),
            F.first(F.when(own, F.col("runs")), ignorenulls=True).alias("runs"),
            F.first(F.when(own, F.col("root")), ignorenulls=True).alias("root"),
        )
        # nodes that are missing are at the end of a run
        run = F.filter(F.transform("_met", lambda m: m["root"]), lambda x: x.isNotNull())
        above = F.when(F.size("_run") > 0, F.sha2(F.array_join("_run", "").cast("binary"), 256))
        state = (
            met.withColumn("_run", run)
            .withColumn("root", F.when(active, above).otherwise(F.col("root")))
            .withColumn("runs", F.when(active, F.concat("runs", F.array("_run"))).otherwise(F.col("runs")))
            .drop("_met", "_run")
        )
    return state.filter(F.col("block") < F.col("_blocks")).select("name", "block", "runs", F.col("root").alias("top"))


def grow(rows: DataFrame, group: str, order: Sequence[str], node: str, payload: Sequence[str], block_levels: int) -> DataFrame:
    """Blocks of every group's tree: name, block, n, copies, nodes, the payload as arrays, runs above the block, top."""
    width = FANOUT**block_levels
    blocks = cut(_blocks(rows, group, order, [node, *payload], width), "blocks")
    blocks = blocks.select(
        F.col(group).alias("name"), "block", "n", F.col("entries.copies").alias("copies"),
        F.col(f"entries.{node}").alias("nodes"), *[F.col(f"entries.{p}").alias(p) for p in payload],
    )
    kind = dict(blocks.dtypes)["name"]
    roots = blocks.select("name", "block", "n", "copies", "nodes")
    roots = cut(roots.mapInArrow(_block_roots(block_levels), f"name {kind}, block long, n long, root string"), "roots")
    above = cut(butterfly(roots, width), "butterfly")
    return blocks.join(above, same_key(blocks, above, "name", "block")).drop(above["name"]).drop(above["block"])


def _source_paths(block_levels: int):
    """Rows of the sources' tree: the runs above a source's root, its place, and the root of all."""
    width = FANOUT**block_levels

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                tree = levels(row["nodes"], _most(row["n"], block_levels))
                first, size = row["block"] * width, len(row["nodes"])
                runs = [runs_of(tree, p) + row["runs"] for p in range(size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["source"], pa.string()),
                        pa.array(runs, pa.list_(pa.list_(pa.string()))),
                        pa.array(range(first, first + size), pa.int64()),
                        pa.array([row["top"]] * size, pa.string()),
                    ],
                    ["source", "up", "up_place", "root"],
                )

    return run


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(block_levels: int):
    """Rows of the documents: proof and fold of every leaf of a block."""
    width = FANOUT**block_levels

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                leaves, ids, changed = (_expanded(row[c], row["copies"]) for c in ("nodes", "doc_id", "tampered"))
                tree = levels(leaves, _most(row["n"], block_levels))
                place, up_place = row["block"] * width, row["up_place"]
                above = siblings(row["runs"], place // FANOUT ** (len(tree) - 1)) + siblings(row["up"], up_place)
                proofs, folded = [], []
                for p, leaf in enumerate(changed):
                    inside = runs_of(tree, p)
                    proofs.append(digest(siblings(inside, p) + above))
                    folded.append(fold(fold(leaf, inside + row["runs"], place + p), row["up"], up_place))
                size = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(leaves, pa.string()),
                        pa.array([row["top"]] * size, pa.string()),
                        pa.array([row["root"]] * size, pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folded, pa.string()),
                        pa.array([f == row["root"] for f in folded], pa.bool_()),
                    ],
                    [part.split()[0] for part in _PROVED.split(", ")],
                )

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    ``tampered`` is the text that is checked against the manifest in place of the original one.
    """
    own = [F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c) for c in FIELDS]
    other = [*own[:-1], F.col("text") if tampered is None else tampered]
    leaves = docs.select(
        own[0].alias("doc_id"), F.col("source"), leaf_digest(own).alias("leaf"), leaf_digest(other).alias("tampered")
    )
    leaves = leaves.groupBy("source", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("copies"))
    trees = grow(cut(leaves, "leaves"), "source", ["doc_id", "leaf", "tampered"], "leaf", ["doc_id", "tampered"], block_levels)
    tops = trees.filter("block = 0").select(F.col("name").alias("source"), F.col("top").alias("subroot"))
    tops = tops.withColumn("all", F.lit(0)).withColumn("copies", F.lit(1).cast("long"))
    above = grow(cut(tops, "subroots"), "all", ["source"], "subroot", ["source"], block_levels)
    above = above.select("block", "n", "nodes", "source", "runs", "top")
    paths = cut(above.mapInArrow(_source_paths(block_levels), "source string, up array<array<string>>, up_place long, root string"), "paths")
    met = trees.join(paths, trees["name"].eqNullSafe(paths["source"]))
    met = met.select("block", "n", "copies", "nodes", "doc_id", "tampered", "runs", "top", "up", "up_place", "root")
    return met.mapInArrow(_proved(block_levels), _PROVED)


def without_newlines(docs: DataFrame) -> Column:
    """Every second document's text (by the checksum of its id) without newlines, the others' as they are."""
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in fields]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, base: str) -> str:
    """CTEs of a forest: <name>(tree, level, pos, h, n) from its leaves, and <name>_run with every node's siblings."""
    run = f"PARTITION BY tree, level, pos // {FANOUT} ORDER BY pos"
    return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT tree, level + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + {FANOUT - 1}) // {FANOUT}
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {FANOUT}),
{name}_run AS (
  SELECT tree, level, pos,
         coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1),"""


def _fold_sql(name: str, tree: str, base: str) -> str:
    """CTE that carries a digest and its proof up a tree, one level per step."""
    return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT f.r, f.tree, f.level + 1, f.pos // {FANOUT}, sha256(t.before || f.h || t.after), f.proof || t.before || t.after
  FROM {name} f JOIN {tree}_run t ON t.tree IS NOT DISTINCT FROM f.tree AND t.level = f.level AND t.pos = f.pos),"""


_LEAVES = "SELECT source AS tree, 0::BIGINT AS level, pos::BIGINT AS pos, leaf AS h, n::BIGINT AS n FROM placed"
_SUBROOTS = "SELECT 0 AS tree, 0::BIGINT AS level, pos::BIGINT AS pos, h, n::BIGINT AS n FROM subroots"
_TAMPERED = "SELECT r, source AS tree, 0::BIGINT AS level, pos::BIGINT AS pos, other AS h, '' AS proof FROM placed"
_FOLDED = """SELECT e.r, 0 AS tree, 0::BIGINT AS level, s.pos::BIGINT AS pos, e.h, e.proof
  FROM inner_end e JOIN placed p ON p.r = e.r JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source"""

SQL = f"""
WITH RECURSIVE tampered AS (
  SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("changed")} AS other FROM tampered),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves),{_tree_sql("nodes", _LEAVES)}
subroots AS (
  SELECT tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),{_tree_sql("top", _SUBROOTS)}{_fold_sql("inner_fold", "nodes", _TAMPERED)}
inner_end AS (
  SELECT r, max_by(h, level) AS h, max_by(proof, level) AS proof FROM inner_fold GROUP BY r),{_fold_sql("outer_fold", "top", _FOLDED)}
outer_end AS (SELECT r, max_by(h, level) AS h, max_by(proof, level) AS proof FROM outer_fold GROUP BY r),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root,
       e.h = root.h AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN outer_end e ON e.r = p.r, root
"""
