"""Near-duplicates by ProbMinHash signatures of weighted word shingles, banding, and exact verification.

A text's shingles are its runs of ``SHINGLE`` words, weighted by how often they occur (a text of fewer
words is one shingle). Similarity is the probability Jaccard index: the chance that independent
exponential clocks, one per shingle and running at the shingle's weight, ring first at the same shingle
in both texts; for weights of one it is the Jaccard index. Each signature component is such a first
ring: every shingle is a Poisson process with its weight as rate, each arrival falls into a random
component, and a shingle stops as soon as its next arrival is later than the latest component.

Texts are compared as follows. Equal texts are one node. ``BANDS`` bands of ``ROWS`` components put a
node into that many buckets. In a bucket, every member is compared with one pivot, its least member; the
links found give components. A pair of similarity s shares a bucket with probability
1 - (1 - s^ROWS)^BANDS: 0.99997 at 0.8, 0.3 at 0.5 and 0.01 at 0.3, so texts that have just a common
passage seldom meet.

Members that the pivot leaves in several components meet by prefixes. Let u and w be the shares of two
texts' weight that lie on shingles the other text lacks. Their similarity is at most
1 / (1 + u / (1 - u) + w / (1 - w)). With the shingles of every text in one order, the rarest first, all
that stands before the first common shingle counts in u and w; so a pair at the threshold t has a common
shingle before which each text has at most 1 - t of its weight, and odds of at most 1 / t - 1 in sum. Texts
of m and n shingles, none of them repeated, share as many on either side; so the number of shingles from the
first common one on, in either text, is at least (m + n) / (1 + 1 / t). Only
pairs of different components that have such a shingle are verified: first with one text for each
shingle, that of least odds, which ends most splits, then all that are left. So no link inside a bucket
that would join two components is lost, and texts from one template meet only where their own parts are
small enough for a link.

Null texts are alone; texts without words equal only exact copies of themselves. Rows with equal text
are of one class whatever their ids; a class is named by its least document id (null if it has none).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskrank.llm.common import slices
from duskrank.llm.components import components
from duskrank.session import cut

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 45, 7
COMPONENTS = BANDS * ROWS
CACHED_WORDS = 100_000
ROUNDING = 1e-9  # of sums of shares; lets a pair at the very threshold through to the exact test

_U = np.uint64
_GOLD, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) < 100:
            self[word] = h
        return h


_HASHES = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Hashes of the shingles in order, repeats included."""
    words = text.encode().split()  # of bytes: the six white-space characters of the word rule
    if not words:
        return np.empty(0, dtype=_U)
    codes = np.fromiter(map(_HASHES.__getitem__, words), dtype=_U, count=len(words))
    size = min(SHINGLE, len(words))
    out = np.zeros(len(words) - size + 1, dtype=_U)
    for k in range(size):
        out = mix(out + _GOLD) ^ codes[k : k + len(out)]
    return mix(out)


def signatures(texts: list[np.ndarray]) -> np.ndarray:
    """(texts x COMPONENTS) shingles that ring first; texts without shingles have undefined rows."""
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = np.concatenate([np.sort(t) for t in texts]) if texts else np.empty(0, dtype=_U)
    first = np.ones(len(code), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    start = np.flatnonzero(first)
    weight = np.diff(np.append(start, len(code))).astype(np.float64)
    doc, code = doc[start], code[start]

    rings = np.full(len(texts) * COMPONENTS, np.inf)
    winner = np.zeros(len(texts) * COMPONENTS, dtype=_U)
    time, turn = np.zeros(len(code)), 0
    while len(code):
        turn += 1
        bits = mix(code + np.array([turn], dtype=_U) * _GOLD)
        time = time - np.log1p(-((bits >> _U(11)).astype(np.float64) * 2.0**-53)) / weight
        part = (mix(bits ^ _MIX1) % _U(COMPONENTS)).astype(np.int64)
        slot = doc * COMPONENTS + part
        better = np.flatnonzero(time < rings[slot])
        better = better[np.argsort(-time[better], kind="stable")]  # of several in a slot the earliest is written last
        rings[slot[better]], winner[slot[better]] = time[better], code[better]
        # a process whose last arrival is later than all components can change nothing any more
        open_docs = np.unique(doc)
        latest = np.zeros(len(texts))
        latest[open_docs] = rings.reshape(-1, COMPONENTS)[open_docs].max(axis=1)
        alive = time < latest[doc]
        doc, code, weight, time = doc[alive], code[alive], weight[alive], time[alive]
    return winner.reshape(-1, COMPONENTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts x BANDS) bucket keys, as signed 64-bit integers."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U) * _GOLD), rows.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out + _GOLD) ^ rows[:, :, k]
    return mix(out).astype(np.int64)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two shingle lists."""
    a, x = np.unique(a, return_counts=True)
    b, y = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return len(i) / (len(a) + len(b) - len(i))
    cx, cy = x[i].astype(float), y[j].astype(float)
    only_x, only_y = x.sum() - cx.sum(), y.sum() - cy.sum()
    ratio = cy / cx
    order = np.argsort(ratio, kind="stable")
    ratio, cx, cy = ratio[order], cx[order], cy[order]
    up_to = np.searchsorted(ratio, ratio, "right")
    sum_x = np.concatenate(([0.0], np.cumsum(cx)))[up_to] + only_x
    sum_y = cy.sum() - np.concatenate(([0.0], np.cumsum(cy)))[up_to] + only_y
    return float((1.0 / (sum_x / cx + sum_y / cy)).sum())


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        found = [shingles(t) if t else np.empty(0, dtype=_U) for t in texts]
        keys = band_keys(signatures(found))
        digests = [hashlib.md5(t.encode(), usedforsecurity=False).digest() if t is not None else None for t in texts]
        lists = [k.tolist() if len(f) else [] for k, f in zip(keys, found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
            ["doc_id", "digest", "bands"],
        )


def _verified(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            ok = []
            for k in range(batch.num_rows):
                if v[k] != last:  # rows come sorted by pivot where the join sorts
                    last, pivot = v[k], shingles(batch.column("pivot_text")[k].as_py())
                ok.append(probability_jaccard(shingles(batch.column("text")[k].as_py()), pivot) >= threshold)
            kept = [k for k, good in enumerate(ok) if good]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for k in kept], pa.int64()) for x in (u, v)], ["u", "v"]
            )

    return run


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of a text's weight that each of its shingles has, and their number if none is repeated."""
    for batch in slices(batches, "text"):
        nodes, codes, weights, sizes = [], [], [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            code, n = np.unique(shingles(text), return_counts=True)
            nodes.append(np.full(len(code), node))
            codes.append(code.view(np.int64))
            weights.append(n / n.sum())
            sizes += [len(code) if n.max() == 1 else None] * len(code)
        arrays = [pa.array(np.concatenate(x)) for x in (nodes, codes, weights)] + [pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "shingle", "share", "size"])


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds each node's component: its own number if it has no link."""
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pairs(met: DataFrame, a: Column, b: Column) -> DataFrame:
    return met.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


class NearDuplicates:
    """The state of a search: nodes (distinct texts), their buckets, and the texts of compared nodes."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD):
        self.docs, self.threshold = docs.select(F.col("doc_id").cast("long"), "text"), threshold
        self.rows = cut(
            self.docs.mapInArrow(_signed, "doc_id long, digest binary, bands array<long>"), "signatures"
        )
        groups = self.rows.filter("digest IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")
        )
        self.nodes = cut(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
        keyed = self.nodes.select("node", F.explode("bands").alias("key"))
        pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("_n"))
        self.buckets = cut(keyed.join(pivots.filter("_n > 1").drop("_n"), "key"), "buckets")
        self.texts = cut(self._texts(), "texts")

    def _texts(self) -> DataFrame:
        """(node, text) of the nodes that share a bucket with another node."""
        shared = self.buckets.select("node").distinct()
        wanted = self.nodes.join(shared, "node").select("node", "digest", F.col("doc_id").alias("_id"))
        rows = self.docs.withColumn("_digest", F.unhex(F.md5(F.col("text").cast("binary"))))
        met = rows.join(wanted, (rows["_digest"] == wanted["digest"]) & rows["doc_id"].eqNullSafe(wanted["_id"]))
        return met.groupBy("node").agg(F.first("text").alias("text"))

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u: member, v: pivot) that are similar enough."""
        members = pairs.join(self.texts.withColumnRenamed("node", "u"), "u")
        pivots = self.texts.select(F.col("node").alias("v"), F.col("text").alias("pivot_text"))
        both = members.join(pivots, "v").select("u", "v", "text", "pivot_text")
        return both.mapInArrow(_verified(self.threshold), "u long, v long")

    def components(self) -> DataFrame:
        """(node, component) of the nodes that have a link."""
        members = self.buckets.filter("node <> pivot")
        compared = cut(members.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), "pairs")
        links = cut(self._links(compared), "found")
        found = cut(components(links), "components")
        placed = cut(self._prefixes(self._split(members, found)), "prefixes")
        for meet in (self._hub_pairs, self._all_pairs):
            pairs = cut(meet(_named(placed, found)).join(compared, ["u", "v"], "left_anti"), "pairs")
            if pairs.limit(1).count():
                compared = compared.unionByName(pairs)
                links = links.unionByName(cut(self._links(pairs), "found"))
                found = cut(components(links), "components")
        return found

    @staticmethod
    def _split(members: DataFrame, found: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component beside the pivot."""
        named = _named(members, found)
        spans = named.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
        return named.join(spans.filter("_least <> _most").select("key"), "key", "left_semi").select("node").distinct()

    def _prefixes(self, nodes: DataFrame) -> DataFrame:
        """(node, shingle, odds, size, room): the shingles at which a link of the node can first meet the other text.

        The rarity that orders the shingles is counted over ``nodes``; any order would give the same links.
        """
        shares = self.texts.join(nodes, "node", "left_semi").mapInArrow(_shares, "node long, shingle long, share double, size long")
        shares = cut(shares, "shares")
        held = shares.groupBy("shingle").agg(F.count(F.lit(1)).alias("_held"))
        rarest = Window.partitionBy("node").orderBy("_held", "shingle").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("share").over(rarest), F.lit(0.0))
        placed = shares.join(held, "shingle").withColumn("_before", before)
        near = placed.filter((F.col("_held") > 1) & (F.col("_before") <= 1 - self.threshold + ROUNDING))
        room = (F.col("size") * (1 - F.col("_before"))).alias("room")
        return near.select("node", "shingle", (F.col("_before") / (1 - F.col("_before"))).alias("odds"), "size", room)

    def _may_link(self, a: str, b: str) -> Column:
        """Whether the prefixes ``a`` and ``b``, met at their first common shingle, leave room for a link."""
        limit = 1 / self.threshold
        by_odds = F.col(f"{a}.odds") + F.col(f"{b}.odds") <= limit - 1 + ROUNDING
        least = F.least(f"{a}.room", f"{b}.room") * (limit + 1) + ROUNDING * F.col(f"{a}.size")
        by_size = F.col(f"{a}.size") + F.col(f"{b}.size") <= least
        return by_odds & F.coalesce(by_size, F.lit(True))

    def _hub_pairs(self, placed: DataFrame) -> DataFrame:
        """Every node with the hub of each of its shingles: the node of least odds."""
        least = F.min(F.struct("odds", "node", "component", "size", "room"))
        hubs = placed.groupBy("shingle").agg(least.alias("hub")).select("shingle", "hub.*")
        on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component"))
        met = placed.alias("a").join(hubs.alias("b"), on & self._may_link("a", "b"))
        return _pairs(met, F.col("a.node"), F.col("b.node"))

    def _all_pairs(self, placed: DataFrame) -> DataFrame:
        """Every node outside the largest component of a shingle with the shingle's nodes of other components."""
        sizes = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("_n"))
        main = sizes.groupBy("shingle").agg(
            F.max_by("component", F.struct("_n", "component")).alias("main"), F.count(F.lit(1)).alias("_components")
        )
        met = placed.join(main.filter("_components > 1").drop("_components"), "shingle")
        small = met.filter("component <> main").alias("a")
        on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component"))
        met = small.join(met.alias("b"), on & self._may_link("a", "b"))
        return _pairs(met, F.col("a.node"), F.col("b.node"))

    def classes(self) -> DataFrame:
        """(doc_id, digest, class_id, class_node): one row per row of the documents; node null for null texts."""
        found = self.components()
        named = self.nodes.join(found, "node", "left").withColumn("class_node", F.coalesce("component", "node"))
        ids = named.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
        named = named.select("digest", "class_node").join(ids, "class_node")
        rows = self.rows.select("doc_id", "digest").join(named, "digest", "left")
        return rows.withColumn("class_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id for every row of ``docs`` (doc_id, text)."""
    return NearDuplicates(docs, threshold).classes().select("doc_id", "class_id")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the least document id, then of the least text digest.

    Null ids come last. Rows with null texts all stay.
    """
    classes = cut(NearDuplicates(docs, threshold).classes(), "classes").filter("digest IS NOT NULL")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "digest")).alias("best")
    chosen = classes.groupBy("class_node").agg(best).select(
        F.col("best.doc_id").alias("_near_id"), F.col("best.digest").alias("_near_digest")
    )
    copies = classes.groupBy(F.col("doc_id").alias("_i"), F.col("digest").alias("_d")).agg(F.count(F.lit(1)).alias("_near_n"))
    on = chosen["_near_id"].eqNullSafe(copies["_i"]) & (chosen["_near_digest"] == copies["_d"])
    chosen = chosen.join(copies, on).select("_near_id", "_near_digest", "_near_n")
    keyed = docs.withColumn("_near_text", F.unhex(F.md5(F.col("text").cast("binary"))))
    on = keyed["doc_id"].cast("long").eqNullSafe(chosen["_near_id"]) & (keyed["_near_text"] == chosen["_near_digest"])
    met = keyed.join(chosen, on)
    once, repeated = met.filter("_near_n = 1"), met.filter("_near_n > 1").dropDuplicates(["_near_id", "_near_text"])
    kept = once.select(*docs.columns).unionByName(repeated.select(*docs.columns))
    return kept.unionByName(docs.filter("text IS NULL"))
