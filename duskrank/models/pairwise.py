"""Factor models with negative samples (BPR, WARP or skip-gram loss), trained in cells of bounded size.

The entries of every item block are cut into cells of a bounded number of entries; a very active user has
copies in several cells. In a round all cells work in parallel: a task goes a few epochs over its cell,
updating its own copies of the cell's users and of the block's items; the changes of all copies are then
merged by key. So a round is one shuffle of the state, and users move once per round however many blocks there are.

Users and items may have side features, tables (id, feature, value): every (feature, value) has a vector
and a bias of its own, and what a user or item enters the loss with is its own vector plus those of its values.
Values are merged like items, one copy from every cell that used them. An id that is known by its values only
(no entry in the training set) gets the sum of their vectors.

Negatives come from the block, drawn by a hash of (seed, epoch, user, item, draw), so reruns agree: alike for
the ranking losses, by count^0.75 (from an alias table of the block) for the skip-gram loss.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import dense_index
from duskrank.models.als import indexed
from duskrank.models.blocks import ROWS_PER_CELL, balanced_cells, restore_ids, stack
from duskrank.session import cut

# fixed values: most negatives tried per positive, margin of the ranking loss
MAX_DRAWS = 10
MARGIN = 1.0
# negatives per positive of the skip-gram loss, and the power of an item's count that they follow
NEGATIVES = 5
NEGATIVE_POWER = 0.75
# kinds of state rows: users, items, and the values of their features
USER, ITEM, USER_VALUE, ITEM_VALUE = "u", "i", "a", "b"
_COPY = "kind string, id int, features array<double>, bias double, seen double, bias_seen double"


def _initial(index: DataFrame, kind: str, number: str, width: int, seed: int) -> DataFrame:
    """Small centred vectors from hashes, zero biases."""
    unit = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda k: (F.pmod(F.xxhash64(F.col(number), F.lit(seed), k), F.lit(1 << 30)) / float(1 << 30) - 0.5) / width,
    )
    return index.select(
        F.lit(kind).alias("kind"),
        F.col(number).alias("id"),
        unit.alias("features"),
        F.lit(0.0).alias("bias"),
        F.lit(1.0).alias("seen"),
        F.lit(1.0).alias("bias_seen"),
    )


def _hashes(users, items, epoch: int, seed: int, count: int) -> np.ndarray:
    """Pseudo-random 64-bit numbers, a (rows, count) matrix that depends only on its arguments."""
    mixed = (
        users.astype("uint64")[:, None] * np.uint64(0x9E3779B97F4A7C15)
        ^ items.astype("uint64")[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        ^ np.arange(count, dtype="uint64")[None, :] * np.uint64(0x165667B19E3779F9)
        ^ np.array([(seed * 1_000_003 + epoch) & 0xFFFFFFFF], dtype="uint64") * np.uint64(0xD6E8FEB86659FD93)
    )
    for _ in range(2):
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def alias_table(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance to stay, where to go otherwise) per slot, so that an even slot and one coin follow ``weight``."""
    size = len(weight)
    if weight.sum() <= 0:
        return np.ones(size), np.arange(size)
    stay = weight * (size / weight.sum())
    other = np.arange(size)
    poor = [k for k in range(size) if stay[k] < 1.0]
    rich = [k for k in range(size) if stay[k] >= 1.0]
    while poor and rich:
        low, high = poor.pop(), rich[-1]
        other[low] = high
        stay[high] -= 1.0 - stay[low]
        if stay[high] < 1.0:
            poor.append(rich.pop())
    for k in poor + rich:  # what rounding left over
        stay[k] = 1.0
    return stay, other


def drawn(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Slots drawn by an alias table: the hash's remainder is the slot, its upper bits the coin."""
    stay, other = table
    slot = (hashes % np.uint64(len(stay))).astype("int64")
    coin = (hashes >> np.uint64(11)).astype("float64") * 2.0**-53
    return np.where(coin < stay[slot], slot, other[slot])


class _Table:
    """Vectors and biases of one kind in a cell, with AdaGrad sums and the number of steps per row."""

    def __init__(self, rows: pd.DataFrame):
        self.id = rows["id"].to_numpy()
        self.x = stack(rows["features"]).astype("float64")
        self.b = rows["bias"].to_numpy(dtype="float64", copy=True)
        self.gx = rows["seen"].to_numpy(dtype="float64", copy=True)
        self.gb = rows["bias_seen"].to_numpy(dtype="float64", copy=True)
        self.n = np.zeros(len(rows), dtype="int64")

    def step(self, at: np.ndarray, grad: np.ndarray, bias_grad: np.ndarray, rate: float) -> None:
        slot, where = np.unique(at, return_inverse=True)
        g, gb = np.zeros((len(slot), grad.shape[1])), np.zeros(len(slot))
        np.add.at(g, where, grad)
        np.add.at(gb, where, bias_grad)
        self.gx[slot] += (g * g).mean(axis=1)
        self.gb[slot] += gb * gb
        self.x[slot] += rate * g / np.sqrt(self.gx[slot])[:, None]
        self.b[slot] += rate * gb / np.sqrt(self.gb[slot])
        self.n[slot] += np.bincount(where, minlength=len(slot))

    def changed(self, kind: str) -> pd.DataFrame:
        keep = self.n > 0
        return pd.DataFrame(
            {
                "kind": kind,
                "id": self.id[keep],
                "features": list(self.x[keep]),
                "bias": self.b[keep],
                "seen": self.gx[keep],
                "bias_seen": self.gb[keep],
            }
        )


class _Side:
    """Users or items of a cell: own rows plus the rows of their values."""

    def __init__(self, state: pd.DataFrame, kind: str, value_kind: str):
        rows = state[state["kind"] == kind].sort_values("id")
        self.kinds = kind, value_kind
        self.own = _Table(rows)
        self.values = _Table(state[state["kind"] == value_kind].sort_values("id"))
        lists = [np.asarray(v) if v is not None else np.empty(0, "int64") for v in rows["values"]]
        self.start = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype("int64")
        flat = np.concatenate(lists) if len(self.values.id) else np.empty(0, "int64")
        self.at_value = np.searchsorted(self.values.id, flat)

    def _of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, row of the value) for all values of the rows ``at``, in order of place."""
        sizes = self.start[at + 1] - self.start[at]
        first = np.cumsum(sizes) - sizes
        places = np.repeat(np.arange(len(at)), sizes)
        return places, self.at_value[np.arange(len(places)) - first[places] + self.start[at][places]]

    def vectors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and biases that the rows ``at`` (any shape) enter the loss with."""
        rows = at.ravel()
        x, b = self.own.x[rows], self.own.b[rows]
        if len(self.at_value):
            places, values = self._of(rows)
            if len(places):
                first = np.flatnonzero(np.diff(places, prepend=-1))
                x[places[first]] += np.add.reduceat(self.values.x[values], first, axis=0)
                b[places[first]] += np.add.reduceat(self.values.b[values], first)
        return x.reshape(*at.shape, -1), b.reshape(at.shape)

    def step(self, at: np.ndarray, grad: np.ndarray, bias_grad: np.ndarray, rate: float) -> None:
        """The gradient of a row goes to its own vector and to those of its values alike."""
        if len(self.at_value):
            places, values = self._of(at)
            if len(places):
                self.values.step(values, grad[places], bias_grad[places], rate)
        self.own.step(at, grad, bias_grad, rate)

    def changed(self) -> list[pd.DataFrame]:
        return [self.own.changed(self.kinds[0]), self.values.changed(self.kinds[1])]


def _trainer(loss: str, epochs: range, seed: int, rate: float, batch: int):
    """One cell: stochastic steps with per-row AdaGrad scaling, ``epochs`` times over its positives."""

    def run(positives: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        U, V = _Side(state, USER, USER_VALUE), _Side(state, ITEM, ITEM_VALUE)
        if positives.empty or not len(U.own.id) or not len(V.own.id):
            return pd.concat(U.changed())
        liked = positives.sort_values(["u", "i"])
        u_at = np.searchsorted(U.own.id, liked["u"].to_numpy())
        i_at = np.searchsorted(V.own.id, liked["i"].to_numpy())
        weight = liked["weight"].to_numpy(dtype="float64")
        size = len(V.own.id)
        owned = np.unique(u_at * size + i_at)
        tries = {"warp": MAX_DRAWS, "skipgram": NEGATIVES, "bpr": 1}[loss]
        liked_u, liked_i = liked["u"].to_numpy(), liked["i"].to_numpy()
        if loss == "skipgram":
            counts = state[state["kind"] == ITEM].sort_values("id")["total"].to_numpy(dtype="float64")
            table = alias_table(counts**NEGATIVE_POWER)

        def batches():
            for epoch in epochs:
                shuffled = np.argsort(_hashes(liked_u, liked_i, epoch, seed + 1, 1)[:, 0], kind="stable")
                for start in range(0, len(shuffled), batch):
                    yield epoch, shuffled[start : start + batch]

        for epoch, rows in batches():
            ua, ia, w = u_at[rows], i_at[rows], weight[rows]
            hashes = _hashes(liked_u[rows], liked_i[rows], epoch, seed, tries)
            cand = drawn(hashes, table) if loss == "skipgram" else (hashes % np.uint64(size)).astype("int64")
            code = ua[:, None] * size + cand
            at = np.minimum(np.searchsorted(owned, code), len(owned) - 1)
            fresh = owned[at] != code
            uv, _ = U.vectors(ua)
            pv, p_bias = V.vectors(ia)
            nv, n_bias = V.vectors(cand)
            good = (uv * pv).sum(axis=1) + p_bias
            bad = np.einsum("rk,rtk->rt", uv, nv) + n_bias
            if loss == "skipgram":
                # logistic loss, without biases: the pair is real, the drawn pairs are not
                up = w / (1.0 + np.exp(np.clip(good, -50, 50)))
                down = fresh * w[:, None] / (1.0 + np.exp(np.clip(-bad, -50, 50)))
                U.step(ua, up[:, None] * pv - np.einsum("rt,rtk->rk", down, nv), np.zeros(len(ua)), rate)
                push = -(down[:, :, None] * uv[:, None, :]).reshape(-1, uv.shape[1])
                at_items = np.concatenate([ia, cand.ravel()])
                V.step(at_items, np.concatenate([up[:, None] * uv, push]), np.zeros(len(at_items)), rate)
                continue
            if loss == "warp":
                hit = fresh & (bad > good[:, None] - MARGIN)
                first = hit.argmax(axis=1)
                use = hit.any(axis=1)
                # negatives come from the block, so the estimated rank is the one within the block
                rank = np.floor((size - 1) / (first + 1.0))
                pull = w * np.log(np.maximum(rank, 1.0))
                # the customary cap keeps one lucky draw from throwing the factors about
                pull = np.minimum(pull, 10.0)
            else:
                first = np.zeros(len(rows), dtype="int64")
                use = fresh[:, 0]
                pull = w / (1.0 + np.exp(np.clip(good - bad[:, 0], -50, 50)))
            if not use.any():
                continue
            chosen = np.arange(len(rows)), first
            ua, ia, na = ua[use], ia[use], cand[chosen][use]
            pull, uv, pv, nv = pull[use], uv[use], pv[use], nv[chosen][use]
            U.step(ua, pull[:, None] * (pv - nv), np.zeros(len(ua)), rate)
            both = np.concatenate([pull[:, None] * uv, -pull[:, None] * uv])
            V.step(np.concatenate([ia, na]), both, np.concatenate([pull, -pull]), rate)
        return pd.concat([*U.changed(), *V.changed()], ignore_index=True)

    return run


def _merge(old: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    """One state per row from its R changed copies: old + sum of changes / sqrt(R), squared gradients added up.

    That is the length of step AdaGrad would take for the summed squared gradients when the copies moved
    alike. Rows that no cell changed keep their state; a row with a single copy takes that copy's.
    """
    sums = copies.groupBy("kind", "id").agg(
        F.count(F.lit(1)).cast("double").alias("_r"),
        F.array(*[F.sum(F.get("features", F.lit(k))) for k in range(width)]).alias("_features"),
        *[F.sum(c).alias(f"_{c}") for c in ("bias", "seen", "bias_seen")],
    )

    def moved(before: Column, total: Column) -> Column:
        return before + (total - F.col("_r") * before) / F.sqrt("_r")

    def added(before: Column, total: Column) -> Column:
        return before + total - F.col("_r") * before

    vectors = F.zip_with("features", "_features", moved)
    return old.join(sums, ["kind", "id"], "left").select(
        "kind",
        "id",
        F.coalesce(vectors, "features").alias("features"),
        F.coalesce(moved(F.col("bias"), F.col("_bias")), "bias").alias("bias"),
        *[F.coalesce(added(F.col(c), F.col(f"_{c}")), c).alias(c) for c in ("seen", "bias_seen")],
    )


class _Values:
    """Numbered values of one side's features, and which of the side's numbered ids have them."""

    def __init__(self, features: DataFrame, index: DataFrame, key: str, number: str):
        kind = index.schema[key].dataType
        named = F.struct(F.col("feature").cast("string").alias("feature"), F.col("value").cast("string").alias("value"))
        held = features.select(F.col("id").cast(kind).alias("id"), "feature", "value").dropna()
        held = held.select("id", named.alias("name")).distinct()
        self.index = cut(dense_index(held, "name", "v"), "values")
        self.held = cut(held.join(self.index, "name").select("id", "v"), "held_values")
        self.numbered = cut(self.held.join(index.withColumnRenamed(key, "id"), "id").select(number, "v"), "numbered_values")

    def lists(self, number: str) -> DataFrame:
        """(number, values): the values of one id as an array."""
        return self.numbered.groupBy(number).agg(F.sort_array(F.collect_list("v")).alias("values"))

    def table(self, state: DataFrame) -> DataFrame:
        """feature, value, features, bias."""
        return state.join(self.index.withColumnRenamed("v", "id"), "id").select("name.feature", "name.value", "features", "bias")


def _summed(own: DataFrame, values: _Values, state: DataFrame, width: int) -> DataFrame:
    """(id, features, bias): own vectors plus those of the values, for the ids that have either."""
    met = values.held.join(state.withColumnRenamed("id", "v"), "v")
    sums = met.groupBy("id").agg(
        F.array(*[F.sum(F.get("features", F.lit(k))) for k in range(width)]).alias("_features"), F.sum("bias").alias("_bias")
    )
    vectors = F.coalesce(F.zip_with("features", "_features", lambda x, y: x + y), "features", "_features")
    return own.join(sums, "id", "full").select(
        "id", vectors.alias("features"), (F.coalesce("bias", F.lit(0.0)) + F.coalesce("_bias", F.lit(0.0))).alias("bias")
    )


def fit_pairwise(
    train: DataFrame,
    n_factors: int = 10,
    epochs: int = 10,
    loss: str = "bpr",
    seed: int = 42,
    rate: float = 0.05,
    block: int = 65536,
    rows_per_cell: int = ROWS_PER_CELL,
    batch: int = 64,
    local_epochs: int = 5,
    user_features: DataFrame | None = None,
    item_features: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Factor tables ``users`` and ``items`` with (id, features, bias).

    Only positive weights are positives (a row's weight scales its steps); ids that occur with other
    weights get vectors too. Tasks exchange vectors after every ``local_epochs`` epochs. ``rows_per_cell``
    bounds the entries of one task and so decides how many copies are merged: it is a parameter of the fit.

    ``user_features`` and ``item_features`` are tables (id, feature, value) of categorical values; rows with a
    null are dropped, repeats count once. With them, ids known by their values only have vectors as
    well, and ``user_values`` and ``item_values`` (feature, value, features, bias) are returned too.
    """
    if loss not in ("bpr", "warp", "skipgram"):
        raise ValueError(f"unknown loss {loss!r}")
    entries, users, items, _ = indexed(train)
    cells = balanced_cells(entries.filter("weight > 0"), block, rows_per_cell)
    a = _Values(user_features, users, "user_id", "u") if user_features is not None else None
    b = _Values(item_features, items, "item_id", "i") if item_features is not None else None

    none = F.lit(None).cast("array<int>")
    totals = cells.entries.groupBy("i").agg(F.sum("weight").alias("total"))
    held = items.select("i", F.floor(F.col("i") / block).cast("int").alias("q")).join(totals, "i", "left")
    held = held.join(b.lists("i"), "i", "left") if b else held.withColumn("values", none)
    held = cells.cells.join(held, "q")
    lent = cells.members.join(a.lists("u"), "u", "left") if a else cells.members.withColumn("values", none)
    columns = ["q", "c", "kind", "id", "total", "values"]
    needed = [
        lent.withColumns({"kind": F.lit(USER), "id": F.col("u"), "total": F.lit(0.0)}).select(*columns),
        held.withColumns({"kind": F.lit(ITEM), "id": F.col("i"), "total": F.coalesce("total", F.lit(0.0))}).select(*columns),
    ]
    for rows, kind, given in ((lent, USER_VALUE, a), (held, ITEM_VALUE, b)):
        if given:
            one = rows.select("q", "c", F.explode("values").alias("id")).distinct()
            needed.append(one.withColumns({"kind": F.lit(kind), "total": F.lit(0.0), "values": none}).select(*columns))
    wanted = needed[0]
    for rows in needed[1:]:
        wanted = wanted.unionByName(rows)
    wanted = cut(wanted, "wanted")

    state = _initial(users, USER, "u", n_factors, seed).unionByName(_initial(items, ITEM, "i", n_factors, seed + 7))
    for given, kind, shift in ((a, USER_VALUE, 13), (b, ITEM_VALUE, 19)):
        if given:
            state = state.unionByName(_initial(given.index, kind, "v", n_factors, seed + shift))
    for first in range(0, epochs, local_epochs):
        span = range(first, min(first + local_epochs, epochs))
        copies = wanted.join(state, ["kind", "id"]).groupBy("q", "c")
        trained = cells.entries.groupBy("q", "c").cogroup(copies).applyInPandas(
            _trainer(loss, span, seed, rate, batch), _COPY
        )
        state = cut(_merge(state, cut(trained, "pairwise_copies"), n_factors), "pairwise", "kind")
    own = {kind: state.filter(F.col("kind") == kind).drop("kind") for kind in (USER, ITEM, USER_VALUE, ITEM_VALUE)}
    out = {}
    for name, kind, value_kind, index, key, number, given in (
        ("user", USER, USER_VALUE, users, "user_id", "u", a),
        ("item", ITEM, ITEM_VALUE, items, "item_id", "i", b),
    ):
        vectors = restore_ids(own[kind].select(F.col("id").alias(number), "features", "bias"), index, key, number)
        if given:
            out[f"{name}_values"] = given.table(own[value_kind])
            vectors = _summed(vectors, given, own[value_kind].select("id", "features", "bias"), n_factors)
        out[f"{name}s"] = vectors
    return out

