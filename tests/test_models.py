"""First-stage models against dense linear algebra and planted preferences."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskrank.models import als, ease, pairwise, sequence, svd
from duskrank.operators import metrics, scoring
from duskrank.models.blocks import balanced_cells
from duskrank.operators import features
from duskrank.plans import fleet

SCHEMA = "user_id long, item_id long, weight double, datetime long, pos long"


@pytest.fixture(scope="module")
def sparse(spark):
    """Random weights with repeats, negative values, large ids, and one user that has every item."""
    rng = np.random.default_rng(5)
    rows = [(10**10 + u, 3 * int(i), float(rng.choice([1, 1, 2, -1])), 1, k) for u in range(40) for k, i in enumerate(rng.integers(0, 23, 9))]
    rows += [(7, 3 * i, 1.0, 1, i) for i in range(23)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def dense(df):
    sums = df.toPandas().groupby(["user_id", "item_id"], as_index=False)["weight"].sum()
    users, items = np.sort(sums.user_id.unique()), np.sort(sums.item_id.unique())
    x = np.zeros((len(users), len(items)))
    x[np.searchsorted(users, sums.user_id), np.searchsorted(items, sums.item_id)] = sums.weight
    return x, users, items


@pytest.mark.parametrize("block", [100, 5])
def test_ease_matches_dense_inverse(spark, sparse, block):
    x, _, items = dense(sparse)
    p = np.linalg.inv(x.T @ x + 3.0 * np.eye(len(items)))
    want = -p / np.diag(p)[None, :]
    np.fill_diagonal(want, 0.0)
    model = ease.fit_ease(sparse, 3.0, 1000, block)
    table = ease.weight_table(model).toPandas()
    got = np.zeros_like(want)
    got[np.searchsorted(items, table.item_j), np.searchsorted(items, table.item_i)] = table.b
    assert len(table) == want.size
    np.testing.assert_allclose(got, want, atol=1e-6)

    pairs = spark.createDataFrame([(7, 3), (10**10, 9), (10**10, 10**6), (-1, 3)], "user_id long, item_id long")
    scores = {(r.user_id, r.item_id): (r.predict, r.is_cold) for r in ease.score_ease(pairs, sparse, model).collect()}
    history = sparse.toPandas()
    for user, item in ((7, 3), (10**10, 9)):
        seen = history[history.user_id == user].item_id  # repeats count repeatedly
        total = sum(want[np.searchsorted(items, j), np.searchsorted(items, item)] for j in seen)
        assert scores[user, item] == (pytest.approx(total, abs=1e-6), False)
    assert scores[10**10, 10**6] == scores[-1, 3] == (-1.0, True)


def test_gram_portions(spark, sparse, monkeypatch):
    monkeypatch.setattr(ease, "_PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(ease, "_SUMS_HELD", 10)
    x, _, items = dense(sparse)
    codes, values = [], []
    sums = sparse.toPandas().groupby(["user_id", "item_id"], as_index=False)["weight"].sum().sort_values(["user_id", "item_id"])
    sums["i"] = np.searchsorted(items, sums.item_id)
    batch = sums.rename(columns={"user_id": "u"})[["u", "i", "weight"]].reset_index(drop=True)
    batch = batch.assign(a=0, b=0, second=False)
    parts = [batch.iloc[:50], batch.iloc[50:51], batch.iloc[51:]]
    for out in ease._gram_of_partition(len(items))(iter(parts)):
        codes.append(out["j"].to_numpy() * len(items) + out["i"].to_numpy())
        values.append(out["g"].to_numpy())
    assert len(codes) > 1
    got = np.zeros(len(items) ** 2)
    np.add.at(got, np.concatenate(codes), np.concatenate(values))
    np.testing.assert_allclose(got.reshape(x.shape[1], -1), np.triu(x.T @ x), atol=1e-9)


def test_pairs_of_a_user_with_half_the_entries_are_spread(spark):
    rng = np.random.default_rng(7)
    x = np.zeros((30, 300))
    x[0, :200] = rng.normal(size=200)
    for u in range(1, 30):
        x[u, rng.choice(300, 7, replace=False)] = rng.normal(size=7)
    entries = spark.createDataFrame([(int(u), int(i), float(x[u, i])) for u, i in zip(*np.nonzero(x))], "u long, i int, weight double")
    for chunk in (16, 1000):
        cells = ease.user_cells(entries, chunk).toPandas()
        sizes = cells.groupby(["u", "a", "b"]).size()
        assert len(sizes.loc[0]) == (13 * 14 // 2 if chunk == 16 else 1) and (chunk != 16 or sizes.max() <= 60)
        assert (cells[cells.u != 0].groupby("u").size() == 7).all()  # other users have no copies
        got = np.zeros((300, 300))
        for r in ease.gram(entries, 300, chunk).collect():
            got[r.j, r.i] = r.g
        np.testing.assert_allclose(got, np.triu(x.T @ x), atol=1e-9)


def test_gram_keeps_the_most_frequent_items(spark):
    rows = [(1, 1, 1.0, 1, 1), (2, 1, 1.0, 1, 1), (1, 2, 1.0, 1, 2), (2, 3, 1.0, 1, 2)]
    table = ease.gram_table(spark.createDataFrame(rows, SCHEMA), 2)
    assert {(r.item_j, r.item_i): r.g for r in table.collect()} == {(1, 1): 2.0, (1, 3): 1.0, (3, 1): 1.0, (3, 3): 1.0}


@pytest.mark.parametrize("block,rows_per_cell", [(100, 150), (6, 20)])
def test_svd_matches_dense(spark, sparse, block, rows_per_cell):
    x, users, items = dense(sparse)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = (u[:, :4] * s[:4]) @ vt[:4]
    model = svd.fit_svd(sparse, 4, oversample=6, passes=2, block=block, rows_per_cell=rows_per_cell)
    pairs = sparse.select("user_id", "item_id").distinct()
    got = scoring.score_pairs(pairs, model["users"], model["items"]).toPandas()
    assert not got.is_cold.any()
    expected = want[np.searchsorted(users, got.user_id), np.searchsorted(items, got.item_id)]
    np.testing.assert_allclose(got.predict, expected, atol=1e-6)


def test_vectors_go_to_the_cells_that_need_them(spark, sparse):
    entries, users, items, _ = als.indexed(sparse)
    matrix = svd.grid(entries, 6, 20)
    cells = matrix.cells.entries.toPandas()
    assert len(cells) == sparse.select("user_id", "item_id").distinct().count()
    assert cells.groupby(["q", "c"]).size().max() <= 20 and (cells.i // 6 == cells.q).all()
    for index, by in ((users, "u"), (items, "i")):
        thin = index.select(by, F.array(F.lit(1.0)).alias("features"))
        sent = matrix.sent(thin, by).toPandas()
        want = cells[["q", "c", by]].drop_duplicates()
        assert len(sent) == len(want) < len(index.collect()) * cells[["q", "c"]].drop_duplicates().shape[0]
        assert set(sent[["q", "c", by]].itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def planted(spark):
    """Users like items of their own third; (train, test)."""
    rng = np.random.default_rng(0)
    rows = []
    for u in range(150):
        for k, i in enumerate(rng.choice(45, 20, replace=False)):
            liked = u % 3 == i % 3 and rng.random() < 0.95
            rows.append((u, int(i), 1.0 if liked else -1.0 if rng.random() < 0.3 else 0.0, 1, k))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "item_id", "weight", "datetime", "pos"]), SCHEMA)
    held = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(3)) == 0
    return df.filter(~held).cache(), df.filter(held).cache()


def auc(test, scored, name):
    joined = test.join(scored, ["user_id", "item_id"]).withColumn("target", F.col("weight").cast("int"))
    return metrics.mean_auc(joined, name).first()["mean_auc"]


@pytest.mark.parametrize("loss,block", [("bpr", 15), ("warp", 1000)])
def test_pairwise_learns(planted, loss, block):
    train, test = planted
    fit = lambda: pairwise.fit_pairwise(train, 8, 40, loss, block=block, rows_per_cell=400, rate=0.1, local_epochs=20)
    model = fit()
    scored = scoring.score_pairs_biased(test, model["users"], model["items"], "s")
    assert auc(test, scored, "s") > 0.62
    if loss == "warp":
        again = fit()
        a, b = (m["items"].orderBy("id").toPandas().features for m in (model, again))
        np.testing.assert_allclose(np.vstack(a), np.vstack(b), atol=1e-9)
    with pytest.raises(ValueError):
        pairwise.fit_pairwise(train, loss="other")


def test_als_and_ease_learn(planted):
    train, test = planted
    model = als.fit_als(train.filter("weight <> 0"), 8, 10.0, 0.05, 8)
    assert auc(test, scoring.score_pairs(test, model["users"], model["items"], "s"), "s") > 0.65
    liked = train.filter("weight > 0")
    model = ease.fit_ease(liked, 20.0)
    assert auc(test, ease.score_ease(test, liked, model, "s"), "s") > 0.65


def test_sequence_model(spark):
    rng = np.random.default_rng(2)
    rows = []
    for u in range(120):
        group = u % 2
        rows += [(u, int(group * 10 + i), 1.0, 1, k) for k, i in enumerate(rng.integers(0, 10, 30))]
    train = spark.createDataFrame(rows, SCHEMA)
    model = sequence.fit_sequence(train, 8, 6, min_count=1)
    pairs = spark.createDataFrame([(u, i) for u in range(20) for i in range(20)] + [(0, 999)], "user_id long, item_id long")
    scored = sequence.score_sequence(pairs, train, model, "s").toPandas()
    own = scored.user_id % 2 == scored.item_id // 10
    assert scored[own].s.mean() > scored[~own & ~scored.is_cold].s.mean()
    assert scored[scored.item_id == 999].s.tolist() == [-1.0]


def test_long_histories_are_cut_into_sentences(spark):
    rows = [(1, k, 1.0, 1, k) for k in range(2500)] + [(2, 5, 1.0, 1, 1)]
    train = spark.createDataFrame(rows, SCHEMA)
    for options in (dict(hot=False), dict(hot=True, limit=600)):
        lists = sorted((r["items"] for r in sequence.sentences(train, **options).collect()), key=len)
        assert [len(x) for x in lists] == [1, 500, 1000, 1000]
        joined = sorted((x for x in lists if len(x) > 1), key=lambda x: int(x[0]))
        assert [int(i) for x in joined for i in x] == list(range(2500))


def test_fleet_definition():
    assert len(fleet.FLEET) == 37 and len({m.name for m in fleet.FLEET}) == 37
    kinds = pd.Series([m.kind for m in fleet.FLEET]).value_counts().to_dict()
    assert kinds == {"als": 7, "pairwise": 18, "ease": 4, "svd": 4, "sequence": 4}
    assert len(fleet.SEARCH_FLEET) == 14


def test_many_item_blocks(planted):
    train, test = planted
    model = pairwise.fit_pairwise(train, 8, 20, "bpr", block=6, rows_per_cell=400, rate=0.1, local_epochs=10)
    assert model["items"].count() == train.select("item_id").distinct().count()
    scored = scoring.score_pairs_biased(test, model["users"], model["items"], "s")
    assert auc(test, scored, "s") > 0.55


def test_fit_does_not_follow_the_session(spark, planted):
    train, _ = planted
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        model = pairwise.fit_pairwise(train, 4, 2, "warp", block=20)
        found.append(np.vstack(model["items"].orderBy("id").toPandas().features))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    np.testing.assert_allclose(*found, atol=1e-9)


def test_pseudo_items_with_large_ids(spark, planted):
    train, _ = planted
    big = train.withColumn("item_id", F.col("item_id") + 1_000_000)
    items = big.select("item_id").distinct().withColumn("source_id", F.col("item_id") % 5)
    spec = next(m for m in fleet.FLEET if m.scope == "pseudo")
    params = fleet.FleetParams(pairwise_factors=4, pairwise_epochs=2)
    model = fleet.fit_model(spec, big, items, params)
    ids = {r["id"] for r in model["items"].select("id").collect()}
    assert ids == {r["item_id"] for r in items.collect()}
    assert ids.isdisjoint(range(5)) and model["users"].count() == big.select("user_id").distinct().count()


def test_cells_are_bounded_with_a_user_of_a_third(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, 1.0) for i in range(4000)] + [(int(u), int(i), 1.0) for u, i in zip(rng.integers(1, 900, 8000), rng.integers(0, 4000, 8000))]
    entries = spark.createDataFrame(rows, "u int, i int, weight double")
    cells = balanced_cells(entries, 2500, 500)
    found = cells.entries.toPandas()
    assert sorted(found[["u", "i", "weight"]].itertuples(index=False, name=None)) == sorted(rows)
    sizes = found.groupby(["q", "c"]).size()
    assert sizes.max() <= 500 and sizes.mean() > 250 and (found.i // 2500 == found.q).all()
    hot = found[found.u == 0].groupby(["q", "c"]).size()
    assert len(hot) >= 8
    members = cells.members.toPandas()
    assert set(members.itertuples(index=False, name=None)) == set(found[["q", "c", "u"]].itertuples(index=False, name=None))
    small = found[found.u != 0].groupby(["q", "u"]).c.nunique()
    assert small.max() == 1  # only a hot user has copies inside a block


def test_copies_of_a_hot_user_are_merged(spark, planted):
    train, test = planted
    hot = train.filter("user_id % 3 = 0").withColumn("user_id", F.lit(0)).groupBy("user_id", "item_id").agg(F.max("weight").alias("weight"))
    rest = train.filter("user_id <> 0").select("user_id", "item_id", "weight")
    model = pairwise.fit_pairwise(rest.unionByName(hot), 8, 40, "bpr", rows_per_cell=16, rate=0.1, local_epochs=4)
    users = model["users"].toPandas()
    assert users.id.is_unique and len(users) == rest.select("user_id").distinct().count() + 1
    scored = scoring.score_pairs_biased(test, model["users"], model["items"], "s")
    assert auc(test, scored, "s") > 0.62
    hers = test.filter("user_id % 3 = 0").withColumn("user_id", F.lit(0)).groupBy("user_id", "item_id").agg(F.max("weight").alias("weight"))
    assert auc(hers, scoring.score_pairs_biased(hers, model["users"], model["items"], "s"), "s") > 0.7


def test_alias_draws_follow_the_weights():
    rng = np.random.default_rng(0)
    for weight in (rng.integers(0, 200, 300) ** 0.75, np.array([5.0]), np.array([0.0, 1.0, 0.0]), np.zeros(4)):
        table = pairwise.alias_table(weight)
        ids = np.arange(200_000)
        got = np.bincount(pairwise.drawn(pairwise._hashes(ids, ids * 7, 3, 42, 2), table).ravel(), minlength=len(weight))
        want = weight / weight.sum() if weight.sum() else np.full(len(weight), 1 / len(weight))
        assert (got[want == 0] == 0).all()
        spread = np.abs(got / got.sum() - want) / np.sqrt(np.maximum(want, 1e-9) / got.sum())
        assert spread.max() < 4.5


def test_frequent_contexts_do_not_crowd_out_planted_pairs(spark):
    """Items 0 and 1 are everywhere; 10+2k and 11+2k stand next to each other."""
    rng, rows = np.random.default_rng(4), []
    for u in range(300):
        places = []
        for k in rng.integers(0, 15, 6):
            places += [10 + 2 * int(k), 11 + 2 * int(k), int(rng.integers(0, 2))]
        rows += [(u, i, 1.0, 1, k) for k, i in enumerate(places)]
    model = sequence.fit_sequence(spark.createDataFrame(rows, SCHEMA), 16, 25, min_count=1, window=1)
    v = {r.id: np.array(r.features) for r in model["items"].collect()}
    # centre vectors: partners share the context of each other's neighbours, so compare the pairs' own contexts
    pairs = sequence.context_pairs(spark.createDataFrame(rows, SCHEMA), 1, 1).toPandas()
    best = pairs[pairs.user_id >= 10].sort_values("weight").groupby("user_id").item_id.last()
    assert all(best[10 + 2 * k] in (11 + 2 * k, 0, 1) for k in range(15))
    assert len(v) == 32 and all(np.isfinite(x).all() for x in v.values())


@pytest.fixture(scope="module")
def sided(spark):
    """Users like items of their own kind; (train, users' values, items' values, test of items never seen)."""
    rng, rows, tests = np.random.default_rng(6), [], []
    for u in range(160):
        for k, i in enumerate(rng.choice(60, 24, replace=False)):
            weight = 1.0 if u % 4 == i % 4 and rng.random() < 0.95 else -1.0 if rng.random() < 0.4 else 0.0
            (rows if i < 44 else tests).append((u, int(i), weight, 1, k))
    make = lambda r: spark.createDataFrame(r, SCHEMA)
    values = "id long, feature string, value string"
    users = spark.createDataFrame([(u, "taste", str(u % 4)) for u in range(200)] + [(3, "taste", None), (3, "taste", "3")], values)
    items = [(i, "kind", str(i % 4)) for i in range(60)] + [(i, "noise", str(i % 7)) for i in range(0, 60, 2)]
    return make(rows), users, spark.createDataFrame(items, values), make(tests)


@pytest.mark.parametrize("loss,rows_per_cell", [("bpr", 1 << 20), ("warp", 150)])
def test_cold_items_and_users_score_by_their_values(spark, sided, loss, rows_per_cell):
    train, users, items, test = sided
    plain = pairwise.fit_pairwise(train, 8, 20, loss, rate=0.1, rows_per_cell=rows_per_cell)
    assert scoring.score_pairs_biased(test, plain["users"], plain["items"], "s").filter("not is_cold").count() == 0
    model = pairwise.fit_pairwise(
        train, 8, 20, loss, rate=0.1, rows_per_cell=rows_per_cell, user_features=users, item_features=items
    )
    scored = scoring.score_pairs_biased(test, model["users"], model["items"], "s")
    assert scored.filter("is_cold").count() == 0
    # dislikes and other items are alike to everything the model can know
    test = test.withColumn("weight", (F.col("weight") > 0).cast("double"))
    assert auc(test, scored, "s") > 0.85
    # users 160 to 199 never occur in the training set
    fresh = test.filter("user_id < 40").withColumn("user_id", F.col("user_id") + 160)
    assert auc(fresh, scoring.score_pairs_biased(fresh, model["users"], model["items"], "s"), "s") > 0.75
    assert {(r.feature, r.value) for r in model["item_values"].collect()} == {("kind", str(k)) for k in range(4)} | {("noise", str(k)) for k in range(7)}
    assert model["user_values"].count() == 4 and model["users"].count() == 200


def test_values_add_up_to_what_pairs_are_scored_with(spark, sided):
    """An id without entries has exactly the sum of its values' vectors."""
    train, users, items, _ = sided
    model = pairwise.fit_pairwise(train, 4, 4, user_features=users, item_features=items)
    vectors = {(r.feature, r.value): (np.array(r.features), r.bias) for r in model["item_values"].collect()}
    rows = {r.id: r for r in model["items"].collect()}
    for i in (44, 50, 57):
        parts = [vectors["kind", str(i % 4)]] + ([vectors["noise", str(i % 7)]] if i % 2 == 0 else [])
        np.testing.assert_allclose(rows[i].features, sum(x for x, _ in parts), atol=1e-12)
        assert rows[i].bias == pytest.approx(sum(b for _, b in parts))


def test_gradients_of_values_are_those_of_the_sum():
    """A step of a row is a step of its own vector and of each of its values, repeats within a batch summed."""
    state = pd.DataFrame(
        [("u", 1, [1.0, 0.0], 0.5, 1.0, 1.0, [4, 9]), ("u", 2, [0.0, 1.0], 0.0, 1.0, 1.0, None), ("u", 3, [2.0, 2.0], 0.0, 1.0, 1.0, [9]),
         ("a", 4, [0.5, 0.5], 1.0, 1.0, 1.0, None), ("a", 9, [-1.0, 3.0], 0.25, 1.0, 1.0, None)],
        columns=["kind", "id", "features", "bias", "seen", "bias_seen", "values"],
    )
    side = pairwise._Side(state, "u", "a")
    x, b = side.vectors(np.array([[0, 1], [2, 0]]))
    np.testing.assert_allclose(x, [[[0.5, 3.5], [0.0, 1.0]], [[1.0, 5.0], [0.5, 3.5]]])
    np.testing.assert_allclose(b, [[1.75, 0.0], [0.25, 1.75]])
    side.step(np.array([0, 2, 0]), np.array([[1.0, 0], [0, 2.0], [1.0, 0]]), np.zeros(3), 0.1)
    np.testing.assert_allclose(side.values.x[0], [0.5 + 0.2 / np.sqrt(1 + 2.0), 0.5])
    np.testing.assert_allclose(side.values.x[1], np.array([-1.0, 3.0]) + 0.1 * np.array([2.0, 2.0]) / np.sqrt(1 + 4.0))
    assert side.values.n.tolist() == [2, 3] and side.own.n.tolist() == [2, 0, 1]


def test_source_models_take_values_of_sources(spark, sided):
    train, users, items, test = sided
    own = spark.createDataFrame([(i, 1000 + i % 30) for i in range(60)], "item_id long, source_id long")
    sources = spark.createDataFrame([(1000 + s, "kind", str(s % 2)) for s in range(30)], "id long, feature string, value string")
    params = fleet.FleetParams(pairwise_factors=4, pairwise_epochs=5)
    seen = train.filter("item_id % 30 < 20")
    specs = {m.scope: m for m in fleet.FLEET if m.kind == "pairwise" and m.loss == "bpr" and m.train_set == "like"}
    side = fleet.SideFeatures(users, items, sources)
    for scope, want in (("source", {1000 + s for s in range(30)}), ("pseudo", set(range(60))), ("item", set(range(60)))):
        model = fleet.fit_model(specs[scope], seen, own, params, side=side)
        assert {r.id for r in model["items"].select("id").collect()} == want
        scored = fleet.score_model(specs[scope], model, test, train, own)
        assert scored.filter("is_cold").count() == 0 and scored.count() == test.count()


def test_categorical_values_as_a_long_table(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (2, None, 2.0)], "k long, x string, y double")
    got = sorted(tuple(r) for r in features.categorical_values(df, "k", ["x", "y"]).collect())
    assert got == [(1, "x", "a"), (1, "y", "2.0"), (1, "y", "3.0"), (2, "y", "2.0")]
