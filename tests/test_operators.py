"""Hand-made edge rows for the split, the weights, the statistics and the features."""

import math

import pytest
from pyspark.sql import functions as F

from duskrank.functions import exprs
from duskrank.sources import io
from duskrank.operators import features, scoring, split, stats, vectors, weights
from duskrank.schemas import INTERACTIONS, ITEMS, USERS, conform


def log_rows(spark, rows):
    """(user, item, timespent, like, dislike, share, bookmarks) in time order."""
    return spark.createDataFrame(
        [(u, i, k, float(t), a, b, c, d) for k, (u, i, t, a, b, c, d) in enumerate(rows)], INTERACTIONS
    )


def history(spark, lengths, item=lambda u, k: k):
    return log_rows(spark, [(u, item(u, k), 1, 0, 0, 0, 0) for u, n in lengths.items() for k in range(n)])


def test_holdout_boundary(spark):
    held = split.last_n_holdout(history(spark, {1: 20, 2: 21}), 20)
    assert {(r.user_id, r.n) for r in held.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {(2, 20)}
    assert held.agg(F.min("item_id")).first()[0] == 1


def test_earlier_repeats_of_held_pairs_leave_the_train_part(spark):
    df = history(spark, {1: 25}, item=lambda u, k: 24 if k == 0 else k)
    train = split.without_pairs(split.with_reverse_position(df), split.last_n_holdout(df, 20))
    assert sorted(r.item_id for r in train.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("hot", [dict(hot=False), dict(hot=True, limit=7)])
def test_split_parts_cover_what_is_left(spark, hot):
    df = history(spark, {1: 26, 2: 24, 3: 5, 4: 60})
    parts = split.split_log(df, 20, 0.2, **hot)
    counts = {(r.user_id, r.split): r.n for r in parts.groupBy("user_id", "split").agg(F.count("*").alias("n")).collect()}
    # 6 rows left: ratio 1/6 < 0.2 only for the last; 4 left: 1/4 is not; 5 left without holdout: 1/5 is not
    assert counts == {
        (1, "test"): 20, (1, "cb"): 1, (1, "als"): 5,
        (2, "test"): 20, (2, "als"): 4,
        (3, "als"): 5,
        (4, "test"): 20, (4, "cb"): 7, (4, "als"): 33,
    }
    assert parts.select("user_id", "pos").distinct().count() == df.count()


def test_users_with_target_and_top_items(spark):
    df = log_rows(spark, [(1, 1, 1, 0, 0, 0, 0), (2, 1, 1, 0, 0, 0, 1), (2, 3, 1, 0, 0, 0, 0), (3, 3, 0, 0, 1, 0, 0)])
    assert {r.user_id for r in split.users_with_target(df).collect()} == {2, 3}
    # items 1 and 3 are tied: the larger id wins
    assert {r.item_id for r in split.keep_frequent_items(df, 1).collect()} == {3}


def test_user_split_is_disjoint_and_seeded(spark):
    df = history(spark, {u: 3 for u in range(300)})
    kept, held = split.split_users(df, 0.2, 42)
    a, b = ({r.user_id for r in part.select("user_id").distinct().collect()} for part in (kept, held))
    assert not a & b and len(a | b) == 300 and 30 < len(b) < 95
    assert {r.user_id for r in split.split_users(df, 0.2, 42)[1].collect()} == b
    assert {r.user_id for r in split.split_users(df, 0.2, 43)[1].collect()} != b


def test_latest_pair_wins(spark):
    df = log_rows(spark, [(1, 1, 5, 1, 0, 0, 0), (1, 1, 9, 0, 1, 0, 0)])
    rows = split.latest_pairs(df).collect()
    assert len(rows) == 1 and rows[0].timespent == 9 and rows[0].dislike == 1


def test_several_reactions_on_one_row(spark):
    df = log_rows(spark, [(1, 1, 1, 1, 0, 1, 1), (1, 2, 1, 1, 1, 0, 0), (1, 3, 1, 0, 0, 0, 0), (1, 4, 1, 0, 0, 1, 0)])
    got = {r.item_id: r.weight for r in weights.like_book_share(df, 0.5, 2.0, 1.0).collect()}
    assert got == {1: 3.5, 2: -1.0, 4: 0.5}
    cut = {r.item_id: r.weight for r in weights.like_book_share(df, 0.5, 2.0, 1.0, truncate=True).collect()}
    assert cut == {1: 3.0, 2: -1.0, 4: 0.0}
    assert {r.item_id: r.weight for r in weights.like(df, 2.0).collect()} == {1: 2.0, 2: 1.0}
    assert {r.item_id: r.weight for r in weights.like_all(df).collect()} == {3: 0.0}


def test_watch_ratio_edges(spark):
    rows = [(0.0, 0.0), (5.0, 0.0), (5.0, None), (None, 2.0), (9.0, 2.0), (1.0, 2.0), (-1.0, 2.0)]
    df = spark.createDataFrame(rows, "t double, d double")
    clipped = [r[0] for r in df.select(exprs.watch_ratio(F.col("t"), F.col("d"), 3.0)).collect()]
    assert clipped == [None, 3.0, None, None, 3.0, 0.5, 0.0]
    free = [r[0] for r in df.select(exprs.watch_ratio(F.col("t"), F.col("d"))).collect()]
    assert free == [None, None, None, None, 4.5, 0.5, -0.5]


def test_log_decay_directions(spark):
    df = log_rows(spark, [(1, k, 1, 1, 0, 0, 0) for k in range(3)])
    for direction, places in (("forward", [1, 2, 3]), ("backward", [3, 2, 1])):
        got = [r.weight for r in weights.log_decay(weights.like(df), direction).orderBy("pos").collect()]
        assert got == pytest.approx([1 / math.log(k + 1) for k in places])


def _meta(spark):
    items = spark.createDataFrame(
        [(1, 7, 10.0, [1.0, 0.0]), (2, 7, 0.0, [0.0, 1.0]), (3, None, 5.0, [1.0, 1.0]), (4, 9, 8.0, None)], ITEMS
    )
    users = spark.createDataFrame([(1, 1.0, 20.0), (2, 2.0, 40.0), (3, 1.0, 30.0)], USERS)
    return items, users


def test_item_stats_thresholds(spark):
    items, users = _meta(spark)
    df = log_rows(spark, [(1, 1, 5, 1, 0, 0, 0), (2, 1, 80, 0, 1, 0, 0), (3, 1, 10, 1, 0, 1, 0), (1, 2, 3, 0, 0, 0, 0)])
    open_ = stats.item_stats(df, items, users, positive_threshold=2, min_users=2).collect()
    assert [r.item_id for r in open_] == [1]
    r = open_[0]
    assert (r.n_users, r.sum_positive, r.sum_dislike) == (3, 3, 1)
    assert r.like_dislike_ratio == pytest.approx(0.5)
    assert (r.mean_gender_positive, r.mean_age_negative, r.mean_age_positive) == (1.0, 40.0, 25.0)
    assert (r.timespent_ratio_q10, r.timespent_ratio_q50, r.timespent_ratio_q90) == (0.5, 1.0, 5.0)
    strict = stats.item_stats(df, items, users, positive_threshold=4, min_users=2).first()
    assert strict.like_dislike_ratio == 1.0
    # hidden below the threshold: the positive gender mean and the negative age mean, not the others
    assert strict.mean_gender_positive is None and strict.mean_age_negative is None
    assert strict.mean_gender_negative == 2.0 and strict.mean_age_positive == 25.0


def test_source_below_threshold_survives_the_full_join(spark):
    items, users = _meta(spark)
    df = log_rows(spark, [(1, 1, 5, 1, 0, 0, 0)])
    some = stats.item_stats(df, items, users, "source_id", 2, min_users=1)
    both = stats.combine_source_stats(some, stats.source_duration_stats(items))
    rows = {r.source_id: r for r in both.collect()}
    assert rows[9].n_users is None and rows[9].n_items == 1 and rows[7].n_users == 1


def test_user_source_stats_total_counts_unknown_items(spark):
    items, _ = _meta(spark)
    df = log_rows(spark, [(1, 1, 5, 1, 0, 0, 0), (1, 2, 5, 0, 1, 0, 0), (1, 99, 5, 0, 0, 0, 0)])
    rows = stats.user_source_stats(df, items, 2).collect()
    assert [(r.source_id, r.n_total_interactions) for r in rows] == [(7, 3)]
    assert rows[0].source_perc == pytest.approx(2 / 3)
    assert rows[0].mean_source_timespent_ratio == 0.5  # the zero-duration row has no ratio


def test_user_stats_recent_counts_and_empty_modes(spark):
    items, _ = _meta(spark)
    df = log_rows(spark, [(1, 1, k, int(k < 5), 0, 0, 0) for k in range(12)] + [(2, 3, 1, 0, 0, 0, 0)] * 1)
    rows = {r.user_id: r for r in stats.user_stats(df, items, min_items=1).collect()}
    assert (rows[1].user_n_likes_last_10, rows[1].user_n_likes_last_20) == (3, 5)
    assert rows[1].user_liked_source_id_mode == [7]
    assert rows[2].user_liked_source_id_mode == [] and rows[2].user_source_id_mode == []
    assert rows[2].user_n_likes_last_10 == 0


def test_sims_fill_and_unknown_items(spark):
    items, _ = _meta(spark)
    factor = log_rows(spark, [(1, 1, 1, 1, 0, 0, 0), (1, 2, 1, 0, 0, 1, 0), (2, 3, 1, 0, 1, 0, 0)])
    liked, disliked = vectors.taste_vectors(factor, items)
    pairs = spark.createDataFrame([(1, 3), (2, 3), (2, 99)], "user_id long, item_id long")
    rows = {(r.user_id, r.item_id): r for r in vectors.embedding_sims(pairs, items, liked, disliked).collect()}
    assert set(rows) == {(1, 3), (2, 3)}
    assert rows[1, 3].liked_embeddings_sim == pytest.approx(1.0)
    # user 2 liked nothing: the mean over the pairs; user 1 disliked nothing: likewise
    assert rows[2, 3].liked_embeddings_sim == pytest.approx(1.0)
    assert rows[1, 3].disliked_embeddings_sim == pytest.approx(2.0)


def test_gender_likelihood(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (1.25, 2.0), (1.5, 3.0), (None, 1.0)], "m double, g double")
    got = [r[0] for r in df.select(exprs.gender_likelihood(F.col("m"), F.col("g"))).collect()]
    assert got == [1.0, 1.0, 0.25, None, None]


def _features(spark, pairs, **options):
    items, users = _meta(spark)
    df = log_rows(spark, [(1, 1, 5, 1, 0, 0, 0), (2, 1, 8, 0, 1, 0, 0), (3, 2, 1, 0, 0, 0, 1)])
    liked, disliked = vectors.taste_vectors(df, items)
    source = stats.combine_source_stats(
        stats.item_stats(df, items, users, "source_id", 1, min_users=1), stats.source_duration_stats(items)
    )
    return features.join_features(
        pairs,
        None,
        stats.item_stats(df, items, users, positive_threshold=1, min_users=1),
        source,
        items,
        stats.user_stats(df, items, 1),
        stats.user_source_stats(df, items, 1),
        vectors.embedding_sims(pairs, items, liked, disliked),
        users,
        **options,
    )


def test_feature_table_keeps_rows_and_hides_raw_columns(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 3), (77, 99)], "user_id long, item_id long")
    wide = _features(spark, pairs)
    assert wide.count() == 3
    columns = features.feature_columns(wide)
    assert not set(columns) & {"source_id", "user_id", "like", "user_source_id_mode"}
    row = wide.filter("user_id = 1").first()
    assert row.is_user_source_id_mode is True and row.mean_like_source is not None
    assert row.mean_age_diff == pytest.approx(20 - row.mean_age)
    unknown = wide.filter("user_id = 77").first()
    assert unknown.mean_like is None and unknown.is_user_source_id_mode is None
    with pytest.raises(ValueError):
        features.feature_columns(wide.withColumn("like", F.lit(1)))


def test_search_variant_of_the_features(spark):
    pairs = spark.createDataFrame([(1, 1)], "user_id long, item_id long")
    small = _features(spark, pairs, likelihoods=False)
    assert "gender_distr" not in small.columns and "source_id" in small.columns
    assert "source_id" not in features.feature_columns(small)


def test_assembler_marks_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0, [1.0, 2.0]), (None, 6.0, None), (3.0, float("nan"), [3.0, 4.0])], "a double, b double, e array<float>")
    fitted = features.FeatureAssembler(["a", "b"], "e", 2).fit(df)
    rows = [r.features.toArray().tolist() for r in fitted.transform(df).collect()]
    assert rows == [[1, 5, 0, 0, 1, 2], [0, 6, 1, 0, 0, 0], [3, 4, 0, 1, 3, 4]]
    wide = features.FeatureAssembler(["a", "b"], degree=2).fit(df).transform(df)
    assert len(wide.first().features) > 4


def test_cold_pairs_and_sources(spark):
    items, _ = _meta(spark)
    users_f = spark.createDataFrame([(1, [1.0, 2.0], 0.5)], "id long, features array<double>, bias double")
    items_f = spark.createDataFrame([(7, [3.0, 4.0], 0.25)], "id long, features array<double>, bias double")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (5, 1)], "user_id long, item_id long")
    by_source = scoring.score_by_source(pairs, items, lambda p: scoring.score_pairs(p, users_f, items_f, "s"))
    got = {(r.user_id, r.item_id): (r.s, r.is_cold) for r in by_source.collect()}
    # item 3 has no source, user 5 is unknown: cold, but still there
    assert got == {(1, 1): (11.0, False), (1, 2): (11.0, False), (1, 3): (-1.0, True), (5, 1): (-1.0, True)}
    own = spark.createDataFrame([(1, 7), (1, 8)], "user_id long, item_id long")
    biased = {r.item_id: r for r in scoring.score_pairs_biased(own, users_f, items_f, "s", cold=None).collect()}
    assert biased[7].s_with_user_and_item_bias == 11.75 and biased[7].s_only_item_bias == 0.25
    assert biased[8].s is None and biased[8].is_cold


def test_mean_ensemble_divides_by_count(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "a double, b double")
    assert df.select(scoring.mean_ensemble(["a", "b"], [1.0, 0.5])).first()[0] == 2.0
    with pytest.raises(ValueError):
        scoring.mean_ensemble(["a"], [1.0, 2.0])


def test_conform_rejects_missing_columns(spark):
    with pytest.raises(ValueError):
        conform(spark.createDataFrame([(1,)], "user_id long"), USERS)


def test_pseudo_items_never_meet_items(spark):
    schema = "user_id long, item_id long, datetime long, weight double"
    items = spark.createDataFrame([(5, 1), (weights.SOURCE_OFFSET + 1, 1)], "item_id long, source_id long")
    small = spark.createDataFrame([(1, 5, 1, 1.0)], schema)
    got = sorted(r.item_id for r in weights.with_pseudo_items(small, items).collect())
    assert got == [5, weights.SOURCE_OFFSET + 1]
    large = spark.createDataFrame([(1, weights.SOURCE_OFFSET + 1, 1, 1.0)], schema)
    with pytest.raises(Exception, match="reaches the pseudo-items"):
        weights.with_pseudo_items(large, items).collect()
    assert weights.with_typed_pseudo_items(large, items).count() == 2


def test_vectors_of_another_length_stop_the_job(spark, tmp_path):
    rows = [(1, 1, 1.0, [1.0, 2.0]), (2, 1, 1.0, None)]
    schema = "item_id long, source_id long, duration double, embeddings array<float>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/good")
    spark.createDataFrame([*rows, (3, 1, 1.0, [1.0])], schema).write.parquet(f"{tmp_path}/bad")
    assert io.read_items(spark, f"{tmp_path}/good", 2).filter("embeddings IS NULL").count() == 1
    assert len(io.read_items(spark, f"{tmp_path}/bad").collect()) == 3
    with pytest.raises(Exception, match="must have 2 elements, not 1"):
        io.read_items(spark, f"{tmp_path}/bad", 2).collect()
    with pytest.raises(Exception, match="must have 3 elements"):
        table = spark.createDataFrame([(0.5, [1.0, 2.0])], "a double, e array<float>")
        features.FeatureAssembler(["a"], "e", 3).fit(table).transform(table).collect()


def test_feature_families_travel_as_structs(spark):
    from duskrank.operators.features import join_features

    pairs = spark.createDataFrame([(1, 10, 5), (2, 20, 6), (None, 30, 7)], "user_id long, item_id long, pos long")
    item_stats = spark.createDataFrame([(10, 0.5, 3)], "item_id long, mean_like double, n_users long")
    source_stats = spark.createDataFrame([(1, 0.25, 9)], "source_id long, mean_like double, n_users long")
    items = spark.createDataFrame([(10, 1), (20, 1)], "item_id long, source_id long")
    user_stats = spark.createDataFrame([(1, 0.5)], "user_id long, user_like_perc double")
    out = join_features(pairs, None, item_stats, source_stats, items, user_stats, likelihoods=False)
    assert out.columns == [
        "user_id", "item_id", "pos", "source_id", "mean_like", "n_users", "mean_like_source", "n_users_source",
        "user_like_perc", "user2item_like_perc",
    ]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [
        (1, 10, 5, 1, 0.5, 3, 0.25, 9, 0.5, 0.25),
        (2, 20, 6, 1, None, None, 0.25, 9, None, None),
        (None, 30, 7, None, None, None, None, None, None, None),
    ]
    assert "AS _family2" in out._jdf.queryExecution().optimizedPlan().toString()
