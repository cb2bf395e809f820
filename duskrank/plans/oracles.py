"""The same results as plain SQL over the benchmark tables, written from the definitions.

Where the library ranks or pre-aggregates, the SQL takes the direct road (self-joins, sorted lists),
so the two share no method. Doubles are rounded after a shift of 3e-10: means of two-decimal values often
lie exactly half-way between two rounded values, and the shift moves the boundary off those points.
"""

from __future__ import annotations

SIGNALS = ("like", "dislike", "share", "bookmarks")
ODD = (10, 30, 50, 70, 90)
ALL = tuple(range(10, 100, 10))

_CTES: dict[str, str] = {
    "interactions": """
        SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_id AS pos,
               value AS timespent,
               CAST(event_type = 'purchase' AS INTEGER) AS "like",
               CAST(event_type = 'error' AS INTEGER) AS dislike,
               CAST(event_type = 'signup' AS INTEGER) AS share,
               CAST(event_type = 'click' AS INTEGER) AS bookmarks
        FROM events""",
    "items": """
        SELECT vec_id AS item_id, vec_id % 10 AS source_id,
               CAST(10 + vec_id % 50 AS DOUBLE) AS duration, embedding AS embeddings
        FROM embeddings""",
    "users": """
        SELECT c_custkey AS user_id, CAST(1 + c_nationkey % 2 AS DOUBLE) AS gender,
               CAST(18 + c_custkey % 60 AS DOUBLE) AS age
        FROM customer""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n_rows
        FROM interactions""",
    "test": "SELECT * EXCLUDE (n_rows) FROM ranked WHERE n_rows > 20 AND rn <= 20",
    "train": """
        SELECT r.* EXCLUDE (n_rows) FROM ranked r
        WHERE NOT EXISTS (SELECT 1 FROM test t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)""",
    "ratios": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC)
                  / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS rn_ratio
        FROM train""",
    "cb": "SELECT * EXCLUDE (rn_ratio) FROM ratios WHERE rn_ratio < CAST(0.2 AS DOUBLE)",
    "als": "SELECT * EXCLUDE (rn_ratio) FROM ratios WHERE rn_ratio >= CAST(0.2 AS DOUBLE)",
    "w_like": """
        SELECT user_id, item_id, CAST("like" - dislike AS DOUBLE) AS weight, CAST(1 AS BIGINT) AS datetime, pos
        FROM als WHERE "like" + dislike >= 1""",
    "placed": """
        SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS seq FROM w_like
        WHERE item_id IN (SELECT item_id FROM w_like GROUP BY item_id HAVING count(*) >= 5)""",
    "rekeyed": """
        SELECT w.user_id, i.source_id AS item_id, w.weight, w.datetime, w.pos
        FROM w_like w JOIN items i ON i.item_id = w.item_id""",
    "rolled": """
        SELECT user_id, item_id, max(datetime) AS datetime, sum(weight) AS weight
        FROM rekeyed GROUP BY user_id, item_id""",
    "watched": """
        SELECT a.*, i.source_id, i.duration, u.gender, u.age,
               CASE WHEN i.duration = 0 AND a.timespent > 0 THEN 5.0
                    WHEN i.duration = 0 THEN NULL
                    ELSE least(greatest(a.timespent / i.duration, 0), 5) END AS timespent_ratio,
               a."like" + a.share + a.bookmarks AS positive_feedback
        FROM als a LEFT JOIN items i ON i.item_id = a.item_id LEFT JOIN users u ON u.user_id = a.user_id""",
    "test_pairs": "SELECT DISTINCT user_id, item_id FROM test",
    "scored": """
        SELECT t.user_id, t.item_id, t.timespent, t."like" - t.dislike AS target, -t.timespent AS neg_time,
               u.rate * i.rate AS predictions
        FROM test t
        LEFT JOIN (SELECT user_id, avg("like") AS rate FROM als GROUP BY user_id) u ON u.user_id = t.user_id
        LEFT JOIN (SELECT item_id, avg("like") AS rate FROM als GROUP BY item_id) i ON i.item_id = t.item_id""",
    "taste": """
        SELECT a.user_id, CASE WHEN a.dislike = 1 THEN 'disliked' ELSE 'liked' END AS taste,
               g.dim, avg(CAST(i.embeddings[g.dim + 1] AS DOUBLE)) AS value
        FROM als a JOIN items i ON i.item_id = a.item_id,
             LATERAL (SELECT unnest(range(len(i.embeddings))) AS dim) g
        WHERE a.dislike = 1 OR a."like" + a.share + a.bookmarks >= 1
        GROUP BY ALL""",
    "taste_lists": """
        SELECT user_id, taste, list(value ORDER BY dim) AS v FROM taste GROUP BY user_id, taste""",
    "raw_sims": """
        SELECT p.user_id, p.item_id,
               list_dot_product(CAST(i.embeddings AS DOUBLE[]), l.v) AS liked,
               list_dot_product(CAST(i.embeddings AS DOUBLE[]), d.v) AS disliked
        FROM test_pairs p JOIN items i ON i.item_id = p.item_id
        LEFT JOIN taste_lists l ON l.user_id = p.user_id AND l.taste = 'liked'
        LEFT JOIN taste_lists d ON d.user_id = p.user_id AND d.taste = 'disliked'""",
    "sims": """
        SELECT user_id, item_id,
               coalesce(liked, (SELECT avg(liked) FROM raw_sims)) AS liked_embeddings_sim,
               coalesce(disliked, (SELECT avg(disliked) FROM raw_sims)) AS disliked_embeddings_sim
        FROM raw_sims""",
    "per_pair": """
        SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS n_rows, avg(timespent) AS mean_time,
               CAST(sum("like") AS DOUBLE) AS likes
        FROM interactions GROUP BY user_id, item_id""",
    "fixed_scores": """
        SELECT p.user_id, p.item_id,
               CASE WHEN u.features IS NULL OR i.features IS NULL THEN -1.0
                    ELSE list_dot_product(CAST(u.features AS DOUBLE[]), CAST(i.features AS DOUBLE[])) END AS predict,
               u.features IS NULL OR i.features IS NULL AS is_cold
        FROM (SELECT DISTINCT user_id, item_id FROM interactions) p
        LEFT JOIN (SELECT e.vec_id AS id, e.embedding AS features FROM embeddings e
                   WHERE e.vec_id IN (SELECT s_suppkey FROM supplier)) u ON u.id = p.user_id
        LEFT JOIN (SELECT e.vec_id AS id, e.embedding AS features FROM embeddings e
                   WHERE e.vec_id IN (SELECT p_partkey FROM part)) i ON i.id = p.item_id""",
}


def _nearest(column: str, percent: int) -> str:
    """Sorted non-null list at 0-based index floor((n-1)*q + 0.5)."""
    index = f"CAST(floor((count({column}) - 1) * CAST({percent / 100.0!r} AS DOUBLE) + 0.5) AS BIGINT)"
    return f"list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))[{index} + 1]"


def _item_stats(column: str, threshold: int, min_users: int) -> str:
    parts = ["count(user_id) AS n_users"]
    for s in SIGNALS:
        parts += [f'avg("{s}") AS mean_{s}', f'CAST(sum("{s}") AS BIGINT) AS sum_{s}']
    for c in ("timespent_ratio", "gender", "age"):
        parts += [
            f"avg({c}) AS mean_{c}",
            f"avg({c}) FILTER (WHERE positive_feedback >= 1) AS mean_{c}_positive",
            f"avg({c}) FILTER (WHERE dislike >= 1) AS mean_{c}_negative",
        ]
    for c in ("timespent_ratio", "age"):
        parts += [f"{_nearest(c, p)} AS {c}_q{p}" for p in ODD]
    parts.append("CAST(sum(positive_feedback) AS BIGINT) AS sum_positive")
    enough = f"sum_positive >= {threshold}"
    return f"""
        SELECT * REPLACE (CASE WHEN {enough} THEN mean_gender_positive END AS mean_gender_positive,
                          CASE WHEN {enough} THEN mean_age_negative END AS mean_age_negative),
               coalesce(CASE WHEN {enough} THEN (sum_positive - sum_dislike)
                        / CAST(nullif(sum_positive + sum_dislike, 0) AS DOUBLE) END, 1.0) AS like_dislike_ratio
        FROM (SELECT {column}, {", ".join(parts)} FROM watched GROUP BY {column})
        WHERE n_users >= {min_users}"""


_CTES["item_stats"] = _item_stats("item_id", 10, 20)
_CTES["source_stats"] = _item_stats("source_id", 2, 5)
_CTES["durations"] = f"""
    SELECT source_id, avg(duration) AS duration_mean, {", ".join(f"{_nearest('duration', p)} AS duration_q{p}" for p in ALL)},
           count(*) AS n_items
    FROM items GROUP BY source_id"""
_CTES["combined"] = "SELECT * FROM source_stats FULL JOIN durations USING (source_id)"


def _user_source() -> str:
    p = "user2source_"
    parts = [
        "avg(CAST(a.\"like\" + a.share + a.bookmarks > 0 AS DOUBLE)) AS source_acceptance",
        "avg(CAST(a.dislike AS DOUBLE)) AS source_disacceptance",
        "avg(a.timespent / nullif(i.duration, 0)) AS mean_source_timespent_ratio",
        f"avg(a.timespent) AS {p}avg_timespent",
        f"avg(a.timespent / nullif(i.duration, 0)) AS {p}avg_timespent_ratio",
    ]
    parts += [f'avg(a."{s}") AS {p}avg_{s}' for s in SIGNALS] + [f'avg(a."like" - a.dislike) AS {p}avg_target']
    parts += [f'CAST(sum(a."{s}") AS BIGINT) AS {p}sum_{s}' for s in SIGNALS]
    parts += [f'CAST(sum(a."like" - a.dislike) AS BIGINT) AS {p}sum_target', f"count(i.source_id) AS {p}source_interactions"]
    return f"""
        SELECT g.* EXCLUDE (n), t.n_total_interactions, g.n / CAST(t.n_total_interactions AS DOUBLE) AS source_perc
        FROM (SELECT a.user_id, i.source_id, count(*) AS n, {", ".join(parts)}
              FROM als a JOIN items i ON i.item_id = a.item_id GROUP BY a.user_id, i.source_id) g
        JOIN (SELECT user_id, count(*) AS n_total_interactions FROM als GROUP BY user_id) t ON t.user_id = g.user_id
        WHERE g.n >= 3"""


_CTES["user_source"] = _user_source()


def _modes(predicate: str) -> str:
    return f"""
        SELECT user_id, list(source_id ORDER BY source_id) AS modes FROM (
            SELECT user_id, source_id, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r
            FROM watched WHERE {predicate} AND source_id IS NOT NULL GROUP BY user_id, source_id)
        WHERE r = 1 GROUP BY user_id"""


_CTES["modes"] = _modes("TRUE")
_CTES["liked_modes"] = _modes('"like" = 1')


def _user_stats() -> str:
    totals = {"like": "total_likes", "dislike": "total_dislikes", "share": "total_share", "bookmarks": "total_bookmarks"}
    recent = {"like": "n_likes", "dislike": "n_dislikes", "share": "n_shares", "bookmarks": "n_bookmarks"}
    perc = {"like": "like_perc", "dislike": "dislike_perc", "share": "share_perc", "bookmarks": "bookmarks_perc"}
    parts = [f'CAST(sum("{s}") AS BIGINT) AS user_{n}' for s, n in totals.items()]
    parts.append("sum(timespent) AS user_total_timespent")
    for c in ("timespent", "timespent_ratio"):
        parts += [
            f"avg({c}) AS user_avg_{c}",
            f'avg({c}) FILTER (WHERE "like" = 1) AS user_avg_{c}_like',
            f"avg({c}) FILTER (WHERE dislike = 1) AS user_avg_{c}_dislike",
        ]
    parts += [f"{_nearest('timespent', p)} AS user_timespent_q{p}" for p in ODD]
    parts.append("count(*) AS user_total_interactions")
    parts += [
        f'CAST(coalesce(sum("{s}") FILTER (WHERE rn_new <= {k}), 0) AS BIGINT) AS user_{n}_last_{k}'
        for s, n in recent.items()
        for k in (10, 20, 100)
    ]
    parts += [f'sum("{s}") / CAST(count(*) AS DOUBLE) AS user_{n}' for s, n in perc.items()]
    return f"""
        SELECT g.*, m.modes AS user_source_id_mode, coalesce(l.modes, CAST([] AS BIGINT[])) AS user_liked_source_id_mode
        FROM (SELECT user_id, {", ".join(parts)}
              FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS rn_new FROM watched)
              GROUP BY user_id HAVING count(*) >= 10) g
        LEFT JOIN modes m ON m.user_id = g.user_id LEFT JOIN liked_modes l ON l.user_id = g.user_id"""


_CTES["user_stats"] = _user_stats()

_DIFFS = [
    (own, base + suffix)
    for own, bases in (
        ("age", ["mean_age", *[f"age_q{p}" for p in ODD], "mean_age_positive", "mean_age_negative"]),
        ("gender", ["mean_gender", "mean_gender_positive", "mean_gender_negative"]),
    )
    for suffix in ("", "_source")
    for base in bases
]


def _feature_table(search: bool = False) -> str:
    """``search``: the smaller table, without user-by-source statistics, likelihoods and mode flags."""
    shared = ["n_users", "sum_positive", "like_dislike_ratio"]
    for s in SIGNALS:
        shared += [f"mean_{s}", f"sum_{s}"]
    for c in ("timespent_ratio", "gender", "age"):
        shared += [f"mean_{c}", f"mean_{c}_positive", f"mean_{c}_negative"]
    shared += [f"{c}_q{p}" for c in ("timespent_ratio", "age") for p in ODD]
    renamed = ", ".join(f"{c} AS {c}_source" for c in shared)
    others = ", ".join(["duration_mean", "n_items", *[f"duration_q{p}" for p in ALL]])
    diffs = ", ".join(
        part for own, c in _DIFFS for part in (f"{own} - {c} AS {c}_diff", f"abs({own} - {c}) AS {c}_diff_abs")
    )

    def likelihood(m: str) -> str:
        return f"CASE WHEN gender = 2 THEN {m} - 1 WHEN gender = 1 THEN 2 - {m} END"

    if search:
        joined = f"""
        FROM (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos DESC) AS k FROM test) WHERE k = 1)
        LEFT JOIN item_stats USING (item_id)
        LEFT JOIN (SELECT item_id, source_id FROM items) USING (item_id)
        LEFT JOIN (SELECT source_id, {renamed}, {others} FROM combined) USING (source_id)
        LEFT JOIN user_stats USING (user_id)
        LEFT JOIN sims USING (user_id, item_id)
        LEFT JOIN users USING (user_id)"""
        return f"SELECT *, {diffs}, user_like_perc * mean_like AS user2item_like_perc {joined}"
    return f"""
        SELECT * EXCLUDE (source_id, user_source_id_mode, user_liked_source_id_mode), {diffs},
               user_like_perc * mean_like AS user2item_like_perc,
               {likelihood("mean_gender")} AS gender_distr,
               {likelihood("mean_gender_source")} AS gender_source_distr,
               user_like_perc * mean_like * ({likelihood("mean_gender")}) AS user2item_like_perc_gender,
               list_contains(user_source_id_mode, source_id) AS is_user_source_id_mode,
               list_contains(user_liked_source_id_mode, source_id) AS is_liked_source_id_mode
        FROM (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos DESC) AS k FROM test) WHERE k = 1)
        LEFT JOIN item_stats USING (item_id)
        LEFT JOIN (SELECT item_id, source_id FROM items) USING (item_id)
        LEFT JOIN (SELECT source_id, {renamed}, {others} FROM combined) USING (source_id)
        LEFT JOIN user_source USING (user_id, source_id)
        LEFT JOIN user_stats USING (user_id)
        LEFT JOIN sims USING (user_id, item_id)
        LEFT JOIN users USING (user_id)"""


_CTES["feature_table"] = _feature_table()
_CTES["search_table"] = _feature_table(search=True)
_CTES["raw_features"] = """
    SELECT COLUMNS(* EXCLUDE (user_id, item_id, "like", dislike, share, bookmarks, timespent, rn, pos))::DOUBLE FROM feature_table"""
_CTES["long_features"] = "SELECT feature, v FROM raw_features UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(*)))"
_CTES["feature_lows"] = "SELECT feature, min(v) AS low, count(*) AS n_all, count(v) AS n_known FROM long_features GROUP BY feature"


def _auc(table: str, score: str) -> str:
    """Every graded pair spelled out by a self-join."""
    win = f"CASE WHEN a.{score} > b.{score} THEN 1 WHEN a.{score} = b.{score} THEN CAST(0.5 AS DOUBLE) ELSE 0 END"
    return f"""
        SELECT a.user_id, sum({win}) AS num, count(*) AS den, sum({win}) / count(*) AS rocauc
        FROM {table} a JOIN {table} b ON a.user_id = b.user_id
             AND ((a.target = 1 AND b.target = 0) OR (a.target = 0 AND b.target = -1))
        GROUP BY a.user_id"""


# gradients of the ranker: noise from md5, neighbours by a self-join on places
_CTES["states"] = """
    SELECT draw, user_id, item_id, target, CASE WHEN draw = 0 THEN 0.0::DOUBLE ELSE (item_id % 7) / 3.0::DOUBLE END AS score
    FROM (SELECT user_id, item_id, "like" - dislike AS target,
                 row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos DESC) AS k FROM cb),
         (SELECT unnest([0, 1]) AS draw)
    WHERE k = 1"""
_CTES["noisy"] = """
    SELECT s.*, p.k,
           (CAST('0x' || substr(md5(concat_ws(':', user_id, item_id, 32, draw, p.k)), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE AS x
    FROM states s, (SELECT unnest([0, 1, 2]) AS k) p"""
_CTES["noisy_places"] = """
    SELECT *, row_number() OVER (PARTITION BY draw, k, user_id ORDER BY score + ln(x / (1 - x)) DESC, item_id) AS place FROM noisy"""
_CTES["noisy_pairs"] = """
    SELECT a.draw, a.user_id, a.item_id AS upper, b.item_id AS lower, sign(a.target - b.target) AS s,
           pow(0.85::DOUBLE, a.place - 1) * abs(a.target - b.target) AS w,
           1 / (1 + exp(sign(a.target - b.target) * (a.score - b.score))) AS wrong
    FROM noisy_places a JOIN noisy_places b
         ON a.draw = b.draw AND a.k = b.k AND a.user_id = b.user_id AND b.place = a.place + 1"""

_CTES["graded"] = 'SELECT user_id, timespent, "like" - dislike AS target FROM interactions'
_CTES["time_auc"] = _auc("graded", "timespent")
for _s in ("predictions", "timespent", "neg_time"):
    _CTES[f"auc_{_s}"] = _auc("scored", _s)

_LOG = "user_id, item_id, pos, round(timespent + 3e-10, 6) AS timespent, \"like\", dislike, share, bookmarks, rn"
_W = "user_id, item_id, round(weight + 3e-10, 6) AS weight, datetime, pos"

_SELECTS: dict[str, str] = {
    "split_positions": f"SELECT {_LOG} FROM ranked",
    "split_holdout": f"SELECT {_LOG} FROM test",
    "split_train": f"SELECT {_LOG} FROM train",
    "split_tail_ratio": f"SELECT {_LOG}, round(rn_ratio + 3e-10, 6) AS rn_ratio FROM ratios",
    "split_tail_cb": f"SELECT {_LOG} FROM cb",
    "split_tail_als": f"SELECT {_LOG} FROM als",
    "append_holdout": f"SELECT {_LOG} FROM cb UNION ALL SELECT {_LOG} FROM (SELECT * REPLACE (CAST(1 AS BIGINT) AS rn) FROM test)",
    "users_with_target": f"""
        SELECT {_LOG} FROM cb WHERE user_id IN (
            SELECT user_id FROM cb GROUP BY user_id HAVING sum("like" + dislike + share + bookmarks) > 0)""",
    "latest_pairs": """
        SELECT user_id, item_id, pos, round(timespent + 3e-10, 6) AS timespent, "like", dislike, share, bookmarks
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos DESC) AS k FROM interactions)
        WHERE k = 1""",
    "top_items": f"""
        SELECT {_W} FROM w_like WHERE item_id IN (
            SELECT item_id FROM w_like GROUP BY item_id ORDER BY count(*) DESC, item_id DESC LIMIT 50)""",
    "w_like": """
        SELECT user_id, item_id, round(CAST("like" * 2.0 - dislike AS DOUBLE) + 3e-10, 6) AS weight, CAST(1 AS BIGINT) AS datetime, pos
        FROM als WHERE "like" + dislike >= 1""",
    "w_like_book_share": """
        SELECT user_id, item_id,
               round(CAST(CASE WHEN dislike = 0 THEN "like" + 0.5 * share + 2.0 * bookmarks ELSE -1 END AS DOUBLE) + 3e-10, 6) AS weight,
               CAST(1 AS BIGINT) AS datetime, pos
        FROM als WHERE "like" + dislike + share + bookmarks >= 1""",
    "w_timespent": """
        SELECT * FROM (
            SELECT a.user_id, a.item_id, round(least(greatest(a.timespent / i.duration, 0), 3) + 3e-10, 6) AS weight, a.rn AS datetime, a.pos
            FROM als a JOIN items i ON i.item_id = a.item_id
            WHERE least(greatest(a.timespent / i.duration, 0), 3) > 0.5)""",
    "w_like_all": """
        SELECT user_id, item_id, CAST("like" AS DOUBLE) AS weight, CAST(1 AS BIGINT) AS datetime, pos
        FROM als WHERE dislike + share + bookmarks = 0""",
    "w_log_decay": """
        SELECT user_id, item_id, round(weight / ln(k + 1) + 3e-10, 6) AS weight, datetime, pos
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM w_like)""",
    "source_rekey": f"SELECT {_W} FROM rekeyed",
    "source_rollup": "SELECT user_id, item_id, datetime, round(weight + 3e-10, 6) AS weight FROM rolled",
    "pseudo_items": """
        SELECT user_id, item_id, datetime, round(weight + 3e-10, 6) AS weight FROM w_like
        UNION ALL SELECT user_id, item_id + 1000000, datetime, round(weight + 3e-10, 6) FROM rolled""",
    "target": 'SELECT user_id, item_id, pos, "like" - dislike AS target FROM interactions',
    "nearest_quantiles": "SELECT item_id, "
    + ", ".join(f"round({_nearest('timespent', p)} + 3e-10, 6) AS timespent_q{p}" for p in ALL)
    + " FROM interactions GROUP BY item_id",
    "mode_ties": """
        SELECT user_id, item_id FROM (
            SELECT user_id, item_id, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r
            FROM interactions GROUP BY user_id, item_id) WHERE r = 1""",
    "user_mean_vector": """
        SELECT user_id, CAST(dim AS INTEGER) AS dim, round(value + 3e-10, 6) AS value FROM taste WHERE taste = 'liked'""",
    "embedding_sims": """
        SELECT user_id, item_id, round(liked_embeddings_sim + 3e-10, 6) AS liked_embeddings_sim,
               round(disliked_embeddings_sim + 3e-10, 6) AS disliked_embeddings_sim FROM sims""",
    "score_pivot": """
        SELECT user_id, item_id, n_rows, round(mean_time + 3e-10, 6) AS mean_time, likes FROM per_pair""",
    "mean_ensemble": """
        SELECT user_id, item_id, round((n_rows + mean_time * CAST(0.5 AS DOUBLE) + likes * 2) / 3 + 3e-10, 6) AS prediction FROM per_pair""",
    "cold_fill": "SELECT user_id, item_id, round(predict + 3e-10, 6) AS predict, is_cold FROM fixed_scores",
    "cold_share": "SELECT round(avg(CAST(is_cold AS DOUBLE)) + 3e-10, 6) AS cold_share FROM fixed_scores",
    "user_auc": "SELECT user_id, num, den, round(rocauc + 3e-10, 6) AS rocauc FROM time_auc",
    "mean_auc": "SELECT round(avg(rocauc) + 3e-10, 6) AS mean_auc, count(*) AS n_users FROM auc_predictions",
    "auc_report": " UNION ALL ".join(
        f"SELECT '{s}' AS model, round(avg(rocauc) + 3e-10, 6) AS mean_auc, count(*) AS n_users FROM auc_{s}"
        for s in ("predictions", "timespent", "neg_time")
    ),
    "biased_fill": """
        SELECT user_id, item_id, round(d + 3e-10, 6) AS predict,
               round(d + CAST(uid AS DOUBLE) / 100 - CAST(iid AS DOUBLE) / 10 + 3e-10, 6) AS predict_with_user_and_item_bias,
               round(CASE WHEN d IS NOT NULL THEN CAST(uid AS DOUBLE) / 100 END + 3e-10, 6) AS predict_only_user_bias,
               round(CASE WHEN d IS NOT NULL THEN -CAST(iid AS DOUBLE) / 10 END + 3e-10, 6) AS predict_only_item_bias,
               d IS NULL AS is_cold
        FROM (SELECT user_id, item_id, user_id AS uid, item_id AS iid, CASE WHEN NOT is_cold THEN predict END AS d
              FROM fixed_scores)""",
    "source_fill": """
        SELECT p.user_id, p.item_id,
               round(CASE WHEN u.embedding IS NULL OR s.embedding IS NULL THEN -1.0
                     ELSE list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) END + 3e-10, 6) AS predict,
               u.embedding IS NULL OR s.embedding IS NULL AS is_cold
        FROM (SELECT DISTINCT user_id, item_id FROM interactions) p
        LEFT JOIN items i ON i.item_id = p.item_id
        LEFT JOIN embeddings u ON u.vec_id = p.user_id AND u.vec_id IN (SELECT s_suppkey FROM supplier)
        LEFT JOIN embeddings s ON s.vec_id = i.source_id AND s.vec_id IN (SELECT p_partkey FROM part)""",
    "sequence_fill": """
        SELECT p.user_id, p.item_id,
               round(CASE WHEN h.v IS NULL OR i.embeddings IS NULL THEN -1.0
                     ELSE list_dot_product(h.v, CAST(i.embeddings AS DOUBLE[])) END + 3e-10, 6) AS predict,
               h.v IS NULL OR i.embeddings IS NULL AS is_cold
        FROM test_pairs p LEFT JOIN items i ON i.item_id = p.item_id
        LEFT JOIN (
            SELECT user_id, list(value ORDER BY dim) AS v FROM (
                SELECT w.user_id, g.dim, avg(CAST(i.embeddings[g.dim + 1] AS DOUBLE)) AS value
                FROM w_like w JOIN items i ON i.item_id = w.item_id,
                     LATERAL (SELECT unnest(range(len(i.embeddings))) AS dim) g
                GROUP BY w.user_id, g.dim) GROUP BY user_id) h ON h.user_id = p.user_id""",
    "sequence_sentences": """
        SELECT user_id, chunk, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY pos) AS sentence
        FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1) // 1000 AS chunk FROM w_like)
        WHERE item_id IS NOT NULL GROUP BY user_id, chunk""",
    "fingerprint": """
        SELECT CAST(coalesce(sum(CAST('0x' || substr(md5(row), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS hash_sum,
               count(*) AS n_rows
        FROM (SELECT concat(""" + ", ".join(
        f"""coalesce(length(CAST("{c}" AS VARCHAR)) || ':' || CAST("{c}" AS VARCHAR), '-1:')"""
        for c in ("bookmarks", "dislike", "item_id", "like", "pos", "share", "timespent", "user_id")
    ) + """) AS row FROM interactions)""",
    "user_split": """
        SELECT user_id, item_id, pos,
               CASE WHEN CAST('0x' || substr(md5('42:' || user_id), 1, 8) AS BIGINT) % 10000 < 2000
                    THEN 'held' ELSE 'kept' END AS side
        FROM interactions""",
    "run_log": """
        SELECT 'run' AS run_id, kind, key, round(value + 3e-10, 6) AS value FROM (
          SELECT 'param' AS kind, 'test_rows' AS key, CAST(20 AS DOUBLE) AS value
          UNION ALL SELECT 'param', 'ranker_fraction', CAST(0.2 AS DOUBLE)
          UNION ALL SELECT 'metric', 'predictions_rocauc', avg(rocauc) FROM auc_predictions
          UNION ALL SELECT 'metric', 'timespent_rocauc', avg(rocauc) FROM auc_timespent
          UNION ALL SELECT 'metric', 'neg_time_rocauc', avg(rocauc) FROM auc_neg_time)""",
    "cold_flags": """
        SELECT m.model, p.user_id, p.item_id, u.user_id IS NULL OR i.item_id IS NULL AS is_cold
        FROM test_pairs p
        CROSS JOIN (SELECT unnest(['predict_als_item_like', 'predict_svd_like', 'predict_lfm_item_like',
                                   'predict_lfm_source_add_like']) AS model) m
        LEFT JOIN (SELECT DISTINCT user_id FROM w_like) u ON u.user_id = p.user_id
        LEFT JOIN (SELECT DISTINCT item_id FROM w_like) i ON i.item_id = p.item_id""",
    "side_values": """
        SELECT DISTINCT 'user' AS side, user_id AS id, 'gender' AS feature, CAST(CAST(gender AS INTEGER) AS VARCHAR) AS value
        FROM users WHERE gender IS NOT NULL
        UNION SELECT 'user', user_id, 'age', CAST(CAST(age AS INTEGER) AS VARCHAR) FROM users WHERE age IS NOT NULL
        UNION SELECT 'item', item_id, 'source_id', CAST(source_id AS VARCHAR) FROM items WHERE source_id IS NOT NULL
        UNION SELECT 'source', source_id, 'parity', CAST(source_id % 2 AS VARCHAR) FROM items WHERE source_id IS NOT NULL""",
    "side_feature_flags": """
        SELECT 'predict_lfm_item_like' AS model, user_id, item_id,
               NOT ((user_id IN (SELECT user_id FROM w_like) OR user_id IN (SELECT user_id FROM users))
                    AND (item_id IN (SELECT item_id FROM w_like) OR item_id IN (SELECT item_id FROM items))) AS is_cold
        FROM test_pairs
        UNION ALL
        SELECT 'predict_lfm_source_like', user_id, item_id,
               NOT ((user_id IN (SELECT user_id FROM rekeyed) OR user_id IN (SELECT user_id FROM users))
                    AND item_id IN (SELECT item_id FROM items))
        FROM test_pairs""",
    "ranker_gradients": """
        SELECT s.draw, s.user_id, s.item_id, CAST(s.target AS DOUBLE) AS target,
               round(coalesce(sum(p.g), 0) + 3e-10, 6) AS grad, round(coalesce(sum(p.h), 0) + 3e-10, 6) AS hess
        FROM states s LEFT JOIN (
            SELECT draw, user_id, upper AS item_id, w * s * wrong AS g, w * wrong * (1 - wrong) AS h FROM noisy_pairs
            UNION ALL SELECT draw, user_id, lower, -w * s * wrong, w * wrong * (1 - wrong) FROM noisy_pairs) p
          ON p.draw = s.draw AND p.user_id = s.user_id AND p.item_id = s.item_id
        GROUP BY s.draw, s.user_id, s.item_id, s.target""",
    "split_files": """
        SELECT user_id, item_id, pos, 'als' AS part FROM als
        UNION ALL SELECT user_id, item_id, pos, 'cb' FROM cb
        UNION ALL SELECT user_id, item_id, pos, 'cb' FROM test
        UNION ALL SELECT user_id, item_id, pos, 'test' FROM test""",
    "pair_files": "SELECT user_id, item_id FROM test_pairs",
    "submission_files": "SELECT user_id, item_id, round(timespent, 6) AS predict FROM test",
    "feature_pool": """
        SELECT feature, count(*) AS n_rows, round(min(v) + 3e-10, 6) AS low, round(max(v) + 3e-10, 6) AS high,
               round(avg(v) + 3e-10, 6) AS mean
        FROM (
            SELECT l.feature, coalesce(l.v, m.low - 1, -1) AS v FROM long_features l JOIN feature_lows m ON m.feature = l.feature
            UNION ALL
            SELECT l.feature || '_missing', CAST(l.v IS NULL AS DOUBLE)
            FROM long_features l JOIN feature_lows m ON m.feature = l.feature WHERE m.n_known < m.n_all
            UNION ALL
            SELECT 'embeddings_' || g.dim, coalesce(CAST(i.embeddings[g.dim + 1] AS DOUBLE), 0)
            FROM test_pairs p LEFT JOIN items i ON i.item_id = p.item_id, (SELECT unnest(range(64)) AS dim) g)
        GROUP BY feature""",
    "item_vectors": """
        SELECT item_id, len(embeddings) AS n, round(list_sum(CAST(embeddings AS DOUBLE[])) + 3e-10, 6) AS total FROM items""",
    "table_files": """
        SELECT 'interactions' AS name, count(*) AS n_rows, CAST(sum(pos) AS BIGINT) AS total FROM interactions
        UNION ALL SELECT 'items', count(*), CAST(sum(source_id) AS BIGINT) FROM items
        UNION ALL SELECT 'users', count(*), CAST(sum(user_id) AS BIGINT) FROM users""",
    "output_cache": """
        SELECT item_id, n, likes, answer, 1 AS computed
        FROM (SELECT item_id, count(*) AS n, sum("like") AS likes FROM interactions GROUP BY item_id),
             (SELECT unnest([1, 2]) AS answer)""",
    "model_cache": """
        SELECT 'items' AS side, item_id AS id, sum(weight) AS weight, 1 AS fits FROM w_like GROUP BY item_id
        UNION ALL SELECT DISTINCT 'users', user_id, NULL, 1 FROM w_like""",
    "sequence_pairs": """
        SELECT a.item_id AS centre, b.item_id AS context, CAST(count(*) AS DOUBLE) AS weight
        FROM placed a JOIN placed b ON a.user_id = b.user_id AND abs(a.seq - b.seq) BETWEEN 1 AND 5
        GROUP BY a.item_id, b.item_id""",
    "ease_gram": """
        SELECT a.item_id AS item_j, b.item_id AS item_i, round(sum(a.weight * b.weight) + 3e-10, 6) AS g
        FROM (SELECT user_id, item_id, sum(weight) AS weight FROM w_like GROUP BY user_id, item_id) a
        JOIN (SELECT user_id, item_id, sum(weight) AS weight FROM w_like GROUP BY user_id, item_id) b ON a.user_id = b.user_id
        GROUP BY a.item_id, b.item_id HAVING sum(a.weight * b.weight) <> 0""",
}
# wide results: every DOUBLE column is rounded by a COLUMNS expression over its name list
_WIDE = {
    "item_stats": "item_stats",
    "source_stats": "source_stats",
    "source_duration_stats": "durations",
    "source_stats_combined": "combined",
    "user2source_stats": "user_source",
    "user_stats": "user_stats",
    "feature_table": "feature_table",
    "feature_files": "feature_table",
    "search_feature_table": "search_table",
}
_NOT_DOUBLE = (
    "user_id|item_id|source_id|pos|like|dislike|share|bookmarks|rn|n_users(_source)?|n_items"
    "|sum_(like|dislike|share|bookmarks|positive)(_source)?"
    "|user2source_sum_.*|user2source_source_interactions|n_total_interactions"
    "|user_total_(likes|dislikes|share|bookmarks|interactions)|user_n_.*|user_(liked_)?source_id_mode"
    "|is_(user|liked)_source_id_mode"
)


def _with(select: str) -> str:
    """Prefix the CTEs ``select`` needs, in order."""
    import re

    names = list(_CTES)
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in needed and re.search(rf"(FROM|JOIN)\s+{n}\b", text):
                needed.add(n)
                todo.append(_CTES[n])
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for m in names:
            if m != n and re.search(rf"(FROM|JOIN)\s+{m}\b", _CTES[n]):
                visit(m)
        ordered.append(n)

    for n in sorted(needed, key=names.index):
        visit(n)
    body = ",\n".join(f"{n} AS ({_CTES[n]})" for n in ordered)
    return f"WITH {body}\n{select}" if ordered else select


def _wide(table: str) -> str:
    modes = ""
    if table in ("user_stats", "search_table"):
        modes = (
            ", array_to_string(user_source_id_mode, ',') AS user_source_id_mode"
            ", array_to_string(user_liked_source_id_mode, ',') AS user_liked_source_id_mode"
        )
    keep = f"COLUMNS(lambda c: regexp_full_match(c, '{_NOT_DOUBLE}')" + (
        " AND NOT regexp_full_match(c, 'user_(liked_)?source_id_mode'))" if modes else ")"
    )
    return f"SELECT {keep}, round(COLUMNS(lambda c: NOT regexp_full_match(c, '{_NOT_DOUBLE}')) + 3e-10, 6){modes} FROM {table}"


def oracle_sql() -> dict[str, str]:
    out = {name: _with(text) for name, text in _SELECTS.items()}
    out.update({name: _with(_wide(table)) for name, table in _WIDE.items()})
    return out
