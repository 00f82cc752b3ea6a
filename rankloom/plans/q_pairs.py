"""Registered pair, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import features as FE
from rankloom.operators import pairs as PA
from rankloom.plans import sqlfrag as Q
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T


def _ratings(spark, sf_dir):
    """The ratings base table of a training job, written once (it is scanned ~6 times)."""
    from rankloom.session import materialize
    return materialize(T.ratings(spark, sf_dir), "ratings")


def _pairs(spark, sf_dir, r=None):
    r = _ratings(spark, sf_dir) if r is None else r
    return PA.training_pairs(r, 4, 42, test_ratio=0.1)


@register("training_pairs", T.sql_with("ratings").rstrip() + Q.training_pairs_ctes() + """
SELECT user_id, item_id, CAST(label AS INTEGER) AS label, rating, CAST(query_id AS BIGINT) AS query_id, split FROM pairs""")
def training_pairs(spark, sf_dir):
    """P1-P3 + W3 + W4: positives, 4 portable negatives per positive, query ids, group split."""
    p = _pairs(spark, sf_dir)
    return p.select("user_id", "item_id", F.col("label").cast("int"), "rating",
                    F.col("query_id").cast("bigint"), "split")


@register("pair_group_sizes", T.sql_with("ratings").rstrip() + Q.training_pairs_ctes() + """
SELECT query_id, split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos FROM pairs GROUP BY query_id, split""")
def pair_group_sizes(spark, sf_dir):
    """A5: group sizes per query (LambdaMART group layout) and positives per group."""
    p = _pairs(spark, sf_dir)
    return p.groupBy("query_id", "split").agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.sum("label").cast("bigint").alias("n_pos"))


@register("epoch_negatives", T.sql_with("ratings", "movies").rstrip() + Q.epoch_triples_ctes(3) + """
SELECT user_id, pos_item, neg_item FROM tri""")
def epoch_negatives(spark, sf_dir):
    """One unrated catalogue item for every positive, drawn for epoch 3."""
    return PA.epoch_negatives(T.ratings(spark, sf_dir), epoch=3, catalogue=T.movies(spark, sf_dir))


@register("last_n_holdout", T.sql_with("ratings") + """
SELECT user_id, item_id, rating, ts, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY """ + Q.ORDER_KEY_DESC + """) AS rn FROM ratings)
WHERE rn <= (SELECT greatest(1, floor(count(*) * 0.1 / count(DISTINCT user_id))) FROM ratings)""")
def last_n_holdout(spark, sf_dir):
    """Last-N ratings per user by time (same N for all users)."""
    h = PA.last_n_holdout(T.ratings(spark, sf_dir))
    return h.select("user_id", "item_id", "rating", "ts", "l_orderkey", "l_linenumber")


@register("evaluation_users", T.sql_with("ratings") + """,
hold AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY """ + Q.ORDER_KEY_DESC + """) AS rn FROM ratings)
  WHERE rn <= (SELECT greatest(1, floor(count(*) * 0.1 / count(DISTINCT user_id))) FROM ratings)),
firsts AS (SELECT user_id, min((""" + Q.ORDER_KEY + """)) AS f FROM hold GROUP BY user_id)
SELECT user_id, row_number() OVER (ORDER BY f, user_id) - 1 AS eval_order FROM firsts ORDER BY f, user_id LIMIT 200""")
def evaluation_users(spark, sf_dir):
    """The reference's evaluation sample -- first 200 users of the time-ordered holdout."""
    h = PA.last_n_holdout(T.ratings(spark, sf_dir))
    return PA.evaluation_users(h, 200).select("user_id", F.col("eval_order").cast("bigint"))


@register("item_universe", T.sql_with("ratings") + "SELECT DISTINCT item_id FROM ratings")
def item_universe(spark, sf_dir):
    """Distinct rated items."""
    return PA.item_universe(T.ratings(spark, sf_dir))


def pair_matrix_sql() -> str:
    """CTE chain ending in ``pfm``: every P1 pair with its 50 features and split."""
    return (T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + Q.item_features_ctes()
            + Q.training_pairs_ctes() + """,
m AS (SELECT p.user_id, p.item_id, p.label, p.query_id, p.split,
             u.avg_rating, u.log_rating_count, u.recency_score, u.gender_encoded, u.age_normalized,
             u.occupation_normalized, u.genre_pref,
             i.avg_rating AS item_avg_rating, i.log_rating_count AS item_log_rating_count,
             i.popularity_score, i.rating_stddev, i.year_normalized, i.genre_vector
      FROM pairs p LEFT JOIN uf u ON p.user_id = u.user_id LEFT JOIN itf i ON p.item_id = i.item_id),
pfm AS (SELECT user_id, item_id, CAST(label AS INTEGER) AS label, CAST(query_id AS BIGINT) AS query_id, split,
""" + ",\n".join(f"coalesce({c}, 0.0) AS {c}" for c in FE.USER_SCALARS + FE.ITEM_SCALARS) + """,
  coalesce(avg_rating - item_avg_rating, 0.0) AS rating_diff,
  coalesce(log_rating_count / (item_log_rating_count + 1e-8), 0.0) AS user_item_popularity_ratio,
  coalesce(""" + Q.dot("genre_pref", "genre_vector") + """, 0.0) AS genre_affinity,
""" + ",\n".join(f"coalesce(genre_pref[{k + 1}], 0.0) AS user_genre_{k}" for k in range(18)) + ",\n"
            + ",\n".join(f"coalesce(genre_vector[{k + 1}], 0.0) AS item_genre_{k}" for k in range(18)) + """
FROM m)
""")


def pair_rows(spark, sf_dir):
    """The P1 pair matrix with ``split``, as a plan: a reader of few columns or one split makes just these."""
    r, u, m = _ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    p = _pairs(spark, sf_dir, r)
    pf = FE.pair_features(p, FE.user_features(r, u, m), FE.item_features(r, m), carry=("split",))
    return pf.select("user_id", "item_id", F.col("label").cast("int"), F.col("query_id").cast("bigint"),
                     "split", *FE.FEATURE_COLUMNS)


def pair_matrix(spark, sf_dir):
    """The materialised P1 pair matrix with ``split`` (for the ranker's training, which reads it often)."""
    from rankloom.session import materialize
    return materialize(pair_rows(spark, sf_dir), "pair_matrix")


@register("pair_features", pair_matrix_sql() + "SELECT user_id, item_id, label, query_id, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in FE.FEATURE_COLUMNS) + " FROM pfm")
def pair_features(spark, sf_dir):
    """J3 + F10-F14: the 50-column training matrix over all P1 pairs."""
    r, u, m = _ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    p = PA.training_pairs(r, 4, 42)      # the split is not part of this matrix
    pf = FE.pair_features(p, FE.user_features(r, u, m), FE.item_features(r, m))
    return rounded(pf.select("user_id", "item_id", F.col("label").cast("int"),
                             F.col("query_id").cast("bigint"), *FE.FEATURE_COLUMNS))
