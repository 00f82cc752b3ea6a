"""Registered exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.genres import DRIVER_GENRES
from rankloom.operators import eda
from rankloom.operators import features as FE
from rankloom.plans import sqlfrag as Q
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T


def _hist_sql(src: str, col: str, n: int) -> str:
    return f""",
hv AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
hb AS (SELECT min(x) AS lo, max(x) AS hi FROM hv),
hc AS (SELECT CASE WHEN hb.hi = hb.lo THEN 0 ELSE least(greatest(CAST(floor((x - hb.lo) / ((hb.hi - hb.lo) / {float(n)!r})) AS INTEGER), 0), {n - 1}) END AS bin,
              count(*) AS n FROM hv, hb GROUP BY 1),
spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range({n}))
SELECT s.bin, round(hb.lo + s.bin * ((hb.hi - hb.lo) / {float(n)!r}), 6) AS bin_lo, coalesce(hc.n, 0) AS n
FROM spine s CROSS JOIN hb LEFT JOIN hc ON s.bin = hc.bin"""


@register("dataset_summary", T.sql_with("ratings") + """
SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       round(1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS sparsity FROM ratings""")
def dataset_summary(spark, sf_dir):
    """S5 + A6 + A8: counts and sparsity."""
    return rounded(eda.dataset_summary(T.ratings(spark, sf_dir)))


@register("rating_distribution", T.sql_with("ratings") + "SELECT rating, count(*) AS n FROM ratings GROUP BY rating")
def rating_distribution(spark, sf_dir):
    """A7."""
    return eda.rating_distribution(T.ratings(spark, sf_dir))


@register("user_activity_histogram", T.sql_with("ratings").rstrip() + """,
per AS (SELECT user_id, count(*) AS n_ratings FROM ratings GROUP BY user_id)""" + _hist_sql("per", "n_ratings", 50))
def user_activity_histogram(spark, sf_dir):
    """50-bin histogram of ratings per user."""
    return rounded(eda.user_activity(T.ratings(spark, sf_dir))[0])


@register("user_activity_median", T.sql_with("ratings") + """
SELECT quantile_cont(n, 0.5) AS median_ratings FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id)""")
def user_activity_median(spark, sf_dir):
    """Median ratings per user."""
    return eda.user_activity(T.ratings(spark, sf_dir))[1]


@register("genre_counts", T.sql_with("movies") + """,
toks AS (SELECT unnest(string_split(genres, '|')) AS genre FROM movies),
vocab AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{g}')" for i, g in enumerate(DRIVER_GENRES)) + """) v(pos, genre))
SELECT CAST(v.pos AS INTEGER) AS pos, v.genre, count(t.genre) AS n
FROM vocab v LEFT JOIN toks t ON v.genre = t.genre GROUP BY v.pos, v.genre""")
def genre_counts(spark, sf_dir):
    """A10: genre occurrences over the vocabulary (zeros kept)."""
    return eda.genre_counts(T.movies(spark, sf_dir))


@register("gender_summary", T.sql_with("ratings", "users") + """,
n AS (SELECT gender, count(*) AS n_users FROM users GROUP BY gender),
m AS (SELECT u.gender, avg(r.rating) AS mean_rating, count(*) AS n_ratings
      FROM ratings r JOIN users u ON r.user_id = u.user_id GROUP BY u.gender)
SELECT coalesce(n.gender, m.gender) AS gender, n.n_users, round(m.mean_rating, 6) AS mean_rating, m.n_ratings
FROM n FULL JOIN m ON n.gender = m.gender""")
def gender_summary(spark, sf_dir):
    """A11 + J9: users and mean rating per gender."""
    return rounded(eda.gender_summary(T.ratings(spark, sf_dir), T.users(spark, sf_dir)))


@register("age_groups", T.sql_with("users") + """,
labels AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {a}, '{l}')" for i, (a, l) in enumerate(eda.AGE_LABELS)) + """) v(pos, age, age_label)),
c AS (SELECT age, count(*) AS n FROM users GROUP BY age)
SELECT CAST(l.pos AS INTEGER) AS pos, l.age_label, coalesce(c.n, 0) AS n FROM labels l LEFT JOIN c ON l.age = c.age""")
def age_groups(spark, sf_dir):
    """age labels in fixed order with empty groups."""
    return eda.age_groups(T.users(spark, sf_dir))


@register("monthly_activity", T.sql_with("ratings") + "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM ratings GROUP BY 1")
def monthly_activity(spark, sf_dir):
    """A12."""
    return eda.monthly_activity(T.ratings(spark, sf_dir))


@register("user_avg_rating_histogram", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes()
          + _hist_sql("uf", "avg_rating", 30)[0:])
def user_avg_rating_histogram(spark, sf_dir):
    """30-bin histogram of user average rating."""
    uf = FE.user_features(T.ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir))
    return rounded(eda.feature_summary(uf, "avg_rating")[0])


@register("feature_moments", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes()
          + Q.item_features_ctes() + """
SELECT 'user_avg_rating' AS feature, round(avg(avg_rating), 6) AS mean, round(stddev_samp(avg_rating), 6) AS std, count(avg_rating) AS n FROM uf
UNION ALL SELECT 'item_popularity_score', round(avg(popularity_score), 6), round(stddev_samp(popularity_score), 6), count(popularity_score) FROM itf""")
def feature_moments(spark, sf_dir):
    """Mean / sample std of user average rating and item popularity score."""
    r, u, m = T.ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    a = eda.feature_summary(FE.user_features(r, u, m), "avg_rating")[1].select(F.lit("user_avg_rating").alias("feature"), "*")
    b = eda.feature_summary(FE.item_features(r, m), "popularity_score")[1].select(
        F.lit("item_popularity_score").alias("feature"), "*")
    return rounded(a.unionByName(b))


_CURVE = T.sql_with("ratings") + """,
pop AS (SELECT item_id, count(*) AS n_ratings FROM ratings GROUP BY item_id),
curve AS (SELECT item_id, n_ratings, row_number() OVER (ORDER BY n_ratings DESC, item_id) - 1 AS pos,
                 sum(n_ratings) OVER (ORDER BY n_ratings DESC, item_id ROWS UNBOUNDED PRECEDING)
                   / CAST((SELECT count(*) FROM ratings) AS DOUBLE) AS cumulative_share FROM pop)
"""


@register("popularity_curve", _CURVE + """
SELECT item_id, n_ratings, pos, pos + 1 AS rank, round(cumulative_share, 6) AS cumulative_share FROM curve""")
def popularity_curve(spark, sf_dir):
    """W6 + W8: rank-frequency table with cumulative share of ratings."""
    return rounded(eda.popularity_curve(T.ratings(spark, sf_dir)))


@register("long_tail", _CURVE + """
SELECT min(CASE WHEN cumulative_share >= 0.8 THEN pos END) AS pos_80, count(*) AS n_items,
       max(n_ratings) AS max_ratings, quantile_cont(n_ratings, 0.5) AS median_ratings,
       round(min(CASE WHEN cumulative_share >= 0.8 THEN pos END) / count(*), 6) AS share_of_items FROM curve""")
def long_tail(spark, sf_dir):
    """W7 + A14: catalogue share covering 80 % of ratings, head and median counts."""
    return rounded(eda.long_tail(T.ratings(spark, sf_dir)))
