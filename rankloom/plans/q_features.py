"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.genres import N_GENRES
from rankloom.functions.vectors import expand
from rankloom.operators import features as FE
from rankloom.plans import sqlfrag as Q
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T


@register("user_features", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + f"""
SELECT user_id, round(avg_rating, 6) AS avg_rating, rating_count, round(recency_score, 6) AS recency_score,
       round(log_rating_count, 6) AS log_rating_count, round(gender_encoded, 6) AS gender_encoded,
       round(age_normalized, 6) AS age_normalized, round(occupation_normalized, 6) AS occupation_normalized,
       {Q.expand('genre_pref', 'genre_pref_')}
FROM uf""")
def user_features(spark, sf_dir):
    """A1 + F2-F5 + A3 + J1, written in the S7 layout (genre_pref_0..17)."""
    uf = FE.user_features(T.ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir))
    return rounded(uf.select("user_id", "avg_rating", "rating_count", "recency_score", "log_rating_count",
                             "gender_encoded", "age_normalized", "occupation_normalized",
                             *expand("genre_pref", "genre_pref_", N_GENRES)))


@register("item_features", T.sql_with("ratings", "movies").rstrip() + Q.item_features_ctes() + f"""
SELECT item_id, round(avg_rating, 6) AS avg_rating, rating_count, round(rating_stddev, 6) AS rating_stddev,
       round(log_rating_count, 6) AS log_rating_count, round(popularity_score, 6) AS popularity_score,
       title, round(year_normalized, 6) AS year_normalized, {Q.expand('genre_vector', 'genre_vec_')}
FROM itf""")
def item_features(spark, sf_dir):
    """A2 + F6-F8 + F1 + J2, written in the S7 layout (genre_vec_0..17)."""
    itf = FE.item_features(T.ratings(spark, sf_dir), T.movies(spark, sf_dir))
    return rounded(itf.select("item_id", "avg_rating", "rating_count", "rating_stddev", "log_rating_count",
                              "popularity_score", "title", "year_normalized",
                              *expand("genre_vector", "genre_vec_", N_GENRES)))


@register("catalogue_genres", T.sql_with("movies").rstrip() + f""",
yr AS (SELECT item_id, title, genres,
              CAST(nullif(regexp_extract(title, '\\((\\d{{4}})\\)$', 1), '') AS DOUBLE) AS year FROM movies)
SELECT item_id, year,
       round(coalesce((year - (SELECT min(year) FROM yr)) / ((SELECT max(year) FROM yr) - (SELECT min(year) FROM yr) + 1e-8), 0.5), 6)
         AS year_normalized,
       {Q.expand(Q.multi_hot('genres'), 'genre_', digits=None)}
FROM yr""")
def catalogue_genres(spark, sf_dir):
    """F1 + F7 + F8 over the whole catalogue: multi-hot genres and normalised year."""
    m = FE.catalogue_years(T.movies(spark, sf_dir))
    from rankloom.functions.genres import multi_hot
    return rounded(m.select("item_id", "year", "year_normalized",
                            *expand(multi_hot("genres"), "genre_", N_GENRES)))


@register("genre_preference", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + f"""
SELECT user_id, {Q.expand('genre_pref', 'pref_')},
       round(sqrt({Q.dot('genre_pref', 'genre_pref')}), 6) AS pref_norm
FROM pref""")
def genre_preference(spark, sf_dir):
    """A3 alone: users with at least one liked, catalogued rating."""
    from rankloom.functions.vectors import norm
    p = FE.genre_preference(T.ratings(spark, sf_dir), FE.item_genre_vectors(T.movies(spark, sf_dir)))
    return rounded(p.select("user_id", *expand("genre_pref", "pref_", N_GENRES),
                            norm("genre_pref", N_GENRES).alias("pref_norm")))
