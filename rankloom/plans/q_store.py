"""Registered source / sink / store queries."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import functions as F

from rankloom.operators import features as FE
from rankloom.operators import retrieval as R
from rankloom.operators import serving
from rankloom.operators import telemetry as TM
from rankloom.plans import sqlfrag as Q
from rankloom.plans.catalog import register, rounded
from rankloom.sources import dat, store
from rankloom.sources import tables as T
from rankloom.functions.vectors import expand

T0 = datetime(2024, 2, 1, 0, 0, 0)


def _t(seconds: int) -> datetime:
    from datetime import timedelta
    return T0 + timedelta(seconds=seconds)


@register("dat_ratings_roundtrip", T.sql_with("ratings") + """
SELECT user_id, item_id, rating, ts FROM ratings""")
def dat_ratings_roundtrip(spark, sf_dir):
    """S1 + S2: ratings written as ``user::item::rating::epoch`` text and read back."""
    from rankloom.functions.scalars import epoch_micros
    r = T.ratings(spark, sf_dir).select("user_id", "item_id", "rating",
                                        F.floor(epoch_micros(F.col("ts")) / 1_000_000).alias("epoch"))
    p = os.path.join(store.new_store_path(spark, "dat"), "ratings.dat")
    dat.write_dat(r, p, ["user_id", "item_id", "rating", "epoch"])
    return dat.read_ratings(spark, p)


@register("dat_catalogue_roundtrip", T.sql_with("users", "movies") + """
SELECT 'movie' AS kind, item_id AS id, title AS a, genres AS b FROM movies
UNION ALL SELECT 'user', user_id, gender || '/' || CAST(age AS VARCHAR) || '/' || CAST(occupation AS VARCHAR), zip_code FROM users""")
def dat_catalogue_roundtrip(spark, sf_dir):
    """S3 + S4: users and movies written as ``::`` text and read back with the latin-1 readers."""
    base = store.new_store_path(spark, "dat")
    dat.write_dat(T.movies(spark, sf_dir), os.path.join(base, "movies.dat"), ["item_id", "title", "genres"])
    dat.write_dat(T.users(spark, sf_dir), os.path.join(base, "users.dat"),
                  ["user_id", "gender", "age", "occupation", "zip_code"])
    m = dat.read_movies(spark, os.path.join(base, "movies.dat"))
    u = dat.read_users(spark, os.path.join(base, "users.dat"))
    return m.select(F.lit("movie").alias("kind"), F.col("item_id").alias("id"), F.col("title").alias("a"),
                    F.col("genres").alias("b")).unionByName(u.select(
                        F.lit("user").alias("kind"), F.col("user_id").alias("id"),
                        F.concat_ws("/", "gender", F.col("age").cast("string"), F.col("occupation").cast("string")).alias("a"),
                        F.col("zip_code").alias("b")))


@register("input_counts", T.sql_with("ratings", "users", "movies") + """
SELECT 'ratings' AS input, count(*) AS n FROM ratings UNION ALL SELECT 'users', count(*) FROM users
UNION ALL SELECT 'movies', count(*) FROM movies""")
def input_counts(spark, sf_dir):
    """Row counts of the three inputs after load."""
    parts = [(n, f(spark, sf_dir)) for n, f in (("ratings", T.ratings), ("users", T.users), ("movies", T.movies))]
    out = None
    for n, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("input"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@register("table_audit", "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", true AS present, count(*) AS rows FROM {t}" for t in T.TABLES))
def table_audit(spark, sf_dir):
    """Every expected driver table present, with its size."""
    return store.table_audit(spark, sf_dir, T.TABLES)


def _published(spark, sf_dir):
    r, u, m = T.ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    path = store.new_store_path(spark)
    store.publish_features(FE.user_features(r, u, m), FE.item_features(r, m), path, _t(0))
    return path, m


@register("store_item_lookup", T.sql_with("ratings", "movies").rstrip() + Q.item_features_ctes() + """
SELECT m.item_id, i.item_id IS NOT NULL AS found, round(i.avg_rating, 6) AS avg_rating, i.rating_count,
       round(i.popularity_score, 6) AS popularity_score, round(i.year_normalized, 6) AS year_normalized
FROM movies m LEFT JOIN itf i ON m.item_id = i.item_id""")
def store_item_lookup(spark, sf_dir):
    """S9 + S11 + J11: publish item features, then batch-get every catalogue id (unrated ids -> not found)."""
    path, m = _published(spark, sf_dir)
    got = store.lookup(spark, path, "item", m.select("item_id"), "item_id", _t(60))
    return rounded(got.select("item_id", "found", "payload.avg_rating", "payload.rating_count",
                              "payload.popularity_score", "payload.year_normalized"))


@register("store_user_roundtrip", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + f"""
SELECT user_id, round(avg_rating, 6) AS avg_rating, rating_count, round(recency_score, 6) AS recency_score,
       {Q.expand('genre_pref', 'genre_pref_')} FROM uf""")
def store_user_roundtrip(spark, sf_dir):
    """S9 + S10 + S12: user rows read back from the store while live."""
    path, _ = _published(spark, sf_dir)
    live = store.read_live(spark, path, "user", _t(3599))
    return rounded(live.select(F.col("entity_id").alias("user_id"), "payload.avg_rating", "payload.rating_count",
                               "payload.recency_score", *expand("payload.genre_pref", "genre_pref_", 18)))


@register("store_expiry", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes()
          + Q.item_features_ctes() + """
SELECT 'item' AS kind, count(*) AS n_live_before, 0 AS n_live_after FROM itf
UNION ALL SELECT 'user', count(*), 0 FROM uf""")
def store_expiry(spark, sf_dir):
    """S12 + S16: live keys per kind one second before and one second after the 3600 s TTL."""
    path, _ = _published(spark, sf_dir)
    before = store.stats(spark, path, ["item", "user"], _t(3599)).select("kind", F.col("n_keys").alias("n_live_before"))
    after = store.stats(spark, path, ["item", "user"], _t(3601)).select("kind", F.col("n_keys").alias("n_live_after"))
    out = before.join(after, "kind", "left").select("kind", "n_live_before",
                                                     F.coalesce("n_live_after", F.lit(0)).cast("int").alias("n_live_after"))
    return out


@register("feature_parquet_roundtrip", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes()
          + Q.item_features_ctes() + f"""
SELECT 'user' AS kind, user_id AS id, round(sqrt({Q.dot('genre_pref', 'genre_pref')}), 6) AS vec_norm,
       round(avg_rating, 6) AS avg_rating FROM uf
UNION ALL SELECT 'item', item_id, round(sqrt({Q.dot('genre_vector', 'genre_vector')}), 6), round(avg_rating, 6) FROM itf""")
def feature_parquet_roundtrip(spark, sf_dir):
    """S7 + S8: features written with expanded genre columns and regrouped on read."""
    from rankloom.functions.vectors import norm
    r, u, m = T.ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    out = store.new_store_path(spark, "features")
    store.write_features(FE.user_features(r, u, m), FE.item_features(r, m), out)
    uf, itf = store.read_features(spark, out)
    a = uf.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), norm("genre_pref", 18).alias("vec_norm"),
                  "avg_rating")
    b = itf.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), norm("genre_vector", 18).alias("vec_norm"),
                   "avg_rating")
    return rounded(a.unionByName(b))


def _cached_sql():
    base = (T.sql_with("ratings", "users", "movies", "requests").rstrip() + Q.user_features_ctes() + Q.item_features_ctes()
            + Q.serving_ctes(serving_n_cand(), 10, 100, serving.DEFAULT_WEIGHTS, serving.USER_DEFAULTS,
                             serving.ITEM_DEFAULTS, query_users="(SELECT * FROM uf WHERE user_id IN (SELECT user_id FROM req))",
                             cold_users="(SELECT DISTINCT user_id FROM req)"))
    base = base.replace("WITH ratings AS", "WITH req AS (SELECT request_id, user_id, coalesce(k, 20) AS k FROM ("
                        + T.SQL_VIEWS["requests"].split(" AS (", 1)[1].rsplit(")", 1)[0]
                        + ") WHERE user_id > 0 AND coalesce(k, 20) BETWEEN 1 AND 100),\nratings AS", 1)
    return base + """
SELECT q.request_id, q.user_id, r.rank, r.item_id, r.title, round(r.score, 6) AS score,
       round(r.retrieval_score, 6) AS retrieval_score, r.genres,
       CASE WHEN q.k <= 10 AND r.source = 'model' THEN 'cache' ELSE 'model' END AS source
FROM req q JOIN recs r ON q.user_id = r.user_id WHERE r.rank <= q.k"""


def serving_n_cand():
    return 500


def _serve(spark, sf_dir):
    """Requests, the ranked lists of their users (scored once, at the largest k), and a
    store that holds the ten best of every model list."""
    from rankloom.operators.towers import content_item_vectors, content_user_vectors
    from rankloom.session import materialize
    r, u, m = materialize(T.ratings(spark, sf_dir), "ratings"), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    uf, itf = materialize(FE.user_features(r, u, m), "uf"), materialize(FE.item_features(r, m), "itf")
    cent = R.basis_centroids(spark, 18)
    reqs = TM.validate_requests(T.requests(spark, sf_dir)).filter(F.col("reject_reason").isNull()) \
        .select("request_id", "user_id", F.col("k_eff").alias("k"))
    req_users = materialize(reqs.select("user_id").distinct(), "req_users")
    ufr = uf.join(req_users, "user_id", "left_semi")
    cands = serving.retrieve_lists(content_user_vectors(ufr), content_item_vectors(m), cent, 18, serving_n_cand(), 10)
    lists = materialize(serving.recommend_batch(r, req_users, m, ufr, itf, cent, 100, serving_n_cand(), 10, candidates=cands), "lists")
    path = store.new_store_path(spark, "recs")
    store.cache_recs(lists.filter("source = 'model' AND rank <= 10"), path, _t(0), k_built=10)

    def answer(as_of):
        return serving.serve_with_cache(
            reqs, store.read_cached_recs(spark, path, as_of), lambda us: lists.join(us, "user_id", "left_semi"),
            write_back=lambda fresh: store.cache_recs(fresh, path, as_of, k_built=100))
    return answer


@register("cached_serving", _cached_sql())
def cached_serving(spark, sf_dir):
    """V4 + S13 + S14 + F19: lists cached at k = 10 answer requests with k <= 10;
    larger k (and users without a cached list) are computed and written back; id 0 / bad
    k rejected."""
    out = _serve(spark, sf_dir)(_t(60))
    return rounded(out.withColumn("genres", F.array_join("genres", "|")))


@register("cached_serving_again", _cached_sql().replace(
    "CASE WHEN q.k <= 10 AND r.source = 'model' THEN 'cache' ELSE 'model' END AS source", "'cache' AS source"))
def cached_serving_again(spark, sf_dir):
    """V4 + S13: the same requests again, after the misses were written back: all hits."""
    answer = _serve(spark, sf_dir)
    answer(_t(60))
    out = answer(_t(120))
    return rounded(out.withColumn("genres", F.array_join("genres", "|")))


@register("store_user_get", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + """
SELECT user_id, round(avg_rating, 6) AS avg_rating, rating_count FROM uf WHERE user_id = (SELECT max(user_id) FROM uf)""")
def store_user_get(spark, sf_dir):
    """One key read from its bucket, after a later put of other rows and a compaction."""
    path, _ = _published(spark, sf_dir)
    live = store.read_live(spark, path, "user", _t(10))
    key = live.agg(F.max("entity_id")).first()[0]
    others = live.where(F.col("entity_id") < key).select(F.col("entity_id").alias("user_id"), "payload.*").withColumn("rating_count", F.lit(-1).cast("long"))
    store.put(others, path, "user", "user_id", _t(20))
    store.compact(spark, path, "user", _t(30))
    got = store.get(spark, path, "user", key, _t(60))
    return rounded(got.select(F.col("entity_id").alias("user_id"), "payload.avg_rating", "payload.rating_count"))


@register("store_flush", T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + """
SELECT 'before' AS version, count(*) AS n FROM uf UNION ALL SELECT 'after', 0""")
def store_flush(spark, sf_dir):
    """Live rows of the version before a flush (its readers keep it) and of the one after."""
    path, _ = _published(spark, sf_dir)
    after = store.flush(spark, path, "user")
    rows = [store.read_live(spark, path, "user", _t(10), version=v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("version"), "n")
            for name, v in (("before", after - 1), ("after", after))]
    return rows[0].unionByName(rows[1])
