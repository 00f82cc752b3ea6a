"""Serving-table behaviour: exclude-seen, responses, request records, index and store persistence."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.operators import features as FE
from rankloom.operators import retrieval as R
from rankloom.operators import serving
from rankloom.sources import store
from rankloom.sources import tables as T


@pytest.fixture(scope="module")
def parts(spark, sf):
    r, u, m = T.ratings(spark, sf), T.users(spark, sf), T.movies(spark, sf)
    return r, u, m, FE.user_features(r, u, m).cache(), FE.item_features(r, m).cache(), R.basis_centroids(spark, 18)


def test_exclude_seen_removes_rated_items(parts):
    r, u, m, uf, itf, cent = parts
    out = serving.recommend_batch(r, u, m, uf, itf, cent, 10, 200, 10, exclude_seen=r)
    seen = out.filter("source = 'model'").join(r.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    assert seen.count() == 0


def test_every_user_gets_k_ranked_rows(parts):
    r, u, m, uf, itf, cent = parts
    out = serving.recommend_batch(r, u, m, uf, itf, cent, 10, 200, 10)
    per = out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    assert per.filter((F.col("n") != 10) | (F.col("lo") != 1) | (F.col("hi") != 10)).count() == 0
    assert per.count() == u.count()   # warm, cold and degraded users all served


def test_responses_sorted_and_rounded(parts):
    r, u, m, uf, itf, cent = parts
    resp = serving.responses(serving.recommend_batch(r, u, m, uf, itf, cent, 5, 100, 10)).collect()
    for row in resp[:20]:
        ranks = [x["rank"] for x in row["recommendations"]]
        assert ranks == sorted(ranks) and row["n_results"] == 5
        assert all(round(x["score"], 6) == x["score"] for x in row["recommendations"])


def test_request_records(spark):
    served = spark.createDataFrame([(1, 7, "cache"), (1, 7, "cache"), (2, 8, "model")],
                                   "request_id long, user_id long, source string")
    rec = {r["request_id"]: (r["n_results"], r["cache_hit"]) for r in serving.request_records(served).collect()}
    assert rec == {1: (2, True), 2: (1, False)}


def test_index_save_load_same_results(spark, sf):
    e = T.embeddings(spark, sf)
    cent = R.label_centroids(e, 64)
    post = R.assign_lists(e, cent, 64)
    path = store.new_store_path(spark, "index-test")
    R.save_index(cent, post, path)
    c2, p2 = R.load_index(spark, path)
    q = e.select(F.col("item_id").alias("query_id"), "vec").limit(10)
    a = R.ann_search(q, post, cent, 64, 10, 3).select("query_id", "item_id", "rank")
    b = R.ann_search(q, p2.select("list_id", "item_id", "vec"), c2, 64, 10, 3).select("query_id", "item_id", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_store_compaction_and_stats(spark):
    path = store.new_store_path(spark, "compact-test")
    t0 = datetime(2024, 1, 1)
    store.put(spark.createDataFrame([(1, 1.0), (2, 2.0)], "item_id long, v double"), path, "item", "item_id", t0, 100)
    store.put(spark.createDataFrame([(1, 10.0)], "item_id long, v double"), path, "item", "item_id",
              t0 + timedelta(seconds=10), 100)
    st = store.stats(spark, path, ["item"], t0 + timedelta(seconds=20)).first()
    assert st["n_keys"] == 2 and st["backend"] == "parquet"
    out = store.compact(spark, path, "item", t0 + timedelta(seconds=20))
    rows = {r["entity_id"]: r["payload"]["v"] for r in spark.read.parquet(out).collect()}
    assert rows == {1: 10.0, 2: 2.0}


def test_top_k_plan_has_partial_window_limit(spark, parts):
    r, u, m, uf, itf, cent = parts
    s = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(50)],
                              "user_id long, item_id long, score double, retrieval_score double")
    plan = serving.top_k_per_user(s, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ratings_view_prunes_columns(spark, sf):
    plan = T.ratings(spark, sf).select("user_id", "rating")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_comment" not in plan


def test_planted_taste_clusters(spark):
    """Two user groups like disjoint genre sets; content retrieval keeps each group in its cluster."""
    from datetime import datetime as dt
    items = [(i, f"Item {i} (2000)", "red|bolt|PROMO" if i <= 50 else "blue|gear|ECONOMY") for i in range(1, 101)]
    movies = spark.createDataFrame(items, "item_id long, title string, genres string")
    rows = []
    for u in range(1, 21):
        base = 1 if u <= 10 else 51
        for j in range(5):
            rows.append((u, base + (u * 7 + j * 3) % 50, 5.0, dt(2024, 1, 1, 0, j + u)))
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts timestamp_ntz")
    for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"):
        ratings = ratings.withColumn(c, F.lit(0))
    users = spark.createDataFrame([(u, "F", 25, 1, "0") for u in range(1, 21)],
                                  "user_id long, gender string, age int, occupation int, zip_code string")
    uf, itf = FE.user_features(ratings, users, movies), FE.item_features(ratings, movies)
    from rankloom.operators.towers import content_item_vectors, content_user_vectors
    cent = R.basis_centroids(spark, 18)
    cands = serving.retrieve_candidates(content_user_vectors(uf), content_item_vectors(movies), cent, 18, 10, 18)
    wrong = cands.filter(((F.col("user_id") <= 10) & (F.col("item_id") > 50)) |
                         ((F.col("user_id") > 10) & (F.col("item_id") <= 50)))
    assert cands.count() == 200 and wrong.count() == 0
    recs = serving.recommend_batch(ratings, users, movies, uf, itf, cent, 5, 20, 18)
    assert recs.filter(((F.col("user_id") <= 10) & (F.col("item_id") > 50)) |
                       ((F.col("user_id") > 10) & (F.col("item_id") <= 50))).count() == 0


def test_lists_fan_out_beside_their_user(spark):
    """Candidates as lists give the same features as rows, rounded before or after the
    fan-out, and no candidate is shuffled."""
    pref, vec = [0.1] * 17 + [0.7654321], [1.0] + [0.0] * 16 + [1.0]
    uf = spark.createDataFrame([(1, 3.3333333, 1.2345678, 0.5, 0.0, 0.25, 0.1, pref), (2, None, 0.0, None, 1.0, 0.5, 0.2, None)],
                               "user_id long, avg_rating double, log_rating_count double, recency_score double, gender_encoded double, "
                               "age_normalized double, occupation_normalized double, genre_pref array<double>")
    itf = spark.createDataFrame([(7, 4.1111111, 0.6931472, 0.1, 0.0, 0.5, vec), (8, 2.0, 0.0, None, 0.3, None, vec[:3])],
                                "item_id long, avg_rating double, log_rating_count double, popularity_score double, rating_stddev double, "
                                "year_normalized double, genre_vector array<double>")
    lists = spark.createDataFrame([(1, [7, 8, 9], [0.9, 0.8, 0.7]), (2, [8], [0.5]), (3, [7], [0.4])],
                                  "user_id long, item_ids array<long>, scores array<double>")
    a = serving.serving_features(lists, uf, itf)
    cols = sorted(a.columns)
    rows = sorted(map(tuple, a.select(cols).collect()))
    assert len(rows) == 5
    flat = serving.serving_features(serving.list_rows(lists).drop("rank"), uf, itf)
    assert sorted(map(tuple, flat.select(cols).collect())) == rows
    shown = serving.serving_features(lists, uf, itf, digits=6).select([c for c in cols if c != "retrieval_score"])
    late = a.select([F.round(c, 6).alias(c) if c in FE.FEATURE_COLUMNS else F.col(c) for c in shown.columns])
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, late.collect()))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate posexplode")].replace("BroadcastExchange", "")


def test_tasks_grow_with_the_users(spark, monkeypatch):
    """A task fans out and ranks the candidates of a bounded number of users."""
    uf = spark.range(1, 41).selectExpr("id AS user_id", *[f"0.5D AS {c}" for c in serving.USER_DEFAULTS], "array(0.5D) AS genre_pref")
    itf = spark.createDataFrame([(7, 4.0, 0.5, 0.1, 0.0, 0.5, [1.0])],
                                "item_id long, avg_rating double, log_rating_count double, popularity_score double, rating_stddev double, "
                                "year_normalized double, genre_vector array<double>")
    lists = uf.selectExpr("user_id", "array(7L) AS item_ids", "array(0.5D) AS scores")
    monkeypatch.setattr(serving, "USERS_PER_TASK", 1)
    f = serving.serving_features(lists, uf, itf)
    assert ", 40), REPARTITION_BY_NUM" in f._jdf.queryExecution().executedPlan().toString() and f.count() == 40


def test_lists_are_cut_before_they_fan_out(spark):
    lists = spark.createDataFrame([(1, [7, 8, 9], [0.9, 0.8, 0.7]), (2, [8], [0.5]), (3, [], [])],
                                  "user_id long, item_ids array<long>, scores array<double>")
    cut = serving.list_rows(lists, 2)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, serving.list_rows(lists).where("rank <= 2").collect())) and cut.count() == 3
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("slice(")


def test_compressed_tables_are_not_taken_for_small(spark):
    """A file of repeated values says little about its rows."""
    assert int(spark.conf.get("spark.sql.sources.fileCompressionFactor").split(".")[0]) >= 10


def test_wide_rows_run_in_methods_that_the_jvm_compiles(spark):
    """HotSpot interprets methods of more than 8000 bytes, as those of 50 feature columns are."""
    from rankloom.plans import catalog
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalog.load_all()["list_count_rule"][0](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
