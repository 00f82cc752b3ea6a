"""Feature, pair and store properties on sf0.001 plus hand-made fixtures."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.functions.vectors import norm
from rankloom.operators import features as FE
from rankloom.operators import pairs as PA
from rankloom.sources import dat, store
from rankloom.sources import tables as T


@pytest.fixture(scope="module")
def feats(spark, sf):
    r, u, m = T.ratings(spark, sf), T.users(spark, sf), T.movies(spark, sf)
    return r, FE.user_features(r, u, m).cache(), FE.item_features(r, m).cache()


def test_user_feature_ranges(feats):
    _, uf, _ = feats
    s = uf.agg(F.min("avg_rating"), F.max("avg_rating"), F.min("recency_score"), F.max("recency_score"),
               F.max(norm("genre_pref", 18)), F.min(F.size("genre_pref"))).first()
    assert 1.0 <= s[0] <= s[1] <= 5.0
    assert 0.0 <= s[2] <= s[3] <= 1.0
    assert s[4] <= 1.01 and s[5] == 18
    assert uf.filter(F.col("avg_rating").isNull() | F.col("log_rating_count").isNull()).count() == 0


def test_item_feature_ranges(feats):
    _, _, itf = feats
    s = itf.agg(F.min("popularity_score"), F.max("popularity_score"), F.min("year_normalized"),
                F.max("year_normalized")).first()
    assert 0.0 <= s[0] <= s[1] <= 1.0 and 0.0 <= s[2] <= s[3] <= 1.0
    bad = itf.select(F.explode("genre_vector").alias("g")).filter(~F.col("g").isin(0.0, 1.0)).count()
    assert bad == 0


def test_pairs_negative_ratio_and_unrated(spark, feats):
    r, uf, itf = feats
    p = PA.training_pairs(r, 4, 42)
    per = p.groupBy("user_id").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    assert per.filter(F.col("neg") > 4 * F.col("pos")).count() == 0
    neg = p.filter("label = 0").select("user_id", "item_id")
    assert neg.join(r.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").count() == 0
    assert neg.count() == neg.distinct().count()
    pf = FE.pair_features(p, uf, itf)
    # |<pref, vec>| <= |pref| |vec| with |pref| <= 1 (Cauchy-Schwarz, per row)
    sq = sum((F.col(f"item_genre_{i}") * F.col(f"item_genre_{i}") for i in range(1, 18)),
             F.col("item_genre_0") * F.col("item_genre_0"))
    assert pf.filter(F.col("genre_affinity") * F.col("genre_affinity") > sq + 1e-9).count() == 0


def test_split_is_by_query(spark, feats):
    r, _, _ = feats
    tr, te = PA.build_training_pairs(r)
    assert tr.select("query_id").intersect(te.select("query_id")).count() == 0
    n_q = tr.select("query_id").union(te.select("query_id")).distinct().count()
    assert te.select("query_id").distinct().count() == max(1, int(n_q * 0.1))


def test_global_index_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = [r["idx"] for r in PA.global_index(df, ["k"], "idx").orderBy("k").collect()]
    assert got == list(range(1000))


def test_dat_readers_latin1_quotes_and_missing(spark):
    d = tempfile.mkdtemp(prefix="rl-dat-")
    with open(os.path.join(d, "movies.dat"), "wb") as f:
        f.write("1::Amélie (2001)::Comedy|Romance\n".encode("latin-1"))
        f.write('2::"Quoted" Title (1999)::Drama|NoSuchGenre\n'.encode("latin-1"))
        f.write("3::No Year::Action\n".encode("latin-1"))
    with open(os.path.join(d, "ratings.dat"), "w") as f:
        f.write("1::1::5::978300760\n")
    m = dat.read_movies(spark, os.path.join(d, "movies.dat")).orderBy("item_id").collect()
    assert m[0]["title"] == "Amélie (2001)" and m[1]["title"] == '"Quoted" Title (1999)'
    yrs = FE.catalogue_years(dat.read_movies(spark, os.path.join(d, "movies.dat"))).orderBy("item_id").collect()
    assert yrs[2]["year"] is None and yrs[2]["year_normalized"] == 0.5
    from rankloom.functions.genres import MOVIELENS_GENRES, multi_hot
    v = dat.read_movies(spark, os.path.join(d, "movies.dat")).select(
        multi_hot("genres", MOVIELENS_GENRES).alias("v")).collect()
    assert sum(v[1]["v"]) == 1.0  # unknown genre ignored
    r = dat.read_ratings(spark, os.path.join(d, "ratings.dat")).first()
    assert r["ts"] == datetime(2000, 12, 31, 22, 12, 40)


def test_store_expired_live_replaced(spark):
    path = store.new_store_path(spark, "test")
    t0 = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "user_id long, v double")
    store.put(a, path, "user", "user_id", t0, ttl_s=100)
    store.put(spark.createDataFrame([(2, 20.0)], "user_id long, v double"), path, "user", "user_id",
              t0 + timedelta(seconds=50), ttl_s=3600)
    live = {r["entity_id"]: r["payload"]["v"] for r in store.read_live(spark, path, "user", t0 + timedelta(seconds=150)).collect()}
    assert live == {2: 20.0}          # 1 expired, 2 replaced by the newer row
    ids = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    got = {r["user_id"]: r["found"] for r in store.lookup(spark, path, "user", ids, "user_id", t0 + timedelta(seconds=60)).collect()}
    assert got == {1: True, 2: True, 3: False}
    store.flush(spark, path, "user")
    assert store.read_live(spark, path, "user", t0).count() == 0


def test_feature_parquet_roundtrip(spark, feats):
    _, uf, itf = feats
    out = store.new_store_path(spark, "feat-test")
    store.write_features(uf, itf, out)
    u2, i2 = store.read_features(spark, out)
    assert set(u2.columns) == set(uf.columns) and set(i2.columns) == set(itf.columns)
    a = {r["user_id"]: r["genre_pref"] for r in uf.collect()}
    b = {r["user_id"]: r["genre_pref"] for r in u2.collect()}
    assert a == b


def test_dataset_summary_approx_close(spark, sf):
    from rankloom.operators import eda
    r = T.ratings(spark, sf)
    a, b = eda.dataset_summary(r).first(), eda.dataset_summary(r, approx=True).first()
    assert a["n_ratings"] == b["n_ratings"]
    assert abs(a["n_users"] - b["n_users"]) <= 0.05 * a["n_users"]
    assert abs(a["n_items"] - b["n_items"]) <= 0.05 * a["n_items"]


def test_user_sums_share_one_count(spark, sf):
    """The averages of the liked rows, with one count in the aggregation's buffer."""
    from pyspark.sql import functions as F

    from rankloom.operators import features as FE
    from rankloom.sources import tables as T
    r, m = T.ratings(spark, sf), T.movies(spark, sf)
    got = FE.user_aggregates(r, FE.item_genre_vectors(m), 18)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1 and plan.count("count(") == 2
    j = r.join(FE.item_genre_vectors(m), "item_id", "left")
    liked = (F.col("rating") >= 4) & F.col("genre_vector").isNotNull()
    want = j.groupBy("user_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("rating_count"), F.max("ts").alias("last_ts"),
                                    *[F.avg(F.when(liked, F.col("genre_vector")[i] * (F.col("rating") - 3.0))).alias(f"g{i}") for i in range(18)])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_users_are_summed_in_few_tasks(spark):
    """A user's rows are dealt to USER_PARTS tasks before any sum is kept of them, and move
    with a byte a genre."""
    from pyspark.sql import functions as F

    from rankloom.operators import features as FE
    r = spark.createDataFrame([(u, i, 4.0, datetime(2020, 1, 1)) for u in range(3) for i in range(200)],
                              "user_id long, item_id long, rating double, ts timestamp")
    m = spark.createDataFrame([(i, "t", "blue|ring") for i in range(150)], "item_id long, title string, genres string")
    got = FE.user_aggregates(r, FE.item_genre_vectors(m), 18)
    dealt = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 1 and "user_id" in dealt[0] and f", {FE.USER_PARTS})" in dealt[0]
    blue = FE.DRIVER_GENRES.index("blue")
    assert sorted((x["user_id"], x["rating_count"], x[f"g{blue}"], x["g0"]) for x in got.collect()) == [(u, 200, 1.0, 0.0) for u in range(3)]


def _rows(spark, rows):
    """Ratings ``(user_id, item_id, rating, day)`` with a row key."""
    t0 = datetime(2020, 1, 1)
    return spark.createDataFrame(
        [(u, i, r, t0 + timedelta(days=d), n, 1, i or 0, 1, 1.0, t0.date()) for n, (u, i, r, d) in enumerate(rows)],
        "user_id long, item_id long, rating double, ts timestamp, l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, "
        "l_quantity double, l_shipdate date")


@pytest.mark.parametrize("chunk", [4, 4096])
def test_negatives_are_the_walk_and_only_kept_draws_become_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(PA, "DRAW_CHUNK", chunk)
    rows = [(u, i, 5.0, 1) for u in range(1, 6) for i in range(60) if (i * 7 + u) % (u + 1) == 0] + [(9, i, 5.0, 1) for i in range(60)]
    rows += [(1, None, 5.0, 1), (None, 3, 5.0, 1), (2, 3, 4.0, 2)]
    r = _rows(spark, rows)
    cat = PA.numbered_catalogue(r, 42)
    place = {x["pos"]: x["item_id"] for x in cat.collect()}
    n = len(place)
    need = {u: 7 * u for u in range(1, 6)} | {9: 3}
    starts = {x["user_id"]: x["s"] % n for x in spark.createDataFrame([(u,) for u in need], "user_id long").select(
        "user_id", PA.portable_hash(F.lit("s"), F.col("user_id"), F.lit("-42")).alias("s")).collect()}
    want = set()
    for u, k in need.items():
        rated = {i for v, i, _, _ in rows if v == u}
        walk = [(d, place[(starts[u] + d * PA.stride_for(n)) % n]) for d in range(min(n, k + len(rated)))]
        free = [(d, i) for d, i in walk if i is None or i not in rated]
        want |= {(u, i, d, at + 1, -u) for at, (d, i) in enumerate(free[:k])}
    got = PA.portable_negatives(r, spark.createDataFrame([(u, k, -u) for u, k in need.items()], "user_id long, need long, tag long"),
                                42, cat, n, ranked=True, carry=["tag"])
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()     # no draw is made to be dropped


def test_positives_keep_the_first_rating(spark):
    rows = [(1, 1, 5.0, 2), (1, 1, 2.0, 1), (1, 2, 4.0, 1), (1, 2, 4.0, 2), (2, 1, 5.0, 5), (2, 1, None, 1), (2, 3, 3.0, 1),
            (None, 1, 5.0, 1), (3, None, 5.0, 1)]
    got = sorted([tuple(x) for x in PA.positives(_rows(spark, rows)).collect()], key=str)
    assert got == sorted([(1, 1, 1, 2.0), (1, 2, 1, 4.0), (1, 2, 1, 4.0), (2, 1, 1, None)], key=str)


def test_split_beside_the_queries_is_the_split_of_the_pairs(feats):
    r, _, _ = feats
    p, q = PA.training_pairs(r, 4, 42, return_queries=True)
    want = PA.split_queries(p, 0.1, 42, q)
    got = PA.training_pairs(r, 4, 42, test_ratio=0.1).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pair_features_move_the_users_vector_once(feats):
    r, uf, itf = feats
    plan = FE.pair_features(PA.training_pairs(r, 4, 42), uf, itf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    assert "user_id" in joins[0] and "item_id" in joins[1]       # the outermost join is the user's


def test_small_vectors_are_the_genre_vectors(spark, sf):
    from rankloom.plans.q_models import _small_vectors
    m = T.movies(spark, sf)
    small = _small_vectors(m)
    assert small.schema["i"].dataType.simpleString() == "array<tinyint>"
    assert small.join(FE.item_genre_vectors(m), "item_id").filter(F.col("i").cast("array<double>") != F.col("genre_vector")).count() == 0


def test_gradients_and_popularity_write_no_table_they_do_not_read(spark, sf, monkeypatch):
    import __spark_entry__ as E
    from rankloom import session
    written, real = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name: written.append((name, df.columns)) or real(df, name))
    E.queries()["ranker_holdout_linear"](spark, sf)
    E.queries()["evaluate_popularity"](spark, sf)
    assert not {"pair_matrix", "user_features"} & {n for n, _ in written}


def test_dense_positions_follow_the_rows(spark):
    """A small table is not spread over the session's partitions, and is not checkpointed."""
    from rankloom.operators.indexing import global_index
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        df = spark.createDataFrame([(i * 7 % 23, i) for i in range(23)], "k long, v long").repartition(5)
        got = global_index(df, ["k"], "idx")
        assert got.rdd.getNumPartitions() < 10 and "Scan parquet" in got._jdf.queryExecution().executedPlan().toString()
        assert [(r["k"], r["idx"]) for r in got.orderBy("idx").collect()] == [(i, i) for i in range(23)]
        assert [r["idx"] for r in global_index(df, ["k"], "idx", 3).orderBy("k").collect()] == list(range(23))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
