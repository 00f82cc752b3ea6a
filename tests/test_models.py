"""Ranker and tower properties (reference model tests)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ranker as RK
from rankloom.operators import towers as TW


@pytest.fixture(scope="module")
def rank_frames(spark):
    rng = np.random.default_rng(42)
    rows = []
    for q in range(40):
        for i in range(15):
            f = rng.normal(size=10)
            rows.append((q, q * 15 + i, int(f[0] > 0.6), *[float(x) for x in f]))
    cols = [f"feat_{j}" for j in range(10)]
    schema = "query_id long, item_id long, label int, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame(rows, schema)
    return df.filter("query_id < 32"), df.filter("query_id >= 32"), cols


def test_ranker_learns_monotone_label(rank_frames):
    tr, va, cols = rank_frames
    model = RK.fit_ranker(tr, cols, va, n_rounds=3, learning_rate=0.3, min_child_samples=5)
    hist = [v for _, split, _, v in model.history if split == "train"]
    assert hist[-1] >= hist[0]
    assert model.top_features(1)[0][0] == "feat_0"
    assert all(v >= 0 for _, v in model.feature_importance("gain"))


def test_ranker_save_load_same_scores(spark, rank_frames):
    tr, va, cols = rank_frames
    model = RK.fit_ranker(tr, cols, None, n_rounds=2, min_child_samples=5)
    m2 = RK.RankerModel.from_frames(*model.to_frames(spark))
    a = [r["score"] for r in model.predict(va).orderBy("item_id").collect()]
    b = [r["score"] for r in m2.predict(va).orderBy("item_id").collect()]
    assert a == b
    info = model.info()
    assert info["n_features"] == 10 and info["n_trees"] == 2


def test_untrained_ranker_raises(spark, rank_frames):
    with pytest.raises(RuntimeError):
        RK.RankerModel(["feat_0"]).predict(rank_frames[1])


def test_lambda_gradients_signs(spark):
    rows = [(1, 0, 0, 1.0), (2, 0, 1, 0.0), (3, 0, 0, -1.0)]
    s = spark.createDataFrame(rows, "row_id long, query_id long, label int, score double")
    g = {r["row_id"]: (r["g"], r["h"]) for r in RK.lambda_gradients(s).collect()}
    assert g[2][0] < 0 and g[1][0] > 0 and g[3][0] > 0      # push the positive up, negatives down
    assert all(h > 0 for _, h in g.values())
    assert sum(v[0] for v in g.values()) == pytest.approx(0.0, abs=1e-12)


def test_linear_score(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert RK.linear_score(df, {"a": 2.0, "b": -1.0, "missing": 5.0}, bias=0.5).first()["score"] == pytest.approx(0.5)


def test_bpr_loss_nonnegative_and_stable(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), ([1000.0, 0.0], [0.0, 1.0], [1.0, 0.0])],
                               "u array<double>, p array<double>, n array<double>")
    vals = [r[0] for r in df.select(TW.bpr_loss("u", "p", "n", 2)).collect()]
    assert all(v >= 0 for v in vals) and vals[1] == pytest.approx(1000.0)


def test_two_tower_one_epoch(spark, sf):
    from rankloom.functions.vectors import norm
    from rankloom.operators import features as FE
    from rankloom.operators import twotower as TT
    from rankloom.sources import tables as T
    r, m = T.ratings(spark, sf), T.movies(spark, sf)
    gv = FE.item_genre_vectors(m)
    model = TT.fit_two_tower(r, gv, epochs=1, batch=64, shard_rows=1500)
    assert len(model.history) == 1 and np.isfinite(model.history[0][1]) and model.history[0][1] > 0
    n = model.embed_items(gv).agg(F.min(norm("vec", 64)).alias("a"), F.max(norm("vec", 64)).alias("b")).first()
    assert n["a"] == pytest.approx(1.0, abs=1e-5) and n["b"] == pytest.approx(1.0, abs=1e-5)


def _ratings_frame(spark, rows):
    from rankloom.sources.tables import RATING_ORDER_KEY
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, t long").withColumn("ts", F.timestamp_seconds("t"))
    return df.select("user_id", "item_id", "rating", "ts", *[F.col("t").alias(c) for c in RATING_ORDER_KEY])


def test_two_tower_learns_from_every_triple(spark):
    """Planted taste: users like the items of their own half. The loss falls, no
    triple is dropped with the default batch, and a heavy user spans shards."""
    from rankloom.operators import twotower as TT
    from rankloom.operators.pairs import epoch_negatives
    rows = [(u, (u % 2) * 20 + (u * 7 + k * 3) % 20, 5.0, u * 1000 + k) for u in range(1, 25) for k in range(12)]
    rows += [(99, k % 20, 5.0, 99000 + k) for k in range(300)]
    r = _ratings_frame(spark, rows)
    gv = spark.range(40).select(F.col("id").alias("item_id"), F.array(*[F.lit(0.0)] * 18).alias("genre_vector"))
    tri = epoch_negatives(r, 1, catalogue=gv)
    liked = r.groupBy("user_id").count().collect()
    got = {x["user_id"]: x["count"] for x in tri.groupBy("user_id").count().collect()}
    assert got == {x["user_id"]: x["count"] for x in liked}        # 300 positives of 20 items keep 300 negatives
    assert tri.join(r.select("user_id", F.col("item_id").alias("neg_item")), ["user_id", "neg_item"]).count() == 0
    model = TT.fit_two_tower(r, gv, epochs=4, lr=0.02, batch=64, shard_rows=200)
    losses = [v for _, v in model.history]
    assert losses[-1] < losses[0] and model.best_epoch == losses.index(min(losses)) + 1
    assert model.item_emb.count() == 40 and model.user_emb.count() == 25


def test_two_tower_shards_train_in_tasks_of_their_own(spark, monkeypatch):
    """Shards of a small table are not put into one task."""
    from rankloom import session
    from rankloom.operators import twotower as TT
    r = _ratings_frame(spark, [(u, (u * 7 + k * 3) % 30, 5.0, u * 1000 + k) for u in range(40) for k in range(10)])
    gv = spark.range(40).select(F.col("id").alias("item_id"), F.array(*[F.lit(0.0)] * 18).alias("genre_vector"))
    made, plain = [], session.materialize

    def seen(df, name):
        if name == "tt_result":
            made.append(df.rdd.mapPartitions(lambda rows: [sum(r["kind"] == "loss" for r in rows)]).collect())
        return plain(df, name)
    monkeypatch.setattr(session, "materialize", seen)
    TT.fit_two_tower(r, gv, epochs=1, batch=64, shard_rows=100)
    assert sum(made[0]) == 4 and max(made[0]) == 1
    assert all(TT._tasks(spark, n) >= n for n in (1, 7))


def test_two_tower_without_triples(spark):
    from rankloom.operators import twotower as TT
    r = _ratings_frame(spark, [(1, 1, 1.0, 1)])
    gv = spark.range(3).select(F.col("id").alias("item_id"), F.array(*[F.lit(0.0)] * 18).alias("genre_vector"))
    with pytest.raises(ValueError):
        TT.fit_two_tower(r, gv, epochs=1)


def test_kmeans_lists_cover_all_vectors(spark, sf):
    from rankloom.operators import retrieval as R
    from rankloom.sources import tables as T
    e = T.embeddings(spark, sf)
    n = e.count()
    k = R.list_count_rule(n, 100)
    cent = R.fit_coarse(e, k, 64)
    post = R.assign_lists(e, cent, 64)
    assert cent.count() == k and post.count() == n
    assert post.select("list_id").distinct().count() <= k


def test_als_report_shape(spark, sf):
    import __spark_entry__ as E
    rep = {r["metric"]: r["value"] for r in E.queries()["als_factors"](spark, sf).collect()}
    assert {"ndcg@10", "recall@20", "mrr", "n_users"} <= set(rep)
    assert all(0.0 <= rep[m] <= 1.0 for m in ("ndcg@10", "recall@20", "mrr"))


def test_als_fit_keeps_no_shuffles_of_its_input(spark, sf, monkeypatch):
    """The fit reads a written table and drops its iterations' shuffle files."""
    import __spark_entry__ as E
    from pyspark.ml import recommendation
    from rankloom import session
    made, plain, fits = [], session.materialize, []

    class Stop(Exception):
        pass

    def fit(self, df):
        fits.append((df._jdf.queryExecution().executedPlan().toString(), self.getCheckpointInterval()))
        raise Stop
    monkeypatch.setattr(session, "materialize", lambda df, name: made.append(name) or plain(df, name))
    monkeypatch.setattr(recommendation.ALS, "fit", fit)
    with pytest.raises(Stop):
        E.queries()["als_factors"](spark, sf)
    assert "Exchange" not in fits[0][0] and fits[0][1] == 1 and "holdout" in made
