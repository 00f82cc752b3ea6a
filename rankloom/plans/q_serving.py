"""Registered serving / popularity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import serving
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T


@register("popularity_top20", T.sql_with("ratings", "movies") + """
, pop AS (SELECT item_id, count(*) AS n_ratings FROM ratings GROUP BY item_id),
top AS (SELECT item_id, n_ratings,
               row_number() OVER (ORDER BY n_ratings DESC, item_id) AS rank
        FROM pop ORDER BY n_ratings DESC, item_id LIMIT 20)
SELECT t.item_id, CAST(t.rank AS INTEGER) AS rank, t.n_ratings,
       round(1.0 - t.rank / 21.0, 6) AS score, CAST(0.0 AS DOUBLE) AS retrieval_score,
       coalesce(m.title, 'Item ' || CAST(t.item_id AS VARCHAR)) AS title,
       coalesce(m.genres, '') AS genres
FROM top t LEFT JOIN movies m ON t.item_id = m.item_id
""")
def popularity_top20(spark, sf_dir):
    """T3 + A4 + J8: top-20 most rated items with titles and genre lists."""
    r = T.ratings(spark, sf_dir)
    top = serving.popularity_top_k(r, 20)
    out = serving.enrich(top, T.movies(spark, sf_dir))
    return rounded(out.select("item_id", "rank", "n_ratings", "score", "retrieval_score", "title",
                              F.array_join("genres", "|").alias("genres")))


from rankloom.operators import features as FE  # noqa: E402
from rankloom.operators import metrics as ME  # noqa: E402
from rankloom.operators import pairs as PA  # noqa: E402
from rankloom.operators import retrieval as R  # noqa: E402
from rankloom.operators.towers import content_item_vectors, content_user_vectors  # noqa: E402
from rankloom.plans import sqlfrag as Q  # noqa: E402

N_CAND, N_PROBE, K = 500, 10, 20


def _feats(spark, sf_dir):
    """Views plus the ratings and the two feature tables, written once to the shared scratch area
    (the feature job's output is the serving job's input)."""
    from rankloom.session import materialize
    r, u, m = materialize(T.ratings(spark, sf_dir), "ratings"), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    return r, u, m, materialize(FE.user_features(r, u, m), "user_features"), \
        materialize(FE.item_features(r, m), "item_features")


def _serving_sql(score_sql: str | None = None):
    return (T.sql_with("ratings", "users", "movies").rstrip() + Q.user_features_ctes() + Q.item_features_ctes()
            + Q.serving_ctes(N_CAND, N_PROBE, K, serving.DEFAULT_WEIGHTS, serving.USER_DEFAULTS,
                             serving.ITEM_DEFAULTS, score_sql=score_sql))


def _recommend(spark, sf_dir):
    r, u, m, uf, itf = _feats(spark, sf_dir)
    cent = R.basis_centroids(spark, 18)
    return serving.recommend_batch(r, u, m, uf, itf, cent, K, N_CAND, N_PROBE)


@register("retrieve_candidates", _serving_sql() + """
SELECT query_id AS user_id, item_id, round(score, 6) AS retrieval_score, CAST(rank AS INTEGER) AS rank FROM hits""")
def retrieve_candidates(spark, sf_dir):
    """V1 with M11: 500 candidates per user from 10 of 18 genre-axis lists."""
    from rankloom.session import materialize
    r, u, m = T.ratings(spark, sf_dir), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    uf = materialize(FE.user_features(r, u, m), "user_features")
    post = R.assign_lists(content_item_vectors(m), R.basis_centroids(spark, 18), 18)
    q = content_user_vectors(uf).select(F.col("user_id").alias("query_id"), "vec")
    hits = R.ann_search(q, post, R.basis_centroids(spark, 18), 18, N_CAND, N_PROBE)
    return rounded(hits.select(F.col("query_id").alias("user_id"), "item_id",
                               F.col("score").alias("retrieval_score"), "rank"))


def _sfeat_sql(column: str) -> str:
    """A feature column over ``sfeat``, whose genre parts are lists."""
    for prefix, name in (("user_genre_", "up"), ("item_genre_", "iv")):
        if column.startswith(prefix):
            return f"{name}[{int(column[len(prefix):]) + 1}]"
    return column


@register("serving_features", _serving_sql() + """
SELECT user_id, item_id, """ + ", ".join(f"round({_sfeat_sql(c)}, 6) AS {c}" for c in FE.FEATURE_COLUMNS) + " FROM sfeat")
def serving_features(spark, sf_dir):
    """V2: candidate matrix with serving defaults, all 50 columns."""
    r, u, m, uf, itf = _feats(spark, sf_dir)
    cent = R.basis_centroids(spark, 18)
    c, items = serving.retrieve_lists(content_user_vectors(uf), content_item_vectors(m), cent, 18, N_CAND, N_PROBE)
    f = serving.serving_features(c, uf, serving.reachable_features(itf, items), digits=6)
    return f.select("user_id", "item_id", *FE.FEATURE_COLUMNS)


@register("recommend_batch", _serving_sql() + """
SELECT user_id, rank, item_id, title, round(score, 6) AS score, round(retrieval_score, 6) AS retrieval_score,
       genres, source FROM recs""")
def recommend_batch(spark, sf_dir):
    """V3 (+V1 V2 V5 T1 J8 L13 M11): top-20 for every user in one job; cold users get popularity."""
    out = _recommend(spark, sf_dir)
    return rounded(out.withColumn("genres", F.array_join("genres", "|")))


# two given trees (nodes: id, feature, threshold, left, right, leaf) and their leaf outputs
TREE_FEATURES = ("genre_affinity", "popularity_score", "rating_diff")
TREES = (([(0, 0, 0.4, 1, 2, -1), (1, -1, 0.0, -1, -1, 0), (2, 1, 0.6, 3, 4, -1), (3, -1, 0.0, -1, -1, 1), (4, -1, 0.0, -1, -1, 2)],
          {0: -0.75, 1: 0.25, 2: 1.5}),
         ([(0, 2, -0.1, 1, 2, -1), (1, -1, 0.0, -1, -1, 0), (2, -1, 0.0, -1, -1, 1)], {0: 0.5, 1: -0.125}))


def given_ranker():
    """A ranker of the given trees."""
    from rankloom.operators.ranker import RankerModel, Tree
    return RankerModel(list(TREE_FEATURES), [Tree(list(n), dict(v)) for n, v in TREES], learning_rate=0.5)


def _tree_sql(nodes, values, nid: int = 0) -> str:
    _, feature, threshold, left, right, leaf = next(n for n in nodes if n[0] == nid)
    if leaf >= 0:
        return f"CAST({values[leaf]!r} AS DOUBLE)"
    return (f"CASE WHEN {TREE_FEATURES[feature]} <= CAST({threshold!r} AS DOUBLE) THEN {_tree_sql(nodes, values, left)} "
            f"ELSE {_tree_sql(nodes, values, right)} END")


_TREES_SQL = "CAST(0.0 AS DOUBLE) + (" + " + ".join(f"CAST(0.5 AS DOUBLE) * ({_tree_sql(n, v)})" for n, v in TREES) + ")"


@register("recommend_trees", _serving_sql(_TREES_SQL) + """
SELECT user_id, rank, item_id, round(score, 6) AS score, round(retrieval_score, 6) AS retrieval_score, source FROM recs""")
def recommend_trees(spark, sf_dir):
    """V3 + L7: the serving job with given vectors (the content towers) and a tree ranker of given trees as scorer."""
    r, u, m, uf, itf = _feats(spark, sf_dir)
    out = serving.recommend_batch(r, u, m, uf, itf, R.basis_centroids(spark, 18), K, N_CAND, N_PROBE, dim=18,
                                  user_vecs=content_user_vectors(uf), item_vecs=content_item_vectors(m),
                                  scorer=given_ranker().predict)
    return rounded(out.select("user_id", "rank", "item_id", "score", "retrieval_score", "source"))


@register("response_lists", _serving_sql() + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS items, count(*) AS n_items,
       round(max(score), 6) AS top_score FROM recs GROUP BY user_id""")
def response_lists(spark, sf_dir):
    """V7: one response row per user -- the ranked list in rank order."""
    out = _recommend(spark, sf_dir)
    g = out.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l"),
                                   F.count(F.lit(1)).alias("n_items"), F.max("score").alias("top_score"))
    return rounded(g.select("user_id", F.array_join(F.transform("l", lambda s: s["item_id"].cast("string")), ",")
                            .alias("items"), "n_items", "top_score"))


def _eval_sql(recs_cte: str):
    return (_serving_sql().rstrip() + """,
hold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY """ + Q.ORDER_KEY_DESC + """) AS rn
         FROM ratings) WHERE rn <= (SELECT greatest(1, floor(count(*) * 0.1 / count(DISTINCT user_id))) FROM ratings)),
truth AS (SELECT user_id, item_id FROM hold WHERE rating >= 4),
recs_e AS (SELECT user_id, item_id, rank FROM """ + recs_cte + """ WHERE user_id IN (SELECT user_id FROM hold))"""
            + Q.per_user_metrics_ctes("recs_e", "truth") + "\n" + Q.report_sql(catalog_expr="SELECT count(DISTINCT item_id) FROM movies"))


def _eval(spark, sf_dir, which: str, shared: dict | None = None):
    """E9 report for one method; ``shared`` carries features / candidates computed once
    when several methods are evaluated on the same split."""
    from rankloom.session import materialize
    sh = shared if shared is not None else {}
    if shared is not None or which != "popularity":
        if "feats" not in sh:
            sh["feats"] = _feats(spark, sf_dir)
        r, u, m, uf, itf = sh["feats"]
    else:       # popularity alone reads no features
        r, m = materialize(T.ratings(spark, sf_dir), "ratings"), T.movies(spark, sf_dir)
    cent = R.basis_centroids(spark, 18)
    if "hold" not in sh:
        sh["hold"] = materialize(PA.last_n_holdout(r).select("user_id", "item_id", "rating"), "holdout")
    hold = sh["hold"]
    truth = hold.filter(F.col("rating") >= 4).select("user_id", "item_id")
    if which != "popularity" and "cands" not in sh:
        lists, items = serving.retrieve_lists(content_user_vectors(uf), content_item_vectors(m), cent, 18, N_CAND, N_PROBE)
        sh["cands"] = (lists if shared is None else materialize(lists, "candidates")), items
    if which == "popularity":
        recs = serving.fallback_lists(hold.select("user_id").distinct(), r, K)
    elif which == "retrieval":
        recs = serving.list_rows(sh["cands"][0], K)
    else:
        recs = serving.recommend_batch(r, u, m, uf, itf, cent, K, N_CAND, N_PROBE, candidates=sh["cands"])
    recs = recs.select("user_id", "item_id", "rank").join(hold.select("user_id").distinct(), "user_id", "left_semi")
    recs = materialize(recs, "recs")       # read by the metrics and by the coverage
    n_cat = m.select(F.count_distinct("item_id")).scalar()
    rep = ME.evaluate_model(recs, truth, (5, 10, 20), n_cat)
    return rounded(rep.filter(~F.col("metric").startswith("error")))


@register("evaluate_pipeline", _eval_sql("recs"))
def evaluate_pipeline(spark, sf_dir):
    """V10 + E9: last-N holdout, truth = held-out ratings >= 4, retrieve 500, rank, keep 20, report.

    All holdout users are evaluated (the reference samples 200: see ``evaluation_users``)."""
    return _eval(spark, sf_dir, "full")


@register("evaluate_popularity", _eval_sql("""(SELECT h.user_id, p.item_id, p.rank FROM (SELECT DISTINCT user_id FROM hold) h
    CROSS JOIN popk p)"""))
def evaluate_popularity(spark, sf_dir):
    """E10 row 1: the popularity method evaluated like the pipeline."""
    return _eval(spark, sf_dir, "popularity")


@register("evaluate_retrieval", _eval_sql("""(SELECT * FROM (SELECT query_id AS user_id, item_id,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM hits) WHERE rank <= 20)"""))
def evaluate_retrieval(spark, sf_dir):
    """E10 row 2: retrieval only (top-20 by retrieval score)."""
    return _eval(spark, sf_dir, "retrieval")


@register("method_comparison", "SELECT * FROM (SELECT 'popularity' AS method, * FROM (" + _eval_sql("""(SELECT h.user_id, p.item_id, p.rank FROM (SELECT DISTINCT user_id FROM hold) h
    CROSS JOIN popk p)""") + """)) UNION ALL SELECT * FROM (SELECT 'retrieval' AS method, * FROM (""" + _eval_sql("""(SELECT * FROM (SELECT query_id AS user_id, item_id,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM hits) WHERE rank <= 20)""")
          + ")) UNION ALL SELECT * FROM (SELECT 'retrieval+linear' AS method, * FROM (" + _eval_sql("recs") + "))")
def method_comparison(spark, sf_dir):
    """The three methods (popularity, retrieval only, retrieval + linear ranker)
    evaluated on the same holdout, one table."""
    out, shared = None, {}
    for name, which in (("popularity", "popularity"), ("retrieval", "retrieval"), ("retrieval+linear", "full")):
        rep = _eval(spark, sf_dir, which, shared).select(F.lit(name).alias("method"), "*")
        out = rep if out is None else out.unionByName(rep)
    return out


@register("served_responses", _serving_sql() + """
SELECT user_id, count(*) AS n_results, string_agg(CAST(item_id AS VARCHAR) || ':' || CAST(round(score, 6) AS VARCHAR), ','
       ORDER BY rank) AS items, min(source) AS source FROM recs GROUP BY user_id""")
def served_responses(spark, sf_dir):
    """V7 + F22: per-user response with the list in rank order and scores rounded to 6 places."""
    resp = serving.responses(_recommend(spark, sf_dir))
    items = F.array_join(F.transform("recommendations", lambda s: F.concat(
        s["item_id"].cast("string"), F.lit(":"), s["score"].cast("string"))), ",")
    return resp.select("user_id", "n_results", items.alias("items"), "source")
