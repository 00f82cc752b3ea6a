"""Registered metric queries (E1-E8) over the holdout of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.genres import multi_hot
from rankloom.operators import metrics as ME
from rankloom.operators import pairs as PA
from rankloom.operators import retrieval as R
from rankloom.operators import serving
from rankloom.operators.towers import content_item_vectors, content_user_vectors
from rankloom.plans import sqlfrag as Q
from rankloom.plans.catalog import register, rounded
from rankloom.plans.q_serving import N_CAND, N_PROBE, _eval_sql, _recommend, _serving_sql
from rankloom.session import materialize
from rankloom.sources import tables as T

_RET20 = """(SELECT * FROM (SELECT query_id AS user_id, item_id,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM hits) WHERE rank <= 20)"""


def _retrieval_top20(spark, sf_dir):
    from rankloom.operators import features as FE
    r, u, m = materialize(T.ratings(spark, sf_dir), "ratings"), T.users(spark, sf_dir), T.movies(spark, sf_dir)
    uf = materialize(FE.user_features(r, u, m), "user_features")
    cent = R.basis_centroids(spark, 18)
    lists, _ = serving.retrieve_lists(content_user_vectors(uf), content_item_vectors(m), cent, 18, N_CAND, N_PROBE)
    return r, materialize(serving.list_rows(lists, 20), "top20")


def _per_user_sql():
    base = _eval_sql(_RET20)
    return base[:base.rindex("\nSELECT '")]  # keep the CTE chain, drop the report


@register("ranking_metrics_per_user", _per_user_sql() + """
SELECT user_id, has_truth, """ + ", ".join(
    f"round({m}_{k}, 6) AS {m}_{k}" for k in (5, 10, 20) for m in ("ndcg", "recall", "precision")) + """,
       round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM pum""")
def ranking_metrics_per_user(spark, sf_dir):
    """E1 + E3 + E4 + E5 + E6 per holdout user for retrieval top-20 lists."""
    r, recs = _retrieval_top20(spark, sf_dir)
    hold = materialize(PA.last_n_holdout(r).select("user_id", "item_id", "rating"), "holdout")
    truth = hold.filter(F.col("rating") >= 4).select("user_id", "item_id")
    recs = recs.join(hold.select("user_id").distinct(), "user_id", "left_semi")
    return rounded(ME.per_user_metrics(recs.select("user_id", "item_id", "rank"), truth))


@register("graded_ndcg", _serving_sql().rstrip() + """,
hold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY """ + Q.ORDER_KEY_DESC + """) AS rn
         FROM ratings) WHERE rn <= (SELECT greatest(1, floor(count(*) * 0.1 / count(DISTINCT user_id))) FROM ratings)),
g AS (SELECT user_id, item_id, max(rating) AS grade FROM hold GROUP BY user_id, item_id),
rr AS (SELECT * FROM """ + _RET20 + """ x WHERE user_id IN (SELECT user_id FROM hold) AND rank <= 10),
dcg AS (SELECT rr.user_id, sum(coalesce(g.grade, 0.0) / log2(rr.rank + 1.0)) AS dcg
        FROM rr LEFT JOIN g ON rr.user_id = g.user_id AND rr.item_id = g.item_id GROUP BY rr.user_id),
ideal AS (SELECT user_id, sum(grade / log2(p + 1.0)) AS idcg FROM (
            SELECT user_id, grade, row_number() OVER (PARTITION BY user_id ORDER BY grade DESC, item_id) AS p
            FROM g WHERE grade > 0) WHERE p <= 10 GROUP BY user_id)
SELECT u.user_id, round(CASE WHEN coalesce(i.idcg, 0) > 0 THEN d.dcg / i.idcg ELSE 0.0 END, 6) AS ndcg
FROM (SELECT DISTINCT user_id FROM rr) u LEFT JOIN dcg d ON u.user_id = d.user_id LEFT JOIN ideal i ON u.user_id = i.user_id""")
def graded_ndcg(spark, sf_dir):
    """NDCG@10 with held-out ratings as graded relevance (linear gain)."""
    r, recs = _retrieval_top20(spark, sf_dir)
    hold = materialize(PA.last_n_holdout(r).select("user_id", "item_id", "rating"), "holdout")
    recs = recs.join(hold.select("user_id").distinct(), "user_id", "left_semi")
    grades = hold.select("user_id", "item_id", F.col("rating").alias("grade"))
    return rounded(ME.graded_ndcg(recs.select("user_id", "item_id", "rank"), grades, 10))


@register("list_diversity", _serving_sql().rstrip() + """,
lv AS (SELECT r.user_id, r.item_id, v.v FROM recs r
       JOIN (SELECT item_id, """ + Q.multi_hot("genres") + """ AS v FROM movies) v ON r.item_id = v.item_id
       WHERE r.rank <= 20 AND """ + Q.dot("v.v", "v.v") + """ > 0),
pd AS (SELECT a.user_id, 1 - """ + Q.dot("a.v", "b.v") + """ / (sqrt(""" + Q.dot("a.v", "a.v") + """) * sqrt("""
          + Q.dot("b.v", "b.v") + """)) AS d
       FROM lv a JOIN lv b ON a.user_id = b.user_id AND a.item_id < b.item_id)
SELECT u.user_id, round(coalesce(avg(pd.d), 0.0), 6) AS diversity
FROM (SELECT DISTINCT user_id FROM recs) u LEFT JOIN pd ON u.user_id = pd.user_id GROUP BY u.user_id""")
def list_diversity(spark, sf_dir):
    """E7 on every served list: closed form (no pair expansion), checked against a pairwise oracle."""
    recs = _recommend(spark, sf_dir)
    vecs = T.movies(spark, sf_dir).select("item_id", multi_hot("genres").alias("vec"))
    return rounded(ME.intra_list_diversity(recs.select("user_id", "item_id", "rank"), vecs, 18, 20))


@register("catalogue_coverage", _serving_sql() + """
SELECT count(DISTINCT item_id) AS n_recommended,
       round(count(DISTINCT item_id) / CAST((SELECT count(DISTINCT item_id) FROM movies) AS DOUBLE), 6) AS coverage
FROM recs""")
def catalogue_coverage(spark, sf_dir):
    """E8 + U5: share of the catalogue present in at least one served list."""
    recs = _recommend(spark, sf_dir)
    n_cat = T.movies(spark, sf_dir).select(F.count_distinct("item_id"))
    return rounded(ME.coverage(recs, F.lit(n_cat.scalar())))
