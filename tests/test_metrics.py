"""Exact small cases for the ranking metrics and drift (reference test cases)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import drift as D
from rankloom.operators import metrics as ME


def _recs(spark, items, user=1):
    return spark.createDataFrame([(user, i, r + 1) for r, i in enumerate(items)], "user_id long, item_id long, rank int")


def _truth(spark, items, user=1):
    return spark.createDataFrame([(user, i) for i in items], "user_id long, item_id long")


def _per(spark, rec, rel, ks=(3, 5)):
    return ME.per_user_metrics(_recs(spark, rec), _truth(spark, rel) if rel else
                               spark.createDataFrame([], "user_id long, item_id long"), ks).first()


def test_ndcg_perfect(spark):
    assert _per(spark, [1, 2, 3, 4, 5], [1, 2, 3])["ndcg_3"] == pytest.approx(1.0)


def test_ndcg_zero(spark):
    assert _per(spark, [4, 5, 6, 7, 8], [1, 2, 3])["ndcg_5"] == pytest.approx(0.0)


def test_ndcg_between(spark):
    v = _per(spark, [1, 4, 2, 5, 3], [1, 2, 3])["ndcg_5"]
    assert 0.0 < v < 1.0


def test_recall(spark):
    assert _per(spark, [1, 2, 3, 4, 5], [1, 2, 6, 7])["recall_3"] == pytest.approx(0.5)


def test_recall_no_truth(spark):
    assert _per(spark, [1, 2, 3], [])["recall_3"] == pytest.approx(0.0)


@pytest.mark.parametrize("rec,rel,exp", [([1, 2, 3], [1], 1.0), ([4, 1, 2], [1, 2], 0.5), ([4, 5, 6], [1, 2, 3], 0.0)])
def test_mrr(spark, rec, rel, exp):
    assert _per(spark, rec, rel)["mrr"] == pytest.approx(exp)


def test_precision_short_list_divides_by_k(spark):
    assert _per(spark, [1, 2], [1, 2], (5,))["precision_5"] == pytest.approx(0.4)


def test_average_precision(spark):
    # hits at ranks 1 and 3 of 2 relevant: (1/1 + 2/3) / 2
    assert _per(spark, [1, 9, 2], [1, 2])["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_coverage(spark):
    rows = [(u, i, r + 1) for u, l in enumerate([[1, 2, 3], [4, 5, 6], [1, 7, 8]]) for r, i in enumerate(l)]
    recs = spark.createDataFrame(rows, "user_id long, item_id long, rank int")
    assert ME.coverage(recs, 10).first()["coverage"] == pytest.approx(0.8)


def test_diversity_closed_form_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.integers(0, 2, 6)]) for i in range(1, 11)]
    items = spark.createDataFrame(vecs, "item_id long, vec array<double>")
    recs = _recs(spark, list(range(1, 11)))
    got = ME.intra_list_diversity(recs, items, 6).first()["diversity"]
    vv = [np.array(v) for _, v in vecs if np.linalg.norm(v) > 0]
    d = [1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) for i, a in enumerate(vv) for b in vv[i + 1:]]
    assert got == pytest.approx(float(np.mean(d)), abs=1e-12)


def test_evaluate_model_counts_users_without_truth(spark):
    recs = _recs(spark, [1, 2, 3], 1).unionByName(_recs(spark, [1, 2, 3], 2))
    rep = {r["metric"]: r["value"] for r in ME.evaluate_model(recs, _truth(spark, [1], 1), (3,)).collect()}
    assert rep["n_users"] == 2 and rep["n_evaluated"] == 1 and rep["ndcg@3"] == pytest.approx(1.0)


def _frame(spark, vals):
    return spark.createDataFrame([(float(v),) for v in vals], "x double")


def test_drift_same_distribution_not_flagged(spark):
    rng = np.random.default_rng(42)
    r = D.detect_skew(_frame(spark, rng.normal(0, 1, 1000)), _frame(spark, rng.normal(0, 1, 500)), 0.5).first()
    assert not r["flagged"]


def test_drift_shift_flagged(spark):
    rng = np.random.default_rng(42)
    r = D.detect_skew(_frame(spark, rng.normal(0, 1, 1000)), _frame(spark, rng.normal(5, 1, 500)), 0.1).first()
    assert r["feature"] == "x" and r["flagged"]


def test_kl_matches_numpy(spark):
    rng = np.random.default_rng(1)
    p, q = rng.normal(0, 1, 400), rng.normal(0.5, 1.3, 300)
    got = D.kl_divergence(_frame(spark, p), _frame(spark, q)).first()["kl"]
    edges = np.linspace(min(p.min(), q.min()), max(p.max(), q.max()), 21)
    hp, _ = np.histogram(p, edges, density=True)
    hq, _ = np.histogram(q, edges, density=True)
    hp, hq = hp + 1e-10, hq + 1e-10
    hp, hq = hp / hp.sum(), hq / hq.sum()
    assert got == pytest.approx(float(np.sum(hp * np.log(hp / hq))), rel=1e-9)


def test_too_few_values_skipped(spark):
    assert D.detect_skew(_frame(spark, range(5)), _frame(spark, range(50))).count() == 0
