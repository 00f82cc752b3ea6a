"""Leaf-wise boosting against a plain numpy version grown split by split."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.operators import boosting as B
from rankloom.operators import ranker as RK

GAINS = (0, 1, 3, 7, 15)


def _table(n_queries=30, seed=0):
    """Rows of (query_id, label, a, b, c, d); ``a`` and ``b`` carry the labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n_queries):
        for _ in range(int(rng.integers(4, 30))):
            x = np.round(rng.normal(size=4), 3)
            label = int(np.clip(x[0] + 0.5 * x[1] * x[0] + rng.normal() * 0.4, 0, 1.99))
            rows.append((q, label, *map(float, x)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "query_id long, label int, a double, b double, c double, d double")


def _terms(score, query, label, order, truncation=30):
    """LambdaMART terms pair by pair; ``order`` breaks ties."""
    g, h = np.zeros(len(score)), np.zeros(len(score))
    for q in np.unique(query):
        rows = np.flatnonzero(query == q)
        rank = sorted(rows, key=lambda r: (-score[r], order[r]))
        gain = {r: GAINS[label[r]] for r in rows}
        best = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(gain.values(), reverse=True)[:truncation]))
        if best <= 0:
            continue
        gq, hq = dict.fromkeys(rows, 0.0), dict.fromkeys(rows, 0.0)
        for i, a in enumerate(rank[:truncation]):
            for j in range(i + 1, len(rank)):
                b = rank[j]
                if label[a] == label[b]:
                    continue
                hi, lo = (a, b) if label[a] > label[b] else (b, a)
                d = abs(gain[a] - gain[b]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / best
                rho = 1 / (1 + math.exp(score[hi] - score[lo]))
                gq[hi] -= rho * d
                gq[lo] += rho * d
                hq[hi] += rho * (1 - rho) * d
                hq[lo] += rho * (1 - rho) * d
        total = sum(abs(v) for v in gq.values())
        f = math.log2(1 + total) / total if total > 0 else 1.0
        for r in rows:
            g[r], h[r] = gq[r] * f, hq[r] * f
    return g, h


def _grow(bins, g, h, used, n_bounds, p):
    """One split after another, every histogram from the rows. Returns leaf of each
    row, leaf values and the splits."""
    def strength(x, y):
        return max(abs(x) - p.l1, 0.0) ** 2 / (y + p.l2)

    def find(rows):
        best = (-math.inf, None, None)
        gt, ht = g[rows].sum(), h[rows].sum()
        for f in used:
            for b in range(n_bounds[f]):
                left = rows[bins[f, rows] <= b]
                right = rows[bins[f, rows] > b]
                if min(len(left), len(right)) < p.min_child or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                    continue
                gain = strength(g[left].sum(), h[left].sum()) + strength(g[right].sum(), h[right].sum()) - strength(gt, ht)
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
        return best
    leaves = {0: (np.arange(bins.shape[1]), find(np.arange(bins.shape[1])))}
    splits = []
    while len(leaves) < p.num_leaves:
        top = min(leaves, key=lambda i: (-leaves[i][1][0], i))
        rows, (gain, f, b) = leaves[top]
        if not gain > 0:
            break
        del leaves[top]
        splits.append((f, b, gain))
        for k, part in enumerate((rows[bins[f, rows] <= b], rows[bins[f, rows] > b])):
            leaves[2 * len(splits) - 1 + k] = (part, find(part))
    out = np.zeros(bins.shape[1])
    for rows, _ in leaves.values():
        x, y = g[rows].sum(), h[rows].sum()
        out[rows] = -math.copysign(max(abs(x) - p.l1, 0.0), x) / (y + p.l2)
    return out, splits


@pytest.mark.parametrize("block_rows", [4096, 60, 15])
def test_first_trees_equal_plain_numpy(spark, block_rows):
    """In one block, in several, and with queries that span blocks."""
    features = ["a", "b", "c", "d"]
    df = _frame(spark, _table())
    model = RK.fit_ranker(df, features, None, n_rounds=3, learning_rate=0.3, num_leaves=12, min_child_samples=5, colsample=0.75,
                          block_rows=block_rows)
    rows = df.withColumn("rid", F.xxhash64("query_id", F.array(*features))).orderBy("query_id", "rid", "label").collect()
    x = np.array([[r[f] for f in features] for r in rows])
    query, label = np.array([r.query_id for r in rows]), np.array([r.label for r in rows])
    bounds = B.bin_bounds(df, features)
    bins = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(bounds)])
    n_bounds = [len(b) for b in bounds]
    p = B.Growth(12, 5, RK.LGBM_PARAMS["reg_alpha"], RK.LGBM_PARAMS["reg_lambda"])
    score, importance = np.zeros(len(rows)), {}
    for rnd in range(3):
        g, h = _terms(score, query, label, np.arange(len(rows)))
        used = np.sort(np.random.default_rng([42, rnd]).permutation(4)[:3])
        add, splits = _grow(bins, g, h, used, n_bounds, p)
        inner = [(n[1], n[2]) for n in model.trees[rnd].nodes if n[5] < 0]
        assert sorted(inner) == sorted((f, float(bounds[f][b])) for f, b, _ in splits)
        for f, _, gain in splits:
            importance[features[f]] = importance.get(features[f], 0.0) + gain
        score = score + 0.3 * add
        model.best_round = rnd + 1
        got = model.predict(df.withColumn("rid", F.xxhash64("query_id", F.array(*features)))).orderBy("query_id", "rid", "label").collect()
        assert np.allclose([r["score"] for r in got], score, atol=1e-9)
    assert {k: pytest.approx(v[0], abs=1e-6) for k, v in model.importance.items()} == importance
    assert dict(model.feature_importance()) == {k: v[0] for k, v in model.importance.items()}
    ndcg = RK.query_ndcg(spark.createDataFrame([(i, int(q), int(y), float(s)) for i, (q, y, s) in enumerate(zip(query, label, score))],
                                               "row_id long, query_id long, label int, score double")).first()
    last = {k: v for r, _, k, v in model.history if r == 3}
    assert last == {k: pytest.approx(ndcg[f"ndcg_{k}"], abs=1e-9) for k in (5, 10, 20)}


def test_terms_equal_distributed_ones(spark):
    rows = _table(6, 3)
    query, label = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows])
    score = np.round(np.random.default_rng(1).normal(size=len(rows)), 1)
    g, h, _ = B.lambda_terms(query, label, score, np.array(GAINS, float), 4)
    df = spark.createDataFrame([(i, int(q), int(y), float(s)) for i, (q, y, s) in enumerate(zip(query, label, score))],
                               "row_id long, query_id long, label int, score double")
    got = {r["row_id"]: (r["g"], r["h"]) for r in RK.lambda_gradients(df, 4).collect()}
    for i in range(len(rows)):
        assert got.get(i, (0.0, 0.0)) == (pytest.approx(g[i], abs=1e-12), pytest.approx(h[i], abs=1e-12))


def test_early_stopping_and_disk(spark, tmp_path):
    """Validation labels are noise: the fit stops early; one state is kept on disk."""
    import os
    df, noise = _frame(spark, _table()), _frame(spark, [(q, i % 2, *x) for i, (q, _, *x) in enumerate(_table(12, 5))])
    seen = []
    for _ in B.boost(df, noise, ["a", "b", "c", "d"], 40, B.Growth(4, 5, 0.1, 0.1), 0.3, 1.0, GAINS, 30, (5, 10), 10, 3, 1):
        folder = session.scratch_dir(spark, "ranker_state").removeprefix("file://")
        seen.append(len(os.listdir(folder)))
    assert 3 < len(seen) < 40 and set(seen) == {2}      # one of the training rows, one of the validation rows


def test_no_rows_and_no_gain(spark):
    empty = _frame(spark, []).where("query_id < 0")
    assert RK.fit_ranker(empty, ["a", "b"], None, n_rounds=2).trees == []
    flat = _frame(spark, [(q, 0, float(i), 0.0, 0.0, 0.0) for q in range(3) for i in range(30)])
    model = RK.fit_ranker(flat, ["a", "b"], None, n_rounds=2)
    assert all(len(t.nodes) == 1 for t in model.trees)
    assert model.predict(flat).agg(F.max(F.abs("score"))).first()[0] == 0.0


def test_replay_is_best_first():
    nodes = [B.Node(0, (), 5.0, left=1, right=2), B.Node(1, (), 1.0, left=3, right=4), B.Node(2, (), 3.0),
             B.Node(3, (), 2.0), B.Node(4, (), -math.inf)]
    assert B.replay(nodes, 2) == ([0], [])
    assert B.replay(nodes, 3) == ([0], [2])                 # node 2 comes before node 1, its children are not known
    nodes[2].left, nodes[2].right = 5, 6
    nodes += [B.Node(5, (), -math.inf), B.Node(6, (), 0.5)]
    assert B.replay(nodes, 4) == ([0, 2, 1], [])
    assert B.replay(nodes, 6) == ([0, 2, 1], [3, 6])


def test_integer_histograms_are_exact():
    rng = np.random.default_rng(2)
    n = 5000
    bins = rng.integers(0, 5, (2, n)).astype(np.uint8)
    g, h = rng.normal(size=n) * 1e3, rng.random(n)
    scale = (B._scale(float(np.abs(g).max()), n), B._scale(float(h.max()), n))
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"n": n, "bins": bins.tobytes(), "g": g.tobytes(), "h": h.tobytes()}])
    out = next(B._histograms([(0, 0, 2, 1, 2)], [1, 2], np.array([0, 1]), scale, 2)(iter([batch]))).to_pylist()
    for r in out:
        rows = (bins[0] <= 2 if r["node"] == 1 else bins[0] > 2) & (bins[r["feature"]] == r["bin"])
        assert r["c"] == rows.sum()
        assert r["g"] == sum(int(v) for v in np.rint(g[rows] * scale[0])) and r["h"] == sum(int(v) for v in np.rint(h[rows] * scale[1]))


def test_rows_reach_their_nodes():
    bins = np.random.default_rng(4).integers(0, 6, (3, 500)).astype(np.uint8)
    splits = [(0, 1, 2, 1, 2), (2, 0, 3, 3, 4), (1, 2, 0, 5, 6), (4, 1, 4, 7, 8)]
    at = B.route(bins, splits)
    for wanted in ([0], [3, 7], [5, 6, 8], [1, 4]):
        for w, rows in zip(wanted, B.reached(bins, splits, wanted)):
            under, more = {w}, True
            while more:
                more = {c for s in splits if s[0] in under for c in s[3:]} - under
                under |= more
            assert np.array_equal(np.sort(rows), np.flatnonzero(np.isin(at, list(under))))


def test_a_tree_begins_with_the_histogram_of_the_step_before(spark, monkeypatch):
    """The root is not summed in a job of its own, and a written state read again gives the same trees."""
    df, valid = _frame(spark, _table(60, 7)), _frame(spark, _table(12, 5))
    calls, plain = [], B._pass
    monkeypatch.setattr(B, "_pass", lambda rows, splits, wanted, *a: calls.append(wanted) or plain(rows, splits, wanted, *a))
    fit = lambda: RK.fit_ranker(df, ["a", "b", "c", "d"], valid, n_rounds=5, num_leaves=6, min_child_samples=5, block_rows=200)
    first = fit()
    assert len(first.trees) == 5 and sum(w == [0] for w in calls) < 4
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(B, "TREE_PARTS", 1)
    again = fit()
    assert [t.nodes for t in again.trees] == [t.nodes for t in first.trees] and [t.values for t in again.trees] == [t.values for t in first.trees]
    assert [h[:3] for h in again.history] == [h[:3] for h in first.history]
    assert [h[3] for h in again.history] == pytest.approx([h[3] for h in first.history])


@pytest.mark.parametrize("most", [1000, 12, 1])
def test_terms_of_blocks_equal_those_by_joins(spark, monkeypatch, most):
    """All queries in blocks, the long ones by joins, and all by joins: the same rows, ties and labels beyond the gains included."""
    rng = np.random.default_rng(9)
    rows = [(i, int(q), int(rng.integers(0, 7)), float(np.round(rng.normal(), 1)), int(rng.integers(0, 5)))
            for i, q in enumerate(np.repeat(np.arange(12), rng.integers(1, 30, 12)))]
    rows += [(1000 + i, 50, 1, 0.5, 0) for i in range(4)] + [(2000 + i, 51, 0, 0.5, 0) for i in range(4)] + [(3000, None, 1, 0.1, 0), (3001, None, 0, 0.2, 0)]
    df = spark.createDataFrame(rows, "row_id long, query_id long, label int, score double, item_id long")
    for args in ({}, {"truncation": 3, "sigmoid": 2.0}, {"truncation": 2, "normalize": False}):
        full = {"truncation": 30, "sigmoid": 1.0, "label_gain": GAINS, "normalize": True, **args}
        want = {r["row_id"]: (r["g"], r["h"]) for r in RK._paired_gradients(df, **full, tie=("item_id", "row_id")).collect()}
        monkeypatch.setattr(RK, "QUERY_ROWS", most)
        got = RK.lambda_gradients(df, **args, tie=("item_id", "row_id"), carry=("label", "item_id")).collect()
        assert {r["row_id"] for r in got} == set(want) and len(got) == len(want)
        for r in got:
            assert (r["g"], r["h"]) == (pytest.approx(want[r["row_id"]][0], abs=1e-12), pytest.approx(want[r["row_id"]][1], abs=1e-12))
            row = next(x for x in rows if x[0] == r["row_id"])
            assert (r["label"], r["item_id"]) == (row[2], row[4])


def test_pairs_of_short_queries_are_not_joined(spark):
    df = spark.createDataFrame([(i, i // 5, i % 2, float(i % 3)) for i in range(40)], "row_id long, query_id long, label int, score double")
    plan = RK.lambda_gradients(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
