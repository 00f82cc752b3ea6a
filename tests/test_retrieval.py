"""Index and search properties (reference index tests) plus cross-path identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import retrieval as R
from rankloom.sources import tables as T

DIM = 64


@pytest.fixture(scope="module")
def index(spark, sf):
    e = T.embeddings(spark, sf).cache()
    cent = R.label_centroids(e, DIM).cache()
    post = R.assign_lists(e, cent, DIM).cache()
    return e, cent, post


def _q(e):
    return e.select(F.col("item_id").alias("query_id"), "vec")


def test_k_results_scores_descending_self_found(index):
    e, cent, post = index
    hits = R.ann_search(_q(e), post, cent, DIM, 10, 3).collect()
    by_q = {}
    for h in hits:
        by_q.setdefault(h["query_id"], []).append(h)
    assert len(by_q) == e.count()
    for q, rows in by_q.items():
        rows.sort(key=lambda r: r["rank"])
        assert len(rows) == 10
        assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))
        assert rows[0]["item_id"] == q  # a unit vector is its own nearest neighbour


def test_k_capped_at_catalogue(index):
    e, cent, post = index
    n = e.count()
    hits = R.exact_search(_q(e).limit(3), post, cent, DIM, n + 100)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] == n


def test_all_lists_equals_exact(spark, index):
    e, cent, post = index
    a = R.ann_search(_q(e), post, cent, DIM, 20, cent.count()).select("query_id", "item_id", "rank")
    b = R.exact_search(_q(e), post, cent, DIM, 20).select("query_id", "item_id", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_many_blocks_equal_one_block(index):
    e, cent, post = index
    a = R.ann_search(_q(e), post, cent, DIM, 15, 2).select("query_id", "item_id", "rank")
    b = R.ann_search(_q(e), post, cent, DIM, 15, 2, user_block=37, item_block=23) \
        .select("query_id", "item_id", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scale_invariant_query(spark, index):
    e, cent, post = index
    q = _q(e).limit(5)
    q3 = q.select("query_id", F.transform("vec", lambda x: x * 3.0).alias("vec"))
    a = R.ann_search(q, post, cent, DIM, 10, 3).select("query_id", "item_id", "rank")
    b = R.ann_search(q3, post, cent, DIM, 10, 3).select("query_id", "item_id", "rank")
    assert a.exceptAll(b).count() == 0


def test_batch_search_fills_missing_slots(index):
    e, cent, post = index
    out = R.ann_batch_search(_q(e).limit(4), post, cent, DIM, 1000, 1)
    n = e.count()
    assert out.groupBy("query_id").count().agg(F.min("count")).first()[0] == n
    assert out.filter(F.col("item_id") == -1).count() > 0


def test_recall_one_with_all_lists(index):
    e, cent, post = index
    q = _q(e).limit(10)
    rec = R.ann_recall(R.ann_search(q, post, cent, DIM, 10, cent.count()), R.exact_search(q, post, cent, DIM, 10))
    assert rec.agg(F.min("recall")).first()[0] == pytest.approx(1.0)


def test_list_count_rule():
    assert R.list_count_rule(3900, 100) == 100 and R.list_count_rule(500, 100) == 12 and R.list_count_rule(10, 100) == 1


def test_vector_width_check(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "item_id long, vec array<double>")
    assert [r["item_id"] for r in R.check_vectors(v, 2).collect()] == [2]


def test_seq_dot_matches_numpy():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(5, 7)), rng.normal(size=(9, 7))
    assert np.allclose(R.seq_dot(q, x), q @ x.T)


def test_rounding_margin_covers_any_order():
    rng = np.random.default_rng(1)
    for scale in (1e-8, 1.0, 1e6):
        q, x = rng.normal(size=(40, 64)) * scale, rng.normal(size=(300, 64))
        assert (np.abs(q @ x.T - R.seq_dot(q, x)) <= R.rounding_margin(q, x)[:, None]).all()
        back = R.seq_dot(q[:, ::-1], x[:, ::-1])
        assert (np.abs(back - R.seq_dot(q, x)) <= R.rounding_margin(q, x)[:, None]).all()


def test_block_top_k_is_exact():
    """Many equal rows: ties must come out by id at any floor."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 9))
    x[50:120] = x[50]
    ids = rng.permutation(1000)[:200]
    q = np.concatenate((x[50:52], rng.normal(size=(6, 9))))
    bounds, allow = np.array([0, 90, 200]), np.ones((8, 2), bool)
    allow[3, 0] = False
    for k in (1, 10, 75, 500):
        score = R.seq_dot(q, x)
        score[3, :90] = -np.inf
        for floor in (np.full(8, -np.inf), np.sort(score, axis=1)[:, -20]):
            r, c, got, rank = R.top_k_block(q, x, ids, bounds, allow, k, floor)
            for i in range(8):
                best = sorted((j for j in range(200) if score[i, j] >= floor[i] and score[i, j] > -np.inf), key=lambda j: (-score[i, j], ids[j]))[:k]
                assert c[r == i].tolist() == best and rank[r == i].tolist() == list(range(len(best)))
                assert (got[r == i] == score[i, best]).all()


def test_blocks_return_few_rows(spark):
    """Lists apart from each other: the first block's k-th score keeps the other blocks
    from returning k rows each."""
    rng = np.random.default_rng(6)
    rows = [(40 * c + i, (np.eye(8)[c] + rng.normal(size=8) * 0.05).tolist()) for c in range(8) for i in range(40)]
    v = spark.createDataFrame(rows, "item_id long, vec array<double>")
    cent = R.basis_centroids(spark, 8)
    post = R.assign_lists(v, cent, 8).cache()
    hits, final = R.block_hits(R._routed(_q(v), R._centroid_matrix(cent, 8), 8, None), post, 8, 10, 64, 40)
    assert not final and 10 * 320 <= hits.count() <= 2 * 10 * 320
    found = {(r["query_id"], r["item_id"]) for r in R.exact_search(_q(v), post, cent, 8, 10, item_block=40).collect()}
    x = R.clamp_normalize(np.array([r[1] for r in rows]))
    score = R.seq_dot(x, x)
    assert found == {(i, j) for i in range(320) for j in sorted(range(320), key=lambda j: (-score[i, j], j))[:10]}


def test_lists_beyond_the_broadcast_bound(spark, index, monkeypatch):
    e, cent, post = index
    a = R.ann_search(_q(e), post, cent, DIM, 10, 3).select("query_id", "item_id", "rank").collect()
    p = R.probe(_q(e), cent, DIM, 3).select("query_id", "list_id", "probe_rank").collect()
    monkeypatch.setattr(R, "MAX_CENTROID_BYTES", DIM * 8 * 5)
    assert R._centroid_matrix(cent, DIM) is None
    assert sorted(R.probe(_q(e), cent, DIM, 3).select("query_id", "list_id", "probe_rank").collect()) == sorted(p)
    assert sorted(R.assign_lists(e, cent, DIM).select("list_id", "item_id").collect()) == sorted(post.select("list_id", "item_id").collect())
    assert sorted(R.ann_search(_q(e), post, cent, DIM, 10, 3).select("query_id", "item_id", "rank").collect()) == sorted(a)


def test_fifty_thousand_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    c, v = rng.normal(size=(50_000, 4)), rng.normal(size=(60, 4))
    cent = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list_id long, centroid array<double>")
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    monkeypatch.setattr(R, "MAX_CENTROID_BYTES", 1 << 20)
    monkeypatch.setattr(R, "BLOCK_BYTES", 1 << 18)
    best = np.argmax(R.seq_dot(R.clamp_normalize(v), c), axis=1)
    got = {r["item_id"]: r["list_id"] for r in R.assign_lists(vec, cent, 4).collect()}
    assert got == dict(enumerate(best.tolist()))


def test_wrong_width_raises(spark, index):
    e, cent, post = index
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, vec array<double>")
    with pytest.raises(Exception, match="must have 64 values"):
        R.ann_search(bad, post, cent, DIM, 5, 2).collect()
    with pytest.raises(Exception, match="must have 64 values"):
        R.assign_lists(bad.withColumnRenamed("query_id", "item_id"), cent, DIM).collect()


def test_saved_index_reads_probed_lists_only(spark, index, tmp_path):
    e, cent, post = index
    R.save_index(cent, post, str(tmp_path))
    c2, p2 = R.load_index(spark, str(tmp_path))
    q = _q(e).limit(1)
    live = R.probed_postings(q, p2, c2, DIM, 2)
    plan = live._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    lists = {r["list_id"] for r in R.probe(q, c2, DIM, 2).collect()}
    assert {r["list_id"] for r in live.select("list_id").distinct().collect()} <= lists and len(lists) == 2
    assert live.count() == post.where(F.col("list_id").isin(list(lists))).count()
    a = R.ann_search(q, live, c2, DIM, 10, 2).select("query_id", "item_id", "rank").collect()
    assert sorted(a) == sorted(R.ann_search(q, post, cent, DIM, 10, 2).select("query_id", "item_id", "rank").collect())


def _brute(queries, items, k):
    out = []
    for q, v in queries:
        v = np.array(v) / max(np.sqrt(np.square(v).sum()), 1e-8)
        best = sorted(((-R.pair_dot(v[None], R.clamp_normalize(np.array([x])))[0], i) for i, x in items))[:k]
        out += [(q, i, r + 1) for r, (_, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("item_block", [None, 1, 2])
def test_equal_vectors_are_scored_once(spark, item_block):
    """Sixty items of three vectors, and queries that cannot tell two of them apart."""
    vecs = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 1.0]]
    items = [(i, vecs[i % 3]) for i in range(60)]
    queries = [(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [0.3, 0.2, 0.9])]
    cent = R.basis_centroids(spark, 3)
    post = R.assign_lists(spark.createDataFrame(items, "item_id long, vec array<double>"), cent, 3)
    entries = R.distinct_entries(post, 25).collect()
    assert len(entries) == 3 and all(e["ids"] == sorted(e["ids"]) and len(e["ids"]) == 20 for e in entries)
    assert {len(e["ids"]) for e in R.distinct_entries(post, 7).collect()} == {7}
    q = spark.createDataFrame(queries, "query_id long, vec array<double>")
    for k in (7, 25, 100):
        hits = R.ann_search(q, post, cent, 3, k, 3, item_block=item_block)
        assert sorted((h["query_id"], h["item_id"], h["rank"]) for h in hits.collect()) == _brute(queries, items, k)
        lists, reach = R.ann_lists(q, post, cent, 3, k, 3, item_block=item_block)
        assert sorted((h["query_id"], i, r + 1) for h in lists.collect() for r, i in enumerate(h["item_ids"])) == _brute(queries, items, k)
        assert reach.count() == 3 * min(k, 20)


def test_expansion_in_steps(monkeypatch):
    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 2, (9, 4)).astype(float), rng.integers(0, 3, (30, 4)).astype(float)
    n = rng.integers(1, 6, 9)
    starts, ids = np.append(0, np.cumsum(n)), rng.permutation(n.sum())
    for a, b in zip(starts, starts[1:]):
        ids[a:b].sort()
    args = (q, x, starts, ids, np.array([0, 9]), np.ones((30, 1), bool), 6, np.full(30, -np.inf))
    whole = [np.concatenate(c) for c in zip(*R.top_k_entries(*args))]
    owner = np.repeat(np.arange(9), n)
    want = [(u, i) for u in range(30) for _, i in sorted((-R.pair_dot(q[u:u + 1], x[o:o + 1])[0], i) for o, i in zip(owner, ids))[:6]]
    assert list(zip(whole[0].tolist(), whole[1].tolist())) == want
    monkeypatch.setattr(R, "EXPAND_ROWS", 5)
    steps = list(R.top_k_entries(*args))
    assert len(steps) == 30 and all((np.concatenate(c) == w).all() for c, w in zip(zip(*steps), whole))


def test_tiles_give_the_block_s_best():
    """Blocks smaller than k, several lists, entries of several ids and equal scores."""
    rng = np.random.default_rng(8)
    x, q = rng.integers(-2, 3, (57, 3)).astype(float), rng.integers(-2, 3, (41, 3)).astype(float)
    n = rng.integers(1, 5, 57)
    starts, ids = np.append(0, np.cumsum(n)), rng.permutation(n.sum())
    for a, b in zip(starts, starts[1:]):
        ids[a:b].sort()
    bounds, allow = np.array([0, 9, 30, 57]), rng.random((41, 3)) < 0.6
    allow[5] = False
    for k in (1, 12, 300):
        for floor in (np.full(41, -np.inf), rng.integers(-3, 4, 41).astype(float)):
            args = (q, x, starts, ids, bounds, allow, k, floor)
            want = [np.concatenate(c) for c in zip(*R.top_k_entries(*args))]
            got = [np.concatenate(c) for c in zip(*R.top_k_tiles(*args, 7, 4))]
            by = np.argsort(got[0], kind="stable")
            assert all((g[by] == w).all() for g, w in zip(got, want)) and len(got[0]) == len(want[0])


def test_small_blocks_return_k_rows_a_query(spark):
    """Blocks of fewer entries than k have no k-th score of their own, and still no block
    returns all its rows."""
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(240)], "item_id long, vec array<double>")
    cent = R.basis_centroids(spark, 4)
    post = R.assign_lists(v, cent, 4).cache()
    hits, _ = R.block_hits(R._routed(_q(v), R._centroid_matrix(cent, 4), 4, None), post, 4, 10, 16, 4)
    assert hits.count() == 10 * 240


def test_blocks_shared_by_several_tasks(spark, monkeypatch):
    """Packed blocks beyond one, each sent to several tasks: the lists of a query are merged."""
    rng = np.random.default_rng(10)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "item_id long, vec array<double>")
    cent = R.basis_centroids(spark, 4)
    post = R.assign_lists(v, cent, 4).cache()
    want = _brute(rows[:60], rows, 9)
    monkeypatch.setattr(R, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(R, "SPLIT_PACKS", 1)
    monkeypatch.setattr(R, "EXPAND_ROWS", 40)
    for item_block in (None, 5):
        hits = R.exact_search(_q(v.where("item_id < 60")), post, cent, 4, 9, user_block=8, item_block=item_block)
        assert sorted((h["query_id"], h["item_id"], h["rank"]) for h in hits.collect()) == want


def test_batch_slots_fan_out_after_the_join(spark):
    """A query's slots are not rows before its list has met it; unfilled ones hold -1."""
    vecs = [(i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(8)]
    post = R.assign_lists(spark.createDataFrame(vecs, "item_id long, vec array<double>"), R.basis_centroids(spark, 2), 2)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (1, [1.0, 0.0])], "query_id long, vec array<double>")
    out = R.ann_batch_search(q, post, R.basis_centroids(spark, 2), 2, 4, 1)
    rows = sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in out.collect())
    one = [(1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (1, 4, -1, R.UNFILLED_SCORE)]
    assert rows == sorted(one * 2 + [(2, r, r + 2, 1.0) for r in (1, 2, 3, 4)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_lists_are_scored_for_their_own_queries_only():
    import tracemalloc
    rng = np.random.default_rng(5)
    q, x = R.clamp_normalize(rng.normal(size=(200, 8))), R.clamp_normalize(rng.normal(size=(20_000, 8)))
    bounds, owner = np.arange(0, 20_001, 400), rng.integers(0, 50, 200)
    allow = np.zeros((200, 50), bool)
    allow[np.arange(200), owner] = True
    tracemalloc.start()
    found = [np.concatenate(c) for c in zip(*R.top_k_entries(q, x, np.arange(20_001), np.arange(20_000), bounds, allow, 10, np.full(200, -np.inf)))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 20_000 * 8 / 4          # a fiftieth of the products is asked for
    s = R.seq_dot(q, x)
    want = [(u, i) for u in range(200) for i in np.lexsort((np.arange(400), -s[u, owner[u] * 400:][:400]))[:10] + owner[u] * 400]
    assert list(zip(found[0].tolist(), found[1].tolist())) == [(u, int(i)) for u, i in want]
    assert (found[2] == s[found[0], found[1]]).all()


def test_first_products_stay_within_their_margin():
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-25, 1e12, 1e20):
        q, x = rng.normal(size=(40, 19)) * scale, rng.normal(size=(60, 19))
        kind, margin = R.near_type(q, x)
        assert kind == (np.float64 if scale > 1e14 else np.float32)
        assert (np.abs(q.astype(kind) @ x.astype(kind).T - R.seq_dot(q, x)) <= margin[:, None]).all()
        for k in (1, 7, 60, 90):
            r, _, got, rank = R.top_k_block(q, x, np.arange(60), np.array([0, 25, 60]), np.ones((40, 2), bool), k, np.full(40, -np.inf))
            s = R.seq_dot(q, x)
            assert np.array_equal(got, np.concatenate([np.sort(v)[::-1][:k] for v in s]))


def test_recall_of_lists_equals_recall_of_rows(spark):
    exact = {1: [4, 5, 6], 2: [7, 8], 3: [9], 4: [1, 1, 2]}
    approx = {1: [6, 4, 11], 2: [3], 4: [1]}

    def frames(lists):
        df = spark.createDataFrame([(q, i, [0.0] * len(i)) for q, i in lists.items()], "query_id long, item_ids array<long>, scores array<double>")
        return df, df.select("query_id", F.explode("item_ids").alias("item_id"))
    (el, er), (al, ar) = frames(exact), frames(approx)
    got, want = R.ann_recall(al, el), R.ann_recall(ar, er)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} == {(1, 2 / 3), (2, 0.0), (3, 0.0), (4, 2 / 3)}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
