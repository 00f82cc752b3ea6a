"""Phrase mining, impact-ordered search and the conversation trie against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import impact_search, prefix_trie, toivonen
from tests.llm import brute


# ------------------------------------------------------------------ phrases

def _phrase_rows(n=160, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    fixed = ["New York City", "of the", "a b c d", "Été à", "x-y\tz"]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 40)):
            w.append(rng.choice(fixed) if rng.random() < 0.25 else vocab[min(int(rng.expovariate(0.15)), 39)])
            if rng.random() < 0.12:
                w[-1] += rng.choice(".,;:!?\n\v\f\r")
        rows.append((i, rng.choice([" ", "  ", " \t "]).join(w), rng.choice(["en", "en", "fr", None, ""])))
    return rows


EDGE = [(900, None, "en"), (901, "", None), (902, "alone", "zz"), (902, "alone", "zz"), (None, "Of the of the", "en"),
        (903, "..,,\n\n", "en"), (904, "rep " * 30000, "long")]


@pytest.mark.parametrize("sample, low", [(8, 2), (2, 1), (1000, 2)])
def test_phrases_equal_brute_force(docs_of, monkeypatch, sample, low):
    """Whatever the sample proposes (next to nothing in the last case), the result is the same."""
    monkeypatch.setattr(toivonen, "SAMPLE", sample)
    monkeypatch.setattr(toivonen, "LOW", low)
    rows = _phrase_rows() + EDGE
    docs = docs_of([(i, t, g) for i, t, g in rows], extra=True)
    got = [tuple(r) for r in toivonen.mine(docs).collect()]
    expect = brute.collocations([(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()])
    assert sorted(got) == sorted(expect) and len(got) > 20


def test_border_failures_need_more_passes(docs_of, monkeypatch):
    rows = [(i, "one two three " * 3, "en") for i in range(8)]
    docs = docs_of(rows)
    monkeypatch.setattr(toivonen, "SAMPLE", 1)
    assert toivonen.frequent_phrases(docs)[1] == 1           # everything is proposed, nothing fails
    monkeypatch.setattr(toivonen, "SAMPLE", 10**9)           # nothing is proposed: words fail, then pairs
    frequent, passes = toivonen.frequent_phrases(docs)
    assert passes == 3
    assert Counter(r.a for r in frequent.where("h3 != 0").collect()) == Counter({24: 1, 16: 2})


def test_small_bitmaps_change_nothing(docs_of, monkeypatch):
    docs = docs_of(_phrase_rows(80, 9))
    expect = sorted(map(tuple, toivonen.mine(docs).collect()))
    monkeypatch.setattr(toivonen, "BITS_MOST", 1 << 16)
    monkeypatch.setattr(toivonen, "BITS_EACH", 1)
    assert sorted(map(tuple, toivonen.mine(docs).collect())) == expect


def test_phrase_products_pass_64_bits(spark):
    big = 10**14
    rows = [("en", 1, 0, 0, big), ("en", 2, 0, 0, big + 1), ("en", 1, 2, 0, big - 1)]
    got = toivonen.collocations(spark.createDataFrame(rows, "lang string, h1 long, h2 long, h3 long, a long")).first()
    assert got["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 1))


def test_phrases_of_an_empty_table(docs_of):
    assert toivonen.mine(docs_of([(1, "x")]).where("doc_id < 0")).count() == 0


# ------------------------------------------------------------------ search

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "vec_id", "embedding", F.lit("q").alias("q"), F.lit(1).alias("block"))


def _search(spark, rows, block_rows, k=20):
    v = impact_search.quantised(_vectors(spark, rows))
    out = impact_search.top_k(v, v.where(F.col("vec_id") % 20 == 0), k, block_rows)
    return sorted((r.query_id, r["rank"], -1 if r.vec_id is None else r.vec_id, r.score) for r in out.collect())


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_search_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(5, 12))
    rows = [(i, [float(x) for x in centre[i % 5] * 0.3 + rng.normal(size=12) * 0.1]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]                             # one very common vector
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2020, []),
             (2040, [0.5, -0.5]), (None, rows[20][1]), rows[60], rows[60], (2060, [0.0] * 12)]
    expect = sorted((q, r, -1 if i is None else i, s) for q, r, i, s in brute.best_products(rows))
    assert _search(spark, rows, block_rows) == expect


def test_search_with_few_rows(spark):
    assert _search(spark, [(0, [1.0]), (20, [-1.0]), (21, [0.5])], 8192) == [
        (0, 1, 21, 64 * 32), (0, 2, 20, -64 * 64), (20, 1, 21, -64 * 32), (20, 2, 0, -64 * 64)]
    assert _search(spark, [(1, [1.0])], 8192) == []
    assert _vectors(spark, [(1, [1.0])]).where("vec_id < 0").transform(impact_search.quantised).count() == 0


def test_scan_stops_only_on_proof():
    """The members returned by one block are the best ones at any threshold."""
    rng = np.random.default_rng(3)
    mat = rng.integers(-30, 30, (500, 8))
    mat[:50] *= 5
    mat[400:] = mat[399]
    ids = np.arange(500)
    none = np.full(60, -2**63)
    for scale in (1, 10**6):        # sums of the second kind pass the precision of floating point
        big = mat * scale
        perm = np.ascontiguousarray(np.argsort(-np.abs(big), axis=0, kind="stable").T.astype(np.int32))
        block = impact_search.Block(ids.tobytes(), np.ones(500, bool).tobytes(), big.tobytes(), perm.tobytes(), 8)
        score = big[:60] @ big.T
        best = [sorted((j for j in range(500) if j != i), key=lambda j: (-score[i, j], j))[:20] for i in range(60)]
        number, rows, got = block.search(big[:60], ids[:60], 20, none)
        assert number.tolist() == [i for i in range(60) for _ in range(20)] and rows.tolist() == sum(best, [])
        assert got.tolist() == [score[i, j] for i in range(60) for j in best[i]]
        floors = np.array([score[i, b[4]] for i, b in enumerate(best)])
        number, rows, _ = block.search(big[:60], ids[:60], 20, floors)
        assert list(zip(number, rows)) == [(i, j) for i in range(60) for j in best[i] if score[i, j] >= floors[i]]


# ------------------------------------------------------------------ trie

def _conversations(n=70, seed=1):
    rng = random.Random(seed)
    texts = ["hello there", "help me", "", "a b c", "thanks  a lot\n!", "ok"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts[:2] if t == 0 else texts)))
    return rows


def _trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", F.lit(1).alias("pos"), F.lit("x").alias("words"), F.lit(2).alias("depth"))
    return sorted(map(tuple, prefix_trie.trie(df).collect()), key=repr)


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = _conversations()
    rows += [(100 + i, 0, "user", "hello there") for i in range(30)]                          # copies, some turnless
    rows += [(200, None, None, None), (200, 3, "user", "b"), (200, 3, "user", "a"), (200, 3, "user", "a"),      # ties and repeats
             (None, 0, "user", "x"), (-7, 0, "user", "hello there"), (-20, 0, "user", "neg"), (221, 0, "user", "no first one"),
             (240, 5, "user", "w " * 20000), (241, 0, "user", "p"), (241, 1, "user", "q"), (241, 2, "user", "r"), (241, 3, "user", "s")]
    random.Random(2).shuffle(rows)
    expect = sorted(brute.trie(rows), key=repr)
    assert _trie(spark, rows) == expect
    monkeypatch.setattr(prefix_trie, "PART", 2)         # sequences summed in parts, lists joined of parts
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 3)
    assert _trie(spark, rows) == expect


def test_long_conversation_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS_PER_TASK", 40)
    rows = [(20, t, "user", f"t{t}") for t in range(300)] + [(c, t, "user", f"t{t}") for c in range(21, 32) for t in range(5)]
    assert _trie(spark, rows) == sorted(brute.trie(rows), key=repr)


def test_trie_of_an_empty_table(spark):
    assert _trie(spark, [(None, 0, "user", "x")]) == []


def test_trie_equals_brute_force_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op13_prefix_trie(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.trie(rows), key=repr)
