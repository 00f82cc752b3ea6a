"""Substring dedup (automata, suffixes) and near-dedup against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm import common, components, minhash_join, passages, substring_sam, suffix_bwt, textops
from rankloom.session import get_spark  # noqa: F401
from tests.llm import brute


def corpus(seed, n=60, shared=6):
    """Random documents with shared passages, copies, periods and odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = [" ".join(r.choices(vocab, k=r.randint(8, 40))) for _ in range(shared)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choices(vocab, k=r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passage), " ".join(r.choices(vocab, k=r.randint(0, 12)))]
        rows.append((i, "\n".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, rows[0][1]), (n + 5, rows[0][1]),
             (n + 6, "a b " * 60), (n + 7, "x\x0by\x0cz " * 30), (n + 8, " ".join(r.choices(vocab, k=6000)) + passage[0])]
    return rows


def test_rolling_hash_is_of_content():
    v = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64)
    w = textops.Rolling(v).windows(3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4


def test_words_follow_the_word_class():
    texts = [b"", b"a  b\tc\x0bd", b" \n", "é x y".encode()]
    w = textops.Words(texts)
    assert w.count.tolist() == [0, 4, 0, 2]
    assert len(textops.Words([b"x" * (3 << 20)]).hashes()) == 1


def test_equal_windows_share_a_seed():
    r = np.random.default_rng(3)
    shared = r.integers(0, 5, 30)
    values = textops.mix(np.concatenate((r.integers(0, 9, 50), shared, r.integers(0, 9, 20), shared)).astype(np.uint64))
    _, h, win, n = textops.seeds(values, np.zeros(len(values)), 4, 20)
    owner = {int(a) + k: int(x) for x, a, c in zip(h, win, n) for k in range(c)}
    assert len(owner) == len(values) - 19
    for k in range(11):
        assert owner[50 + k] == owner[100 + k]


@pytest.mark.parametrize("seed,window,k", [(1, 10, 4), (2, 12, 12), (3, 35, 12)])
def test_substring_matches_brute_force(docs_of, seed, window, k):
    rows = corpus(seed)
    got = substring_sam.dedup_substrings(docs_of(rows, extra=True), window, k).collect()
    expect = {x[0]: x for x in brute.substring(rows, window)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) == expect[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_hot_seed_is_cut_into_windows(docs_of, monkeypatch):
    monkeypatch.setattr(passages, "HOT_PIECES", 3)
    monkeypatch.setattr(passages, "SHARD_PIECES", 4)
    rows = corpus(5)
    got = substring_sam.dedup_substrings(docs_of(rows), 10, 4, with_text=False).collect()
    expect = {x[0]: x for x in brute.substring(rows, 10)}
    assert all((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) == expect[r.doc_id] for r in got)
    got = suffix_bwt.dedup_bytes(docs_of(rows), 40, 12, with_bytes=False).collect()
    expect = {x[0]: x for x in brute.suffixes(rows, 40)}
    assert all((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expect[r.doc_id] for r in got)


@pytest.mark.parametrize("unit,window,k", [("word", 10, 4), ("byte", 40, 12)])
def test_hot_window_is_one_row_of_its_shard(docs_of, monkeypatch, unit, window, k):
    """A passage shared by many documents, with different text around it."""
    monkeypatch.setattr(passages, "HOT_PIECES", 3)
    r = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{r.random()} {r.random()} {shared} {r.random()} {r.random()}") for i in range(40)]
    docs = docs_of([*rows, (None, shared), (3, rows[3][1])])
    common.prepare(docs.sparkSession)
    distinct = passages.distinct_pieces(passages.repeated_pieces(docs, unit, k, window))
    shard, windows, _ = passages.shards(docs, distinct, unit, window, k)
    hot = shard.where("hot").groupBy("key", "body").count().collect()
    assert hot and max(x["count"] for x in hot) == 1
    assert windows.groupBy("key").count().agg({"count": "max"}).first()[0] > 20
    rows = [*rows, (None, shared)]
    docs = docs_of(rows)
    if unit == "word":
        got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in substring_sam.dedup_substrings(docs, window, k).collect()}
        assert got == {x[0]: x[2:] for x in brute.substring(rows, window)}
    else:
        got = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_bwt.dedup_bytes(docs, window, k).collect()}
        assert got == {x[0]: x[2:] for x in brute.suffixes(rows, window)}


@pytest.mark.parametrize("hot", [2, 3, 10**9])
def test_any_heat_gives_the_same_result(docs_of, monkeypatch, hot):
    """Whether and how far pieces are cut into parts does not show in the results."""
    monkeypatch.setattr(passages, "HOT_PIECES", hot)
    r = random.Random(3)
    shared = [" ".join(r.choices("abcdefgh", k=50)) for _ in range(3)]
    rows = [(i, f"{r.random()} {shared[i % 3][i % 7:]} {r.random()} {shared[0][:60 + i % 5]}") for i in range(60)]
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, None)]
    got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in substring_sam.dedup_substrings(docs_of(rows), 12, 5).collect()}
    assert got == {x[0]: x[2:] for x in brute.substring(rows, 12)}
    got = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_bwt.dedup_bytes(docs_of(rows), 40, 12).collect()}
    assert got == {x[0]: x[2:] for x in brute.suffixes(rows, 40)}


def test_automaton_counts_places():
    sam = substring_sam.SuffixAutomaton()
    for s in ("abcab", "xbca"):
        sam.add(s)
    sam.close(2)
    assert sam.statistics("abca") == [1, 2, 2, 3]     # ab twice, bca twice
    assert sam.statistics("zzbc") == [0, 0, 1, 2]


@pytest.mark.parametrize("seed,length", [(1, 30), (4, 100)])
def test_suffixes_match_brute_force(docs_of, seed, length):
    rows = corpus(seed)
    got = suffix_bwt.dedup_bytes(docs_of(rows, extra=True), length, 12).collect()
    expect = {x[0]: x for x in brute.suffixes(rows, length)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expect[r.doc_id]


@pytest.mark.parametrize("trial", range(6))
def test_interval_expansion_groups(trial):
    r = random.Random(trial)
    m = r.choice([1, 3, 9, 20])
    base = [bytes(r.choices(b"ab" if trial % 2 else b"abcdef", k=r.randint(m, 60))) for _ in range(5)]
    text = np.frombuffer(b"\xff".join(b"".join(r.choices(base, k=2)) for _ in range(15)) + b"\xff", np.uint8)
    order, group = suffix_bwt.common_prefix_groups(text, m)
    twice = text.tobytes() * 2
    heads = [twice[i:i + m] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert all((heads[i] == heads[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(order)))


def test_null_ids_repeated_rows_and_empty_tables(docs_of):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(None, text), (3, text), (3, text), (3, "other " + text), (None, None)]
    got = substring_sam.dedup_substrings(docs_of(rows), 35, 12).collect()
    assert len(got) == 5 and sum(r.n_removed == 50 for r in got) == 4
    got = suffix_bwt.dedup_bytes(docs_of(rows), 100, 24).collect()
    assert {(r.doc_id, r.n_removed > 0) for r in got} == {(None, False), (3, True)} and len(got) == 5
    got = minhash_join.near_classes(docs_of(rows)).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.n_shingles} == {3}
    empty = docs_of([])
    assert substring_sam.dedup_substrings(empty).count() == 0
    assert suffix_bwt.dedup_bytes(empty).count() == 0
    assert minhash_join.near_classes(empty).count() == 0
    assert minhash_join.near_filter(empty).columns == empty.columns


def near_rows(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = r.choices(vocab, k=r.choice([8, 40, 120]))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 10))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "one", "ONE", "One two", "one  two", "a a a a", rows[0][1].upper()])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_classes_match_brute_force(docs_of, monkeypatch, seed):
    monkeypatch.setattr(minhash_join, "BLOCK", 4)
    rows = near_rows(seed)
    got = minhash_join.near_classes(docs_of(rows, extra=True)).collect()
    expect = brute.classes(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expect


def test_near_filter_keeps_one_of_each_class(docs_of):
    rows = near_rows(4)
    docs = docs_of(rows, extra=True)
    kept = minhash_join.near_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in brute.classes(rows).items() if c[2]}


def test_pipeline_stage_compares_five_words(docs_of):
    """Two words changed: alike by two-word shingles, not by five-word ones."""
    base = [f"f{i}" for i in range(60)]
    changed = [*base[:20], "x", *base[21:40], "y", *base[41:]]
    rows = near_rows(6)
    rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate([base, changed, [*base, "z"], base[:4], base[:4], base[:3]])]
    two, five = brute.classes(rows), brute.classes(rows, 5)
    docs = docs_of(rows)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect()}
    assert got == {i for i, c in five.items() if c[2]} != {i for i, c in two.items() if c[2]}


def test_chain_of_links_is_one_class(docs_of):
    """Neighbours in the chain are alike, its ends are not."""
    words = [f"c{i}" for i in range(140)]
    rows = [(i, " ".join(words[4 * i:4 * i + 60])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash_join.near_classes(docs_of(rows)).collect()}
    assert got == {i: c[1] for i, c in brute.classes(rows).items()}
    assert set(got.values()) == {0}


def test_components_of_paths_and_stars(spark):
    common.prepare(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (7, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[100 + i] for i in range(30)}) == 1
    assert got[0] != got[100] and 500 not in got
