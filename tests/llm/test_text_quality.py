"""Personal data, quality rules, mixing and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, mixing, pii_crf, quality_mcd
from tests.llm import brute

# ---- personal data ----


def test_base_spans_match_the_patterns():
    r = random.Random(5)
    bits = ["a", "1", "2", "25", "256", "0", ".", "@", "-", " ", "+", "(", ")", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "\n", "é", "_"]
    for _ in range(20000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert pii_crf.base_spans(text) == brute.base_spans(text)


def test_long_runs_are_linear():
    pii_crf.base_spans("1" * 200000 + " " + "a@" * 50000 + "1." * 50000 + "+1 ((" * 20000)


def letters(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        mail, phone = f"john.{r.randint(10, 99)}@mail{i % 5}.example.com", f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        rows.append((i, f"Write to {mail} or call {phone} now. In {r.randint(1990, 2030)} we had {r.randint(10, 99)} of 3.5 and id {r.randint(10**8, 10**9)}. "
                        f"Again: {mail}, {phone}."))
    return rows


def test_links_carry_labels(docs_of):
    rows = letters(60, 1)
    rows += [(100, "I am bob.smith42@x.example.org. Yours, bob.smith42 and the year 2020."), (101, "year 2020, id 404189497460, bob.smith42"),
             (102, None), (103, ""), (104, "call +1 (988) 555-2485 or 555-2485 today")]
    got = {r.doc_id: r for r in pii_crf.find_spans(docs_of(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = pii_crf.span_text(brute.base_spans(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert "email:39:50" in got[100].spans          # the bare name, by its link to the address
    assert got[101].spans == "" and got[102].spans == "" and got[103].spans == ""
    assert "phone:26:34" in got[104].spans
    assert all(got[i].spans == pii_crf.span_text(brute.base_spans(t)) for i, t in rows[:60])


def test_messages_agree_with_exact_marginals():
    """On a chain without loops, message passing is exact."""
    import itertools

    import numpy as np
    rng = np.random.default_rng(0)
    f = pii_crf.Field("a1 b2 c3", [])
    w = {"unary": rng.normal(size=(pii_crf._FEATURES, 5)), "chain": rng.normal(size=(5, 5)), "skip": 1.0}
    u = f.features() @ w["unary"]
    exact = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        p = np.exp(sum(u[i, y[i]] for i in range(3)) + w["chain"][y[0], y[1]] + w["chain"][y[1], y[2]])
        for i in range(3):
            exact[i, y[i]] += p
    assert np.allclose(pii_crf.marginals(f, w), exact / exact.sum(axis=1, keepdims=True), atol=1e-3)


def test_redact(docs_of):
    docs = docs_of([(1, "mail a.b@c.de!"), (2, None), (3, "clean é"), (4, "n 4111 1111 1111 1111 x"), (5, "+1 4111 1111 x")], extra=True)
    out = pii_crf.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("mail [EMAIL]!", 13), 2: (None, None), 3: ("clean é", 7), 4: ("n [CARD] x", 10), 5: ("[PHONE] x", 9)}
    assert pii_crf.redact(docs_of([])).count() == 0 and pii_crf.find_spans(docs_of([])).count() == 0

# ---- quality ----


def quality_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(240):
        words = [r.choice(["the", "of", "thing", "being", "wonder", "a", "certain"]) + str(r.randint(0, 500)) for _ in range(r.randint(5, 150))]
        text = " ".join(words)
        if i % 40 == 7:
            text = " ".join(w + "###$$" for w in words + words[:30])
        if i % 40 == 9:
            text = "\n".join(["same line of several words here today"] * 12 + words)
        if i % 40 == 11:
            text = "one two three four five six seven eight nine ten " * 6
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 2}" if i % 5 else None))
    return rows + [(900, None), (901, ""), (902, "a  \n\n b\n \n b"), (903, "x " * 40000, None, None)]


def test_base_counts(docs_of):
    rows = quality_rows()
    got = quality_mcd.quality_scores(docs_of(rows, extra=True)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(text[r.doc_id])
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in got}
    noisy = [i for i in range(240) if i % 40 == 7]
    assert not any(by[i].kept for i in noisy)
    plain = [i for i in range(240) if i % 40 not in (7, 9, 11) and not by[i].base_failed]
    assert all(by[i].kept for i in plain)


def _normal(rng, n, pairs):
    """Four statistics, correlated in the given pairs."""
    import numpy as np
    c = np.eye(4)
    for i, j in pairs:
        c[i, j] = c[j, i] = 0.95
    return rng.multivariate_normal(np.zeros(4), c, n)


def _mcd(spark, x, group=lambda i: "g"):
    import numpy as np
    common.prepare(spark)
    df = spark.createDataFrame([(i, "en", group(i), *map(float, v)) for i, v in enumerate(x)],
                               "doc_id long, lang string, _g string, x0 double, x1 double, x2 double, x3 double")
    return np.array([r.d2 for r in quality_mcd.mcd_distances(df).orderBy("doc_id").collect()])


def test_mcd_finds_the_least_determinant(spark):
    """Against random multi-start concentration in numpy, run to convergence."""
    import numpy as np
    rng = np.random.default_rng(1)
    x = _normal(rng, 600, [(0, 1), (2, 3)]) * [.3, 1, .4, .5]
    x[:130] = rng.normal(size=(130, 4)) * .1 + [1.8, -6, 2.4, -3]
    got = _mcd(spark, x)
    floor = np.diag(np.square(quality_mcd.FLOOR))
    best = (np.inf, None, None)
    for _ in range(60):
        near = x[rng.choice(600, 6, replace=False)]
        old = np.inf
        while True:
            m, c = near.mean(axis=0), np.cov(near.T, bias=True) + floor
            det = np.linalg.det(c)
            if not det < old - 1e-12:
                break
            old = det
            d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d2)[:450]]
        if old < best[0]:
            best = (old, m, c)
    _, m, c = best
    d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    near = x[d2 <= quality_mcd.CHI_REWEIGHT * 1.4866]
    m, c = near.mean(axis=0), 1.0645 * np.cov(near.T, bias=True) + floor
    d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    assert np.allclose(got, d2, rtol=.02)


def test_planted_outliers_are_rejected(spark):
    """A fifth of each group lies against the correlation of the rest; medians alone miss it."""
    import numpy as np
    rng = np.random.default_rng(2)
    at = [np.array([6, -6, 6, -6]), np.array([8, -8, 0, 0])]
    x = np.concatenate([_normal(rng, 1500, [(0, 1), (2, 3)]) for _ in at])
    bad = np.zeros(3000, bool)
    for k, centre in enumerate(at):
        rows = slice(1500 * k, 1500 * k + 330)
        x[rows] = centre + rng.normal(size=(330, 4)) * .3
        bad[rows] = True
    far = _mcd(spark, x, lambda i: f"g{i // 1500}") > quality_mcd.CUT
    assert far[bad].all() and far[~bad].mean() < .003


def test_clean_groups_keep_their_rows(spark):
    import numpy as np
    x = _normal(np.random.default_rng(3), 4000, [(0, 2)]) * 5        # the floors hardly count
    far = _mcd(spark, x) > quality_mcd.CUT
    assert far.mean() < .003
    flat = np.zeros((200, 4))
    assert not (_mcd(spark, flat) > quality_mcd.CUT).any()           # no scatter at all
    assert quality_mcd._consistency(.75, quality_mcd.CHI_H) == pytest.approx(1.4866, abs=1e-3)


def test_quality_uses_no_python(docs_of):
    plan = quality_mcd.quality_scores(docs_of(quality_rows()[:50]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_of_no_rows(docs_of):
    docs = docs_of([])
    assert quality_mcd.quality_scores(docs).count() == 0 and quality_mcd.quality_filter(docs).columns == docs.columns

# ---- mixing ----


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 5, 100, 5000, 100000]) for s in [None, "a", "B", "é", "z", "src10", "src2"][:r.randint(1, 7)]}
    rows = [(s, n) for s, n in sizes.items()]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(brute.targets(sizes, mixing.WEIGHTS, 3))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(docs_of):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 60), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(None, "x y", "en", "b"), (601, None, None, "c")]
    docs = docs_of(rows, extra=True)
    plan = mixing.plan(docs).collect()
    again = mixing.plan(docs).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again)) and len(plan) == len(rows)
    for p in plan:
        assert 0 <= p.copies <= 3
    for source, mine in brute.by_key(plan, lambda p: p.source).items():
        if mine[0].target > 0:
            assert sum(p.size * p.copies for p in mine) == pytest.approx(mine[0].target, rel=.25)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(p.copies for p in plan)
    assert mixing.mix(docs_of([])).count() == 0 and mixing.plan(docs_of([])).count() == 0


def test_mix_uses_no_python(docs_of):
    plan = mixing.plan(docs_of([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

# ---- pipeline ----


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            kept = {r.doc_id for r in quality_mcd.quality_scores(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if i == 1:
            expect = brute.classes([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.NEAR_SHINGLE)
            assert {r.doc_id for r in docs.collect()} == {k for k, v in expect.items() if v[2]}
        if i == 2:
            assert not any(brute.base_spans(r.text) for r in docs.collect())
        if i == 3:
            taken = {r.doc_id: r.copies for r in mixing.plan(before).collect()}
            got = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert got == {k: v for k, v in taken.items() if v}
        if i == 4:
            assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0 and counts[5] > 0


CLASH = ("_tk", "_mi", "_ms", "_copies", "_copy", "copies", "_ni", "_nt", "_qi", "_ql", "bad", "first", "class", "rep", "n", "_id", "_key", "token", "part")


def test_stages_with_clashing_names_nulls_and_repeats(docs_of, tmp_path):
    """Every filtering stage on null ids, null columns, repeated rows and columns named
    like those that operators use inside."""
    import corpus_pipeline
    text = "the first one of several words here " * 5
    rows = [(1, text), (1, text), (None, text + "x"), (None, text + "x"), (3, None), (3, None), (4, ""), (5, "unlike any other words at all " * 6, None, None)]
    docs = docs_of(rows)
    for c in CLASH:
        docs = docs.withColumn(c, docs["doc_id"].cast("string"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 5, None).otherwise(F.col("source")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(docs.sparkSession, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        empty = stage(docs.sparkSession, docs.where("doc_id = -1"), "")
        assert empty.columns == docs.columns and empty.count() == 0
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect() if r.text)
    assert [k[1] for k in kept] == [1, 5]       # one of the class, of its repeated row one
    assert corpus_pipeline.near_dedup(docs.sparkSession, docs, "").where("text IS NULL OR text = ''").count() == 3
