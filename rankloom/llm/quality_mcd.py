"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules look at each document alone. Documents that pass them are then
compared with their own language and source by a minimum-covariance-determinant
estimate of centre and scatter. It is searched from four deterministic starts
(`_starts`), which run side by side as rows of the same aggregations: a
concentration step takes the share ``H`` of documents nearest to an estimate and
makes a new one of them, whose determinant is not larger. After ``FIRST_STEPS`` steps
the start of least determinant goes on, until its determinant stops falling. A
consistency factor and a reweighting step follow. Documents beyond ``CUT`` in squared
Mahalanobis distance are rejected.

Statistics (four rates per word, smoothed towards the group's pooled rate by
``SMOOTH`` pseudo-words so that short texts are not outliers by chance, then
transformed): log mean word length, log symbols, share of repeated lines,
share of repeated words. Each variance has a floor (``FLOOR``), which keeps groups with a
constant statistic invertible. Groups under ``MIN_GROUP`` documents are pooled
by language.

Every pass over the documents is one grouped aggregation with map-side
combining, so a source with a third of all rows costs one partial row per
task; quantiles are exact percentiles of rounded values, whose state is
bounded by the number of rounding steps.

Defined results: null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; rows are judged one by one
(repeated rows alike); an empty table gives an empty result; extra columns are
carried by `quality_filter` and ignored by `quality_scores`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import common

MIN_WORDS = 20
REPEAT_SHARE = 30       # percent of words in repeated windows
H = 0.75                # share of documents that the estimate rests on
FIRST_STEPS = 2         # concentration steps of every start
FALL = 1e-3             # least fall of the log determinant that counts
SMOOTH = 100.0
MIN_GROUP = 50
FLOOR = (0.05, 0.6, 0.12, 0.12)       # least standard deviation of each statistic
#: chi-square quantiles, 4 degrees of freedom: H (consistency), 0.975 (reweighting), 0.999 (rejection)
CHI_H, CHI_REWEIGHT, CUT = 5.385, 11.143, 18.467
D = 4


def _consistency(share: float, quantile: float) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal data that of
    all: share / P(chi-square with D + 2 degrees of freedom < quantile)."""
    x = quantile / 2
    return share / (1 - math.exp(-x) * (1 + x + x * x / 2))     # D + 2 = 6

_WORD = r"[\\x20\\x09-\\x0D]+"

#: one lambda binds the word array, so that it is computed once per text
_STATS = rf"""
transform(array(filter(split(coalesce(text, ''), '{_WORD}'), x -> x != '')), w -> named_struct(
  'n_words', size(w),
  'word_chars', aggregate(w, 0L, (a, x) -> a + char_length(x)),
  'n_repeat_words', CASE WHEN size(w) < 9 THEN 0 ELSE
    transform(array(transform(sequence(0, greatest(size(w) - 8, 0)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2),
        get(w, i + 3), get(w, i + 4), get(w, i + 5), get(w, i + 6), get(w, i + 7)))), h ->
      CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE
        transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
          aggregate(
            sort_array(transform(filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false)
                                                  OR coalesce(get(s, j + 1).x = e.x, false)), e -> e.i)),
            named_struct('c', 0, 'last', -8),
            (a, i) -> named_struct('c', a.c + least(8, i - a.last), 'last', i),
            a -> a.c))[0] END)[0] END))[0]"""
_LINES = r"filter(split(coalesce(text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"


def base_stats(docs: DataFrame) -> DataFrame:
    """Counts of every row: ``doc_id, lang, source`` and a struct ``s``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    symbols = "char_length(coalesce(text, '')) - char_length(translate(coalesce(text, ''), '#*$%&|<>', ''))"
    return base.select(
        "doc_id", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tk"),
        F.expr(_STATS).alias("s"), F.expr(symbols).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({_LINES}), l -> named_struct('n', size(l), 'dup', size(l) - size(array_distinct(l))))[0]").alias("l"))


def _flat(stats: DataFrame) -> DataFrame:
    n, rep = F.col("s.n_words").cast("long"), F.col("s.n_repeat_words").cast("long")
    return stats.select(
        "doc_id", "lang", "source", "_tk", n.alias("n_words"), F.col("s.word_chars").cast("long").alias("word_chars"),
        "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("l.n").cast("long").alias("n_lines"),
        rep.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * rep > REPEAT_SHARE * n)).alias("base_failed"))


def _vectors(flat: DataFrame) -> DataFrame:
    """Statistic vectors of the rows that pass the base rules, with their group."""
    ok = flat.where("not base_failed")
    size = ok.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    size = size.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), (F.col("_n") < MIN_GROUP).alias("_small"))
    ok = ok.join(size, ok["lang"].eqNullSafe(F.col("_l")) & ok["source"].eqNullSafe(F.col("_s")))
    #: group key: the source behind a mark, or one mark for all small sources of the language
    ok = ok.withColumn("_g", F.when(F.col("_small"), F.lit("small")).otherwise(
        F.concat(F.lit("="), F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), "null").otherwise(""))))
    ok = ok.drop("_l", "_s", "_small")
    rates = ok.groupBy("lang", "_g").agg(*(
        (F.sum(c) / F.sum(w)).alias(r) for c, w, r in
        (("word_chars", "n_words", "_r1"), ("n_symbols", "n_words", "_r2"),
         ("n_dup_lines", "n_lines", "_r3"), ("n_repeat_words", "n_words", "_r4"))))
    rates = rates.withColumnRenamed("lang", "_l").withColumnRenamed("_g", "_h")
    ok = ok.join(rates, ok["lang"].eqNullSafe(F.col("_l")) & ok["_g"].eqNullSafe(F.col("_h")))

    def smooth(c, w, r, k):
        return (F.col(c) + k * F.col(r)) / (F.col(w) + k)
    return ok.select(
        "doc_id", "_tk", "lang", "source", "_g",
        F.log(smooth("word_chars", "n_words", "_r1", SMOOTH)).alias("x0"),
        F.log1p(100 * smooth("n_symbols", "n_words", "_r2", SMOOTH)).alias("x1"),
        smooth("n_dup_lines", "n_lines", "_r3", SMOOTH / 10).alias("x2"),
        smooth("n_repeat_words", "n_words", "_r4", SMOOTH).alias("x3"))


def _pairs():
    return [(i, j) for i in range(D) for j in range(i, D)]


_GROUP = ("lang", "_g")


def _beside(rows: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """Rows with the columns of their group's row in a small table (``more``: further keys)."""
    keys = (*_GROUP, *more)
    t = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in table.columns if c not in keys))
    both = rows.join(t, reduce(lambda x, y: x & y, (rows[k].eqNullSafe(t[f"_k{i}"]) for i, k in enumerate(keys))))
    return both.drop(*(f"_k{i}" for i in range(len(keys))))


def _invert(est: DataFrame) -> DataFrame:
    """Add ``p_ij``, the inverse of ``c_ij``, and ``ld``, its log determinant: one
    elimination per projection (keeps every expression small)."""
    keep = [c for c in est.columns if not c.startswith("c_")]
    cols = {(i, j): F.col(f"c_{min(i, j)}{max(i, j)}") for i in range(D) for j in range(D)}
    cols |= {(i, D + j): F.lit(1.0 if i == j else 0.0) for i in range(D) for j in range(D)}
    out = est.select(*keep, F.array(*(cols[i, j] for i in range(D) for j in range(2 * D))).alias("m"), F.lit(0.0).alias("ld"))

    def at(i, j):
        return F.get("m", F.lit(i * 2 * D + j))
    for k in range(D):
        cells = []
        for i in range(D):
            for j in range(2 * D):
                pivot = at(k, j) / at(k, k)
                cells.append(pivot if i == k else at(i, j) - at(i, k) * pivot)
        out = out.select(*keep, F.array(*cells).alias("m"), (F.col("ld") + F.log(at(k, k))).alias("ld"))
    return out.select(*keep, "ld", *(at(i, D + j).alias(f"p_{i}{j}") for i, j in _pairs()))


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """Centre ``m_i``, inverse scatter ``p_ij`` and ``ld`` per group and start of rows
    with ``z_i``, their distance from ``m_i``."""
    sums = rows.groupBy(*_GROUP, "st").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(f"z{i}").alias(f"s{i}") for i in range(D)),
        *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in _pairs()),
        *(F.first(f"m{i}").alias(f"a{i}") for i in range(D)))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(D)]
    cov = []
    for i, j in _pairs():
        c = scale * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j])
        cov.append((F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2 if i == j else c).alias(f"c_{i}{j}"))
    return _invert(sums.select(*_GROUP, "st", *((F.col(f"a{i}") + mean[i]).alias(f"m{i}") for i in range(D)), *cov))


def _distances(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows once per start, with ``z_i`` and the squared distance ``d2``."""
    both = _beside(rows, est.drop("ld"))
    both = both.withColumns({f"z{i}": F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)})
    total = sum(((1 if i == j else 2) * F.col(f"p_{i}{j}") * F.col(f"z{i}") * F.col(f"z{j}") for i, j in _pairs()), F.lit(0.0))
    return both.select(*rows.columns, "st", *(f"m{i}" for i in range(D)), *(f"z{i}" for i in range(D)), total.alias("d2"))


def _nearest(dist: DataFrame) -> DataFrame:
    """The share ``H`` of rows nearest to each estimate, per group and start."""
    level = F.round(F.log1p(F.least(F.greatest("d2", F.lit(0.0)), F.lit(1e6))), 3)
    dist = dist.withColumn("_v", level)
    cut = dist.groupBy(*_GROUP, "st").agg(F.percentile("_v", H).alias("_cut"))
    return _beside(dist, cut, "st").where(F.col("_v") <= F.col("_cut") + 0.0005).drop("_v", "_cut")


def _starts(vectors: DataFrame) -> DataFrame:
    """Four first estimates per group, from each statistic's median and median
    deviation: ``st`` 0 takes the deviations alone; the others the shape (correlations)
    of 1: hyperbolic tangents, 2: directions, 3: the half of rows nearest to the medians."""
    med = vectors.groupBy(*_GROUP).agg(*(F.percentile(F.round(f"x{i}", 3), 0.5).alias(f"m{i}") for i in range(D)))
    dev = _beside(vectors, med)
    spread = dev.groupBy(*_GROUP).agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(D)),
        *(F.percentile(F.round(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 3), 0.5).alias(f"d{i}") for i in range(D)))
    spread = common.materialize(spread.withColumns({f"d{i}": F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i] ** 2) for i in range(D)}), "mcd_start")
    rows = _beside(vectors, spread).withColumns({f"u{i}": (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(D)})
    rows = rows.withColumn("_r", F.sqrt(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(D)), F.lit(0.0))))
    half = rows.groupBy(*_GROUP).agg(F.percentile(F.round(F.least("_r", F.lit(1e6)), 3), 0.5).alias("_half"))
    rows = _beside(rows, half)
    forms = [(1, F.tanh, F.lit(1.0)), (2, lambda u: u / F.greatest(F.col("_r"), F.lit(1e-9)), F.lit(1.0)),
             (3, lambda u: u, F.when(F.col("_r") <= F.col("_half") + 0.0005, 1.0).otherwise(0.0))]
    sums = rows.groupBy(*_GROUP).agg(*(
        F.sum(w * f(F.col(f"u{i}")) * f(F.col(f"u{j}"))).alias(f"q{st}_{i}{j}") for st, f, w in forms for i, j in _pairs()))
    table = _beside(spread, sums)
    out = []
    for st in range(4):
        cov = []
        for i, j in _pairs():
            if i == j:
                c = F.col(f"d{i}") * F.col(f"d{i}")
            elif st == 0:
                c = F.lit(0.0)
            else:   # a correlation, drawn a little towards 0 so that the matrix has an inverse
                size = F.sqrt(F.col(f"q{st}_{i}{i}") * F.col(f"q{st}_{j}{j}"))
                c = F.when(size > 0, 0.98 * F.col(f"q{st}_{i}{j}") / size).otherwise(0.0) * F.col(f"d{i}") * F.col(f"d{j}")
            cov.append(c.alias(f"c_{i}{j}"))
        out.append(table.select(*_GROUP, F.lit(st).alias("st"), *(f"m{i}" for i in range(D)), *cov))
    return _invert(reduce(DataFrame.unionByName, out))


def _step(vectors: DataFrame, est: DataFrame) -> DataFrame:
    return common.materialize(_estimate(_nearest(_distances(vectors, est)), 1.0), "mcd")


def mcd_distances(vectors: DataFrame) -> DataFrame:
    """Squared robust distances ``d2`` of rows ``lang, _g, x0..x3`` from the
    minimum-covariance-determinant estimate of their group."""
    est = common.materialize(_starts(vectors), "mcd")
    for _ in range(FIRST_STEPS):
        est = _step(vectors, est)
    best = Window.partitionBy(*_GROUP).orderBy("ld", "st")      # four rows a group
    est = common.materialize(est.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"), "mcd")
    while True:
        new = _step(vectors, est)
        fall = _beside(est.select(*_GROUP, "st", F.col("ld").alias("_old")), new.select(*_GROUP, "ld"))
        most = fall.agg(F.max(F.col("_old") - F.col("ld"))).first()[0]
        est = new
        if most is None or most < FALL:     # the determinant of some group falls every time, and it has a least value
            break
    raw = _consistency(H, CHI_H)
    near = _distances(vectors, est).where(F.col("d2") <= CHI_REWEIGHT * raw)
    est = common.materialize(_estimate(near, _consistency(0.975, CHI_REWEIGHT)), "mcd")
    return _distances(vectors, est).drop("st", *(f"m{i}" for i in range(D)), *(f"z{i}" for i in range(D)))


def quality_scores(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, squared distance (null if the base rule failed)
    and ``kept`` per row."""
    common.prepare(docs.sparkSession)
    flat = _flat(common.materialize(base_stats(docs), "quality"))
    vectors = common.materialize(_vectors(flat), "vectors")
    # only rejected rows are joined back; rows alike in id, text, language and source are judged alike
    far = mcd_distances(vectors).where(F.col("d2") > CUT).groupBy(
        F.col("doc_id").alias("_i"), F.col("_tk").alias("_t"), F.col("lang").alias("_l"), F.col("source").alias("_s")) \
        .agg(F.max("d2").alias("d2"))
    out = flat.join(far, flat["doc_id"].eqNullSafe(F.col("_i")) & (flat["_tk"] == F.col("_t"))
                    & flat["lang"].eqNullSafe(F.col("_l")) & flat["source"].eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "lang", "source", "_tk", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("d2").isNull()).alias("kept"),
                      F.col("d2").alias("distance"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is kept, all their columns unchanged."""
    bad = quality_scores(docs).where("not kept").select("doc_id", "_tk", "lang", "source").distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (common.text_key(docs) == bad["_tk"])
                     & docs["lang"].cast("string").eqNullSafe(bad["lang"])
                     & docs["source"].cast("string").eqNullSafe(bad["source"]), "left_anti")


def op10_quality_mcd(spark, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over the whole ``documents`` table."""
    return quality_scores(common.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
