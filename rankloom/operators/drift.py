"""Training-serving skew (K1-K4).

All features are checked in one job: both sides are unpivoted to
``(feature, value)`` rows, ranges come from one grouped aggregate, bins from
K1, and KL divergence from a grouped sum over the full bin spine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rankloom.functions.binning import equal_width_bin

N_BINS = 20
EPSILON = 1e-10
THRESHOLD = 0.1
MIN_VALUES = 10


def numeric_columns(a: DataFrame, b: DataFrame) -> list[str]:
    bcols = set(b.columns)
    return [f.name for f in a.schema.fields if isinstance(f.dataType, NumericType) and f.name in bcols]


def _long(df: DataFrame, cols, side: str) -> DataFrame:
    u = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    return u.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("side", F.lit(side))


def kl_divergence(train: DataFrame, serving: DataFrame, cols=None, n_bins: int = N_BINS,
                  epsilon: float = EPSILON) -> DataFrame:
    """K2 per feature: ``(feature, kl, n_train, n_serving)``.

    Density histograms over the combined range (right-open bins, last closed),
    ``+epsilon`` on the densities, renormalised, ``sum p ln(p/q)``; a constant
    feature gives 0.
    """
    cols = cols or numeric_columns(train, serving)
    v = _long(train, cols, "p").unionByName(_long(serving, cols, "q"))
    rng = v.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum(F.when(F.col("side") == "p", 1).otherwise(0)).alias("n_p"),
        F.sum(F.when(F.col("side") == "q", 1).otherwise(0)).alias("n_q"))
    # one row per feature: bounded by the number of columns
    b = v.join(F.broadcast(rng.select("feature", "lo", "hi")), "feature") \
        .withColumn("bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), n_bins))
    counts = b.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("side") == "p", 1).otherwise(0)).alias("c_p"),
        F.sum(F.when(F.col("side") == "q", 1).otherwise(0)).alias("c_q"))
    spine = rng.select("feature", "lo", "hi", "n_p", "n_q",
                       F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    h = spine.join(counts, ["feature", "bin"], "left").fillna(0, ["c_p", "c_q"])
    w = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
    h = h.withColumn("dp", F.col("c_p") / (F.col("n_p") * w) + F.lit(epsilon)) \
         .withColumn("dq", F.col("c_q") / (F.col("n_q") * w) + F.lit(epsilon))
    s = h.groupBy("feature", "lo", "hi", "n_p", "n_q").agg(
        F.sum("dp").alias("sp"), F.sum("dq").alias("sq"),
        F.collect_list(F.struct("dp", "dq")).alias("_d"))
    kl = F.aggregate("_d", F.lit(0.0), lambda acc, d: acc + (d["dp"] / F.col("sp")) *
                     F.log((d["dp"] / F.col("sp")) / (d["dq"] / F.col("sq"))))
    return s.select("feature", F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise(kl).alias("kl"),
                    F.col("n_p").alias("n_train"), F.col("n_q").alias("n_serving"))


def detect_skew(train: DataFrame, serving: DataFrame, threshold: float = THRESHOLD, cols=None,
                n_bins: int = N_BINS, min_values: int = MIN_VALUES) -> DataFrame:
    """K3: per shared numeric feature ``(feature, kl, flagged)``; features with fewer
    than ``min_values`` non-null values on either side are skipped; KL rounded to 6."""
    kl = kl_divergence(train, serving, cols, n_bins)
    kl = kl.filter((F.col("n_train") >= min_values) & (F.col("n_serving") >= min_values))
    return kl.select("feature", F.round("kl", 6).alias("kl"), (F.round("kl", 6) > threshold).alias("flagged"))


def skew_report(per_feature: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """K3 summary row: features checked, flagged count, max KL, skew detected."""
    return per_feature.agg(
        F.count(F.lit(1)).alias("n_features_checked"),
        F.sum(F.col("flagged").cast("int")).alias("n_flagged"),
        F.coalesce(F.max("kl"), F.lit(0.0)).alias("max_kl"),
        F.coalesce(F.max(F.col("flagged").cast("int")), F.lit(0)).cast("boolean").alias("skew_detected"),
    ).withColumn("threshold", F.lit(threshold))
