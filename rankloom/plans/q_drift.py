"""Registered drift queries (K1-K3): lineitem before vs. from 1998-06-01."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import drift as D
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T

COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_quantity_shifted")
CUT = "1998-06-01"


def _sides(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")
    train = li.filter(F.col("l_shipdate") < cut).withColumn("l_quantity_shifted", F.col("l_quantity"))
    serve = li.filter(F.col("l_shipdate") >= cut).withColumn("l_quantity_shifted", F.col("l_quantity") + 25)
    return train.select(*COLS), serve.select(*COLS)


def _kl_sql(final: str) -> str:
    cols = ", ".join(f"'{c}'" for c in COLS)
    unions = []
    for side, pred, shift in (("p", "<", ""), ("q", ">=", " + 25")):
        for c in COLS:
            expr = f"l_quantity{shift}" if c == "l_quantity_shifted" else c
            unions.append(f"SELECT '{c}' AS feature, CAST({expr} AS DOUBLE) AS value, '{side}' AS side "
                          f"FROM lineitem WHERE l_shipdate {pred} TIMESTAMP '{CUT}' AND {expr} IS NOT NULL")
    del cols
    return "WITH v AS (" + "\nUNION ALL ".join(unions) + """),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi, sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS n_p,
               sum(CASE WHEN side = 'q' THEN 1 ELSE 0 END) AS n_q FROM v GROUP BY feature),
b AS (SELECT v.feature, v.side, CASE WHEN r.hi = r.lo THEN 0
             ELSE least(greatest(CAST(floor((v.value - r.lo) / ((r.hi - r.lo) / 20.0)) AS INTEGER), 0), 19) END AS bin
      FROM v JOIN rng r ON v.feature = r.feature),
cnt AS (SELECT feature, bin, sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS c_p,
               sum(CASE WHEN side = 'q' THEN 1 ELSE 0 END) AS c_q FROM b GROUP BY feature, bin),
spine AS (SELECT feature, lo, hi, n_p, n_q, unnest(range(0, 20)) AS bin FROM rng),
h AS (SELECT s.*, coalesce(c.c_p, 0) AS c_p, coalesce(c.c_q, 0) AS c_q
      FROM spine s LEFT JOIN cnt c ON s.feature = c.feature AND s.bin = c.bin),
d AS (SELECT *, c_p / (n_p * ((hi - lo) / 20.0)) + 1e-10 AS dp, c_q / (n_q * ((hi - lo) / 20.0)) + 1e-10 AS dq FROM h),
sums AS (SELECT feature, sum(dp) AS sp, sum(dq) AS sq FROM d GROUP BY feature),
kl AS (SELECT d.feature, CASE WHEN max(d.hi) = max(d.lo) THEN 0.0
              ELSE sum((d.dp / s.sp) * ln((d.dp / s.sp) / (d.dq / s.sq))) END AS kl, max(d.n_p) AS n_p, max(d.n_q) AS n_q
       FROM d JOIN sums s ON d.feature = s.feature GROUP BY d.feature),
per AS (SELECT feature, round(kl, 6) AS kl, round(kl, 6) > 0.1 AS flagged FROM kl WHERE n_p >= 10 AND n_q >= 10)
""" + final


@register("drift_per_feature", _kl_sql("SELECT feature, kl, flagged FROM per"))
def drift_per_feature(spark, sf_dir):
    """K1 + K2 + K3: KL divergence per column, one job for all columns; the shifted column is a planted positive."""
    tr, sv = _sides(spark, sf_dir)
    return D.detect_skew(tr, sv, 0.1, list(COLS))


@register("drift_report", _kl_sql("""SELECT count(*) AS n_features_checked, sum(CAST(flagged AS INTEGER)) AS n_flagged,
       coalesce(max(kl), 0.0) AS max_kl, coalesce(max(CAST(flagged AS INTEGER)), 0) = 1 AS skew_detected,
       CAST(0.1 AS DOUBLE) AS threshold FROM per"""))
def drift_report(spark, sf_dir):
    """K3 summary: features checked, flagged, max KL, skew detected."""
    tr, sv = _sides(spark, sf_dir)
    out = D.skew_report(D.detect_skew(tr, sv, 0.1, list(COLS)), 0.1)
    return rounded(out.withColumn("n_flagged", F.col("n_flagged").cast("bigint")))
