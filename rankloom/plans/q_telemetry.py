"""Registered telemetry queries over the request-log view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import telemetry as TM
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T

_LAB = T.sql_with("requests") + """,
lab AS (SELECT *, CASE WHEN starts_with(path, '/recommend') THEN '/recommend' WHEN starts_with(path, '/health') THEN '/health'
                       WHEN starts_with(path, '/metrics') THEN '/metrics' WHEN starts_with(path, '/model') THEN '/model/info'
                       ELSE path END AS endpoint,
               CASE WHEN path = '/recommend' THEN 'POST' ELSE 'GET' END AS method FROM requests)
"""


def _req(spark, sf_dir):
    return T.requests(spark, sf_dir)


def _hq_sql(phi: float, edges) -> str:
    parts = []
    for i, e in enumerate(edges):
        lo = 0.0 if i == 0 else float(edges[i - 1])
        prev = "0" if i == 0 else f"le_{i - 1}"
        parts.append(f"WHEN le_{i} >= {phi!r} * le_inf THEN {lo!r} + ({float(e)!r} - {lo!r}) * ({phi!r} * le_inf - {prev}) / (le_{i} - {prev})")
    return f"CASE WHEN le_inf > 0 THEN CASE {' '.join(parts)} ELSE {float(edges[-1])!r} END END"


def _hist_sql(value: str, edges, keys: str) -> str:
    b = ", ".join(f"sum(CASE WHEN {value} <= {float(e)!r} THEN 1 ELSE 0 END) AS le_{i}" for i, e in enumerate(edges))
    return f"SELECT {keys}, {b}, count(*) AS le_inf, sum({value}) AS sum, count(*) AS count FROM lab GROUP BY ALL"


@register("request_validation", T.sql_with("requests") + """
SELECT request_id, coalesce(k, 20) AS k_eff, true AS use_cache,
       CASE WHEN user_id IS NULL OR user_id <= 0 THEN 'user_id must be > 0'
            WHEN coalesce(k, 20) < 1 OR coalesce(k, 20) > 100 THEN 'k must be in [1, 100]' END AS reject_reason
FROM requests""")
def request_validation(spark, sf_dir):
    """request defaults and bounds; rejected rows carry a reason."""
    return TM.validate_requests(_req(spark, sf_dir)).select("request_id", "k_eff", "use_cache", "reject_reason")


@register("request_counters", _LAB + "SELECT method, endpoint, status_code, count(*) AS n FROM lab GROUP BY ALL")
def request_counters(spark, sf_dir):
    """A15 + F20: request totals per (method, endpoint, status)."""
    return TM.request_counters(_req(spark, sf_dir))


@register("request_latency_histogram", _LAB + _hist_sql("latency_ms / 1000.0", TM.REQUEST_LATENCY_SECONDS_EDGES,
                                                       "method, endpoint, status_code").replace(
    "sum(latency_ms / 1000.0) AS sum", "round(sum(latency_ms / 1000.0), 6) AS sum"))
def request_latency_histogram(spark, sf_dir):
    """Cumulative request-latency buckets (seconds) per (method, endpoint, status)."""
    d = TM.labelled(_req(spark, sf_dir))
    return rounded(TM.cumulative_histogram(d, F.col("latency_ms") / 1000.0, TM.REQUEST_LATENCY_SECONDS_EDGES,
                                           ["method", "endpoint", "status_code"]))


@register("total_requests", "SELECT count(*) AS total_requests FROM events")
def total_requests(spark, sf_dir):
    """O1."""
    return _req(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_requests"))


@register("request_rate", _LAB + """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, endpoint, count(*) AS n, round(count(*) / 60.0, 6) AS rate
FROM lab GROUP BY ALL""")
def request_rate(spark, sf_dir):
    """O2: requests per second over 1-minute windows by endpoint."""
    return rounded(TM.request_rate(_req(spark, sf_dir)))


@register("request_rate_total", _LAB + """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS n, round(count(*) / 60.0, 6) AS rate
FROM lab GROUP BY ALL""")
def request_rate_total(spark, sf_dir):
    """O2 total: requests per second over 1-minute windows."""
    return rounded(TM.request_rate(_req(spark, sf_dir), by_endpoint=False))


@register("cache_ratio", _LAB + """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, sum(CAST(cache_hit AS INTEGER)) AS hits,
       count(*) - sum(CAST(cache_hit AS INTEGER)) AS misses,
       round(sum(CAST(cache_hit AS INTEGER)) / 60.0, 6) AS hit_rate,
       round((count(*) - sum(CAST(cache_hit AS INTEGER))) / 60.0, 6) AS miss_rate,
       round(sum(CAST(cache_hit AS INTEGER)) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS hit_ratio
FROM lab WHERE endpoint = '/recommend' GROUP BY ALL""")
def cache_ratio(spark, sf_dir):
    """O3: cache hit / miss rates and ratio per minute."""
    out = TM.cache_ratio(_req(spark, sf_dir))
    return rounded(out.withColumn("hits", F.col("hits").cast("bigint")).withColumn("misses", F.col("misses").cast("bigint")))


@register("latency_quantiles", _LAB + """,
h AS (""" + _hist_sql("latency_ms", TM.RECOMMENDATION_LATENCY_MS_EDGES,
                      "time_bucket(INTERVAL '5 minutes', ts) AS window_start, endpoint") + """),
q AS (SELECT window_start, endpoint, count, """ + ", ".join(
    f"{_hq_sql(p, TM.RECOMMENDATION_LATENCY_MS_EDGES)} AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + """ FROM h)
SELECT window_start, endpoint, count, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99,
       CASE WHEN p99 < 100.0 THEN 'green' WHEN p99 < 500.0 THEN 'yellow' ELSE 'red' END AS state FROM q""")
def latency_quantiles(spark, sf_dir):
    """O4 + O6 + O11: histogram-interpolated p50/p95/p99 per 5-minute window and endpoint, with panel state."""
    return rounded(TM.latency_quantiles(_req(spark, sf_dir)))


@register("exact_latency_percentiles", _LAB + """
SELECT endpoint, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99, count(*) AS n FROM lab GROUP BY endpoint""")
def exact_latency_percentiles(spark, sf_dir):
    """Exact latency percentiles by endpoint."""
    return rounded(TM.exact_latency_percentiles(_req(spark, sf_dir)))


@register("error_rate", T.sql_with("requests") + """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, status_code, round(count(*) / 60.0, 6) AS error_rate, count(*) AS n
FROM requests WHERE status_code >= 500 GROUP BY ALL""")
def error_rate(spark, sf_dir):
    """Errors per second per minute."""
    return rounded(TM.error_rate(_req(spark, sf_dir)))


@register("active_requests", T.sql_with("requests") + """,
ev AS (SELECT floor(epoch_us(ts) / 60000000.0) AS bucket, 1 AS d FROM requests
       UNION ALL SELECT floor((epoch_us(ts) + CAST(trunc(latency_ms * 1000) AS BIGINT)) / 60000000.0), -1 FROM requests),
net AS (SELECT CAST(bucket AS BIGINT) AS bucket, sum(d) AS net FROM ev GROUP BY bucket)
SELECT bucket * 60 AS bucket_start_s, net, sum(net) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS active FROM net""")
def active_requests(spark, sf_dir):
    """In-flight requests at the end of each minute."""
    out = TM.active_requests(_req(spark, sf_dir))
    return out.select(F.col("bucket_start_s").cast("bigint"), F.col("net").cast("bigint"),
                      F.col("active").cast("bigint"))


@register("last_gauge", T.sql_with("requests") + """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, arg_max(k, (ts, request_id)) AS last_value
FROM requests GROUP BY 1""")
def last_gauge(spark, sf_dir):
    """Last requested list size per minute."""
    return TM.last_gauge(_req(spark, sf_dir))


@register("user_sessions", T.sql_with("requests") + """,
s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                 OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                               THEN 1 ELSE 0 END AS new_s FROM requests),
g AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events,
       min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY user_id, sid""")
def user_sessions(spark, sf_dir):
    """Per-user activity sessions with a 30-minute gap."""
    return TM.sessions(_req(spark, sf_dir))


@register("recent_latency", _LAB + """
SELECT endpoint, round(coalesce(quantile_cont(latency_ms, 0.5), 0.0), 2) AS p50,
       round(coalesce(quantile_cont(latency_ms, 0.99), 0.0), 2) AS p99, count(*) AS n_samples
FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, request_id DESC) AS r FROM lab) WHERE r <= 1000
GROUP BY endpoint""")
def recent_latency(spark, sf_dir):
    """W9 + V9: p50 / p99 over the latest 1000 requests per endpoint."""
    return TM.recent_latency(_req(spark, sf_dir))


@register("cache_stats", _LAB + """
SELECT count(*) AS total_requests, coalesce(sum(CAST(cache_hit AS INTEGER)), 0) AS cache_hits,
       count(*) - coalesce(sum(CAST(cache_hit AS INTEGER)), 0) AS cache_misses,
       round(coalesce(sum(CAST(cache_hit AS INTEGER)), 0) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS cache_hit_rate
FROM lab WHERE endpoint = '/recommend'""")
def cache_stats(spark, sf_dir):
    """V8: cache hit statistics of recommendation requests."""
    out = TM.cache_stats(_req(spark, sf_dir))
    return rounded(out.select("total_requests", F.col("cache_hits").cast("bigint"),
                              F.col("cache_misses").cast("bigint"), "cache_hit_rate"))


@register("rolling_latency", _LAB + """
SELECT request_id, endpoint, ts,
       round(quantile_cont(latency_ms, 0.5) OVER w, 6) AS p50, round(quantile_cont(latency_ms, 0.99) OVER w, 6) AS p99
FROM lab WINDOW w AS (PARTITION BY endpoint ORDER BY ts, request_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark, sf_dir):
    """W9 history: per-request rolling p50 / p99 over the endpoint's last 1000 samples
    (timelines cut into 2500-row pieces with a 999-row halo; the result is piece-size independent)."""
    return rounded(TM.rolling_latency(_req(spark, sf_dir), chunk=2500))
