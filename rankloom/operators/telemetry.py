"""Service telemetry over a request log.

Request log schema: ``(request_id, ts, user_id, path, status_code, latency_ms,
k, cache_hit)``. Counters and histograms are grouped aggregates keyed by
labels and event-time windows, so the same code runs on a static log or a
stream (see ``rankloom.streaming``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Histogram bucket upper edges of the four latency histograms.
REQUEST_LATENCY_SECONDS_EDGES = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0)
RECOMMENDATION_LATENCY_MS_EDGES = (5, 10, 25, 50, 75, 100, 200, 500, 1000, 2000, 5000)
RETRIEVAL_LATENCY_MS_EDGES = (1, 2, 5, 10, 20, 50, 100, 200)
RANKING_LATENCY_MS_EDGES = (1, 2, 5, 10, 20, 50, 100, 200)

# Stat-panel thresholds in ms (green below 100, yellow below 500, red above).
GREEN_BELOW_MS, YELLOW_BELOW_MS = 100.0, 500.0


def endpoint_label(path) -> Column:
    """collapse path parameters into a bounded label set."""
    p = F.col(path) if isinstance(path, str) else path
    return (F.when(p.startswith("/recommend"), "/recommend").when(p.startswith("/health"), "/health")
            .when(p.startswith("/metrics"), "/metrics").when(p.startswith("/model"), "/model/info")
            .otherwise(p))


def http_method(path) -> Column:
    """POST for the request-body endpoint, GET for every other route."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p == "/recommend", "POST").otherwise("GET")


def labelled(requests: DataFrame) -> DataFrame:
    return requests.withColumn("endpoint", endpoint_label("path")).withColumn("method", http_method("path"))


def validate_requests(requests: DataFrame, default_k: int = 20) -> DataFrame:
    """defaults (k = 20, use_cache = true) and bounds (user_id > 0, 1 <= k <= 100).

    Adds ``k_eff``, ``use_cache`` and ``reject_reason`` (null when accepted).
    """
    k = F.coalesce(F.col("k"), F.lit(default_k))
    reason = (F.when(F.col("user_id").isNull() | (F.col("user_id") <= 0), "user_id must be > 0")
              .when((k < 1) | (k > 100), "k must be in [1, 100]"))
    use_cache = F.coalesce(F.col("use_cache"), F.lit(True)) if "use_cache" in requests.columns else F.lit(True)
    return requests.withColumn("k_eff", k).withColumn("use_cache", use_cache).withColumn("reject_reason", reason)


def request_counters(requests: DataFrame) -> DataFrame:
    """Request totals per ``(method, endpoint, status_code)``."""
    return labelled(requests).groupBy("method", "endpoint", "status_code").agg(F.count(F.lit(1)).alias("n"))


def cumulative_histogram(df: DataFrame, value: Column, edges, keys=()) -> DataFrame:
    """Prometheus-style cumulative buckets ``le_<edge>`` and ``le_inf`` plus sum and count."""
    aggs = [F.sum(F.when(value <= F.lit(float(e)), 1).otherwise(0)).alias(f"le_{i}") for i, e in enumerate(edges)]
    aggs += [F.count(F.lit(1)).alias("le_inf"), F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count")]
    return df.groupBy(*keys).agg(*aggs)


def histogram_quantile(phi: float, edges, bucket_prefix: str = "le_") -> Column:
    """O4 on a row of cumulative buckets: linear interpolation inside the first bucket
    whose cumulative count reaches ``phi x total``; the first bucket starts at 0;
    a rank in the ``+Inf`` bucket returns the last finite edge. Empty -> null."""
    total = F.col(f"{bucket_prefix}inf")
    rank = F.lit(phi) * total
    expr = F.lit(float(edges[-1]))
    for i in reversed(range(len(edges))):
        lo = 0.0 if i == 0 else float(edges[i - 1])
        prev = F.lit(0) if i == 0 else F.col(f"{bucket_prefix}{i - 1}")
        cur = F.col(f"{bucket_prefix}{i}")
        val = F.lit(lo) + (F.lit(float(edges[i])) - F.lit(lo)) * (rank - prev) / (cur - prev)
        expr = F.when(cur >= rank, val).otherwise(expr)
    return F.when(total > 0, expr)


def windowed(df: DataFrame, duration: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    return df.withColumn("window", w)


def request_rate(requests: DataFrame, duration: str = "1 minute", seconds: float = 60.0,
                 by_endpoint: bool = True) -> DataFrame:
    """O1/O2: requests per second in tumbling windows (total or by endpoint)."""
    keys = [F.col("window.start").alias("window_start")] + ([F.col("endpoint")] if by_endpoint else [])
    d = windowed(labelled(requests), duration)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / seconds).alias("rate"))


def cache_ratio(requests: DataFrame, duration: str = "1 minute", seconds: float = 60.0) -> DataFrame:
    """O3: hit/miss rates and hit ratio of recommendation requests per window."""
    d = windowed(labelled(requests).filter(F.col("endpoint") == "/recommend"), duration)
    hits = F.sum(F.col("cache_hit").cast("int"))
    g = d.groupBy(F.col("window.start").alias("window_start")).agg(
        hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"))
    return g.withColumn("hit_rate", F.col("hits") / seconds).withColumn("miss_rate", F.col("misses") / seconds) \
        .withColumn("hit_ratio", F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)))


def latency_quantiles(requests: DataFrame, duration: str = "5 minutes", phis=(0.5, 0.95, 0.99)) -> DataFrame:
    """O4 + O11: bucket-interpolated latency quantiles (ms) per window and endpoint,
    with the stat-panel colour of the p99."""
    d = windowed(labelled(requests), duration)
    h = cumulative_histogram(d, F.col("latency_ms"), RECOMMENDATION_LATENCY_MS_EDGES,
                             [F.col("window.start").alias("window_start"), "endpoint"])
    out = h.select("window_start", "endpoint", "count",
                   *[histogram_quantile(p, RECOMMENDATION_LATENCY_MS_EDGES).alias(f"p{int(p * 100)}") for p in phis])
    p = F.col(f"p{int(phis[-1] * 100)}")
    return out.withColumn("state", F.when(p < GREEN_BELOW_MS, "green").when(p < YELLOW_BELOW_MS, "yellow")
                          .otherwise("red"))


def exact_latency_percentiles(requests: DataFrame, phis=(0.5, 0.95, 0.99), value: str = "latency_ms",
                              part: str = "endpoint") -> DataFrame:
    """Exact percentiles (linear interpolation) per endpoint.

    Rows get dense positions in ``(endpoint, value)`` order, so an endpoint with a
    large share of all requests spans many tasks; only the two rows around each
    percentile are then looked up by position. Null values are passed over."""
    from rankloom.operators.indexing import global_index
    d = labelled(requests).filter(F.col(value).isNotNull()).select(part, value, "request_id")
    g = global_index(d, [part, value, "request_id"], "_g")
    stats = g.groupBy(part).agg(F.min("_g").alias("_s"), F.count(F.lit(1)).alias("n"))
    want = stats.select(part, "n", "_s", F.explode(F.array(
        *[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(phis)])).alias("w"))
    want = want.select(part, "n", F.col("w.i").alias("i"), (F.col("w.at") - F.floor("w.at")).alias("frac"), F.explode(F.array(
        *[F.struct(F.lit(k).alias("hi"), (F.col("_s") + f(F.col("w.at"))).cast("long").alias("_g"))
          for k, f in enumerate((F.floor, F.ceil))])).alias("p")).select(part, "n", "i", "frac", "p.hi", "p._g")
    got = want.join(g.select("_g", F.col(value).alias("_v")), "_g")

    def pick(i, hi):
        return F.max(F.when((F.col("i") == i) & (F.col("hi") == hi), F.col("_v")))
    out = got.groupBy(part).agg(F.max("n").alias("n"), *[x for i in range(len(phis)) for x in (
        pick(i, 0).alias(f"_l{i}"), pick(i, 1).alias(f"_h{i}"), F.max(F.when(F.col("i") == i, F.col("frac"))).alias(f"_f{i}"))])
    return out.select(part, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"p{int(p * 100)}")
                              for i, p in enumerate(phis)], "n")


def error_rate(requests: DataFrame, duration: str = "1 minute", seconds: float = 60.0) -> DataFrame:
    """Server errors per second per window and status."""
    d = windowed(requests.filter(F.col("status_code") >= 500), duration)
    return d.groupBy(F.col("window.start").alias("window_start"), "status_code").agg(
        (F.count(F.lit(1)) / seconds).alias("error_rate"), F.count(F.lit(1)).alias("n"))


def active_requests(requests: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """In-flight requests at the end of each time bucket.

    +1 at start, -1 at ``ts + latency`` (decremented once -- the reference's
    double decrement on errors is fixed). Net change per bucket is a grouped
    aggregate; the running sum runs over the small bucket frame only.
    """
    from rankloom.functions.scalars import epoch_micros
    start = epoch_micros(F.col("ts"))
    end = start + (F.col("latency_ms") * 1000).cast("long")
    b = F.lit(bucket_seconds * 1_000_000)
    ev = requests.select(F.explode(F.array(
        F.struct(F.floor(start / b).alias("bucket"), F.lit(1).alias("d")),
        F.struct(F.floor(end / b).alias("bucket"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    net = ev.groupBy("bucket").agg(F.sum("d").alias("net"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    return net.select((F.col("bucket") * bucket_seconds).alias("bucket_start_s"), "net",
                      F.sum("net").over(w).alias("active"))


def last_gauge(requests: DataFrame, value: str = "k", duration: str = "1 minute") -> DataFrame:
    """Last value of a gauge per window (latest event wins; ties by request id)."""
    d = windowed(requests, duration)
    return d.groupBy(F.col("window.start").alias("window_start")).agg(
        F.max_by(value, F.struct("ts", "request_id")).alias("last_value"))


def sessions(requests: DataFrame, gap_minutes: int = 30, chunk: int = 50_000) -> DataFrame:
    """Activity sessions per user; an event starts a new session when it comes
    ``gap`` or more after the previous one (``session_window`` semantics:
    end = last event + gap).

    Gaps and islands on global positions, so a user with a large share of all
    events spans many tasks: each user's timeline is cut into ``chunk``-row pieces,
    the previous event comes from a one-row halo of the piece before, and session
    numbers are piece-local running sums plus per-piece offsets (one row per piece).
    """
    from rankloom.operators.indexing import global_index
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    g = global_index(requests.select("user_id", "ts", "request_id"), ["user_id", "ts", "request_id"], "_g")
    start = g.groupBy("user_id").agg(F.min("_g").alias("_s"))
    x = g.join(start, "user_id").withColumn("_p", F.col("_g") - F.col("_s")) \
        .withColumn("_c", F.floor(F.col("_p") / chunk))
    halo = x.filter(F.col("_p") % chunk == chunk - 1).select(
        "user_id", (F.col("_c") + 1).alias("_c"), F.col("ts").alias("_halo_ts"))
    w = Window.partitionBy("user_id", "_c").orderBy("_p")
    x = x.withColumn("_prev", F.lag("ts").over(w)).join(halo, ["user_id", "_c"], "left") \
        .withColumn("_prev", F.coalesce("_prev", "_halo_ts"))
    x = x.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("ts") >= F.col("_prev") + gap), 1).otherwise(0))
    x = x.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tot = x.groupBy("user_id", "_c").agg(F.sum("_new").alias("_t"))
    wc = Window.partitionBy("user_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_o", F.coalesce(F.sum("_t").over(wc), F.lit(0))).select("user_id", "_c", "_o")
    x = x.join(off, ["user_id", "_c"]).withColumn("_sid", F.col("_o") + F.col("_local"))
    g2 = x.groupBy("user_id", "_sid").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts"))
    return g2.select("user_id", F.col("first_ts").alias("session_start"), (F.col("last_ts") + gap).alias("session_end"),
                     "n_events", "first_ts", "last_ts")


def sessions_windowed(requests: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """O13 with the built-in ``session_window`` (used by the streaming form)."""
    g = requests.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events", "first_ts", "last_ts")


def recent_latency(requests: DataFrame, value: str = "latency_ms", window: int = 1000,
                   part: str = "endpoint", bucket_seconds: int = 60) -> DataFrame:
    """p50 and p99 over the latest ``window`` samples per endpoint, rounded
    to 2 places (0.0 when empty).

    Counts per endpoint and time bucket tell from which bucket on the latest
    ``window`` rows lie; only rows from there are ranked, whatever the number of
    map tasks."""
    from rankloom.functions.scalars import epoch_micros, round_binary
    d = labelled(requests).withColumn("_b", F.floor(epoch_micros(F.col("ts")) / F.lit(bucket_seconds * 1_000_000)).cast("long"))
    counts = d.groupBy(part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy(part).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    cut = counts.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).filter(F.col("_before") < window) \
        .groupBy(part).agg(F.min("_b").alias("_from")).withColumnRenamed(part, "_part")
    d = d.join(cut, d[part].eqNullSafe(F.col("_part"))).filter(F.col("_b").isNull() | (F.col("_b") >= F.col("_from")))
    w = Window.partitionBy(part).orderBy(F.desc("ts"), F.desc("request_id"))
    last = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window)
    return last.groupBy(part).agg(
        round_binary(F.coalesce(F.percentile(value, 0.5), F.lit(0.0)), 2).alias("p50"),
        round_binary(F.coalesce(F.percentile(value, 0.99), F.lit(0.0)), 2).alias("p99"),
        F.count(F.lit(1)).alias("n_samples"))


def cache_stats(requests: DataFrame) -> DataFrame:
    """V8: totals, hits, misses and hit rate with ``max(total, 1)``."""
    r = labelled(requests).filter(F.col("endpoint") == "/recommend")
    hits = F.sum(F.col("cache_hit").cast("int"))
    return r.agg(F.count(F.lit(1)).alias("total_requests"), F.coalesce(hits, F.lit(0)).alias("cache_hits")) \
        .withColumn("cache_misses", F.col("total_requests") - F.col("cache_hits")) \
        .withColumn("cache_hit_rate", F.col("cache_hits") / F.greatest(F.col("total_requests"), F.lit(1)))


def rolling_latency(requests: DataFrame, value: str = "latency_ms", window: int = 1000,
                    chunk: int = 50_000, part: str = "endpoint") -> DataFrame:
    """W9 history: for every request, p50 / p99 (linear interpolation, unrounded) of the
    latest ``window`` samples of its endpoint up to and including it.

    A plain ``OVER (PARTITION BY endpoint ...)`` would put a whole endpoint -- a
    handful of labels, one of which may carry most traffic -- into one task.
    Instead each endpoint's timeline is cut into ``chunk``-row pieces (positions
    from ``global_index``), every piece also receives the last ``window - 1`` rows
    of the piece before it as a halo, and the sliding frame runs per piece.
    The result does not depend on ``chunk`` (>= ``window``).
    """
    from rankloom.operators.indexing import global_index
    if chunk < window:
        raise ValueError("chunk must be at least the window length")
    d = labelled(requests).select(part, "ts", "request_id", value)
    g = global_index(d, [part, "ts", "request_id"], "_g")
    starts = g.groupBy(part).agg(F.min("_g").alias("_s"))           # one row per value of part
    x = g.join(starts, part).withColumn("_p", F.col("_g") - F.col("_s")) \
        .withColumn("_c", F.floor(F.col("_p") / chunk))
    own = x.withColumn("_halo", F.lit(False))
    halo = x.filter(F.col("_p") % chunk >= chunk - (window - 1)) \
        .withColumn("_c", F.col("_c") + 1).withColumn("_halo", F.lit(True))
    piece = own.unionByName(halo).select("request_id", part, "ts", F.col(value).cast("double").alias("_v"), "_p", "_c", "_halo")
    schema = StructType([piece.schema[c] for c in ("request_id", part, "ts")]).add("p50", "double").add("p99", "double")

    def run(table: pa.Table) -> pa.Table:
        t = table.take(pa.array(np.argsort(table.column("_p").to_numpy(), kind="stable")))
        p = rolling_percentiles(t.column("_v"), window, (0.5, 0.99))
        return t.select(["request_id", part, "ts"]).append_column("p50", p[0]).append_column("p99", p[1]).filter(pc.invert(t.column("_halo")))
    return piece.groupBy(part, "_c").applyInArrow(run, schema)


def rolling_percentiles(column: pa.ChunkedArray, window: int, shares: tuple) -> list[pa.Array]:
    """Percentiles of the latest ``window`` rows up to each row, by linear interpolation as in
    ``F.percentile``: nulls do not count, NaN is above all numbers. The window is kept
    sorted while it slides (by the values' order numbers), so a row costs log(window)."""
    null = column.is_null().to_numpy()
    values, code = np.unique(column.fill_null(0.0).to_numpy(), return_inverse=True)
    codes = pd.Series(np.where(null, np.nan, code.astype(np.float64)))
    seen = np.append(0, np.cumsum(~null))
    n = seen[1:] - seen[np.maximum(np.arange(1, len(null) + 1) - window, 0)]
    out = []
    for share in shares:
        place = np.maximum(n - 1, 0) * share
        lo, hi = (values[codes.rolling(window, min_periods=1).quantile(share, interpolation=i).fillna(0).to_numpy().astype(np.int64)]
                  for i in ("lower", "higher"))
        whole = np.floor(place) == np.ceil(place)
        with np.errstate(invalid="ignore"):
            mixed = (np.ceil(place) - place) * lo + (place - np.floor(place)) * hi
        out.append(pa.array(np.where(whole | (lo == hi), lo, mixed), mask=n == 0))
    return out
