"""Registered streaming queries: each runs a stream to completion over the driver
files (availableNow) and returns the upserted result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans.catalog import register, rounded
from rankloom.plans.q_drift import COLS, CUT
from rankloom.plans.q_telemetry import _LAB
from rankloom.sources import tables as T
from rankloom.streaming import jobs as S


@register("stream_request_rate", _LAB + """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, endpoint, count(*) AS n, round(count(*) / 60.0, 6) AS rate
FROM lab GROUP BY ALL""")
def stream_request_rate(spark, sf_dir):
    """O2 as a stream: watermarked 1-minute windows, update mode, foreachBatch upsert."""
    path = S.run_upsert(S.request_rate_stream(spark, sf_dir), "request_rate")
    out = S.read_upserts(spark, path, ["window_start", "endpoint"])
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz"), "endpoint", "n", "rate"))


@register("stream_user_stats", T.sql_with("ratings") + """
SELECT user_id, round(avg(rating), 6) AS avg_rating, count(*) AS rating_count, max(ts) AS last_ts
FROM ratings GROUP BY user_id""")
def stream_user_stats(spark, sf_dir):
    """O12 + A1: per-user rating statistics maintained by a stateful stream."""
    path = S.run_upsert(S.user_stats_stream(spark, sf_dir), "user_stats")
    out = S.read_upserts(spark, path, ["user_id"])
    return rounded(out.select("user_id", (F.col("rating_sum") / F.col("rating_count")).alias("avg_rating"),
                              "rating_count", "last_ts"))


def _drift_sql() -> str:
    unions_t, unions_s = [], []
    for c in COLS:
        e_t = "l_quantity" if c == "l_quantity_shifted" else c
        e_s = "l_quantity + 25" if c == "l_quantity_shifted" else c
        unions_t.append(f"SELECT '{c}' AS feature, CAST({e_t} AS DOUBLE) AS value FROM lineitem "
                        f"WHERE l_shipdate < TIMESTAMP '{CUT}' AND {e_t} IS NOT NULL")
        unions_s.append(f"SELECT '{c}' AS feature, CAST({e_s} AS DOUBLE) AS value FROM lineitem "
                        f"WHERE l_shipdate >= TIMESTAMP '{CUT}' AND {e_s} IS NOT NULL")
    binx = ("CASE WHEN r.hi = r.lo THEN 0 ELSE least(greatest(CAST(floor((v.value - r.lo) / ((r.hi - r.lo) / 20.0)) "
            "AS INTEGER), 0), 19) END")
    return f"""WITH tv AS ({' UNION ALL '.join(unions_t)}), sv AS ({' UNION ALL '.join(unions_s)}),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM tv GROUP BY feature),
tc AS (SELECT v.feature, {binx} AS bin, count(*) AS c FROM tv v JOIN rng r ON v.feature = r.feature GROUP BY ALL),
sc AS (SELECT v.feature, {binx} AS bin, count(*) AS c FROM sv v JOIN rng r ON v.feature = r.feature GROUP BY ALL),
spine AS (SELECT feature, lo, hi, unnest(range(0, 20)) AS bin FROM rng),
h AS (SELECT s.feature, s.lo, s.hi, s.bin, coalesce(t.c, 0) AS c_p, coalesce(q.c, 0) AS c_q FROM spine s
      LEFT JOIN tc t ON s.feature = t.feature AND s.bin = t.bin LEFT JOIN sc q ON s.feature = q.feature AND s.bin = q.bin),
tot AS (SELECT feature, sum(c_p) AS n_p, sum(c_q) AS n_q FROM h GROUP BY feature),
d AS (SELECT h.*, c_p / (n_p * ((hi - lo) / 20.0)) + 1e-10 AS dp, c_q / (n_q * ((hi - lo) / 20.0)) + 1e-10 AS dq
      FROM h JOIN tot USING (feature)),
sm AS (SELECT feature, sum(dp) AS sp, sum(dq) AS sq FROM d GROUP BY feature)
SELECT d.feature, round(CASE WHEN max(hi) = max(lo) THEN 0.0 ELSE sum((dp / sp) * ln((dp / sp) / (dq / sq))) END, 6) AS kl
FROM d JOIN sm USING (feature) GROUP BY d.feature"""


@register("stream_drift", _drift_sql())
def stream_drift(spark, sf_dir):
    """K4: serving line items streamed and binned on the stored training histogram; KL per feature."""
    li = T.table(spark, sf_dir, "lineitem")
    train = li.filter(F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")).withColumn("l_quantity_shifted", F.col("l_quantity"))
    from rankloom.session import materialize
    hist = materialize(S.training_histogram(train, COLS), "train_hist")
    path = S.run_upsert(S.drift_stream(spark, sf_dir, COLS, CUT, hist), "drift_counts")
    counts = S.read_upserts(spark, path, ["feature", "bin"])
    return rounded(S.kl_from_counts(hist, counts))


STEPS = 4       # micro-batches of the queries below, in time order; the query restarts before each


@register("stream_sessions", T.sql_with("requests") + """,
s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                 OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                               THEN 1 ELSE 0 END AS new_s FROM requests),
g AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM g GROUP BY user_id, sid""")
def stream_sessions(spark, sf_dir):
    """O13 as a stream: sessions kept in state across micro-batches and restarts, emitted when the watermark passes them."""
    ev = T.table(spark, sf_dir, "events")
    steps = [*S.time_steps(ev, "ts", STEPS), S.closing_rows(ev, "ts", user_id=-1, event_type="view")]
    path = S.run_in_steps(lambda folder: S.sessions_stream(spark, folder, ev.schema), steps, "sessions")
    return spark.read.parquet(path).select("user_id", F.col("session_start").cast("timestamp_ntz"), F.col("session_end").cast("timestamp_ntz"),
                                           "n_events")


@register("stream_active_requests", T.sql_with("requests") + """,
ev AS (SELECT floor(epoch_us(ts) / 60000000.0) AS bucket, 1 AS d FROM requests
       UNION ALL SELECT floor((epoch_us(ts) + CAST(trunc(latency_ms * 1000) AS BIGINT)) / 60000000.0), -1 FROM requests),
net AS (SELECT CAST(bucket AS BIGINT) AS bucket, sum(d) AS net FROM ev GROUP BY bucket)
SELECT bucket * 60 AS bucket_start_s, net, sum(net) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS active FROM net""")
def stream_active_requests(spark, sf_dir):
    """O8 as a stream: the in-flight gauge kept as state over closed minutes."""
    ev = T.table(spark, sf_dir, "events")
    steps = [*S.time_steps(ev, "ts", STEPS), S.closing_rows(ev, "ts", user_id=-1, event_type="view", value=0.0)]
    path = S.run_in_steps(lambda folder: S.active_stream(spark, folder, ev.schema), steps, "active")
    return spark.read.parquet(path).select(F.unix_seconds("bucket_start").alias("bucket_start_s"), "net", "active")


def _windowed_drift_sql() -> str:
    sql = _drift_sql()
    serving = sql[sql.index("sv AS ("):sql.index("rng AS (")]
    sql = sql.replace(serving, serving.replace("' AS feature, CAST", "' AS feature, time_bucket(INTERVAL 30 DAYS, l_shipdate, TIMESTAMP '1970-01-01') AS w, CAST"))
    head, tail = sql.split("sc AS (SELECT v.feature", 1)
    return head + "sc AS (SELECT v.w, v.feature" + tail \
        .replace("spine AS (SELECT feature, lo, hi, unnest(range(0, 20)) AS bin FROM rng)",
                 "spine AS (SELECT w, feature, lo, hi, unnest(range(0, 20)) AS bin FROM rng JOIN (SELECT DISTINCT w, feature FROM sc) USING (feature))") \
        .replace("h AS (SELECT s.feature", "h AS (SELECT s.w, s.feature") \
        .replace("q ON s.feature = q.feature AND", "q ON s.w = q.w AND s.feature = q.feature AND") \
        .replace("tot AS (SELECT feature, ", "tot AS (SELECT w, feature, ").replace("FROM h GROUP BY feature", "FROM h GROUP BY w, feature") \
        .replace("FROM h JOIN tot USING (feature)", "FROM h JOIN tot USING (w, feature)") \
        .replace("sm AS (SELECT feature, ", "sm AS (SELECT w, feature, ").replace("FROM d GROUP BY feature", "FROM d GROUP BY w, feature") \
        .replace("SELECT d.feature, round", "SELECT d.w AS window_start, d.feature, CAST(sum(c_q) AS BIGINT) AS n_serving, round") \
        .replace("FROM d JOIN sm USING (feature) GROUP BY d.feature", "FROM d JOIN sm USING (w, feature) GROUP BY d.w, d.feature")


@register("stream_windowed_drift", _windowed_drift_sql())
def stream_windowed_drift(spark, sf_dir):
    """K4: drift per 30-day window and feature, windows closed by the watermark over several micro-batches."""
    from rankloom.session import materialize
    li, cut = T.table(spark, sf_dir, "lineitem"), F.lit(CUT).cast("timestamp_ntz")
    train = li.filter(F.col("l_shipdate") < cut).withColumn("l_quantity_shifted", F.col("l_quantity"))
    hist = materialize(S.training_histogram(train, COLS), "train_hist")
    serve = li.filter(F.col("l_shipdate") >= cut).withColumn("l_quantity_shifted", F.col("l_quantity") + 25).select("l_shipdate", *COLS)
    steps = [*S.time_steps(serve, "l_shipdate", STEPS), S.closing_rows(serve, "l_shipdate", days=400)]
    path = S.run_in_steps(lambda folder: S.windowed_drift_stream(spark, folder, serve.schema, COLS, "l_shipdate", hist), steps, "windowed_drift")
    out = S.kl_by_window(hist, spark.read.parquet(path))
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz"), "feature", "n_serving", "kl"))
