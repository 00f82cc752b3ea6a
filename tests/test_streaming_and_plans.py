"""Streaming late data, telemetry helpers, plan shapes and the driver contract."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.operators import telemetry as TM
from rankloom.streaming import jobs


def test_late_row_dropped_by_watermark(spark):
    d = tempfile.mkdtemp(prefix="rl-stream-")
    schema = "ts timestamp, endpoint string"
    spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 10), "/a"), (datetime(2024, 1, 1, 1, 0, 0), "/a")],
                          schema).write.parquet(os.path.join(d, "data", "b1"))
    src = spark.readStream.schema(schema).parquet(os.path.join(d, "data", "*"))
    agg = src.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute").alias("w")).count()
    q = agg.writeStream.outputMode("append").format("memory").queryName("late_test") \
        .option("checkpointLocation", os.path.join(d, "_ck")).start()
    q.processAllAvailable()
    spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 20), "/a"), (datetime(2024, 1, 1, 2, 0, 0), "/a")],
                          schema).write.parquet(os.path.join(d, "data", "b2"))
    q.processAllAvailable()
    q.stop()
    got = {r["w"]["start"]: r["count"] for r in spark.table("late_test").collect()}
    assert got[datetime(2024, 1, 1, 0, 0)] == 1   # the 00:00:20 row arrived after the watermark passed


def test_histogram_quantile_interpolates(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 3.0, 6.0, 8.0]], "v double")
    h = TM.cumulative_histogram(df, F.col("v"), (5, 10))
    r = h.select(TM.histogram_quantile(0.5, (5, 10)).alias("q")).first()
    assert r["q"] == pytest.approx(5.0)   # rank 2 reaches the top of bucket [0, 5]


def test_endpoint_labels(spark):
    df = spark.createDataFrame([("/recommend/7",), ("/health",), ("/model/info",), ("/other",)], "p string")
    assert [r[0] for r in df.select(TM.endpoint_label("p")).collect()] == ["/recommend", "/health", "/model/info", "/other"]


def test_request_validation(spark):
    df = spark.createDataFrame([(0, 5), (3, 0), (3, None), (3, 101)], "user_id long, k int")
    out = TM.validate_requests(df).collect()
    assert out[0]["reject_reason"] and out[1]["reject_reason"] and out[3]["reject_reason"]
    assert out[2]["reject_reason"] is None and out[2]["k_eff"] == 20


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_and_pushdown(spark, sf):
    import __spark_entry__ as E
    plan = _plan(E.queries()["recommend_batch"](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    li = spark.read.parquet(os.path.join(sf, "lineitem.parquet")).filter(F.col("l_quantity") > 10).select("l_quantity")
    p = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80


def test_rolling_latency_independent_of_chunk(spark, sf):
    from rankloom.sources import tables as T
    req = T.requests(spark, sf)
    a = TM.rolling_latency(req, window=50, chunk=50).select("request_id", "p50", "p99")
    b = TM.rolling_latency(req, window=50, chunk=100000).select("request_id", "p50", "p99")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sessions_chunked_equal_session_window(spark, sf):
    from rankloom.sources import tables as T
    req = T.requests(spark, sf)
    a = TM.sessions(req, 30, chunk=3)
    b = TM.sessions_windowed(req, "30 minutes")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, rows):
    """Events of ``(id, minute, user, seconds of latency)``."""
    from datetime import datetime, timedelta
    return spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=m), u, "view", s * 1000.0, None) for i, m, u, s in rows], EVENTS)


def test_session_state_spans_batches_and_late_rows_go(spark):
    """One session over three batches with a restart before each; an event behind the
    watermark is dropped; a session is out only when the watermark has passed it."""
    steps = [_events(spark, [(1, 0, 7, 1), (2, 20, 7, 1)]), _events(spark, [(3, 45, 7, 1), (4, 200, 8, 1)]),
             _events(spark, [(5, 60, 7, 1), (6, 210, 7, 1)]), _events(spark, [(7, 2000, 9, 1)])]
    path = jobs.run_in_steps(lambda f: jobs.sessions_stream(spark, f, steps[0].schema), steps, "sessions_test")
    got = {(r.user_id, r.n_events, r.session_start.hour * 60 + r.session_start.minute, r._batch) for r in spark.read.parquet(path).collect()}
    assert {g[:3] for g in got} == {(7, 3, 0), (8, 1, 200), (7, 1, 210)}       # event 5 came 140 minutes late
    assert len({g[3] for g in got}) > 1


def test_gauge_state_spans_batches(spark):
    rows = [(i, i * 2, 1, 600 if i % 3 else 5) for i in range(40)]
    ev = _events(spark, rows)
    steps = [*jobs.time_steps(ev, "ts", 3), jobs.closing_rows(ev, "ts", value=0.0)]
    assert sum(s.count() for s in steps[:3]) == 40 and all(s.count() for s in steps)
    path = jobs.run_in_steps(lambda f: jobs.active_stream(spark, f, ev.schema), steps, "gauge_test")
    got = {r.bucket_start: (r.net, r.active) for r in spark.read.parquet(path).collect()}
    change = {}
    for _, m, _, s in rows:
        for at, d in ((m, 1), (m + s // 60, -1)):
            change[at] = change.get(at, 0) + d
    total, expect = 0, {}
    for at in sorted(change):
        total += change[at]
        expect[at] = (change[at], total)
    assert {(k.hour * 60 + k.minute): v for k, v in got.items()} == expect


def test_time_steps_keep_every_row(spark):
    ev = _events(spark, [(i, i % 5, 1, 1) for i in range(50)]).unionByName(_events(spark, []))
    ev = ev.unionByName(spark.createDataFrame([(99, None, 1, "view", 1.0, None)], EVENTS))
    assert sorted(r.event_id for s in jobs.time_steps(ev, "ts", 4) for r in s.collect()) == [*range(50), 99]


def test_rolling_latency_equals_percentile_windows(spark):
    """With nulls, NaN, infinities and repeated values; no window function sorts each frame anew."""
    from datetime import datetime, timedelta

    from pyspark.sql import Window
    odd = [None, float("nan"), float("inf"), 5.0, -0.0]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i // 3), i % 2 and "/recommend" or "/health", 200,
             odd[i % 11] if i % 11 < 5 else float((i * 37) % 50) / 7) for i in range(400)]
    rows += [(i, datetime(2023, 1, 1) + timedelta(seconds=i), "/recommend", 200, None) for i in range(400, 420)]
    req = spark.createDataFrame(rows, "request_id long, ts timestamp, path string, status_code int, latency_ms double") \
        .withColumn("user_id", F.lit(1).cast("long")).withColumn("k", F.lit(5)).withColumn("cache_hit", F.lit(False))
    got = TM.rolling_latency(req, window=20, chunk=30)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    w = Window.partitionBy("endpoint").orderBy("ts", "request_id").rowsBetween(-19, 0)
    want = TM.labelled(req).select("request_id", "endpoint", "ts", F.percentile("latency_ms", 0.5).over(w).alias("p50"),
                                   F.percentile("latency_ms", 0.99).over(w).alias("p99"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_session_state_is_not_counted(spark):
    """Each write to a counted store looks its key up first; the stream's result and the session's settings stay."""
    from datetime import timedelta
    ev = _events(spark, [(i, 7 * i, i % 3, 1) for i in range(60)])
    steps = [*jobs.time_steps(ev, "ts", 3), jobs.closing_rows(ev, "ts", user_id=-1, event_type="view")]
    before = {k: spark.conf.get(k, None) for k in jobs.STATE_CONF}
    path = jobs.run_in_steps(lambda folder: jobs.sessions_stream(spark, folder, ev.schema), steps, "uncounted")
    assert {k: spark.conf.get(k, None) for k in jobs.STATE_CONF} == before
    got = {(r.user_id, r.session_start, r.session_end - timedelta(minutes=30), r.n_events) for r in spark.read.parquet(path).collect()}
    want = {(u, *(datetime(2024, 1, 1) + timedelta(minutes=7 * i) for i in (u, u + 57)), 20) for u in range(3)}
    assert got == want
