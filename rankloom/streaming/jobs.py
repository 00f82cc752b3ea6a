"""Streaming jobs (O2/O3 windows, O8 gauge, O13 sessions, O12 live feature refresh, K4 streaming drift).

Sources are file streams over the driver's Parquet folders; sinks are
``foreachBatch`` upserts: every micro-batch appends its updated rows tagged
with the batch id to a Parquet table in the shared scratch area, and readers
keep the newest row per key. A replayed batch id overwrites nothing and the
newest-wins read makes retries idempotent. Checkpoints live under the shared
checkpoint folder, so a restarted query resumes.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.binning import equal_width_bin
from rankloom.operators import telemetry as TM
from rankloom.session import path_kind, scratch_dir
from rankloom.sources import tables as T


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the driver table ``name`` (schema taken from the batch table, never inferred)."""
    schema = T.table(spark, sf_dir, name).schema
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if path_kind(spark, path) == "dir":     # an ordinary table folder
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _paths(spark: SparkSession, name: str):
    base = os.path.join(scratch_dir(spark, "streams"), f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "updates"), os.path.join(base, "_checkpoint")


def run_upsert(df: DataFrame, name: str, mode: str = "update", trigger_available_now: bool = True) -> str:
    """Run a streaming aggregate into a batch-tagged Parquet table; returns its path."""
    spark = df.sparkSession
    out, ckpt = _paths(spark, name)

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(sink)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    q.awaitTermination()
    if path_kind(spark, out) is None:       # no batch ran: an empty table of the right columns
        spark.createDataFrame([], df.schema.add("_batch", "long")).write.parquet(out)
    return out


def read_upserts(spark: SparkSession, path: str, keys) -> DataFrame:
    """Newest row per key of a batch-tagged table."""
    d = spark.read.parquet(path)
    vals = [c for c in d.columns if c not in set(keys) | {"_batch"}]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("_v")).select(*keys, "_v.*")


def request_rate_stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """O2 on a stream: 1-minute request counts and rates per endpoint, with a watermark."""
    ev = file_stream(spark, sf_dir, "events")
    req = T.requests_of(ev).withColumn("ts", F.col("ts").cast("timestamp"))  # watermark needs TIMESTAMP
    lab = TM.labelled(req).withWatermark("ts", watermark)
    agg = lab.groupBy(F.window("ts", "1 minute").alias("w"), "endpoint").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("window_start"), "endpoint", "n", (F.col("n") / 60.0).alias("rate"))


def user_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live A1 statistics from a line-item stream joined to static orders."""
    li = file_stream(spark, sf_dir, "lineitem")
    od = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    r = li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        F.col("o_custkey").alias("user_id"),
        (F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        F.col("o_orderdate").alias("ts"))
    return r.groupBy("user_id").agg(F.sum("rating").alias("rating_sum"), F.count(F.lit(1)).alias("rating_count"),
                                    F.max("ts").alias("last_ts"))


def training_histogram(train: DataFrame, cols, n_bins: int = 20) -> DataFrame:
    """K4 reference side: per feature range and bin counts of the training data."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value") \
        .filter(F.col("value").isNotNull())
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = long.join(F.broadcast(rng), "feature").withColumn("bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), n_bins))
    counts = b.groupBy("feature", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"))
    return counts


def drift_stream(spark: SparkSession, sf_dir: str, cols, cut: str, train_hist: DataFrame, n_bins: int = 20) -> DataFrame:
    """K4 serving side: stream of line items from ``cut`` on, binned on the stored
    training ranges (values outside are clamped into the edge bins); running
    counts per (feature, bin)."""
    li = file_stream(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit(cut).cast("timestamp_ntz"))
    li = li.withColumn("l_quantity_shifted", F.col("l_quantity") + 25)
    rng = train_hist.select("feature", "lo", "hi").distinct()   # one row per feature
    long = li.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value") \
        .filter(F.col("value").isNotNull())
    b = long.join(F.broadcast(rng), "feature").withColumn(
        "bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), n_bins))
    return b.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))


def kl_from_counts(train_hist: DataFrame, serve_counts: DataFrame, n_bins: int = 20, eps: float = 1e-10) -> DataFrame:
    """KL(train || serving) from two count tables on the training bins (K2 formula)."""
    spine = train_hist.select("feature", "lo", "hi").distinct().select(
        "feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    t = train_hist.select("feature", "bin", F.col("c").alias("c_p"))
    s = serve_counts.select("feature", "bin", F.col("c").alias("c_q"))
    h = spine.join(t, ["feature", "bin"], "left").join(s, ["feature", "bin"], "left").fillna(0, ["c_p", "c_q"])
    tot = h.groupBy("feature").agg(F.sum("c_p").alias("n_p"), F.sum("c_q").alias("n_q"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
    d = h.join(tot, "feature").withColumn("dp", F.col("c_p") / (F.col("n_p") * w) + F.lit(eps)) \
        .withColumn("dq", F.col("c_q") / (F.col("n_q") * w) + F.lit(eps))
    sums = d.groupBy("feature").agg(F.sum("dp").alias("sp"), F.sum("dq").alias("sq"))
    d = d.join(sums, "feature").withColumn("p", F.col("dp") / F.col("sp")).withColumn("q", F.col("dq") / F.col("sq"))
    return d.groupBy("feature").agg(
        F.when(F.max("hi") == F.max("lo"), F.lit(0.0)).otherwise(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"))


# ----------------------------------------------------------------------- streams in several steps

#: A store that counts its rows looks up every key before it writes or removes it.
STATE_CONF = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


@contextmanager
def _settings(spark: SparkSession, conf: dict):
    """Settings of the queries started within; the session's own come back after."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_in_steps(make, steps, name: str, mode: str = "append") -> str:
    """Run a stream once per step: each step's rows are added to its source folder and
    the query is started again from its checkpoint (``availableNow``), so state goes on
    across micro-batches and restarts. ``make(folder)`` builds the stream. Returns the
    path of the batch-tagged result table."""
    spark = steps[0].sparkSession
    out, ckpt = _paths(spark, name)
    folder = os.path.join(os.path.dirname(out), "source")

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)
    for rows in steps:
        rows.write.mode("append").parquet(folder)
        df = make(folder)
        with _settings(spark, STATE_CONF):      # a query keeps the settings that it starts with
            query = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
    if path_kind(spark, out) is None:
        spark.createDataFrame([], df.schema.add("_batch", "long")).write.parquet(out)
    return out


def time_steps(df: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """``df`` cut into ``n`` steps by quantiles of its time column (null times first)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.select(at.cast("double").alias("_t")).approxQuantile("_t", [i / n for i in range(1, n)], 0.001)
    bounds = [None, *cuts, None]
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        keep = F.lit(True)
        if lo is not None:
            keep = keep & (at > lo)
        if hi is not None:
            keep = keep & ((at <= hi) if lo is not None else (at.isNull() | (at <= hi)))
        out.append(df.filter(keep))
    return out


def closing_rows(df: DataFrame, ts: str, days: int = 2, **values) -> DataFrame:
    """One row far behind the last time of ``df``, which moves the watermark past all
    others; ``values`` fill further columns (the rest is null)."""
    last = df.agg(F.max(ts).alias("_m"))
    cols = [(F.col("_m") + F.make_dt_interval(days=F.lit(days))).cast(f.dataType).alias(f.name) if f.name == ts
            else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return last.select(*cols)


def sessions_stream(spark: SparkSession, folder: str, schema, watermark: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """O13 on a stream: a session is emitted when the watermark passes its end; events
    behind the watermark are dropped."""
    req = T.requests_of(spark.readStream.schema(schema).parquet(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    return TM.sessions_windowed(req.withWatermark("ts", watermark), gap)


_MINUTE_MS = 60_000


def _minute_changes(batches):
    """Net change per minute of one batch of events: few rows reach the state."""
    import pandas as pd
    for pdf in batches:
        net = pdf.groupby("minute")["d"].sum()
        yield pd.DataFrame({"bucket_start": net.index, "net": net.to_numpy()})


def _gauge(key, frames, state):
    """State: the gauge after the last closed minute, and the open minutes' changes.
    Minutes that the watermark has passed are closed in order."""
    import pandas as pd
    total, starts, nets = state.get if state.exists else (0, [], [])
    open_ = dict(zip(starts, nets))
    for pdf in frames:
        for at, d in zip(pdf["bucket_start"].astype("int64") // 1000, pdf["net"]):     # microseconds
            at = int(at) // 1000
            open_[at] = open_.get(at, 0) + int(d)
    mark = state.getCurrentWatermarkMs()
    rows = []
    for at in sorted(open_):
        if at + _MINUTE_MS > mark:
            break
        net = open_.pop(at)
        total += net
        rows.append((pd.Timestamp(at, unit="ms"), net, total))
    state.update((total, list(open_), list(open_.values())))
    if open_:
        state.setTimeoutTimestamp(max(min(open_) + _MINUTE_MS, mark + 1))
    yield pd.DataFrame(rows, columns=["bucket_start", "net", "active"])


def active_stream(spark: SparkSession, folder: str, schema, watermark: str = "10 minutes") -> DataFrame:
    """O8 on a stream: the in-flight gauge kept as state, one row per minute with events
    when the watermark closes it. Changes are summed per minute before they reach the
    state (which holds the open minutes only), so its one key sees few rows."""
    req = T.requests_of(spark.readStream.schema(schema).parquet(folder))
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = start + (F.col("latency_ms") * 1000).cast("long")
    ev = req.filter(F.col("ts").isNotNull()).select(F.explode(F.array(
        F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("e")) \
        .select(F.timestamp_micros(F.floor(F.col("e.at") / 60_000_000) * 60_000_000).alias("minute"), "e.d").filter("minute IS NOT NULL")
    net = ev.mapInPandas(_minute_changes, "bucket_start timestamp, net long").withWatermark("bucket_start", watermark)
    return net.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandasWithState(
        _gauge, "bucket_start timestamp, net long, active long", "total long, starts array<long>, nets array<long>", "append", "EventTimeTimeout")


def windowed_drift_stream(spark: SparkSession, folder: str, schema, cols, ts: str, train_hist: DataFrame, window: str = "30 days",
                          watermark: str = "1 day", n_bins: int = 20) -> DataFrame:
    """K4: bin counts on the stored training ranges per (window, feature, bin), emitted
    when the watermark closes the window."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    rng = train_hist.select("feature", "lo", "hi").distinct()   # one row per feature
    long = rows.select("_ts", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("_ts", list(cols), "feature", "value") \
        .filter(F.col("value").isNotNull())
    b = long.join(F.broadcast(rng), "feature").withColumn("bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), n_bins))
    out = b.groupBy(F.window("_ts", window).alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    return out.select(F.col("w.start").alias("window_start"), "feature", "bin", "c")


def kl_by_window(train_hist: DataFrame, counts: DataFrame, n_bins: int = 20, eps: float = 1e-10) -> DataFrame:
    """K4: KL(train || serving) per (window, feature) from the two count tables."""
    spine = train_hist.select("feature", "lo", "hi").distinct().join(counts.select("window_start", "feature").distinct(), "feature") \
        .select("window_start", "feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    h = spine.join(train_hist.select("feature", "bin", F.col("c").alias("c_p")), ["feature", "bin"], "left") \
        .join(counts.select("window_start", "feature", "bin", F.col("c").alias("c_q")), ["window_start", "feature", "bin"], "left") \
        .fillna(0, ["c_p", "c_q"])
    keys = ["window_start", "feature"]
    tot = h.groupBy(*keys).agg(F.sum("c_p").alias("n_p"), F.sum("c_q").alias("n_q"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
    d = h.join(tot, keys).withColumn("dp", F.col("c_p") / (F.col("n_p") * w) + F.lit(eps)) \
        .withColumn("dq", F.col("c_q") / (F.col("n_q") * w) + F.lit(eps))
    sums = d.groupBy(*keys).agg(F.sum("dp").alias("sp"), F.sum("dq").alias("sq"))
    d = d.join(sums, keys).withColumn("p", F.col("dp") / F.col("sp")).withColumn("q", F.col("dq") / F.col("sq"))
    return d.groupBy(*keys).agg(F.max("n_q").alias("n_serving"), F.when(F.max("hi") == F.max("lo"), F.lit(0.0))
                                .otherwise(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"))
