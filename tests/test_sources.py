"""Sources and store: encodings, pruned lookups, directory tables, percentiles of a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import telemetry as TM
from rankloom.session import path_kind
from rankloom.sources import dat, store
from rankloom.streaming import jobs


def test_accents_and_quotes_survive_the_round_trip(spark, tmp_path):
    rows = [(1, 'Amélie "la" (2001)', "Comedy|Romance"), (2, " spaced , title ", "Drama")]
    dat.write_dat(spark.createDataFrame(rows, "item_id long, title string, genres string"), str(tmp_path / "m"), ["item_id", "title", "genres"])
    got = {r.item_id: (r.title, r.genres) for r in dat.read_movies(spark, str(tmp_path / "m")).collect()}
    assert got == {i: (t, g) for i, t, g in rows}


def test_lookup_reads_the_requested_buckets(spark):
    path = store.new_store_path(spark, "prune")
    users = spark.range(1, 400).select(F.col("id").alias("user_id"), (F.col("id") * 2.0).alias("x"))
    store.put(users, path, "user", "user_id", "2024-01-01 00:00:00")
    store.put(users.filter("user_id = 7").withColumn("x", F.lit(-1.0)), path, "user", "user_id", "2024-01-01 00:00:00")
    ids = spark.createDataFrame([(7,), (1000,)], "user_id long")
    out = store.lookup(spark, path, "user", ids, "user_id", "2024-01-01 00:10:00")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    got = {r.user_id: r.payload.x if r.found else None for r in out.collect()}
    assert got == {7: -1.0, 1000: None}         # the later put of the same stamp wins
    assert store.get(spark, path, "user", 8, "2024-01-01 00:10:00").first()["payload"]["x"] == 16.0
    assert store.get(spark, path, "user", 8, "2024-01-02 00:10:00").count() == 0


def test_path_kind(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    assert (path_kind(spark, str(tmp_path)), path_kind(spark, f"file://{tmp_path}/f"), path_kind(spark, str(tmp_path / "no"))) == ("dir", "file", None)


def test_directory_tables_are_streamed(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))

    def rates(folder, **kw):
        path = jobs.run_upsert(jobs.request_rate_stream(spark, folder), "rate_test")
        return {(r.window_start, r.endpoint): r.n for r in jobs.read_upserts(spark, path, ["window_start", "endpoint"]).collect()}
    assert rates(str(tmp_path)) == rates(sf)


def test_exact_percentiles_match_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(i, "/a" if i % 10 else "/b", float(v)) for i, v in enumerate(r.integers(0, 50, 997))] + [(5000, "/b", None)]
    df = spark.createDataFrame(rows, "request_id long, endpoint string, latency_ms double")
    base = TM.labelled
    try:
        TM.labelled = lambda d: d
        got = {x.endpoint: (x.p50, x.p95, x.p99, x.n) for x in TM.exact_latency_percentiles(df).collect()}
    finally:
        TM.labelled = base
    for e in ("/a", "/b"):
        v = [x[2] for x in rows if x[1] == e and x[2] is not None]
        assert got[e][:3] == pytest.approx(tuple(np.percentile(v, [50, 95, 99]))) and got[e][3] == len(v)


def _table(spark, path, rows, as_of="2024-01-01 00:00:00"):
    return store.put(spark.createDataFrame(rows, "user_id long, x double"), path, "user", "user_id", as_of)


def _values(df):
    return {r["entity_id"]: r["payload"]["x"] for r in df.collect()}


def test_readers_see_one_version(spark):
    path, now = store.new_store_path(spark, "versions"), "2024-01-01 00:10:00"
    _table(spark, path, [(i, float(i)) for i in range(50)])
    _table(spark, path, [(1, -1.0)], "2024-01-01 00:01:00")
    before = store.read_live(spark, path, "user", now)
    assert store.versions(spark, path, "user") == [1, 2]
    out = store.compact(spark, path, "user", now)
    _table(spark, path, [(2, -2.0)], "2024-01-01 00:02:00")
    store.flush(spark, path, "user")
    assert _values(before) == {i: -1.0 if i == 1 else float(i) for i in range(50)}       # opened before: unchanged
    assert store.read_live(spark, path, "user", now).count() == 0
    assert _values(store.read_live(spark, path, "user", now, version=4))[2] == -2.0
    assert {r["entity_id"] for r in spark.read.parquet(out).collect()} == set(range(50))
    assert store.vacuum(spark, path, "user", keep=1) == 4 and store.versions(spark, path, "user") == [5]
    _table(spark, path, [(9, 9.0)])
    assert _values(store.read_live(spark, path, "user", now)) == {9: 9.0}


def test_compaction_keeps_what_is_put_meanwhile(spark, monkeypatch):
    path, now = store.new_store_path(spark, "races"), "2024-01-01 00:10:00"
    _table(spark, path, [(1, 1.0), (2, 2.0)])
    write = store._write_part

    def slow(rows, p, kind):
        monkeypatch.setattr(store, "_write_part", write)
        _table(spark, path, [(2, 20.0), (3, 30.0)], "2024-01-01 00:05:00")      # between the read and the commit
        return write(rows, p, kind)
    monkeypatch.setattr(store, "_write_part", slow)
    store.compact(spark, path, "user", now)
    assert _values(store.read_live(spark, path, "user", now)) == {1: 1.0, 2: 20.0, 3: 30.0}
    assert len(store.manifest(spark, path, "user")["parts"]) == 2


def test_two_writers_of_one_version(spark, monkeypatch):
    """The second to commit finds the version taken and builds on it."""
    path, now = store.new_store_path(spark, "writers"), "2024-01-01 00:10:00"
    _table(spark, path, [(1, 1.0)])
    real, first = store.manifest, []

    def late(spark, p, kind, version=None):
        found = real(spark, p, kind, version)
        if not first and version is None:
            first.append(1)
            monkeypatch.setattr(store, "manifest", real)
            _table(spark, path, [(2, 2.0)])             # another writer, between read and rename
        return found
    monkeypatch.setattr(store, "manifest", late)
    assert store._commit(spark, path, "user", lambda now: {**now, "parts": [p for p in now["parts"]]}) == 3
    assert _values(store.read_live(spark, path, "user", now)) == {1: 1.0, 2: 2.0}


def test_get_reads_one_bucket_and_pushes_the_id(spark):
    path = store.new_store_path(spark, "point")
    _table(spark, path, [(i, float(i)) for i in range(300)])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = store.get(spark, path, "user", 8, "2024-01-01 00:10:00")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(entity_id,8)" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert store.get(spark, path, "user", 8, "2024-01-01 00:10:00").first()["payload"]["x"] == 8.0
