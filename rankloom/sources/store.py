"""Keyed feature / recommendation store on Parquet.

A table is a set of folders and a manifest. ``put`` writes a folder of rows stamped
with ``written_at`` and ``expires_at``, in hash ``bucket`` partitions sorted by id, so
lookups prune files and row groups. A manifest (one small JSON file per version) names
the folders that are live; a new version appears by one rename that fails if another
writer was first, and is then tried again on top of that one. Readers open one version
and see just that one, whatever is written meanwhile. Reads keep the newest live row
per key (merge on read); ``compact`` and ``flush`` commit a version with other folders;
``vacuum`` deletes what the kept versions do not name.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.functions.genres import N_GENRES
from rankloom.session import drop_tree, path_kind, scratch_dir

FEATURE_TTL_S = 3600
RECS_TTL_S = 300
N_BUCKETS = 64          # of a new table; a table keeps the number it was made with
META = ("kind", "bucket", "key", "entity_id", "written_at", "expires_at", "seq")


def new_store_path(spark: SparkSession, name: str = "store") -> str:
    """A fresh folder for a store under the shared checkpoint location."""
    return os.path.join(scratch_dir(spark, name), uuid.uuid4().hex)


def entity_key(kind: str, entity_id) -> F.Column:
    """Typed key ``user:feat:<id>`` / ``item:feat:<id>`` / ``recs:<id>``."""
    prefix = {"user": "user:feat:", "item": "item:feat:", "recs": "recs:"}[kind]
    return F.concat(F.lit(prefix), F.col(entity_id).cast("string"))


def _bucket(id_col, n_buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n_buckets)).cast("int")


def _stamp(df: DataFrame, kind: str, id_col: str, as_of, ttl_s: int, n_buckets: int) -> DataFrame:
    """``seq`` orders puts of the same stamp: the later call wins."""
    t = F.lit(as_of).cast("timestamp")
    return df.select(
        F.lit(kind).alias("kind"), _bucket(id_col, n_buckets).alias("bucket"),
        entity_key(kind, id_col).alias("key"), F.col(id_col).cast("long").alias("entity_id"),
        t.alias("written_at"), (t + F.make_dt_interval(secs=F.lit(ttl_s))).alias("expires_at"),
        F.lit(time.time_ns()).alias("seq"),
        F.struct(*[c for c in df.columns if c != id_col]).alias("payload"))


# ----------------------------------------------------------------------- versions

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the versions on disk, ascending."""
    p, fs = _fs(spark, os.path.join(path, kind, "_versions"))
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, kind: str, version: int | None = None) -> dict | None:
    """``version, parts, schema, n_buckets`` of a version (the newest by default)."""
    if version is None:
        known = versions(spark, path, kind)
        if not known:
            return None
        version = known[-1]
    text = spark.read.text(os.path.join(path, kind, "_versions", f"v{version:010d}.json"), wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, kind: str, change: Callable[[dict | None], dict]) -> int:
    """Write the next version as ``change`` makes it of the newest one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = os.path.join(path, kind, "_versions")
    while True:
        now = manifest(spark, path, kind)
        version = now["version"] + 1 if now else 1
        body = json.dumps({**change(now), "version": version}).encode()
        tmp, fs = _fs(spark, os.path.join(folder, f".{uuid.uuid4().hex}"))
        out = fs.create(tmp)
        out.write(bytearray(body))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"v{version:010d}.json"))
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(tmp, target, options)
            return version
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" not in str(e):
                raise


def _read_version(spark: SparkSession, path: str, kind: str, now: dict | None) -> DataFrame:
    if now is None:
        raise FileNotFoundError(f"no table of kind {kind} in {path}")
    schema = StructType.fromJson(now["schema"])
    if not now["parts"]:
        return spark.createDataFrame([], schema)
    table = os.path.join(path, kind)
    return spark.read.option("basePath", table).schema(StructType([*schema.fields]).add("part", "string")) \
        .parquet(*[os.path.join(table, p) for p in now["parts"]]).drop("part")


def _write_part(rows: DataFrame, path: str, kind: str) -> str:
    """A new folder: one sorted file per bucket (more for a large one)."""
    part = f"part={uuid.uuid4().hex}"
    rows.repartition("bucket").sortWithinPartitions("bucket", "entity_id").write.partitionBy("bucket").parquet(os.path.join(path, kind, part))
    return part


# ----------------------------------------------------------------------- reads and writes

def put(df: DataFrame, path: str, kind: str, id_col: str, as_of, ttl_s: int = FEATURE_TTL_S, n_buckets: int = N_BUCKETS) -> int:
    """Append (upsert by newest-wins) rows of one kind; returns the version."""
    spark = df.sparkSession
    now = manifest(spark, path, kind)
    n_buckets = now["n_buckets"] if now else n_buckets
    rows = _stamp(df, kind, id_col, as_of, ttl_s, n_buckets)
    schema = rows.select(*META, "payload").schema.jsonValue()
    part = _write_part(rows, path, kind)
    return _commit(spark, path, kind, lambda now: {
        "parts": [*(now["parts"] if now else []), part], "schema": schema, "n_buckets": now["n_buckets"] if now else n_buckets})


def publish_features(user_feats: DataFrame, item_feats: DataFrame, path: str, as_of,
                     ttl_s: int = FEATURE_TTL_S) -> None:
    """Bulk publish; the item payload drops ``title`` (served from metadata)."""
    put(user_feats, path, "user", "user_id", as_of, ttl_s)
    put(item_feats.drop("title"), path, "item", "item_id", as_of, ttl_s)


def read_live(spark: SparkSession, path: str, kind: str, as_of, buckets=None, ids: DataFrame | None = None,
              version: int | None = None) -> DataFrame:
    """Newest row per key among rows not yet expired at ``as_of``, of one version
    of the table (the newest by default).

    ``buckets`` (a partition column) prunes files; ``ids(entity_id)`` keeps only
    the requested entities before the newest row per key is chosen."""
    return _live(spark, path, kind, as_of, manifest(spark, path, kind, version), buckets, ids)


def _live(spark, path, kind, as_of, now, buckets=None, ids=None, one=None) -> DataFrame:
    t = F.lit(as_of).cast("timestamp")
    rows = _read_version(spark, path, kind, now).filter((F.col("kind") == kind) & (F.col("expires_at") > t) & (F.col("written_at") <= t))
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(list(buckets)))
    if one is not None:
        rows = rows.filter(F.col("entity_id") == one)
    if ids is not None:
        rows = rows.join(ids, "entity_id", "left_semi")
    newest = rows.groupBy("key").agg(F.max_by(F.struct(*META, "payload"), F.struct("written_at", "seq")).alias("r"))
    return newest.select("r.*")


def get(spark: SparkSession, path: str, kind: str, entity_id: int, as_of) -> DataFrame:
    """The live row of one key (none if absent or expired). Reads one bucket, of
    it the row groups that hold the id."""
    now = manifest(spark, path, kind)
    one = spark.range(1).select(F.lit(entity_id).cast("long").alias("entity_id"))
    bucket = one.select(_bucket("entity_id", now["n_buckets"])).first()[0]
    return _live(spark, path, kind, as_of, now, [bucket], one=entity_id).select("entity_id", "payload")


def lookup(spark: SparkSession, path: str, kind: str, ids: DataFrame, id_col: str, as_of) -> DataFrame:
    """One row per requested id; absent or expired keys give a null payload.

    Only the buckets of the requested ids are read (at most the table's number of
    buckets reach the driver). The ids are the preserved side of a left join.
    """
    now = manifest(spark, path, kind)
    want = ids.select(F.col(id_col).cast("long").alias("entity_id")).distinct()
    buckets = [r[0] for r in want.select(_bucket("entity_id", now["n_buckets"])).distinct().collect()]
    live = _live(spark, path, kind, as_of, now, buckets, want).select(F.col("entity_id").alias(id_col), "payload")
    return ids.select(id_col).join(live, id_col, "left").withColumn("found", F.col("payload").isNotNull())


def flush(spark: SparkSession, path: str, kind: str) -> int:
    """A version without rows; readers of an earlier one keep theirs."""
    return _commit(spark, path, kind, lambda now: {**now, "parts": []})


def compact(spark: SparkSession, path: str, kind: str, as_of) -> str:
    """Purge job: the live newest rows in one folder, which replaces the folders they
    are from. What others put meanwhile stays. Returns the folder."""
    base = manifest(spark, path, kind)
    part = _write_part(_live(spark, path, kind, as_of, base), path, kind)
    old = set(base["parts"])

    def swap(now: dict) -> dict:
        # a flush meanwhile took the rows away: then there is nothing to replace
        kept = [p for p in now["parts"] if p not in old]
        return {**now, "parts": [part, *kept] if old <= set(now["parts"]) else kept}
    _commit(spark, path, kind, swap)
    return os.path.join(path, kind, part)


def vacuum(spark: SparkSession, path: str, kind: str, keep: int = 1) -> int:
    """Delete the folders that none of the newest ``keep`` versions names, and the older
    versions; returns how many folders went. Not while a put is under way."""
    known = versions(spark, path, kind)
    named = {p for v in known[-keep:] for p in manifest(spark, path, kind, v)["parts"]}
    p, fs = _fs(spark, os.path.join(path, kind))
    gone = [f.getPath().getName() for f in fs.listStatus(p)]
    gone = [n for n in gone if n.startswith("part=") and n not in named]
    for n in gone:
        drop_tree(spark, os.path.join(path, kind, n))
    for v in known[:-keep]:
        drop_tree(spark, os.path.join(path, kind, "_versions", f"v{v:010d}.json"))
    return len(gone)


def stats(spark: SparkSession, path: str, kinds, as_of) -> DataFrame:
    """Backend and live key count per kind."""
    frames = [read_live(spark, path, k, as_of).groupBy("kind").agg(F.count(F.lit(1)).alias("n_keys"))
              for k in kinds]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("backend", F.lit("parquet"))


def cache_recs(recs: DataFrame, path: str, as_of, ttl_s: int = RECS_TTL_S, k_built: int | None = None) -> None:
    """One row per user holding the rank-ordered list (bounded by k)."""
    lists = recs.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "item_id", "title", "score", "retrieval_score", "genres"))).alias("recs"))
    if k_built is not None:
        lists = lists.withColumn("k_built", F.lit(k_built))
    put(lists, path, "recs", "user_id", as_of, ttl_s)


def read_cached_recs(spark: SparkSession, path: str, as_of) -> DataFrame:
    """Newest live list per user: ``(user_id, recs, k_built)``."""
    live = read_live(spark, path, "recs", as_of)
    cols = [F.col("entity_id").alias("user_id"), F.col("payload.recs").alias("recs")]
    if "k_built" in live.select("payload.*").columns:
        cols.append(F.col("payload.k_built").alias("k_built"))
    return live.select(*cols)


def write_features(user_feats: DataFrame, item_feats: DataFrame, out_dir: str, n: int = N_GENRES) -> None:
    """Array columns expanded to ``genre_pref_i`` / ``genre_vec_i``, Parquet sink."""
    u = user_feats.select(*[c for c in user_feats.columns if c != "genre_pref"],
                          *[F.col("genre_pref")[i].alias(f"genre_pref_{i}") for i in range(n)])
    i = item_feats.select(*[c for c in item_feats.columns if c != "genre_vector"],
                          *[F.col("genre_vector")[k].alias(f"genre_vec_{k}") for k in range(n)])
    u.write.mode("overwrite").parquet(os.path.join(out_dir, "user_features.parquet"))
    i.write.mode("overwrite").parquet(os.path.join(out_dir, "item_features.parquet"))


def read_features(spark: SparkSession, in_dir: str, n: int = N_GENRES) -> tuple[DataFrame, DataFrame]:
    """Read back; the scalar genre columns are regrouped into one array when all are present."""
    def regroup(df, prefix, name):
        cols = [f"{prefix}{i}" for i in range(n)]
        if all(c in df.columns for c in cols):
            return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols])).drop(*cols)
        return df
    u = spark.read.parquet(os.path.join(in_dir, "user_features.parquet"))
    i = spark.read.parquet(os.path.join(in_dir, "item_features.parquet"))
    return regroup(u, "genre_pref_", "genre_pref"), regroup(i, "genre_vec_", "genre_vector")


def table_audit(spark: SparkSession, sf_dir: str, expected) -> DataFrame:
    """For each expected input table, present or not and its row count."""
    rows = []
    for name in expected:
        p = os.path.join(sf_dir, f"{name}.parquet")
        if path_kind(spark, p):
            rows.append(spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows"))
                        .select(F.lit(name).alias("table"), F.lit(True).alias("present"), "rows"))
        else:
            rows.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(False).alias("present"),
                                              F.lit(0).cast("long").alias("rows")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
