"""Session construction and the lineage-cut helper."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": "10",     # repeated values: rows take far more than their files
    "spark.sql.codegen.hugeMethodLimit": "8000",         # the JVM never compiles a longer method: wide rows go by smaller ones
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),   # rows of packed blocks are large
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "rankloom", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster pass ``master=None`` and let the launcher decide; tests pass
    ``local[*]`` and a small shuffle-partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "16g"  # local mode: the driver JVM is the only executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only a ``local`` master
    may run without it (tests): there a fresh scratch folder is set."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="rankloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint) and return the truncated-lineage frame."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)   # else the checkpoint job recomputes the plan
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


_SCRATCH: dict = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables next to the shared checkpoint dir. Each
    application has its own root, which is deleted when the driver exits."""
    import atexit
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    key = (spark.sparkContext.applicationId, base)
    if key not in _SCRATCH:
        root = f"{base}/rankloom-tables/{key[0]}-{uuid.uuid4().hex[:8]}"
        _SCRATCH[key] = root
        atexit.register(drop_tree, spark, root)
    return f"{_SCRATCH[key]}/{name}"


def path_kind(spark: SparkSession, path: str) -> str | None:
    """``file``, ``dir`` or None for a path on any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def drop_tree(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system (any scheme)."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context is gone: the cluster's own cleaning takes over
        pass


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rankloom`` importable in Python workers (pandas UDFs) by adding a
    zip of the package to the context, once per application. The zip is code,
    not data: it is built in the driver's own temp folder and Spark sends it
    to the executors, like ``--py-files``."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="rankloom-code-"), "rankloom.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _dirs, names in os.walk(pkg):
            for n in sorted(names):
                if n.endswith(".py"):
                    f = os.path.join(root, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch area and read it back:
    a durable lineage cut at natural materialisation points (features, postings)."""
    import uuid
    path = f"{scratch_dir(df.sparkSession, name)}/{uuid.uuid4().hex}"
    # the plan runs once: its shuffle files go when it ends, not when the driver's JVM collects garbage
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
