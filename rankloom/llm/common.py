"""Shared plumbing of the operators in this subpackage: document keys, packed
texts, and span lists per document.

Document key: ``(doc_id, _tk)`` with ``_tk`` a hash of the text, so rows that
repeat an id with another text stay apart, and null ids are one ordinary key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import session
from rankloom.session import materialize  # noqa: F401  (used by the operators)

KEY = ("doc_id", "_tk")
_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    """What every operator needs of a session: the shared scratch folder, this
    package on the workers, Arrow batches of bounded bytes (long texts), and
    shuffle files that go when the query that made them is over (an operator
    writes its intermediate tables, so no later query reads those files)."""
    session.ensure_checkpoint_dir(spark)
    session.ship_package(spark)
    for k, v in _CONF.items():
        spark.conf.set(k, v)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, _tk, text`` of every document; other columns are dropped, so
    their names cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tk"), "text")


def same_key(a: DataFrame, b: DataFrame):
    return (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["_tk"] == b["_tk"])


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(docs: DataFrame):
    """``_tk`` of a row of ``docs`` itself."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def binaries(column) -> list[bytes]:
    """Text or binary column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def longs(a) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64, copy=False))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = binaries(b.column(2))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([z.compress(t) for t in texts], pa.binary())],
            names=["doc_id", "_tk", "z"])


def packed(docs: DataFrame) -> DataFrame:
    """Compressed texts by key, for joins that must move whole texts."""
    return keyed(docs).mapInArrow(_pack, "doc_id long, _tk long, z binary")


def unpack(column) -> list[bytes]:
    import zstandard
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in column.to_pylist()]


def pieces_of(n: int, size: int) -> Iterator[tuple[int, int]]:
    for i in range(0, n, size):
        yield i, min(n, i + size)
