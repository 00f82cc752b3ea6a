"""Embedding towers.

``content_embeddings`` (M11) is the deterministic tower pair used for exact
end-to-end checks: users are their genre preference, items their normalised
genre vector. The trainable two-tower model lives in ``twotower.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.genres import DRIVER_GENRES, multi_hot
from rankloom.functions.vectors import dot


def content_user_vectors(user_feats: DataFrame) -> DataFrame:
    """M11 user side: ``(user_id, vec)`` = genre preference (A3)."""
    return user_feats.select("user_id", F.col("genre_pref").alias("vec"))


def content_item_vectors(movies: DataFrame, vocab=DRIVER_GENRES) -> DataFrame:
    """M11 item side: ``(item_id, vec)`` = multi-hot genres of every catalogue item."""
    return movies.select("item_id", multi_hot("genres", vocab).alias("vec"))


def bpr_loss(u: str, p: str, n: str, dim: int) -> F.Column:
    """M3 per row: ``-log sigmoid(u.p - u.n)`` in the overflow-safe softplus form."""
    x = dot(u, p, dim) - dot(u, n, dim)
    return F.when(x > 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))


def in_batch_bpr_loss(batch: DataFrame, dim: int) -> DataFrame:
    """M4: ``batch(batch_id, row, u, i)``; every other row's item is a negative.

    ``mean_i mean_{j != i} softplus(-(u_i.i_i - u_i.i_j))``. Expressed with the
    batch's score matrix row by row: a self-join inside ``batch_id`` -- a batch
    is a training mini-batch whose size is a fixed parameter, so the pair count
    is bounded by batch_size^2 per batch.
    """
    a = batch.select("batch_id", F.col("row").alias("ri"), F.col("u").alias("ui"), F.col("i").alias("ii"))
    b = batch.select("batch_id", F.col("row").alias("rj"), F.col("i").alias("ij"))
    j = a.join(b, "batch_id").filter(F.col("ri") != F.col("rj"))
    x = dot("ui", "ii", dim) - dot("ui", "ij", dim)
    sp = F.when(x > 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))
    per_i = j.groupBy("batch_id", "ri").agg(F.avg(sp).alias("l"))
    return per_i.groupBy("batch_id").agg(F.avg("l").alias("loss"))
