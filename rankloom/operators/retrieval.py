"""List-pruned (IVF) nearest-neighbour retrieval by inner product.

Layout: ``centroids(list_id, centroid)`` and ``postings(list_id, item_id, vec)``.

One plan at every size:

* ``probe`` finds the best lists of a query. Up to ``MAX_CENTROID_BYTES`` the centroids
  are broadcast; beyond, they are an index of their own: cells around about
  sqrt(n_lists) pivots, searched exactly with the bound q.c <= q.pivot + |q| radius.
* Equal vectors of a list are one entry with the k smallest of their ids: no other id
  of theirs can be in a top k. A query scores each entry once.
* Entries are packed into blocks of ``BLOCK_BYTES`` of vectors and ids: small lists share a
  block, a large list spans several. Queries are packed by the blocks they need. A block
  meets at most ``SPLIT_PACKS`` packs in one task, and is sent to as many tasks as it needs.
* The block with a query's best list is searched first. Its k-th score is a lower
  bound for the query, and every other block returns only rows that reach it. A block
  returns one list per query, and the lists of a query are merged by batches of queries.
* Smaller blocks that a caller asks for are searched one after the other in the task
  that holds them: the k-th score so far bounds the next, and k rows per query leave it.
* A block is scored by matrix products, a list only for the queries that probe it. The
  product (in float32) may differ from the float64 sum taken dimension by dimension by a
  proved margin (``near_type``), so rows within that of the k-th score are candidates,
  and only these are summed again.

Scores are thus the left-to-right float64 sum a SQL engine computes, so rankings,
including ties on identical vectors, are reproducible by an independent oracle.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.hashing import portable_hash
from rankloom.functions.vectors import l2_normalize
from rankloom.session import materialize

DEFAULT_N_LISTS = 100
DEFAULT_N_PROBE = 10
DEFAULT_K = 500
MAX_CENTROID_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20          # vectors of one block
USER_BLOCK = 1024               # queries of one pack
SPLIT_PACKS = 32                # packs that one task searches in a block
SCORE_BUDGET_BYTES = 32 << 20   # score matrix of one step
RUN_ROWS = 2048                 # entries that are scored before the first bound
PAIR_ROWS = 512                 # pairs of vectors that are summed at a time
NO_BOUND = float(np.finfo(np.float64).min)
EXPAND_ROWS = 1 << 20           # ids of one step
UNFILLED_SCORE = -3.4028234663852886e38  # -FLT_MAX, what an IVF search reports for empty slots


def spread(queries: DataFrame, per_task: int = 4) -> DataFrame:
    """Hash-spread the (usually tiny, AQE-coalesced) query frame over the cluster
    before the CPU-heavy scoring; an explicit partition count is not coalesced."""
    n = queries.sparkSession.sparkContext.defaultParallelism * per_task
    return queries.repartition(n, "query_id")


# ----------------------------------------------------------------------- numpy kernels

def seq_norm(x: np.ndarray) -> np.ndarray:
    s = x[:, 0] * x[:, 0]
    for j in range(1, x.shape[1]):
        s = s + x[:, j] * x[:, j]
    return np.sqrt(s)


def seq_dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``q @ x.T`` summed dimension by dimension (no reassociation)."""
    acc = np.multiply.outer(q[:, 0], x[:, 0])
    for j in range(1, q.shape[1]):
        acc += np.multiply.outer(q[:, j], x[:, j])
    return acc


def clamp_normalize(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(seq_norm(x), 1e-8)[:, None]


def _stack(col: pd.Series, dim: int) -> np.ndarray:
    """A column of vectors as a matrix; raises on null vectors or another width."""
    if len(col) == 0:
        return np.zeros((0, dim))
    if any(v is None or len(v) != dim for v in col.values):
        raise ValueError(f"every vector must have {dim} values")
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values])


def rounding_margin(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per row of ``q``: twice the largest difference between two float64 sums of a
    product with a row of ``x``, whatever their order. Each is within
    gamma |q| |x| of the exact value, gamma = d u / (1 - d u), u = 2**-53; the norms'
    own rounding is covered by another factor of two."""
    d = q.shape[1]
    gamma = d * 2.0**-53 / (1.0 - d * 2.0**-53)
    most = math.sqrt(float(np.square(x).sum(axis=1).max())) if len(x) else 0.0
    return 8.0 * gamma * np.sqrt(np.square(q).sum(axis=1)) * most + 1e-300


def near_type(q: np.ndarray, x: np.ndarray) -> tuple[type, np.ndarray]:
    """Type of a first product of ``q`` and ``x``, and per row of ``q`` twice the largest
    difference between it and a float64 sum: float32 while neither can overflow it. The
    inputs' rounding counts as two more terms of the sum."""
    margin = rounding_margin(q, x)
    far = math.sqrt(max((float(np.square(v).sum(axis=1).max()) if len(v) else 0.0 for v in (q, x)), default=0.0))
    if not far < 1e15:
        return np.float64, margin
    u = (q.shape[1] + 2) * 2.0**-24
    return np.float32, margin + 4.0 * u / (1.0 - u) * np.sqrt(np.square(q).sum(axis=1)) * far + 1e-20


def pair_dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of corresponding rows, summed dimension by dimension; a few rows at a time,
    which stay in the cache."""
    return pairs_dot(q, x, np.arange(len(q)), np.arange(len(x)))


def pairs_dot(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``pair_dot`` of the rows ``r`` of ``q`` and ``c`` of ``x``."""
    out = np.empty(len(r))
    for lo in range(0, len(r), PAIR_ROWS):
        terms = np.ascontiguousarray((q[r[lo:lo + PAIR_ROWS]] * x[c[lo:lo + PAIR_ROWS]]).T)
        acc = terms[0]
        for j in range(1, len(terms)):
            acc += terms[j]
        out[lo:lo + PAIR_ROWS] = acc
    return out


def _kth(r: np.ndarray, s: np.ndarray, n: int, k: int) -> np.ndarray:
    """Per row its k-th largest score, -inf with fewer."""
    size = np.bincount(r, minlength=n)
    full = size >= k
    at = (np.cumsum(size) - size + k - 1)[full]
    out = np.full(n, -np.inf)
    if s.dtype == np.float32:       # row and score as one number, whose sort is several times faster
        bits = s.view(np.uint32)
        down = np.where(bits >> 31, bits, bits ^ np.uint32(0x7FFFFFFF))      # falls as the score rises
        key = np.sort((r.astype(np.uint64) << np.uint64(32)) | down)[at].astype(np.uint32)      # the low half
        out[full] = np.where(key >> 31, key, key ^ np.uint32(0x7FFFFFFF)).view(np.float32)
    else:
        out[full] = s[np.lexsort((-s, r))][at]
    return out


def near_top(q: np.ndarray, x: np.ndarray, bounds: np.ndarray, allow: np.ndarray, k: int, least: np.ndarray,
             margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and entry of all products that can be among the k best of a query and reach
    ``least``. A list is scored only for the queries that probe it, by growing runs of
    entries; the k-th product so far is a lower bound for the next ones."""
    least = least.copy()
    found, kept = [], 0

    def tightened() -> list:
        r, c, s = (np.concatenate(v) for v in zip(*found))
        np.maximum(least, _kth(r, s, len(q), k) - 2 * margin, out=least)
        fine = s >= least[r]
        return [(r[fine], c[fine], s[fine])]

    for li in range(len(bounds) - 1):
        rows, at, end = np.flatnonzero(allow[:, li]), int(bounds[li]), int(bounds[li + 1])
        if not len(rows):
            continue
        some, size = q[rows], max(RUN_ROWS, 4 * k)
        while at < end:
            part = x[at:min(end, at + size)]
            s = some @ part.T
            new = np.flatnonzero(least[rows] == NO_BOUND) if len(part) > k else ()
            if len(new):
                kth = np.partition(s[new], len(part) - k, axis=1)[:, len(part) - k]
                least[rows[new]] = np.maximum(NO_BOUND, kth - 2 * margin[rows[new]])
            bound = least[rows]
            if s.dtype != bound.dtype:      # the next number below it
                bound = np.nextafter(np.maximum(bound, -1e38).astype(s.dtype), s.dtype.type(-2e38))
            flat = np.flatnonzero(s >= bound[:, None])
            if len(flat):
                r, c = np.divmod(flat, len(part))
                found.append((rows[r], at + c, s.ravel()[flat]))
                kept += len(flat)
            if kept > 3 * k * len(q):
                found = tightened()
                kept = max(len(found[0][0]), 2 * k * len(q))
            at, size = at + len(part), 2 * size
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tightened()[0][:2]


def top_k_entries(q: np.ndarray, x: np.ndarray, starts: np.ndarray, ids: np.ndarray, bounds: np.ndarray, allow: np.ndarray, k: int,
                  floor: np.ndarray, near: tuple | None = None) -> Iterator[tuple]:
    """Exact top-k rows of a block for each query by (score desc, id asc).

    ``x`` holds the entries' vectors ordered by list, ``bounds`` are the lists' starts (and
    the end), entry e has the ascending ``ids[starts[e]:starts[e + 1]]``, ``allow`` says which
    lists a query probes, ``floor`` the score that a row must reach, ``near`` may hold ``q``,
    ``x`` in the ``near_type`` and its margins. Yields query rows, ids and scores, best first,
    a run of queries at a time."""
    if near is None:
        kind, margin = near_type(q, x)
        near = q.astype(kind), x.astype(kind), margin
    q0, x0, margin = near
    r, c = near_top(q0, x0, bounds, allow, k, np.maximum(floor - margin, NO_BOUND), margin)
    score = pairs_dot(q, x, r, c)
    fine = score >= floor[r]
    r, c, score = r[fine], c[fine], score[fine]
    by = np.lexsort((-score, r))
    r, c, score = r[by], c[by], score[by]
    # a tier: the entries of a query with one score; it counts while fewer than k ids lie before it
    tier, before = _tiers(r, score, np.diff(starts)[c])
    counts = before < k
    r, c, score, tier, n = r[counts], c[counts], score[counts], tier[counts], np.minimum(np.diff(starts)[c], k - before)[counts]
    done = np.cumsum(n)
    lo = 0
    while lo < len(r):                # runs of whole queries with EXPAND_ROWS ids, or one query
        last = max(lo, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + EXPAND_ROWS, "right")) - 1)
        hi = int(np.searchsorted(r, r[last]))
        hi = hi if hi > lo else int(np.searchsorted(r, r[last], "right"))
        if last == len(r) - 1:
            hi = len(r)
        yield _expand(r[lo:hi], c[lo:hi], score[lo:hi], tier[lo:hi], n[lo:hi], starts, ids, k)
        lo = hi


def top_k_block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, allow: np.ndarray, k: int, floor: np.ndarray):
    """``top_k_entries`` with one id an entry: query rows, item rows, scores and 0-based ranks."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    found = list(top_k_entries(q, x, np.arange(len(ids) + 1), place, bounds, allow, k, floor))
    r, c, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float)))
    return r, order[c], score, np.arange(len(r)) - np.searchsorted(r, r)


def _tiers(r: np.ndarray, score: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tier of each entry, and the ids of its query before that tier."""
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.append(True, r[1:] != r[:-1])
    new = turn | np.append(True, score[1:] != score[:-1])
    tier = np.cumsum(new) - 1
    ahead = np.cumsum(n) - n
    return tier, ahead[np.flatnonzero(new)][tier] - ahead[np.flatnonzero(turn)][np.cumsum(turn) - 1]


def _expand(r, c, score, tier, n, starts, ids, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k ids of each query; those of a tier in ascending order."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[c], n)
    found, of = ids[at], np.repeat(tier, n)
    several = np.flatnonzero(np.repeat(np.bincount(tier - tier[0])[tier - tier[0]] > 1, n))
    found[several] = found[several][np.lexsort((found[several], of[several]))]
    rows = np.repeat(r, n)
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], found[keep], np.repeat(score, n)[keep]


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; raises on null vectors or another width."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if column.null_count or (size != dim).any():
        raise ValueError(f"every vector must have {dim} values")
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dim)


# ----------------------------------------------------------------------- index build

def list_count_rule(n_vectors: int, n_lists: int = DEFAULT_N_LISTS) -> int:
    """R2: keep ``n_lists`` if there are at least 39 training vectors per list,
    else ``max(1, n // 39)``."""
    return n_lists if n_vectors >= 39 * n_lists else max(1, n_vectors // 39)


def _centroid_matrix(centroids: DataFrame, dim: int):
    """List ids and centroids, or None beyond ``MAX_CENTROID_BYTES``."""
    if centroids.count() * dim * 8 > MAX_CENTROID_BYTES:
        return None
    pdf = centroids.select("list_id", "centroid").orderBy("list_id").toPandas()
    return pdf["list_id"].to_numpy(np.int64), _stack(pdf["centroid"], dim)


def label_centroids(vectors: DataFrame, dim: int, label: str = "label") -> DataFrame:
    """Caller-given centroids: mean of the (clamp-normalised) vectors per label."""
    v = vectors.select(F.col(label).cast("long").alias("list_id"), l2_normalize("vec", dim, "clamp").alias("u"))
    agg = v.groupBy("list_id").agg(*[F.avg(F.col("u")[i]).alias(f"c{i}") for i in range(dim)])
    return agg.select("list_id", F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("centroid"))


def basis_centroids(spark, dim: int) -> DataFrame:
    """Caller-given centroids: the unit axes (list j = items whose largest coordinate is j)."""
    rows = [(j, [1.0 if i == j else 0.0 for i in range(dim)]) for j in range(dim)]
    return spark.createDataFrame(rows, "list_id long, centroid array<double>")


def fit_coarse(vectors: DataFrame, n_lists: int, dim: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Train list centroids with MLlib k-means (cosine distance) on normalised vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = vectors.select(array_to_vector(l2_normalize("vec", dim, "clamp")).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(data)
    spark = vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "list_id long, centroid array<double>")


def assign_lists(vectors: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """Postings ``(list_id, item_id, vec)``: vectors clamp-normalised, each put
    in the list of its best centroid (ties -> lowest list id). A vector of another
    width, or null, raises (R10)."""
    found = _centroid_matrix(centroids, dim)
    if found is None:
        lists = probe(vectors.select(F.col("item_id").alias("query_id"), "vec"), centroids, dim, 1)
        return lists.select("list_id", F.col("query_id").alias("item_id"), F.col("qvec").alias("vec"))
    bc = vectors.sparkSession.sparkContext.broadcast(found)

    def _assign(batches):
        lids, c = bc.value
        for pdf in batches:
            x = clamp_normalize(_stack(pdf["vec"], dim))
            s = seq_dot(x, c)
            best = np.argmax(s, axis=1) if len(pdf) else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame({"list_id": lids[best], "item_id": pdf["item_id"].to_numpy(np.int64),
                                "vec": list(x)})

    schema = "list_id long, item_id long, vec array<double>"
    return vectors.select(F.col("item_id").cast("long"), "vec").mapInPandas(_assign, schema)


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector width differs from ``dim`` (or is null) -- empty when valid."""
    return vectors.filter(F.col("vec").isNull() | (F.size("vec") != dim))


def index_stats(postings: DataFrame, dim: int, n_lists: int, n_probe: int) -> DataFrame:
    """Vectors, dim, lists, probe, metric, id count, plus list-size skew."""
    sizes = postings.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_vectors"), F.lit(dim).alias("dim"), F.lit(n_lists).alias("n_lists"),
        F.count(F.lit(1)).alias("non_empty_lists"), F.lit(n_probe).alias("n_probe"),
        F.lit("inner_product").alias("metric"), F.max("n").alias("max_list_size"),
        F.min("n").alias("min_list_size"), F.avg("n").alias("avg_list_size"))


# ----------------------------------------------------------------------- search

def _routed(queries: DataFrame, lists: tuple, dim: int, n_probe: int | None, radius: np.ndarray | None = None) -> DataFrame:
    """Queries with their lists, best first: ``query_id, qvec, lists, bounds``. All
    lists without ``n_probe``; ``bounds`` (above any score in the list) with ``radius``."""
    bc = queries.sparkSession.sparkContext.broadcast((*lists, radius))
    n = len(lists[0]) if n_probe is None else min(n_probe, len(lists[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, far = bc.value
        for b in batches:
            q = clamp_normalize(_doubles(b.column("vec"), dim)) if b.num_rows else np.zeros((0, dim))
            step = max(1, SCORE_BUDGET_BYTES // max(1, 8 * len(ids)))
            for lo in range(0, len(q), step):
                part = q[lo:lo + step]
                s = seq_dot(part, c)
                order = np.argsort(-s, axis=1, kind="stable")[:, :n]
                top = np.full(order.shape, np.inf)
                if far is not None:
                    # q.c = q.pivot + q.(c - pivot), and rounding
                    reach = s + seq_norm(part)[:, None] * far + rounding_margin(part, c)[:, None] * 2 + 1e-12 * (1 + far)
                    top = np.take_along_axis(reach, order, axis=1)
                at = pa.array(np.arange(0, order.size + 1, n), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("query_id").slice(lo, len(part)), pa.array([v.tobytes() for v in part], pa.binary()),
                     pa.ListArray.from_arrays(at, pa.array(ids[order].ravel())), pa.ListArray.from_arrays(at, pa.array(top.ravel()))],
                    names=["query_id", "qvec", "lists", "bounds"])

    return spread(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))) \
        .mapInArrow(run, "query_id long, qvec binary, lists array<long>, bounds array<double>")


def _unpacked(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.frombuffer(b"".join(b.column("qvec").to_pylist()), np.float64)
            at = pa.array(np.arange(0, len(v) + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query_id", "list_id", "probe_rank")),
                                              pa.ListArray.from_arrays(at, pa.array(v))], names=["query_id", "list_id", "probe_rank", "qvec"])
    return run


def _centroid_cells(centroids: DataFrame, dim: int):
    """Centroids beyond the broadcast bound as an index of their own: postings by cell,
    and per cell its pivot and radius. About sqrt(n_lists) pivots."""
    c = materialize(centroids.select("list_id", "centroid"), "centroids")
    n = max(1, math.isqrt(c.count()))
    if n * dim * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"{n} pivots x {dim} dims exceed the bound of a broadcast")
    pdf = c.orderBy(F.xxhash64("list_id"), "list_id").limit(n).toPandas()
    pivots = _stack(pdf["centroid"], dim)
    bc = centroids.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        p = bc.value
        for pdf in batches:
            x = _stack(pdf["centroid"], dim)
            far = np.sqrt(np.maximum(np.square(x).sum(1)[:, None] - 2 * (x @ p.T) + np.square(p).sum(1), 0))
            cell = np.argmin(far, axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(np.square(x - p[cell]).sum(axis=1))
            yield pd.DataFrame({"list_id": cell, "item_id": pdf["list_id"].to_numpy(np.int64), "vec": list(x), "far": far})

    cells = materialize(c.mapInPandas(nearest, "list_id long, item_id long, vec array<double>, far double"), "cells")
    radius = np.zeros(n)
    for r in cells.groupBy("list_id").agg(F.max("far").alias("far")).collect():      # one row per pivot
        radius[r["list_id"]] = r["far"]
    return cells.drop("far"), (np.arange(n), pivots), radius


def probe(queries: DataFrame, centroids: DataFrame, dim: int, n_probe: int) -> DataFrame:
    """Best ``n_probe`` lists per (clamp-normalised) query: ``(query_id, list_id, probe_rank, qvec)``."""
    found = _centroid_matrix(centroids, dim)
    if found is not None:
        rows = _routed(queries, found, dim, n_probe).select("query_id", "qvec", F.posexplode("lists").alias("_p", "list_id")) \
            .select("query_id", "list_id", (F.col("_p") + 1).alias("probe_rank"), "qvec")
    else:
        routed, hits = _probe_cells(queries, centroids, dim, n_probe)
        rows = hits.join(routed.select("query_id", "qvec"), "query_id").select(
            "query_id", F.col("item_id").alias("list_id"), F.col("rank").alias("probe_rank"), "qvec")
    return rows.mapInArrow(_unpacked(dim), "query_id long, list_id long, probe_rank int, qvec array<double>")


def _probe_cells(queries: DataFrame, centroids: DataFrame, dim: int, n_probe: int) -> tuple[DataFrame, DataFrame]:
    cells, pivots, radius = _centroid_cells(centroids, dim)
    routed = materialize(_routed(queries, pivots, dim, None, radius), "routed")
    return routed, _search(routed, materialize(distinct_entries(cells, n_probe), "entries"), dim, n_probe, USER_BLOCK, None)


_BLOCK = "block long, lists binary, bounds binary, starts binary, ids binary, mat binary"
_PACK = "block long, split long, query_ids binary, floors binary, offsets binary, probed binary, qmat binary"
_HITS = "query_id long, item_ids array<long>, scores array<double>"


def _pack_items(dim: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        lists, ids = table.column("list_id").to_numpy(), table.column("ids").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        head = ids.flatten().to_numpy()[np.cumsum(sizes) - sizes]
        order = np.lexsort((head, lists))
        own, first = np.unique(lists[order], return_index=True)
        mat = _doubles(table.column("vec").combine_chunks(), dim)[order]
        starts = np.append(0, np.cumsum(sizes[order]))
        return pa.table({"block": table.column("block").slice(0, 1), "lists": [own.tobytes()],
                         "bounds": [np.append(first, len(order)).astype(np.int64).tobytes()], "starts": [starts.tobytes()],
                         "ids": [ids.take(pa.array(order)).flatten().to_numpy().tobytes()], "mat": [mat.tobytes()]},
                        schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("lists", "bounds", "starts", "ids", "mat"))]))
    return run


def _pack_queries(table: pa.Table) -> pa.Table:
    lists = table.column("lists").combine_chunks()
    return pa.table({"block": table.column("block").slice(0, 1), "split": table.column("split").slice(0, 1), "query_ids": [table.column("query_id").to_numpy().tobytes()],
                     "floors": [table.column("floor").to_numpy().tobytes()], "offsets": [lists.offsets.to_numpy().astype(np.int64).tobytes()],
                     "probed": [lists.flatten().to_numpy().tobytes()], "qmat": [b"".join(table.column("qvec").to_pylist())]},
                    schema=pa.schema([("block", pa.int64()), ("split", pa.int64()), *((c, pa.binary()) for c in ("query_ids", "floors", "offsets", "probed", "qmat"))]))


def _best(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by (score desc, id asc)."""
    by = np.lexsort((ids, -score, r))
    r, ids, score = r[by], ids[by], score[by]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], ids[keep], score[keep]


def beside(allow: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Steps of queries, those that probe the same first list side by side."""
    order = np.argsort(np.argmax(allow, axis=1), kind="stable")
    for lo in range(0, len(order), step):
        yield np.sort(order[lo:lo + step])


def top_k_tiles(q: np.ndarray, x: np.ndarray, starts: np.ndarray, ids: np.ndarray, bounds: np.ndarray, allow: np.ndarray, k: int,
                floor: np.ndarray, user_block: int, item_block: int) -> Iterator[tuple]:
    """``top_k_entries`` of ``user_block`` queries with ``item_block`` entries at a time;
    the k-th score of the tiles before is the next one's floor."""
    kind, margin = near_type(q, x)
    q0, x0 = q.astype(kind), x.astype(kind)
    for who in beside(allow, user_block):
        least, found = floor[who].copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for a in range(0, len(x), item_block):
            b = min(a + item_block, len(x))
            l0, l1 = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
            here = np.flatnonzero(allow[who, l0:l1].any(axis=1))
            if not len(here):
                continue
            new = list(top_k_entries(q[who[here]], x[a:b], starts[a:b + 1], ids, np.clip(bounds[l0:l1 + 1], a, b) - a,
                                     allow[who[here], l0:l1], k, least[here], (q0[who[here]], x0[a:b], margin[who[here]])))
            if new:
                r, i, s = (np.concatenate(c) for c in zip(found, *((here[r], i, s) for r, i, s in new)))
                found = _best(r, i, s, k)
                n = np.bincount(found[0], minlength=len(who))
                full = n >= k
                least[full] = found[2][np.cumsum(n) - 1][full]
        if len(found[0]):
            yield who[found[0]], found[1], found[2]


def _score_blocks(dim: int, k: int, user_block: int, item_block: int | None) -> Callable:
    """Rows of one query pack and one item block each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: np.frombuffer(b.column(c)[i].as_buffer(), np.float64 if c in ("mat", "qmat", "floors") else np.int64)
                       for c in ("lists", "bounds", "starts", "ids", "mat", "query_ids", "floors", "offsets", "probed", "qmat")}
                x, q = row["mat"].reshape(-1, dim), row["qmat"].reshape(-1, dim)
                allow = np.zeros((len(q), len(row["lists"])), bool)
                at = np.minimum(np.searchsorted(row["lists"], row["probed"]), len(row["lists"]) - 1)
                here = row["lists"][at] == row["probed"]
                allow[np.repeat(np.arange(len(q)), np.diff(row["offsets"]))[here], at[here]] = True
                for r, ids, score in found_rows(q, x, row["starts"], row["ids"], row["bounds"], allow, row["floors"]):
                    yield _lists(row["query_ids"], r, ids, score)

    def found_rows(q, x, starts, ids, bounds, allow, floor) -> Iterator[tuple]:
        if item_block is not None and item_block < len(x):
            yield from top_k_tiles(q, x, starts, ids, bounds, allow, k, floor, user_block, item_block)
            return
        kind, margin = near_type(q, x)
        q0, x0 = q.astype(kind), x.astype(kind)
        for who in beside(allow, max(1, SCORE_BUDGET_BYTES // (8 * len(x)))):
            for r, i, score in top_k_entries(q[who], x, starts, ids, bounds, allow[who], k, floor[who], (q0[who], x0, margin[who])):
                yield who[r], i, score
    return run


def _lists(query_ids: np.ndarray, r: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Hits ordered by query as one row per query."""
    who, first = np.unique(r, return_index=True)
    at = pa.array(np.append(first, len(r)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.ListArray.from_arrays(at, pa.array(ids)),
                                       pa.ListArray.from_arrays(at, pa.array(score))], names=["query_id", "item_ids", "scores"])


def _merge_lists(k: int) -> Callable:
    """One list per query of the lists of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query, lists = b.column("query_id").to_numpy(), b.column("_l")
            lo = 0
            while lo < b.num_rows:         # steps of whole queries with EXPAND_ROWS ids, or one query
                part = lists.slice(lo)
                of = part.flatten()
                ids, scores = of.field("item_ids"), of.field("scores")
                row_at = part.offsets.to_numpy() - part.offsets[0].as_py()
                done = (ids.offsets.to_numpy() - ids.offsets[0].as_py())[row_at[1:]]
                n = max(1, int(np.searchsorted(done, EXPAND_ROWS, "right")))
                total = done[n - 1]
                r = np.repeat(np.arange(n), np.diff(np.append(0, done[:n])))
                yield _lists(query[lo:lo + n], *_best(r, ids.flatten().slice(0, total).to_numpy(), scores.flatten().slice(0, total).to_numpy(), k))
                lo += n
    return run


def distinct_entries(postings: DataFrame, k: int) -> DataFrame:
    """Equal vectors of a list once: ``(list_id, vec, ids)`` with the k smallest of their
    ids, ascending. Their scores are equal, so a top k holds no other id of theirs."""
    w = Window.partitionBy("list_id", "vec").orderBy("item_id")
    least = postings.select("list_id", "item_id", "vec").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return least.groupBy("list_id", "vec").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))


def _blocks(entries: DataFrame, dim: int, item_block: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Packed blocks of the entries, which blocks each list is in, and their number.
    Blocks of ``item_block`` entries are packed as many together as fit."""
    sizes = entries.groupBy("list_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("ids")).alias("_ids"))
    # one row per list
    sizes = materialize(sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("list_id")) - F.col("_n")), "list_sizes")
    total, n_ids = (v or 0 for v in sizes.agg(F.sum("_n"), F.sum("_ids")).first())
    block_rows = max(1, BLOCK_BYTES // (8 * (dim + math.ceil(n_ids / max(1, total)))))
    if item_block is not None:
        block_rows = max(1, block_rows // item_block) * item_block
    at = F.floor((F.col("_start") + F.pmod(portable_hash(F.col("ids")[0]), F.col("_n"))) / block_rows)
    dealt = entries.join(sizes, "list_id").select(at.cast("long").alias("block"), "list_id", "ids", "vec")
    spans = sizes.select("list_id", F.explode(F.sequence(
        F.floor(F.col("_start") / block_rows), F.floor((F.col("_start") + F.col("_n") - 1) / block_rows))).alias("block"))
    return materialize(dealt.groupBy("block").applyInArrow(_pack_items(dim), _BLOCK), "item_blocks"), spans, -(-total // block_rows)


def _rows(lists: DataFrame) -> DataFrame:
    """Lists of hits as rows ``(query_id, item_id, score, rank)``."""
    return lists.select("query_id", "scores", F.posexplode("item_ids").alias("_p", "item_id")).select(
        "query_id", "item_id", F.col("scores")[F.col("_p")].alias("score"), (F.col("_p") + 1).alias("rank"))


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """Top-k lists of the blocks' lists."""
    return hits.groupBy("query_id").agg(F.collect_list(F.struct("item_ids", "scores")).alias("_l")).mapInArrow(_merge_lists(k), _HITS)


def _top_lists(routed: DataFrame, entries: DataFrame, dim: int, k: int, user_block: int, item_block: int | None) -> DataFrame:
    """Top-k of routed queries, one row per query that has a hit."""
    hits, final = _block_lists(routed, entries, dim, k, user_block, item_block)
    return hits if final else _merged(hits, k)


def _search(routed: DataFrame, entries: DataFrame, dim: int, k: int, user_block: int, item_block: int | None) -> DataFrame:
    """Top-k of routed queries."""
    return _rows(_top_lists(routed, entries, dim, k, user_block, item_block)).select("query_id", "item_id", "score", "rank")


def block_hits(routed: DataFrame, postings: DataFrame, dim: int, k: int, user_block: int, item_block: int | None) -> tuple[DataFrame, bool]:
    """Rows of each packed block that can be in a query's top-k, and whether no blocks were
    asked for and one holds all, so that their ranks are final."""
    hits, final = _block_lists(routed, materialize(distinct_entries(postings, k), "entries"), dim, k, user_block, item_block)
    return _rows(hits), final and item_block is None


def _block_lists(routed: DataFrame, entries: DataFrame, dim: int, k: int, user_block: int, item_block: int | None) -> tuple[DataFrame, bool]:
    """Lists of the rows of each block that can be in a query's top-k, and whether there is
    but one block, so that they are final. The block with the best list is searched
    first, then the others whose bound reaches the k-th score found there."""
    spark = entries.sparkSession
    items, spans, n_blocks = _blocks(entries, dim, item_block)
    n = spark.sparkContext.defaultParallelism * 4

    def hits(part: DataFrame) -> DataFrame:
        pack = user_block if item_block is None else max(user_block, USER_BLOCK // 4)
        packs = part.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / pack).alias("_packs"))
        # tasks of a block: few packs each, and all cores have one
        splits = F.greatest(F.ceil(F.col("_packs") / SPLIT_PACKS), F.least("_packs", F.lit(-(-n // max(1, n_blocks))))).cast("long")
        packs = packs.withColumn("_splits", splits)
        if n_blocks > 1:
            packs = materialize(packs, "packs")     # one row per block
        rows = part.join(packs, "block").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.col("_packs"))) \
            .withColumn("split", F.floor(F.col("pack") * F.col("_splits") / F.col("_packs")).cast("long"))
        # an explicit partition count is not coalesced: scoring takes far longer than reading
        packed = rows.select("block", "split", "pack", "query_id", "qvec", "lists", "floor").repartition(n, "block", "pack") \
            .groupBy("block", "split", "pack").applyInArrow(_pack_queries, _PACK)
        if n_blocks > 1:        # a block goes to each of its tasks, whatever the number of its queries
            copies = items.join(F.broadcast(packs.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_splits") - 1)).alias("split"))), "block")
            joined = packed.repartition(n, "block", "split").join(copies.repartition(n, "block", "split"), ["block", "split"])
        else:
            joined = packed.join(F.broadcast(items), "block")       # at most BLOCK_BYTES
        return joined.mapInArrow(_score_blocks(dim, k, user_block, item_block), _HITS)
    routed = routed.dropDuplicates(["query_id"])
    if n_blocks <= 1:       # every list is in it
        return hits(materialize(routed.select(F.lit(0).cast("long").alias("block"), "query_id", "qvec", "lists",
                                              F.lit(float("-inf")).alias("floor")), "targets")), True
    routed = materialize(routed, "routed")
    probes = routed.select("query_id", F.posexplode(F.arrays_zip("lists", "bounds")).alias("_p", "_l"))         .select("query_id", "_p", F.col("_l.lists").alias("list_id"), F.col("_l.bounds").alias("bound"))
    targets = materialize(probes.join(spans, "list_id").groupBy("query_id", "block").agg(
        F.collect_list("list_id").alias("lists"), F.min("_p").alias("_p"), F.max("bound").alias("bound")), "targets")
    # the lists that a query has in no block are empty: the first list that has rows counts
    lead = targets.groupBy("query_id").agg(F.min("_p").alias("_first"))
    targets = targets.join(lead, "query_id").join(routed.select("query_id", "qvec"), "query_id")
    first = hits(targets.where("_p = _first").withColumn("floor", F.lit(float("-inf"))))
    first = materialize(first, "first_hits")
    floors = first.groupBy("query_id").agg(F.max(F.when(F.size("scores") == k, F.col("scores")[k - 1])).alias("floor"))
    rest = targets.where("_p > _first").join(floors, "query_id", "left") \
        .withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).where("bound >= floor")
    return first.unionByName(hits(rest)), False


def _route(queries: DataFrame, centroids: DataFrame, dim: int, n_probe: int) -> DataFrame:
    """Queries with their best ``n_probe`` lists."""
    found = _centroid_matrix(centroids, dim)
    if found is not None:
        return _routed(queries, found, dim, n_probe)
    routed, lists = _probe_cells(queries, centroids, dim, n_probe)
    lists = lists.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("_l")).select(
        "query_id", F.col("_l.item_id").alias("lists"), F.transform("_l", lambda _: F.lit(float("inf"))).alias("bounds"))
    return routed.select("query_id", "qvec").join(lists, "query_id")


def ann_search(queries: DataFrame, postings: DataFrame, centroids: DataFrame, dim: int,
               k: int = DEFAULT_K, n_probe: int = DEFAULT_N_PROBE, user_block: int = USER_BLOCK,
               item_block: int | None = None, as_lists: bool = False) -> DataFrame:
    """Top-k items per query over the ``n_probe`` best lists.

    ``queries(query_id, vec)`` -> ``(query_id, item_id, score, rank)``; queries
    are clamp-normalised, slots that cannot be filled are dropped, k is capped
    at the catalogue size implicitly. ``n_probe >= n_lists`` is exact search (J10).
    ``item_block`` overrides the entries of a block. ``as_lists`` leaves one row per query
    that has a hit: ``(query_id, item_ids, scores)``."""
    entries = materialize(distinct_entries(postings, k), "entries")
    found = _top_lists if as_lists else _search
    return found(_route(queries, centroids, dim, n_probe), entries, dim, k, user_block, item_block)


def ann_lists(queries: DataFrame, postings: DataFrame, centroids: DataFrame, dim: int,
              k: int = DEFAULT_K, n_probe: int = DEFAULT_N_PROBE, user_block: int = USER_BLOCK,
              item_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """R4 as one row per query that has a hit: ``(query_id, item_ids, scores)``, best first;
    and ``item_id`` of the items that can be hits at all."""
    entries = materialize(distinct_entries(postings, k), "entries")
    hits = _top_lists(_route(queries, centroids, dim, n_probe), entries, dim, k, user_block, item_block)
    return hits, entries.select(F.explode("ids").alias("item_id")).distinct()


def ann_batch_search(queries: DataFrame, postings: DataFrame, centroids: DataFrame, dim: int,
                     k: int = DEFAULT_K, n_probe: int = DEFAULT_N_PROBE, **kw) -> DataFrame:
    """Like R4 but every query has ``min(k, n_items)`` slots; unfilled slots hold
    item -1 with score -FLT_MAX."""
    n_items = postings.count()
    slots = min(k, n_items)
    found, _ = ann_lists(queries, postings, centroids, dim, k, n_probe, **kw)
    # one row per query meets its list; the slots fan out last
    j = queries.select(F.col("query_id").cast("long").alias("query_id")).join(found, "query_id", "left") \
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("rank"))
    return j.select("query_id", "rank", F.coalesce(F.get("item_ids", F.col("rank") - 1), F.lit(-1).cast("long")).alias("item_id"),
                    F.coalesce(F.get("scores", F.col("rank") - 1), F.lit(UNFILLED_SCORE)).alias("score"))


def exact_search(queries: DataFrame, postings: DataFrame, centroids: DataFrame, dim: int,
                 k: int = DEFAULT_K, **kw) -> DataFrame:
    """J10 + T2: exhaustive inner-product top-k (all lists probed)."""
    n_lists = centroids.count()
    return ann_search(queries, postings, centroids, dim, k, n_lists, **kw)


def ann_recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query, share of the exact top-k found by the pruned search. Both are rows, or
    both lists, one row per query; lists meet without fanning out."""
    if "item_ids" in exact.columns:
        pair = exact.select("query_id", F.col("item_ids").alias("_e")).join(approx.select("query_id", F.col("item_ids").alias("_a")), "query_id", "left")
        found = F.coalesce(F.size(F.filter("_e", lambda i: F.array_contains("_a", i))), F.lit(0))
        return pair.select("query_id", (F.when(F.col("_a").isNull(), 0).otherwise(found) / F.size("_e")).alias("recall"))
    e = exact.select("query_id", "item_id")
    hits = e.join(approx.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi") \
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    tot = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"))
    return tot.join(hits, "query_id", "left").select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.col("n_exact")).alias("recall"))


def save_index(centroids: DataFrame, postings: DataFrame, path: str) -> None:
    """The index is two Parquet tables; postings are partitioned by list so a
    probe reads only its lists' files."""
    centroids.write.mode("overwrite").parquet(os.path.join(path, "centroids"))
    postings.repartition("list_id", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("overwrite").partitionBy("list_id").parquet(os.path.join(path, "postings"))


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(os.path.join(path, "centroids")),
            spark.read.schema("item_id long, vec array<double>, list_id long").parquet(os.path.join(path, "postings")))


def probed_postings(queries: DataFrame, postings: DataFrame, centroids: DataFrame, dim: int, n_probe: int = DEFAULT_N_PROBE) -> DataFrame:
    """The postings of the lists that any of the queries probes. On a saved index
    Spark prunes the other lists' files at run time: the probed list ids are a
    broadcast side of at most one row per list."""
    live = materialize(probe(queries, centroids, dim, n_probe).select("list_id", "probe_rank"), "probed")
    live = live.where(F.col("probe_rank") <= n_probe).select("list_id").distinct()
    return postings.join(live, "list_id", "left_semi")
