"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become integers (``floor(SCALE * x)``), dealt to blocks of about
``BLOCK_ROWS`` rows. A block is indexed by dimension: its rows by descending size of
their value, so values of one quantised level form a posting segment. For a batch of
queries a segment's impact is the largest weight in its dimension times its value.

1. All segments of a block are processed by descending impact, quantised to
   ``LEVELS`` levels, into one accumulator per row and query. The values that are left
   in each dimension bound from both sides what a row can still gain.
2. A row is a possible member of a query's list while accumulator + upper bound
   reaches the k-th accumulator + lower bound, or the k-th score known from earlier
   blocks. The scan stops when these rows are proved to hold the answers and cost less
   to score than to go on; nothing stops it otherwise than the end of the postings.
3. Possible members are rescored exactly in 64-bit integers.

Blocks are searched in rounds of geometrically growing size. After a round the
k-th score of each query is its threshold, and later blocks return only rows that
reach it: about ``GROWTH * k`` rows a query and round, whatever the number of
blocks. Queries meet blocks by a join on (block, slot), in rows of bounded size.

Defined results: null vectors, and vectors with null or non-finite components,
take no part; shorter vectors are filled with zeros (an empty one scores 0); a
null id is a candidate (ties last), never a query; rows equal in id and vector
are one row, other repeats of an id are rows of their own, and none of them is a
candidate of a query with that id; ties go to the smaller id; an empty table has
an empty result; inner products must fit 64 bits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import common

TOP = 20
CHECKS = (0.5, 0.75, 0.875, 0.9375, 0.96875)    # shares of the postings after which a stop is tried
QUERY_EVERY = 20        # ids divisible by this are queries
SCALE = 64.0
BLOCK_ROWS = 4096
BATCH_QUERIES = 128
GROWTH = 8              # blocks of a round against those before it
LEVELS = 64
_NO_ID = np.iinfo(np.int64).max

_BLOCK = "block long, ids binary, named binary, mat binary, perm binary"
_BATCH = "batch long, ids binary, keys binary, mat binary, floors binary"
_HIT = "query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, q`` (array of long) and ``key``, a hash of the two."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("v").isNotNull() & fine)
    q = v.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(SCALE) * x)).alias("q")).distinct()
    return q.withColumn("key", F.xxhash64("vec_id", "q"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _build(width: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """The index of one block."""
        ids = table.column("vec_id").combine_chunks()
        mat = _matrix(table.column("q"), width)
        perm = np.argsort(-np.abs(mat), axis=0, kind="stable").T.astype(np.int32)
        return pa.table({"block": table.column("block").slice(0, 1), "ids": [ids.fill_null(_NO_ID).to_numpy().tobytes()],
                         "named": [np.array(ids.is_valid()).tobytes()], "mat": [mat.tobytes()],
                         "perm": [np.ascontiguousarray(perm).tobytes()]},
                        schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "named", "mat", "perm"))]))
    return run


def index(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """One row per block: ids, vectors, and each dimension's rows by descending size of the value."""
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks)))
    return common.materialize(dealt.select("block", "vec_id", "q").groupBy("block").applyInArrow(_build(width), _BLOCK), "impact_index")


def _batches(width: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "key", "floor")}
        return pa.table({"batch": table.column("batch").slice(0, 1), "ids": [cols["vec_id"].tobytes()], "keys": [cols["key"].tobytes()],
                         "mat": [_matrix(table.column("q"), width).tobytes()], "floors": [cols["floor"].tobytes()]},
                        schema=pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("ids", "keys", "mat", "floors"))]))
    return run


class Block:
    """Posting segments of one block, read from its index row."""

    def __init__(self, ids: bytes, named: bytes, mat: bytes, perm: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.named = np.frombuffer(named, bool)
        n = self.n = len(self.ids)
        self.mat = np.frombuffer(mat, np.int64).reshape(n, width)
        self.perm = np.frombuffer(perm, np.int32).reshape(width, n)
        self.value = np.take_along_axis(self.mat.T, self.perm, axis=1)
        self.size = np.abs(self.value)
        # largest and smallest value from each place on; nothing is left after the last one
        none = np.zeros((width, 1), np.int64)
        self.high = np.hstack((np.maximum.accumulate(self.value[:, ::-1], axis=1)[:, ::-1], none))
        self.low = np.hstack((np.minimum.accumulate(self.value[:, ::-1], axis=1)[:, ::-1], none))
        self.by_id = np.argsort(self.ids, kind="stable")

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have the id of a query, and the query's number."""
        keys = self.ids[self.by_id]
        a, b = np.searchsorted(keys, ids, "left"), np.searchsorted(keys, ids, "right")
        query = np.repeat(np.arange(len(ids)), b - a)
        rows = self.by_id[np.arange(len(query)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        keep = self.named[rows]
        return rows[keep], query[keep]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, rows and scores of this block's rows that can be among the
        ``k`` best of a query and reach its floor, best first."""
        weight = np.abs(q).max(axis=0)
        impact = weight[:, None] * self.size
        reach = int((weight * self.size[:, 0]).sum())
        # sums of integers are exact in floating point up to its precision; beyond, the proof keeps a distance
        kind, slack = (np.float32, 0.0) if reach < 1 << 24 else (np.float64, 0.0 if reach < 1 << 53 else reach * 2.0**-40)
        acc = np.zeros((self.n, len(q)), kind)
        rows, number = self.own(own)
        acc[rows, number] = -np.inf
        total, done = impact.size, np.zeros(len(weight), np.int64)
        most = int(impact.max())
        # end of each level in each dimension, from the highest level down
        bars = most * (np.arange(LEVELS - 1, -1, -1) / LEVELS)
        ends = np.stack([np.searchsorted(-i, -bars, side="right") for i in impact])
        ends[:, -1] = self.n
        share = ends.sum(axis=0) / total
        checks = sorted({int(np.searchsorted(share, c)) for c in CHECKS} | {LEVELS - 1})
        weights = q.T.astype(kind)
        possible = None
        for level in checks:
            for d in np.flatnonzero(ends[:, level] > done):
                a, b = done[d], ends[d, level]
                at = self.perm[d, a:b]              # a row is in a dimension once
                part = acc[at]
                part += np.multiply.outer(self.value[d, a:b].astype(kind), weights[d])
                acc[at] = part
            done = ends[:, level]
            left = np.arange(len(weight)), done
            up = np.maximum(q * self.high[left], q * self.low[left]).sum(axis=1)
            down = np.minimum(q * self.high[left], q * self.low[left]).sum(axis=1)
            bar = floors.astype(np.float64)
            if self.n >= k:
                kth = np.partition(acc, self.n - k, axis=0)[self.n - k].astype(np.float64)
                bar = np.maximum(bar, kth + down)
            possible = (acc >= bar - up - 2 * slack) & (acc > -np.inf)
            todo = (total - int(done.sum())) * len(q)
            if np.count_nonzero(possible) * len(weight) <= todo:
                break       # proved: no other row can be a member, and these are cheaper to score
        number, rows = np.nonzero(possible.T)
        score = np.concatenate([(self.mat[rows[i:j]] * q[number[i:j]]).sum(axis=1) for i, j in common.pieces_of(len(rows), 1 << 16)]
                               or [np.zeros(0, np.int64)])
        fine = score >= floors[number]
        number, rows, score = number[fine], rows[fine], score[fine]
        by = np.lexsort((self.ids[rows], ~self.named[rows], -score, number))
        number, rows, score = number[by], rows[by], score[by]
        keep = np.arange(len(rows)) - np.searchsorted(number, number) < k
        return number[keep], rows[keep], score[keep]


def _search(width: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in ("block", "q_ids", "q_keys", "q_mat", "q_floors")}
                if number != row["block"]:
                    block = Block(*(b.column(c)[r].as_py() for c in ("ids", "named", "mat", "perm")), width)
                    number = row["block"]
                ids, keys, floors = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_keys", "q_floors"))
                q, rows, score = block.search(np.frombuffer(row["q_mat"], np.int64).reshape(len(ids), width), ids, k, floors)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[q]), pa.array(block.ids[rows], mask=~block.named[rows]),
                                                  common.longs(score)], names=["query_id", "query_key", "vec_id", "score"])
    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query by
    inner product, over ``quantised`` rows and queries."""
    spark = rows.sparkSession
    common.prepare(spark)
    rows, queries = common.materialize(rows, "vectors"), common.materialize(queries, "queries")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    n_queries, width_q = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    width = max(width or 0, width_q or 0, 1)
    blocks, batches = max(1, -(-n // block_rows)), max(1, -(-n_queries // BATCH_QUERIES))
    table = index(rows, width, blocks)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best, first, size = None, 0, 1
    while first < blocks:
        last = min(blocks, first + size)
        floors = queries
        if best is None:
            floors = floors.withColumn("floor", F.lit(None).cast("long"))
        else:
            full = best.groupBy("query_id", "query_key").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")) \
                .where(F.col("_n") >= k).select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"), "floor")
            floors = floors.join(full, ["vec_id", "key"], "left")
        floors = floors.withColumn("floor", F.coalesce("floor", F.lit(-2**63).cast("long"))) \
            .withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)))
        packed = common.materialize(floors.select("batch", "vec_id", "key", "q", "floor").groupBy("batch")
                                    .applyInArrow(_batches(width), _BATCH), "query_batches")
        # every block of the round meets every batch: blocks are repeated by slot, batches by block
        slots = max(1, min(batches, 4 * spark.sparkContext.defaultParallelism // (last - first)))
        left = table.where((F.col("block") >= first) & (F.col("block") < last)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        right = packed.select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long"))).alias("block"),
                              F.pmod("batch", F.lit(slots)).cast("int").alias("slot"),
                              *[F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "mat", "floors")])
        parts = (last - first) * slots
        both = left.repartition(parts, "block", "slot").join(right.repartition(parts, "block", "slot"), ["block", "slot"])
        hits = common.materialize(both.mapInArrow(_search(width, k), _HIT), "hits")
        hits = hits if best is None else best.select(hits.columns).unionByName(hits)
        best = common.materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        first, size = last, size * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


def op12_impact_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best rows of ``embeddings`` for each row with an id divisible by 20."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


SQL = r"""
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, a.q, b.vec_id,
             list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
