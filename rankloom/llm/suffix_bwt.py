"""Suffix-array dedup of bytes by threshold-bounded interval expansion.

Candidate passages come from `passages` (seeds of 24 bytes in windows of 100).
Each shard's passages are joined to one text; its suffixes are sorted, and the
common-prefix boundaries are found on the Burrows-Wheeler transform alone:
starting from the empty string, all intervals of one length are extended
backward by every byte at once; an interval end not seen before has a common
prefix of exactly that length, and just those intervals go on. The expansion
stops at the minimum length: suffixes with no boundary between them then share
at least so many bytes. Of each such group the earliest place stays.

Defined results: null or empty text has no bytes; texts under ``min_bytes``
lose none; places are ordered by doc_id (null first), then position; rows that
repeat an id with the same text are one document, with another text they are
ordered by the text's hash; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common, passages

SEED_BYTES = 24
MIN_BYTES = 100
_END = 0xFF   # never occurs in UTF-8


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` ordered by their first ``depth`` bytes or more."""
    n = len(text)
    twice = np.concatenate((text, np.resize(text, 8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | twice[i:i + n]
    have = 8
    while True:
        order = np.argsort(key)
        k = key[order]
        step = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        if have >= depth or step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank * n + np.roll(rank, -(have % n))
        have *= 2


def common_prefix_groups(text: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text``, and a group number per rank: ranks of one
    group have at least ``min_length`` bytes in common."""
    n = len(text)
    order = sorted_suffixes(text, min_length + 1)
    bwt = text[order - 1]
    # where each row's rotation goes when its preceding byte is put in front
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    slot, source = np.full(n, -1), np.empty(n, np.int64)
    left, right = np.array([0]), np.array([n])
    for _ in range(min_length):
        size = right - left
        total = int(size.sum())
        if not total:
            break
        start = np.cumsum(size) - size
        rows = np.arange(total) - np.repeat(start - left, size)
        interval = np.repeat(np.arange(len(size)), size)
        to = back[rows]
        if total * 8 > n:   # order by scattering: the targets are distinct ranks
            slot[to] = interval
            source[to] = rows
            to = np.flatnonzero(slot >= 0)
            interval, symbol = slot[to], bwt[source[to]]
            slot[to] = -1
        else:
            by = np.argsort(to)
            to, interval, symbol = to[by], interval[by], bwt[rows[by]]
        head = np.flatnonzero(np.concatenate(([True], (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1]))))
        lo = to[head]
        hi = lo + np.diff(np.concatenate((head, [total])))
        new = ~closed[hi]
        # the interval that ends the table has no boundary after it, but must be extended
        keep = new | (hi == n)
        closed[hi[new]] = True
        left, right = lo[keep], hi[keep]
    return order, np.cumsum(closed[:n])


def _solve(min_bytes: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """Windows of one shard that also start at an earlier place."""
        table = table.combine_chunks()
        bodies = table.column("body").to_pylist()
        lens = np.fromiter((len(b) for b in bodies), np.int64, len(bodies))
        starts = np.cumsum(lens + 1) - lens - 1
        text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
        order, group = common_prefix_groups(text, min_bytes)
        # every window of a piece, with its place
        piece = np.repeat(np.arange(len(bodies)), lens - min_bytes + 1)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(lens - min_bytes + 1) - (lens - min_bytes + 1),
                                                   lens - min_bytes + 1)
        group_at = np.empty(len(text), np.int64)
        group_at[order] = group
        g = group_at[starts[piece] + offset]
        loc = table.column("loc").to_numpy() // passages._LOC
        docs = pa.table({"d": table.column("doc_id"), "t": table.column("_tk")}).to_pandas()
        # null ids sort first, as the smallest
        rank = docs.sort_values(["d", "t"], na_position="first").groupby(["d", "t"], sort=False, dropna=False).ngroup()
        rank = rank.reindex(docs.index).to_numpy()
        at = loc[piece] + offset
        by = np.lexsort((at, rank[piece], g))
        same = np.concatenate(([False], g[by][1:] == g[by][:-1]))
        lead = np.flatnonzero(~same)
        lead = by[lead[np.cumsum(~same) - 1]]   # the earliest of each window's group
        later = (rank[piece][by] != rank[piece][lead]) | (at[by] != at[lead])
        gone = np.zeros(len(piece), bool)
        gone[by[same & later]] = True
        idx = np.flatnonzero(gone)
        if len(idx):
            cut = np.concatenate(([True], (idx[1:] != idx[:-1] + 1) | (piece[idx][1:] != piece[idx][:-1])))
            first = np.flatnonzero(cut)
            n = np.diff(np.concatenate((first, [len(idx)])))
            idx = idx[first]
        else:
            n = idx
        rows = pa.array(piece[idx])
        return pa.table({"doc_id": table.column("doc_id").take(rows), "_tk": table.column("_tk").take(rows),
                         "loc": common.longs(at[idx] * passages._LOC + n)})
    return run


def removal_runs(docs: DataFrame, min_bytes: int = MIN_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """Runs of windows that also start earlier: ``doc_id, _tk, loc``."""
    k = min(seed_bytes, min_bytes)
    occ = passages.repeated_pieces(docs, "byte", k, min_bytes)
    distinct = passages.distinct_pieces(occ)
    twins = distinct.where("copies > 1").select(F.col("seed").alias("_s"), F.col("piece").alias("_p"), "rep")
    whole = occ.join(twins, (F.col("seed") == F.col("_s")) & (F.col("piece") == F.col("_p"))) \
        .where(~F.struct("doc_id", "_tk", "loc").eqNullSafe(F.col("rep"))).select("doc_id", "_tk", "loc")
    shard, parts, first = passages.shards(docs, distinct.where("multi"), "byte", min_bytes, k)
    found = shard.groupBy("shard").applyInArrow(_solve(min_bytes), "doc_id long, _tk long, loc long")
    # of equal parts all but the earliest go; the place is a part of the join's key, so a hot part is spread
    again = parts.join(first, common.same_key(parts, first) & (parts["loc"] == first["loc"])
                       & (parts["key"] == first["key"]) & (parts["same"] == first["same"]), "left_anti") \
        .select("doc_id", "_tk", "loc")
    return whole.unionByName(common.materialize(found, "found")).unionByName(again)


def _apply(min_bytes: int, with_bytes: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in common.pieces_of(b.num_rows, 256):
                part = b.slice(lo, hi - lo)
                total, removed, spans, sha, kept = [], [], [], [], []
                for text, locs in zip(common.unpack(part.column(1)), part.column(2).to_pylist()):
                    rest, n = text, 0
                    if locs:
                        gone = passages.covered(len(text), locs, min_bytes)
                        rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                        n = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
                    total.append(len(text))
                    removed.append(len(text) - len(rest))
                    spans.append(n)
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                cols = [part.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(sha)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_bytes:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def dedup_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, seed_bytes: int = SEED_BYTES,
                with_bytes: bool = True) -> DataFrame:
    """Remove every byte covered by a ``min_bytes`` string that also starts
    earlier in the corpus. Per document row: counts, the SHA-256 of the kept
    bytes and (``with_bytes``) the kept bytes themselves, which may cut a
    character."""
    common.prepare(docs.sparkSession)
    runs = passages.spans_by_document(removal_runs(docs, min_bytes, seed_bytes))
    texts = common.packed(docs)
    both = texts.join(runs, common.same_key(texts, runs), "left").select(texts["doc_id"], "z", "locs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return both.mapInArrow(_apply(min_bytes, with_bytes), schema + (", kept binary" if with_bytes else ""))


def op6_suffix_bwt(spark, sf_dir: str) -> DataFrame:
    """Suffix-array dedup of the whole ``documents`` table, 100 bytes."""
    return dedup_bytes(common.documents(spark, sf_dir), with_bytes=False)


#: windows by digest (on the hex form), runs of those with an earlier place as islands, and the bytes between
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS t FROM documents),
x AS (SELECT doc_id, unnest([md5(substr(t, 2 * i + 1, 200)) FOR i IN range(0, len(t) // 2 - 99)]) AS h,
             unnest(range(0, len(t) // 2 - 99)) AS i FROM d WHERE len(t) >= 200),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM x),
hit AS (SELECT doc_id, i FROM n WHERE r > 1),
cut AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS c FROM hit),
grp AS (SELECT *, SUM(c) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
isl AS (SELECT doc_id, MIN(i) AS s, MAX(i) + 100 AS e FROM grp GROUP BY doc_id, g),
gap AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM isl),
kept AS (SELECT doc_id, string_agg(substr(t, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS head, MAX(e) AS tail,
                SUM(e - s)::BIGINT AS n_removed, COUNT(*) AS n_spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(t) // 2)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN t ELSE head || substr(t, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
