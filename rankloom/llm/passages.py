"""Passages that share a window: the candidate search behind both exact
substring operators (`substring_sam`, `suffix_bwt`).

1. Every window of the corpus is assigned one content-defined seed
   (`textops.seeds`); equal windows have equal seeds. A seed with the windows
   it stands for is a *piece* (a few dozen values). Rows: one per piece.
2. Seeds that occur once are dropped: none of their windows repeats.
3. Pieces are grouped by content with map-side aggregation, so thousands of
   copies become one *distinct piece* with a count and its first place.
4. Distinct pieces that can share windows with others (or have copies) need a
   look at single windows. Their texts are cut out once and dealt to shards by
   seed. Pieces of a seed with very many distinct pieces are cut into parts by the
   seed's place in a window (`_hot_parts`): parts that cannot share a window get
   different keys, equal ones are grouped by content with map-side aggregation, and
   one of them is dealt with the number of its places and the first one. So no shard
   grows with a hot seed or a hot window, and a piece has few parts.

The shards are then solved by the operator's own index structure.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.textops import Rolling, Words, byte_values, chunks, mix, seeds

#: distinct pieces that one shard holds on average, and of one seed or key before its pieces are cut further
SHARD_PIECES = 2000
HOT_PIECES = 1000
SPLIT = 4    # parts of a piece, and of a part
_LOC = 256   # windows of one piece stay below


def _values(texts: list[bytes], unit: str):
    """Hash value of each word or byte, and the text number it belongs to."""
    if unit == "word":
        w = Words(texts)
        return w.hashes(), w.doc(), w.first, w
    buf = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return byte_values(buf), np.repeat(np.arange(len(texts)), lens), np.cumsum(lens) - lens, None


def _seed_rows(unit: str, k: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.binaries(b.column(2))
            for i, j in chunks(texts):
                values, owner, first, _ = _values(texts[i:j], unit)
                _, h, win, n = seeds(values, owner, k, window)
                if not len(h):
                    continue
                whole = Rolling(values).slices(win, win + n + window - 1)
                rows = owner[win]
                at = pa.array(rows + i)
                yield pa.RecordBatch.from_arrays(
                    [common.longs(h), common.longs(whole), b.column(0).take(at), b.column(1).take(at),
                     common.longs((win - first[rows]) * _LOC + n)],
                    names=["seed", "piece", "doc_id", "_tk", "loc"])
    return run


def seed_rows(docs: DataFrame, unit: str, k: int, window: int) -> DataFrame:
    """One row per piece: ``seed, piece`` (hashes), the document key, and
    ``loc = first window * 256 + windows``."""
    if window - k + 1 >= _LOC:
        raise ValueError("window - k + 1 must stay below the run limit")
    return common.keyed(docs).mapInArrow(
        _seed_rows(unit, k, window), "seed long, piece long, doc_id long, _tk long, loc long")


def repeated_pieces(docs: DataFrame, unit: str, k: int, window: int) -> DataFrame:
    """Pieces whose seed occurs at least twice, with ``multi``: the seed has
    several distinct pieces. Written once."""
    counts = seed_rows(docs, unit, k, window).groupBy("seed") \
        .agg(F.count(F.lit(1)).alias("_m"), F.min("piece").alias("_a"), F.max("piece").alias("_b")) \
        .where("_m > 1").select("seed", (F.col("_a") != F.col("_b")).alias("multi"))
    counts = common.materialize(counts, "seeds")    # a table of its own: Spark can split a hot seed's side of the join
    occ = seed_rows(docs, unit, k, window).join(counts, "seed")
    return common.materialize(occ, "pieces")


def distinct_pieces(occ: DataFrame) -> DataFrame:
    """Per distinct piece: how often it occurs, and its first place."""
    place = F.struct("doc_id", "_tk", "loc")
    out = occ.groupBy("seed", "piece").agg(
        F.count(F.lit(1)).alias("copies"), F.min(place).alias("rep"), F.max("multi").alias("multi"))
    return common.materialize(out, "distinct")


_CUT = "seed long, piece long, copies long, loc long, hot boolean, doc_id long, _tk long, body binary"


def _cut(unit: str, window: int) -> Callable:
    """Values and texts of pieces out of whole documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in common.pieces_of(b.num_rows, 64):
                part = b.slice(lo, hi - lo)
                texts = common.unpack(part.column(2))
                out = {k: [] for k in ("seed", "piece", "copies", "loc", "hot", "row", "body")}
                for r, (text, want) in enumerate(zip(texts, part.column(3).to_pylist())):
                    words = text.split() if unit == "word" else None
                    for p in want:
                        first, n = p["loc"] // _LOC, p["loc"] % _LOC
                        stop = first + n + window - 1
                        out["body"].append(b" ".join(words[first:stop]) if words is not None else text[first:stop])
                        for c in ("seed", "piece", "copies", "loc", "hot"):
                            out[c].append(p[c])
                        out["row"].append(r)
                at = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[c], pa.int64()) for c in ("seed", "piece", "copies", "loc")]
                    + [pa.array(out["hot"], pa.bool_()), part.column(0).take(at), part.column(1).take(at),
                       pa.array(out["body"], pa.binary())],
                    names=["seed", "piece", "copies", "loc", "hot", "doc_id", "_tk", "body"])
    return run


def _seed_place(unit: str, k: int, window: int) -> Callable:
    """Whole pieces as parts: ``at``, the place of the seed in the piece, and the
    range ``a <= place of the seed in a window < b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, seed = b.column("body").to_pylist(), b.column("seed").to_numpy().view(np.uint64)
            for lo, hi in common.pieces_of(len(bodies), 512):
                values, owner, first, _ = _values(bodies[lo:hi], unit)
                grams = Rolling(values).windows(k)
                hit = np.flatnonzero(grams == seed[lo:hi][owner[:len(grams)]])
                at = np.full(hi - lo, len(values))
                np.minimum.at(at, owner[hit], hit - first[owner[hit]])     # the leftmost, as seeds() has it
                cols = {c: b.column(c).slice(lo, hi - lo) for c in _ROW}
                yield pa.RecordBatch.from_arrays(
                    [*cols.values(), common.longs(np.zeros(hi - lo, np.int64)), common.longs(np.full(hi - lo, window - k + 1)),
                     common.longs(at)], names=[*_ROW, "a", "b", "at"])
    return run


def _split(unit: str, window: int) -> Callable:
    """Each part cut into ``SPLIT`` narrower ranges of the seed's place. ``key`` names
    seed, range and the values that all windows of that range contain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column("body").to_pylist()
            num = {c: b.column(c).to_numpy() for c in ("loc", "a", "b", "at")}
            seed = b.column("seed").to_numpy().view(np.uint64)
            for lo, hi in common.pieces_of(len(bodies), 512):
                values, _, first, _ = _values(bodies[lo:hi], unit)
                cut, body = [], []
                for r in range(lo, hi):
                    loc, low, high, at = (int(num[c][r]) for c in ("loc", "a", "b", "at"))
                    units = bodies[r].split(b" ") if unit == "word" else bodies[r]
                    step = -(-(high - low) // SPLIT)
                    for x in range(low, high, step):
                        y = min(high, x + step)
                        i, j = max(0, at - y + 1), min(loc % _LOC - 1, at - x)
                        if i <= j:
                            cut.append((r, x, y, (loc // _LOC + i) * _LOC + j - i + 1, at - i,
                                        first[r - lo] + at - x, first[r - lo] + at - y + 1 + window))
                            part = units[i:j + window]
                            body.append(b" ".join(part) if unit == "word" else part)
                if not cut:
                    continue
                r, x, y, loc, at, core, stop = np.array(cut, np.int64).T
                key = mix(Rolling(values).slices(core, stop) ^ mix(seed[r] + (x * _LOC + y).astype(np.uint64)))
                rows = pa.array(r)
                own = {c: b.column(c).take(rows) for c in _ROW}
                own |= {"loc": common.longs(loc), "body": pa.array(body, pa.binary())}
                yield pa.RecordBatch.from_arrays([*own.values(), *map(common.longs, (x, y, at, key))], names=[*_ROW, "a", "b", "at", "key"])
    return run


_ROW = ("seed", "piece", "copies", "loc", "doc_id", "_tk", "body")
_PART = "seed long, piece long, copies long, loc long, doc_id long, _tk long, body binary, a long, b long, at long"


def _hot_parts(pieces: DataFrame, unit: str, k: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of hot seeds, narrowed until parts with one key are few.

    All windows of a part have the seed in one range of places, so they share the
    values around it: parts that differ there cannot have a window in common and get
    different keys, and a key of one place is done. Keys with many distinct parts are
    narrowed further, down to single windows. Equal windows have equal keys at every
    level.

    Returns the distinct parts (``key, same``, their number of places, the first one,
    their text), and the parts of all pieces by ``key, same``."""
    parts = pieces.mapInArrow(_seed_place(unit, k, window), _PART)
    distinct, places = [], []
    while True:
        parts = common.materialize(parts.mapInArrow(_split(unit, window), _PART + ", key long").withColumn("same", F.xxhash64("body")), "parts")
        once = parts.groupBy("key", "same").agg(
            F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "_tk", "loc")).alias("rep"), F.first("body").alias("body"),
            F.max(F.col("b") - F.col("a")).alias("width"))
        once = common.materialize(once, "once")
        keys = once.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("copies").alias("_c"), F.max("width").alias("_w"))
        hot = (F.col("_n") > HOT_PIECES) & (F.col("_w") > 1)
        keys = common.materialize(keys.where("_c > 1").select("key", hot.alias("_hot")), "keys")
        final = keys.where("NOT _hot").select("key")
        distinct.append(once.join(final, "key", "left_semi").drop("width"))
        places.append(parts.join(final, "key", "left_semi").select("key", "same", "seed", "piece", "loc", "doc_id", "_tk"))
        again = keys.where("_hot").select("key")
        if again.isEmpty():
            return reduce(DataFrame.unionByName, distinct), reduce(DataFrame.unionByName, places)
        parts = parts.join(again, "key", "left_semi").drop("key", "same")


def shards(docs: DataFrame, distinct: DataFrame, unit: str, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of the given distinct pieces, with the number of their ``shard``:
    pieces that share a window share the shard. Shards have a bounded size.
    ``seed, piece`` name the piece that a text is from, ``loc`` its place.

    A text that is ``hot`` is a part for all that equal it; these are the second
    result: ``key, same`` (the text's ``seed, piece``), the ``seed, piece`` that the
    part is from, and its place. The third has the first place of each text."""
    hot = distinct.groupBy("seed").count().where(F.col("count") > HOT_PIECES).select("seed", F.lit(True).alias("_hot"))
    want = distinct.join(hot, "seed", "left").select(
        F.col("rep.doc_id").alias("doc_id"), F.col("rep._tk").alias("_tk"),
        F.struct("seed", "piece", "copies", F.col("rep.loc").alias("loc"),
                 F.coalesce("_hot", F.lit(False)).alias("hot")).alias("p"))
    want = want.groupBy("doc_id", "_tk").agg(F.collect_list("p").alias("want"))
    texts = common.packed(docs)
    both = texts.join(want, common.same_key(texts, want)).select(texts["doc_id"], texts["_tk"], "z", "want")
    cut = common.materialize(both.mapInArrow(_cut(unit, window), _CUT), "cut")
    plain = cut.where("not hot").select(F.col("seed").alias("key"), *cut.columns)
    # a repeated row of the table gives its piece twice: one is enough
    once, places = _hot_parts(cut.where("hot").select(*_ROW).dropDuplicates(["seed", "piece"]), unit, k, window)
    once = common.materialize(once.select(
        "key", F.col("key").alias("seed"), F.col("same").alias("piece"), "copies", F.col("rep.loc").alias("loc"),
        F.lit(True).alias("hot"), F.col("rep.doc_id").alias("doc_id"), F.col("rep._tk").alias("_tk"), "body"), "windows")
    n = max(1, math.ceil((plain.count() + once.count()) / SHARD_PIECES))
    first = once.select("key", F.col("piece").alias("same"), "doc_id", "_tk", "loc")
    return plain.unionByName(once).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n))), places, first


def spans_by_document(spans: DataFrame) -> DataFrame:
    """Window runs ``(doc_id, _tk, loc)`` gathered per document."""
    return spans.groupBy("doc_id", "_tk").agg(F.collect_list("loc").alias("locs"))


def covered(n: int, locs, window: int) -> np.ndarray:
    """Which of ``n`` values lie in one of the windows of the given runs."""
    edge = np.zeros(n + 1, np.int64)
    if locs is not None and len(locs):
        a = np.asarray(locs, np.int64)
        first, count = a // _LOC, a % _LOC
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + window - 1, -1)
    return np.cumsum(edge[:n]) > 0
