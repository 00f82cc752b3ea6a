"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each document becomes its set of distinct shingles of ``shingle`` words
   (64-bit hashes; two words in op9, five in the pipeline), a signature of ``COORDS`` values, and a 128-bit hash of the set.
   Equal sets collapse to one node, whatever their number.
   A coordinate's value joins two min-wise hashes: sets that merely share some
   frequent shingles then seldom agree in any.
2. Every coordinate-value pair is a token. Two sets of similarity 0.8 agree in
   each with probability 0.64, and in ``MATCHES`` of all but for a chance of
   about 1e-6. With tokens
   ordered from rare to frequent, such a pair must share one of the first
   ``COORDS - MATCHES + 1`` tokens of both: only this prefix is posted, and
   tokens of a single node are never posted, so most documents drop out here.
3. Each node is compared with the one list head (smallest node of a posting
   list) that it collides with most often: the links found form components.
4. What is left to decide are posting lists whose nodes lie in several
   components. Nodes outside the list's largest component are compared, in
   blocks, with the rest of the list: collisions are counted on signatures,
   and pairs at the threshold are confirmed on the full sets. A pair is looked
   at in one list only, that of its first common prefix coordinate. Pairs are never
   rows: a task emits the links that join two components.
5. The links' components give the classes.

Defined results: null or empty text (or text without words) has an empty set,
is linked with nothing and is kept; fewer words are one shingle; rows of equal id
and text share one verdict; ties go to the smallest doc_id (null ids are
passed over, and count as kept only without any other member); an empty table
gives an empty result; extra columns are carried by `near_filter`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.components import components
from rankloom.llm.textops import Rolling, Words, chunks, mix

SHINGLE = 2         # words of a shingle, unless another number is given
COORDS = 32
JOINED = 2          # min-wise hashes that one coordinate's value is made of
MATCHES = 8
PERCENT = 80
BLOCK = 1024        # nodes of a posting list that are compared with as many others at once
BUCKET_ROWS = 4000  # rows of one comparison task, on average


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its shingles (one of all words
    for a shorter text, none without words)."""
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        roll = Rolling(w.hashes(lower=True))
        runs = roll.windows(shingle)
        for first, last in zip(w.first.tolist(), w.last.tolist()):
            if last - first >= shingle:
                s = np.sort(runs[first:last - shingle + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif last > first:
                yield roll.slices(np.array([first]), np.array([last]))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """32 bits per coordinate, of the minima of its ``JOINED`` hashes over the set."""
    best = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        best = np.minimum(best, np.multiply.outer(mul, shingles[i:i + 2048]).min(axis=1))
    value = np.zeros(len(mul) // JOINED, np.uint64)
    for i in range(JOINED):
        value = mix(value ^ best[i::JOINED])
    return (value >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    mul = _multipliers(COORDS * JOINED)
    for b in batches:
        n, node, sig = [], [], []
        for s in shingle_sets(common.binaries(b.column(2)), shingle):
            n.append(len(s))
            if len(s):
                m = mix(s)
                sums = np.array([m.sum(), mix(m + np.uint64(len(s))).sum()], np.uint64)
                node.append(sums.tobytes())
                sig.append(signature(s, mul).tobytes())
            else:
                node.append(None)
                sig.append(None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())],
            names=["doc_id", "_tk", "n", "node", "sig"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tag = np.arange(COORDS, dtype=np.uint64) << np.uint64(32)
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
        at = pa.array(np.repeat(np.arange(b.num_rows), COORDS))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), common.longs((sig.astype(np.uint64) | tag).ravel())], names=["node", "token"])


def postings(nodes: DataFrame) -> DataFrame:
    """``node, tokens``: every node's prefix of shared tokens, rare first."""
    tokens = nodes.select("node", "sig").mapInArrow(_tokens, "node binary, token long")
    df = common.materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    shared = tokens.join(df, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # a node's other tokens are its own alone: they fill the prefix first
    room = COORDS - MATCHES + 1 - (COORDS - F.size("t"))
    return shared.where(room > 0).select("node", F.transform(F.slice("t", F.lit(1), room), lambda x: x["token"]).alias("tokens"))


def _pairs_alike(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Confirm pairs of texts on their full sets."""
    for b in batches:
        keep = []
        for lo, hi in common.pieces_of(b.num_rows, 256):
            left = list(shingle_sets(common.unpack(b.column("za").slice(lo, hi - lo)), shingle))
            right = list(shingle_sets(common.unpack(b.column("zb").slice(lo, hi - lo)), shingle))
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _groups(table: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of each (token, block, block) group of a task's table."""
    keys = [table.column(c).to_numpy() for c in ("token", "bi", "bj")]
    order = np.lexsort(keys)
    cut = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        cut[1:] |= s[1:] != s[:-1]
    return np.split(order, np.flatnonzero(cut))


def _flag(table: pa.Table) -> pa.Table:
    """Nodes of a group with enough collisions across components."""
    table = table.combine_chunks()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
    comp = table.column("comp").to_numpy(zero_copy_only=False)
    comp = np.unique(comp, return_inverse=True)[1]
    minor = table.column("minor").to_numpy(zero_copy_only=False)
    size = table.column("n").to_numpy()
    mask = table.column("mask").to_numpy().view(np.uint64)
    own = table.column("token").to_numpy().view(np.uint64) >> np.uint64(32)
    bit = np.uint64(1) << np.arange(COORDS, dtype=np.uint64)
    hit = np.zeros(len(comp), bool)
    for rows in _groups(table):
        s, c, n = sig[rows], comp[rows], size[rows]
        for r in np.flatnonzero(minor[rows]):
            ok = (c != c[r]) & (100 * np.minimum(n, n[r]) >= PERCENT * np.maximum(n, n[r]))
            ok = np.flatnonzero(ok)
            equal = s[ok] == s[r]
            enough = equal.sum(axis=1) >= MATCHES
            ok, equal = ok[enough], equal[enough]
            shared = (equal * bit).sum(axis=1, dtype=np.uint64) & mask[rows[ok]] & mask[rows[r]]
            lowest = shared & (~shared + np.uint64(1))
            ok = ok[lowest == np.uint64(1) << own[rows[r]]]
            if len(ok):
                hit[rows[ok]] = hit[rows[r]] = True
    return table.select(["token", "bi", "bj", "minor", "node", "comp", "bucket"]).filter(pa.array(hit))


def _link(table: pa.Table, shingle: int) -> pa.Table:
    """Links on full sets between the components of a group's nodes. A pair
    whose components were joined before is not looked at again."""
    table = table.combine_chunks()
    sets = list(shingle_sets(common.unpack(table.column("z")), shingle))
    names = table.column("comp").to_pylist()
    comp_all = np.unique(np.array(names, object), return_inverse=True)[1]
    minor = table.column("minor").to_numpy(zero_copy_only=False)
    out_a, out_b = [], []
    for rows in _groups(table):
        own = [sets[r] for r in rows]
        lens = np.array([len(s) for s in own])
        start = np.cumsum(lens) - lens
        vocabulary, ids = np.unique(np.concatenate(own), return_inverse=True)
        shared = np.bincount(ids, minlength=len(vocabulary))[ids] > 1
        most = np.add.reduceat(shared, start)    # no intersection can be larger
        comp = comp_all[rows].copy()
        mark = np.zeros(len(vocabulary), np.int32)
        possible = 100 * most >= PERCENT * lens
        for r in np.flatnonzero(minor[rows] & possible):
            cand = np.flatnonzero(possible & (comp != comp[r]) & (100 * np.minimum(lens, lens[r]) >= PERCENT * np.maximum(lens, lens[r])))
            if not len(cand):
                continue
            mark[ids[start[r]:start[r] + lens[r]]] = 1
            if len(cand) * 4 > len(rows):
                both = np.add.reduceat(mark[ids], start)[cand]
            else:
                both = np.array([mark[ids[start[c]:start[c] + lens[c]]].sum() for c in cand])
            mark[ids[start[r]:start[r] + lens[r]]] = 0
            for c in cand[100 * both >= PERCENT * (lens[cand] + lens[r] - both)]:
                if comp[c] != comp[r]:
                    out_a.append(names[rows[r]])
                    out_b.append(names[rows[c]])
                    comp[comp == comp[c]] = comp[r]
    return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})


def members(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: ``doc_id, _tk, n_shingles`` and its ``class`` (null without words)."""
    common.prepare(docs.sparkSession)
    sketch = common.materialize(common.keyed(docs).mapInArrow(
        lambda b: _sketch(b, shingle), "doc_id long, _tk long, n long, node binary, sig binary"), "sketch")
    nodes = common.materialize(sketch.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "_tk")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    prefix = common.materialize(postings(nodes), "prefix")
    posts = prefix.select("node", F.explode("tokens").alias("token"))
    #: the coordinates of a node's prefix as bits: a pair is compared in the list of its first common one only
    mask = F.expr("aggregate(transform(tokens, t -> shiftleft(1L, cast(shiftright(t, 32) AS int))), 0L, (a, b) -> a | b)")
    nodes = common.materialize(nodes.join(prefix.select("node", mask.alias("mask")), "node"), "nodes")

    # texts of the nodes that are in any list
    wanted = nodes.select("node", "rep.doc_id", "rep._tk")
    zipped = common.packed(docs)
    texts = common.materialize(zipped.join(wanted, common.same_key(zipped, wanted)).select("node", "z")
                               .dropDuplicates(["node"]), "texts")

    # one head per node: the one it meets in most lists
    heads = common.materialize(posts.groupBy("token").agg(F.min("node").alias("head")), "heads")
    star = posts.join(heads, "token").where("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c"))
    star = star.groupBy("node").agg(F.max(F.struct("c", "head")).alias("best")).select(
        F.col("node").alias("a"), F.col("best.head").alias("b"))
    star = common.materialize(star, "star")
    za, zb = (texts.select(F.col("node").alias(x), F.col("z").alias(f"z{x}")) for x in "ab")
    links = star.join(za, "a").join(zb, "b").select("a", "b", "za", "zb").mapInArrow(
        lambda b: _pairs_alike(b, shingle), "a binary, b binary")
    first = components(common.materialize(links, "links"))

    # lists that span several components
    part = common.materialize(posts.join(first.select("node", F.col("root").alias("comp")), "node", "left")
                              .select("token", "node", F.coalesce("comp", "node").alias("comp")), "part")
    sizes = part.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("token").agg(F.sum("c").alias("p"), F.max(F.struct("c", "comp")).alias("top"),
                                       F.count(F.lit(1)).alias("k")).where("k > 1")
    lists = common.materialize(lists.select(
        "token", F.col("top.comp").alias("top"),
        F.ceil((F.col("p") - F.col("top.c")) / BLOCK).cast("int").alias("ni"), F.ceil(F.col("p") / BLOCK).cast("int").alias("nj")), "lists")
    open_ = part.join(lists, "token").withColumn("minor", F.col("comp") != F.col("top"))
    # each block of the nodes outside the largest component meets each block of the list
    h = F.xxhash64("node")
    one = open_.where("minor").withColumn("bi", F.pmod(h, F.col("ni")).cast("int")) \
        .withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
    two = open_.withColumn("bj", F.pmod(h, F.col("nj")).cast("int")) \
        .withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("minor", F.lit(False))
    cols = ["token", "bi", "bj", "minor", "node", "comp"]
    cells = common.materialize(one.select(*cols).unionByName(two.select(*cols)), "cells")
    n = max(1, math.ceil(cells.count() / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("token", "bi", "bj"), F.lit(n)).cast("int")
    flagged = cells.join(nodes.select("node", "sig", "n", "mask"), "node").withColumn("bucket", bucket)
    flagged = common.materialize(flagged.groupBy("bucket").applyInArrow(
        _flag, "token long, bi int, bj int, minor boolean, node binary, comp binary, bucket int"), "flagged")
    joined = flagged.join(texts, "node").groupBy("bucket").applyInArrow(lambda t: _link(t, shingle), "a binary, b binary")
    second = components(common.materialize(joined, "links"))

    comp = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "full") \
        .select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("class"))
    member = common.materialize(sketch.join(comp, "node", "left").select(
        "doc_id", "_tk", F.col("n").alias("n_shingles"), F.coalesce("class", "node").alias("class")), "member")
    return member


def near_classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id, _tk, n_shingles``, the smallest id of its class, and
    whether that is its own."""
    member = members(docs, shingle)
    least = common.materialize(member.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("component_id")), "least")
    out = member.join(least, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "_tk", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_filter(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each class, all columns: that of the smallest id (null
    last), then of the smallest text hash; of rows equal in id and text any one.
    Documents without words are in no class and all stay."""
    member = members(docs, shingle).where("class is not null").select("class", "doc_id", "_tk")
    first = member.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tk")).alias("rep"))
    gone = member.join(common.materialize(first, "first"), "class") \
        .where(~(F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_tk") == F.col("rep._tk")))).select("doc_id", "_tk").distinct()
    twice = common.materialize(member.groupBy("doc_id", "_tk").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    left = _without(docs, gone)
    if twice.isEmpty():
        return left
    keys = [common.fresh_name(docs, c) for c in ("_id", "_key")]
    again = _without(left, twice, "left_semi").select("*", left["doc_id"].cast("long").alias(keys[0]), common.text_key(left).alias(keys[1]))
    return _without(left, twice).unionByName(again.dropDuplicates(keys).drop(*keys))


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    keys = keys.select("doc_id", "_tk")
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (common.text_key(docs) == keys["_tk"]), how)


def op9_minhash_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the whole ``documents`` table."""
    return near_classes(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


#: all pairs that share a shingle, with their exact similarity, and the classes by reachability
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE
        [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_id AS (SELECT a, MIN(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, LEAST(d.doc_id, COALESCE(m, d.doc_id)) AS component_id,
       LEAST(d.doc_id, COALESCE(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON least_id.a = d.doc_id
"""
