"""Prefix trie of rebuilt conversations by whole-sequence collapse.

1. Every conversation is rebuilt: it may borrow the first turns of the first
   conversation of its block of ids. Turns are handled as hashes and word counts.
2. Identical rebuilt conversations become one weighted sequence with the list of
   the ids that end there. Only one conversation of each goes on.
3. Every prefix of a sequence is a node, named by its depth and two 64-bit
   hashes: the exclusive or of its turns' hashes, each taken with its position.
4. Sequences that are a proper prefix of another are found by an anti join; the
   rest are the leaves.
5. Nodes are weighted sums over the sequences that pass through them. The words
   below a node, each node once, need no descent: a sequence owns the nodes of
   which it has the smallest id, which are its deepest ones, so what it adds to
   an ancestor is the lesser of two sums over its end part.

Nothing orders a whole conversation or the ids of a node in one task: places in
a conversation come from one sort over all turns, prefixes are summed by parts of
``PART`` turns, and end lists are joined in parts, of which a task sees a stream.

Defined results: a null conv_id takes no part; null role or text is empty; turns
are ordered null first, equal turn numbers by role, then text; repeated rows are
turns of their own; an empty table has no nodes; very long texts are only hashed
and counted; extra columns are ignored. ``conv_id - conv_id % block`` follows
the sign of ``conv_id``, as SQL's remainder does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import common

BLOCK = 20              # conversations that may borrow from the first one of their block
MOST_SHARED = 4         # they borrow crc32(id) modulo this many turns
PART = 4096             # turns of a sequence summed in one window
LIST_IDS = 4096         # ids of one part of an end list
ROWS_PER_TASK = 100_000
_WORDS = r"[^\x20\x09-\x0D]+"
_NONE = hashlib.sha256(b"").hexdigest()


def _tasks(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as ``conv_id, run, at, a, b, words`` (two hashes of role and text),
    sorted within each ``run``, and per conversation and run ``first, before``: a
    turn's place is ``at - first + before``."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(_tasks(rows.sparkSession, rows.count()), *order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
        F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at"))
    placed = common.materialize(placed, "turns").withColumn("run", F.shiftright("at", 33))
    runs = placed.groupBy("conv_id", "run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return placed, runs.select("conv_id", "run", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def rebuilt(conversations: DataFrame, block: int = BLOCK, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and their rebuilt turns ``conv_id, pos, u, v, words``."""
    placed, runs = placed_turns(conversations)
    runs = common.materialize(runs, "runs")
    heads = placed.where(F.col("conv_id") % block == 0).join(runs, ["conv_id", "run"]) \
        .withColumn("pos", F.col("at") - F.col("first") + F.col("before")).where(F.col("pos") < most - 1) \
        .select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    heads = common.materialize(heads, "heads")
    ids = runs.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % block) \
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    ids = ids.join(heads.groupBy("base").agg(F.count(F.lit(1)).alias("_n")), "base", "left") \
        .withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n")
    ids = common.materialize(ids, "ids")
    borrowed = ids.join(heads, "base").where("pos < h").select("conv_id", "pos", "a", "b", "words")
    # what moves a turn is known per run, so a conversation over many runs is joined in many tasks
    move = runs.join(ids.select("conv_id", "h", "taken"), "conv_id").select(
        "conv_id", "run", "h", "taken", (F.col("before") - F.col("first")).alias("move"))
    own = placed.join(move, ["conv_id", "run"]).withColumn("pos", F.col("at") + F.col("move")).where("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words")
    turns = own.unionByName(borrowed).select(
        "conv_id", "pos", F.xxhash64("pos", "a", "b").alias("u"), F.xxhash64("b", "pos", "a").alias("v"), "words")
    return ids.select("conv_id"), common.materialize(turns, "rebuilt")


_KEY = ["depth", "u", "v"]


def collapse(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation the node at which it ends (``conv_id, depth, u, v``),
    and the distinct sequences: ``rep`` (smallest id), ``weight``, ``total`` words."""
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("u").alias("u"),
                                         F.bit_xor("v").alias("v"), F.sum("words").alias("total"))
    zero = F.lit(0).cast("long")
    ends = ids.join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in (*_KEY, "total")])
    ends = common.materialize(ends, "ends")
    sequences = ends.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"),
                                        F.max("total").alias("total"))
    return ends, common.materialize(sequences, "sequences")


def prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every sequence: ``rep``, its node and parent (``pu, pv``),
    and ``below``: the sequence's words from the prefix's last turn on."""
    chosen = turns.join(sequences.select(F.col("rep").alias("conv_id"), "total"), "conv_id") \
        .withColumn("part", F.floor(F.col("pos") / PART))
    sums = [(F.bit_xor, "u"), (F.bit_xor, "v"), (F.sum, "words")]
    inner = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chosen.groupBy("conv_id", "part").agg(*[f(c).alias(f"_{c}") for f, c in sums]) \
        .select("conv_id", "part", *[f(f"_{c}").over(earlier).alias(f"_{c}") for f, c in sums]).where("part > 0")
    run = chosen.select("*", *[f(c).over(inner).alias(f"s{c}") for f, c in sums]).join(parts, ["conv_id", "part"], "left")
    zero = F.lit(0)
    run = run.withColumns({"nu": F.col("su").bitwiseXOR(F.coalesce("_u", zero)), "nv": F.col("sv").bitwiseXOR(F.coalesce("_v", zero)),
                           "upto": F.col("swords") + F.coalesce("_words", zero)})
    nodes = run.select(F.col("conv_id").alias("rep"), (F.col("pos") + 1).alias("depth"), F.col("nu").alias("u"), F.col("nv").alias("v"),
                       F.col("nu").bitwiseXOR(F.col("u")).alias("pu"), F.col("nv").bitwiseXOR(F.col("v")).alias("pv"),
                       (F.col("total") - F.col("upto") + F.col("words")).alias("below"))
    none = F.lit(0).cast("long")
    root = sequences.select("rep", none.alias("depth"), none.alias("u"), none.alias("v"), none.alias("pu"), none.alias("pv"),
                            F.col("total").alias("below"))
    return common.materialize(nodes.unionByName(root), "prefixes")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, u, v, conv_id`` to parts of end lists."""
    key, first, ids = None, 0, []

    def part():
        return pa.RecordBatch.from_pylist([{"depth": key[0], "u": key[1], "v": key[2], "first": first,
                                            "ids": ",".join(map(str, ids))}], schema=_LIST)
    for b in batches:
        for *k, i in zip(*(b.column(c).to_pylist() for c in (*_KEY, "conv_id"))):
            if k != key or len(ids) == LIST_IDS:
                if ids:
                    yield part()
                key, first, ids = k, i, []
            ids.append(i)
    if ids:
        yield part()


_LIST = pa.schema([("depth", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def end_lists(ends: DataFrame) -> DataFrame:
    """``depth, u, v, first, ids``: the ascending ids of the conversations that
    end at a node, comma-joined, in parts ordered by their first id."""
    n = _tasks(ends.sparkSession, ends.count())
    out = ends.select(*_KEY, "conv_id").repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id") \
        .mapInArrow(_lists, "depth long, u long, v long, first long, ids string")
    return common.materialize(out, "end_lists")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None
    for b in batches:
        rows: list = []
        for *k, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if k == key:
                sha.update(b",")
            else:
                if sha:
                    rows.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        yield _digest_batch(rows)
    if sha:
        yield _digest_batch([(*key, sha.hexdigest())])


def _digest_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                      names=[*_KEY, "ends_sha256"])


def trie(conversations: DataFrame, block: int = BLOCK, most: int = MOST_SHARED) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``."""
    common.prepare(conversations.sparkSession)
    ids, turns = rebuilt(conversations, block, most)
    ends, sequences = collapse(ids, turns)
    rows = prefixes(turns, sequences)
    # whole sequences that go on in another are no leaves
    inner = rows.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
    leaves = sequences.join(inner, _KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    # the join's key has the sequence in it, so a node that many share is spread
    least = rows.groupBy(*_KEY).agg(F.min("rep").alias("rep"))
    owned = rows.join(least, [*_KEY, "rep"]).groupBy("rep").agg(F.max("below").alias("owned"))
    of_rep = sequences.select("rep", "weight").join(owned, "rep", "left").join(leaves, "rep", "left").select(
        "rep", "weight", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    nodes = rows.join(of_rep, "rep").groupBy(*_KEY).agg(
        F.min("rep").alias("conv_id"), F.min("pu").alias("pu"), F.min("pv").alias("pv"), F.sum("weight").alias("n_convs"),
        F.sum("leaf").cast("long").alias("n_leaves"),
        (F.sum(F.col("weight") * F.col("below")) - F.sum(F.least("below", "owned"))).alias("saved_tokens"))
    nodes = common.materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pu").alias("u"), F.col("pv").alias("v")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("u").alias("pu"), F.col("v").alias("pv"),
                           F.col("conv_id").alias("parent_conv_id"))
    lists = end_lists(ends)
    digests = lists.repartition(_tasks(lists.sparkSession, lists.count()), *_KEY).sortWithinPartitions(*_KEY, "first") \
        .mapInArrow(_digests, "depth long, u long, v long, ends_sha256 string")
    return nodes.join(parents, ["depth", "pu", "pv"], "left").join(children, _KEY, "left").join(digests, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of the whole ``conversations`` table."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 bit by bit; prefixes are lists of turns
SQL = r"""
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
seq AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS s FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, conv_id - conv_id % 20 AS base, s,
               xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
                   lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT FOR i IN range(8)]),
                       lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295) % 4 AS h FROM seq),
r AS (SELECT c.conv_id, list_concat(COALESCE(b.s, [])[1:c.h], c.s[c.h + 1:]) AS s FROM crc c LEFT JOIN seq b ON b.conv_id = c.base),
p AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s FROM r),
k AS (SELECT conv_id, depth, s[1:depth] AS node, len(s) = depth AS is_end FROM p),
n AS MATERIALIZED (SELECT depth, node, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
             CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS words,
             sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
      FROM k GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, COUNT(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, node)),
up AS (SELECT unnest(range(0, depth + 1)) AS depth, depth AS below, node, n_convs, words, n_children FROM m),
sub AS (SELECT depth, node[1:depth] AS node, COUNT(*) FILTER (WHERE n_children = 0) AS n_leaves,
               SUM((n_convs - 1) * words)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, sub.n_leaves, sub.saved_tokens, m.ends_sha256
FROM m JOIN sub USING (depth, node) LEFT JOIN n q ON q.depth = m.depth - 1 AND q.node = m.node[1:m.depth - 1]
"""
