"""Mixing sources to target weights, in DataFrame functions only.

Word counts are summed per source with map-side combining. Sources are ranked
by code point (null last) and take the weights of ``WEIGHTS`` in turn. Targets
share the total by weight; a target stops at ``MAX_REPEAT`` times its source,
and what that frees is shared again by weight until no target is above. That
fixpoint is found in closed form: sources are ordered by limit per unit of
weight, and the level is the highest that any prefix of capped sources leaves
to the rest. Both windows run over one row per source.

Each document is then emitted floor(rate) times, plus once more if a hash of
the seed and its id, as a number in [0, 1), lies below the fraction.

Defined results: null or empty text has size 0 and takes 0; a source of size 0
has target 0; rows that repeat an id draw alike (also when ids are null, with
the text's hash); an empty table gives an empty result; extra columns are kept
by `mix` (its added names start with ``_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import common

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17

_WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, _tk, size`` of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_tk"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("_w", F.get(F.array(*(F.lit(float(w)) for w in weights)),
                                     (F.row_number().over(order) - 1) % len(weights)))
    cap = F.col("source_size") * max_repeat
    per = per.withColumn("_cap", cap.cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # level that the rest would get if all sources of a smaller ratio were capped: it rises as long as that is
    # right, and falls from there on, so its maximum is the fixpoint
    per = per.withColumn("_total", F.sum("source_size").over(every)).withColumn("_all_w", F.sum("_w").over(every))
    per = per.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                         / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    per = per.withColumn("_top", F.max("_level").over(every))
    return per.select("source", "source_size", F.least("_cap", F.col("_top") * F.col("_w")).alias("target"))


def _draw(seed: int):
    """A number in [0, 1) from the seed and the document's key."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.col("_tk").cast("string")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def plan(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Per row: its size, its source's size and target, and ``copies``."""
    common.prepare(docs.sparkSession)
    sized = common.materialize(sizes(docs), "sizes")
    per = common.materialize(targets(sized, weights, max_repeat), "targets")
    per = per.withColumnRenamed("source", "_s")
    both = sized.join(per, sized["source"].eqNullSafe(F.col("_s")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("int")
    return both.withColumn("_rate", rate).select(
        "doc_id", "_tk", "source", "size", "source_size", "target",
        (whole + (_draw(seed) < F.col("_rate") - whole).cast("int")).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the plan says,
    all columns unchanged."""
    p = plan(docs, weights, max_repeat, seed).where("copies > 0").select("doc_id", "_tk", "source", "copies").distinct()
    both = docs.join(p, docs["doc_id"].cast("long").eqNullSafe(p["doc_id"]) & (common.text_key(docs) == p["_tk"])
                     & docs["source"].cast("string").eqNullSafe(p["source"]))
    copy = common.fresh_name(docs, "_copy")
    return both.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), p["copies"])).alias(copy)).drop(copy)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of the whole ``documents`` table: words taken per document."""
    return plan(common.documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM per),
capped AS (SELECT *, (source_size * 3)::DOUBLE AS cap, (source_size * 3)::DOUBLE / w AS ratio FROM ranked),
levels AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(cap) OVER b, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0)) AS level
  FROM capped WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, LEAST(cap, MAX(level) OVER () * w) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('17:' || d.doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
