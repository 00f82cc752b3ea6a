"""Training pairs, negative sampling and splits.

Sampling is *portable*: every draw is a function of md5 hashes, so an
independent SQL engine reproduces the exact sample. Cost is O(sum over users of
draws), with draws per user bounded by the catalogue size; there is no
user x catalogue product.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.hashing import portable_hash
from rankloom.operators.indexing import global_index
from rankloom.session import materialize
from rankloom.sources.tables import RATING_ORDER_KEY

DRAW_CHUNK = 4096
# Candidate strides for the negative-sampling walk (primes).
STRIDE_PRIMES = (7919, 7907, 7901, 7883, 7879, 7877, 7873, 7867)


def stride_for(n: int) -> int:
    for p in STRIDE_PRIMES:
        if gcd(p, n) == 1:
            return p
    raise ValueError(f"no stride coprime with catalogue size {n}")


def order_key() -> list:
    return [F.col("ts")] + [F.col(c) for c in RATING_ORDER_KEY]


def item_universe(ratings: DataFrame) -> DataFrame:
    """Distinct rated items."""
    return ratings.select("item_id").distinct()


def numbered_catalogue(ratings: DataFrame, seed: int) -> DataFrame:
    """Catalogue permutation ``(pos, item_id)``: items ordered by ``(hash(item-seed), item)``."""
    u = item_universe(ratings).withColumn("_h", portable_hash(F.col("item_id"), F.lit(f"-{seed}")))
    return global_index(u, ["_h", "item_id"], "pos").select("pos", "item_id")


def rated_pairs(ratings: DataFrame, min_rating: float = 4.0) -> DataFrame:
    """One row per rated ``(user_id, item_id)``, written once: ``n_liked`` rows that reach
    ``min_rating``, and ``rating`` if it is the same in all rows (``_same``)."""
    known = F.count("rating") == F.count(F.lit(1))
    return materialize(ratings.groupBy("user_id", "item_id").agg(
        F.count_if(F.col("rating") >= min_rating).alias("n_liked"), F.min("rating").alias("rating"),
        F.coalesce(known & (F.min("rating") == F.max("rating")), F.lit(False)).alias("_same")), "rated_pairs")


def portable_negatives(ratings: DataFrame, need: DataFrame, seed: int = 42,
                       catalogue: DataFrame | None = None, n_items: int | None = None,
                       ranked: bool = False, rated: DataFrame | None = None, carry=()) -> DataFrame:
    """Exactly ``need`` distinct unrated items per user (or the whole unrated pool).

    ``need(user_id, need)``. User ``u`` walks the catalogue permutation from
    ``hash('s' u '-' seed) mod N`` with a stride coprime to N, taking
    ``need + rated_u`` draws (all distinct), drops rated items and keeps the
    first ``need``. The stride's inverse gives the draw at which a rated item would be
    met, so only draws that are kept are ever made into rows, chunk by chunk: a hot
    user's walk spans tasks. ``rated`` are the distinct ``(user_id, item_id)`` if they
    are made already; columns of ``need`` named in ``carry`` are kept.
    Returns ``(user_id, item_id, draw)``.
    """
    cat = numbered_catalogue(ratings, seed) if catalogue is None else catalogue
    n_items = cat.count() if n_items is None else n_items
    step = stride_for(max(n_items, 1))
    back = pow(step, -1, max(n_items, 1))
    rated = ratings.select("user_id", "item_id").distinct() if rated is None else rated.select("user_id", "item_id")
    rated_n = rated.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rated"))
    plan = need.filter(F.col("need") > 0).join(rated_n, "user_id", "inner").withColumn(
        "m", F.least(F.lit(n_items).cast("bigint"), F.col("need") + F.col("n_rated"))
    ).withColumn("start", F.pmod(portable_hash(F.lit("s"), F.col("user_id"), F.lit(f"-{seed}")), F.lit(n_items))).drop("n_rated")
    plan = materialize(plan, "negative_plan")       # one row per user, read twice
    # draws of the walk that meet a rated item
    at = F.pmod(F.pmod(F.col("pos") - F.col("start"), F.lit(n_items)) * F.lit(back), F.lit(n_items))
    holes = rated.join(cat, "item_id").join(plan.select("user_id", "m", "start"), "user_id") \
        .select("user_id", "m", at.alias("draw")).filter(F.col("draw") < F.col("m")) \
        .groupBy("user_id", F.floor(F.col("draw") / DRAW_CHUNK).alias("c")).agg(F.collect_list("draw").alias("_holes"))
    chunks = plan.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / DRAW_CHUNK).cast("bigint"))).alias("c"))
    lo, hi = F.col("c") * DRAW_CHUNK, F.least((F.col("c") + 1) * DRAW_CHUNK, F.col("m"))
    chunks = chunks.join(holes, ["user_id", "c"], "left").withColumn("_n", hi - lo - F.coalesce(F.size("_holes"), F.lit(0)))
    # kept draws before the chunk: a running sum over a user's chunks
    wc = Window.partitionBy("user_id").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0))).filter(F.col("_off") < F.col("need"))
    walk = F.sequence(lo, hi - 1)
    left = F.when(F.col("_holes").isNull(), walk).otherwise(F.array_except(walk, F.col("_holes")))
    left = F.slice(left, F.lit(1), F.least(F.col("_n"), F.col("need") - F.col("_off")).cast("int"))
    kept = chunks.repartition("user_id", "c").select("user_id", *carry, "start", "_off", F.posexplode(left).alias("_p", "draw")) \
        .select("user_id", *carry, "draw", F.pmod(F.col("start") + F.col("draw") * F.lit(step), F.lit(n_items)).alias("pos"),
                *([(F.col("_off") + F.col("_p") + 1).alias("_r")] if ranked else []))
    return kept.join(cat, "pos", "inner").select("user_id", "item_id", "draw", *(["_r"] if ranked else []), *carry)


def positives(ratings: DataFrame, min_rating: float = 4.0, rated: DataFrame | None = None) -> DataFrame:
    """One row per liked rating row; ``rating`` is the user's *first* rating
    of that item in time order (it may be below the threshold). Only pairs whose
    ratings differ are ordered. ``rated`` are ``rated_pairs`` made before."""
    rated = rated_pairs(ratings, min_rating) if rated is None else rated
    liked = rated.filter((F.col("n_liked") > 0) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    same = liked.filter("_same").select("user_id", "item_id", "n_liked", "rating")
    other = liked.filter("NOT _same").select("user_id", "item_id", "n_liked")
    first = ratings.join(other, ["user_id", "item_id"]).groupBy("user_id", "item_id").agg(
        F.first("n_liked").alias("n_liked"), F.min_by("rating", F.struct(*order_key())).alias("rating"))
    return same.unionByName(first).select(
        "user_id", "item_id", F.lit(1).alias("label"), "rating", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_liked"))).alias("_c")).drop("_c")


def training_pairs(ratings: DataFrame, n_negatives: int = 4, seed: int = 42,
                   min_rating: float = 4.0, return_queries: bool = False, test_ratio: float | None = None):
    """Positives ∪ ``n_neg x n_pos`` portable negatives; with ``test_ratio`` the
    column ``split`` of ``split_queries``.

    Users without a positive, or with fewer than ``n_negatives`` unrated items,
    are skipped; the draw count is capped at the unrated pool (fix of the
    reference's abort on heavy users). ``query_id`` is the dense 0-based rank of
    the user (W3). It and the split are put beside the user before the pairs are made.
    """
    rated = rated_pairs(ratings, min_rating)
    cat = numbered_catalogue(rated, seed)
    n_items = cat.count()
    stats = rated.groupBy("user_id").agg(F.sum("n_liked").alias("n_pos"), F.count("item_id").alias("n_rated"))
    eligible = stats.filter((F.col("n_pos") > 0) & (F.lit(n_items) - F.col("n_rated") >= n_negatives))
    need = eligible.select("user_id", F.least(F.col("n_pos") * n_negatives,
                                              F.lit(n_items) - F.col("n_rated")).alias("need"))
    queries = global_index(need, ["user_id"], "query_id")  # checkpointed, one row per user
    carry = ["query_id"]
    if test_ratio is not None:
        queries = materialize(queries.join(query_split(queries.select("query_id"), test_ratio, seed), "query_id"), "queries")
        carry.append("split")
    neg = portable_negatives(ratings, queries, seed, cat, n_items, rated=rated, carry=carry).select(
        "user_id", "item_id", F.lit(0).alias("label"), F.lit(0.0).alias("rating"), *carry)
    out = positives(ratings, min_rating, rated).join(queries.select("user_id", *carry), "user_id").unionByName(neg)
    return (out, queries.select("query_id")) if return_queries else out


def query_split(queries: DataFrame, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """W4 on the query table: ``max(1, int(n_queries x ratio))`` queries with the
    smallest ``hash('q' query_id '-' seed)`` are ``test``, the rest ``train``."""
    n_q = queries.count()
    n_test = max(1, int(n_q * test_ratio))
    ranked = global_index(queries.withColumn("_h", portable_hash(F.lit("q"), F.col("query_id"), F.lit(f"-{seed}"))),
                          ["_h", "query_id"], "_qpos")
    return ranked.select("query_id", F.when(F.col("_qpos") < n_test, "test").otherwise("train").alias("split"))


def split_queries(pairs: DataFrame, test_ratio: float = 0.1, seed: int = 42,
                  queries: DataFrame | None = None) -> DataFrame:
    """Group-level split of a pair table; adds ``split``. Pass the query table
    (from ``training_pairs(..., return_queries=True)``) to avoid re-deriving it."""
    q = queries if queries is not None else pairs.select("query_id").distinct()
    return pairs.join(query_split(q, test_ratio, seed), "query_id", "inner")


def build_training_pairs(ratings: DataFrame, n_negatives: int = 4, test_ratio: float = 0.1,
                         seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` pair tables ``(user_id, item_id, label, rating, query_id)``."""
    s = training_pairs(ratings, n_negatives, seed, test_ratio=test_ratio)
    cols = ["user_id", "item_id", "label", "rating", "query_id"]
    return s.filter(F.col("split") == "train").select(*cols), s.filter(F.col("split") == "test").select(*cols)


def indexed_positives(ratings: DataFrame, min_rating: float = 4.0) -> DataFrame:
    """``user_id, pos_item, _i``: liked ratings with their 1-based place in the user's time order."""
    liked = ratings.filter(F.col("rating") >= min_rating)
    # dense global positions (range-partitioned, so a heavy user spans many tasks) minus the user's first
    keys = ["user_id", "ts", *RATING_ORDER_KEY]
    g = global_index(liked.select(*keys, "item_id"), keys, "_g")
    first = g.groupBy("user_id").agg(F.min("_g").alias("_s"))
    return g.join(first, "user_id").select("user_id", F.col("item_id").alias("pos_item"),
                                           (F.col("_g") - F.col("_s") + 1).alias("_i"))


def epoch_negatives(ratings: DataFrame, epoch: int, min_rating: float = 4.0, catalogue: DataFrame | None = None,
                    index: str | None = None, pos: DataFrame | None = None, rated: DataFrame | None = None) -> DataFrame:
    """One unrated negative for every positive row, re-drawn each epoch (seed = epoch).

    Returns ``(user_id, pos_item, neg_item)``: the i-th positive (time order) pairs
    with draw ``i mod pool`` of the user's ``pool`` unrated items, so a user with
    more positives than unrated items repeats negatives and loses no positive.
    Negatives come from ``catalogue(item_id)`` and the rated items. Users who rated
    the whole catalogue have no negative and no row. ``index`` names an extra
    column with the positive's 1-based position; ``pos`` are
    ``indexed_positives`` and ``rated`` the distinct ``(user_id, item_id)`` made before (they
    are the same in every epoch).
    """
    pos = materialize(indexed_positives(ratings, min_rating), "positives") if pos is None else pos
    rated = materialize(ratings.select("user_id", "item_id").distinct(), "rated_pairs") if rated is None else rated
    items = rated.select("item_id")
    if catalogue is not None:
        items = items.unionByName(catalogue.select("item_id"))
    cat = numbered_catalogue(items, epoch)
    n_items = cat.count()
    need = pos.groupBy("user_id").agg(F.count(F.lit(1)).alias("need"))
    pool = need.join(rated.groupBy("user_id").agg(F.count("item_id").alias("_n")), "user_id").select(
        "user_id", F.least("need", F.lit(n_items) - F.col("_n")).alias("_pool")).filter(F.col("_pool") > 0)
    neg = portable_negatives(ratings, need, epoch, cat, n_items, ranked=True, rated=rated)
    neg = neg.select("user_id", F.col("item_id").alias("neg_item"), F.col("_r").alias("_d"))
    pos = pos.join(pool, "user_id").withColumn("_d", (F.col("_i") - 1) % F.col("_pool") + 1)
    out = pos.join(neg, ["user_id", "_d"], "inner")
    return out.select("user_id", "pos_item", "neg_item", *([F.col("_i").alias(index)] if index else []))


def last_n_holdout(ratings: DataFrame, ratio: float = 0.1) -> DataFrame:
    """The last ``N = max(1, int(rows x ratio / users))`` ratings of every user."""
    # N as a literal (one number to the driver), so `row_number() <= N` is planned with a
    # partial WindowGroupLimit: each map task forwards at most N rows per user
    n = int(ratings.select(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio)
                                                        / F.count_distinct("user_id"))).cast("int")).first()[0])
    w = Window.partitionBy("user_id").orderBy(*[c.desc() for c in order_key()])
    return ratings.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def holdout_split(ratings: DataFrame, ratio: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """P5 (time form): ``(history, holdout)`` with W1 as the holdout."""
    hold = last_n_holdout(ratings, ratio)
    keys = ["user_id", "item_id", "ts", *RATING_ORDER_KEY]
    return ratings.join(hold.select(*keys), keys, "left_anti"), hold


def evaluation_users(holdout: DataFrame, n_users: int | None = 200) -> DataFrame:
    """Users by first appearance in the time-ordered holdout (first ``n_users``;
    None keeps all). Adds ``eval_order`` (0-based)."""
    first = holdout.groupBy("user_id").agg(F.min(F.struct(*order_key())).alias("_first"))
    if n_users is None:
        return global_index(first.select("user_id", "_first"), ["_first", "user_id"], "eval_order").drop("_first")
    top = first.orderBy("_first", "user_id").limit(n_users)
    w = Window.orderBy("_first", "user_id")  # n_users rows
    return top.select("user_id", (F.row_number().over(w) - 1).alias("eval_order"))
