"""Serving tables: popularity fallback, top-k, metadata enrichment, batch recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def item_metadata(movies: DataFrame) -> DataFrame:
    """``(item_id, title, genres[])``."""
    return movies.select("item_id", "title", F.split("genres", r"\|").alias("genres"))


def popularity(ratings: DataFrame) -> DataFrame:
    """A4: rating count per item (partial aggregation before the shuffle)."""
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"))


def popularity_top_k(ratings: DataFrame, k: int = 20) -> DataFrame:
    """The k most rated items, ties by item id, score ``1 - rank/(k+1)``.

    ``orderBy().limit(k)`` keeps k rows per partition and merges k x partitions:
    the driver-side state is bounded by k, never by the catalogue.
    """
    top = popularity(ratings).orderBy(F.desc("n_ratings"), F.asc("item_id")).limit(k)
    w = Window.orderBy(F.desc("n_ratings"), F.asc("item_id"))  # over k rows only
    return top.select(
        "item_id", F.row_number().over(w).alias("rank"), "n_ratings"
    ).withColumn("score", F.lit(1.0) - F.col("rank") / F.lit(float(k + 1))) \
     .withColumn("retrieval_score", F.lit(0.0))


def enrich(recs: DataFrame, movies: DataFrame) -> DataFrame:
    """Title / genre list per recommended item; missing title -> ``Item <id>``,
    missing genres -> empty list."""
    meta = item_metadata(movies)
    j = recs.join(meta, "item_id", "left")
    return j.withColumn("title", F.coalesce("title", F.concat(F.lit("Item "), F.col("item_id").cast("string")))) \
            .withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def top_k_per_user(scored: DataFrame, k: int, score: str = "score",
                   tie: tuple = ("retrieval_score", "item_id"), part: str = "user_id") -> DataFrame:
    """1-based rank by score (ties: retrieval score, then item id), keep k.

    ``row_number() <= k`` with a literal k is planned as a partial
    ``WindowGroupLimit`` before the shuffle, so each map task forwards at most
    k rows per user.
    """
    order = [F.desc(score)] + [F.desc(t) if t != "item_id" else F.asc(t) for t in tie]
    w = Window.partitionBy(part).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --------------------------------------------------------------------------- batch serving

from rankloom.functions.genres import DRIVER_GENRES, N_GENRES  # noqa: E402
from rankloom.functions.vectors import dot as _dot  # noqa: E402
from rankloom.functions.vectors import pad_or_zero  # noqa: E402

# Serving-time defaults for absent features (user then item side).
USER_DEFAULTS = {"avg_rating": 3.5, "log_rating_count": 0.0, "recency_score": 0.5,
                 "gender_encoded": 0.0, "age_normalized": 0.3, "occupation_normalized": 0.3}
ITEM_DEFAULTS = {"item_avg_rating": 3.5, "item_log_rating_count": 0.0, "popularity_score": 0.0,
                 "rating_stddev": 0.0, "year_normalized": 0.5}

# Weights of the linear scorer used by the registered end-to-end queries.
DEFAULT_WEIGHTS = {"genre_affinity": 1.0, "popularity_score": 0.5, "item_avg_rating": 0.2,
                   "rating_diff": -0.1, "year_normalized": 0.05}


ITEM_BROADCAST_BYTES = 64 << 20     # rows of item features that are sent to every task
USERS_PER_TASK = 2048               # users whose candidates one task fans out and ranks


def _small(i: DataFrame, n: int) -> bool:
    return i.count() * 8 * (n + 10) <= ITEM_BROADCAST_BYTES


def serving_features(cands: DataFrame, user_feats: DataFrame, item_feats: DataFrame,
                     n: int = N_GENRES, digits: int | None = None) -> DataFrame:
    """V2: the 50-column matrix for ``cands(user_id, item_id, retrieval_score)`` with
    *serving* defaults (not the training 0.0), vectors padded to ``n`` with zeros.

    Per-entity work (vector padding, defaults, rounding to ``digits``) runs on the user /
    item tables before the fan-out join; per-candidate work is only differences and the
    dot. ``cands(user_id, item_ids, scores)``, one row per user, join the user's row before
    they fan out, and then stay with their user: few item features (as those of
    ``retrieve_lists``) are broadcast, so that no candidate is shuffled.
    """
    from rankloom.functions.vectors import zeros

    def shown(side: DataFrame, scalars, vector: str) -> DataFrame:
        """The entity's numbers as they are put out, beside those that are reckoned with."""
        if digits is None:
            return side
        return side.withColumns({**{f"_o_{c}": F.round(F.col(c).cast("double"), digits) for c in scalars},
                                 f"_o{vector}": F.array(*[F.round(F.col(vector)[k], digits) for k in range(n)])})

    u = user_feats.select("user_id", *USER_DEFAULTS, pad_or_zero("genre_pref", n).alias("_up"))
    i = item_feats.select("item_id", F.col("avg_rating").alias("item_avg_rating"),
                          F.col("log_rating_count").alias("item_log_rating_count"),
                          "popularity_score", "rating_stddev", "year_normalized",
                          pad_or_zero("genre_vector", n).alias("_iv"))
    u, i = shown(u, USER_DEFAULTS, "_up"), shown(i, ITEM_DEFAULTS, "_iv")
    if "item_ids" in cands.columns:
        # an explicit partition count is not coalesced: the rows fan out after the shuffle
        spark = cands.sparkSession
        # and their number goes with the users, so that a task's sorted candidates stay as many
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 4,
                    -(-user_feats.count() // USERS_PER_TASK))
        m = cands.repartition(parts, "user_id").join(u, "user_id", "left")
        m = m.select("scores", F.posexplode("item_ids").alias("_p", "item_id"), *u.columns) \
            .withColumn("retrieval_score", F.col("scores")[F.col("_p")]).drop("scores", "_p")
    else:
        m = cands.join(u, "user_id", "left")
    m = m.join(F.broadcast(i) if _small(item_feats, n) else i, "item_id", "left")
    m = m.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in {**USER_DEFAULTS, **ITEM_DEFAULTS}.items()})
    m = m.withColumn("_up", F.coalesce("_up", zeros(n))).withColumn("_iv", F.coalesce("_iv", zeros(n)))
    m = m.withColumns({
        "rating_diff": F.col("avg_rating") - F.col("item_avg_rating"),
        "user_item_popularity_ratio": F.col("log_rating_count") / (F.col("item_log_rating_count") + F.lit(1e-8)),
        "genre_affinity": _dot("_up", "_iv", n)})
    up, iv = "_up", "_iv"
    if digits is not None:
        m = m.withColumns({c: F.round(c, digits) for c in ("rating_diff", "user_item_popularity_ratio", "genre_affinity")})
        m = m.withColumns({c: F.coalesce(f"_o_{c}", F.lit(round(v, digits))) for c, v in {**USER_DEFAULTS, **ITEM_DEFAULTS}.items()})
        m = m.withColumns({"_o_up": F.coalesce("_o_up", zeros(n)), "_o_iv": F.coalesce("_o_iv", zeros(n))})
        up, iv = "_o_up", "_o_iv"
    m = m.withColumns({**{f"user_genre_{k}": F.col(up)[k] for k in range(n)},
                       **{f"item_genre_{k}": F.col(iv)[k] for k in range(n)}})
    return m.drop(*[c for c in m.columns if c in ("_up", "_iv") or c.startswith("_o_")])


def retrieve_lists(user_vecs: DataFrame, item_vecs: DataFrame, centroids: DataFrame, dim: int,
                   n_candidates: int = 500, n_probe: int = 10, **kw) -> tuple[DataFrame, DataFrame]:
    """V1, one row per user with a candidate: ``(user_id, item_ids, scores)``, best first,
    and ``item_id`` of the items that can be candidates of any user."""
    from rankloom.operators import retrieval as R
    from rankloom.session import materialize
    post = materialize(R.assign_lists(item_vecs, centroids, dim), "postings")
    q = user_vecs.select(F.col("user_id").alias("query_id"), "vec")
    lists, items = R.ann_lists(q, post, centroids, dim, n_candidates, n_probe, **kw)
    return lists.withColumnRenamed("query_id", "user_id"), items


def reachable_features(item_feats: DataFrame, items: DataFrame) -> DataFrame:
    """Features of the items that can be candidates, written once."""
    from rankloom.session import materialize
    return materialize(item_feats.join(items, "item_id", "left_semi"), "reachable_features")


def retrieve_candidates(user_vecs: DataFrame, item_vecs: DataFrame, centroids: DataFrame, dim: int,
                        n_candidates: int = 500, n_probe: int = 10, **kw) -> DataFrame:
    """V1: top ``n_candidates`` items per user by list-pruned inner product."""
    return list_rows(retrieve_lists(user_vecs, item_vecs, centroids, dim, n_candidates, n_probe, **kw)[0]).drop("rank")


def list_rows(lists: DataFrame, k: int | None = None) -> DataFrame:
    """``retrieve_lists`` as rows ``(user_id, item_id, retrieval_score, rank)``; the k
    best of each list if k is given."""
    if k is not None:       # the lists are cut before they fan out
        lists = lists.select("user_id", F.slice("item_ids", 1, k).alias("item_ids"), F.slice("scores", 1, k).alias("scores"))
    return lists.select("user_id", "scores", F.posexplode("item_ids").alias("_p", "item_id")).select(
        "user_id", "item_id", F.col("scores")[F.col("_p")].alias("retrieval_score"), (F.col("_p") + 1).alias("rank"))


def cold_users(users: DataFrame, user_vecs: DataFrame) -> DataFrame:
    """V5: users with no embedding (no rating rows) -- the popularity fallback set."""
    return users.select("user_id").join(user_vecs.select("user_id"), "user_id", "left_anti")


def fallback_lists(users_without: DataFrame, ratings: DataFrame, k: int) -> DataFrame:
    """V5/V6: the T3 list for each listed user (k rows, broadcast: bounded by k)."""
    top = popularity_top_k(ratings, k).select("item_id", "rank", "score", "retrieval_score")
    # k rows: attach them to every listed user by an array literal of structs built
    # from the bounded top-k frame (scalar subquery) -- no join on a constant key.
    arr = top.select(F.sort_array(F.collect_list(F.struct("rank", "item_id", "score", "retrieval_score")))).scalar()
    return users_without.withColumn("r", F.explode(arr)).select(*users_without.columns, "r.*")


def recommend_batch(ratings: DataFrame, users: DataFrame, movies: DataFrame, user_feats: DataFrame,
                    item_feats: DataFrame, centroids: DataFrame, k: int = 20, n_candidates: int = 500,
                    n_probe: int = 10, weights: dict | None = None, vocab=DRIVER_GENRES,
                    exclude_seen: DataFrame | None = None, candidates: DataFrame | tuple | None = None,
                    user_vecs: DataFrame | None = None, item_vecs: DataFrame | None = None, dim: int | None = None,
                    scorer=None, **kw) -> DataFrame:
    """V3 (+V1, V2, V5, T1, J8): ranked lists for all users in one job.

    Warm users: retrieval -> serving features -> score -> top-k; cold users (no
    vector): popularity top-k. Retrieval takes content vectors unless ``user_vecs
    (user_id, vec)``, ``item_vecs(item_id, vec)`` and ``dim`` are given (e.g. of a
    trained two-tower model, with its own ``centroids``); ``scorer(features)`` adds
    ``score`` (e.g. ``RankerModel.predict``), by default the linear scorer. Output
    ``(user_id, rank, item_id, title, score, retrieval_score, genres, source)``.
    """
    from rankloom.operators.ranker import linear_score
    from rankloom.operators.towers import content_item_vectors, content_user_vectors
    if (user_vecs is None) != (item_vecs is None):
        raise ValueError("user_vecs and item_vecs go together")
    uvec = content_user_vectors(user_feats) if user_vecs is None else user_vecs
    ivec = content_item_vectors(movies, vocab) if item_vecs is None else item_vecs
    if candidates is not None:      # rows, or lists and their items
        cands, items = candidates if isinstance(candidates, tuple) else (candidates, None)
    else:
        cands, items = retrieve_lists(uvec, ivec, centroids, dim or len(vocab), n_candidates, n_probe, **kw)
    if items is not None:
        item_feats = reachable_features(item_feats, items)
    if exclude_seen is not None:   # J12 (extension): drop items the user rated in *training* rows
        cands = list_rows(cands).drop("rank") if "item_ids" in cands.columns else cands
        cands = cands.join(exclude_seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    feats = serving_features(cands, user_feats, item_feats, len(vocab))
    scored = scorer(feats) if scorer is not None else linear_score(feats, weights or DEFAULT_WEIGHTS)
    from rankloom.session import materialize
    # written once (k rows per user): read by the output and by the V6 check below
    warm = materialize(top_k_per_user(scored.select("user_id", "item_id", "score", "retrieval_score"), k)
                       .withColumn("source", F.lit("model")), "warm_lists")
    # V6: warm users for whom the model produced no row also get the fallback list
    empty = uvec.select("user_id").join(users.select("user_id"), "user_id", "left_semi") \
        .join(warm.select("user_id"), "user_id", "left_anti")
    without = cold_users(users, uvec).withColumn("source", F.lit("popularity")).unionByName(empty.withColumn("source", F.lit("fallback")))
    cols = ["user_id", "rank", "item_id", "score", "retrieval_score", "source"]
    allr = warm.select(*cols).unionByName(fallback_lists(without, ratings, k).select(*cols))
    return enrich(allr, movies).select("user_id", "rank", "item_id", "title", "score", "retrieval_score",
                                       "genres", "source")


def serve_with_cache(requests: DataFrame, cached: DataFrame, compute, strict: bool = True, write_back=None) -> DataFrame:
    """V4: split requests ``(request_id, user_id, k)`` into cache hits and misses.

    A cached list is a hit only if it can answer k (``size >= k`` or built with
    ``k_built >= k``; ``strict=False`` accepts any live list, as the reference
    does). Hits are truncated to k; misses are computed by
    ``compute(users) -> recs(user_id, rank, item_id, title, score, retrieval_score, genres)``
    for the largest k asked and cut per request. ``write_back(recs)`` is given the
    computed lists of the misses (e.g. to ``store.cache_recs``).
    """
    j = requests.join(cached, "user_id", "left")
    size_ok = F.size("recs") >= F.col("k")
    if "k_built" in cached.columns:
        size_ok = size_ok | (F.col("k_built") >= F.col("k"))
    hit = F.col("recs").isNotNull() & (size_ok if strict else F.lit(True))
    j = j.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    hits = j.filter("_hit").select("request_id", "user_id", "k",
                                   F.explode(F.slice("recs", 1, F.col("k"))).alias("r")) \
        .select("request_id", "user_id", "r.*").withColumn("source", F.lit("cache"))
    misses = j.filter(~F.col("_hit")).select("request_id", "user_id", "k")
    fresh = compute(misses.select("user_id").distinct())
    if write_back is not None:
        from rankloom.session import materialize
        fresh = materialize(fresh, "fresh_lists")      # read by the answer and by the write
        write_back(fresh)
    served = misses.join(fresh, "user_id", "inner").filter(F.col("rank") <= F.col("k")).drop("k") \
        .withColumn("source", F.lit("model"))
    cols = ["request_id", "user_id", "rank", "item_id", "title", "score", "retrieval_score", "genres", "source"]
    return hits.select(*cols).unionByName(served.select(*cols))


def responses(recs: DataFrame, digits: int = 6, candidates: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """V7 + F22: one response per user -- the rank-ordered list of served rows, scores
    rounded to 6 places, their number and whether they came from the cache. With
    ``candidates(user_id, ...)`` the number of candidates (0 for a user without), with
    ``latency(user_id, latency_ms)`` the time taken."""
    items = F.sort_array(F.collect_list(F.struct(
        "rank", "item_id", "title", F.round("score", digits).alias("score"),
        F.round("retrieval_score", digits).alias("retrieval_score"), "genres")))
    out = recs.groupBy("user_id").agg(items.alias("recommendations"), F.first("source").alias("source"),
                                      F.count(F.lit(1)).alias("n_results"), F.max(F.col("source") == "cache").alias("cache_hit"))
    if candidates is not None:
        n = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_candidates"))
        out = out.join(n, "user_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return out if latency is None else out.join(latency.select("user_id", "latency_ms"), "user_id", "left")


def request_records(served: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """One record per served request (latency, stage times, candidates, cache hit),
    ready for an append sink (``df.write.mode('append')`` or a stream's foreachBatch)."""
    per = served.groupBy("request_id", "user_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.max(F.col("source") == "cache").alias("cache_hit"))
    if latency is not None:
        per = per.join(latency, "request_id", "left")
    return per
