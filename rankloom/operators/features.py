"""User, item and pair features.

All statistics are ``groupBy`` aggregates with map-side partial aggregation,
so a hot user or item never funnels raw rows into one task. Catalogue-wide
constants (min/max for scaling) are scalar subqueries, not cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.genres import DRIVER_GENRES, N_GENRES, multi_hot
from rankloom.functions.vectors import dot, l2_normalize, zeros

USER_SCALARS = ("avg_rating", "log_rating_count", "recency_score",
                "gender_encoded", "age_normalized", "occupation_normalized")
ITEM_SCALARS = ("item_avg_rating", "item_log_rating_count", "popularity_score",
                "rating_stddev", "year_normalized")

USER_PARTS = 4      # tasks that share a user's ratings before they are summed

# The ranker's 50-column feature contract, in order.
FEATURE_COLUMNS = [
    "avg_rating", "log_rating_count", "recency_score",
    "gender_encoded", "age_normalized", "occupation_normalized",
    "item_avg_rating", "item_log_rating_count", "popularity_score",
    "rating_stddev", "year_normalized",
    "rating_diff", "user_item_popularity_ratio", "genre_affinity",
] + [f"user_genre_{i}" for i in range(N_GENRES)] + [f"item_genre_{i}" for i in range(N_GENRES)]


def _as_of(ratings: DataFrame, as_of) -> DataFrame:
    """Leak-free variant: only ratings strictly before ``as_of`` (None = all)."""
    return ratings if as_of is None else ratings.filter(F.col("ts") < F.lit(as_of))


def item_genre_vectors(movies: DataFrame, vocab=DRIVER_GENRES) -> DataFrame:
    """F1 over the catalogue: ``(item_id, genre_vector)``."""
    return movies.select("item_id", multi_hot("genres", vocab).alias("genre_vector"))


def user_stats(ratings: DataFrame) -> DataFrame:
    """A1: mean rating, count, last activity per user."""
    return ratings.groupBy("user_id").agg(
        F.avg("rating").alias("avg_rating"),
        F.count(F.lit(1)).alias("rating_count"),
        F.max("ts").alias("last_ts"))


def recency(stats: DataFrame) -> DataFrame:
    """last activity min-max scaled over users; constant range -> 1.0."""
    from rankloom.functions.scalars import epoch_micros
    t = epoch_micros(F.col("last_ts"))
    lo = stats.select(F.min(t)).scalar()
    hi = stats.select(F.max(t)).scalar()
    rng = (hi - lo).cast("double")
    return stats.withColumn(
        "recency_score", F.when(rng > 0, (t - lo).cast("double") / rng).otherwise(F.lit(1.0)))


def demographics(users: DataFrame) -> DataFrame:
    """gender code and max-normalised age / occupation."""
    max_age = users.select(F.max("age")).scalar()
    max_occ = users.select(F.max("occupation")).scalar()
    return users.select(
        "user_id",
        F.when(F.col("gender") == "F", 1.0).otherwise(0.0).alias("gender_encoded"),
        (F.col("age") / max_age).alias("age_normalized"),
        (F.col("occupation") / max_occ).alias("occupation_normalized"))


def genre_preference(ratings: DataFrame, genre_vecs: DataFrame, n: int = N_GENRES,
                     min_rating: float = 4.0) -> DataFrame:
    """A3: per user mean of ``genre_vec * (rating - 3)`` over liked ratings, L2-normalised.

    One ``groupBy`` with ``n`` conditional averages -- one shuffle, no explode.
    Liked ratings whose item has no catalogue row are dropped (inner join, J4).
    """
    liked = ratings.filter(F.col("rating") >= min_rating).select("user_id", "item_id", "rating")
    j = liked.join(genre_vecs, "item_id", "inner")
    w = F.col("rating") - 3.0
    agg = j.groupBy("user_id").agg(*[F.avg(F.col("genre_vector")[i] * w).alias(f"g{i}") for i in range(n)])
    arr = F.array(*[F.col(f"g{i}") for i in range(n)])
    return agg.select("user_id", l2_normalize(arr, n).alias("genre_pref"))


def user_aggregates(ratings: DataFrame, genre_vecs: DataFrame, n: int = N_GENRES,
                    min_rating: float = 4.0) -> DataFrame:
    """A1 and the A3 sums in **one** pass over the ratings: ratings ⟕ genre vectors,
    one ``groupBy(user)`` with mean / count / last activity and ``n`` averages of
    ``vec * (rating - 3)`` over liked rows whose item is catalogued."""
    # a user's rows lie in USER_PARTS tasks: partial sums of rows dealt by item would hold
    # nearly all users in every task, and one task per user would hold a hot user's rows alone
    j = ratings.select("user_id", "item_id", "rating", "ts").join(genre_vecs, "item_id", "left") \
        .repartition("user_id", F.pmod(F.xxhash64("item_id"), F.lit(USER_PARTS)))
    liked = (F.col("rating") >= min_rating) & F.col("genre_vector").isNotNull()
    w = F.col("rating") - 3.0
    # the averages have one count in common: half of the aggregation's buffer
    sums = j.groupBy("user_id").agg(
        F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("rating_count"), F.max("ts").alias("last_ts"),
        F.count_if(liked).alias("_liked"),
        *[F.sum(F.when(liked, F.col("genre_vector")[i] * w)).alias(f"g{i}") for i in range(n)])
    return sums.withColumns({f"g{i}": F.try_divide(f"g{i}", F.col("_liked").cast("double")) for i in range(n)}).drop("_liked")


def user_features(ratings: DataFrame, users: DataFrame, movies: DataFrame,
                  vocab=DRIVER_GENRES, as_of=None) -> DataFrame:
    """Stats ⟕ demographics, with the genre preference; one row per rated user.

    The per-user aggregate is written once (user-sized), so the recency bounds
    (scalar subqueries) scan it instead of re-running the ratings join."""
    from rankloom.session import materialize
    n = len(vocab)
    r = _as_of(ratings, as_of)
    vecs = item_genre_vectors(movies, vocab).select("item_id", F.col("genre_vector").cast("array<tinyint>").alias("genre_vector"))
    agg = materialize(user_aggregates(r, vecs, n), "user_aggregates")
    arr = F.array(*[F.col(f"g{i}") for i in range(n)])
    pref = F.when(F.col("g0").isNull(), zeros(n)).otherwise(l2_normalize(arr, n))
    st = recency(agg).withColumn("log_rating_count", F.log1p("rating_count")).withColumn("genre_pref", pref)
    st = st.drop("last_ts", *[f"g{i}" for i in range(n)])
    return st.join(demographics(users), "user_id", "left")


def item_stats(ratings: DataFrame) -> DataFrame:
    """A2: mean, count and sample std (single rating -> 0) per item."""
    return ratings.groupBy("item_id").agg(
        F.avg("rating").alias("avg_rating"),
        F.count(F.lit(1)).alias("rating_count"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_stddev"))


def catalogue_years(movies: DataFrame) -> DataFrame:
    """Year from a trailing ``(YYYY)``; min-max over the whole catalogue
    with ``+1e-8`` in the divisor; no year -> 0.5."""
    year = F.nullif(F.regexp_extract("title", r"\((\d{4})\)$", 1), F.lit("")).cast("double")
    m = movies.withColumn("year", year)
    lo = m.select(F.min("year")).scalar()
    hi = m.select(F.max("year")).scalar()
    return m.withColumn("year_normalized",
                        F.coalesce((F.col("year") - lo) / (hi - lo + F.lit(1e-8)), F.lit(0.5)))


def item_features(ratings: DataFrame, movies: DataFrame, vocab=DRIVER_GENRES, as_of=None) -> DataFrame:
    """Item stats ⟕ catalogue (title, genre vector, year); one row per rated item."""
    from rankloom.session import materialize
    st = materialize(item_stats(_as_of(ratings, as_of)), "item_stats").withColumn("log_rating_count", F.log1p("rating_count"))
    max_log = st.select(F.max("log_rating_count")).scalar()
    st = st.withColumn("popularity_score", F.col("log_rating_count") / max_log)
    cat = catalogue_years(movies).select(
        "item_id", "title", multi_hot("genres", vocab).alias("genre_vector"), "year_normalized")
    out = st.join(cat, "item_id", "left")
    return out.withColumn("genre_vector", F.coalesce("genre_vector", zeros(len(vocab))))


def pair_features(pairs: DataFrame, user_feats: DataFrame, item_feats: DataFrame,
                  n: int = N_GENRES, carry=()) -> DataFrame:
    """J3 + F10-F14: the flat 50-feature matrix for ``(user_id, item_id, label, query_id)`` rows
    (and the columns of ``pairs`` named in ``carry``, unchanged).

    Vectors travel as arrays through the two joins and are expanded last;
    every remaining null becomes 0.0 (training defaults).
    """
    u = user_feats.select("user_id", *USER_SCALARS, "genre_pref")
    i = item_feats.select(
        "item_id", F.col("avg_rating").alias("item_avg_rating"),
        F.col("log_rating_count").alias("item_log_rating_count"),
        "popularity_score", "rating_stddev", "year_normalized", "genre_vector")
    # the item's side first: its vector is mostly zeros and small when it moves on to the user's, whose numbers are dense
    m = pairs.select("user_id", "item_id", "label", "query_id", *carry) \
        .join(i, "item_id", "left").join(u, "user_id", "left")
    cols = [F.col(c) for c in ("user_id", "item_id", "label", "query_id", *carry)]
    cols += [F.col(c) for c in USER_SCALARS + ITEM_SCALARS]
    cols += [(F.col("avg_rating") - F.col("item_avg_rating")).alias("rating_diff"),
             (F.col("log_rating_count") / (F.col("item_log_rating_count") + F.lit(1e-8)))
             .alias("user_item_popularity_ratio"),
             dot("genre_pref", "genre_vector", n).alias("genre_affinity")]
    cols += [F.col("genre_pref")[k].alias(f"user_genre_{k}") for k in range(n)]
    cols += [F.col("genre_vector")[k].alias(f"item_genre_{k}") for k in range(n)]
    out = m.select(*cols)
    return out.na.fill(0.0, subset=FEATURE_COLUMNS)


def feature_contract(df: DataFrame, wanted=None) -> list[str]:
    """the ordered feature columns present in ``df``."""
    wanted = FEATURE_COLUMNS if wanted is None else wanted
    return [c for c in wanted if c in df.columns]


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """F16: drop rows with a null in any feature column."""
    return df.dropna(subset=feature_contract(df) if cols is None else list(cols))


def add_missing_features(df: DataFrame, wanted=None) -> DataFrame:
    """add absent ranker columns as 0.0."""
    wanted = FEATURE_COLUMNS if wanted is None else wanted
    missing = {c: F.lit(0.0) for c in wanted if c not in df.columns}
    return df.withColumns(missing) if missing else df
