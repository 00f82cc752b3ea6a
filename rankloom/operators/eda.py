"""Dataset exploration tables.

Everything is a partial+final aggregate. Popularity curves avoid a
single-partition window over all items: positions come from ``global_index``
and cumulative sums from the small frame of distinct popularity values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.binning import equal_width_bin
from rankloom.functions.genres import DRIVER_GENRES, genre_tokens
from rankloom.operators.indexing import global_index

# Age code -> label of the demographic table, in display order.
AGE_LABELS = ((1, "<18"), (18, "18-24"), (25, "25-34"), (35, "35-44"), (45, "45-49"), (50, "50-55"), (56, "56+"))


def dataset_summary(ratings: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A6 + A8: rows, distinct users/items, sparsity ``1 - n/(users x items)``.

    ``approx=True`` uses HyperLogLog++ sketches (``approx_count_distinct``, relative
    standard deviation ``rsd``): constant memory per task instead of a distinct shuffle."""
    cd = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return ratings.agg(F.count(F.lit(1)).alias("n_ratings"), cd("user_id").alias("n_users"),
                       cd("item_id").alias("n_items")).withColumn(
        "sparsity", F.lit(1.0) - F.col("n_ratings") / (F.col("n_users") * F.col("n_items")))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Count per rating value."""
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, col: str, n_bins: int) -> DataFrame:
    """K1 over the column's own [min, max]: every bin (empty ones too) with its lower edge."""
    lo = values.select(F.min(col)).scalar()
    hi = values.select(F.max(col)).scalar()
    b = values.filter(F.col(col).isNotNull()).select(equal_width_bin(F.col(col).cast("double"), lo, hi, n_bins).alias("bin"))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = values.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    w = (hi - lo) / F.lit(float(n_bins))
    return spine.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * w).cast("double").alias("bin_lo"), F.coalesce("n", F.lit(0)).alias("n"))


def user_activity(ratings: DataFrame, n_bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Histogram of ratings per user (50 equal bins) and the median count."""
    per = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ratings"))
    med = per.agg(F.percentile("n_ratings", 0.5).alias("median_ratings"))
    return histogram(per, "n_ratings", n_bins), med


def genre_counts(movies: DataFrame, vocab=DRIVER_GENRES) -> DataFrame:
    """A10: token occurrences per vocabulary genre; zeros kept, unknown tokens dropped."""
    toks = movies.select(F.explode(genre_tokens("genres")).alias("genre"))
    counts = toks.groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    spark = movies.sparkSession
    v = spark.createDataFrame([(i, g) for i, g in enumerate(vocab)], "pos int, genre string")
    return v.join(counts, "genre", "left").select("pos", "genre", F.coalesce("n", F.lit(0)).alias("n"))


def gender_summary(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """A11 + J9: users per gender and mean rating by gender (ratings ⋈ users)."""
    n = users.groupBy("gender").agg(F.count(F.lit(1)).alias("n_users"))
    m = ratings.select("user_id", "rating").join(users.select("user_id", "gender"), "user_id", "inner") \
        .groupBy("gender").agg(F.avg("rating").alias("mean_rating"), F.count(F.lit(1)).alias("n_ratings"))
    return n.join(m, "gender", "full")


def age_groups(users: DataFrame) -> DataFrame:
    """users per age label in fixed order, empty groups kept."""
    spark = users.sparkSession
    labels = spark.createDataFrame([(i, a, l) for i, (a, l) in enumerate(AGE_LABELS)], "pos int, age int, age_label string")
    c = users.groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(c, "age", "left").select("pos", "age_label", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_activity(ratings: DataFrame) -> DataFrame:
    """Ratings per calendar month."""
    return ratings.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def feature_summary(df: DataFrame, col: str, n_bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """30-bin histogram plus mean and sample std of a feature column."""
    s = df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))
    return histogram(df.select(col), col, n_bins), s


def popularity_curve(ratings: DataFrame) -> DataFrame:
    """W6 + W8: items by descending rating count (ties: item id) with 0-based
    position, 1-based rank and cumulative share of all ratings."""
    pop = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"))
    pos = global_index(pop.withColumn("_neg", -F.col("n_ratings")), ["_neg", "item_id"], "pos").drop("_neg")
    # one row per distinct popularity value: cumulative totals above each value
    by_n = pop.groupBy("n_ratings").agg(F.count(F.lit(1)).alias("n_items"))
    w = Window.orderBy(F.desc("n_ratings")).rowsBetween(Window.unboundedPreceding, -1)
    grp = by_n.select("n_ratings",
                      F.coalesce(F.sum("n_items").over(w), F.lit(0)).alias("_start"),
                      F.coalesce(F.sum(F.col("n_items") * F.col("n_ratings")).over(w), F.lit(0)).alias("_before"))
    total = ratings.select(F.count(F.lit(1))).scalar()
    j = pos.join(grp, "n_ratings", "inner")
    cum = F.col("_before") + (F.col("pos") - F.col("_start") + 1) * F.col("n_ratings")
    return j.select("item_id", "n_ratings", "pos", (F.col("pos") + 1).alias("rank"),
                    (cum / total).alias("cumulative_share"))


def long_tail(ratings: DataFrame, share: float = 0.8) -> DataFrame:
    """W7 + A14: first 0-based position whose cumulative share reaches ``share``,
    as a fraction of items; most popular count; median count."""
    curve = popularity_curve(ratings)
    return curve.agg(
        F.min(F.when(F.col("cumulative_share") >= share, F.col("pos"))).alias("pos_80"),
        F.count(F.lit(1)).alias("n_items"), F.max("n_ratings").alias("max_ratings"),
        F.percentile("n_ratings", 0.5).alias("median_ratings"),
    ).withColumn("share_of_items", F.col("pos_80") / F.col("n_items"))
