"""``::``-delimited text tables (S1-S4) and a writer used for round trips.

Read with an explicit schema (no inference), a two-character separator,
latin-1 for user / movie files and quoting disabled so literal quotes survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS_SCHEMA = "user_id long, item_id long, rating double, epoch long"
USERS_SCHEMA = "user_id long, gender string, age int, occupation int, zip_code string"
MOVIES_SCHEMA = "item_id long, title string, genres string"


def _read(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return (spark.read.option("sep", "::").option("quote", "\u0000").option("escape", "\u0000")
            .option("encoding", encoding).option("mode", "FAILFAST").schema(schema).csv(path))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2: ``user::item::rating::epoch`` -> ``(user_id, item_id, rating, ts)``."""
    r = _read(spark, path, RATINGS_SCHEMA)
    from rankloom.functions.scalars import from_epoch_seconds
    return r.select("user_id", "item_id", "rating", from_epoch_seconds(F.col("epoch")).alias("ts"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """S3: latin-1 user table."""
    return _read(spark, path, USERS_SCHEMA, "ISO-8859-1")


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 movie table; accents and literal quotes are kept."""
    return _read(spark, path, MOVIES_SCHEMA, "ISO-8859-1")


def write_dat(df: DataFrame, path: str, cols, encoding: str = "ISO-8859-1") -> None:
    """Write ``cols`` joined by ``::``, one line per row, in the encoding the
    readers expect (one CSV column without quoting, so the text stays as it is)."""
    df.select(F.concat_ws("::", *[F.col(c).cast("string") for c in cols]).alias("value")) \
        .write.mode("overwrite").option("encoding", encoding).option("sep", "\u0001").option("quote", "") \
        .option("escapeQuotes", "false").option("ignoreLeadingWhiteSpace", "false") \
        .option("ignoreTrailingWhiteSpace", "false").csv(path)
