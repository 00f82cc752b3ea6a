"""Driver tables and the canonical recommendation views derived from them.

``ratings(user_id, item_id, rating, ts, <row key>)``, ``users``, ``movies``
and ``requests`` are plain DataFrame projections/joins of the TPC-H-ish
tables; every operator downstream works on these schemas only.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Full row key that makes a ratings row unique (ties on ts are broken by it).
RATING_ORDER_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "l_quantity", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit 1..5 ratings: one row per line item, rated by the order's customer."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        F.col("o_orderdate").alias("ts"),
        *RATING_ORDER_KEY,
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    age = (F.when(F.col("c_nationkey") % 7 == 0, 1).when(F.col("c_nationkey") % 7 == 1, 18)
           .when(F.col("c_nationkey") % 7 == 2, 25).when(F.col("c_nationkey") % 7 == 3, 35)
           .when(F.col("c_nationkey") % 7 == 4, 45).when(F.col("c_nationkey") % 7 == 5, 50)
           .otherwise(56))
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "F").otherwise("M").alias("gender"),
        age.cast("int").alias("age"),
        (F.col("c_nationkey") % 21).cast("int").alias("occupation"),
        F.col("c_custkey").cast("string").alias("zip_code"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).otherwise(
        F.concat(F.col("p_name"), F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")")))
    genres = F.concat(F.regexp_replace(F.col("p_name"), " ", "|"), F.lit("|"), F.col("p_type"))
    return p.select(F.col("p_partkey").alias("item_id"), title.alias("title"), genres.alias("genres"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log view over ``events`` (event type -> endpoint path, k from props)."""
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(e: DataFrame) -> DataFrame:
    """The request-log projection of an events frame (batch or streaming)."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = (F.when(F.col("event_type") == "view", F.lit("/recommend"))
            .when(F.col("event_type") == "click",
                  F.concat(F.lit("/recommend/"), F.col("user_id").cast("string")))
            .when(F.col("event_type") == "purchase", F.lit("/health"))
            .when(F.col("event_type") == "signup", F.lit("/model/info"))
            .otherwise(F.lit("/recommend")))
    return e.select(
        F.col("event_id").alias("request_id"), "ts", "user_id", path.alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("latency_ms"), k.alias("k"), ((k % 4) == 0).alias("cache_hit"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


# --------------------------------------------------------------------------- #
# DuckDB text of the same views, for the oracle SQL.                          #
# --------------------------------------------------------------------------- #

SQL_VIEWS = {
    "ratings": """ratings AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         CAST(1 + FLOOR((l.l_quantity - 1) / 10) AS DOUBLE) AS rating,
         o.o_orderdate AS ts,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_shipdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "users": """users AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD') THEN 'F' ELSE 'M' END AS gender,
         CAST(CASE c_nationkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 18 WHEN 2 THEN 25 WHEN 3 THEN 35
              WHEN 4 THEN 45 WHEN 5 THEN 50 ELSE 56 END AS INTEGER) AS age,
         CAST(c_nationkey % 21 AS INTEGER) AS occupation, CAST(c_custkey AS VARCHAR) AS zip_code
  FROM customer)""",
    "movies": """movies AS (
  SELECT p_partkey AS item_id,
         CASE WHEN p_partkey % 50 = 0 THEN p_name
              ELSE concat(p_name, ' (', CAST(1950 + p_size AS VARCHAR), ')') END AS title,
         concat(replace(p_name, ' ', '|'), '|', p_type) AS genres
  FROM part)""",
    "requests": """requests AS (
  SELECT event_id AS request_id, ts, user_id,
         CASE event_type WHEN 'view' THEN '/recommend'
              WHEN 'click' THEN concat('/recommend/', CAST(user_id AS VARCHAR))
              WHEN 'purchase' THEN '/health' WHEN 'signup' THEN '/model/info'
              ELSE '/recommend' END AS path,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         value AS latency_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0 AS cache_hit
  FROM events)""",
    "emb": """emb AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)""",
}


def sql_with(*names: str, extra: str = "") -> str:
    """``WITH`` prefix holding the named views (in dependency order) plus extra CTEs."""
    parts = [SQL_VIEWS[n] for n in names]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
