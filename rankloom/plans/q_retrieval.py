"""Registered retrieval queries over the driver's ``embeddings`` table.

Every vector is indexed and every vector is also a query (self-search), so
the work grows with the table. Centroids are the caller-given label means.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.functions.vectors import norm
from rankloom.operators import retrieval as R
from rankloom.plans import sqlfrag as Q
from rankloom.plans.catalog import register, rounded
from rankloom.sources import tables as T

DIM = 64
N_PROBE = 3
K = 100


def _index(spark, sf_dir):
    """Index build; centroids and postings are written once (the index's natural
    materialisation point) and read by every search."""
    from rankloom.session import materialize
    e = T.embeddings(spark, sf_dir)
    cent = materialize(R.label_centroids(e, DIM), "centroids")
    return e, cent, materialize(R.assign_lists(e, cent, DIM), "postings")


def _queries(e):
    return e.select(F.col("item_id").alias("query_id"), "vec")


_IVF = lambda n_probe, k: T.sql_with("emb").rstrip() + Q.ivf_ctes(
    DIM, n_probe, k, "emb", Q.label_centroids_sql(DIM), "(SELECT item_id AS query_id, vec FROM emb)")


@register("ivf_assign", _IVF(N_PROBE, K) + "SELECT list_id, item_id FROM asg")
def ivf_assign(spark, sf_dir):
    """Each normalised vector goes to the list of its best centroid."""
    return _index(spark, sf_dir)[2].select("list_id", "item_id")


@register("ann_search", _IVF(N_PROBE, K) + "SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def ann_search(spark, sf_dir):
    """R4 + T2: top-100 by inner product over the 3 best lists, every vector as a query."""
    e, cent, post = _index(spark, sf_dir)
    return rounded(R.ann_search(_queries(e), post, cent, DIM, K, N_PROBE))


@register("ann_search_blocked", _IVF(N_PROBE, K) + "SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def ann_search_blocked(spark, sf_dir):
    """R4 over many small blocks: lists span blocks, and later blocks return only
    rows that reach the score found in the first ones."""
    e, cent, post = _index(spark, sf_dir)
    return rounded(R.ann_search(_queries(e), post, cent, DIM, K, N_PROBE, user_block=64, item_block=32))


@register("saved_index_search", _IVF(N_PROBE, K) + "SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def saved_index_search(spark, sf_dir):
    """R9 + R4: the index is saved, loaded, and searched in the probed lists only."""
    from rankloom.session import scratch_dir
    e, cent, post = _index(spark, sf_dir)
    path = f"{scratch_dir(spark, 'index')}/{uuid.uuid4().hex}"
    R.save_index(cent, post, path)
    cent, post = R.load_index(spark, path)
    post = R.probed_postings(_queries(e), post, cent, DIM, N_PROBE)
    return rounded(R.ann_search(_queries(e), post, cent, DIM, K, N_PROBE))


@register("exact_search", _IVF(10_000, K) + "SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def exact_search(spark, sf_dir):
    """J10 + T2: exhaustive top-100 (every list probed) -- the exact baseline."""
    e, cent, post = _index(spark, sf_dir)
    return rounded(R.exact_search(_queries(e), post, cent, DIM, K))


@register("ann_batch_search", T.sql_with("emb").rstrip() + Q.ivf_ctes(
    DIM, 1, 200, "emb", Q.label_centroids_sql(DIM), "(SELECT item_id AS query_id, vec FROM emb)") + """,
slots AS (SELECT query_id, unnest(range(1, least(200, (SELECT count(*) FROM emb)) + 1)) AS rank FROM qn)
SELECT s.query_id, CAST(s.rank AS INTEGER) AS rank, coalesce(h.item_id, -1) AS item_id,
       round(coalesce(h.score, -3.4028234663852886e38), 6) AS score
FROM slots s LEFT JOIN hits h ON s.query_id = h.query_id AND s.rank = h.rank""")
def ann_batch_search(spark, sf_dir):
    """200 slots per query with one probed list; unfilled slots are item -1."""
    e, cent, post = _index(spark, sf_dir)
    return rounded(R.ann_batch_search(_queries(e), post, cent, DIM, 200, 1))


@register("ann_recall", T.sql_with("emb").rstrip() + Q.ivf_ctes(
    DIM, N_PROBE, K, "emb", Q.label_centroids_sql(DIM), "(SELECT item_id AS query_id, vec FROM emb)") + """,
approx AS (SELECT query_id, item_id FROM hits),
exact AS (SELECT query_id, item_id FROM (
  SELECT q.query_id, n.item_id, row_number() OVER (PARTITION BY q.query_id ORDER BY """ + Q.dot("q.qv", "n.u", DIM)
          + f""" DESC, n.item_id) AS rank
  FROM qn q CROSS JOIN nv n) WHERE rank <= {K})
SELECT e.query_id, round(count(a.item_id) / count(*), 6) AS recall
FROM exact e LEFT JOIN approx a ON e.query_id = a.query_id AND e.item_id = a.item_id GROUP BY e.query_id""")
def ann_recall(spark, sf_dir):
    """R6 + R7: recall@100 of the 3-list search against the exhaustive search."""
    e, cent, post = _index(spark, sf_dir)
    q = _queries(e)
    return rounded(R.ann_recall(R.ann_search(q, post, cent, DIM, K, N_PROBE, as_lists=True),
                                R.exact_search(q, post, cent, DIM, K, as_lists=True)))


@register("index_stats", _IVF(N_PROBE, K) + f""",
sz AS (SELECT list_id, count(*) AS n FROM asg GROUP BY list_id)
SELECT sum(n) AS n_vectors, {DIM} AS dim, (SELECT count(*) FROM cent) AS n_lists, count(*) AS non_empty_lists,
       {N_PROBE} AS n_probe, 'inner_product' AS metric, max(n) AS max_list_size, min(n) AS min_list_size,
       round(avg(n), 6) AS avg_list_size
FROM sz""")
def index_stats(spark, sf_dir):
    """Index statistics incl. list-size skew."""
    e, cent, post = _index(spark, sf_dir)
    out = R.index_stats(post, DIM, cent.count(), N_PROBE)
    return rounded(out.select(F.col("n_vectors").cast("bigint"), F.col("dim").cast("int"),
                              F.col("n_lists").cast("bigint"), "non_empty_lists", F.col("n_probe").cast("int"),
                              "metric", "max_list_size", "min_list_size", "avg_list_size"))


@register("list_count_rule", """
SELECT count(*) AS n_vectors, CAST(CASE WHEN count(*) >= 39 * 100 THEN 100 ELSE greatest(1, count(*) // 39) END AS BIGINT)
       AS n_lists FROM embeddings""")
def list_count_rule(spark, sf_dir):
    """R2: effective list count for the table size (default 100 lists)."""
    e = T.embeddings(spark, sf_dir)
    n = F.count(F.lit(1))
    return e.agg(n.alias("n_vectors"), F.when(n >= 39 * 100, F.lit(100))
                 .otherwise(F.greatest(F.lit(1), F.floor(n / 39))).cast("bigint").alias("n_lists"))


@register("embedding_norms", f"""
SELECT round(avg(nrm), 6) AS mean_norm, round(min(nrm), 6) AS min_norm, round(max(nrm), 6) AS max_norm
FROM (SELECT sqrt({Q.dot('v', 'v', DIM)}) AS nrm FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def embedding_norms(spark, sf_dir):
    """M9: mean / min / max L2 norm of the stored vectors."""
    e = T.embeddings(spark, sf_dir).select(norm("vec", DIM).alias("n"))
    return rounded(e.agg(F.avg("n").alias("mean_norm"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm")))
