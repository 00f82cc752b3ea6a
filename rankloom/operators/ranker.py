"""Learning to rank.

* ``linear_score`` (L13): caller-given weights, exact and oracle-checkable.
* ``lambda_gradients`` (L3): LambdaMART first/second-order terms per row.
  Pairs are formed only between a query's current top ``truncation`` rows and
  the query's other rows (LightGBM's default truncation level is 30), so the
  pair count is at most ``truncation x rows`` per query -- linear, never all
  pairs. Whole queries are dealt to blocks of about ``QUERY_ROWS`` rows, whose pairs never become
  rows of a table; only queries beyond that size are ranked and paired by joins.
* ``fit_ranker`` (L1, L4-L6, L8): boosting loop over leaf-wise histogram trees
  (``operators.boosting``); a leaf's value is ``-sign(G) max(|G| - l1, 0) / (H + l2)``
  and ``lr x leaf`` is added to the scores. Trees are compiled to ``CASE WHEN``
  expressions, so scoring other frames stays JVM-side.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# LambdaMART settings of the reference ranker.
LGBM_PARAMS = {"n_rounds": 500, "num_leaves": 63, "learning_rate": 0.05, "min_child_samples": 20,
               "colsample_bytree": 0.8, "reg_alpha": 0.1, "reg_lambda": 0.1, "label_gain": (0, 1, 3, 7, 15),
               "eval_at": (5, 10, 20), "early_stopping_rounds": 30}
TRUNCATION = 30
SIGMOID = 1.0
QUERY_ROWS = 16384      # rows of a block of whole queries; a larger query spans tasks


def linear_score(df: DataFrame, weights: dict, bias: float = 0.0, out: str = "score") -> DataFrame:
    """``score = bias + sum(w_f * f)`` over caller-given weights (missing features -> 0)."""
    terms = [F.lit(float(bias))] + [F.lit(float(w)) * (F.col(c) if c in df.columns else F.lit(0.0))
                                    for c, w in weights.items()]
    return df.withColumn(out, reduce(lambda a, b: a + b, terms))


def rank_within_query(scored: DataFrame, tie=("row_id",)) -> DataFrame:
    """0-based ``pos`` by score (desc) inside each query, without a per-query window:
    dense global positions over ``(query_id, -score, tie)`` (range-partitioned, so a
    query holding a large share of rows spans many tasks) minus the query's start."""
    from rankloom.operators.indexing import global_index
    g = global_index(scored.withColumn("_neg", -F.col("score")), ["query_id", "_neg", *tie], "_g").drop("_neg")
    start = g.groupBy("query_id").agg(F.min("_g").alias("_s"))
    return g.join(start, "query_id").withColumn("pos", F.col("_g") - F.col("_s")).drop("_g", "_s")


def _gain(label: Column, label_gain) -> Column:
    expr = F.lit(float(label_gain[-1]))
    for i in reversed(range(len(label_gain))):
        expr = F.when(label == i, F.lit(float(label_gain[i]))).otherwise(expr)
    return expr


def lambda_gradients(scored: DataFrame, truncation: int = TRUNCATION, sigmoid: float = SIGMOID,
                     label_gain=LGBM_PARAMS["label_gain"], normalize: bool = True, tie=("row_id",), carry=()) -> DataFrame:
    """L3: ``(row_id, g, h)`` and the columns ``carry`` for ``scored(row_id, query_id, label, score)``,
    which is read twice. Rows without a pair are left out.

    Rows are ranked by score inside their query (ties: row id). For every pair
    with one side in the top ``truncation`` and different labels:
    ``dNDCG = |gain_hi - gain_lo| * |disc_hi - disc_lo| / maxDCG@truncation``,
    ``rho = 1 / (1 + exp(sigmoid (s_hi - s_lo)))``; the higher-labelled row gets
    ``g -= sigmoid rho dNDCG`` and the other ``g += ...``; both get
    ``h += sigmoid^2 rho (1 - rho) dNDCG``. With ``normalize`` a query's terms are
    scaled by ``log2(1 + S) / S`` where S is its sum of |lambda|.
    """
    args = (truncation, sigmoid, label_gain, normalize)
    sizes = scored.where("query_id IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    n, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if (most or 0) <= QUERY_ROWS:
        return _block_gradients(scored, n or 0, *args, tie, carry)
    wide = F.broadcast(sizes.where(F.col("_n") > QUERY_ROWS).select("query_id"))     # at most n / QUERY_ROWS rows
    by_joins = _paired_gradients(scored.join(wide, "query_id", "left_semi"), *args, tie)
    if carry:
        by_joins = by_joins.join(scored.select("row_id", *carry), "row_id")
    return _block_gradients(scored.join(wide, "query_id", "left_anti"), n, *args, tie, carry).unionByName(by_joins)


def _block_gradients(scored: DataFrame, n: int, truncation: int, sigmoid: float, label_gain, normalize: bool, tie, carry) -> DataFrame:
    """The terms of whole queries in one task."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    kept = list(dict.fromkeys(["row_id", *carry]))
    rows = scored.where("query_id IS NOT NULL").select(*dict.fromkeys([*kept, "query_id", "label", "score", *tie]))
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in kept), StructField("g", DoubleType()), StructField("h", DoubleType())])
    order = [("query_id", "ascending"), ("score", "descending"), *((c, "ascending") for c in tie)]
    gains = np.asarray(label_gain, np.float64)

    def run(table: pa.Table) -> pa.Table:
        from rankloom.operators import boosting
        table = table.sort_by(order)
        query = np.unique(table.column("query_id").to_numpy(), return_inverse=True)[1]
        label, score = table.column("label").to_numpy(), table.column("score").to_numpy()
        g, h, pos = boosting.lambda_terms(query, label, score, gains, truncation, sigmoid, normalize)
        at = np.flatnonzero(paired(query, label, pos, truncation) & (np.bincount(query, gains[np.minimum(label, len(gains) - 1)])[query] > 0))
        out = table.select(kept).take(pa.array(at))
        return out.append_column("g", pa.array(g[at])).append_column("h", pa.array(h[at]))
    blocks = max(1, -(-n // QUERY_ROWS))
    return rows.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks))).applyInArrow(run, schema)


def paired(query: np.ndarray, label: np.ndarray, pos: np.ndarray, truncation: int) -> np.ndarray:
    """Rows of a pair: two labels differ and one of the two rows is in the top ``truncation``. ``query`` is sorted."""
    def ends(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(int(query[-1]) + 1, np.iinfo(np.int64).max), np.full(int(query[-1]) + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, query[rows], label[rows])
        np.maximum.at(high, query[rows], label[rows])
        return low[query], high[query]
    low, high = ends(np.arange(len(query)))
    top_low, top_high = ends(np.flatnonzero(pos < truncation))
    return np.where(pos < truncation, low != high, (top_low != label) | (top_high != label))


def _paired_gradients(scored: DataFrame, truncation: int, sigmoid: float, label_gain, normalize: bool, tie) -> DataFrame:
    """The terms by joins of ranked rows: a query may span tasks."""
    r = rank_within_query(scored.select(*dict.fromkeys(["row_id", "query_id", "label", "score", *tie])), tie) \
        .withColumn("gain", _gain(F.col("label"), label_gain)) \
        .withColumn("disc", F.lit(1.0) / F.log2(F.col("pos") + 2.0))
    # ideal DCG at the truncation level, per query, from its gains sorted descending
    # (literal limit -> partial WindowGroupLimit: at most `truncation` rows per query leave a map task)
    wi = Window.partitionBy("query_id").orderBy(F.desc("gain"), "row_id")
    ideal = r.withColumn("_ip", F.row_number().over(wi)).filter(F.col("_ip") <= truncation) \
        .groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("_ip") + 1.0)).alias("max_dcg"))
    top = r.filter(F.col("pos") < truncation).select(
        "query_id", F.col("row_id").alias("a_id"), F.col("label").alias("a_label"), F.col("score").alias("a_score"),
        F.col("gain").alias("a_gain"), F.col("disc").alias("a_disc"), F.col("pos").alias("a_pos"))
    other = r.select("query_id", F.col("row_id").alias("b_id"), F.col("label").alias("b_label"),
                     F.col("score").alias("b_score"), F.col("gain").alias("b_gain"), F.col("disc").alias("b_disc"),
                     F.col("pos").alias("b_pos"))
    # each unordered pair once: b ranked below a (both top rows are counted from the higher one)
    p = top.join(other, "query_id").filter((F.col("b_pos") > F.col("a_pos")) & (F.col("a_label") != F.col("b_label")))
    p = p.join(ideal, "query_id").filter(F.col("max_dcg") > 0)
    a_hi = F.col("a_label") > F.col("b_label")
    s_hi = F.when(a_hi, F.col("a_score")).otherwise(F.col("b_score"))
    s_lo = F.when(a_hi, F.col("b_score")).otherwise(F.col("a_score"))
    dndcg = F.abs(F.col("a_gain") - F.col("b_gain")) * F.abs(F.col("a_disc") - F.col("b_disc")) / F.col("max_dcg")
    rho = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(sigmoid) * (s_hi - s_lo)))
    p = p.withColumn("_lam", F.lit(sigmoid) * rho * dndcg).withColumn(
        "_hes", F.lit(sigmoid * sigmoid) * rho * (F.lit(1.0) - rho) * dndcg)
    hi_id = F.when(a_hi, F.col("a_id")).otherwise(F.col("b_id"))
    lo_id = F.when(a_hi, F.col("b_id")).otherwise(F.col("a_id"))
    terms = p.select("query_id", F.explode(F.array(
        F.struct(hi_id.alias("row_id"), (-F.col("_lam")).alias("g"), F.col("_hes").alias("h")),
        F.struct(lo_id.alias("row_id"), F.col("_lam").alias("g"), F.col("_hes").alias("h")))).alias("t")) \
        .select("query_id", "t.*")
    per_row = terms.groupBy("query_id", "row_id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    if normalize:
        qs = per_row.groupBy("query_id").agg(F.sum(F.abs("g")).alias("_s"))
        f = F.when(F.col("_s") > 0, F.log2(F.lit(1.0) + F.col("_s")) / F.col("_s")).otherwise(F.lit(1.0))
        per_row = per_row.join(qs, "query_id").select("query_id", "row_id", (F.col("g") * f).alias("g"),
                                                     (F.col("h") * f).alias("h"))
    return per_row.select("row_id", "g", "h")


# --------------------------------------------------------------------------- trees


@dataclass
class Tree:
    """One regression tree: nodes ``(node_id, feature, threshold, left, right, leaf)``;
    ``leaf`` is the leaf index (left-to-right) or -1 for a split node."""
    nodes: list
    values: dict = field(default_factory=dict)  # leaf index -> output

    def expr(self, features, leaf_values: dict | None = None) -> Column:
        vals = self.values if leaf_values is None else leaf_values
        by_id = {n[0]: n for n in self.nodes}

        def build(nid):
            _, feat, thr, left, right, leaf = by_id[nid]
            if leaf >= 0:
                return F.lit(float(vals.get(leaf, 0.0))) if vals is not None else F.lit(leaf)
            return F.when(F.col(features[feat]) <= F.lit(float(thr)), build(left)).otherwise(build(right))
        return build(0)

    def leaf_expr(self, features) -> Column:
        by_id = {n[0]: n for n in self.nodes}

        def build(nid):
            _, feat, thr, left, right, leaf = by_id[nid]
            if leaf >= 0:
                return F.lit(leaf)
            return F.when(F.col(features[feat]) <= F.lit(float(thr)), build(left)).otherwise(build(right))
        return build(0)


@dataclass
class RankerModel:
    features: list
    trees: list = field(default_factory=list)
    learning_rate: float = 0.05
    best_round: int = 0
    history: list = field(default_factory=list)     # (round, split, k, ndcg)
    importance: dict = field(default_factory=dict)   # feature -> [gain, splits]

    def score_expr(self, n_rounds: int | None = None) -> Column:
        trees = self.trees[: (n_rounds or len(self.trees))]
        if not trees:
            raise RuntimeError("ranker is not trained")
        return reduce(lambda a, b: a + b, [F.lit(self.learning_rate) * t.expr(self.features) for t in trees])

    def predict(self, df: DataFrame, out: str = "score", chunk: int = 25) -> DataFrame:
        """Sum of tree outputs (features in stored order; missing ones added as 0.0).
        Trees are added in chunks so each projection stays compact."""
        from rankloom.operators.features import add_missing_features
        if not self.trees:
            raise RuntimeError("ranker is not trained")
        n = self.best_round or len(self.trees)
        d = add_missing_features(df, self.features).withColumn(out, F.lit(0.0))
        for s in range(0, n, chunk):
            part = reduce(lambda a, b: a + b,
                          [F.lit(self.learning_rate) * t.expr(self.features) for t in self.trees[s:min(n, s + chunk)]])
            d = d.withColumn(out, F.col(out) + part)
        return d

    def feature_importance(self, kind: str = "gain") -> list:
        """``(feature, importance)`` sorted descending."""
        i = 0 if kind == "gain" else 1
        return sorted(((f, v[i]) for f, v in self.importance.items()), key=lambda x: -x[1])

    def top_features(self, n: int = 10, kind: str = "gain") -> list:
        """T5."""
        return self.feature_importance(kind)[:n]

    def to_frames(self, spark):
        """Node table and metadata table (write them with ``.write.parquet``)."""
        rows = [(r, *n, float(t.values.get(n[5], 0.0)) if n[5] >= 0 else None)
                for r, t in enumerate(self.trees) for n in t.nodes]
        nodes = spark.createDataFrame(rows, "round int, node_id int, feature int, threshold double, left int, "
                                            "right int, leaf int, value double")
        meta = spark.createDataFrame([(self.features, self.learning_rate, self.best_round, len(self.trees))],
                                     "features array<string>, learning_rate double, best_round int, n_trees int")
        return nodes, meta

    @staticmethod
    def from_frames(nodes: DataFrame, meta: DataFrame) -> "RankerModel":
        m = meta.first()
        model = RankerModel(list(m["features"]), learning_rate=m["learning_rate"], best_round=m["best_round"])
        by_round = {}
        for r in nodes.orderBy("round", "node_id").collect():   # model-sized, not data-sized
            t = by_round.setdefault(r["round"], Tree([], {}))
            t.nodes.append((r["node_id"], r["feature"], r["threshold"], r["left"], r["right"], r["leaf"]))
            if r["leaf"] >= 0:
                t.values[r["leaf"]] = r["value"]
        model.trees = [by_round[k] for k in sorted(by_round)]
        return model

    def info(self) -> dict:
        """L10."""
        return {"n_features": len(self.features), "best_iteration": self.best_round, "n_trees": len(self.trees),
                "num_leaves": LGBM_PARAMS["num_leaves"], "learning_rate": self.learning_rate,
                "eval_at": list(LGBM_PARAMS["eval_at"]), "top_features": self.top_features(10)}


def query_ndcg(scored: DataFrame, k_values=(5, 10, 20), tie=("row_id",)) -> DataFrame:
    """L5/L11 helper: mean binary NDCG@k over queries with at least one positive."""
    from rankloom.operators.metrics import per_user_metrics
    ranked = rank_within_query(scored.select(*dict.fromkeys(["row_id", "query_id", "label", "score", *tie])), tie)
    # NDCG@k / recall@k only look at the first max(k) rows of a query
    recs = ranked.filter(F.col("pos") < max(k_values)).select(
        F.col("query_id").alias("user_id"), F.col("row_id").alias("item_id"), (F.col("pos") + 1).alias("rank"))
    truth = scored.filter(F.col("label") > 0).select(F.col("query_id").alias("user_id"), F.col("row_id").alias("item_id"))
    per = per_user_metrics(recs, truth, k_values).filter("has_truth")
    return per.agg(*[F.avg(f"ndcg_{k}").alias(f"ndcg_{k}") for k in k_values],
                   F.avg(f"recall_{max(k_values)}").alias(f"recall_{max(k_values)}"),
                   F.count(F.lit(1)).alias("n_queries"))


def _tree(nodes, chosen, values, bounds) -> Tree:
    """A grown tree as a node table in pre-order, leaves numbered left to right."""
    out, leaf_of, inner = [], {}, set(chosen)

    def walk(i):
        nid = len(out)
        out.append(None)
        if i in inner:
            n = nodes[i]
            left = walk(n.left)
            right = walk(n.right)
            out[nid] = (nid, n.feature, float(bounds[n.feature][n.bin]), left, right, -1)
        else:
            leaf_of[i] = len(leaf_of)
            out[nid] = (nid, -1, 0.0, -1, -1, leaf_of[i])
        return nid
    walk(0)
    return Tree(out, {leaf_of[i]: v for i, v in values.items()})


def fit_ranker(train: DataFrame, features, valid: DataFrame | None = None, n_rounds: int = LGBM_PARAMS["n_rounds"],
               learning_rate: float = LGBM_PARAMS["learning_rate"], num_leaves: int = LGBM_PARAMS["num_leaves"],
               min_child_samples: int = LGBM_PARAMS["min_child_samples"],
               colsample: float = LGBM_PARAMS["colsample_bytree"], l1: float = LGBM_PARAMS["reg_alpha"],
               l2: float = LGBM_PARAMS["reg_lambda"], early_stopping: int = LGBM_PARAMS["early_stopping_rounds"],
               seed: int = 42, eval_k: int = 10, eval_at=LGBM_PARAMS["eval_at"],
               truncation: int = TRUNCATION, block_rows: int | None = None) -> RankerModel:
    """L1 + L4 + L5 + L6 + L8: LambdaMART boosting on ``(query_id, label, features...)``
    frames, leaf-wise over binned features (``operators.boosting``).

    NDCG is recorded at every ``eval_at``; early stopping follows ``eval_k``."""
    from rankloom.operators import boosting
    features = list(features)
    if eval_k not in eval_at:
        raise ValueError("eval_k must be one of eval_at")
    model = RankerModel(features, learning_rate=learning_rate)
    growth = boosting.Growth(num_leaves, min_child_samples, l1, l2)
    best = -1.0
    rounds = boosting.boost(train, valid, features, n_rounds, growth, learning_rate, colsample, LGBM_PARAMS["label_gain"], truncation,
                            eval_at, eval_k, early_stopping, seed, block_rows or boosting.BLOCK_ROWS)
    for rnd, (nodes, chosen, values, bounds, history) in enumerate(rounds, 1):
        model.trees.append(_tree(nodes, chosen, values, bounds))
        for i in chosen:
            imp = model.importance.setdefault(features[nodes[i].feature], [0.0, 0])
            imp[0] += nodes[i].gain
            imp[1] += 1
        model.history += [(rnd, name, k, v) for name, k, v in history]
        metric = [v for name, k, v in history if k == eval_k][-1]
        if metric > best:
            best, model.best_round = metric, rnd
    return model


def holdout_eval(scored: DataFrame, tie=("row_id",)) -> DataFrame:
    """Per query rank by score; mean NDCG@10, NDCG@20, Recall@20 and query
    count over queries with a positive. ``scored(query_id, row_id, label, score)``."""
    return query_ndcg(scored, (10, 20), tie).select("ndcg_10", "ndcg_20", "recall_20", "n_queries")
