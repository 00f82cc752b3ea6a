"""DuckDB text fragments shared by several oracles."""

from __future__ import annotations

from rankloom.functions.genres import DRIVER_GENRES

N = len(DRIVER_GENRES)


def multi_hot(expr: str, vocab=DRIVER_GENRES) -> str:
    return "[" + ", ".join(
        f"CAST(coalesce(list_contains(string_split({expr}, '|'), '{g}'), false) AS DOUBLE)"
        for g in vocab) + "]"


def dot(a: str, b: str, n: int = N) -> str:
    return "(" + " + ".join(f"{a}[{i + 1}] * {b}[{i + 1}]" for i in range(n)) + ")"


def lst(exprs) -> str:
    return "[" + ", ".join(exprs) + "]"


def expand(arr: str, prefix: str, n: int = N, digits: int | None = 6) -> str:
    if digits is None:
        return ", ".join(f"{arr}[{i + 1}] AS {prefix}{i}" for i in range(n))
    return ", ".join(f"round({arr}[{i + 1}], {digits}) AS {prefix}{i}" for i in range(n))


def user_features_ctes() -> str:
    """CTE chain ending in ``uf(user_id, avg_rating, rating_count, recency_score,
    log_rating_count, gender_encoded, age_normalized, occupation_normalized, genre_pref)``."""
    g = [f"g{i}" for i in range(N)]
    nrm = "sqrt(" + " + ".join(f"g{i} * g{i}" for i in range(N)) + ")"
    pref = lst([f"CASE WHEN {nrm} > 0 THEN g{i} / {nrm} ELSE g{i} END" for i in range(N)])
    return f""",
gv AS (SELECT item_id, {multi_hot('genres')} AS genre_vector FROM movies),
st AS (SELECT user_id, avg(rating) AS avg_rating, count(*) AS rating_count,
              epoch_us(max(ts)) AS last_us FROM ratings GROUP BY user_id),
rc AS (SELECT st.*, CASE WHEN (SELECT max(last_us) - min(last_us) FROM st) > 0
              THEN (last_us - (SELECT min(last_us) FROM st)) / CAST((SELECT max(last_us) - min(last_us) FROM st) AS DOUBLE)
              ELSE 1.0 END AS recency_score, ln(1 + rating_count) AS log_rating_count FROM st),
demo AS (SELECT user_id, CASE WHEN gender = 'F' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS gender_encoded,
                age / (SELECT max(age) FROM users) AS age_normalized,
                occupation / (SELECT max(occupation) FROM users) AS occupation_normalized FROM users),
liked AS (SELECT r.user_id, r.rating - 3.0 AS w, gv.genre_vector AS v
          FROM ratings r JOIN gv ON r.item_id = gv.item_id WHERE r.rating >= 4),
pagg AS (SELECT user_id, {", ".join(f"avg(v[{i + 1}] * w) AS g{i}" for i in range(N))} FROM liked GROUP BY user_id),
pref AS (SELECT user_id, {pref} AS genre_pref FROM pagg),
uf AS (SELECT rc.user_id, rc.avg_rating, rc.rating_count, rc.recency_score, rc.log_rating_count,
              d.gender_encoded, d.age_normalized, d.occupation_normalized,
              coalesce(p.genre_pref, {lst(['0.0'] * N)}) AS genre_pref
       FROM rc LEFT JOIN demo d ON rc.user_id = d.user_id LEFT JOIN pref p ON rc.user_id = p.user_id)
""".replace("{g}", ",".join(g))


def item_features_ctes() -> str:
    """CTE chain ending in ``itf(item_id, avg_rating, rating_count, rating_stddev,
    log_rating_count, popularity_score, title, genre_vector, year_normalized)``."""
    return f""",
ist AS (SELECT item_id, avg(rating) AS avg_rating, count(*) AS rating_count,
               coalesce(stddev_samp(rating), 0.0) AS rating_stddev,
               ln(1 + count(*)) AS log_rating_count FROM ratings GROUP BY item_id),
yr AS (SELECT item_id, title, genres,
              CAST(nullif(regexp_extract(title, '\\((\\d{{4}})\\)$', 1), '') AS DOUBLE) AS year FROM movies),
cat AS (SELECT item_id, title, {multi_hot('genres')} AS genre_vector,
               coalesce((year - (SELECT min(year) FROM yr)) / ((SELECT max(year) FROM yr) - (SELECT min(year) FROM yr) + 1e-8), 0.5)
               AS year_normalized FROM yr),
itf AS (SELECT s.item_id, s.avg_rating, s.rating_count, s.rating_stddev, s.log_rating_count,
               s.log_rating_count / (SELECT max(log_rating_count) FROM ist) AS popularity_score,
               c.title, coalesce(c.genre_vector, {lst(['0.0'] * N)}) AS genre_vector, c.year_normalized
        FROM ist s LEFT JOIN cat c ON s.item_id = c.item_id)
"""


def phash(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


ORDER_KEY = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"
ORDER_KEY_DESC = ", ".join(c.strip() + " DESC" for c in ORDER_KEY.split(","))


def stride(n_expr: str) -> str:
    primes = (7919, 7907, 7901, 7883, 7879, 7877, 7873, 7867)
    return "CASE " + " ".join(f"WHEN gcd({p}, {n_expr}) = 1 THEN {p}" for p in primes) + " END"


def negatives_ctes(need_cte: str, seed: int = 42, suffix: str = "",
                   universe: str = "SELECT DISTINCT item_id FROM ratings") -> str:
    """Portable negatives in SQL: needs ``ratings`` and a CTE ``need_cte(user_id, need)``;
    defines ``neg{suffix}(user_id, item_id, draw)``. ``universe`` selects the distinct items to draw from."""
    s = suffix or "_n"
    return f""",
items{s} AS ({universe}),
ncat{s} AS (SELECT count(*) AS n_items FROM items{s}),
cat{s} AS (SELECT item_id, row_number() OVER (ORDER BY h, item_id) - 1 AS pos
           FROM (SELECT item_id, {phash(f"CAST(item_id AS VARCHAR) || '-{seed}'")} AS h FROM items{s})),
rated{s} AS (SELECT DISTINCT user_id, item_id FROM ratings),
rated_n{s} AS (SELECT user_id, count(*) AS n_rated FROM rated{s} GROUP BY user_id),
plan{s} AS (SELECT n.user_id, n.need, least((SELECT n_items FROM ncat{s}), n.need + r.n_rated) AS m,
                 {phash(f"'s' || CAST(n.user_id AS VARCHAR) || '-{seed}'")} % (SELECT n_items FROM ncat{s}) AS start
          FROM {need_cte} n JOIN rated_n{s} r ON n.user_id = r.user_id),
draws{s} AS (SELECT user_id, need, start, unnest(range(0, CAST(m AS BIGINT))) AS draw FROM plan{s}),
cand{s} AS (SELECT d.user_id, c.item_id, d.draw, d.need
            FROM draws{s} d JOIN cat{s} c
              ON c.pos = (d.start + d.draw * ({stride(f"(SELECT n_items FROM ncat{s})")})) % (SELECT n_items FROM ncat{s})
            ANTI JOIN rated{s} rr ON rr.user_id = d.user_id AND rr.item_id = c.item_id),
neg{suffix} AS (SELECT user_id, item_id, draw FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY draw) AS rn FROM cand{s}) WHERE rn <= need)
"""


def training_pairs_ctes(n_neg: int = 4, seed: int = 42, ratio: float = 0.1) -> str:
    """Defines ``pairs(user_id, item_id, label, rating, query_id, split)``."""
    return f""",
pstats AS (SELECT user_id, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS n_pos,
                  count(DISTINCT item_id) AS n_rated FROM ratings GROUP BY user_id),
eligible AS (SELECT * FROM pstats WHERE n_pos > 0
             AND (SELECT count(DISTINCT item_id) FROM ratings) - n_rated >= {n_neg}),
pneed AS (SELECT user_id, least(n_pos * {n_neg}, (SELECT count(DISTINCT item_id) FROM ratings) - n_rated) AS need
          FROM eligible)""" + negatives_ctes("pneed", seed) + f""",
firstr AS (SELECT user_id, item_id, arg_min(rating, ({ORDER_KEY})) AS first_rating
           FROM ratings GROUP BY user_id, item_id),
pos AS (SELECT r.user_id, r.item_id, 1 AS label, f.first_rating AS rating
        FROM ratings r JOIN firstr f ON r.user_id = f.user_id AND r.item_id = f.item_id
        WHERE r.rating >= 4 AND r.user_id IN (SELECT user_id FROM eligible)),
allpairs AS (SELECT * FROM pos UNION ALL SELECT user_id, item_id, 0 AS label, 0.0 AS rating FROM neg),
qid AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS query_id FROM eligible),
qrank AS (SELECT query_id, row_number() OVER (ORDER BY {phash(f"'q' || CAST(query_id AS VARCHAR) || '-{seed}'")}, query_id) - 1 AS qpos
          FROM qid),
pairs AS (SELECT a.user_id, a.item_id, a.label, a.rating, q.query_id,
                 CASE WHEN qr.qpos < greatest(1, floor((SELECT count(*) FROM qid) * {ratio})) THEN 'test' ELSE 'train' END AS split
          FROM allpairs a JOIN qid q ON a.user_id = q.user_id JOIN qrank qr ON q.query_id = qr.query_id)
"""


def clamp_norm_list(v: str, n: int) -> str:
    nrm = f"greatest(sqrt({dot(v, v, n)}), 1e-8)"
    return lst([f"{v}[{i + 1}] / {nrm}" for i in range(n)])


def ivf_ctes(dim: int, n_probe: int, k: int, items_cte: str, cent_sql: str, queries_cte: str) -> str:
    """IVF search in SQL. ``items_cte(item_id, vec)`` raw vectors; ``cent_sql`` defines
    ``cent(list_id, c)``; ``queries_cte(query_id, vec)`` raw queries. Defines
    ``nv(item_id, u)``, ``asg(item_id, list_id)``, ``pr(query_id, list_id)`` and
    ``hits(query_id, item_id, score, rank)``."""
    return f""",
nv AS (SELECT item_id, {clamp_norm_list('vec', dim)} AS u FROM {items_cte}),
{cent_sql},
asg AS (SELECT item_id, list_id FROM (
          SELECT n.item_id, c.list_id, row_number() OVER (PARTITION BY n.item_id ORDER BY {dot('n.u', 'c.c', dim)} DESC, c.list_id) AS rn
          FROM nv n CROSS JOIN cent c) WHERE rn = 1),
qn AS (SELECT query_id, {clamp_norm_list('vec', dim)} AS qv FROM {queries_cte}),
pr AS (SELECT query_id, list_id FROM (
          SELECT q.query_id, c.list_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {dot('q.qv', 'c.c', dim)} DESC, c.list_id) AS rn
          FROM qn q CROSS JOIN cent c) WHERE rn <= {n_probe}),
cand AS (SELECT pr.query_id, a.item_id, {dot('q.qv', 'n.u', dim)} AS score
         FROM pr JOIN asg a ON pr.list_id = a.list_id JOIN nv n ON n.item_id = a.item_id
         JOIN qn q ON q.query_id = pr.query_id),
hits AS (SELECT * FROM (SELECT query_id, item_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM cand) WHERE rank <= {k})
"""


def label_centroids_sql(dim: int, src: str = "emb") -> str:
    return f"""lnv AS (SELECT label, {clamp_norm_list('vec', dim)} AS u FROM {src}),
cent AS (SELECT CAST(label AS BIGINT) AS list_id, {lst([f'avg(u[{i + 1}])' for i in range(dim)])} AS c
         FROM lnv GROUP BY label)"""


def basis_cent_sql(dim: int = N) -> str:
    rows = ", ".join("(" + str(j) + ", " + lst(["1.0" if i == j else "0.0" for i in range(dim)]) + ")"
                     for j in range(dim))
    return f"cent(list_id, c) AS (SELECT CAST(col0 AS BIGINT), CAST(col1 AS DOUBLE[]) FROM (VALUES {rows}))"


def serving_ctes(n_cand: int, n_probe: int, k: int, weights: dict, user_defaults: dict, item_defaults: dict,
                 query_users: str = "uf", cold_users: str = "users", score_sql: str | None = None) -> str:
    """(``score_sql`` replaces the linear score over ``sfeat``.) After ``ratings, users, movies`` + user/item feature CTEs. Defines
    ``hits``, ``sfeat`` (serving matrix), ``scored``, ``warm`` (top-k) and ``recs``
    (warm + cold popularity lists, enriched)."""
    zeros = lst(["0.0"] * N)
    ucols = ",\n".join(f"coalesce(CAST(u.{c} AS DOUBLE), CAST({v!r} AS DOUBLE)) AS {c}" for c, v in user_defaults.items())
    imap = {"item_avg_rating": "avg_rating", "item_log_rating_count": "log_rating_count",
            "popularity_score": "popularity_score", "rating_stddev": "rating_stddev",
            "year_normalized": "year_normalized"}
    icols = ",\n".join(f"coalesce(CAST(i.{imap[c]} AS DOUBLE), CAST({v!r} AS DOUBLE)) AS {c}"
                       for c, v in item_defaults.items())
    score = "CAST(0.0 AS DOUBLE)" + "".join(f" + CAST({w!r} AS DOUBLE) * {c}" for c, w in weights.items())
    score = score_sql or score
    return f""",
ivec AS (SELECT item_id, {multi_hot('genres')} AS vec FROM movies),
uvec AS (SELECT user_id AS query_id, genre_pref AS vec FROM {query_users})""" + ivf_ctes(
        N, n_probe, n_cand, "ivec", basis_cent_sql(), "uvec") + f""",
sf0 AS (SELECT h.query_id AS user_id, h.item_id, h.score AS retrieval_score,
{ucols},
{icols},
          coalesce(u.genre_pref, {zeros}) AS up, coalesce(i.genre_vector, {zeros}) AS iv
        FROM hits h LEFT JOIN uf u ON h.query_id = u.user_id LEFT JOIN itf i ON h.item_id = i.item_id),
sfeat AS (SELECT *, avg_rating - item_avg_rating AS rating_diff,
                 log_rating_count / (item_log_rating_count + 1e-8) AS user_item_popularity_ratio,
                 {dot('up', 'iv')} AS genre_affinity FROM sf0),
scored AS (SELECT *, {score} AS score FROM sfeat),
warm AS (SELECT * FROM (SELECT user_id, item_id, score, retrieval_score,
           row_number() OVER (PARTITION BY user_id ORDER BY score DESC, retrieval_score DESC, item_id) AS rank
         FROM scored) WHERE rank <= {k}),
popk AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM
           (SELECT item_id, count(*) AS n FROM ratings GROUP BY item_id) ORDER BY n DESC, item_id LIMIT {k}),
cold AS (SELECT us.user_id, p.item_id, p.rank, 1.0 - p.rank / {float(k + 1)!r} AS score, 0.0 AS retrieval_score
         FROM {cold_users} us CROSS JOIN popk p WHERE us.user_id NOT IN (SELECT user_id FROM uf)),
recs AS (SELECT r.user_id, CAST(r.rank AS INTEGER) AS rank, r.item_id,
                coalesce(m.title, 'Item ' || CAST(r.item_id AS VARCHAR)) AS title, r.score, r.retrieval_score,
                coalesce(m.genres, '') AS genres, r.source
         FROM (SELECT user_id, rank, item_id, score, retrieval_score, 'model' AS source FROM warm
               UNION ALL SELECT user_id, rank, item_id, score, retrieval_score, 'popularity' AS source FROM cold) r
         LEFT JOIN movies m ON r.item_id = m.item_id)
"""


def per_user_metrics_ctes(recs: str, truth: str, ks=(5, 10, 20)) -> str:
    """Defines ``pum(user_id, has_truth, ndcg_k, recall_k, precision_k, mrr, ap)``."""
    import math
    idcg = [0.0]
    for i in range(1, max(ks) + 1):
        idcg.append(idcg[-1] + 1.0 / math.log2(i + 1))
    idcg_list = lst([repr(x) for x in idcg])
    parts = []
    for k in ks:
        parts.append(f"sum(CASE WHEN rank <= {k} AND hit = 1 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg{k}")
        parts.append(f"sum(CASE WHEN rank <= {k} AND hit = 1 THEN 1 ELSE 0 END) AS hits{k}")
    outs = []
    for k in ks:
        ideal = f"({idcg_list})[least(coalesce(t.n_rel, 0), {k}) + 1]"
        outs.append(f"CASE WHEN {ideal} > 0 THEN a.dcg{k} / {ideal} ELSE 0.0 END AS ndcg_{k}")
        outs.append(f"CASE WHEN coalesce(t.n_dis, 0) > 0 THEN a.hits{k} / t.n_dis ELSE 0.0 END AS recall_{k}")
        outs.append(f"a.hits{k} / {float(k)!r} AS precision_{k}")
    return f""",
tset AS (SELECT DISTINCT user_id, item_id FROM {truth}),
tst AS (SELECT user_id, count(*) AS n_rel, count(DISTINCT item_id) AS n_dis FROM {truth} GROUP BY user_id),
rh AS (SELECT r.user_id, r.item_id, r.rank, CASE WHEN s.item_id IS NULL THEN 0 ELSE 1 END AS hit
       FROM {recs} r LEFT JOIN tset s ON r.user_id = s.user_id AND r.item_id = s.item_id),
rh2 AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank, item_id ROWS UNBOUNDED PRECEDING) AS hno FROM rh),
agg AS (SELECT user_id, min(CASE WHEN hit = 1 THEN rank END) AS first_hit,
               sum(CASE WHEN hit = 1 THEN hno / rank ELSE 0.0 END) AS ap_sum, {", ".join(parts)}
        FROM rh2 GROUP BY user_id),
pum AS (SELECT a.user_id, coalesce(t.n_rel, 0) > 0 AS has_truth, {", ".join(outs)},
               coalesce(1.0 / a.first_hit, 0.0) AS mrr,
               CASE WHEN coalesce(t.n_dis, 0) > 0 THEN a.ap_sum / t.n_dis ELSE 0.0 END AS ap
        FROM agg a LEFT JOIN tst t ON a.user_id = t.user_id)
"""


def report_sql(ks=(5, 10, 20), catalog_expr: str | None = None, recs: str = "recs_e") -> str:
    """Final SELECT of the E9 report over ``pum`` (+ coverage over ``recs``)."""
    sel = []
    for k in ks:
        for m in ("ndcg", "recall", "precision"):
            sel.append(f"SELECT '{m}@{k}' AS metric, {k} AS k, round(coalesce(avg({m}_{k}), 0.0), 6) AS value FROM pum WHERE has_truth")
    sel.append("SELECT 'mrr', NULL, round(coalesce(avg(mrr), 0.0), 6) FROM pum WHERE has_truth")
    sel.append("SELECT 'map', NULL, round(coalesce(avg(ap), 0.0), 6) FROM pum WHERE has_truth")
    sel.append("SELECT 'n_users', NULL, CAST(count(*) AS DOUBLE) FROM pum")
    sel.append("SELECT 'n_evaluated', NULL, CAST(coalesce(sum(CASE WHEN has_truth THEN 1 ELSE 0 END), 0) AS DOUBLE) FROM pum")
    if catalog_expr:
        sel.append(f"""SELECT 'coverage', NULL, round(CASE WHEN ({catalog_expr}) > 0 THEN
            (SELECT count(DISTINCT item_id) FROM {recs} WHERE user_id IN (SELECT user_id FROM pum WHERE has_truth))
            / CAST(({catalog_expr}) AS DOUBLE) ELSE 0.0 END, 6)""")
    return "\nUNION ALL ".join(sel)


def epoch_triples_ctes(seed: int) -> str:
    """Defines ``tri(user_id, pos_item, neg_item)``; needs ``ratings`` and ``movies``."""
    return f""",
lk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_KEY}) AS i FROM ratings WHERE rating >= 4),
eneed AS (SELECT user_id, count(*) AS need FROM lk GROUP BY user_id)""" + negatives_ctes(
        "eneed", seed=seed, universe="SELECT item_id FROM ratings UNION SELECT item_id FROM movies") + """,
negi AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY draw) AS i,
                count(*) OVER (PARTITION BY user_id) AS pool FROM neg),
tri AS (SELECT l.user_id, l.item_id AS pos_item, n.item_id AS neg_item
        FROM lk l JOIN negi n ON l.user_id = n.user_id AND (l.i - 1) % n.pool + 1 = n.i)"""
