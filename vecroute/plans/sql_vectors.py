"""SQL for DuckDB that gives the rows of the queries in ``q_vectors``."""

from __future__ import annotations

K, TREES, BEAM, TOP, LEAVES = 4, 2, 4, 10, 16

V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
Q = "q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 20 = 0)"
TP = """ranked AS (
  SELECT t.tree_id, vec_id,
         row_number() OVER (PARTITION BY t.tree_id ORDER BY md5(t.tree_id::VARCHAR || '-' || vec_id::VARCHAR), vec_id) - 1 AS rank
  FROM v, (VALUES (0), (1)) t(tree_id)),
tp AS (SELECT tree_id, vec_id, [(rank % 16 // 4)::INT, (rank % 4)::INT] AS path, (rank % 16)::BIGINT AS leaf_id FROM ranked)"""
ROUTER = """mem AS (
  SELECT tree_id, []::INT[] AS prefix, path[1] AS branch, e FROM tp JOIN v USING (vec_id)
  UNION ALL SELECT tree_id, path[1:1], path[2], e FROM tp JOIN v USING (vec_id)),
cell AS (
  SELECT tree_id, prefix, branch, d, round(avg(x), 6) AS m
  FROM (SELECT tree_id, prefix, branch, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM mem) GROUP BY ALL),
cen AS (SELECT tree_id, prefix, branch, list(m ORDER BY d) AS c FROM cell GROUP BY ALL),
router AS (SELECT tree_id, prefix, branch, list_transform(c, lambda x: 2 * x) AS weight, -list_inner_product(c, c) AS bias FROM cen)"""
BASE = f"{V}, {Q}, {TP}, {ROUTER}"

#: Log-probabilities of all branches of tree 0's root.
LP = f"""{BASE},
lg AS (SELECT vec_id, branch, round(list_inner_product(e, weight) + bias, 6) AS logit
       FROM v, router WHERE tree_id = 0 AND len(prefix) = 0),
lz AS (SELECT *, logit - max(logit) OVER (PARTITION BY vec_id) AS z FROM lg),
lp AS (SELECT vec_id, branch, round(z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)), 6) AS log_prob FROM lz),
pr AS (SELECT vec_id, branch, round(exp(log_prob), 6) AS p FROM lp)"""


def metric_sql(name: str, a: str, b: str) -> str:
    length = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return {
        "euclidean": f"list_distance({a}, {b})",
        "angular": f"CASE WHEN {length} > 0 THEN 1 - list_inner_product({a}, {b}) / {length} ELSE 1.0 END",
        "inner_product": f"-list_inner_product({a}, {b})",
    }[name if name != "cosine" else "angular"]


def knn(metric: str, base: str = "v", asked: str = "q", k: int = TOP) -> str:
    return f"""SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT query_id, vec_id, distance, (row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) - 1)::INT AS rank
  FROM (SELECT query_id, b.vec_id, {metric_sql(metric, 'b.e', 'a.e')} AS distance FROM {asked} a, {base} b)) WHERE rank < {k}"""


NEXT = f"WITH {V}, n AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"

ORDERED = f"""{LP},
o AS (SELECT vec_id, []::INT[] AS prefix, list(branch ORDER BY p DESC, branch) AS ord, list(p ORDER BY branch) AS probs FROM pr GROUP BY vec_id)"""

SCORES = {"confidence": "list_max(probs)", "margin": "(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2])", "input": "0.0"}


def rounds(source: str, cap: str, order: str, name: str) -> str:
    """CTEs of the four rounds over ``source`` (vec_id, prefix, ord, probs); the last is ``name``."""
    out = [f"{name}_r0 AS (SELECT *, {SCORES[order]} AS s, NULL::INT AS branch, NULL::INT AS chosen_rank FROM {source})"]
    for t in range(K):
        tried = "".join(f", ord[{j + 1}]" for j in range(t - 1, -1, -1))
        out.append(f"""{name}_k{t} AS (SELECT *, coalesce(branch, ord[{t + 1}]) AS bkey FROM {name}_r{t}),
{name}_n{t} AS (SELECT *, row_number() OVER (PARTITION BY prefix, bkey ORDER BY (branch IS NULL), s DESC{tried}, vec_id) AS seat FROM {name}_k{t}),
{name}_r{t + 1} AS (SELECT * EXCLUDE (branch, chosen_rank, bkey, seat),
  CASE WHEN branch IS NULL AND seat <= {cap} THEN bkey ELSE branch END AS branch,
  CASE WHEN branch IS NULL AND seat <= {cap} THEN {t} ELSE chosen_rank END AS chosen_rank FROM {name}_n{t})""")
    out.append(f"""{name}_f AS (
  SELECT prefix, arg_min(b, n * 1000 + b) AS least FROM (
    SELECT g.prefix, b, (SELECT count(*) FROM {name}_r{K} x WHERE x.prefix = g.prefix AND x.branch = b) AS n
    FROM (SELECT DISTINCT prefix FROM {name}_r{K}) g, (SELECT unnest([0, 1, 2, 3]) AS b)) GROUP BY prefix),
{name} AS (
  SELECT vec_id, r.prefix, probs, ord, coalesce(branch, least) AS branch, coalesce(chosen_rank, {K}) AS chosen_rank,
         branch IS NULL AS used_fallback, CASE WHEN branch IS NOT NULL THEN probs[branch + 1] END AS prob
  FROM {name}_r{K} r JOIN {name}_f f ON r.prefix = f.prefix)""")
    return ",\n".join(out)


CAP1 = "(SELECT greatest(1, ceil(count(*) / 4.0)) FROM v)"
CAP1_TIGHT = "(SELECT greatest(1, ceil(0.8 * count(*) / 4)) FROM v)"
CAP2 = "(SELECT greatest(1, ceil(count(*) / 16.0)) FROM v)"


def root_assigned(order: str, cap: str = CAP1) -> str:
    return f"WITH {ORDERED}, {rounds('o', cap, order, 'a')}"


PLACED = "vec_id, branch, chosen_rank, used_fallback, prob"

SEARCH = f"""{BASE},
g0 AS (SELECT query_id, q.e, tree_id, branch, round(list_inner_product(q.e, weight) + bias, 6) AS logit
       FROM q, router WHERE len(prefix) = 0),
z0 AS (SELECT *, logit - max(logit) OVER (PARTITION BY query_id, tree_id) AS z FROM g0),
s0 AS (SELECT query_id, e, tree_id, [branch] AS path,
              round(0.0 + round(z - ln(sum(exp(z)) OVER (PARTITION BY query_id, tree_id)), 6), 6) AS score FROM z0),
b0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tree_id ORDER BY score DESC, path) - 1 AS pos FROM s0) WHERE pos < {BEAM}),
g1 AS (SELECT query_id, b.e, b.tree_id, b.path, b.score, r.branch, round(list_inner_product(b.e, weight) + bias, 6) AS logit
       FROM b0 b JOIN router r ON r.tree_id = b.tree_id AND r.prefix = b.path),
z1 AS (SELECT *, logit - max(logit) OVER (PARTITION BY query_id, tree_id, path) AS z FROM g1),
s1 AS (SELECT query_id, tree_id, list_concat(path, [branch]) AS path,
              round(score + round(z - ln(sum(exp(z)) OVER (PARTITION BY query_id, tree_id, path)), 6), 6) AS score FROM z1),
beam AS (SELECT query_id, tree_id, leaf_rank::INT AS leaf_rank, (path[1] * 4 + path[2])::BIGINT AS leaf_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, tree_id ORDER BY score DESC, path) - 1 AS leaf_rank FROM s1) WHERE leaf_rank < {BEAM}),
looked AS (SELECT query_id, beam.tree_id, vec_id, leaf_rank FROM beam JOIN tp ON tp.tree_id = beam.tree_id AND tp.leaf_id = beam.leaf_id)"""


def chosen(least: int, leaves: int = BEAM, name: str = "cand") -> str:
    return f"""{name}_c AS (SELECT query_id, vec_id, count(*)::INT AS n_trees FROM looked WHERE leaf_rank < {leaves} GROUP BY ALL),
{name} AS (SELECT query_id, vec_id, n_trees FROM (SELECT *, max(n_trees) OVER (PARTITION BY query_id) AS top FROM {name}_c)
           WHERE n_trees >= {least} OR top < {least})"""


def reranked(metric: str, source: str = "cand", name: str = "res") -> str:
    return f"""{name} AS (SELECT query_id, rank::INT AS rank, vec_id, distance FROM (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) - 1 AS rank FROM (
    SELECT query_id, vec_id, round({metric_sql(metric, 'v.e', 'q.e')}, 9) AS distance
    FROM {source} JOIN v USING (vec_id) JOIN q USING (query_id))) WHERE rank < {TOP})"""


TRUTH = f"truth AS ({knn('euclidean')})"


def recall(results: str = "res", name: str = "rec") -> str:
    return f"""{name} AS (SELECT t.query_id, count(r.vec_id) / {TOP}.0 AS recall FROM truth t
  LEFT JOIN (SELECT DISTINCT query_id, vec_id FROM {results}) r ON r.query_id = t.query_id AND r.vec_id = t.vec_id GROUP BY t.query_id)"""


def counted(source: str = "cand", name: str = "cnt") -> str:
    return f"{name} AS (SELECT q.query_id, count(c.vec_id) AS n_candidates FROM q LEFT JOIN {source} c ON c.query_id = q.query_id GROUP BY q.query_id)"


def sweep(least: int, tag: str) -> tuple[str, str]:
    """(CTEs, a query over them) of (num_leaves, recall, mean_candidates)."""
    parts, rows = [], []
    for m in (1, 2, 3, 4):
        n = f"{tag}{m}"
        parts += [chosen(least, m, f"c{n}"), reranked("euclidean", f"c{n}", f"r{n}"), recall(f"r{n}", f"e{n}"), counted(f"c{n}", f"n{n}")]
        rows.append(f"SELECT {m} AS num_leaves, (SELECT avg(recall) FROM e{n}) AS recall, (SELECT avg(n_candidates) FROM n{n}) AS mean_candidates")
    return ",\n".join(parts), " UNION ALL ".join(rows)


_UNION, _UNION_ROWS = sweep(1, "u")
_COMMON, _COMMON_ROWS = sweep(2, "k")
CURVES = f"""WITH {SEARCH}, {TRUTH}, {_UNION}, {_COMMON},
curve AS MATERIALIZED (
  SELECT 'union' AS label, num_leaves AS leaves, round(recall, 6) AS recall, round(mean_candidates, 6) AS candidates FROM ({_UNION_ROWS})
  UNION ALL SELECT 'common', num_leaves, round(recall, 6), round(mean_candidates, 6) FROM ({_COMMON_ROWS}))"""
FOUND = f"WITH {SEARCH}, {chosen(2)}, {reranked('euclidean')}"
SIZES = "sizes AS (SELECT t.tree_id, l.leaf_id, (SELECT count(*) FROM tp WHERE tp.tree_id = t.tree_id AND tp.leaf_id = l.leaf_id) AS size FROM (VALUES (0), (1)) t(tree_id), range({n}) l(leaf_id))"
GINI = """cum AS (SELECT tree_id, size, sum(size) OVER (PARTITION BY tree_id ORDER BY size, leaf_id ROWS UNBOUNDED PRECEDING) AS c FROM sizes),
gini AS (SELECT tree_id, CASE WHEN sum(size) > 0 THEN (count(*) + 1 - 2 * sum(c)::DOUBLE / sum(size)) / count(*) ELSE 0.0 END AS gini FROM cum GROUP BY tree_id)"""
EDGES = "edges AS (SELECT * FROM (VALUES (0, 'rank_0', 1), (1, 'rank_1', 2), (2, 'rank_2', 3), (3, 'rank_3', 4), (4, 'rank_4_7', 8), (8, 'rank_8_15', 16), (16, 'rank_16_31', 32), (32, 'rank_32_63', 64), (64, 'rank_64_127', 128), (128, 'rank_128_255', 256), (256, 'rank_256_plus', 2147483647)) t(edge, bucket, stop))"
HIST = f"""{root_assigned('confidence')}, {EDGES},
hist AS (SELECT edge, bucket, (SELECT count(*) FROM a WHERE NOT used_fallback AND chosen_rank >= edge AND chosen_rank < stop) AS n_vectors FROM edges)"""

#: All vectors in the nodes of their own path of tree 0, with the log-probability of every branch there.
PATHS = f"""WITH {BASE},
own AS (SELECT vec_id, []::INT[] AS prefix, path[1] AS own FROM tp WHERE tree_id = 0 UNION ALL SELECT vec_id, path[1:1], path[2] FROM tp WHERE tree_id = 0),
raw AS (SELECT vec_id, o.prefix, branch, round(list_inner_product(e, weight) + bias, 6) AS logit
        FROM own o JOIN v USING (vec_id) JOIN router r ON r.tree_id = 0 AND r.prefix = o.prefix),
low AS (SELECT *, logit - max(logit) OVER (PARTITION BY vec_id, prefix) AS z FROM raw),
every AS (SELECT vec_id, prefix, branch, round(z - ln(sum(exp(z)) OVER (PARTITION BY vec_id, prefix)), 6) AS log_prob FROM low)"""
#: One vector at a time: each takes its best branch with room, else the least full.
SEQUENTIAL = f"""WITH RECURSIVE {ORDERED},
seq AS (SELECT vec_id, ord, probs, row_number() OVER (ORDER BY list_max(probs) DESC, vec_id) AS i FROM o),
run AS (
  SELECT 0::BIGINT AS i, NULL::INT AS branch, NULL::INT AS chosen_rank, [0, 0, 0, 0]::BIGINT[] AS taken, (SELECT greatest(1, ceil(count(*) / 4.0)) FROM v) AS cap
  UNION ALL
  SELECT i, b, r, list_transform(taken, lambda n, j: n + (j = b + 1)::BIGINT), cap FROM (
    SELECT s.i, taken, cap, coalesce(f, list_position(taken, list_min(taken)) - 1)::INT AS b, coalesce(list_position(ord, f) - 1, {K})::INT AS r FROM (
      SELECT q.i, q.ord, run.taken, run.cap, list_filter(q.ord, lambda x: run.taken[x + 1] < run.cap)[1] AS f FROM run JOIN seq q ON q.i = run.i + 1) s))"""

SQL = {
    **{f"knn_{m}": f"WITH {V}, {Q} {knn(m)}" for m in ("euclidean", "angular", "cosine", "inner_product")},
    "knn_chunked_equiv": f"WITH {V}, {Q} {knn('euclidean')}",
    "knn_subset": f"WITH {V}, {Q}, s AS (SELECT * FROM v ORDER BY md5('7-' || vec_id::VARCHAR), vec_id LIMIT (SELECT count(*) // 5 FROM v)) {knn('euclidean', 's')}",
    "knn_label_pairs": f"WITH {V}, {Q} {knn('euclidean', 'v', 'q', 5)}",
    "training_pairs": f"WITH {V}, {Q}, {TP}, m AS ({knn('euclidean', 'v', 'q', 5)}) SELECT query_id, rank, leaf_id FROM m JOIN tp USING (vec_id) WHERE tree_id = 0",
    "dist_all": f"{NEXT} SELECT vec_id, " + ", ".join(f"round({metric_sql(m, 'a', 'b')}, 6) AS {m}" for m in ("euclidean", "angular", "cosine", "inner_product")) + " FROM n",
    "dist_hamming": f"{NEXT} SELECT vec_id, round(list_avg(list_transform(list_zip(a, b), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT)), 6) AS distance FROM n",
    "dist_jaccard": f"""{NEXT}, i AS (
  SELECT vec_id, list_filter(range(len(a)), lambda i: a[i + 1] > 0) AS a, list_filter(range(len(b)), lambda i: b[i + 1] > 0) AS b FROM n),
j AS (SELECT vec_id, len(list_intersect(a, b)) AS x, len(a) + len(b) AS y FROM i)
SELECT vec_id, round(CASE WHEN y - x > 0 THEN 1 - x / (y - x) ELSE 1.0 END, 6) AS distance FROM j""",
    "l2_normalize": f"""WITH {V}, n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v)
SELECT vec_id, (generate_subscripts(e, 1) - 1)::INT AS d, round(unnest(e) / CASE WHEN l > 0 THEN l ELSE 1 END, 6) AS x FROM n""",
    "leaf_id_to_path": "SELECT vec_id, [(vec_id % 16 // 4)::INT, (vec_id % 4)::INT] AS path FROM embeddings",
    "path_to_leaf_id": "SELECT vec_id, ((vec_id % 4) * 4 + label % 4)::BIGINT AS leaf_id FROM embeddings",
    "random_init": f"WITH {V}, {TP} SELECT tree_id, vec_id, path, leaf_id FROM tp",
    "leaf_buckets": f"WITH {V}, {TP} SELECT tree_id, leaf_id, list(vec_id ORDER BY vec_id) AS members FROM tp GROUP BY ALL",
    "leaf_size_stats": f"""WITH {V}, {TP}, {SIZES.format(n=64)}, {GINI}
SELECT s.tree_id, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS std, min(size) AS min, max(size) AS max,
       count_if(size = 0)::BIGINT AS num_empty, round(any_value(gini), 6) AS gini
FROM sizes s JOIN gini g ON g.tree_id = s.tree_id GROUP BY s.tree_id""",
    "leaf_gini": f"""WITH {V}, sizes AS (SELECT 0 AS tree_id, l.leaf_id, (SELECT count(*) FROM v WHERE label = l.leaf_id) AS size FROM range(16) l(leaf_id)), {GINI}
SELECT tree_id, round(gini, 6) AS gini FROM gini""",
    "merge_trees": f"WITH {V}, {TP} SELECT tree_id, vec_id, path, leaf_id FROM tp",
    "leaf_divergence": f"""WITH {V}, {TP} SELECT 0 AS tree_id, count_if(a.path <> b.path)::BIGINT AS moved, count(*) AS n_vectors, round(count_if(a.path <> b.path) / count(*), 6) AS share
FROM tp a JOIN tp b ON a.vec_id = b.vec_id AND a.tree_id = 0 AND b.tree_id = 1""",
    "router_logits": f"WITH {LP} SELECT vec_id, branch, logit FROM lg",
    "router_log_softmax": f"WITH {LP} SELECT vec_id, branch, log_prob FROM lp",
    "branch_order": f"WITH {ORDERED} SELECT vec_id, ord AS branches FROM o",
    "assign_margin_scores": f"WITH {ORDERED} SELECT vec_id, round({SCORES['margin']}, 6) AS margin FROM o",
    **{f"assign_round_{o}": f"{root_assigned(o)} SELECT {PLACED} FROM a" for o in SCORES},
    "assign_fallback": f"{root_assigned('confidence', CAP1_TIGHT)} SELECT {PLACED} FROM a",
    "assign_level2": f"""{root_assigned('confidence')},
d1 AS (SELECT a.vec_id, [a.branch] AS prefix, r.branch AS b, round(list_inner_product(v.e, weight) + bias, 6) AS logit
       FROM a JOIN v USING (vec_id) JOIN router r ON r.tree_id = 0 AND r.prefix = [a.branch]),
d2 AS (SELECT *, logit - max(logit) OVER (PARTITION BY vec_id) AS z FROM d1),
d3 AS (SELECT vec_id, prefix, b, round(exp(round(z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)), 6)), 6) AS p FROM d2),
o2 AS (SELECT vec_id, prefix, list(b ORDER BY p DESC, b) AS ord, list(p ORDER BY b) AS probs FROM d3 GROUP BY vec_id, prefix),
{rounds('o2', CAP2, 'confidence', 'a2')}
SELECT vec_id, (prefix[1] * 4 + branch)::BIGINT AS leaf_id, chosen_rank FROM a2""",
    "assign_diagnostics": f"""{root_assigned('confidence')}
SELECT count(*) AS num_vectors, count_if(used_fallback)::BIGINT AS fallback_count, count_if(branch <> ord[1])::BIGINT AS denied_top_count,
  max(chosen_rank) FILTER (NOT used_fallback) AS max_chosen_rank, round(avg(chosen_rank), 6) AS mean_chosen_rank, round(avg(prob), 6) AS mean_assigned_prob,
  round(avg(list_max(probs)), 6) AS mean_confidence, round(avg({SCORES['margin']}), 6) AS mean_margin,
  round(count_if(NOT used_fallback AND chosen_rank = 1) / count(*), 6) AS second_choice_fraction, round(count_if(NOT used_fallback AND chosen_rank >= 2) / count(*), 6) AS third_or_later_choice_fraction,
  round(count_if(branch <> ord[1]) / count(*), 6) AS denied_top_fraction, round(count_if(used_fallback) / count(*), 6) AS fallback_fraction FROM a""",
    "rank_histogram": f"{HIST} SELECT edge, bucket, n_vectors FROM hist",
    "min_top_r_covering": f"""{HIST}, run AS (SELECT edge, sum(n_vectors) OVER (ORDER BY edge) AS upto, coalesce(lead(edge) OVER (ORDER BY edge), edge) AS next_edge, sum(n_vectors) OVER () AS total FROM hist)
SELECT coalesce(arg_min(next_edge, edge), 0) AS min_top_r FROM run WHERE total > 0 AND upto >= 0.999 * total""",
    "eval_loss": f"""{PATHS} SELECT round(-2 * avg(log_prob), 6) AS loss FROM own JOIN every USING (vec_id, prefix) WHERE branch = own""",
    "assign_sequential": f"""{SEQUENTIAL} SELECT vec_id, branch, chosen_rank, chosen_rank = {K} AS used_fallback, CASE WHEN chosen_rank < {K} THEN probs[branch + 1] END AS prob
FROM run JOIN seq USING (i)""",
    "beam_search": f"WITH {SEARCH} SELECT query_id, tree_id, leaf_rank, leaf_id, score FROM beam",
    "leaf_lookup": f"WITH {SEARCH} SELECT query_id, tree_id, vec_id FROM looked",
    "candidates_union": f"WITH {SEARCH}, {chosen(1)} SELECT * FROM cand",
    "candidates_min_trees": f"WITH {SEARCH}, {chosen(2)} SELECT * FROM cand",
    "candidates_fallback": f"WITH {SEARCH}, {chosen(2, 1)} SELECT * FROM cand",
    "candidate_counts": f"WITH {SEARCH}, {chosen(2)}, {counted()} SELECT * FROM cnt",
    "rerank_topk": f"WITH {SEARCH}, {chosen(1)}, {reranked('euclidean')} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM res",
    "rerank_angular": f"WITH {SEARCH}, {chosen(1)}, {reranked('angular')} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM res",
    "rerank_inner_product": f"WITH {SEARCH}, {chosen(1)}, {reranked('inner_product')} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM res",
    "leaf_store": f"{FOUND} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM res",
    "search_end_to_end": f"{FOUND} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM res",
    "search_wide": f"""{FOUND} SELECT q.query_id, list_concat(coalesce(list(vec_id ORDER BY rank) FILTER (vec_id IS NOT NULL), []), list_transform(range({TOP}), lambda x: -1::BIGINT))[1:{TOP}] AS ids
FROM q LEFT JOIN res ON res.query_id = q.query_id GROUP BY q.query_id""",
    "recall_at_10": f"{FOUND}, {TRUTH}, {recall()} SELECT query_id, round(recall, 6) AS recall FROM rec",
    "recall_stats": f"""{FOUND}, {TRUTH}, {recall()} SELECT round(avg(recall), 6) AS mean, """
    + ", ".join(f"round(quantile_cont(recall, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))
    + ", round(min(recall), 6) AS min, round(max(recall), 6) AS max, count_if(recall = 0)::BIGINT AS zero_count, count_if(recall < 0.5)::BIGINT AS below_half_count FROM rec",
    "sweep_num_leaves": f"WITH {SEARCH}, {TRUTH}, {_COMMON} SELECT num_leaves, round(recall, 6) AS recall, round(mean_candidates, 6) AS mean_candidates FROM ({_COMMON_ROWS})",
    "routing_evals": "SELECT 40::BIGINT AS exact, 64::BIGINT AS bound, round(count(*) * 4 / 16, 6) AS tree_candidates, round(count(*) * 8 / 16, 6) AS all_candidates FROM embeddings",
    "candidate_set_estimate": "SELECT round(2 * 4 * count(*) / 16, 6) AS candidates FROM embeddings",
    "curve_interpolation": f"""{CURVES},
seg AS (SELECT label, recall AS lo, lead(recall) OVER w AS hi, candidates AS cl, lead(candidates) OVER w AS ch FROM curve WINDOW w AS (PARTITION BY label ORDER BY recall, candidates)),
goal AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.9])::DOUBLE AS target),
hit AS (SELECT label, target, arg_min(cl + CASE WHEN hi > lo THEN (target - lo) / (hi - lo) ELSE 0 END * (ch - cl), lo) AS candidates
        FROM seg, goal WHERE target BETWEEN lo AND hi GROUP BY label, target)
SELECT l.label, g.target, round(candidates, 6) AS candidates FROM (SELECT DISTINCT label FROM curve) l CROSS JOIN goal g LEFT JOIN hit ON hit.label = l.label AND hit.target = g.target""",
    "balance_warnings": f"""{CURVES} SELECT a.leaves, round(a.candidates, 6) AS base, round(b.candidates, 6) AS other, round((b.candidates - a.candidates) / a.candidates, 6) AS drift
FROM curve a JOIN curve b ON a.leaves = b.leaves AND a.label = 'union' AND b.label = 'common' WHERE abs((b.candidates - a.candidates) / a.candidates) > 0.05""",
    "qps_by_machine": """SELECT replace(p_brand, ' ', '-') AS host, 'NVIDIA A' || (p_size % 3) AS gpu, count(*) AS n_points, round(max(p_retailprice), 6) AS best_qps,
  round(median(p_retailprice), 6) AS median_qps, round(max(CASE WHEN p_size > 0 THEN p_retailprice * p_size END), 6) AS best_candidates_per_second
FROM part GROUP BY ALL""",
    "repetition_summary": f"""{NEXT} SELECT label, count(*) AS repetitions, round(median(list_distance(a, b)), 6) AS median,
  round(min(list_distance(a, b)), 6) AS min, round(max(list_distance(a, b)), 6) AS max FROM n JOIN v USING (vec_id) GROUP BY label""",
    "weighted_loss": f"WITH {LP} SELECT round(-avg(log_prob), 6) AS loss FROM lp JOIN tp ON tp.vec_id = lp.vec_id AND tp.tree_id = 0 AND tp.path[1] = lp.branch",
    "linspace_sample": """SELECT vec_id AS i, label FROM embeddings WHERE vec_id IN (
  SELECT floor(x * ((SELECT count(*) FROM embeddings) - 1)::DOUBLE / 100)::BIGINT FROM range(101) t(x))""",
    "source_roundtrip": f"WITH {V} SELECT vec_id, len(e)::INT AS width, round(list_sum(e), 6) AS total FROM v",
}
