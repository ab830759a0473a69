"""Named query plans: relational graph algebra and closed-form statistics, one text for both engines.

``@name`` stands for a relation of :mod:`pathloom.sources.graphs`. Every plan is declarative, so Catalyst prunes columns
(only the used ones of a table are read), aggregates before shuffles and picks join strategies.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import adjust, not_close_fit, probit, student, two_sided
from ..operators import graphs
from ..operators.adjust import adjusted
from ..operators.rows import pairs, quantiles
from ..sources.graphs import relations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations")

#: Nodes that a test of two others can be given, at most, in the plans; the graph of the columns has six. (The operator
#: ``models.separation_tests`` knows no such bound.)
SWEEPS = 8

# -- relations that several plans share
# in Spark the pairs of columns come from the rows' cross products, one small matrix a task; SQL sums them pair by pair
PAIR = "SELECT x, y, r, cov, n FROM (@pair) pr"
EDGE_DATA = "SELECT src, dst, obs, grp, xv, yv FROM (@edge_data) m"
Z_ALL = "SELECT src, dst, corr(xv, yv) AS r, count(*) AS n FROM d GROUP BY src, dst"
TTEST = """SELECT var, avg(CASE WHEN grp = 1 THEN value END) - avg(CASE WHEN grp = 0 THEN value END) AS diff,
 sqrt(((count(CASE WHEN grp = 1 THEN value END) - 1) * var_samp(CASE WHEN grp = 1 THEN value END) + (count(CASE WHEN grp = 0 THEN value END) - 1) * var_samp(CASE WHEN grp = 0 THEN value END)) / (count(*) - 2)
 * (1.0 / count(CASE WHEN grp = 1 THEN value END) + 1.0 / count(CASE WHEN grp = 0 THEN value END))) AS se, count(*) - 2.0 AS df FROM (@long) l GROUP BY var"""
PVALUE = student("diff / se", "df")
UNDIRECTED = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (@mixed) e WHERE src <> dst"
VERTS = "SELECT src AS name FROM (@mixed) e UNION SELECT dst AS name FROM (@mixed) f"
WEIGHTS = f"SELECT x, y, round(1.0 - abs(r), 9) AS w FROM ({PAIR}) p"


def _plans() -> dict[str, str]:
    p: dict[str, str] = {}
    # moments, scaling, ranks
    p["corr_long"] = f"SELECT x, y, n, round(r, 8) AS r FROM ({PAIR}) p"
    p["cov_matrix_long"] = f"WITH c AS ({PAIR}) SELECT x AS i, y AS j, round(cov, 8) AS v FROM c UNION ALL SELECT y, x, round(cov, 8) FROM c UNION ALL SELECT var, var, round(var_samp(value), 8) FROM (@long) l GROUP BY var"
    p["scale_columns"] = "SELECT obs, var, round((value - avg(value) OVER (PARTITION BY var)) / stddev_samp(value) OVER (PARTITION BY var), 6) AS z FROM (@long) l"
    p["variance_filter"] = "SELECT var, round(stddev_samp(value), 8) AS sd FROM (@long) l GROUP BY var HAVING stddev_samp(value) > 0.1"
    p["quantiles_type7"] = "SELECT var, round(PERCENTILE(value, 0.25), 8) AS q25, round(PERCENTILE(value, 0.5), 8) AS q50, round(PERCENTILE(value, 0.99), 8) AS q99 FROM (@long) l GROUP BY var"
    p["l2t_log2"] = "WITH q AS (SELECT PERCENTILE(l_extendedprice, 0.0) AS q0, PERCENTILE(l_extendedprice, 0.25) AS q25, PERCENTILE(l_extendedprice, 0.99) AS q99, PERCENTILE(l_extendedprice, 1.0) AS q100 FROM (@lines) l) SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN q99 > 100 OR (q100 - q0 > 50 AND q25 > 0) THEN CASE WHEN l_extendedprice > 0 THEN log2(l_extendedprice) END ELSE l_extendedprice END), 6) AS mean_l2 FROM (@lines) l CROSS JOIN q GROUP BY l_returnflag"
    ranks = "SELECT obs, var, value, rank() OVER (PARTITION BY var ORDER BY value) + (count(*) OVER (PARTITION BY var, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY var) AS n FROM (@long) l"
    p["npn_rank_u"] = f"SELECT obs, var, round(rk / (n + 1), 8) AS u FROM ({ranks}) k"
    p["npn_z"] = f"SELECT obs, var, round({probit('u')}, 6) AS z FROM (SELECT obs, var, rk / (n + 1.0) AS u FROM ({ranks}) k) s"
    p["spearman_sin"] = f"SELECT a.var AS x, b.var AS y, round(2.0 * sin(pi() / 6.0 * corr(a.rk, b.rk)), 8) AS rho FROM ({ranks}) a JOIN ({ranks}) b ON a.obs = b.obs AND a.var < b.var GROUP BY a.var, b.var"
    p["scree_diff"] = "SELECT var, cast(k AS bigint) AS k, round(v - lag(v) OVER (ORDER BY k), 8) AS d1, round(v - 2 * lag(v) OVER (ORDER BY k) + lag(v, 2) OVER (ORDER BY k), 8) AS d2 FROM (SELECT var, v, row_number() OVER (ORDER BY v DESC, var) AS k FROM (SELECT var, var_samp(value) AS v FROM (@long) l GROUP BY var) s) t"
    p["pve_cumsum"] = "SELECT var, round(sum(v) OVER (ORDER BY v DESC, var ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(v) OVER (), 8) AS pve FROM (SELECT var, var_samp(value) AS v FROM (@long) l GROUP BY var) s"
    p["top_variables"] = "SELECT var, round(sd, 8) AS sd FROM (SELECT var, stddev_samp(value) AS sd FROM (@long) l GROUP BY var) s ORDER BY sd DESC, var LIMIT 3"
    # edge and node weights
    p["edge_r2z"] = f"WITH d AS ({EDGE_DATA}), z AS ({Z_ALL}) SELECT src, dst, round(atanh(r) * sqrt(n - 3.0), 6) AS u, CASE WHEN abs(atanh(r) * sqrt(n - 3.0)) < 1.96 THEN 0 WHEN r > 0 THEN 1 ELSE -1 END AS zsign, round({two_sided('atanh(r) * sqrt(n - 3.0)')}, 6) AS pv FROM z"
    group_z = "g AS (SELECT src, dst, (atanh(max(CASE WHEN grp = 1 THEN r END)) - atanh(max(CASE WHEN grp = 0 THEN r END))) / sqrt(1.0 / (max(CASE WHEN grp = 1 THEN n END) - 3) + 1.0 / (max(CASE WHEN grp = 0 THEN n END) - 3)) AS u FROM (SELECT src, dst, grp, corr(xv, yv) AS r, count(*) AS n FROM d GROUP BY src, dst, grp) s GROUP BY src, dst)"
    p["edge_r2z_group"] = f"WITH d AS ({EDGE_DATA}), {group_z} SELECT src, dst, round(u, 6) AS u, CASE WHEN abs(u) < 1.96 THEN 0 WHEN u > 0 THEN 1 ELSE -1 END AS zsign, round({two_sided('u')}, 6) AS pv FROM g"
    tests = f"WITH g AS (SELECT x AS src, y AS dst, (atanh(max(CASE WHEN grp = 1 THEN r END)) - atanh(max(CASE WHEN grp = 0 THEN r END))) / sqrt(1.0 / (max(CASE WHEN grp = 1 THEN n END) - 3) + 1.0 / (max(CASE WHEN grp = 0 THEN n END) - 3)) AS u FROM (@group_pair) p GROUP BY x, y), t AS (SELECT src, dst, u, {two_sided('u')} AS pv FROM g)"
    p["pairs_r2z_group_tests"] = f"{tests} SELECT src, dst, u, pv FROM t"
    p["pairs_r2z_group_bh"] = f"{tests}, j AS ({adjust('pv', 't', 'BH', 'src, dst, u')}) SELECT src, dst, round(u, 6) AS u, round(pv, 6) AS pv, round(padj, 6) AS padj FROM j"
    slopes = "s AS (SELECT src, dst, grp, covar_samp(xv, yv) / var_samp(xv) AS b, count(*) AS n, (count(*) - 1) * (var_samp(yv) - covar_samp(xv, yv) * covar_samp(xv, yv) / var_samp(xv)) AS rss, (count(*) - 1) * var_samp(xv) AS sxx FROM d GROUP BY src, dst, grp)"
    p["edge_lmi_interaction"] = f"WITH d AS ({EDGE_DATA}), {slopes} SELECT src, dst, round((max(CASE WHEN grp = 1 THEN b END) - max(CASE WHEN grp = 0 THEN b END)) / sqrt(sum(rss) / (sum(n) - 4) * sum(1.0 / sxx)), 6) AS t FROM s GROUP BY src, dst"
    p["edge_group_slopes"] = f"WITH d AS ({EDGE_DATA}), {slopes} SELECT src, dst, round(max(CASE WHEN grp = 1 THEN b END) - max(CASE WHEN grp = 0 THEN b END), 8) AS d_est, round(sqrt(sum(rss / (n - 2) / sxx)), 8) AS d_se, round((max(CASE WHEN grp = 1 THEN b END) - max(CASE WHEN grp = 0 THEN b END)) / sqrt(sum(rss / (n - 2) / sxx)), 6) AS d_z FROM s GROUP BY src, dst"
    p["edge_sem_w"] = f"WITH d AS ({EDGE_DATA}), deg AS (SELECT name, count(*) AS k FROM (SELECT src AS name FROM (@dag) e UNION ALL SELECT dst AS name FROM (@dag) f) s GROUP BY name), m AS (SELECT src, dst, avg(CASE WHEN grp = 1 THEN xv END) - avg(CASE WHEN grp = 0 THEN xv END) AS a1, avg(CASE WHEN grp = 1 THEN yv END) - avg(CASE WHEN grp = 0 THEN yv END) AS b1 FROM d GROUP BY src, dst) SELECT m.src, m.dst, round(a1 / p.k + b1 / q.k, 8) AS w FROM m JOIN deg p ON p.name = m.src JOIN deg q ON q.name = m.dst"
    p["edge_cov_w"] = f"WITH d AS ({EDGE_DATA}), deg AS (SELECT name, count(*) AS k FROM (SELECT src AS name FROM (@dag) e UNION ALL SELECT dst AS name FROM (@dag) f) s GROUP BY name), m AS (SELECT src, dst, avg(CASE WHEN grp = 1 THEN xv END) - avg(CASE WHEN grp = 0 THEN xv END) AS a, avg(CASE WHEN grp = 1 THEN yv END) - avg(CASE WHEN grp = 0 THEN yv END) AS b, covar_pop(CASE WHEN grp = 1 THEN xv END, CASE WHEN grp = 1 THEN yv END) - covar_pop(CASE WHEN grp = 0 THEN xv END, CASE WHEN grp = 0 THEN yv END) AS c FROM d GROUP BY src, dst) SELECT m.src, m.dst, round(a / p.k + b / q.k + c, 8) AS w FROM m JOIN deg p ON p.name = m.src JOIN deg q ON q.name = m.dst"
    p["node_lm_t"] = f"SELECT var, round(diff / se, 6) AS t, CASE WHEN abs(diff / se) < 2 THEN 0 WHEN diff > 0 THEN 1 ELSE -1 END AS zsign FROM ({TTEST}) s"
    pvals = f"t AS (SELECT var, {PVALUE} AS pv FROM ({TTEST}) s)"
    for name, method in (("bh", "BH"), ("bonferroni", "bonferroni"), ("holm", "holm")):
        p[f"p_adjust_{name}"] = f"WITH {pvals}, j AS ({adjust('pv', 't', method, 'var')}) SELECT var, round(pv, 6) AS pv, round(padj, 6) AS padj FROM j"
    p["fisher_combine_even_df"] = f"WITH {pvals}, f AS (SELECT sum(-2.0 * ln(pv + 1e-16)) AS x, count(*) AS k FROM t), terms AS (SELECT row_number() OVER (ORDER BY var) - 1 AS i FROM t), fact AS (SELECT a.i, coalesce(sum(ln(b.i)), 0.0) AS lf FROM terms a LEFT JOIN terms b ON b.i BETWEEN 1 AND a.i GROUP BY a.i) SELECT round(max(x), 6) AS chisq, 2 * max(k) AS df, round(sum(exp(-x / 2 + i * ln(x / 2) - lf)), 6) AS p FROM f CROSS JOIN fact"
    p["bonferroni_combine"] = f"WITH {pvals} SELECT count(*) AS k, round(least(1.0, count(*) * min(pv)), 6) AS p FROM t"
    # conditional independence
    p["missing_edges_basis_set"] = "WITH v AS (SELECT src AS name FROM (@signal) e UNION SELECT dst AS name FROM (@signal) f) SELECT a.name AS x, b.name AS y FROM v a JOIN v b ON a.name < b.name LEFT ANTI JOIN (SELECT least(src, dst) AS x, greatest(src, dst) AS y FROM (@signal) g) k ON k.x = a.name AND k.y = b.name"
    basis = "v AS (SELECT DISTINCT var AS name FROM (@long) l), miss AS (SELECT a.name AS x, b.name AS y FROM v a JOIN v b ON a.name < b.name WHERE NOT EXISTS (SELECT 1 FROM (@dag) g WHERE least(g.src, g.dst) = a.name AND greatest(g.src, g.dst) = b.name)), z AS (SELECT DISTINCT x, y, src AS z FROM miss JOIN (@dag) g ON g.dst = miss.x OR g.dst = miss.y WHERE g.src <> miss.x AND g.src <> miss.y)"
    p["conditioning_sets"] = f"WITH {basis} SELECT miss.x, miss.y, count(z.z) AS n_z FROM miss LEFT JOIN z ON z.x = miss.x AND z.y = miss.y GROUP BY miss.x, miss.y"
    p["partial_corr_q1"] = f"WITH {basis}, c AS (SELECT x, y, r, n FROM ({PAIR}) p UNION ALL SELECT y AS x, x AS y, r, n FROM ({PAIR}) q) SELECT z.x, z.y, z.z, round((a.r - b.r * d.r) / sqrt((1 - b.r * b.r) * (1 - d.r * d.r)), 8) AS pr FROM z JOIN c a ON a.x = z.x AND a.y = z.y JOIN c b ON b.x = z.x AND b.y = z.z JOIN c d ON d.x = z.y AND d.y = z.z"
    # the correlations among the ends and conditioning nodes of each missing edge, from which the latter are swept one by one
    end = lambda i, j: f"max(CASE WHEN i = {i} AND j = {j} THEN r END)"
    one = f"WITH {basis}, ks AS (SELECT x, y, z, row_number() OVER (PARTITION BY x, y ORDER BY z) AS s FROM z), nd AS (SELECT x, y, x AS node FROM miss UNION ALL SELECT x, y, y AS node FROM miss UNION ALL SELECT x, y, z AS node FROM z), m0 AS (SELECT a.x, a.y, a.node AS i, b.node AS j, CASE WHEN a.node = b.node THEN 1.0 ELSE c.r END AS r, c.n FROM nd a JOIN nd b ON b.x = a.x AND b.y = a.y LEFT JOIN ({PAIR}) c ON c.x = least(a.node, b.node) AND c.y = greatest(a.node, b.node))"
    for s in range(1, SWEEPS + 1):
        one += f", m{s} AS (SELECT x, y, i, j, n, CASE WHEN z IS NULL THEN r ELSE r - iz * zj / zz END AS r FROM (SELECT m.x, m.y, m.i, m.j, m.n, m.r, k.z, max(CASE WHEN m.j = k.z THEN m.r END) OVER (PARTITION BY m.x, m.y, m.i) AS iz, max(CASE WHEN m.i = k.z THEN m.r END) OVER (PARTITION BY m.x, m.y, m.j) AS zj, max(CASE WHEN m.i = k.z AND m.j = k.z THEN m.r END) OVER (PARTITION BY m.x, m.y) AS zz FROM m{s - 1} m LEFT JOIN ks k ON k.x = m.x AND k.y = m.y AND k.s = {s}) w WHERE z IS NULL OR (i <> z AND j <> z))"
    one += f", pr AS (SELECT t.x, t.y, coalesce(k.q, 0) AS q, t.n, t.r FROM (SELECT x, y, max(n) AS n, {end('x', 'y')} / sqrt({end('x', 'x')} * {end('y', 'y')}) AS r FROM m{SWEEPS} GROUP BY x, y) t LEFT JOIN (SELECT x, y, count(*) AS q FROM z GROUP BY x, y) k ON k.x = t.x AND k.y = t.y)"
    p["not_close_fit_p"] = f"{one} SELECT x, y, q AS n_z, round(r, 8) AS estimate, round({not_close_fit('r', 'n', 'q')}, 6) AS pvalue, round(tanh(atanh(r) - 1.96 / sqrt(n - 3.0 - q)), 6) AS lower, round(tanh(atanh(r) + 1.96 / sqrt(n - 3.0 - q)), 6) AS upper FROM pr"
    p["shipley_c_stat"] = f"{one}, t AS (SELECT {not_close_fit('r', 'n', 'q')} AS pv FROM pr) SELECT count(*) AS n_tests, round(sum(-2.0 * ln(pv + 1e-16)), 4) AS c_stat, 2 * count(*) AS df FROM t"
    p["bap_edges_selected"] = f"{one}, t AS (SELECT x, y, {two_sided('atanh(r) * sqrt(n - 3.0 - q)')} AS pv FROM pr), j AS ({adjust('pv', 't', 'BH', 'x, y')}) SELECT x, y, round(padj, 6) AS padj FROM j WHERE padj < 0.5"
    # graph algebra
    p["simplify_edges"] = "SELECT DISTINCT src, dst FROM (@rawtrans) e WHERE src <> dst"
    p["mutual_edges"] = "SELECT a.src, a.dst FROM (@trans) a WHERE a.src <> a.dst AND EXISTS (SELECT 1 FROM (@trans) b WHERE b.src = a.dst AND b.dst = a.src)"
    p["split_directed_bidirected"] = "SELECT least(a.src, a.dst) AS a, greatest(a.src, a.dst) AS b, CASE WHEN count(*) > 1 THEN '<->' WHEN max(a.src) < max(a.dst) THEN '->' ELSE '<-' END AS kind FROM (@mixed) a GROUP BY least(a.src, a.dst), greatest(a.src, a.dst)"
    p["induced_subgraph"] = "WITH keep AS (SELECT dst AS name FROM (@mixed) e GROUP BY dst HAVING count(*) > 1) SELECT e.src, e.dst FROM (@mixed) e LEFT SEMI JOIN keep k ON k.name = e.src LEFT SEMI JOIN keep m ON m.name = e.dst"
    p["delete_edges_isolates"] = f"WITH left_ AS (SELECT src, dst FROM (@mixed) e WHERE src <> @c AND dst <> @c) SELECT v.name, CASE WHEN EXISTS (SELECT 1 FROM left_ l WHERE l.src = v.name OR l.dst = v.name) THEN 0 ELSE 1 END AS isolated FROM ({VERTS}) v"
    p["graph_union"] = "SELECT src, dst FROM (@signal) a UNION SELECT src, dst FROM (@dag) b"
    p["graph_difference"] = f"SELECT a, b FROM ({UNDIRECTED}) u EXCEPT SELECT least(src, dst), greatest(src, dst) FROM (@signal) s WHERE src = @c OR dst = @c"
    p["edge_old_new_color"] = "SELECT a.src, a.dst, CASE WHEN b.src IS NULL THEN 'green' ELSE 'gray' END AS color FROM (@mixed) a LEFT JOIN (@signal) b ON b.src = a.src AND b.dst = a.dst"
    p["degree_table"] = f"SELECT v.name, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM ({VERTS}) v LEFT JOIN (SELECT dst, count(*) AS n FROM (@mixed) e GROUP BY dst) i ON i.dst = v.name LEFT JOIN (SELECT src, count(*) AS n FROM (@mixed) e GROUP BY src) o ON o.src = v.name"
    p["degree_supply"] = "SELECT dst AS name, count(*) AS degree FROM (@supply) e GROUP BY dst"
    p["source_sink_nodes"] = "WITH e AS (@signal) SELECT s.name AS source, t.name AS sink FROM (SELECT DISTINCT src AS name FROM e WHERE src NOT IN (SELECT dst FROM e)) s CROSS JOIN (SELECT DISTINCT dst AS name FROM e WHERE dst NOT IN (SELECT src FROM e)) t"
    p["weighted_indegree_status"] = "SELECT dst, CASE WHEN sum(w) >= 1 THEN 1 WHEN sum(w) = 0 THEN 0 ELSE -1 END AS status FROM (SELECT src, dst, CASE WHEN src < dst THEN 1.0 ELSE -0.5 END AS w FROM (@mixed) e) s GROUP BY dst"
    p["parents"] = "SELECT src AS name FROM (@mixed) e WHERE dst = @d UNION SELECT @d AS name"
    p["children_siblings"] = "SELECT dst AS name FROM (@mixed) e WHERE src = @a UNION SELECT @a AS name"
    p["cycles_k3"] = "WITH e AS (SELECT src, dst FROM (@trans) t WHERE src <> dst) SELECT a.src AS a, a.dst AS b, b.dst AS c FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.src"
    p["vstructures"] = "SELECT a.src AS x, a.dst AS y, b.src AS z FROM (@signal) a JOIN (@signal) b ON b.dst = a.dst AND a.src < b.src WHERE NOT EXISTS (SELECT 1 FROM (@signal) c WHERE (c.src = a.src AND c.dst = b.src) OR (c.src = b.src AND c.dst = a.src))"
    p["orient_edges"] = f"SELECT a AS src, b AS dst FROM ({UNDIRECTED}) u WHERE NOT EXISTS (SELECT 1 FROM (@signal) s WHERE s.src = u.b AND s.dst = u.a) UNION SELECT b, a FROM ({UNDIRECTED}) w WHERE NOT EXISTS (SELECT 1 FROM (@signal) s WHERE s.src = w.a AND s.dst = w.b)"
    p["cpdag_mi_filter"] = f"SELECT x, y, round(-n * ln(1 - r * r + 1e-16), 6) AS mi FROM ({PAIR}) p WHERE -n * ln(1 - r * r + 1e-16) > power({probit('0.975')}, 2)"
    p["eweight_transform"] = f"SELECT x, y, round(1 - abs(r), 8) AS w_cor, 2 - CASE WHEN abs(atanh(r) * sqrt(n - 3.0)) < 1.96 THEN 0 ELSE 1 END AS w_zsign, round(1.0 / (-log10(greatest({two_sided('atanh(r) * sqrt(n - 3.0)')}, 1e-15) * 0.999999)), 5) AS w_p FROM ({PAIR}) p"
    # text forms
    p["model_text"] = "SELECT 'z' || dst || '~z' || src AS line FROM (@signal) e UNION ALL SELECT 'z' || least(a.src, a.dst) || '~~z' || greatest(a.src, a.dst) AS line FROM (@mixed) a JOIN (@mixed) b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst"
    p["model_parse"] = "SELECT replace(split_part(line, '~', 1), 'z', '') AS lhs, CASE WHEN line LIKE '%~~%' THEN '~~' ELSE '~' END AS op, replace(substring(line, length(split_part(line, '~', 1)) + CASE WHEN line LIKE '%~~%' THEN 3 ELSE 2 END), 'z', '') AS rhs FROM (" + p["model_text"] + ") m"
    p["dagitty_text"] = "SELECT CASE WHEN b.src IS NULL THEN a.src || '->' || a.dst ELSE a.src || '<->' || a.dst END AS line FROM (@mixed) a LEFT JOIN (@mixed) b ON b.src = a.dst AND b.dst = a.src WHERE b.src IS NULL OR a.src < a.dst"
    p["dagitty_parse"] = "WITH m AS (" + p["dagitty_text"] + "), s AS (SELECT replace(line, '<', '') AS line, line LIKE '%<->%' AS twoway FROM m) SELECT split_part(line, '->', 1) AS src, split_part(line, '->', 2) AS dst FROM s UNION ALL SELECT split_part(line, '->', 2), split_part(line, '->', 1) FROM s WHERE twoway"
    p["color_graph"] = f"WITH t AS (SELECT var, diff, {PVALUE} AS pv FROM ({TTEST}) s), j AS ({adjust('pv', 't', 'BH', 'var, diff')}) SELECT var, CASE WHEN padj >= 0.3 THEN 'white' WHEN diff > 0 THEN 'pink' ELSE 'lightblue' END AS color FROM j"
    # clusters
    member = "m AS (@member)"
    p["cluster_sizes_filter"] = f"WITH {member} SELECT cluster, count(*) AS n FROM m GROUP BY cluster HAVING count(*) >= 3"
    p["cplot_modules"] = f"WITH {member} SELECT a.cluster, e.src, e.dst FROM (@mixed) e JOIN m a ON a.name = e.src JOIN m b ON b.name = e.dst AND b.cluster = a.cluster"
    p["merge_nodes"] = f"WITH {member} SELECT DISTINCT a.cluster AS src, b.cluster AS dst FROM (@mixed) e JOIN m a ON a.name = e.src JOIN m b ON b.name = e.dst WHERE a.cluster <> b.cluster"
    p["hidden_module_graph"] = f"WITH {member} SELECT 'LV' || cast(cluster AS STRING) AS src, name AS dst FROM m UNION ALL SELECT src, dst FROM (@signal) e"
    p["modularity"] = f"WITH {member}, u AS ({UNDIRECTED}), t AS (SELECT count(*) AS m FROM u), k AS (SELECT name, count(*) AS k FROM (SELECT a AS name FROM u UNION ALL SELECT b FROM u) s GROUP BY name), c AS (SELECT m.cluster, cast(sum(k) AS double) AS d FROM m JOIN k ON k.name = m.name GROUP BY m.cluster), i AS (SELECT a.cluster, count(*) AS l FROM u JOIN m a ON a.name = u.a JOIN m b ON b.name = u.b AND b.cluster = a.cluster GROUP BY a.cluster) SELECT round(sum(coalesce(l, 0) / cast(t.m AS double) - power(d / (2.0 * t.m), 2)), 8) AS q FROM c LEFT JOIN i ON i.cluster = c.cluster CROSS JOIN t"
    p["two_sample_score_group"] = f"SELECT var, round(diff, 8) AS est, round(se, 8) AS se, round(diff / se, 6) AS z, round({PVALUE}, 6) AS pvalue FROM ({TTEST}) s"
    # pathways and evaluation
    path = "SELECT p_brand AS pathway, 's' || cast(l_suppkey AS STRING) AS src, 'p' || cast(l_partkey AS STRING) AS dst FROM (@lines) l JOIN (@parts) p ON p.p_partkey = l.l_partkey"
    p["pathway_filters"] = f"SELECT pathway, count(*) AS n_edges, count(DISTINCT src) + count(DISTINCT dst) AS n_nodes FROM (SELECT DISTINCT pathway, src, dst FROM ({path}) q) s GROUP BY pathway HAVING count(*) BETWEEN 6 AND 100000"
    p["probe_collapse_mean"] = "SELECT p_type, count(*) AS n, round(avg(p_retailprice), 6) AS v FROM (@parts) p WHERE p_type <> '' GROUP BY p_type"
    p["probe_collapse_first"] = "SELECT p_type, p_partkey, p_retailprice FROM (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM (@parts) p) s WHERE k = 1"
    p["rank_abs_rel_comp"] = f"WITH {pvals} SELECT var, cast(dense_rank() OVER (ORDER BY pv) AS bigint) AS abs_rank, round(100.0 * dense_rank() OVER (ORDER BY pv) / (SELECT count(DISTINCT pv) FROM t), 6) AS rel_rank, round(100.0 * cume_dist() OVER (ORDER BY pv), 6) AS comp_rank FROM t"
    p["gsa_postprocess"] = f"WITH {pvals}, g AS (SELECT var AS pathway, pv AS p_na, 1 - pv AS p_ni FROM t), h AS (SELECT pathway, least(2 * least(p_na, p_ni), 1.0) AS pval FROM g) SELECT pathway, round(pval, 6) AS pval, round(least(1.0, pval * count(*) OVER ()), 6) AS adjp FROM h"
    p["metrics_prf"] = f"WITH pred AS (SELECT x, y FROM ({PAIR}) p WHERE abs(atanh(r) * sqrt(n - 3.0)) > 1.96), gold AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM (@dag) g), v AS (SELECT count(DISTINCT var) AS k FROM (@long) l), c AS (SELECT count(CASE WHEN p.x IS NOT NULL AND g.x IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN g.x IS NULL THEN 1 END) AS fp, count(CASE WHEN p.x IS NULL THEN 1 END) AS fn FROM pred p FULL OUTER JOIN gold g ON g.x = p.x AND g.y = p.y) SELECT tp, fp, fn, round(tp / cast(tp + fp AS double), 8) AS prec, round(tp / cast(tp + fn AS double), 8) AS tpr, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1, round(fp / (k * (k - 1) / 2.0 - tp - fn), 8) AS fpr FROM c CROSS JOIN v"
    p["shd_hamming"] = f"WITH a AS ({UNDIRECTED}), b AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (@signal) e WHERE src <> @c) SELECT count(*) AS shd FROM (SELECT a.a FROM a LEFT ANTI JOIN b ON b.a = a.a AND b.b = a.b UNION ALL SELECT b.a FROM b LEFT ANTI JOIN a ON a.a = b.a AND a.b = b.b) s"
    p["jaccard_sets"] = "WITH s AS (SELECT DISTINCT lang, source FROM (@docs) d), n AS (SELECT lang, count(*) AS k FROM s GROUP BY lang), b AS (SELECT a.lang AS x, b.lang AS y, count(*) AS common FROM s a JOIN s b ON b.source = a.source AND a.lang < b.lang GROUP BY a.lang, b.lang) SELECT b.x, b.y, round(common / cast(p.k + q.k - common AS double), 8) AS jaccard FROM b JOIN n p ON p.lang = b.x JOIN n q ON q.lang = b.y"
    p["reshape_wide"] = "SELECT lang, count(CASE WHEN source = 'src0' THEN 1 END) AS src0, count(CASE WHEN source = 'src1' THEN 1 END) AS src1, count(CASE WHEN source NOT IN ('src0', 'src1') THEN 1 END) AS others FROM (@docs) d GROUP BY lang"
    p["median_error"] = "SELECT l_returnflag, round(PERCENTILE(l_quantity, 0.5), 6) AS med, round(avg(l_quantity), 6) AS mean FROM (@lines) l GROUP BY l_returnflag"
    p["ego2_sizes"] = "WITH u AS (SELECT src AS a, dst AS b FROM (@mixed) e UNION SELECT dst AS a, src AS b FROM (@mixed) f), n AS (SELECT a, b FROM u UNION SELECT x.a AS a, y.b AS b FROM u x JOIN u y ON y.a = x.b UNION SELECT src AS a, src AS b FROM (@mixed) g UNION SELECT dst AS a, dst AS b FROM (@mixed) h) SELECT a AS name, count(*) AS size FROM n GROUP BY a"
    p["lingam_entropy_terms"] = "SELECT var, round(avg(ln((exp(z) + exp(-z)) / 2.0)), 8) AS log_cosh, round(avg(z * exp(-z * z / 2.0)), 8) AS gauss FROM (SELECT var, (value - avg(value) OVER (PARTITION BY var)) / stddev_samp(value) OVER (PARTITION BY var) AS z FROM (@long) l) s GROUP BY var"
    p["ols_nodewise_1parent"] = f"WITH d AS ({EDGE_DATA}) SELECT dst AS lhs, src AS rhs, round(corr(xv, yv), 8) AS est, round(sqrt((1 - power(corr(xv, yv), 2)) / count(*)), 8) AS se FROM d GROUP BY src, dst"
    p["srmr_from_cov"] = f"SELECT round(sqrt(avg(power(res, 2))), 8) AS srmr FROM (SELECT CASE WHEN e.src IS NULL THEN r ELSE 0.0 END AS res FROM ({PAIR}) p LEFT JOIN (@dag) e ON least(e.src, e.dst) = p.x AND greatest(e.src, e.dst) = p.y UNION ALL SELECT 0.0 AS res FROM (SELECT DISTINCT var FROM (@long) l) v) s"
    # orders, samples and set measures
    p["order_by_p"] = f"WITH {pvals} SELECT cast(row_number() OVER (ORDER BY pv, var) AS bigint) AS place, var, round(pv, 6) AS pv FROM t"
    p["modules_by_shift"] = f"WITH {pvals}, c AS (SELECT src AS module, dst AS var FROM (@dag) e), m AS (SELECT module, count(*) AS n, sum(-2.0 * ln(pv + 1e-16)) AS score FROM c JOIN t ON t.var = c.var GROUP BY module) SELECT cast(row_number() OVER (ORDER BY score DESC, module) AS bigint) AS place, module, n, round(score, 6) AS score FROM m"
    p["sampled_rows"] = "SELECT obs, grp FROM (SELECT DISTINCT obs, grp FROM (@long) l) o ORDER BY md5(concat('17:', cast(obs AS STRING))), obs LIMIT 20"
    p["node_set_metrics"] = f"WITH {pvals}, seed AS (SELECT DISTINCT src AS var FROM (@dag) e), gold AS (SELECT var FROM t WHERE pv < 0.05), c AS (SELECT (SELECT count(*) FROM seed) AS size, (SELECT count(*) FROM gold) AS n_gold, (SELECT count(*) FROM seed JOIN gold ON gold.var = seed.var) AS hits) SELECT size, n_gold, hits, round(hits / cast(size AS double), 8) AS prec, round(hits / cast(n_gold AS double), 8) AS recall, round(2.0 * hits / (size + n_gold), 8) AS f1 FROM c"
    p["classification_metrics"] = "WITH s AS (SELECT var, avg(CASE WHEN grp = 1 THEN value END) AS m1, avg(CASE WHEN grp = 0 THEN value END) AS m0, var_samp(value) AS v FROM (@long) l GROUP BY var), d AS (SELECT l.obs, max(l.grp) AS gold, sum((l.value - (m1 + m0) / 2) * (m1 - m0) / v) AS score FROM (@long) l JOIN s ON s.var = l.var GROUP BY l.obs), c AS (SELECT count(CASE WHEN score > 0 AND gold = 1 THEN 1 END) AS tp, count(CASE WHEN score > 0 AND gold = 0 THEN 1 END) AS fp, count(CASE WHEN score <= 0 AND gold = 1 THEN 1 END) AS fn, count(CASE WHEN score <= 0 AND gold = 0 THEN 1 END) AS tn FROM d) SELECT tp, fp, fn, tn, round(tp / cast(tp + fn AS double), 8) AS sensitivity, round(tn / cast(tn + fp AS double), 8) AS specificity, round((tp + tn) / cast(tp + tn + fp + fn AS double), 8) AS accuracy FROM c"
    p["extracted_tree"] = f"WITH {pvals}, seed AS (SELECT var FROM t WHERE pv < 0.05), e AS (SELECT DISTINCT src, dst FROM (@dag) g), near AS (SELECT src, dst FROM e WHERE src IN (SELECT var FROM seed) OR dst IN (SELECT var FROM seed)) SELECT src, dst, CASE WHEN src IN (SELECT var FROM seed) AND dst IN (SELECT var FROM seed) THEN 'seeds' ELSE 'link' END AS kind FROM near"
    p["full_graph"] = f"SELECT a.name AS src, b.name AS dst FROM ({VERTS}) a JOIN ({VERTS}) b ON a.name <> b.name"
    p["conversation_chain"] = "SELECT role AS src, nxt AS dst, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (@turns) t) s WHERE nxt IS NOT NULL GROUP BY role, nxt"
    return p


def swept_regressions(pairs: str, most: int = 3) -> str:
    """CTEs that end in ``reg`` (j, k, b, v, n): the regression of each node on its parents, at most ``most`` of them, from correlations
    ``pairs`` (x, y, r, n): slope, its variance but for the rows' number, and that number. Parents are swept one by one."""
    out = f"c AS ({pairs}), f AS (SELECT dst AS j, src AS k, row_number() OVER (PARTITION BY dst ORDER BY src) AS s FROM (SELECT DISTINCT src, dst FROM (@dag) g) e), nd AS (SELECT j, k AS node FROM f UNION SELECT j, j AS node FROM f), m0 AS (SELECT a.j, a.node AS i, b.node AS l, CASE WHEN a.node = b.node THEN 1.0 ELSE c.r END AS v FROM nd a JOIN nd b ON b.j = a.j LEFT JOIN c ON c.x = least(a.node, b.node) AND c.y = greatest(a.node, b.node))"
    for s in range(1, most + 1):
        out += f", m{s} AS (SELECT j, i, l, CASE WHEN z IS NULL THEN v WHEN i = z AND l = z THEN -1.0 / zz WHEN i = z THEN zl / zz WHEN l = z THEN iz / zz ELSE v - iz * zl / zz END AS v FROM (SELECT m.j, m.i, m.l, m.v, f.k AS z, max(CASE WHEN m.l = f.k THEN m.v END) OVER (PARTITION BY m.j, m.i) AS iz, max(CASE WHEN m.i = f.k THEN m.v END) OVER (PARTITION BY m.j, m.l) AS zl, max(CASE WHEN m.i = f.k AND m.l = f.k THEN m.v END) OVER (PARTITION BY m.j) AS zz FROM m{s - 1} m LEFT JOIN f ON f.j = m.j AND f.s = {s}) w)"
    return out + f", reg AS (SELECT b.j, b.i AS k, b.v AS b, -p.v * rest.v AS v, (SELECT max(n) FROM c) AS n FROM m{most} b JOIN m{most} p ON p.j = b.j AND p.i = b.i AND p.l = b.i JOIN m{most} rest ON rest.j = b.j AND rest.i = b.j AND rest.l = b.j WHERE b.l = b.j AND b.i <> b.j)"


PLANS = _plans()


def text(plan: str, duck: bool = False, published: bool = False) -> str:
    """The SQL of a plan (its name or text) for one engine; relations may refer to others."""
    found, out = relations(duck, published), PLANS.get(plan, plan)
    while "@" in out:
        out = re.sub(r"@(\w+)", lambda m: found[m[1]], out)
    number = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")  # doubles, not decimals
    return duck_dialect(number.sub(r"\1::DOUBLE", out)) if duck else number.sub(r"\1D", out)


def duck_dialect(sql: str) -> str:
    """Spark's names to DuckDB's."""
    return sql.replace("PERCENTILE(", "quantile_cont(").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN").replace(" AS STRING)", " AS VARCHAR)").replace(" AS string)", " AS varchar)")


def frames(plans: list[str], spark: SparkSession, sf_dir: str, published: bool = False) -> list[DataFrame]:
    """The results of several plans over one opening of their tables, each of which is a job."""
    sqls = [text(p, published=published) for p in plans]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any("{" + t + "}" in s for s in sqls)}
    return [spark.sql(s, **{t: df for t, df in used.items() if "{" + t + "}" in s}) for s in sqls]


def frame(plan: str, spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    sql = text(plan, published=published)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if "{pairs}" in sql or "{group_pairs}" in sql:
        from .fits import matrix

        rows, name = matrix(spark, sf_dir), lambda pick: pick(F.concat(F.lit("v"), F.col("i").cast("string")), F.concat(F.lit("v"), F.col("j").cast("string")))
        for key, given in (("pairs", rows.withColumn("grp", F.lit(0))), ("group_pairs", rows)):
            if "{" + key + "}" in sql:
                used[key] = pairs(given).select("grp", name(F.least).alias("x"), name(F.greatest).alias("y"), "n", "r", "cov")
    return spark.sql(sql, **used)


def pairs_r2z_group_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variable pairs differ between two groups; the adjustment sorts in ranges where the SQL text has one window."""
    tests = adjusted(frame("pairs_r2z_group_tests", spark, sf_dir), ["src", "dst"])
    return tests.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("u", "pv", "padj")])


def l2t_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the logarithms where the quantiles call for them; these come from sorted ranges where the SQL text has aggregates."""
    lines = frame("SELECT l_returnflag, l_extendedprice FROM (@lines) l", spark, sf_dir)
    q0, q25, q99, q100 = quantiles(lines.select("l_extendedprice"), [0.0, 0.25, 0.99, 1.0])
    log = q0 is not None and (q99 > 100 or (q100 - q0 > 50 and q25 > 0))
    value = F.when(F.col("l_extendedprice") > 0, F.log2("l_extendedprice")) if log else F.col("l_extendedprice")
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_l2"))


def missing_edges_basis_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nodes that no edge joins, from blocks of the graph's matrix where the SQL text joins all pairs with the edges."""
    return graphs.gaps(frame("SELECT src, dst FROM (@signal) e", spark, sf_dir))


def full_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.full(frame("SELECT src, dst FROM (@mixed) e", spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = {name: (lambda spark, sf_dir, name=name: frame(name, spark, sf_dir)) for name in PLANS if name != "pairs_r2z_group_tests"}
    return plans | {"pairs_r2z_group_bh": pairs_r2z_group_bh, "l2t_log2": l2t_log2, "missing_edges_basis_set": missing_edges_basis_set, "full_graph": full_graph}


def oracle_sql() -> dict[str, str]:
    return {name: text(name, duck=True) for name in PLANS if name != "pairs_r2z_group_tests"}

