"""Model fits over sufficient statistics, as queries.

Rows are read once: every partition adds up its counts, sums and cross products by group and sends one small matrix, which
is summed by Spark. Kernels see these matrices only; replicates and models run as rows of parallel tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import two_sided
from ..operators import kernels, learning
from ..operators.rows import complete, moments, multiplied, pooled
from ..operators.sem import poisson_weights
from . import catalog

Edge = tuple[int, int]


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, x (array of doubles, whole vectors) and grp of the embedding table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("obs"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") >= 5).cast("int").alias("grp"))


def edges_of(spark: SparkSession, sf_dir: str) -> list[Edge]:
    """The graph of the columns, as places: a model graph, so it is small."""
    return [(r["a"], r["b"]) for r in catalog.frame("SELECT DISTINCT src - 1 AS a, dst - 1 AS b FROM (@places) e ORDER BY a, b", spark, sf_dir).collect()]


def _estimates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    found = spark.createDataFrame([(f"v{j}", "~", f"v{k}", float(b), float(se)) for j, k, b, se in rows], "lhs string, op string, rhs string, est double, se double")
    p = two_sided("(est / se)")
    return found.selectExpr("lhs", "op", "rhs", "round(est, 6) AS est", "round(se, 6) AS se", "round(est / se, 4) AS z", f"round({p}, 6) AS pvalue")


def study(spark: SparkSession, sf_dir: str) -> tuple[list[Edge], dict[int, tuple], int, object]:
    """(edges, moments, rows, pooled correlation) of the stored matrix and the graph of its columns."""
    parts = moments(matrix(spark, sf_dir))
    return edges_of(spark, sf_dir), parts, *pooled(parts)


def _parents(edges: list[Edge], width: int) -> dict[int, list[int]]:
    return dict(enumerate(learning.parents(edges, width)))


def fit_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum-likelihood paths of the recursive model on correlations."""
    edges, _, n, r = study(spark, sf_dir)
    return _estimates(spark, kernels.dag_ols(r, _parents(edges, len(r)), n))


def fit_two_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the paths between the groups."""
    import numpy as np

    edges, parts, *_ = study(spark, sf_dir)
    fits = {}
    for g, (n, _, c) in parts.items():
        d = np.sqrt(np.diag(c))
        fits[g] = kernels.dag_ols(c / np.outer(d, d), _parents(edges, len(c)), n)
    if len(fits) < 2:
        return _estimates(spark, [])
    return _estimates(spark, [(j, k, b1 - b0, math.hypot(s0, s1)) for (j, k, b0, s0), (*_, b1, s1) in zip(fits[0], fits[1], strict=True)])


#: Bidirected edges of the mixed model: neighbouring regions.
BIDIRECTED = [(0, 1), (1, 2), (2, 3), (3, 4)]


def fit_ricf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit indices of the mixed graph with bidirected edges between the regions."""
    edges, _, n, r = study(spark, sf_dir)
    _, _, sigma, steps = kernels.ricf(r, edges, BIDIRECTED)
    found = kernels.fit_indices(r, sigma, n, len(edges) + len(BIDIRECTED) + len(r))
    return spark.createDataFrame([(round(found["dev"], 4), found["df"], round(found["srmr"], 6), round(found["rmsea"], 6), n, found["npar"], steps)], "dev double, df int, srmr double, rmsea double, n long, npar int, steps int")


def fit_ggm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-biased node-wise regressions: a lasso step corrected by the inverse of the parents' covariance."""
    edges, _, n, r = study(spark, sf_dir)
    return _estimates(spark, kernels.node_wise(r, _parents(edges, len(r)), n))


def resampled(rows: DataFrame, families: list[tuple[int, list[int]]], reps: int) -> DataFrame:
    """(lhs, rhs, est, se, reps) of the regressions (child, predictors) on scaled columns, by a Poisson bootstrap.

    Every row draws its weight in each replicate from a hash of its id, so one pass over the rows adds up all replicates, whatever
    the partitions. A family needs the cross products of its own columns only, and a replicate is fitted where these meet.
    """
    import numpy as np

    rows = complete(rows)
    families = [(j, [j, *up]) for j, up in families if up]
    cells = [(a, b) for j, own in families for i, a in enumerate(own) for b in own[i:]]
    cells = sorted({(min(c), max(c)) for c in cells})
    nodes = sorted({v for c in cells for v in c})
    place = {c: 1 + len(nodes) + k for k, c in enumerate(cells)}
    size = 1 + len(nodes) + len(cells)
    left, right = [a for a, _ in cells], [b for _, b in cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((reps, size))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                obs = np.asarray(batch.column(0).to_pylist(), np.uint64)
                x = np.asarray(batch.column(1).flatten(), float).reshape(len(obs), -1)
                sums += poisson_weights(obs, reps).T @ np.column_stack([np.ones(len(x)), x[:, nodes], x[:, left] * x[:, right]])
        yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), pa.array([row.tobytes() for row in sums], pa.binary())], names=["rep", "sums"])

    def fit(table: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        mean = dict(zip(nodes, s[1 : 1 + len(nodes)] / s[0], strict=True))
        out = []
        for j, own in families:
            c = np.array([[s[place[min(a, b), max(a, b)]] / s[0] - mean[a] * mean[b] for b in own] for a in own])
            d = np.sqrt(np.diag(c))
            out += [(f"v{j}", ",".join(f"v{v}" for v in own[1:]), f"v{own[k]}", b) for _, k, b, _ in kernels.dag_ols(c / np.outer(d, d), {0: list(range(1, len(own)))}, int(s[0]))]
        return pa.table({"lhs": [x[0] for x in out], "given": [x[1] for x in out], "rhs": [x[2] for x in out], "b": [float(x[3]) for x in out]})

    fitted = rows.select("obs", "x").mapInArrow(run, "rep int, sums binary").groupBy("rep").applyInArrow(fit, "lhs string, given string, rhs string, b double")
    return fitted.groupBy("lhs", "given", "rhs").agg(F.avg("b").alias("est"), F.stddev_samp("b").alias("se"), F.count(F.lit(1)).alias("reps"))


def bootstrap_se(spark: SparkSession, sf_dir: str, reps: int = 1000) -> DataFrame:
    """Resampled errors of the model's paths."""
    edges = edges_of(spark, sf_dir)
    families = list(enumerate(learning.parents(edges, 1 + max(v for e in edges for v in e))))
    return resampled(matrix(spark, sf_dir), families, reps).select("lhs", "rhs", F.round("se", 6).alias("se"), "reps")


def effects_bootstrap(spark: SparkSession, sf_dir: str, reps: int = 1000) -> DataFrame:
    """Total effects of all reachable pairs, given the parents of the source, with resampled errors."""
    import numpy as np

    edges = edges_of(spark, sf_dir)
    width = 1 + max(v for e in edges for v in e)
    d = learning.distances(edges, width)
    pairs = [(x, y) for x in range(width) for y in range(width) if x != y and np.isfinite(d[x, y])]
    families = {(y, x): learning.adjustment(edges, width, x, y, "parents") for x, y in pairs}
    found = resampled(matrix(spark, sf_dir), [(y, [x, *given]) for (y, x), given in families.items()], reps)
    first = found.where(F.col("given").startswith(F.col("rhs")) & ((F.col("given") == F.col("rhs")) | F.col("given").startswith(F.concat("rhs", F.lit(",")))))
    p = two_sided("(est / se)")
    return first.selectExpr("lhs AS sink", "rhs AS source", "round(est, 6) AS est", "round(se, 6) AS se", f"round({p}, 6) AS pvalue")


def learn_dag(spark: SparkSession, sf_dir: str, beta: float = 0.0) -> DataFrame:
    """Lasso parents along the bottom-up layers of the precision matrix."""
    import numpy as np

    _, _, n, r = study(spark, sf_dir)
    found = kernels.layers(r, 0.005)
    lam = math.sqrt(math.log(max(len(found), 2)) / n)
    rows = []
    for i, layer in enumerate(found[:-1]):
        later = sorted(k for other in found[i + 1 :] for k in other)
        for j in layer:
            b = kernels.lasso(r[np.ix_(later, later)], r[later, j], lam)
            rows += [(f"v{k}", f"v{j}", round(float(x), 6)) for k, x in zip(later, b, strict=True) if abs(x) > beta]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def _square(spark: SparkSession, m) -> DataFrame:
    return spark.createDataFrame([(f"v{i}", f"v{j}", round(float(m[i, j]), 6)) for i in range(len(m)) for j in range(m.shape[1])], "i string, j string, v double")


def glasso_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse precision matrix in which the edges of the graph are zero, as they are no confounding."""
    edges, _, n, r = study(spark, sf_dir)
    return _square(spark, kernels.glasso(r, math.sqrt(math.log(len(r)) / n), set(edges))[1])


def confounded(r, n: int, edges: list[Edge], alpha: float = 0.05) -> list[Edge]:
    """Missing edges that stay dependent given the parents of both ends, at adjusted p-values."""
    gaps = learning.missing(edges, len(r))
    padj = learning.adjusted([learning.basis_test(r, n, edges, e)[2] for e in gaps])
    return [e for e, q in zip(gaps, padj, strict=True) if q < alpha]


def deconfounding(method: str, r, n: int, edges: list[Edge], q: int | None = None):
    """The matrix that rows are multiplied by: "cggm" (tested covariances), "glasso", "glpc", or a spectral method
    (trim, lava, rsvp, pcss, pc). ``q`` is the number of hidden components, from the eigenvalues where it isn't given.
    """
    import numpy as np

    if method == "cggm":
        strong = confounded(r, n, edges)
        return kernels.power(kernels.covariance_graph(r, strong), -0.5) if strong else np.eye(len(r))
    if method == "glasso":
        return kernels.power(kernels.glasso(r, math.sqrt(math.log(len(r)) / n), set(edges))[1], 0.5)
    q = max(1, learning.latent_count(r, "knee")) if q is None else q
    if method == "glpc":
        w = kernels.laplacian_components(r, edges, q)
        return np.eye(len(r)) - w @ np.linalg.pinv(w.T @ r @ w) @ w.T @ r
    return kernels.spectral(r * (n - 1), method, q)


def bap_decorrelate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows multiplied by the inverse root of the covariance graph of the confounded missing edges."""
    edges, _, n, r = study(spark, sf_dir)
    return multiplied(matrix(spark, sf_dir), deconfounding("cggm", r, n, edges))


def _spectral(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, _, n, r = study(spark, sf_dir)
        return _square(spark, kernels.spectral(r * (n - 1), method, 2))

    return query


def _deconfounded(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, _, n, r = study(spark, sf_dir)
        return multiplied(matrix(spark, sf_dir), deconfounding(method, r, n, edges))

    return query


def factor_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, r = study(spark, sf_dir)
    load, psi = kernels.factors(r, 1)
    return spark.createDataFrame([(f"v{k}", round(abs(float(load[k, 0])), 4), round(float(psi[k]), 4)) for k in range(len(r))], "var string, loading double, uniqueness double")


def steiner_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree that joins all regions' columns over the graph."""
    edges, _, _, r = study(spark, sf_dir)
    weights = {tuple(sorted(e)): 1 - abs(float(r[e])) for e in edges}
    return spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in kernels.steiner(weights, sorted({a for a, _ in edges} - {b for _, b in edges}))], "src string, dst string")


def arborescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, r = study(spark, sf_dir)
    return spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in kernels.arborescence(abs(r))], "src string, dst string")


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    label = kernels.greedy_modularity(edges, 1 + max(v for e in edges for v in e))
    return spark.createDataFrame([(f"v{k}", c) for k, c in enumerate(label)], "name string, cluster int")


def minimax_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, r = study(spark, sf_dir)
    return spark.createDataFrame([(f"v{k}", f"p{proto}") for members, proto in kernels.minimax(1 - abs(r), 0.97) for k in members], "name string, prototype string")


def eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of the correlations in falling order, with their first and second differences and cumulated share."""
    import numpy as np

    _, _, _, r = study(spark, sf_dir)
    v = np.sort(np.linalg.eigvalsh(r))[::-1]
    d1, d2 = [None, *np.diff(v)], [None, None, *np.diff(v, 2)]
    part = np.cumsum(v) / v.sum()
    f = lambda x: None if x is None else round(float(x), 8)
    return spark.createDataFrame([(k + 1, f(v[k]), f(d1[k]), f(d2[k]), f(part[k])) for k in range(len(v))], "k int, value double, d1 double, d2 double, pve double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (fit_ml, fit_two_group, fit_ricf, fit_ggm, bootstrap_se, effects_bootstrap, learn_dag, glasso_precision, bap_decorrelate, factor_loadings, steiner_tree, arborescence, communities, minimax_clusters, eigenvalues)
    return {f.__name__: f for f in plain} | {f"svd_{m}": _spectral(m) for m in ("trim", "lava", "rsvp", "pcss", "pc")} | {f"deconfounded_{m}": _deconfounded(m) for m in ("glasso", "glpc", "trim", "pcss")}


_LINE = f"round(b, 6) AS est, round(se, 6) AS se, round(b / se, 4) AS z, round({two_sided('(b / se)')}, 6) AS pvalue"
_BY_GROUP = "SELECT x, y, r, n FROM (@group_pair) p WHERE grp = {}"
SQL = {
    "fit_ml": f"WITH {catalog.swept_regressions(catalog.PAIR)}, g AS (SELECT j, k, b, sqrt(v / n) AS se FROM reg) SELECT j AS lhs, '~' AS op, k AS rhs, {_LINE} FROM g",
    "fit_two_group": f"WITH one AS (WITH {catalog.swept_regressions(_BY_GROUP.format(1))} SELECT j, k, b, v / n AS v FROM reg), zero AS (WITH {catalog.swept_regressions(_BY_GROUP.format(0))} SELECT j, k, b, v / n AS v FROM reg), g AS (SELECT one.j, one.k, one.b - zero.b AS b, sqrt(one.v + zero.v) AS se FROM one JOIN zero USING (j, k)) SELECT j AS lhs, '~' AS op, k AS rhs, {_LINE} FROM g",
}


def oracle_sql() -> dict[str, str]:
    return {name: catalog.text(sql, duck=True) for name, sql in SQL.items()}
