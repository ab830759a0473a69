"""Whole analyses as queries: gene sets, effects, separation, modules, searches, orders, ordinal tables and streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import communities, kernels, learning, models
from ..operators.rows import added, complete, moments
from ..sources import storage
from ..streaming.moments import event_moments
from . import catalog
from .fits import edges_of, matrix, study



def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pathway and edges: of each region the part of the columns' graph that its nations span."""
    own = "SELECT n_regionkey AS k, n_regionkey AS a, 5 + n_nationkey AS b FROM (@nations) x UNION ALL SELECT n_regionkey, 5 + n_nationkey, 30 + n_nationkey FROM (@nations) y UNION ALL SELECT n_regionkey, 5 + n_nationkey, 55 + n_nationkey % 9 FROM (@nations) z"
    return catalog.frame(f"SELECT concat('m', cast(k AS string)) AS pathway, array_sort(collect_list(struct(cast(a AS int) AS src, cast(b AS int) AS dst))) AS edges FROM ({own}) e GROUP BY k", spark, sf_dir)


def _parts(spark: SparkSession, sf_dir: str) -> dict:
    return moments(matrix(spark, sf_dir))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes])


def gene_set_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = modules(spark, sf_dir)
    found = models.gene_sets(sets, _parts(spark, sf_dir))
    return _rounded(found.withColumn("adjp", F.least(F.lit(1.0), F.col("pval") * sets.count())))


def differential_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.differential_edges(modules(spark, sf_dir), _parts(spark, sf_dir)))


def _effects(pairs: str, kind: str, by_group: bool = False):
    return lambda spark, sf_dir: _rounded(models.effects(spark, _parts(spark, sf_dir), edges_of(spark, sf_dir), pairs, kind, by_group))


def separation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.separation_tests(spark, _parts(spark, sf_dir), edges_of(spark, sf_dir)))


def local_separation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.local_tests(spark, _parts(spark, sf_dir), edges_of(spark, sf_dir)))


def path_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.find_paths(spark, _parts(spark, sf_dir), edges_of(spark, sf_dir)))


def module_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.fit_modules(modules(spark, sf_dir), _parts(spark, sf_dir)))


def _scores(kind: str):
    return lambda spark, sf_dir: _rounded(models.score_modules(modules(spark, sf_dir), _parts(spark, sf_dir), kind), 5)


def _search(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, parts, _, r = study(spark, sf_dir)
        network = edges + [(a, b) for a, b in zip(range(30, 55), range(31, 56), strict=True) if b < len(r)]
        found = models.search(parts, edges, network, len(r), kind=kind, beta=0.02)
        return spark.createDataFrame([(f"v{a}", f"v{b}", how) for a, b, how in found], "src string, dst string, kind string")

    return query


def node_permutation(spark: SparkSession, sf_dir: str, reps: int = 1000) -> DataFrame:
    """The shift of each node's own residual between the groups, against those under random groups.

    A residual is what the model's parents leave of a node, a linear map of the row. A row draws its group in each replicate
    from a hash of its id, so that one pass adds up all replicates.
    """
    import numpy as np

    rows = matrix(spark, sf_dir)
    edges, parts, n, r = study(spark, sf_dir)
    width = len(r)
    if len(parts) < 2:
        return spark.createDataFrame([], "node string, stat double, pvalue double")
    share = parts[1][0] / n
    mean = sum(k * m for k, m, _ in parts.values()) / n
    sd = np.sqrt(np.diag(sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values()) / (n - 1)))
    own = np.eye(width)
    for j, k, b, _ in kernels.dag_ols(r, dict(enumerate(learning.parents(edges, width))), n):
        own[j, k] = -b
    own = own / sd

    def contribute(x, obs):
        key = obs.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(reps, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        drawn = ((key ^ (key >> np.uint64(32))) >> np.uint64(11)) / float(1 << 53) < share
        return np.concatenate([drawn.sum(0), (drawn.T.astype(float) @ ((x - mean) @ own.T)).ravel()])

    flat = added(rows, reps * (1 + width), contribute)
    k, sums = flat[:reps, None], flat[reps:].reshape(reps, width)
    null = sums / k + sums / (n - k)  # residuals add up to 0 over all rows
    stat = (parts[1][1] - parts[0][1]) @ own.T
    z = (stat - null.mean(0)) / null.std(0, ddof=1)
    return spark.createDataFrame([(f"v{i}", round(float(z[i]), 6), round(2 * kernels.normal_survival(abs(z[i])), 6)) for i in range(width)], "node string, stat double, pvalue double")


def additive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every ordered pair by a penalised spline of the child on the parent, and whether the best branching has it.

    One pass over the rows: the cross products of the splines of all columns. A parent's spline is solved once for all children.
    """
    import numpy as np

    rows, parts = matrix(spark, sf_dir), _parts(spark, sf_dir)
    n = sum(k for k, *_ in parts.values())
    mean = sum(k * m for k, m, _ in parts.values()) / n
    sd = np.sqrt(np.diag(sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values()) / n))
    width, each = len(mean), 3 + len(learning.KNOTS)
    size = 1 + width * each

    def contribute(x, obs):
        f = np.column_stack([np.ones(len(x)), learning.spline((x - mean) / sd).reshape(len(x), -1)])
        return (f.T @ f[:, [0, *range(1, size, each)]]).ravel()  # against the columns themselves

    def within(x, obs):
        f = learning.spline((x - mean) / sd)
        return np.einsum("nia,nib->iab", f, f).ravel()

    cross = added(rows, size * (1 + width), contribute).reshape(size, 1 + width) / n
    own = added(rows, width * each * each, within).reshape(width, each, each) / n
    means = cross[1:, 0].reshape(width, each)
    rest = np.ones((width, width))
    for a in range(width):
        gram = own[a] - np.outer(means[a], means[a])
        xy = cross[1 + a * each : 1 + (a + 1) * each, 1:] - np.outer(means[a], cross[0, 1:])
        for b in set(range(width)) - {a}:
            rest[a, b] = learning.smooth_residual(gram, xy[:, b], 1.0, n)
    score = -np.log(np.maximum(rest, 1e-12))
    tree = set(kernels.arborescence(score))
    return spark.createDataFrame([(f"v{a}", f"v{b}", round(float(score[a, b]), 6), (a, b) in tree) for a in range(width) for b in range(width) if a != b], "src string, dst string, weight double, in_tree boolean")


def ordered(spark: SparkSession, sf_dir: str) -> tuple[list[int], int, object]:
    """Columns from cause to effect by entropies of mutual residuals; one pass over the rows for each place.

    The columns left over are linear in the original ones, so a pass is given the matrix that makes them.
    """
    import numpy as np

    rows, parts = matrix(spark, sf_dir), _parts(spark, sf_dir)
    n = sum(k for k, *_ in parts.values())
    mean = sum(k * m for k, m, _ in parts.values()) / n
    cov = sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values()) / n
    left, make, order = list(range(len(mean))), np.eye(len(mean)), []
    rows = storage.cut(complete(rows))

    def entropy(log_cosh, gauss):  # maximum-entropy approximation; constants of the standard normal
        return 0.5 * (1 + math.log(2 * math.pi)) - 79.047 * (log_cosh - 0.37457) ** 2 - 7.4129 * gauss**2

    while len(left) > 1:
        p = len(left)
        s = make.T @ cov @ make
        sd = np.sqrt(np.diag(s))
        unit, r = make / sd, s / np.outer(sd, sd)

        def contribute(x, obs, unit=unit, r=r, p=p):
            z = (x - mean) @ unit
            u = (z[:, :, None] - r[None] * z[:, None, :]) / np.sqrt(np.maximum(1 - r**2, 1e-12))[None]  # i given j
            u[:, range(p), range(p)] = z
            size = np.abs(u)
            return np.concatenate([(size + np.log1p(np.exp(-2 * size)) - math.log(2)).sum(0).ravel(), (u * np.exp(-(u**2) / 2)).sum(0).ravel()])

        a, b = added(rows, 2 * p * p, contribute).reshape(2, p, p) / n
        h = entropy(a, b)
        own = np.diag(h)
        ratio = (own[None, :] + h) - (own[:, None] + h.T)  # positive where i causes j: h(j) + h(i|j) - h(i) - h(j|i)
        np.fill_diagonal(ratio, 0)
        first = int((np.minimum(ratio, 0) ** 2).sum(1).argmin())
        order.append(left[first])
        make = np.delete(make - np.outer(make[:, first], s[first] / s[first, first]), first, 1)
        left.pop(first)
    sd = np.sqrt(np.diag(cov))
    return order + left, n, cov / np.outer(sd, sd)


def causal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns from cause to effect, and the lasso parents of each among those before it.

    As in the published search, the second place never gets a parent.
    """
    import numpy as np

    order, n, r = ordered(spark, sf_dir)
    lam, rows = math.sqrt(math.log(max(len(order), 2)) / n), []
    for k, v in enumerate(order):
        up = order[:k] if k > 1 else []
        b = kernels.lasso(r[np.ix_(up, up)], r[up, v], lam) if up else []
        rows.append((k + 1, f"v{v}", sorted(f"v{u}" for u, x in zip(up, b, strict=True) if abs(x) > 0.05)))
    return spark.createDataFrame(rows, "place int, var string, parents array<string>")


def latent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = models.correlation(_parts(spark, sf_dir))
    return spark.createDataFrame([(m, learning.latent_count(r, m, n)) for m in ("knee", "ed", "ic", "auto")], "method string, n int")


def _ordinal(measure: Callable, levels: int, name: str):
    """Pairs of columns, each cut into equal-width codes; a pair's task gets its table of counts only."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        import numpy as np
        import pandas as pd

        rows = complete(matrix(spark, sf_dir))
        width = rows.agg(F.max(F.size("x"))).first()[0]
        if not width:
            return spark.createDataFrame([], f"x string, y string, {name} double")
        rows = rows.where(F.size("x") == width)
        at = F.posexplode("x").alias("k", "v")
        ends = sorted((r["k"], r["lo"], r["hi"]) for r in rows.select(at).groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        low, scale = (F.array(*[F.lit(x) for x in xs]) for xs in zip(*((lo, levels / ((hi - lo) or 1.0)) for _, lo, hi in ends), strict=True))
        codes = F.transform(F.arrays_zip(F.col("x"), low.alias("lo"), scale.alias("s")), lambda t: F.least(F.lit(levels - 1), F.floor((t["x"] - t["lo"]) * t["s"]).cast("int")))
        coded = rows.select(codes.alias("c")).select(F.posexplode("c").alias("a", "i"), "c")
        counted = coded.select("a", "i", F.posexplode(F.expr("slice(c, a + 2, size(c))")).alias("k", "j")).select("a", (F.col("a") + 1 + F.col("k")).alias("b"), "i", "j").groupBy("a", "b", "i", "j").count()

        def run(key, frame):
            table = np.zeros((levels, levels))
            table[frame["i"], frame["j"]] = frame["count"]
            return pd.DataFrame([(f"v{key[0]}", f"v{key[1]}", round(measure(table), 5))], columns=["x", "y", name])

        return counted.groupBy("a", "b").applyInPandas(run, f"x string, y string, {name} double")

    return query


def simulated_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a simulated model (0.5 along every edge of the graph), as estimated from 5000 rows."""
    import numpy as np

    edges = edges_of(spark, sf_dir)
    width = 1 + max(v for e in edges for v in e)
    beta = np.zeros((width, width))
    for a, b in edges:
        beta[b, a] = 0.5
    n, r = models.correlation(moments(models.simulate(spark, beta, 5000, shift={0: 0.5})))
    rows = kernels.dag_ols(r, {j: up for j, up in enumerate(learning.parents(edges, width))}, n)
    return spark.createDataFrame([(f"v{j}", "~", f"v{k}", round(b, 5), round(se, 5)) for j, k, b, se in rows], "lhs string, op string, rhs string, est double, se double")


def streamed_event_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_moments(spark, f"{sf_dir}/events.parquet", storage.scratch(spark, "stream"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[list, int]:
    edges = edges_of(spark, sf_dir)
    return edges, 1 + max(v for e in edges for v in e)


def _communities(find: Callable):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(f"v{k}", c) for k, c in enumerate(find(communities.adjacency(*_graph(spark, sf_dir))))], "name string, cluster int")

    return query


def communities_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _, r = study(spark, sf_dir)
    weights = {tuple(sorted(e)): 1 - abs(float(r[e])) for e in edges}
    return spark.createDataFrame([(f"v{k}", c) for k, c in enumerate(communities.by_tree(weights, len(r)))], "name string, cluster int")


def centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness, and visits of a walk that restarts at the root."""
    a = communities.adjacency(*_graph(spark, sf_dir))
    node, walk = communities.betweenness(a)[0], communities.restart_walk(a, [0])
    return spark.createDataFrame([(f"v{k}", round(float(node[k]), 6), round(float(walk[k]), 6)) for k in range(len(a))], "name string, betweenness double, visits double")


def over_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules in which columns that differ between the groups (p below 0.05) are over-represented."""
    n, r = learning.with_group(_parts(spark, sf_dir))
    hit = {k for k, c in enumerate(r[0, 1:]) if 2 * kernels.student_survival(abs(c) * math.sqrt((n - 2) / (1 - c * c)), n - 2) < 0.05}
    rows = []
    for row in modules(spark, sf_dir).collect():  # one row for each pathway
        nodes = {v for e in row["edges"] for v in (e["src"], e["dst"])}
        rows.append((row["pathway"], len(nodes & hit), round(communities.over_representation(len(nodes & hit), len(nodes), len(hit), len(r) - 1), 6)))
    return spark.createDataFrame(rows, "pathway string, hits int, pvalue double")


STREAM_SQL = """
SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance
FROM events GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (gene_set_analysis, differential_edges, separation_tests, local_separation_tests, path_finder, module_fits, node_permutation, additive_scores, causal_order, latent_counts, simulated_fit, streamed_event_moments, communities_tree, centralities, over_representation)
    return (
        {f.__name__: f for f in plain}
        | {"effects_all": _effects("all", "optimal"), "effects_direct": _effects("direct", "parents"), "effects_source2sink": _effects("source2sink", "parents"), "effects_group": _effects("all", "parents", True)}
        | {f"module_score_{k.lower()}": _scores(k) for k in ("LV", "CV", "UV")}
        | {f"model_search_{k}": _search(k) for k in ("basic", "direct", "inner", "outer")}
        | {f"communities_{k}": _communities(find) for k, find in communities.METHODS.items()}
        | {"kendall_codes": _ordinal(learning.kendall, 64, "tau"), "polychoric_codes": _ordinal(learning.polychoric, 4, "rho")}
    )


def oracle_sql() -> dict[str, str]:
    return {"streamed_event_moments": STREAM_SQL}
