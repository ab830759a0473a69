"""Queries that fit, weight and resample models of a graph table and a wide data table, and that simulate, assemble and sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, kernels, learning, models, simulate
from ..operators.rows import complete, moments
from ..operators.sem import Study, model_simulated_p
from ..sources import files, storage
from . import catalog
from .fits import edges_of, matrix, study


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored matrix as a wide table: obs, grp and a column for each place of the vectors."""
    rows = complete(matrix(spark, sf_dir))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.where(F.size("x") == width).select("obs", "grp", *[F.col("x")[k].alias(f"v{k}") for k in range(width)])


def graph(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """The columns' graph with a weight for each edge; ``mixed`` joins neighbouring regions both ways."""
    edges = catalog.frame("SELECT DISTINCT src, dst FROM (@dag) e", spark, sf_dir)
    if mixed:
        near = catalog.frame("SELECT concat('v', cast(r_regionkey AS string)) AS src, lead(concat('v', cast(r_regionkey AS string))) OVER (ORDER BY r_regionkey) AS dst FROM (@regions) r", spark, sf_dir).where("dst is not null")
        edges = edges.unionByName(near).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return simulate.path_weights(edges)


def bound(spark: SparkSession, sf_dir: str, mixed: bool = False) -> Study:
    return Study.bind(graph(spark, sf_dir, mixed), wide(spark, sf_dir), "grp", "obs")


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes])


def _run(fit: int, algo: str, part: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if fit == 0:
            one = Study.bind(graph(spark, sf_dir, algo != "cggm"), wide(spark, sf_dir).drop("grp"), None, "obs")
        else:
            one = bound(spark, sf_dir, algo == "ml")
        return rounded(one.run(fit, algo)[part])

    return query


def _weights(method: str):
    return lambda spark, sf_dir: rounded(bound(spark, sf_dir).weighted(method)[0], 6)


def node_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bound(spark, sf_dir).weighted("r2z")[1], 6)


def ricf_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled errors of the mixed model of the regions and nations."""
    some = wide(spark, sf_dir)
    return rounded(Study.bind(graph(spark, sf_dir, True), some.select("obs", "grp", *[c for c in some.columns if c[0] == "v" and int(c[1:]) < 30]), "grp", "obs").bootstrap(200))


def ricf_bootstrap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = wide(spark, sf_dir)
    return rounded(Study.bind(graph(spark, sf_dir, True), some.select("obs", "grp", *[c for c in some.columns if c[0] == "v" and int(c[1:]) < 30]), "grp", "obs").bootstrap(200, True))


def all_fit_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = bound(spark, sf_dir, True)
    return rounded(one._indices(one.indices("ricf")), 6)


def start_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bound(spark, sf_dir, True).starts(0.1), 8)


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bound(spark, sf_dir, True).summary("ricf")
    return spark.createDataFrame([(k, line) for k, line in enumerate(text.split("\n"))], "k int, line string")


def colored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir).colored()[0]


def colored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir).colored()[1]


def monte_carlo_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Shipley model's deviance against simulated independence models of its degrees of freedom."""
    edges, parts, n, r = study(spark, sf_dir)
    nodes = sorted({v for e in edges for v in e if v < 6})
    own = [(nodes.index(a), nodes.index(b)) for a, b in edges if a in nodes and b in nodes]
    r = r[[[a] for a in nodes], nodes]
    found = kernels.fit_indices(r, kernels.ricf(r, own, [])[2], n, len(own) + len(nodes))
    mc, ml = model_simulated_p(spark, found["df"], min(n, 200), found["dev"])
    return spark.createDataFrame([(found["df"], round(found["dev"], 5), round(mc, 5), round(ml, 5))], "df int, deviance double, mc_p double, ml_p double")


def local_separation_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tests and their Bonferroni combination."""
    tests = models.local_tests(spark, moments(matrix(spark, sf_dir)), edges_of(spark, sf_dir))
    return tests.agg(F.count(F.lit(1)).alias("k"), F.round(F.least(F.lit(1.0), F.count(F.lit(1)) * F.min("pvalue")), 6).alias("p"))


def correlated_columns(spark: SparkSession, sf_dir: str, cutoff: float = 0.1) -> DataFrame:
    _, _, _, r = study(spark, sf_dir)
    return spark.createDataFrame([(f"v{k}",) for k in kernels.correlated_columns(r, cutoff)], "var string")


def backfilled(raw: DataFrame, changed: DataFrame) -> DataFrame:
    """(obs, var, value): the changed values, but the raw ones of columns that the change has left without variance."""
    return kept_flat(raw.join(changed.withColumnRenamed("value", "new"), ["obs", "var"])).select("obs", "var", "value")


def kept_flat(both: DataFrame) -> DataFrame:
    """The same of a table that has the changed values beside the raw ones, as ``new``; its rows need no key."""
    flat = both.groupBy("var").agg((F.coalesce(F.var_samp("new"), F.lit(0.0)) == 0).alias("flat"))
    return both.join(flat, "var").withColumn("value", F.when(F.col("flat"), F.col("value")).otherwise(F.col("new"))).drop("new", "flat")


def total(column: str):
    """The sum of doubles, whole parts and fractions apart: whole parts add without error up to 2^53, so the order of rows doesn't show."""
    whole = F.when(F.col(column) < 0, F.ceil(column)).otherwise(F.floor(column)).cast("double")
    big = F.abs(column) >= 2.0**52  # no fraction; infinity and NaN too
    parts = F.when(big, F.col(column)).otherwise(0.0), F.when(big, 0.0).otherwise(whole), F.when(big, 0.0).otherwise(F.col(column) - whole)
    return F.sum(parts[0]) + F.sum(parts[1]) + F.sum(parts[2])


def variance_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values cut to steps of 20; types of which one step is all there is keep theirs."""
    raw = catalog.frame("SELECT event_type AS var, value FROM (@measures) e", spark, sf_dir)
    both = raw.withColumn("new", F.when(F.col("var") == "view", F.lit(1.0)).otherwise(F.floor(F.col("value") / 20).cast("double")))
    return kept_flat(both).groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.round(total("value"), 6).alias("total"))


def simulated_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph(spark, sf_dir), 8)


def simulated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means of simulated data of the columns' graph with small-world confounding."""
    import numpy as np

    edges = edges_of(spark, sf_dir)
    p = 1 + max(v for e in edges for v in e)
    beta = np.zeros((p, p))
    for r in graph(spark, sf_dir).collect():  # the model graph
        beta[int(r["dst"][1:]), int(r["src"][1:])] = r["weight"]
    omega = simulate.covariances(simulate.small_world(edges, p, 2) + simulate.confounding_pairs(spark, edges, p, 30), p, 0.0, 0.3)
    parts = moments(simulate.model_data(spark, beta, omega, 2000))
    return spark.createDataFrame([(f"v{k}", g, round(float(m[k]), 5)) for g, (_, m, _) in parts.items() for k in range(p)], "var string, grp int, mean double")


def simulated_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of the module and of the other columns in each design."""
    out = None
    for k in range(1, 8):
        cells = simulate.module_design(spark, k).select(F.posexplode("x").alias("col", "v"))
        one = cells.groupBy((F.col("col") < 50).alias("module")).agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_samp("v"), 5).alias("sd")).withColumn("design", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def exact_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance of simulated rows, which is that asked for."""
    _, _, _, r = study(spark, sf_dir)
    (_, _, c), = moments(simulate.exact_data(spark, r, 1000).withColumn("grp", F.lit(0))).values()
    return spark.createDataFrame([(f"v{i}", f"v{j}", round(float(c[i, j]), 6), round(float(r[i, j]), 6)) for i in range(len(r)) for j in range(i + 1)], "i string, j string, got double, asked double")


def shifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means after the shift of every third column by 0.5."""
    rows = simulate.shifted_design(complete(matrix(spark, sf_dir)), {k: 1 if k % 2 else -1 for k in range(0, 64, 3)}, 0.5)
    return spark.createDataFrame([(f"v{k}", g, round(float(m[k]), 4)) for g, (_, m, _) in moments(rows).items() for k in range(len(m))], "var string, grp int, mean double")


def whitened_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, p = simulate.distance_shift(matrix(spark, sf_dir))
    return spark.createDataFrame([(round(z, 6), round(p, 6))], "z double, pvalue double")


def experiment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set written as three positional files and read again."""
    path = storage.scratch(spark, "experiment")
    values = catalog.frame("SELECT obs, var, value, grp FROM (@long) l", spark, sf_dir)
    cells = values.groupBy("var").agg(F.array_sort(F.collect_list(F.struct("obs", "value"))).alias("c")).orderBy("var")
    files.write_table(cells.select(F.array_join(F.transform("c", lambda x: x["value"].cast("string")), "\t").alias("line")).coalesce(1), f"{path}/x", "\x01")
    files.write_table(values.select("obs", "grp").distinct().orderBy("obs").select(F.concat(F.lit("s"), F.col("obs").cast("string")).alias("s"), "grp").coalesce(1), f"{path}/c")
    files.write_table(cells.select("var").coalesce(1), f"{path}/r")
    back = files.read_experiment(spark, f"{path}/x", f"{path}/c", f"{path}/r")
    return back.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("grp").alias("n1"), F.round(F.avg("value"), 6).alias("mean"))


def adjacency_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's matrix over all nodes of a larger one."""
    edges = catalog.frame("SELECT src, dst FROM (@signal) e WHERE src LIKE 'r%'", spark, sf_dir)
    names = catalog.frame("SELECT src AS name FROM (@regional) e UNION SELECT dst FROM (@regional) f", spark, sf_dir)
    return graphs.to_adjacency(edges, names)


def pairwise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scatter-plot matrix shows: of the graph's edges the correlation and a deterministic sample of points; of nodes a histogram."""
    edge = catalog.frame("SELECT src, dst, obs, xv, yv FROM (@edge_data) m", spark, sf_dir)
    points = F.slice(F.array_sort(F.collect_list(F.struct(F.md5(F.col("obs").cast("string")).alias("k"), F.round("xv", 6).alias("x"), F.round("yv", 6).alias("y")))), 1, 20)
    return edge.where(F.md5(F.col("obs").cast("string")) < "2").groupBy("src", "dst").agg(points.alias("p"), F.count(F.lit(1)).alias("n")).select("src", "dst", "n", F.transform("p", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"))).cast("string").alias("points"))


PLAIN = (node_weights, ricf_bootstrap, ricf_bootstrap_groups, all_fit_indices, start_values, model_summary, colored_nodes, colored_edges, monte_carlo_fit, local_separation_combined, correlated_columns, variance_backfill, simulated_weights, simulated_groups, simulated_designs, exact_covariance, shifted_rows, whitened_shift, experiment_files, adjacency_cells, pairwise_matrix)

SQL = {
    "variance_backfill": "WITH s AS (SELECT event_type AS var, value, CASE WHEN event_type = 'view' THEN 1.0 ELSE floor(value / 20) END AS v FROM (@measures) x), f AS (SELECT var, var_samp(v) = 0 AS flat FROM s GROUP BY var) SELECT var, count(*) AS n, round(sum(CASE WHEN flat THEN value ELSE v END), 6) AS total FROM s JOIN f USING (var) GROUP BY var",
    "adjacency_cells": "WITH n AS (SELECT src AS name FROM (@regional) e UNION SELECT dst FROM (@regional) f), e AS (SELECT DISTINCT src, dst FROM (@signal) s WHERE src LIKE 'r%') SELECT a.name AS i, b.name AS j, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS v FROM n a CROSS JOIN n b LEFT JOIN e ON e.src = a.name AND e.dst = b.name",
    "experiment_files": "SELECT var AS feature, count(*) AS n, sum(grp) AS n1, round(avg(value), 6) AS mean FROM (@long) l GROUP BY var",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    runs = {f"sem_run{fit}_{algo}": _run(fit, algo, part) for fit, part in ((0, "fit"), (1, "gest"), (2, "dest")) for algo in ("ml", "cggm", "ricf")}
    return {f.__name__: f for f in PLAIN} | runs | {f"graph_weights_{m}": _weights(m) for m in ("r2z", "sem", "cov", "cfa", "lmi")}


def oracle_sql() -> dict[str, str]:
    return {name: catalog.text(sql, duck=True) for name, sql in SQL.items()}
