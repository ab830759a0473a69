"""Walks of a graph that fits one task: a handful of jobs for the whole query, as each costs a fixed time however large the tables are."""

import pytest

from pathloom.operators import graphs
from pathloom.plans import walks

#: Jobs of each query, at most (before walks took one job each: 21, 38, 41, 11 and 21 in the order of all five).
MOST = {"ancestors": 18, "path_nodes_directed": 20, "path_nodes_shortest": 22, "topo_levels": 10, "merged_levels": 16}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("walks")
    spark.sql("SELECT cast(id AS int) AS n_nationkey, 0 AS n_regionkey FROM range(2)").write.parquet(f"{path}/nation.parquet")
    spark.sql("SELECT id AS c_custkey, cast(id % 2 AS int) AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(4)").write.parquet(f"{path}/customer.parquet")
    spark.range(1, 31).selectExpr("id AS s_suppkey", "0 AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(MOST))
def test_jobs_of_a_walk(spark, tables, name):
    spark.sparkContext.setJobGroup(f"jobs-{name}", name)
    try:
        walks.queries()[name](spark, tables).toPandas()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs-{name}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= MOST[name]


def test_repeated_edges_beyond_a_tasks_bound(spark, monkeypatch):
    """Only different edges count: a graph of 20 edges, each 50 times, fits a task of 30, and one of 40 edges goes in rounds."""
    monkeypatch.setattr(graphs, "WALK_EDGES", 30)
    for n, jobs_at_least in ((20, 0), (40, 40)):
        edges = spark.range(50 * n).selectExpr(f"concat('v', id % {n}) src", f"concat('v', id % {n} + 1) dst")
        spark.sparkContext.setJobGroup(f"bound-{n}", "bound")
        found = graphs.levels(edges)[0]
        assert {r["name"]: r["level"] for r in found.collect()} == {f"v{k}": k for k in range(n + 1)}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bound-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs >= jobs_at_least and (jobs_at_least or jobs < 10)
