"""Queries over graphs whose walks have thousands of steps: few jobs, and the rows that the graph's form gives."""

import pytest

from pathloom.plans import walks

#: Suppliers of the one nation that has any; each leads to the next.
N = 1200

WANT = {
    "acyclic_check": lambda rows: dict(zip(rows["graph"], rows["n_cyclic"], strict=True)) == {"signal": 0, "mixed": N + 2},  # F1
    "ancestors": lambda rows: len(rows) == N + 4 and {"r0", "n0", "n1", "BUILDING", "s1"} <= set(rows["name"]),  # F2
    "path_nodes_directed": lambda rows: set(rows["name"]) == {"r0", "n0", *(f"s{k}" for k in range(1, N + 1))},  # F4
    "path_nodes_shortest": lambda rows: set(rows["name"]) == {"r0", "n0", f"s{N}"},  # F5
    "topo_levels": lambda rows: dict(zip(rows["name"], rows["level"], strict=True)) == {"r0": 0, "BUILDING": 0, "n0": 1, "n1": 1} | {f"s{k}": k + 1 for k in range(1, N + 1)},  # F6
    "merged_levels": lambda rows: dict(zip(rows["name"], rows["level"], strict=True)) == {"r0": N + 1, "BUILDING": N + 1, "n0": N, "n1": 0} | {f"s{k}": N - k for k in range(1, N + 1)},  # F7
}


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("deep")
    spark.sql("SELECT cast(id AS int) AS n_nationkey, 0 AS n_regionkey FROM range(2)").write.parquet(f"{path}/nation.parquet")
    spark.sql("SELECT id AS c_custkey, cast(id % 2 AS int) AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(4)").write.parquet(f"{path}/customer.parquet")
    spark.range(1, N + 1).selectExpr("id AS s_suppkey", "0 AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(WANT))
def test_deep_graph(spark, deep, name):
    spark.sparkContext.setJobGroup(name, name)
    try:
        rows = walks.queries()[name](spark, deep).toPandas()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert WANT[name](rows)
    assert jobs < 100  # a job for each step would be more than 1200
