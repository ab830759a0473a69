"""Whole analyses on Spark against numpy, the other engine and simulated truth."""

import duckdb
import numpy as np
import pytest

from pathloom.operators import learning, models
from pathloom.operators.rows import moments
from pathloom.plans import analyses, fits

SF = "/root/testdata/sf0.001"
CHAIN = [(0, 1), (1, 2)]


@pytest.fixture(scope="module")
def sample(spark):
    beta = np.zeros((3, 3))
    beta[1, 0], beta[2, 1] = 0.8, -0.5
    return models.simulate(spark, beta, 6000, seed=4, shift={2: 1.0}).cache()


@pytest.mark.parametrize("name", sorted(analyses.queries()))
def test_every_query_has_rows(spark, name):
    assert analyses.queries()[name](spark, SF).limit(1).collect() or name.startswith("model_search")


def test_simulated_rows_do_not_depend_on_partitions(spark):
    beta = np.zeros((2, 2))
    one, two = (models.simulate(spark, beta, 50, seed=9).repartition(k).orderBy("obs").collect() for k in (1, 7))
    assert [r["x"] for r in one] == [r["x"] for r in two] and sum(r["grp"] for r in one) == 25


def test_moments_equal_numpy(sample):
    rows = sample.collect()
    for g, (n, mean, cov) in moments(sample).items():
        x = np.array([r["x"] for r in rows if r["grp"] == g])
        assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))


def test_effects_multiply_along_the_chain(spark, sample):
    parts = moments(sample)
    found = {(r["source"], r["sink"]): r for r in models.effects(spark, {0: parts[0]}, CHAIN).collect()}
    x = np.array([r["x"] for r in sample.where("grp = 0").collect()])
    sd = x.std(0, ddof=1)
    assert set(found) == {("v0", "v1"), ("v1", "v2"), ("v0", "v2")}
    assert abs(found["v0", "v2"]["est"] * sd[2] / sd[0] + 0.4) < 0.06
    assert found["v0", "v2"]["path_l"] == 2 and found["v0", "v2"]["pvalue"] < 1e-6


def test_the_shifted_node_is_found(spark, sample):
    parts = moments(sample)
    tests, fit, act, inh = models.node_tests(parts, CHAIN)
    assert tests[2][2] < 1e-10 < 0.001 < tests[0][2] and act < 0.001 < inh
    tasks = spark.createDataFrame([("a", [(0, 1, 1.0), (1, 2, 1.0)]), ("b", [(0, 1, -1.0)])], "pathway string, edges array<struct<src: int, dst: int, weight: double>>")
    rows = {r["pathway"]: r for r in models.gene_sets(tasks, parts).collect()}
    assert rows["a"]["pert"] == "up act" and rows["a"]["no_degs"] == 1 and rows["b"]["pert"].endswith("inh")


def test_missing_edge_is_separated(spark, sample):
    parts = {0: moments(sample)[0]}
    (one,) = models.local_tests(spark, parts, CHAIN).collect()
    assert (one["x"], one["y"], one["z"]) == ("v0", "v2", "v1") and abs(one["estimate"]) < 0.05 and one["pvalue"] > 0.3


def test_search_keeps_old_edges_and_asks_the_network():
    r = np.array([[1, 0.6, 0.5], [0.6, 1, 0.3], [0.5, 0.3, 1]])
    parts = {0: (1000, np.zeros(3), r)}
    old = [(0, 1)]
    by = {kind: models.search(parts, old, [(0, 2)], 3, kind=kind) for kind in ("basic", "direct")}
    assert {e[:2] for e in by["direct"]} <= {e[:2] for e in by["basic"]}
    assert all(how == "old" or (a, b) == (0, 2) for a, b, how in by["direct"])


def test_causal_order_of_skewed_noise(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 4000
    e = rng.laplace(size=(n, 8))
    place = [5, 2, 7, 0, 1, 3, 4, 6]
    x = np.zeros((n, 8))
    for k, v in enumerate(place):
        x[:, v] = e[:, v] + (0.9 * x[:, place[k - 1]] if k else 0)
    path = tmp_path / "embeddings.parquet"
    spark.createDataFrame([(i, row.tolist(), int(i % 10)) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(path))
    assert [r["var"] for r in sorted(analyses.causal_order(spark, str(tmp_path)).collect())] == [f"v{v}" for v in place]


def test_permutation_agrees_with_the_closed_form(spark):
    edges, parts, *_ = fits.study(spark, SF)
    t = {k: x for k, x, _ in models.node_tests(parts, edges)[0]}
    got = {row["node"]: row["stat"] for row in analyses.node_permutation(spark, SF, 300).collect()}
    assert np.corrcoef([got[f"v{k}"] for k in t], list(t.values()))[0, 1] > 0.98


def test_stream_equals_the_whole_table(spark):
    got = sorted(tuple(r) for r in analyses.streamed_event_moments(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert got == sorted(con.execute(analyses.STREAM_SQL).fetchall())
