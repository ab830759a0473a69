"""Models of graph and data tables against closed forms, simulated truth and each other."""

import math

import numpy as np
import pytest

from pathloom.functions.scalars import student
from pathloom.operators import kernels, learning, sem, simulate
from pathloom.operators.rows import complete, moments
from pathloom.operators.sem import Study


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 1500
    h = rng.normal(size=n)
    grp = (np.arange(n) % 2).astype(int)
    a = rng.normal(size=n)
    b = 0.6 * a + rng.normal(size=n) + 0.8 * h + 0.9 * grp
    c = (0.2 + 0.5 * grp) * b + rng.normal(size=n)
    d = 0.4 * c + rng.normal(size=n) + 0.8 * h
    rows = [(int(i), int(g), *map(float, v)) for i, (g, *v) in enumerate(zip(grp, a, b, c, d, rng.normal(size=n), strict=True))]
    return spark.createDataFrame(rows, "id long, g int, a double, b double, c double, d double, other double").repartition(4)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b", 0.5), ("b", "c", -0.2), ("c", "d", 1.0), ("b", "d", 0.4), ("d", "b", 0.6), ("a", "zz", 1.0)], "src string, dst string, weight double")


@pytest.fixture(scope="module")
def study(data, edges):
    return Study.bind(edges, data, "g", "id")


def test_names_are_the_columns_that_the_graph_has(study):
    assert study.names == ["a", "b", "c", "d"] and study.directed == [(0, 1), (1, 2), (2, 3)] and study.both == [(1, 3)]
    starts = {tuple(r)[:3]: r["start"] for r in study.starts(0.1).collect()}
    assert starts["b", "~", "a"] == pytest.approx(0.05) and starts["d", "~~", "b"] == pytest.approx(0.05)


def test_errors_of_a_recursive_model_are_those_of_regressions(study):
    n, r = study.pooled()
    rows, *_ = study._fitted(r, n, "ml", study.directed, [])
    want = {(j, k): (b, se) for j, k, b, se in kernels.dag_ols(r, study.parents, n)}
    for i, op, j, b, se in rows:
        if op == "~":
            assert b == pytest.approx(want[i, j][0], abs=1e-6) and se == pytest.approx(want[i, j][1], rel=1e-5)


def test_the_three_fits(spark, study, data, edges):
    plain = Study.bind(edges, data.drop("g"), None, "id").run()
    table = {(x["lhs"], x["op"], x["rhs"]): x for x in plain["fit"].collect()}
    assert table["d", "~~", "b"]["pvalue"] < 1e-6 and set(plain) == {"fit", "indices"}
    found = plain["indices"].first()
    assert found["df"] == 4 * 5 // 2 - (3 + 1 + 4) and 0 <= found["srmr"] < 0.2 and found["cfi"] <= 1.0000001 and 0 <= found["p_rmsea"] <= 1
    for algo in ("ml", "ricf", "cggm"):
        one = study.run(algo=algo)
        gest = {x["lhs"]: x["pvalue"] for x in one["gest"].collect()}
        assert gest["b"] < 1e-6 < 0.001 < gest["a"] and list(gest) == ["a", "b", "c", "d"]
        two = study.run(2, algo)
        dest = {(x["lhs"], x["rhs"]): x for x in two["dest"].collect()}
        assert dest["c", "b"]["pvalue"] < 1e-6 and dest["b", "a"]["pvalue"] > 1e-4
        assert {x["grp"] for x in two["fit"].collect()} == {0, 1}
    with pytest.raises(ValueError):
        study.run(3)
    text = study.summary("ricf")
    assert "Regressions:" in text and "Covariances:" in text and "Variances:" in text
    nodes, colored = study.colored()
    assert {x["name"]: x["color"] for x in nodes.collect()}["b"] == "pink" and {x["color"] for x in colored.collect()} <= {"gray", "red2", "royalblue3"}


def test_resampled_errors_are_near_the_expected_ones(study):
    drawn = {x[:3]: x[4] for x in map(tuple, study.bootstrap(300).collect())}
    n, r = study.pooled()
    want = {x[:3]: x[4] for x in study.estimates("ricf")}
    assert all(se == pytest.approx(want[k], rel=0.35) for k, se in drawn.items())
    diff = {x[:3]: x for x in map(tuple, study.bootstrap(100, True).collect())}
    assert diff["c", "~", "b"][6] < 0.001


def test_weights_of_edges_and_nodes(study, data):
    for method, want in (("r2z", None), ("lmi", None), ("sem", 1), ("cov", None), ("cfa", 1)):
        edge, node = study.weighted(method)
        rows = {(r["src"], r["dst"]): r for r in edge.collect()}
        assert len(rows) == 5 and all(0 < r["pv"] < 1 and r["zsign"] in (-1, 0, 1) for r in rows.values())
        assert want is None or rows["a", "b"]["zsign"] == want
    assert {r["name"]: r["zsign"] for r in node.collect()}["b"] == 1
    x = np.array([(r["b"], r["c"], r["g"]) for r in data.collect()])
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0, ddof=1)
    g = x[:, 2]
    design = np.column_stack([np.ones(len(g)), z[:, 0], g, z[:, 0] * g])
    beta, rss, *_ = np.linalg.lstsq(design, z[:, 1], rcond=None)
    t = beta[3] / math.sqrt(rss[0] / (len(g) - 4) * np.linalg.inv(design.T @ design)[3, 3])
    assert sem.edge_z(study._scaled(1, 2), "lmi", 1, 1, True) == pytest.approx(t, rel=1e-6)
    # the factor's shift is that of the half sum
    half = z.mean(axis=1)
    gap = half[g == 1].mean() - half[g == 0].mean()
    rest = (half[g == 1].var() * (g == 1).sum() + half[g == 0].var() * (g == 0).sum()) / len(g)
    assert sem.edge_z(study._scaled(1, 2), "cfa", 1, 1, True) == pytest.approx(gap / math.sqrt(rest * (1 / (g == 1).sum() + 1 / (g == 0).sum())), rel=1e-6)


def test_missing_and_short_rows_do_not_count(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [3.0, 5.0], 0), (3, [None, 1.0], 0), (4, [1.0], 0), (5, None, 0), (6, [float("nan"), 1.0], 0), (7, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "obs long, x array<double>, grp int").repartition(4)
    parts = moments(df)
    x = np.array([r[1] for r in rows[:3]])
    assert parts[0][0] == 3 and np.allclose(parts[0][1], x.mean(0)) and np.allclose(parts[0][2], np.cov(x.T)) and parts[1][0] == 1 and not parts[1][2].any()
    far = spark.createDataFrame([(k, [1e9 + v, v * 2.0], 0) for k, v in enumerate([0.5, 1.5, 2.25, 4.0] * 5)], "obs long, x array<double>, grp int").repartition(5)
    want = np.cov(np.array([r["x"] for r in far.collect()]).T)
    assert np.allclose(moments(far)[0][2], want, rtol=1e-6)
    assert complete(df).count() == 5


def test_a_singular_matrix_is_shrunk(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.normal(size=6))) for k in range(5)]
    data = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{k} double" for k in range(6)))
    edges = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(5)], "src string, dst string")
    n, r = Study.bind(edges, data, None, "id").pooled()
    assert n == 5 and kernels.positive(r) and np.allclose(np.diag(r), 1)


def test_simulated_deviances(spark):
    mc, ml = sem.model_simulated_p(spark, 10, 500, 10.0, 2000)
    assert abs(mc - ml) < 0.05 and ml == pytest.approx(kernels.chi2_survival(10.0, 10))


def test_generators(spark):
    edges = [(0, 1), (1, 2)]
    assert not {frozenset(e) for e in simulate.small_world(edges, 12, 2)} & {frozenset(e) for e in edges}
    assert simulate.confounding_pairs(spark, edges, 6, 50) == simulate.confounding_pairs(spark, edges, 6, 50)
    w = simulate.path_weights(spark.createDataFrame([(f"a{k}", "b") for k in range(300)], "src string, dst string")).collect()
    assert all(0.1 <= abs(r["weight"]) <= 1 for r in w) and 0.3 < np.mean([r["weight"] > 0 for r in w]) < 0.7
    s = np.array([[2.0, 0.6, 0.1], [0.6, 1.0, -0.2], [0.1, -0.2, 1.5]])
    x = np.array([r["x"] for r in simulate.exact_data(spark, s, 60).collect()])
    assert np.allclose(np.cov(x.T), s, atol=1e-4)
    two = np.array([r["x"] for r in simulate.module_design(spark, 5, 3.0, 40, 60, 20).collect()])
    assert two[:, :10].mean() > 2 and two[:, 10:20].mean() < -2 and abs(two[:, 20:].mean()) < 0.3
    assert len(simulate.module_design(spark, 6, 1.0, 5, 60, 20).first()["x"]) == 60
    rows = simulate.model_data(spark, np.array([[0, 0], [0.8, 0.0]]), np.eye(2), 2000)
    _, r = learning.with_group(moments(rows))
    assert abs(r[1, 2]) > 0.4
    assert simulate.distance_shift(simulate.shifted_design(rows, {0: 1, 1: 1}, 1.0))[1] < 1e-6


def test_student_and_noncentral(spark):
    for t, df in ((0.3, 25), (2.1, 30), (3.5, 498), (-1.2, 60)):
        exact = 2 * kernels.student_survival(abs(t), df)
        assert spark.sql(f"SELECT {student(f'({t}D)', f'({df}D)')} AS p".replace("0.5)", "0.5D)")).first()[0] == pytest.approx(exact, abs=2e-5)
    assert kernels.student_survival(1.0, 1) == pytest.approx(0.25)
    assert kernels.noncentral_survival(3.0, 4, 0.0) == pytest.approx(kernels.chi2_survival(3.0, 4))
    z, delta = math.sqrt(5.0), math.sqrt(2.0)
    assert kernels.noncentral_survival(5.0, 1, 2.0) == pytest.approx(kernels.normal_survival(z - delta) + kernels.normal_survival(z + delta), abs=1e-8)


def test_columns_that_repeat_others_go():
    r = np.array([[1, 0.995, 0.1], [0.995, 1, 0.3], [0.1, 0.3, 1]])
    assert kernels.correlated_columns(r) == [1] and kernels.correlated_columns(np.eye(3)) == []


def test_hidden_components_of_the_graph():
    rng = np.random.default_rng(2)
    h = rng.normal(size=2000)
    x = rng.normal(size=(2000, 8)) + 1.5 * h[:, None]
    r = np.corrcoef(x.T)
    ring = kernels.laplacian_components(r, [(k, k + 1) for k in range(7)], 2)
    assert ring.shape == (8, 2) and np.allclose(ring.T @ ring, np.eye(2)) and abs(ring.sum(axis=0)).max() < 0.9  # the constant vector costs
    w = kernels.laplacian_components(r, [], 1)
    assert abs(np.corrcoef(((x - x.mean(0)) / x.std(0)) @ w[:, 0], h)[0, 1]) > 0.8
    r = np.corrcoef((rng.normal(size=(2000, 40)) + 1.5 * h[:, None]).T)
    assert all(learning.latent_count(r, m, 2000) == 1 for m in ("auto", "ic", "ed", "knee"))
