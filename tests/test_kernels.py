import itertools
import math

import numpy as np
import pytest

from pathloom.operators import kernels as k
from pathloom.plans import fits

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s():
    x = np.random.default_rng(1).normal(size=(300, 6))
    x[:, 2] += 0.7 * x[:, 0]
    x[:, 4] += 0.6 * x[:, 2] - 0.4 * x[:, 1]
    return np.corrcoef(x.T)


def test_ricf_of_a_dag_is_least_squares(s):
    edges = [(0, 2), (1, 4), (2, 4), (3, 5)]
    beta, _, sigma, steps = k.ricf(s, edges, [])
    for j, p, b, _ in k.dag_ols(s, {j: [a for a, c in edges if c == j] for j in range(6)}, 300):
        assert beta[j, p] == pytest.approx(b)
    assert steps == 2 and k.positive(sigma)


def test_ricf_with_a_covariance_reaches_it(s):
    _, _, sigma, _ = k.ricf(s, [(0, 2)], [(1, 4), (3, 5)])
    assert sigma[1, 4] == pytest.approx(s[1, 4], abs=1e-4) and sigma[3, 5] == pytest.approx(s[3, 5], abs=1e-4)


def test_saturated_model_has_no_deviance(s):
    edges = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    _, _, sigma, _ = k.ricf(s, edges, [])
    found = k.fit_indices(s, sigma, 300, len(edges) + 6)
    assert found["df"] == 0 and abs(found["dev"]) < 1e-8 and found["srmr"] < 1e-10


def test_root_inverts(s):
    root = k.power(s, -0.5)
    assert np.allclose(root @ s @ root, np.eye(6))


def test_covariance_graph(s):
    edges = [(0, 2), (2, 4), (1, 4)]
    w = k.covariance_graph(s, edges)
    inv = np.linalg.inv(w)
    on = {frozenset(e) for e in edges}
    for i, j in itertools.combinations(range(6), 2):
        assert (w[i, j] == pytest.approx(s[i, j], abs=1e-4)) if frozenset((i, j)) in on else abs(inv[i, j]) < 1e-4


def test_lasso_meets_its_conditions(s):
    b = k.lasso(s[:5, :5], s[:5, 5], 0.05)
    grad = s[:5, 5] - s[:5, :5] @ b
    assert all(abs(g) <= 0.05 + 1e-6 if x == 0 else g == pytest.approx(0.05 * math.copysign(1, x), abs=1e-6) for g, x in zip(grad, b, strict=True))


def test_glasso_without_penalty_is_the_inverse(s):
    assert np.allclose(k.glasso(s, 0.0)[1], np.linalg.inv(s), atol=1e-4)


@pytest.mark.parametrize("seed", range(6))
def test_arborescence_is_the_best(seed):
    w = np.random.default_rng(seed).integers(1, 30, (4, 4)).astype(float)

    def spans(edges, root):
        seen = {root}
        for _ in range(4):
            seen |= {j for i, j in edges if i in seen}
        return len(seen) == 4

    best = max(sum(w[i, j] for i, j in edges) for root in range(4) for choice in itertools.product(range(4), repeat=3) if spans(edges := [(i, j) for i, j in zip(choice, [v for v in range(4) if v != root], strict=True) if i != j], root) and len(edges) == 3)
    assert sum(w[i, j] for i, j in k.arborescence(w)) == best


def test_tail_functions():
    assert k.chi2_survival(15.507, 8) == pytest.approx(0.05, abs=1e-4)
    assert k.chi2_survival(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert 1 - k.normal_survival(1.96) == pytest.approx(0.9750021048517796)


def test_steiner_prunes():
    weights = {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0, (0, 3): 2.5, (3, 4): 1.0, (1, 5): 0.1}
    assert k.steiner(weights, [0, 3]) == [(0, 3)]
    assert k.steiner(weights, [0, 2, 3]) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("name", list(fits.queries()))
def test_fit_queries_run(spark, name):
    assert fits.queries()[name](spark, DATA).count() >= 1


def test_moments_agree_with_numpy(spark):
    rows = fits.matrix(spark, DATA).collect()
    x = np.array([r["x"] for r in rows])
    n, r = fits.pooled(fits.moments(fits.matrix(spark, DATA)))
    assert n == len(x) and np.allclose(r, np.corrcoef(x.T))
