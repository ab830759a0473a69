"""Graph searches and statistics against brute force, published counts and simulated truth."""

import itertools
import math

import numpy as np
import pytest

from pathloom.operators import kernels, learning
from pathloom.sources.graphs import SIGNAL

NAMES = sorted({v for e in SIGNAL for v in e})
GRAPH = [(NAMES.index(a), NAMES.index(b)) for a, b in SIGNAL]


def test_distances_and_missing_edges_of_the_example_graph():
    d = learning.distances(GRAPH, len(NAMES))
    assert [int((d == k).sum()) for k in (1, 2, 3, 4)] == [18, 11, 6, 1]
    assert len(learning.missing(GRAPH, len(NAMES))) == 37


def test_separation_equals_blocked_walks():
    rng = np.random.default_rng(3)

    def blocked(edges, x, y, given):
        p = 6
        below = np.isfinite(learning.distances(edges, p))
        near = {v: {a for a, b in edges if b == v} | {b for a, b in edges if a == v} for v in range(p)}

        def walk(path):
            if path[-1] == y:
                for a, v, b in zip(path, path[1:], path[2:], strict=False):
                    collider = (a, v) in edges and (b, v) in edges
                    if collider and not any(below[v, g] for g in given) or not collider and v in given:
                        return False
                return True
            return any(walk([*path, v]) for v in near[path[-1]] if v not in path)

        return not walk([x])

    for _ in range(30):
        edges = [e for e in itertools.combinations(range(6), 2) if rng.random() < 0.4]
        given = {int(v) for v in rng.choice(range(1, 5), rng.integers(0, 3), replace=False)}
        assert learning.separated(edges, 6, 0, 5, given) == blocked(edges, 0, 5, given)


def test_separator_and_adjustment():
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (4, 3)]
    assert learning.separator(edges, 5, 1, 2) == (0,)
    assert learning.separator(edges, 5, 0, 3) == (1, 2)
    assert learning.separator(edges, 5, 0, 1) is None
    assert learning.adjustment(edges, 5, 1, 3, "parents") == [0]
    assert learning.adjustment(edges, 5, 1, 3, "optimal") == [2, 4]
    with pytest.raises(ValueError):
        learning.adjustment(edges, 5, 1, 3, "other")


def test_acyclic_drops_the_weakest_edge():
    weight = np.zeros((3, 3))
    weight[0, 1], weight[1, 2], weight[2, 0] = 0.9, 0.1, 0.5
    assert learning.acyclic([(0, 1), (1, 2), (2, 0)], 3, weight) == [(0, 1), (2, 0)]


def test_kendall_and_polychoric():
    rng = np.random.default_rng(1)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 4000)
    codes = np.digitize(z, [-0.7, 0.1, 1.0])
    table = np.zeros((4, 4))
    np.add.at(table, tuple(codes.T), 1)
    assert abs(learning.polychoric(table) - 0.6) < 0.04
    a, b = codes[:300].T
    small = np.zeros((4, 4))
    np.add.at(small, (a, b), 1)
    sa, sb = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    assert math.isclose(learning.kendall(small), (sa * sb).sum() / math.sqrt((sa**2).sum() * (sb**2).sum()), rel_tol=1e-12)
    assert learning.kendall(np.array([[5.0, 0], [0, 0]])) == 0
    for h, k, r in ((0.3, -0.5, 0.7), (1.0, 1.0, -0.4)):
        draw = rng.multivariate_normal([0, 0], [[1, r], [r, 1]], 200_000)
        assert abs(learning.bivariate([h], [k], r)[0, 0] - ((draw[:, 0] < h) & (draw[:, 1] < k)).mean()) < 0.005


def test_adjusted_and_combined():
    p = [0.01, 0.04, 0.03, 0.5]
    assert np.allclose(learning.adjusted(p), [0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert learning.adjusted(p, "bonferroni") == [0.04, 0.16, 0.12, 1.0]
    assert learning.combined(p, np.ones(4), "positive") < 0.01 < 0.9 < learning.combined(p, np.ones(4), "negative")
    # a value that has underflowed is the strongest evidence, in either direction
    assert learning.combined([0.0, 0.5], np.array([-1, 1]), "negative") < 1e-100 < 0.5 < learning.combined([0.0, 0.5], np.array([-1, 1]), "positive")
    # tests that are copies of each other count once
    assert abs(learning.combined([0.02] * 3, np.ones(3), "positive", np.ones((3, 3))) - 0.01) < 0.002


def test_perturbation_of_a_shifted_node():
    rng = np.random.default_rng(5)
    n, edges = 3000, [(0, 1), (1, 2)]
    grp = (rng.random(n) < 0.4).astype(float)
    x = rng.standard_normal((n, 3))
    x[:, 1] += 0.6 * x[:, 0] + 0.5 * grp
    x[:, 2] += 0.6 * x[:, 1]
    parts = {g: (int((grp == g).sum()), x[grp == g].mean(0), np.cov(x[grp == g].T)) for g in (0, 1)}
    m, r = learning.with_group(parts)
    assert m == n and np.allclose(r, np.corrcoef(np.column_stack([grp, x]).T))
    t, p, fit, _ = learning.perturbed(r, n, edges)
    assert p[1] < 1e-10 and p[0] > 0.001 and p[2] > 0.001 and fit["df"] == 1


def test_module_scores_are_of_unit_variance():
    rng = np.random.default_rng(6)
    s = np.corrcoef((rng.standard_normal((500, 1)) + rng.standard_normal((500, 4))).T)
    for kind in ("LV", "CV", "UV"):
        w = learning.module_weights(s, kind, [0])
        assert math.isclose(w @ s @ w, 1, rel_tol=1e-9)
    assert learning.module_weights(s, "UV", []) is None


def test_smooth_residual_sees_a_bend():
    rng = np.random.default_rng(7)
    z = rng.standard_normal(4000)
    y = np.abs(z) + 0.1 * rng.standard_normal(4000)
    y = (y - y.mean()) / y.std()
    f = learning.spline(z)
    f = f - f.mean(0)
    assert learning.smooth_residual(f.T @ f / 4000, f.T @ y / 4000, 1.0, 4000) < 0.1
    assert learning.smooth_residual(f.T @ f / 4000, f.T @ rng.standard_normal(4000) / 4000, 1.0, 4000) > 0.95


def test_not_close_fit_is_high_for_no_correlation():
    p, low, high = learning.not_close(0.0, 500, 1)
    assert p > 0.9 and low < 0 < high
    assert learning.not_close(0.4, 500, 1)[0] < 1e-6
    assert math.isclose(learning.partial(np.array([[1, 0.5, 0.4], [0.5, 1, 0.3], [0.4, 0.3, 1]]), 0, 1, [2]), (0.5 - 0.12) / math.sqrt((1 - 0.16) * (1 - 0.09)), rel_tol=1e-9)
    assert kernels.chi2_survival(*learning.fisher([0.5, 0.5])[:2]) == learning.fisher([0.5, 0.5])[2]
