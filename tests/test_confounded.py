"""Confounded pairs are those that their parents do not explain."""

import numpy as np

from pathloom.plans import fits


EDGES = [(0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (1, 7)]


def implied(extra=None):
    """Correlations of the DAG with paths of 0.6, with a covariance between the disturbances of ``extra``."""
    b, psi = np.zeros((8, 8)), np.eye(8)
    for s, t in EDGES:
        b[t, s] = 0.6
    if extra:
        psi[extra] = psi[extra[::-1]] = 0.5
    a = np.linalg.inv(np.eye(8) - b)
    c = a @ psi @ a.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def test_pairs_linked_by_the_graph_alone_are_not_confounded():
    r = implied()
    assert abs(r[0, 3]) > 0.3 and fits.confounded(r, 500, EDGES) == []


def test_a_hidden_cause_is_found():
    assert (4, 7) in fits.confounded(implied((4, 7)), 500, EDGES)
