"""The tests of the basis set use every missing edge, and equal those of the kernels."""

import pytest

from pathloom.operators import learning
from pathloom.plans import catalog, fits

DATA = "/root/testdata/sf0.001"


def test_every_missing_edge_is_tested_given_all_parents(spark):
    edges, _, n, r = fits.study(spark, DATA)
    gaps = learning.missing(edges, len(r))
    want = {tuple(sorted((f"v{a}", f"v{b}"))): learning.basis_test(r, n, edges, (a, b)) for a, b in gaps}
    got = {(x.x, x.y): x for x in catalog.frame("not_close_fit_p", spark, DATA).collect()}
    assert got.keys() == want.keys() and len(got) == 64 * 63 // 2 - len(edges) and 1 < max(x.n_z for x in got.values()) <= catalog.SWEEPS
    for key, (q, value, *_) in want.items():
        assert got[key].n_z == q and got[key].estimate == pytest.approx(value, abs=1e-6)
    total = catalog.frame("shipley_c_stat", spark, DATA).collect()[0]
    assert total.n_tests == len(gaps) and total.df == 2 * len(gaps) and total.c_stat == pytest.approx(learning.fisher([w[2] for w in want.values()])[0], rel=1e-5)
