"""Adjusted p-values in ranges equal those of a sorted list."""

import random

import pytest

from pathloom.operators import learning
from pathloom.operators.adjust import adjusted


def holm(p):
    order, out, high = sorted(range(len(p)), key=lambda k: p[k]), [0.0] * len(p), 0.0
    for rank, k in enumerate(order):
        high = max(high, p[k] * (len(p) - rank))
        out[k] = min(1.0, high)
    return out


@pytest.mark.parametrize("method", ["BH", "holm", "bonferroni", "none"])
def test_adjusted(spark, method):
    rng = random.Random(1)
    p = [rng.choice([rng.random(), rng.random() ** 6, 0.25]) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(p), (999, None)], "k long, pv double").repartition(7)
    got = {r["k"]: r["padj"] for r in adjusted(df, ["k"], method=method).collect()}
    want = holm(p) if method == "holm" else learning.adjusted(p, method)
    assert got.pop(999) is None and [got[k] for k in range(300)] == pytest.approx(want)
    assert adjusted(df.where("false"), ["k"], method=method).count() == 0
