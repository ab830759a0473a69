"""Exact quantiles from sorted ranges."""

import random

import numpy as np
import pytest

from pathloom.operators.rows import quantiles
from pathloom.plans import catalog

POINTS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("values", [[7.5], [1.0, 2.0], [3.0] * 40 + [1.0, 2.0], [random.Random(5).choice([random.Random(k).gauss(0, 9), 4.0]) for k in range(999)]], ids=["one", "two", "ties", "many"])
def test_quantiles(spark, values):
    got = quantiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5), POINTS)
    assert got == pytest.approx(np.quantile(values, POINTS).tolist(), abs=1e-12)
    assert quantiles(spark.createDataFrame([(None,)], "v double"), POINTS) == [None] * len(POINTS)


def test_l2t_log2_holds_no_column_in_one_aggregate(spark):
    """PERCENTILE keeps all distinct prices in a map, four times over, in one task."""
    plan = catalog.queries()["l2t_log2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "PythonRDD" not in plan
