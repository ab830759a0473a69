"""Adjusted p-values over any number of tests, without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut


def adjusted(tests: DataFrame, keys: Sequence[str], p: str = "pv", method: str = "BH") -> DataFrame:
    """The rows with ``padj``: by "BH", "holm", "bonferroni" or "none". Nulls are no tests and keep a null.

    Tests are sorted in ranges of p and checkpointed. A range's first rank and the best value beyond it follow from one count and
    one extreme for each range, which is all that is gathered; the running extremes within a range are a window over it.
    """
    tests = cut(tests)
    known, missing = tests.where(F.col(p).isNotNull()), tests.where(F.col(p).isNull()).withColumn("padj", F.lit(None).cast("double"))
    if method == "none":
        return known.withColumn("padj", F.col(p)).unionByName(missing)
    if method == "bonferroni":
        m = known.count()
        return known.withColumn("padj", F.least(F.lit(1.0), F.col(p) * m)).unionByName(missing)
    if method not in ("BH", "holm"):
        raise ValueError(method)
    laid = cut(known.repartitionByRange(p, *keys).sortWithinPartitions(p, *keys).withColumn("_id", F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright("_id", 33).cast("int"))
    counts = sorted((r["_range"], r["n"]) for r in laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    m, firsts, at = sum(n for _, n in counts), [], 0
    for k, n in counts:
        firsts.append((k, at))
        at += n
    spark = tests.sparkSession
    ranked = laid.join(F.broadcast(spark.createDataFrame(firsts or [(0, 0)], "_range int, _first long")), "_range")
    rank = F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    value = F.col(p) * m / rank if method == "BH" else F.col(p) * (F.lit(m + 1) - rank)
    ranked = ranked.withColumn("_value", value)
    extreme = F.min if method == "BH" else F.max
    ends = sorted((r["_range"], r["e"]) for r in ranked.groupBy("_range").agg(extreme("_value").alias("e")).collect())
    beyond, best = [], 1.0 if method == "BH" else 0.0
    for k, e in reversed(ends) if method == "BH" else ends:
        beyond.append((k, best))
        best = min(best, e) if method == "BH" else max(best, e)
    own = Window.partitionBy("_range").orderBy(F.desc("_id") if method == "BH" else "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.join(F.broadcast(spark.createDataFrame(beyond or [(0, 1.0)], "_range int, _beyond double")), "_range").withColumn("_run", extreme("_value").over(own))
    joined = F.least("_run", "_beyond") if method == "BH" else F.greatest("_run", "_beyond")
    return ranked.withColumn("padj", F.least(F.lit(1.0), joined)).select(*tests.columns, "padj").unionByName(missing)
