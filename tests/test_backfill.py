"""The backfill of flat columns needs no key of rows, and its sums don't depend on the rows' order."""

from decimal import Decimal

import duckdb

from pathloom.plans import studies


def test_repeated_and_missing_ids_count_once_each(spark, tmp_path):
    """raw and changed values were joined by id, which squares a repeated one and loses a null."""
    rows = [(1, "click", 45.5), (1, "click", 61.0), (1, "click", 61.0), (None, "click", 9.0), (2, "view", 3.25), (2, "view", 4.5), (None, "view", 8.0), (3, "error", None)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(studies.oracle_sql()["variance_backfill"]).fetchall())
    assert sorted(map(tuple, studies.variance_backfill(spark, str(tmp_path)).collect())) == want == [("click", 4, 8.0), ("view", 3, 15.75)]


def test_total_is_the_exact_sum(spark):
    cents = [(k * 7919) % 50000 + 1 for k in range(200000)]
    exact = float(sum(Decimal(c) for c in cents) / 100)
    for parts in (1, 7):
        values = spark.createDataFrame([(c / 100,) for c in cents], "value double").repartition(parts)
        assert round(values.agg(studies.total("value").alias("t")).first()[0], 6) == exact
    odd = spark.createDataFrame([(-1.5,), (2.0**60,), (-(2.0**60),), (0.25,)], "value double")
    assert odd.agg(studies.total("value").alias("t")).first()[0] == -1.25
    assert odd.unionByName(spark.createDataFrame([(float("inf"),)], "value double")).agg(studies.total("value").alias("t")).first()[0] == float("inf")
