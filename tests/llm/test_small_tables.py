"""Rounds over small tables: with many shuffle partitions, a task and its files for each of them would be left at every step."""

from pathloom.llm import common, components


def test_small_tables_take_few_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("64", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(k, k + 3) for k in range(60)], "u long, v long")
        found = components.stars(edges)
        assert found.rdd.getNumPartitions() <= common.SNUG_PARTS
        assert sorted(map(tuple, found.collect())) == [(k, k % 3) for k in range(3, 63)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
