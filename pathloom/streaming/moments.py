"""Moments of a stream, kept up to date by Structured Streaming.

Fits depend on counts, sums and squares only, so a stream needs no more state than one row for each key and window; the
watermark lets state of past days go once late rows are no longer expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Count, mean and variance of ``value`` by day of ``ts`` and event type; days are those of the clock that ``ts`` shows,
    whatever the session's time zone."""
    events = events.withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("+00:00"))))
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def event_moments(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """What the stream over the files under ``source`` has added up once all that is there has been read.

    A micro-batch writes the days that it has changed (update mode, so the watermark drops the state of past days) and replaces its
    own table, so a restart after a loss from the stream's checkpoint repeats it safely. Of a day the last table counts.
    """
    schema = spark.read.parquet(source).schema
    pattern = f"{source[:-1]}[{source[-1]}]"  # matches the source only; a plain path would have to be a folder
    files = spark.readStream.schema(schema).parquet(pattern)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = daily(files).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    last = F.max_by(F.struct("n", "mean", "variance"), "batch").alias("last")
    rows = found.groupBy("window", "event_type").agg(last).select("window", "event_type", "last.*")
    return rows.select(F.date_from_unix_date((F.unix_timestamp("window.start") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))
