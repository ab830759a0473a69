"""Delimited sources and sinks, positional readers, series matrices, and the steps that make a data set of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graphs import BIDIRECTED, SIGNAL


def read_table(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None, header: bool = True) -> DataFrame:
    """A delimited text file; without a header give the schema. ``NA`` is null."""
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", "NA")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    """Tab-separated without a header, as positional readers take it; or with one (``sep=','`` for CSV)."""
    df.write.option("sep", sep).option("header", header).option("nullValue", "NA").csv(path)


def positioned(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The rows with ``row`` from 0: in the order of the columns, or, without one, of the files and their lines.

    Only counts of partitions are gathered.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    laid = laid.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts, total, firsts = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}, 0, []
    for p in sorted(counts):
        firsts.append((p, total))
        total += counts[p]
    small = df.sparkSession.createDataFrame(firsts or [(0, 0)], "_p long, _first long")
    return laid.join(F.broadcast(small), part == F.col("_p")).withColumn("row", F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_p", "_first")


def read_experiment(spark: SparkSession, exprs: str, samples: str, features: str, sep: str = "\t") -> DataFrame:
    """(feature, sample, grp, value) of three header-less files: values (a line for each feature, a column for each sample),
    samples (name, group) and features (name), which belong together by position."""
    lines = positioned(spark.read.text(exprs)).select("row", F.posexplode(F.split("value", sep)).alias("col", "value"))
    who = positioned(read_table(spark, samples, sep, "sample string, grp int", False))
    what = positioned(read_table(spark, features, sep, "feature string", False))
    found = lines.join(what, "row").join(who.select(F.col("row").alias("col"), "sample", "grp"), "col")
    return found.select("feature", "sample", "grp", F.expr("try_cast(value as double)").alias("value"))


def read_series(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(values: probe, sample, value; samples: field, sample, value) of a series-matrix file: lines of ``!Sample_`` fields and a table."""
    lines = positioned(spark.read.text(path))
    cells = lines.select("row", F.split("value", "\t").alias("c")).where("c[0] <> ''")
    plain = lambda c: F.regexp_replace(c, '^"|"$', "")
    head = cells.where(plain(F.col("c")[0]) == "ID_REF").orderBy("row").limit(1)
    names = head.select(F.col("row").alias("start"), F.posexplode("c").alias("col", "sample")).where("col > 0").select("start", "col", plain(F.col("sample")).alias("sample"))
    table = cells.where(~F.col("c")[0].startswith("!")).select("row", plain(F.col("c")[0]).alias("probe"), F.posexplode("c").alias("col", "value"))
    values = table.join(F.broadcast(names), "col").where("row > start").select("probe", "sample", F.expr("try_cast(value as double)").alias("value"))
    fields = cells.where(F.col("c")[0].startswith("!Sample_")).select("row", F.expr("substr(c[0], 9)").alias("field"), F.posexplode("c").alias("col", "value")).where("col > 0")
    return values, fields.join(F.broadcast(names.select("col", "sample")), "col").select("field", "sample", plain(F.col("value")).alias("value"))


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several platforms one after another; columns that one hasn't are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def collapsed(values: DataFrame, probes: DataFrame, how: str = "mean") -> DataFrame:
    """(gene, sample, value): probes (probe, gene) without a gene, or with several (``///``), go; of several probes the mean, or the first."""
    known = probes.where("gene is not null and gene <> '' and not contains(gene, '///')")
    joined = values.join(known, "probe")
    if how == "mean":
        return joined.groupBy("gene", "sample").agg(F.avg("value").alias("value"))
    if how != "first":
        raise ValueError(how)
    return joined.groupBy("gene", "sample").agg(F.min_by("value", "probe").alias("value"))


def logged(values: DataFrame) -> DataFrame:
    """log2 of the values where their spread asks for it (0.99 quantile above 100, or a range above 50 and a first quartile above 0); what isn't positive is null then."""
    q = values.agg(F.expr("percentile(value, array(0.0, 0.25, 0.99, 1.0))").alias("q"))
    big = (F.col("q")[2] > 100) | ((F.col("q")[3] - F.col("q")[0] > 50) & (F.col("q")[1] > 0))
    return values.join(F.broadcast(q)).withColumn("value", F.when(big, F.when(F.col("value") > 0, F.log2("value"))).otherwise(F.col("value"))).drop("q")


def renamed(values: DataFrame, names: DataFrame) -> DataFrame:
    """(gene, sample, value) with genes mapped by ``names`` (id, name), one to one; those without a name go, of two of one name the first id stays."""
    one = names.where("name is not null").groupBy("id").agg(F.min("name").alias("name"))
    first = Window.partitionBy("name", "sample").orderBy("gene")
    mapped = values.join(one, values["gene"] == one["id"]).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return mapped.select(F.col("name").alias("gene"), "sample", "value")


def assembled(values: DataFrame, samples: DataFrame, field: str, cases: str, probes: DataFrame | None = None, names: DataFrame | None = None, log: bool = True) -> DataFrame:
    """(gene, sample, grp, value): a data set of a series, the group being whether a sample field contains a text."""
    if probes is not None:
        values = collapsed(values, probes)
    else:
        values = values.withColumnRenamed("probe", "gene")
    if names is not None:
        values = renamed(values, names)
    if log:
        values = logged(values)
    grp = samples.where(F.col("field") == field).groupBy("sample").agg(F.max(F.contains(F.lower("value"), F.lit(cases.lower())).cast("int")).alias("grp"))
    return values.join(grp, "sample").select("gene", "sample", "grp", "value")


def widened(values: DataFrame, key: str = "sample", column: str = "gene") -> DataFrame:
    """One row for each key with a column for each name: for matrices whose columns a plan can hold."""
    names = [r[0] for r in values.select(column).distinct().orderBy(column).collect()]
    return values.groupBy(key).pivot(column, names).agg(F.first("value"))


def example_graph(spark: SparkSession) -> DataFrame:
    """The published example graph: 18 directed edges and one bidirected pair, as two opposite edges."""
    return spark.createDataFrame(SIGNAL + BIDIRECTED + [(b, a) for a, b in BIDIRECTED], "src string, dst string")
