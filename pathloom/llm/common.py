"""What the text operators share: reading, batching, the shared folder and global row numbers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Rows of keys and ids that a partition holds in :func:`snug`, and partitions that it leaves at least.
SNUG_ROWS, SNUG_PARTS = 1 << 16, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset the session must be local (tests); a folder under /tmp is then set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file:///tmp/checkpoints/pathloom-{os.getpid()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint: later stages and lost executors reread files, not lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def snug(df: DataFrame, rows: int) -> DataFrame:
    """The same narrow rows, about ``rows`` of them, in no more partitions than they fill.

    Each partition of a shuffle is a task, and each task leaves files however few its rows are: without this, rounds over small
    tables take hundreds of tasks, and more disk for their files' blocks than for the rows.
    """
    return df.coalesce(max(SNUG_PARTS, -(-rows // SNUG_ROWS)))


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and their freed arrays would count on the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column``; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


#: What tells rows apart in :func:`keyed`.
ROW_KEY = ["_sha", "_id", "_none"]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``_sha`` (SHA-256 of the text), ``_id`` and ``_none``: ids compare safely where they are null, and an id on two texts is two rows."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.withColumns({"_sha": sha, "_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})


def staying(rows: DataFrame, keep: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose ``on`` is in ``keep``, one of each. The last step needs no shuffle: the join has dealt and sorted the rows."""
    return rows.join(keep.select(*on).hint("merge"), list(on), "left_semi").dropDuplicates(list(on))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def numbered(df: DataFrame, order: Sequence[str], name: str = "idx") -> tuple[DataFrame, DataFrame]:
    """A gapless number from 0 in the order of the columns, without a single sorting task.

    Rows are sorted in ranges and checkpointed; the only thing gathered is one count for each partition.
    Also returns the checkpointed rows with their partition, for other counts over the same layout.
    """
    spark = df.sparkSession
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    laid = laid.withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = {r["_part"]: r["n"] for r in laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    small = spark.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    out = laid.join(F.broadcast(small), "_part").withColumn(name, F.col("_at") + F.col("_offset"))
    return out.drop("_part", "_at", "_offset"), laid
