"""One-pass sums over the rows of a matrix (``obs``, ``x`` an array of doubles, ``grp``), and maps of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut

#: Rows of a cross-product matrix that travel together.
BLOCK = 256
#: Rows whose products are held at once, and numbers of a sum that travel together.
ROWS, PIECE = 256, 1 << 16


def complete(rows: DataFrame) -> DataFrame:
    """The rows without a missing value."""
    return rows.where("x is not null and grp is not null and not exists(x, v -> v is null or isnan(v))")


SUMS = "grp int, width int, block int, n long, mean binary, squares binary, sums binary"


def blocks(rows: DataFrame) -> DataFrame:
    """Centred cross products by group, in blocks of ``BLOCK`` of their rows: ``n``, ``mean`` and ``squares`` (the diagonal) of all columns,
    ``sums`` of the block's. Tasks send one row a block, which are merged pairwise, so a large mean costs no digits.
    """
    import numpy as np

    def merged(one, two, at=slice(None)):
        (n, mean, squares, sums), (k, other, more, added_) = one, two
        gap, part = other - mean, n * k / (n + k)
        return n + k, mean + gap * (k / (n + k)), squares + more + gap**2 * part, sums + added_ + np.outer(gap[at], gap) * part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            lists, grp = batch.column(0), np.asarray(batch.column(1).to_pylist())
            size = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten(), float)
            ends = np.cumsum(size)
            for width in np.unique(size) if len(size) else ():
                for g in np.unique(grp):
                    who = np.flatnonzero((grp == g) & (size == width))
                    if not len(who) or not width:
                        continue
                    x = flat[(ends[who] - width)[:, None] + np.arange(width)]
                    mean = x.mean(axis=0)
                    sums = (x - mean).T @ (x - mean)
                    own = len(x), mean, np.diag(sums).copy(), sums
                    key = int(g), int(width)
                    found[key] = merged(found[key], own) if key in found else own
        out = [(g, w, k, n, mean.tobytes(), squares.tobytes(), sums[k * BLOCK : (k + 1) * BLOCK].tobytes()) for (g, w), (n, mean, squares, sums) in found.items() for k in range(-(-w // BLOCK))]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=SUMS.replace(",", "").split()[::2])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for r in table.to_pylist():
            mean = np.frombuffer(r["mean"])
            own = r["n"], mean, np.frombuffer(r["squares"]), np.frombuffer(r["sums"]).reshape(-1, len(mean))
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            total = merged(total, own, at) if total else own
        first = table.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([first | {"n": total[0], "mean": total[1].tobytes(), "squares": total[2].tobytes(), "sums": total[3].tobytes()}], schema=table.schema)

    return complete(rows).select("x", "grp").mapInArrow(run, SUMS).groupBy("grp", "width", "block").applyInArrow(add, SUMS)


def moments(rows: DataFrame) -> dict[int, tuple]:
    """Group to (n, means, covariance) of the columns; what is gathered is width^2 numbers a group.

    Rows with a missing value, or shorter than the widest, are incomplete and don't count.
    """
    import numpy as np

    parts = blocks(rows).drop("squares").collect()
    width = max((r["width"] for r in parts), default=0)
    out: dict[int, tuple] = {}
    for g in sorted({r["grp"] for r in parts if r["width"] == width}):
        own = sorted((r for r in parts if r["grp"] == g and r["width"] == width), key=lambda r: r["block"])
        n, sums = own[0]["n"], np.vstack([np.frombuffer(r["sums"]).reshape(-1, width) for r in own])
        out[g] = (int(n), np.frombuffer(own[0]["mean"]).copy(), sums / max(n - 1, 1))
    return out


def pairs(rows: DataFrame) -> DataFrame:
    """(grp, i, j, n, r, cov) of all pairs i < j of columns by group; nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for b in batch.to_pylist():
                squares, first = np.frombuffer(b["squares"]), b["block"] * BLOCK
                sums = np.frombuffer(b["sums"]).reshape(-1, len(squares))
                for k, row in enumerate(sums):
                    i, rest = first + k, slice(first + k + 1, None)
                    size = len(squares) - i - 1
                    if size:
                        scale = np.sqrt(squares[i] * squares[rest])
                        r = np.divide(row[rest], scale, out=np.full(size, np.nan), where=scale > 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, b["grp"], np.int32)), pa.array(np.full(size, i, np.int32)), pa.array(np.arange(i + 1, len(squares), dtype=np.int32)), pa.array(np.full(size, b["n"], np.int64)), pa.array(np.clip(r, -1, 1)), pa.array(row[rest] / max(b["n"] - 1, 1))], names=["grp", "i", "j", "n", "r", "cov"])

    return blocks(rows).mapInArrow(run, "grp int, i int, j int, n long, r double, cov double")


def pooled(parts: dict[int, tuple]) -> tuple:
    """(n, correlation) of all groups together."""
    import numpy as np

    n = sum(k for k, *_ in parts.values())
    mean = sum(k * m for k, m, _ in parts.values()) / n
    s = sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values()) / (n - 1)
    d = np.sqrt(np.diag(s))
    return n, s / np.outer(d, d)


def added(rows: DataFrame, size: int, contribute: Callable) -> object:
    """The sum of ``contribute(values, obs)``, a vector of ``size`` numbers for a block of complete rows, over all rows."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                total += contribute(np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1), np.asarray(batch.column(1).to_pylist()))
        pieces = [total[k : k + PIECE].tobytes() for k in range(0, size, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["k", "v"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"k": table.column("k")[:1], "v": pa.array([sum(np.frombuffer(x) for x in table.column("v").to_pylist()).tobytes()], pa.binary())})

    found = complete(rows).select("x", "obs").mapInArrow(run, "k int, v binary").groupBy("k").applyInArrow(add, "k int, v binary").collect()
    return np.concatenate([np.zeros(0), *(np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["k"]))]) if found else np.zeros(size)


def multiplied(rows: DataFrame, root) -> DataFrame:
    """obs and x of the complete rows, each multiplied by a width x width matrix."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1) @ shared.value
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(x, 6).tolist(), pa.list_(pa.float64()))], names=["obs", "x"])

    return complete(rows).where(F.size("x") == len(root)).select("obs", "x").mapInArrow(run, "obs long, x array<double>")


def quantiles(values: DataFrame, points: list[float]) -> list[float | None]:
    """Exact quantiles (type 7) of a column of doubles, none where it has no value: distinct values are sorted in ranges, of which
    only those that hold a wanted rank are looked at again, so no task holds all values."""
    column = values.columns[0]
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counted.repartitionByRange("v")).withColumn("part", F.spark_partition_id())
    total, below = 0, {}
    for r in sorted(ranged.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("v")).collect(), key=lambda r: (r["v"] != r["v"], r["v"])):  # NaN last
        below[r["part"]] = (total, r["n"])
        total += r["n"]
    if not total:
        return [None] * len(points)
    places = [p * (total - 1) for p in points]
    ranks = sorted({k for x in places for k in (int(x), min(int(x) + 1, total - 1))})
    found: dict[int, float] = {}
    for part, (before, n) in below.items():
        if own := [k for k in ranks if before <= k < before + n]:
            upto = F.sum("n").over(Window.orderBy("v")) + before
            hit = F.array(*[F.lit(k).cast("long") for k in own])
            near = ranged.where(F.col("part") == part).select("v", "n", upto.alias("upto"))
            for r in near.select("v", F.filter(hit, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))).alias("ranks")).where("size(ranks) > 0").collect():
                found |= dict.fromkeys(r["ranks"], r["v"])
    at = [(found[int(x)], found[min(int(x) + 1, total - 1)], x - int(x)) for x in places]
    return [low if low == high or not share else low * (1 - share) + high * share for low, high, share in at]
