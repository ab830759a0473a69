"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts; all rows of a group go to one shard. Groups sorted by bytes, largest first, enter the
open bin with the least remaining capacity that still holds them, found in a balanced (AVL) tree of remaining capacities;
where none holds it a new bin opens. Groups of equal size are one class and enter together: the tightest bin stays the
tightest until it is full, so a class is packed by division, with the same outcome as one group after another. The
driver sees sizes and counts of the classes only. Sizes of more than ``SIZE_BITS`` bits count as rounded up to so many leading bits
(an excess of 1/2048 at most), so there are at most 2^11 classes for each power of two, whatever the input. Which group of a
class comes first follows the digest of its text.

``pack`` minimises the number of bins of a fixed capacity; ``fair`` takes the least capacity that a bisection finds at which a given
number of bins suffices, after giving a bin of its own to every group that is larger than an equal share.

A null text has no bytes and is a group of its own kind, apart from the empty text; its crc32 is that of the empty text.
Rows that repeat stay together and get slots of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


#: Leading bits of a group's size that tell classes apart.
SIZE_BITS = 12


class Tree:
    """An AVL tree of (remaining capacity, bin), with the least entry at or above a bound."""

    def __init__(self):
        self.root = None

    def insert(self, key: tuple[int, int]) -> None:
        self.root = _insert(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = _remove(self.root, key)

    def at_least(self, size: int) -> tuple[int, int] | None:
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found


# A node is [key, left, right, height].
def _height(node) -> int:
    return node[3] if node else 0


def _turned(node, up: int):
    """Rotates the child on side ``up`` above the node."""
    down = 3 - up
    kid = node[up]
    node[up], kid[down] = kid[down], node
    node[3] = 1 + max(_height(node[1]), _height(node[2]))
    kid[3] = 1 + max(_height(kid[1]), _height(kid[2]))
    return kid


def _balanced(node):
    node[3] = 1 + max(_height(node[1]), _height(node[2]))
    lean = _height(node[1]) - _height(node[2])
    if abs(lean) < 2:
        return node
    heavy = 1 if lean > 0 else 2
    if _height(node[heavy][heavy]) < _height(node[heavy][3 - heavy]):
        node[heavy] = _turned(node[heavy], 3 - heavy)
    return _turned(node, heavy)


def _insert(node, key):
    if node is None:
        return [key, None, None, 1]
    side = 1 if key < node[0] else 2
    node[side] = _insert(node[side], key)
    return _balanced(node)


def _remove(node, key):
    if key != node[0]:
        side = 1 if key < node[0] else 2
        node[side] = _remove(node[side], key)
        return _balanced(node)
    if node[1] is None or node[2] is None:
        return node[1] or node[2]
    least = node[2]
    while least[1]:
        least = least[1]
    node[0] = least[0]
    node[2] = _remove(node[2], least[0])
    return _balanced(node)


def pack(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int]] | None:
    """Best-fit-decreasing over (size, count) classes, largest size first.

    Returns runs (bin, count) in the order in which groups enter, or None where more than ``bins`` bins are needed.
    """
    tree, opened, runs = Tree(), 0, []
    for size, count in classes:
        if size > capacity:
            raise ValueError(f"a group of {size} bytes exceeds the capacity of {capacity}")
        while count:
            spot = tree.at_least(size)
            if spot is None:
                if opened == bins:
                    return None
                spot = (capacity, opened)
                opened += 1
            else:
                tree.remove(spot)
            n = min(count, spot[0] // size)
            tree.insert((spot[0] - n * size, spot[1]))
            if runs and runs[-1][0] == spot[1]:
                runs[-1] = (spot[1], runs[-1][1] + n)
            else:
                runs.append((spot[1], n))
            count -= n
    return runs


def fair(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int]]:
    """Runs (bin, count) at the least capacity for which best-fit-decreasing needs at most ``bins`` bins."""
    classes, runs, first = [list(x) for x in classes], [], 0
    left = sum(s * n for s, n in classes)
    while classes and first < bins - 1 and classes[0][0] * (bins - first) > left:
        runs.append((first, 1))  # larger than an equal share of what is left: alone in its bin
        left -= classes[0][0]
        classes[0][1] -= 1
        if not classes[0][1]:
            classes.pop(0)
        first += 1
    if not classes:
        return runs
    n = bins - first
    low = max(-(-left // n), classes[0][0])
    step, capacity = 0, low
    found = pack(classes, capacity, n)
    while found is None:  # gallop, then halve
        low = capacity + 1
        step = max(1, 2 * step)
        capacity += step
        found = pack(classes, capacity, n)
    high = capacity
    while low < high:
        mid = (low + high) // 2
        if (tried := pack(classes, mid, n)) is None:
            low = mid + 1
        else:
            high, found = mid, tried
    return runs + [(b + first, c) for b, c in found]


def rows_of(docs: DataFrame) -> DataFrame:
    """Id, size, crc32 and text digest of every row; the text itself goes no further."""
    text = F.col("text")
    digest = F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text.cast("binary"), 256)))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), digest.alias("digest"))


def classed(size: Column) -> Column:
    """The size, rounded up to ``SIZE_BITS`` leading bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(size)) - SIZE_BITS)).cast("long")
    return (F.ceil(size / step) * step).cast("long")


def assign(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Give ``shards`` for so many bins of nearly equal bytes, or ``capacity`` for as few bins of that many bytes as best-fit-
    decreasing finds (a larger group is refused).
    """
    import numpy as np

    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    rows = rows_of(docs)
    sized = rows.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n")).select("digest", (F.col("size") * F.col("n")).alias("bytes"))
    counted = classed(F.col("bytes"))
    if capacity:
        counted = F.when(F.col("bytes") <= capacity, F.least(counted, F.lit(capacity))).otherwise(counted)
    order = sized.select((-counted).alias("less"), "digest")
    groups, laid = common.numbered(order, ["less", "digest"])
    classes = [(-r["less"], r["n"]) for r in laid.groupBy("less").agg(F.count(F.lit(1)).alias("n")).orderBy("less").toLocalIterator()]
    runs = fair(classes, shards) if shards else pack(classes, capacity)
    ends = np.cumsum([n for _, n in runs], dtype=np.int64)
    plan = spark.sparkContext.broadcast((ends, np.array([b for b, _ in runs], np.int32)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, bins = plan.value
        for batch in batches:
            at = np.searchsorted(to, batch.column(1).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins[at], pa.int32())], names=["digest", "shard"])

    placed = groups.select("digest", "idx").mapInArrow(place, "digest binary, shard int")
    found = rows.join(placed.hint("merge"), "digest").select("doc_id", "size", "text_crc32", "shard")
    out, laid = common.numbered(found, ["shard", "doc_id", "text_crc32"])
    firsts, total = [], 0
    for r in sorted(laid.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["shard"]):
        firsts.append((r["shard"], total))
        total += r["n"]
    small = spark.createDataFrame(firsts or [(0, 0)], "shard int, _first long")
    return out.join(F.broadcast(small), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("idx") - F.col("_first")).alias("slot"))


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``assign`` with the law it keeps: sizes of the shards are near equal."""
    return assign(docs, shards=shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
