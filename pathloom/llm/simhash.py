"""SimHash near-dedup with covering locality-sensitive hashing.

A document's words (``A-Z`` lower-cased, split at ASCII white space) give word shingles, repeats included; each shingle
votes with its XXH64 (seed 42), and a bit of the fingerprint is set where more than half the votes have it. Distinct
fingerprints are linked at ``radius`` or fewer differing bits.

Candidates come from covering masks (Pagh 2016): every bit position gets a non-zero vector of radius + 1 bits over GF(2),
and mask v leaves out the positions whose vector is orthogonal to v. For any ``radius`` positions some v leaves all of
them out, so each pair within the radius agrees under one mask: recall is exactly 1. A bucket is the distinct fingerprints that agree
under one mask. Buckets are sorted streams, compared block against block and contracted to a spanning forest, so
neither pairs nor a whole bucket are ever held; a larger bucket is split into pairs of blocks which separate tasks compare.
A hot bucket, for which those would be more rows than masks, is dealt again under a second family of covering masks: these
tell its members apart by the bits that the first mask left out, and again miss no pair.

Null, empty and all-white texts have fingerprint zero and are linked like any other; fewer words than a shingle make one
shingle; copies and repeated rows share a fingerprint and count once until the end; other columns are not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares at once; larger buckets are split into pairs of such blocks.
BLOCK = 2048
# Fixed values of XXH64: its five primes.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def xxh64(data: bytes, starts, lengths, seed: int = SEED):
    """XXH64 of many slices of ``data`` at once."""
    import numpy as np

    u = np.uint64
    p1, p2, p3, p4, p5 = u(P1), u(P2), u(P3), u(P4), u(P5)
    buf = np.frombuffer(data + b"\0" * 8, np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", buf.data, 0, (1,))
    four = np.ndarray((len(data) + 1,), "<u4", buf.data, 0, (1,))

    def rot(x, r):
        return (x << u(r)) | (x >> u(64 - r))

    def lane(x):
        return rot(x * p2, 31) * p1

    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    at, left = np.asarray(starts, np.int64)[order].copy(), lengths[order]
    h = np.full(len(at), (seed + P5) & (1 << 64) - 1, u)
    if n := int(np.searchsorted(-left, -32, "right")):
        acc = [np.full(n, (seed + P1 + P2) & (1 << 64) - 1, u), np.full(n, (seed + P2) & (1 << 64) - 1, u), np.full(n, seed, u), np.full(n, (seed - P1) & (1 << 64) - 1, u)]
        rounds, k, m = left[:n] // 32, 0, n
        while m:
            for i in range(4):
                acc[i][:m] = rot(acc[i][:m] + eight[at[:m] + 32 * k + 8 * i] * p2, 31) * p1
            k += 1
            m = int(np.searchsorted(-rounds, -k, "left"))
        merged = rot(acc[0], 1) + rot(acc[1], 7) + rot(acc[2], 12) + rot(acc[3], 18)
        for a in acc:
            merged = (merged ^ lane(a)) * p1 + p4
        h[:n] = merged
        at[:n] += 32 * rounds
    h += left.astype(u)
    tail = left.copy()
    tail[:n] %= 32
    # the tail: lanes of 8 bytes, one of 4, single bytes; rows by the length of their tail
    order2 = np.argsort(-tail, kind="stable")
    at, tail, g = at[order2], tail[order2], h[order2]
    k = 0
    while m := int(np.searchsorted(-tail, -8 * (k + 1), "right")):
        g[:m] = rot(g[:m] ^ lane(eight[at[:m] + 8 * k]), 27) * p1 + p4
        k += 1
    at, rest = at + tail // 8 * 8, tail % 8
    if len(has := np.flatnonzero(rest >= 4)):
        g[has] = rot(g[has] ^ four[at[has]].astype(u) * p1, 23) * p2 + p3
        at[has] += 4
    rest = rest % 4
    for i in range(3):
        if len(has := np.flatnonzero(rest > i)):
            g[has] = rot(g[has] ^ buf[at[has] + i].astype(u) * p5, 11) * p1
    g ^= g >> u(33)
    g *= p2
    g ^= g >> u(29)
    g *= p3
    g ^= g >> u(32)
    out = np.empty_like(g)
    out[order[order2]] = g
    return out


def bit_counts(h, firsts, counts):
    """For each document, how many of its hashes set each of the 64 bits: rows of documents, columns of bits 0 to 63.

    ``firsts`` and ``counts`` tell which of ``h`` are a document's. Eight bits of each hash are spread over the bytes of one
    word, so 255 rows are summed without carry.
    """
    import numpy as np

    u = np.uint64
    ones = u(0x0101010101010101)
    pieces = np.maximum(-(-counts // 255), 1)
    owner = np.repeat(np.arange(len(counts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = firsts[owner] + 255 * within
    heads = np.cumsum(pieces) - pieces
    out = np.zeros((len(counts), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat((h >> u(k)) & ones, cuts)
        out[:, k::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads)
    return out


def shingles(texts: list[bytes | None], words: int = WORDS):
    """Hashes of the shingles of all UTF-8 texts in a row, repeats included; how many a text has; which texts have any."""
    import numpy as np

    lines, starts, lengths, counts, who, base = [], [], [], [], [], 0
    for i, text in enumerate(texts):
        parts = text.lower().split() if text else []
        if not parts:
            continue
        line = b" ".join(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size + 1) - size - 1
        n = max(1, len(parts) - words + 1)
        last = min(words, len(parts)) - 1
        starts.append(base + first[:n])
        lengths.append(first[last : last + n] + size[last : last + n] - first[:n])
        lines.append(line)
        counts.append(n)
        who.append(i)
        base += len(line)
    h = xxh64(b"".join(lines), np.concatenate(starts), np.concatenate(lengths)) if who else np.zeros(0, np.uint64)
    return h, np.array(counts, np.int64), who


def fingerprints(texts: list[bytes | None], words: int = WORDS):
    """Fingerprints of UTF-8 texts, as an unsigned array."""
    import numpy as np

    out = np.zeros(len(texts), np.uint64)
    h, counts, who = shingles(texts, words)
    if who:
        votes = bit_counts(h, np.cumsum(counts) - counts, counts)
        bits = (2 * votes > counts[:, None]).astype(np.uint8)
        out[who] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def masks(radius: int = RADIUS, bits: int = 64, family: int = 0) -> list[int]:
    """2^(radius+1) - 1 covering masks.

    Position i has the non-zero vector m(i) = i mod (2^(radius+1) - 1) + 1; mask v keeps the positions with an odd number of common bits of
    m(i) and v. Vectors of ``radius`` positions span at most ``radius`` dimensions, so a non-zero v is orthogonal to all of them.
    Other families deal the vectors to the positions in another order.
    """
    n = (1 << radius + 1) - 1
    vector = [i % n + 1 for i in range(bits)]
    if family:
        random.Random(family).shuffle(vector)
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def linked(left, right, radius: int, same: bool):
    """Index pairs that connect what links connect, among the fingerprints of a block or between two blocks.

    Pairs are stars of a forest: each joins two members of a component, near each other or not.
    """
    import numpy as np

    pairs = []
    step = max(1, (1 << 22) // max(1, len(right)))
    for i in range(0, len(left), step):
        near = np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(near)
        a += i
        keep = a < b if same else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        pairs += components.forest(zip(a.tolist(), (b if same else b + len(left)).tolist(), strict=True)).items()
    return pairs


def _dealt(prints: DataFrame, kept: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(mask, key, fp): what each fingerprint keeps under each mask, apart by the column ``before``; and the sizes of buckets of two or more.

    Keys that ``before`` tells apart are hashes; equal ones of two buckets would only be compared in vain.
    """
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(kept)]))
    rows = prints.select("fp", "before", key.alias("b")).select("b.mask", F.when(F.col("before") == 0, F.col("b.key")).otherwise(F.xxhash64("before", "b.key")).alias("key"), "fp")
    return rows, common.cut(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints with the same components as all links of ``radius`` or fewer bits.

    ``prints`` has one signed long column ``fp`` of distinct values.
    """
    dealt, sizes = _dealt(prints.select("fp", F.lit(0).alias("before")), masks(radius))
    hot = sizes.where(F.col("n") > len(masks(radius)) * block)
    if hot.take(1):
        calm = dealt.join(hot.select("mask", "key").hint("merge"), ["mask", "key"], "left_anti")
        again = dealt.join(hot.select("mask", "key").hint("merge"), ["mask", "key"], "left_semi")
        more, sizes_again = _dealt(again.select("fp", F.xxhash64("mask", "key").alias("before")), masks(radius, family=1))
        first = len(masks(radius))
        dealt = calm.unionByName(more.withColumn("mask", F.col("mask") + first))
        sizes = sizes.where(F.col("n") <= first * block).unionByName(sizes_again.withColumn("mask", F.col("mask") + first))
    # pair (i, j) of blocks, i <= j: a row of block b goes to the pairs that have b; one pair for a bucket of one block
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = dealt.join(sizes.withColumn("blocks", blocks).hint("merge"), ["mask", "key"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = spread.select("mask", "key", "fp", "own", other.alias("with")).select("mask", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rest = None
        for batch in batches:
            cols = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            cols = cols if rest is None else np.concatenate([rest, cols])
            change = np.flatnonzero((cols[1:, :4] != cols[:-1, :4]).any(axis=1)) + 1
            cuts = [0, *change.tolist()]
            yield found(cols[: cuts[-1]], cuts)
            rest = cols[cuts[-1] :]
        if rest is not None and len(rest):
            yield found(rest, [0, len(rest)])

    def found(cols, cuts):
        import numpy as np

        us, vs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            fps = cols[a:b, 5]
            i, j = cols[a, 2], cols[a, 3]
            first = cols[a:b, 4] == i
            x = fps if i == j else np.concatenate([fps[first], fps[~first]])
            n = int(first.sum())
            u = x.view(np.uint64)
            for p, q in linked(u, u, radius, True) if i == j else linked(u[:n], u[n:], radius, False):
                us.append(int(x[p]))
                vs.append(int(x[q]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = rows.repartition("mask", "key", "i", "j").sortWithinPartitions("mask", "key", "i", "j", "own")
    return dealt.mapInArrow(run, "u long, v long")


def printed(docs: DataFrame, words: int = WORDS, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, signed 64-bit fingerprint and the columns ``extra`` of every row."""
    names = ["doc_id", "fp", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            for part in common.slices(whole, limit=2 << 20):
                fps = fingerprints(common.utf8(part), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    kinds = "".join(f", {c} {given.schema[c].dataType.simpleString()}" for c in extra)
    return given.mapInArrow(run, f"doc_id long, fp long{kinds}")


def rooted(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``prints`` (distinct ``fp``) with the fingerprint that stands for their component as ``root``."""
    tops = components.stars(links(prints.select("fp"), radius))
    return prints.join(tops.select(F.col("u").alias("fp"), F.col("v").alias("top")).hint("merge"), "fp", "left").withColumn("root", F.coalesce("top", "fp")).drop("top")


def near(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    rows = common.cut(printed(docs, words))
    roots = rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), radius)
    # written first: the join then deals its left side apart from this sum, so that adaptive execution can split a hot root
    classes = common.cut(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    named = roots.join(classes.hint("merge"), "root").select("fp", "component_id")
    return rows.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`near`: the fingerprint as 16 hex digits."""
    return near(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """One row of each component, with all its columns: the smallest id, a null id last, then the smallest digest of the text.

    Where a ``similarity`` is given, links are the pairs whose sets of shingles have that Jaccard similarity or more, and
    fingerprints within the radius are candidates of it (see :mod:`jaccard`).
    """
    if similarity is not None:
        from . import jaccard

        return jaccard.dedup(docs, words, similarity, radius=radius)
    marked = common.keyed(docs)
    rows = common.cut(printed(marked, words, common.ROW_KEY))
    prints = rows.groupBy("fp").agg(F.min(F.struct("_none", "_id", "_sha")).alias("least"))
    keep = rooted(prints, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    return common.staying(marked, keep, common.ROW_KEY).select(docs.columns)
