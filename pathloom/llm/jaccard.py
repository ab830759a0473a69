"""Near-dedup of texts whose sets of word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

This is the mode of :mod:`simhash` for a similarity in place of a radius. Words and shingles are its own, in shingles of five;
fewer words make one shingle. Candidates are texts whose fingerprints lie within the radius, by its covering masks, and, as
a pair of similarity 0.8 differs by 10 of 64 bits and often by 16 (for which covering masks are 2^17, or keep about ten bits
each if the bits are split), texts that share a band of min-hashes: each of ``BANDS`` bands holds the minima of ``ROWS`` hash
functions, so a pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS, 3e-6 at 0.8 and less above.

Equal sets are one vertex. Vertices that share a band or a link are linked to the least of them, and the texts of each component
of this graph are dealt together, a large component in blocks. There every set is compared exactly with all that it is
not yet joined to, so candidates which are not similar don't join, and neither pairs nor sets are ever shuffled. In a component
of several blocks each block is first compared with ``PIVOTS`` texts of the component. What these join into one class, in a
hot group of copies almost all, is not compared within itself; only the rest goes against all blocks.

Texts without words are one set; null ids and ids on several texts are rows like others; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, simhash

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS, SEED = 4, 24, 42
#: Texts of a component that are compared at once; larger components are split into pairs of such blocks.
BLOCK = 1024
#: Texts of a large component, those with the least hashes, that all its others are compared with first.
PIVOTS = 16


def bands(h, firsts):
    """For each text (its hashes begin at ``firsts``) the keys of its bands."""
    import numpy as np

    u = np.uint64
    factors = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, ROWS * BANDS, dtype=u) | u(1)
    out = np.empty((len(firsts), BANDS), u)
    for band in range(BANDS):
        key = np.full(len(firsts), band + 1, u)
        for factor in factors[band * ROWS : band * ROWS + ROWS]:
            v = h * factor
            v ^= v >> u(32)
            v *= u(simhash.P1)
            key = (key ^ np.minimum.reduceat(v, firsts)) * u(simhash.P2)
            key ^= key >> u(29)
        out[:, band] = key
    return out


def sets(texts: list[bytes | None], words: int = WORDS) -> list:
    """Sorted distinct shingle hashes of each text."""
    import numpy as np

    h, counts, who = simhash.shingles(texts, words)
    out = [h[:0]] * len(texts)
    for i, part in zip(who, np.split(h, np.cumsum(counts)[:-1]), strict=True) if who else ():
        out[i] = np.unique(part)
    return out


def joined(groups: list, similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """(member, root) of the components that similar sets make. A set is compared with those that no component has yet."""
    import numpy as np

    sizes = np.array([len(g) for g in groups])
    codes = np.unique(np.concatenate(groups), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    flags = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    left, rest = np.arange(len(groups)), codes

    def take(out):
        nonlocal left, rest
        rest = rest[np.repeat(~out, sizes[left])]
        left = left[~out]

    while len(left) > 1:
        root = int(left[0])
        take(left == root)
        todo = [root]
        while todo and len(left):
            at = todo.pop()
            mine = codes[ends[at] - sizes[at] : ends[at]]
            flags[mine] = True
            shared = np.add.reduceat(flags[rest].astype(np.int64), np.cumsum(sizes[left]) - sizes[left])
            flags[mine] = False
            near = shared / (sizes[left] + sizes[at] - shared) >= similarity
            if near.any():
                found = left[near].tolist()
                yield from ((k, root) for k in found)
                todo += found
                take(near)


def printed(marked: DataFrame, words: int = WORDS) -> DataFrame:
    """The row keys, the digest of the set of shingles as ``sid``, the bands and the fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for whole in batches:
            for part in common.slices(whole, limit=2 << 20):
                texts = common.utf8(part)
                found = sets(texts, words)
                some = [k for k, g in enumerate(found) if len(g)]
                keys = np.zeros((len(found), BANDS), np.uint64)
                if some:
                    size = np.array([len(found[k]) for k in some])
                    keys[some] = bands(np.concatenate([found[k] for k in some]), np.cumsum(size) - size)
                sid = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in found], np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                prints = simhash.fingerprints(texts, words)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sid.view(np.int64)), lists, pa.array(prints.view(np.int64))], names=[*common.ROW_KEY, "sid", "bands", "fp"])

    return marked.select(*common.ROW_KEY, "text").mapInArrow(run, "_sha binary, _id long, _none boolean, sid long, bands array<long>, fp long")


def candidates(reps: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Edges (u, v) between sets: those that share a band with the least of it, and those whose fingerprints a link joins."""
    dealt = reps.select("sid", F.explode("bands").alias("band"))
    low = dealt.groupBy("band").agg(F.min("sid").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = dealt.join(low.hint("merge"), "band").where("sid <> low").select(F.col("sid").alias("u"), F.col("low").alias("v"))
    first = common.cut(common.snug(reps.groupBy("fp").agg(F.min("sid").alias("first")), reps.count()))
    same = reps.select("sid", "fp").join(first.hint("merge"), "fp").where("sid <> first").select(F.col("sid").alias("u"), F.col("first").alias("v"))
    close = simhash.links(first.select("fp"), radius)
    for end in ("u", "v"):
        close = close.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")).hint("merge"), end)
    return edges.unionByName(same).unionByName(close.select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def _compared(rows: DataFrame, keys: list[str], words: int, similarity: float) -> DataFrame:
    """Edges (u, v) that join what is similar among the texts of each group."""

    def run(table: pa.Table) -> pa.Table:
        sid = table.column("sid").to_pylist()
        pairs = list(joined(sets(table.column("text").cast(pa.binary()).to_pylist(), words), similarity))
        if table.nbytes > common.SLICE_BYTES // 4:
            common.release()
        return pa.table({"u": pa.array([sid[a] for a, _ in pairs], pa.int64()), "v": pa.array([sid[b] for _, b in pairs], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "u long, v long")


def _pivoted(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (u, v) from pivots to the texts of their group that are similar to them."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        sid, pivot = table.column("sid").to_pylist(), table.column("pivot").to_pylist()
        groups = sets(table.column("text").cast(pa.binary()).to_pylist(), words)
        sizes, us, vs = np.array([len(g) for g in groups]), [], []
        line, ends = np.concatenate(groups), np.cumsum(sizes)
        for k in np.flatnonzero(pivot):
            shared = np.concatenate([[0], np.cumsum(np.isin(line, groups[k]))])
            shared = shared[ends] - shared[ends - sizes]
            near = np.flatnonzero(shared >= similarity * (sizes + sizes[k] - shared))
            us += [sid[i] for i in near if i != k]
            vs += [sid[k]] * (len(near) - 1)
        common.release()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return rows.groupBy("comp", "own").applyInArrow(run, "u long, v long")


def links(marked: DataFrame, reps: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK, radius: int = simhash.RADIUS) -> DataFrame:
    """Edges (u, v) between sets with the components of all similar pairs. ``reps`` has sid, bands, fp and a row's keys of every set."""
    tops = components.stars(candidates(reps, radius))
    n = reps.count()
    whole = common.cut(common.snug(tops.select(F.col("u").alias("sid"), F.col("v").alias("comp")).unionByName(tops.select(F.col("v").alias("sid"), F.col("v").alias("comp")).distinct()), n))
    sizes = common.cut(common.snug(whole.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), n))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = whole.join(sizes.hint("merge"), "comp").withColumn("blocks", blocks)
    placed = common.cut(common.snug(placed.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")), n))

    # the texts of candidates, one of each set, move once
    named = reps.select("sid", *common.ROW_KEY).join(placed.hint("merge"), "sid")
    texts = marked.select(*common.ROW_KEY, "text").join(named.hint("merge"), common.ROW_KEY).dropDuplicates(common.ROW_KEY)
    texts = common.cut(texts.select("comp", "blocks", "own", "n", "sid", "text"))
    small = _compared(texts.where("blocks = 1").select("comp", "sid", "text"), ["comp"], words, similarity)
    large = placed.where("blocks > 1")
    if not large.take(1):
        return small
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    texts = texts.where("blocks > 1").withColumn("pivot", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("n")) < PIVOTS)
    first = texts.where("pivot").withColumn("own", every).unionByName(texts.where("not pivot"))
    found = common.cut(_pivoted(first.select("comp", "own", "sid", "pivot", "text"), words, similarity))
    # what the pivots don't join into the largest class of its component goes against all blocks
    classes = large.select("comp", "blocks", "own", "sid").join(components.stars(found).select(F.col("u").alias("sid"), F.col("v").alias("top")).hint("merge"), "sid", "left")
    classes = common.cut(common.snug(classes.withColumn("top", F.coalesce("top", "sid")), n))
    most = classes.groupBy("comp", "top").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").agg(F.max(F.struct("n", "top")).alias("m"), F.sum("n").alias("n"))
    most = common.cut(common.snug(most.select("comp", F.col("m.top").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / block).cast("int").alias("rest")).where("rest > 0"), n))
    todo = classes.join(most.hint("merge"), "comp").withColumn("part", F.when(F.col("top") != F.col("main"), F.pmod(F.xxhash64("sid", F.lit(2)), F.col("rest")).cast("int")))
    if not todo.take(1):
        return small.unionByName(found)
    against = F.explode(F.sequence(F.lit(0), F.col("rest") - 1))
    rows = texts.select("sid", "text").join(todo.hint("merge"), "sid")
    pairs = rows.withColumn("part", against).unionByName(rows.where("part is not null").withColumn("own", every))
    return small.unionByName(found).unionByName(_compared(pairs.select("comp", "own", "part", "sid", "text"), ["comp", "own", "part"], words, similarity))


def dedup(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK, radius: int = simhash.RADIUS) -> DataFrame:
    """One row of each component, with all its columns: the smallest id, a null id last, then the smallest digest of the text."""
    marked = common.keyed(docs)
    rows = common.cut(printed(marked, words))
    least = F.struct("_none", "_id", "_sha")
    reps = rows.groupBy("sid").agg(F.min(least).alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).select("sid", "bands", "fp", "least.*")
    reps = common.cut(common.snug(reps, rows.count()))
    tops = components.stars(links(marked, reps, words, similarity, block, radius))
    roots = reps.select("sid", least.alias("least")).join(tops.select(F.col("u").alias("sid"), F.col("v").alias("top")).hint("merge"), "sid", "left")
    keep = roots.groupBy(F.coalesce("top", "sid").alias("root")).agg(F.min("least").alias("least")).select("least.*")
    return common.staying(marked, keep, common.ROW_KEY).select(docs.columns)
