"""Graph operators over edge tables (``src``, ``dst`` strings, where needed ``weight`` or ``pv`` doubles).

Walks go on until nothing new is found, so no depth is bounded: a graph that fits one task is walked there, whatever its depth, a
larger one in rounds of joins, a round for each step. What a round has found is cut by a reliable checkpoint; a round keeps one row
for each pair or node, never one for each walk. Null ends are dropped, loops and repeated edges count once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import kernels

#: Edges a task holds at once when spanning forests are merged.
FOREST_EDGES = 1 << 20
#: Edges, and characters of their names, up to which one task walks a graph; larger graphs are walked in rounds, with the same result.
WALK_EDGES, WALK_CHARS = 1 << 21, 1 << 27
#: Cells of a matrix that a task makes, about.
CELLS = 1 << 24


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def empty(spark, schema: str = "src string, dst string") -> DataFrame:
    """A graph without edges."""
    return spark.createDataFrame([], schema)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()


def from_adjacency(cells: DataFrame) -> DataFrame:
    """Edges of the non-zero cells (i, j, v) of an adjacency matrix."""
    return cells.where("v <> 0").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").cast("double").alias("weight"))


def cells(names: DataFrame, edges: DataFrame | None = None, above: bool = False) -> DataFrame:
    """(i, at, j, to, v): all cells over the names, with the places of both in the order of names, v 1 where an edge leads from i to j.

    A row meets blocks of 64 names, whose edges are the bits of a number, and only then its cells are written out, so no cell is
    shuffled or looked up by name. Tasks make about ``CELLS`` of them. ``above`` leaves out blocks that end before the row's place.
    """
    placed = cut(names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("at")))
    blocks = placed.groupBy(F.expr("at div 64").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n")).select("block", F.col("n.name").alias("names"))
    rows = placed
    if edges is not None:
        tips = simple(edges).join(placed.select(F.col("name").alias("dst"), F.col("at").alias("to")), "dst")
        bits = tips.groupBy(F.col("src").alias("name"), F.expr("to div 64").alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(to % 64 AS int)))").alias("bits"))
        rows = placed.join(bits.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("m")), "name", "left")
    tasks = -(-(placed.count() ** 2) // CELLS)
    grid = rows.withColumnRenamed("name", "i").repartition(max(1, tasks)).join(F.broadcast(blocks), F.expr("block >= at div 64" if above else "true"))
    bit = F.coalesce(F.col("m")[F.col("block")], F.lit(0).cast("long")) if edges is not None else F.lit(0).cast("long")
    long = grid.select("i", "at", F.expr("cast(block * 64 AS int)").alias("first"), bit.alias("bits"), F.posexplode("names").alias("place", "j"))
    return long.select("i", "at", "j", (F.col("first") + F.col("place")).alias("to"), F.expr("cast(shiftright(bits, place) & 1 AS int)").alias("v"))


def to_adjacency(edges: DataFrame, names: DataFrame) -> DataFrame:
    """All cells (i, j, v) over the given names, 0 where there is no edge: also those of names that no edge has."""
    return cells(names, edges).select("i", "j", "v")


def full(edges: DataFrame) -> DataFrame:
    """(src, dst): edges between all nodes of a graph, both ways."""
    return cells(ends(edges)).where("at <> to").select(F.col("i").alias("src"), F.col("j").alias("dst"))


def gaps(edges: DataFrame) -> DataFrame:
    """(x, y), x before y: the pairs of a graph's nodes that no edge joins."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return cells(ends(edges), edges.select("src", "dst").unionByName(back), above=True).where("to > at and v = 0").select(F.col("i").alias("x"), F.col("j").alias("y"))


def ends(edges: DataFrame) -> DataFrame:
    """The names that stand at some end of an edge, loops included."""
    return vertices(edges).where("name is not null")


def at_once(rows: DataFrame, kernel: Callable, *columns: str) -> DataFrame | None:
    """(name, ``columns``): what ``kernel`` finds for each name, of all rows in one task and one job; nothing where they are too many.

    The kernel gets ends and beginnings of the edges as numbers, how many names there are, and the numbers of names that stand alone as
    ``src`` and as ``dst``; it returns a list for each column. A row of two nulls comes through as a null name with zeros. Repeated
    rows are dropped once they are more than a task holds, so only different ones count.
    """
    most, chars, too_many = WALK_EDGES, WALK_CHARS, -2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        def packed(names, values):
            return pa.Table.from_arrays([names, *(pa.array(v, pa.int32()) for v in values)], names=["name", *columns]).to_batches(1 << 16)

        kind = pa.schema([("src", pa.string()), ("dst", pa.string())])
        held, size, bytes_, limit = [], 0, 0, (most, chars)
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).cast(kind))
            size, bytes_ = size + batch.num_rows, bytes_ + sum(pc.sum(pc.binary_length(c)).as_py() or 0 for c in held[-1].columns)
            if size > limit[0] or bytes_ > limit[1]:
                held = [pa.concat_tables(held).group_by(["src", "dst"]).aggregate([]).select(["src", "dst"])]
                size, bytes_ = held[0].num_rows, sum(pc.sum(pc.binary_length(c)).as_py() or 0 for c in held[0].columns)
                if size > most or bytes_ > chars:
                    yield from packed(pa.array([None], pa.string()), [[too_many]] * len(columns))
                    return
                limit = max(most, size + most // 2), max(chars, bytes_ + chars // 2)
        whole = pa.concat_tables([kind.empty_table(), *held])
        coded = pa.chunked_array([x for c in whole.columns for x in c.chunks], pa.string()).combine_chunks().dictionary_encode()
        code = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
        src, dst = code[: len(whole)], code[len(whole) :]
        edge, none = (src >= 0) & (dst >= 0), (src < 0) & (dst < 0)
        found = kernel(src[edge], dst[edge], len(coded.dictionary), src[(src >= 0) & (dst < 0)].tolist(), dst[(src < 0) & (dst >= 0)].tolist())
        yield from packed(coded.dictionary, found)
        if none.any():
            yield from packed(pa.array([None], pa.string()), [[0]] * len(columns))

    found = cut(rows.select("src", "dst").repartition(1).mapInArrow(run, ", ".join(["name string", *(f"{c} int" for c in columns)])))
    return found if found.where(F.col(columns[0]) == too_many).isEmpty() else None


def alone(names: DataFrame, column: str = "src") -> DataFrame:
    """Rows of :func:`at_once` for names that stand alone as ``column``."""
    return names.select(*(F.col("name").alias(c) if c == column else F.lit(None).cast("string").alias(c) for c in ("src", "dst")))


def reached(edges: DataFrame, start: DataFrame, backward: bool = False) -> DataFrame:
    """(name, d): nodes that walks from ``start`` (names) reach and the fewest steps; the start itself at 0."""
    ways = edges.select(*(F.col(c).alias(a) for c, a in zip(("dst", "src") if backward else ("src", "dst"), ("src", "dst"), strict=True))).where("src <> dst")
    found = at_once(ways.unionByName(alone(start)), lambda a, b, n, starts, _: [kernels.distances(a, b, n, starts)], "d")
    if found is not None:
        return found.where("d >= 0")
    step = cut(ways.distinct().withColumnsRenamed({"src": "name", "dst": "to"}))
    seen = front = cut(start.select("name").distinct().withColumn("d", F.lit(0)))
    for k in itertools.count(1):
        new = cut(front.join(step, "name").select(F.col("to").alias("name"), (F.col("d") + 1).alias("d")).distinct().join(seen.select("name"), "name", "left_anti"))
        if new.isEmpty():
            return seen
        seen, front = seen.unionByName(new), new
        seen = seen if k % 8 else cut(seen)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, d): fewest steps between all pairs that a walk joins. Walks double in each round."""
    found, last = cut(simple(edges).withColumn("d", F.lit(1))), None
    while True:
        size = found.agg(F.count(F.lit(1)), F.sum("d")).first()
        if size == last:
            return found
        right = found.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("d").alias("more"))
        longer = found.join(right, "dst").select("src", F.col("to").alias("dst"), (F.col("d") + F.col("more")).alias("d"))
        last, found = size, cut(found.unionByName(longer).groupBy("src", "dst").agg(F.min("d").alias("d")))


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, level): the longest walk that ends in a node; and the names on or behind cycles, whose walks have no longest.

    Round k keeps the nodes that walks of k steps end in, ever fewer of them, until none is left or none falls out.
    """
    found = at_once(edges.where("src <> dst"), lambda a, b, n, *_: [kernels.longest(a, b, n)], "level")
    if found is not None:
        return found.where("level >= 0"), found.where("level < 0").select("name")
    step = cut(simple(edges))
    now = cut(vertices(step))
    rounds, n = [now], now.count()
    while n:
        now = cut(step.join(now.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name")).distinct())
        last, n = n, now.count()
        if n == last:
            break
        rounds.append(now)
    out = rounds[0].withColumn("level", F.lit(0))
    for k, names in enumerate(rounds[1:], 1):
        out = out.unionByName(names.withColumn("level", F.lit(k)))
    return out.groupBy("name").agg(F.max("level").alias("level")).join(now, "name", "left_anti"), now


def layers(edges: DataFrame) -> DataFrame:
    """(name, up, down): the longest walks that begin and that end in a node, of the nodes on no walk to or from a cycle."""
    found = at_once(edges.where("src <> dst"), lambda a, b, n, *_: [kernels.longest(b, a, n), kernels.longest(a, b, n)], "up", "down")
    if found is not None:
        return found.where("up >= 0 and down >= 0")
    edges = cut(simple(edges))
    up = levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))[0].withColumnRenamed("level", "up")
    return cut(up.join(levels(edges)[0].withColumnRenamed("level", "down"), "name"))


def on_paths(edges: DataFrame, a: DataFrame, b: DataFrame, shortest: bool = False) -> DataFrame:
    """Names on the directed (or the shortest) paths between two sets of names, ends included; none where no path is."""
    rows = edges.select("src", "dst").where("src <> dst").unionByName(alone(a)).unionByName(alone(b, "dst"))
    on = at_once(rows, lambda a, b, n, starts, ends: [kernels.distances(a, b, n, starts), kernels.distances(b, a, n, ends)], "f", "d")
    if on is not None:
        on = on.where("name is not null and f >= 0 and d >= 0")
    else:
        on = reached(edges, a).withColumnRenamed("d", "f").join(reached(edges, b, True), "name")
        on = cut(on) if shortest else on
    if shortest:
        on = on.join(F.broadcast(on.agg(F.min(F.col("f") + F.col("d")).alias("least"))), F.col("f") + F.col("d") == F.col("least"))
    return on.select("name")


def components(edges: DataFrame) -> DataFrame:
    """(name, component): the least name of each node's weak component, by alternating stars (Kiveris et al. 2014)."""
    now = cut(simple(edges).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        many = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if many and new.select("u").intersect(new.select("v")).isEmpty():
            break
        now = new
    tops = new.select("v").distinct().select(F.col("v").alias("name"), F.col("v").alias("component"))
    return new.select(F.col("u").alias("name"), F.col("v").alias("component")).unionByName(tops)


def properties(edges: DataFrame) -> DataFrame:
    """Components of two or more nodes, the largest first: nodes, edges, mutual pairs, share of all nodes, and whether acyclic."""
    plain = cut(simple(edges))
    of = cut(components(plain))
    sized = of.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    back = plain.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(1).alias("back"))
    inner = plain.join(back, ["src", "dst"], "left").join(of.withColumnRenamed("name", "src"), "src")
    counted = inner.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"), (F.sum(F.coalesce("back", F.lit(0))) / 2).cast("long").alias("n_mutual"))
    cyclic = of.join(levels(plain)[1], "name", "left_semi").select("component").distinct().withColumn("cyclic", F.lit(True))
    total = vertices(edges).count()
    out = sized.join(counted, "component").join(cyclic, "component", "left")
    return out.select("component", "n_nodes", "n_edges", "n_mutual", F.round(100 * F.col("n_nodes") / total, 1).alias("percent"), F.col("cyclic").isNull().alias("is_dag")).orderBy(F.desc("n_nodes"), "component")


def largest(edges: DataFrame) -> DataFrame:
    """The edges of the largest component (of equal ones, that of the least name)."""
    of = cut(components(edges))
    top = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return edges.join(of.join(F.broadcast(top), "component").select(F.col("name").alias("src")), "src", "left_semi")


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select(*edges.columns)


def dag(edges: DataFrame, keep_mutual: bool = False) -> DataFrame:
    """An acyclic graph: mutual edges go, then in each cycle of 3, 4, ... nodes the edge of largest ``weight``.

    As published, a cycle starts at its least name and its closing edge is no candidate; cycles of one length are treated
    together. What cycles that way remain nowhere, as each loses an edge at its length. ``keep_mutual`` adds the mutual edges again.
    """
    given = cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    back = given.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    rest = cut(given.join(back, ["src", "dst"], "left_anti"))
    mutual = given.join(back, ["src", "dst"], "left_semi")
    size = 3
    while True:
        left = cut(levels(rest)[1])
        if left.isEmpty():
            return rest.unionByName(mutual) if keep_mutual else rest
        # simple paths from their least name, among edges that may lie on cycles
        core = cut(induced(rest, left).select("src", "dst", "weight"))
        path = core.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"), F.struct("weight", "src", "dst").alias("top"))
        for _ in range(size - 2):
            step = core.select(F.col("src").alias("at"), F.col("dst").alias("to"), "weight")
            path = path.join(step, "at").where(F.col("to") > F.col("first")).where(~F.array_contains("path", F.col("to")))
            path = path.select("first", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.greatest("top", F.struct("weight", F.col("at").alias("src"), F.col("to").alias("dst"))).alias("top"))
        closed = path.join(core.select(F.col("src").alias("at"), F.col("dst").alias("first")), ["at", "first"], "left_semi")
        rest = cut(rest.join(closed.select("top.src", "top.dst").distinct(), ["src", "dst"], "left_anti"))
        size += 1


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the minimum spanning forest of an undirected graph, of parallel edges the mean weight.

    An edge that is no part of the forest of some of the edges is no part of the whole one, so tasks span their own edges and
    forests are merged, ever fewer of them; the last one has less edges than there are nodes. Ties go by names.
    """
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    rest = edges.where("src <> dst").select(*ends, "weight").groupBy("src", "dst").agg(F.avg("weight").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], float] = {}

        def forest():
            return {e: held[e] for e in kernels.spanning(held)}

        for batch in batches:
            held |= dict(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True))
            if len(held) > FOREST_EDGES:
                held = forest()
        out = forest()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string()), pa.array(list(out.values()), pa.float64())], names=["src", "dst", "weight"])

    parts = 64
    while True:
        rest = cut(rest.repartition(parts, "src").mapInArrow(run, "src string, dst string, weight double"))
        if parts == 1:
            return rest
        parts = max(1, parts // 8)


def vouched(edges: DataFrame, network: DataFrame, d: int = 2) -> DataFrame:
    """(src, dst, d): edges whose ends a walk of at most ``d`` steps joins in the network, with its length."""
    step = cut(simple(network).select(F.col("src").alias("at"), F.col("dst").alias("to")))
    todo = cut(simple(edges).withColumn("at", F.col("src")))
    out = None
    for k in range(1, d + 1):
        front = todo.join(step, "at").select("src", "dst", F.col("to").alias("at")).distinct()
        hit = cut(front.where("at = dst").select("src", "dst", F.lit(k).alias("d")))
        out = hit if out is None else out.unionByName(hit)
        todo = front.join(hit, ["src", "dst"], "left_anti")
    return out


def mediated(edges: DataFrame, network: DataFrame, d: int = 2) -> DataFrame:
    """(src, dst): the edges of the network on a shortest walk of at most ``d`` steps for each edge it vouches for.

    Where the network has p-values (``pv``), of several shortest walks the one with the largest sum of -2 log p; else, and among
    equal ones, that of the least names.
    """
    p = F.greatest(F.col("pv"), F.lit(1e-300)) if "pv" in network.columns else F.lit(1.0)
    step = cut(network.where("src <> dst").groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.max(-2 * F.log(p)).alias("gain")))
    todo = cut(simple(edges).select("src", "dst", F.col("src").alias("at"), F.array("src").alias("path"), F.lit(0.0).alias("less")))
    out = None
    for _ in range(d):
        front = todo.join(step, "at").where(~F.array_contains("path", F.col("to")))
        front = front.select("src", "dst", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), (F.col("less") - F.col("gain")).alias("less"))
        # one walk for each end and next place: the best so far
        front = cut(front.groupBy("src", "dst", "at").agg(F.min(F.struct("less", "path")).alias("b")).select("src", "dst", "at", "b.path", "b.less"))
        hit = front.where("at = dst").select("src", "dst", "path")
        out = hit if out is None else out.unionByName(hit)
        todo = front.join(hit, ["src", "dst"], "left_anti")
    hops = F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("src"), F.expr("slice(path, 2, size(path) - 1)").alias("dst")))
    return out.select(hops.alias("h")).select("h.src", "h.dst").distinct()


def resized(graph: DataFrame, new: DataFrame, network: DataFrame, d: int = 2, mediators: bool = True) -> DataFrame:
    """(src, dst, color): the graph (gray) and what the network vouches for of the new edges (green), the largest component."""
    added = mediated(new, network, d) if mediators else vouched(new, network, d).select("src", "dst")
    old = simple(graph).withColumn("color", F.lit("gray"))
    whole = old.unionByName(added.join(old, ["src", "dst"], "left_anti").distinct().withColumn("color", F.lit("green")))
    return largest(cut(whole))


def directed_by(undirected: DataFrame, known: DataFrame) -> DataFrame:
    """Orientation rules of v-structures: x -> y -> z forces y -> z for an undirected y - z whose ends share no neighbour x.

    ``undirected`` has a, b (a < b), ``known`` directed src, dst edges, all over one skeleton. Meek's first rule, until nothing changes.
    """
    both = lambda e: e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    known, undirected = cut(simple(known)), cut(undirected.select("a", "b").distinct())
    skeleton = cut(both(undirected).unionByName(known).unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    while True:
        into = known.select(F.col("src").alias("x"), F.col("dst").alias("src"))
        forced = both(undirected).join(into, "src").where("x <> dst").join(skeleton.select(F.col("src").alias("x"), F.col("dst")), ["x", "dst"], "left_anti").select("src", "dst").distinct()
        # a pair that is forced both ways keeps the way of the least name
        forced = forced.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("src").alias("src"))
        forced = cut(forced.select("src", F.when(F.col("src") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("dst"), "a", "b"))
        if forced.isEmpty():
            return known.withColumn("kind", F.lit("->")).unionByName(undirected.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("--").alias("kind")))
        known = cut(known.unionByName(forced.select("src", "dst")))
        undirected = cut(undirected.join(forced.select("a", "b"), ["a", "b"], "left_anti"))


def dot(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph): DOT text of a graph; edges may have color and width, nodes (name) label and color. For graphs to be drawn, so small."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\\\\\"'), F.lit('"'))

    def marks(df, names):
        found = [F.concat(F.lit(f"{a}="), quoted(F.col(c).cast("string"))) for c, a in names if c in df.columns]
        return F.concat(F.lit(" ["), F.concat_ws(",", *found), F.lit("]")) if found else F.lit("")

    lines = edges.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), marks(edges, [("color", "color"), ("width", "penwidth")]), F.lit(";")).alias("line"))
    if nodes is not None:
        lines = nodes.select(F.concat(quoted("name"), marks(nodes, [("label", "label"), ("color", "fillcolor")]), F.lit(";")).alias("line")).unionByName(lines)
    return lines.agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n}")).alias("graph"))


def load_pathways(edges: DataFrame, names: DataFrame | None = None, labels: DataFrame | None = None, prefix: str = "", giant: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pathways, network) of raw pathway edges (``pathway``, ``src``, ``dst``).

    Ids are mapped by ``names`` (id, name; unmapped ids keep theirs), loops, repeated and mutual edges go, pathways of five or
    less nodes too, the prefix of names is taken off. The network is the union, or its largest component; both get ``src_label``
    and ``dst_label`` from ``labels`` (name, label).
    """
    plain = edges.select("pathway", "src", "dst")
    if names is not None:
        for end in ("src", "dst"):
            to = names.groupBy(F.col("id").alias(end)).agg(F.min("name").alias("_to"))
            plain = plain.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    plain = cut(plain.where("src <> dst").distinct())
    plain = plain.join(plain.select("pathway", F.col("src").alias("dst"), F.col("dst").alias("src")), ["pathway", "src", "dst"], "left_anti")
    kept = plain.select("pathway", F.explode(F.array("src", "dst")).alias("name")).distinct().groupBy("pathway").agg(F.count(F.lit(1)).alias("n")).where("n > 5")
    cutoff = lambda c: F.when(F.col(c).startswith(prefix), F.col(c).substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(F.col(c)) if prefix else F.col(c)
    pathways = cut(plain.join(kept.select("pathway"), "pathway", "left_semi").select("pathway", cutoff("src").alias("src"), cutoff("dst").alias("dst")))
    network = simple(pathways)
    network = largest(cut(network)) if giant else network

    def labelled(df):
        for end in ("src", "dst") if labels is not None else ():
            df = df.join(labels.groupBy(F.col("name").alias(end)).agg(F.min("label").alias(f"{end}_label")), end, "left")
        return df

    return labelled(pathways), labelled(network)
