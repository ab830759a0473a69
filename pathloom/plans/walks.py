"""Queries over whole edge tables that need rounds of joins, each with SQL that finds the same rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from . import catalog
from .catalog import PAIR, WEIGHTS


def table(text: str, published: bool = False):
    return lambda spark, sf_dir: catalog.frame(text, spark, sf_dir, published)


def _edges(spark, sf_dir, name, published=False) -> DataFrame:
    return catalog.frame(f"SELECT src, dst FROM (@{name}) e", spark, sf_dir, published)


def _asked(spark, sf_dir, name, nodes, published=False) -> list[DataFrame]:
    """The edges of a graph, and nodes that plans ask about."""
    return catalog.frames([f"SELECT src, dst FROM (@{name}) e", *(f"SELECT @{n} AS name" for n in nodes)], spark, sf_dir, published)


def bfs_distance(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    """Fewest steps from one node."""
    edges, start = _asked(spark, sf_dir, "signal", "a", published)
    return graphs.reached(edges, start).where("d > 0").join(start.select(F.col("name").alias("src"))).select("src", F.col("name").alias("dst"), "d")


def ancestors(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    """A node and all that lead to it; a bidirected pair can be walked both ways."""
    return graphs.reached(*_asked(spark, sf_dir, "mixed", "b", published), True).select("name")


def descendants(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    return graphs.reached(*_asked(spark, sf_dir, "mixed", "c", published)).select("name")


def topo_levels(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    return graphs.levels(_edges(spark, sf_dir, "signal", published))[0]


def levels_from_sinks(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    return graphs.levels(_edges(spark, sf_dir, "signal", published).select(F.col("dst").alias("src"), F.col("src").alias("dst")))[0]


def merged_levels(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    """Levels from the bottom: sinks first, sources last, between them the lower of the two layerings."""
    both = graphs.layers(_edges(spark, sf_dir, "signal", published))
    top = both.agg(F.max("down").alias("top"))
    middle = F.least("up", F.col("top") - F.col("down"))
    return both.join(F.broadcast(top)).select("name", F.when(F.col("up") == 0, 0).when(F.col("down") == 0, F.col("top")).otherwise(middle).cast("int").alias("level"))


def acyclic_check(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    """Nodes on or behind cycles of two graphs; none where the graph is acyclic."""
    one, two = (graphs.levels(_edges(spark, sf_dir, name, published))[1].agg(F.count(F.lit(1)).alias("n_cyclic")).withColumn("graph", F.lit(name)) for name in ("signal", "mixed"))
    return one.unionByName(two).select("graph", "n_cyclic")


def all_pairs_reachable_len_freq(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    return graphs.closure(_edges(spark, sf_dir, "signal", published)).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


def path_nodes_directed(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    return graphs.on_paths(*_asked(spark, sf_dir, "signal", "ab", published))


def path_nodes_shortest(spark: SparkSession, sf_dir: str, published: bool = False) -> DataFrame:
    return graphs.on_paths(*_asked(spark, sf_dir, "signal", "ab", published), True)


def resize_validate_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edges of one graph walks of two steps in another vouch for."""
    return graphs.vouched(_edges(spark, sf_dir, "mixed"), _edges(spark, sf_dir, "regional"))


def resize_mediators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acyclic graph with what the mutual one adds for pairs of regions and suppliers, mediators included."""
    new = catalog.frame("SELECT r.src, s.dst FROM (@signal) r JOIN (@signal) s ON s.src = r.dst", spark, sf_dir)
    return graphs.resized(_edges(spark, sf_dir, "signal"), new, _edges(spark, sf_dir, "regional"), 2)


def graph_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.properties(_edges(spark, sf_dir, "regional"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.components(_edges(spark, sf_dir, "regional"))


def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.largest(_edges(spark, sf_dir, "regional"))


def graph_to_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations (customers' to suppliers'), a nation's strongest partners only, made acyclic."""
    return graphs.dag(catalog.frame("SELECT src, dst, weight FROM (@trade) t", spark, sf_dir)).select("src", "dst", F.round("weight", 6).alias("weight"))


def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graphs.spanning_forest(catalog.frame(f"SELECT x AS src, y AS dst, w AS weight FROM ({WEIGHTS}) w", spark, sf_dir))
    return found.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("weight").alias("w"))


def cpdag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partly directed tree: significant pairs, their spanning tree, v-structures of uncorrelated ends, and what these force."""
    pairs = graphs.cut(catalog.frame(f"SELECT x AS src, y AS dst, 1 - abs(r) AS weight, -n * ln(1 - r * r + 1e-16) AS mi FROM ({PAIR}) p", spark, sf_dir))
    strong = pairs.where("mi > 3.841458820694124").select("src", "dst", "weight")
    tree = graphs.cut(graphs.spanning_forest(strong).select("src", "dst"))
    both = tree.unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    wedge = both.alias("p").join(both.alias("q"), F.col("p.dst") == F.col("q.dst")).where("p.src < q.src").select(F.col("p.src").alias("x"), F.col("p.dst").alias("y"), F.col("q.src").alias("z"))
    ends = strong.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("z"))
    v = graphs.cut(wedge.join(ends, ["x", "z"], "left_anti"))
    arrows = v.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(v.select(F.col("z").alias("src"), F.col("y").alias("dst"))).distinct()
    # an edge that two v-structures point both ways stays undirected
    arrows = graphs.cut(arrows.join(arrows.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_anti"))
    rest = tree.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).join(arrows.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["a", "b"], "left_anti")
    return graphs.directed_by(rest, arrows)


def dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.dot(catalog.frame("SELECT src, dst, CASE WHEN src LIKE 'r%' THEN 'red' ELSE 'gray' END AS color FROM (@regional) e", spark, sf_dir))


def pathways_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pathways (brands, from suppliers to parts) with the network's size beside each edge's labels."""
    raw = catalog.frame("SELECT p_brand AS pathway, concat('id:', 's', cast(l_suppkey AS string)) AS src, concat('id:', 'p', cast(l_partkey AS string)) AS dst FROM (@lines) l JOIN (@parts) p ON p_partkey = l_partkey", spark, sf_dir)
    labels = catalog.frame("SELECT concat('p', cast(p_partkey AS string)) AS name, p_type AS label FROM (@parts) p", spark, sf_dir)
    return graphs.load_pathways(raw, labels=labels, prefix="id:")[0]


PLAIN = (bfs_distance, ancestors, descendants, topo_levels, levels_from_sinks, merged_levels, acyclic_check, all_pairs_reachable_len_freq, path_nodes_directed, path_nodes_shortest, resize_validate_d, resize_mediators, graph_properties, graph_components, giant_component, graph_to_dag, mst_edges, cpdag, dot_text, pathways_loaded)

#: All walks with their lengths, of an acyclic graph.
_WALKS = "e AS (@signal), r AS (SELECT src, dst, 1 AS d FROM e UNION SELECT r.src, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.dst)"
_NEAREST = f"{_WALKS}, dist AS (SELECT src, dst, min(d) AS d FROM r GROUP BY src, dst)"
_REGION = "e AS (@regional), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT src AS name, src AS mate FROM u UNION SELECT c.name, u.dst FROM c JOIN u ON u.src = c.mate), comp AS (SELECT name, min(mate) AS component FROM c GROUP BY name)"
_UP = "SELECT name, max(d) AS {} FROM (SELECT {} AS name, d FROM r UNION ALL SELECT src, 0 FROM e UNION ALL SELECT dst, 0 FROM e) x GROUP BY name"
SQL = {
    "bfs_distance": f"WITH RECURSIVE {_NEAREST} SELECT src, dst, d FROM dist WHERE src = @a",
    "ancestors": "WITH RECURSIVE e AS (@mixed), r AS (SELECT @b AS name UNION SELECT e.src FROM r JOIN e ON e.dst = r.name) SELECT name FROM r",
    "descendants": "WITH RECURSIVE e AS (@mixed), r AS (SELECT @c AS name UNION SELECT e.dst FROM r JOIN e ON e.src = r.name) SELECT name FROM r",
    "topo_levels": f"WITH RECURSIVE {_WALKS} {_UP.format('level', 'dst')}",
    "levels_from_sinks": f"WITH RECURSIVE {_WALKS} {_UP.format('level', 'src')}",
    "merged_levels": f"WITH RECURSIVE {_WALKS}, up AS ({_UP.format('up', 'src')}), down AS ({_UP.format('down', 'dst')}), t AS (SELECT max(down) AS top FROM down) SELECT name, CASE WHEN up = 0 THEN 0 WHEN down = 0 THEN top ELSE least(up, top - down) END AS level FROM up JOIN down USING (name), t",
    "acyclic_check": "WITH RECURSIVE e AS (@mixed), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), on_ AS (SELECT src FROM r WHERE src = dst), s AS (@signal), q AS (SELECT src, dst FROM s UNION SELECT q.src, s.dst FROM q JOIN s ON s.src = q.dst) SELECT 'mixed' AS graph, count(DISTINCT dst) AS n_cyclic FROM r WHERE src IN (SELECT src FROM on_) UNION ALL SELECT 'signal', count(*) FROM q WHERE src = dst",
    "all_pairs_reachable_len_freq": f"WITH RECURSIVE {_NEAREST} SELECT d, count(*) AS n FROM dist GROUP BY d",
    "path_nodes_directed": f"WITH RECURSIVE {_WALKS} SELECT DISTINCT x.dst AS name FROM r x JOIN r y ON y.src = x.dst WHERE x.src = @a AND y.dst = @b UNION SELECT src FROM r WHERE src = @a AND dst = @b UNION SELECT dst FROM r WHERE src = @a AND dst = @b",
    "path_nodes_shortest": f"WITH RECURSIVE {_NEAREST} SELECT x.dst AS name FROM dist x JOIN dist y ON y.src = x.dst JOIN dist t ON t.src = x.src AND t.dst = y.dst WHERE x.src = @a AND y.dst = @b AND x.d + y.d = t.d UNION SELECT src FROM dist WHERE src = @a AND dst = @b UNION SELECT dst FROM dist WHERE src = @a AND dst = @b",
    "resize_validate_d": "WITH g AS (SELECT DISTINCT src, dst FROM (@mixed) m), n AS (SELECT DISTINCT src, dst FROM (@regional) m) SELECT g.src, g.dst, 1 AS d FROM g JOIN n USING (src, dst) UNION ALL SELECT g.src, g.dst, 2 FROM g WHERE EXISTS (SELECT 1 FROM n x JOIN n y ON y.src = x.dst WHERE x.src = g.src AND y.dst = g.dst) AND NOT EXISTS (SELECT 1 FROM n WHERE n.src = g.src AND n.dst = g.dst)",
    "graph_components": f"WITH RECURSIVE {_REGION} SELECT name, component FROM comp",
    "giant_component": f"WITH RECURSIVE {_REGION}, top AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT e.src, e.dst FROM e JOIN comp ON comp.name = e.src JOIN top USING (component)",
    "graph_properties": f"WITH RECURSIVE {_REGION}, d AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT src, dst FROM d UNION SELECT r.src, d.dst FROM r JOIN d ON d.src = r.dst), k AS (SELECT component, count(*) AS n_nodes FROM comp GROUP BY component), m AS (SELECT component, count(*) AS n_edges, count(b.src) // 2 AS n_mutual FROM d JOIN comp ON name = d.src LEFT JOIN d b ON b.src = d.dst AND b.dst = d.src GROUP BY component), cyc AS (SELECT DISTINCT component FROM r JOIN comp ON name = r.src WHERE r.src = r.dst) SELECT k.component, n_nodes, n_edges, n_mutual, round(100 * n_nodes / (SELECT count(*) FROM comp), 1) AS percent, cyc.component IS NULL AS is_dag FROM k JOIN m USING (component) LEFT JOIN cyc USING (component)",
    "mst_edges": f"WITH RECURSIVE w AS ({WEIGHTS}), u AS (SELECT x, y, w FROM w UNION ALL SELECT y, x, w FROM w), r AS (SELECT x AS a, y AS b, w AS lim, x AS here FROM w UNION SELECT r.a, r.b, r.lim, u.y FROM r JOIN u ON u.x = r.here AND u.w < r.lim) SELECT w.x, w.y, w.w FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = w.x AND r.b = w.y AND r.here = r.b)",
    "dot_text": "SELECT 'digraph {' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}' AS graph FROM (SELECT '\"' || src || '\" -> \"' || dst || '\" [color=\"' || CASE WHEN src LIKE 'r%' THEN 'red' ELSE 'gray' END || '\"];' AS line FROM (@regional) e)",
    "pathways_loaded": "WITH q AS (SELECT DISTINCT p_brand AS pathway, concat('s', cast(l_suppkey AS string)) AS src, concat('p', cast(l_partkey AS string)) AS dst, p_type AS dst_label FROM (@lines) l JOIN (@parts) p ON p_partkey = l_partkey), n AS (SELECT pathway FROM (SELECT pathway, src AS v FROM q UNION SELECT pathway, dst FROM q) s GROUP BY pathway HAVING count(*) > 5) SELECT pathway, src, dst, NULL::VARCHAR AS src_label, dst_label FROM q JOIN n USING (pathway)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in PLAIN}


def oracle_sql() -> dict[str, str]:
    return {name: catalog.text(sql, duck=True) for name, sql in SQL.items()}
