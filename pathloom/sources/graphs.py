"""Inputs of the analytics: data matrices, groups and graphs as SQL relations over the stored tables.

Each relation has a Spark and a DuckDB text; operators refer to it as ``@name``. Matrices have the width of the stored vectors.
Graphs come from the tables' keys:

* ``dag``: over the matrix columns, regions to nations, nations to a column of their own and to shared ones (acyclic)
* ``signal``: regions and market segments to nations, nations to suppliers, each supplier to the next of its nation (acyclic)
* ``mixed``: the same, and neighbouring nations of a region joined both ways; ``regional``: that without the segments
* ``trade``: from a supplier's nation to the three others whose customers pay most, with the sum
* ``trans``: which event type follows which; ``supply``: parts to suppliers
* ``@a @b @c @d``: nodes that plans ask about

The published example graph stands beside them for tests (``published=True``).
"""

from __future__ import annotations

# The directed edges of the protein-signalling example graph, and its one bidirected pair.
SIGNAL = [("PIP3", "Akt"), ("PKA", "Akt"), ("Mek", "Erk"), ("PKA", "Erk"), ("PKA", "Jnk"), ("PKC", "Jnk"), ("PKA", "Mek"), ("PKC", "Mek"), ("Raf", "Mek"), ("PKA", "P38"), ("PKC", "P38"), ("PIP3", "PIP2"), ("Plcg", "PIP2"), ("PIP2", "PKC"), ("Plcg", "PKC"), ("PIP3", "Plcg"), ("PKA", "Raf"), ("PKC", "Raf")]
BIDIRECTED = [("PKA", "PIP3")]


def pairs(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS dst" for a, b in rows)


def _graphs(t) -> dict[str, str]:
    """Relations whose text is the same for both engines."""
    column = lambda k: f"concat('v', cast({k} AS string))"
    nation = t("nation")
    dag = f"SELECT {column('n_regionkey')} AS src, {column('5 + n_nationkey')} AS dst FROM {nation} UNION ALL SELECT {column('5 + n_nationkey')}, {column('30 + n_nationkey')} FROM {nation} UNION ALL SELECT {column('5 + n_nationkey')}, {column('55 + n_nationkey % 9')} FROM {nation}"
    places = dag.replace("concat('v', cast(", "(1 + (").replace(" AS string))", "))")
    supplier, chain = t("supplier"), "concat('s', cast(s_suppkey AS string))"
    signal = f"""SELECT concat('r', cast(n_regionkey AS string)) AS src, concat('n', cast(n_nationkey AS string)) AS dst FROM {nation}
 UNION ALL SELECT DISTINCT c_mktsegment, concat('n', cast(c_nationkey AS string)) FROM {t("customer")}
 UNION ALL SELECT concat('n', cast(s_nationkey AS string)), {chain} FROM {supplier}
 UNION ALL SELECT src, dst FROM (SELECT {chain} AS src, lead({chain}) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM {supplier}) c WHERE dst IS NOT NULL"""
    near = f"SELECT concat('n', cast(n_nationkey AS string)) AS src, lead(concat('n', cast(n_nationkey AS string))) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS dst FROM {nation}"
    regional = signal.split("UNION ALL SELECT DISTINCT c_mktsegment")[0] + "UNION ALL" + signal.split("UNION ALL", 2)[2]
    first = f"(SELECT s_nationkey FROM {supplier} WHERE s_suppkey = (SELECT min(s_suppkey) FROM {supplier}))"
    return {
        "dag": dag,
        "places": places,
        "signal": signal,
        "regional": f"{regional} UNION ALL SELECT src, dst FROM ({near}) p WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM ({near}) q WHERE dst IS NOT NULL",
        # of each nation's exports to others, which are ranked, the three that bring most
        "trade": f"SELECT src, dst, weight FROM (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM (SELECT concat('n', cast(s_nationkey AS string)) AS src, concat('n', cast(c_nationkey AS string)) AS dst, sum(l_extendedprice) AS weight FROM {t('lineitem')} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {t('orders')} ON o_orderkey = l_orderkey JOIN {t('customer')} ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) g) x WHERE k <= 3",
        "mixed": f"{signal} UNION ALL SELECT src, dst FROM ({near}) p WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM ({near}) q WHERE dst IS NOT NULL",
        "member": f"SELECT concat('r', cast(r_regionkey AS string)) AS name, r_regionkey AS cluster FROM {t('region')} UNION ALL SELECT concat('n', cast(n_nationkey AS string)), n_regionkey FROM {nation} UNION ALL SELECT {chain}, n_regionkey FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey",
        "a": f"(SELECT concat('r', cast(n_regionkey AS string)) FROM {nation} WHERE n_nationkey = {first})",
        "b": f"(SELECT concat('s', cast(max(s_suppkey) AS string)) FROM {supplier} WHERE s_nationkey = {first})",
        "c": f"(SELECT concat('n', cast(n_nationkey AS string)) FROM {nation} WHERE n_nationkey = {first})",
        "d": f"(SELECT concat('n', cast(n_nationkey AS string)) FROM {nation} WHERE n_nationkey = {first})",
    }


def _published() -> dict[str, str]:
    """The example graph, its text forms' names and the nodes that its published figures are about."""
    return {"signal": pairs(SIGNAL), "mixed": pairs(SIGNAL + BIDIRECTED + [(b, a) for a, b in BIDIRECTED]), "a": "'PIP3'", "b": "'Erk'", "c": "'PKA'", "d": "'PKC'"}


def relations(duck: bool = False, published: bool = False) -> dict[str, str]:
    """Name to SQL text."""
    t = (lambda name: name) if duck else (lambda name: "{" + name + "}")
    grp = "CASE WHEN label >= 5 THEN 1 ELSE 0 END AS grp"
    if duck:
        matrix = f"SELECT vec_id AS obs, 'v' || cast(i - 1 AS varchar) AS var, cast(embedding[i] AS double) AS value, {grp} FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)"
        both = f"SELECT vec_id AS obs, {grp}, i - 1 AS i, j - 1 AS j, cast(embedding[i] AS double) AS xv, cast(embedding[j] AS double) AS yv FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i), unnest(range(i + 1, len(embedding) + 1)) AS s(j)"
        edge = f"SELECT 'v' || (i - 1) AS src, 'v' || (j - 1) AS dst, vec_id AS obs, {grp}, cast(embedding[i] AS double) AS xv, cast(embedding[j] AS double) AS yv FROM embeddings, (SELECT src AS i, dst AS j FROM (@places) g) e"
    else:
        matrix = f"SELECT vec_id AS obs, concat('v', v) AS var, cast(x AS double) AS value, {grp} FROM {{embeddings}} LATERAL VIEW posexplode(embedding) e AS v, x"
        both = f"SELECT vec_id AS obs, {grp}, i, i + 1 + k AS j, cast(x AS double) AS xv, cast(y AS double) AS yv FROM {{embeddings}} LATERAL VIEW posexplode(embedding) a AS i, x LATERAL VIEW posexplode(slice(embedding, i + 2, size(embedding))) b AS k, y"
        # the edge list is one row, so that edges meet a row's vector without a join on obs
        edge = f"SELECT concat('v', e.src - 1) AS src, concat('v', e.dst - 1) AS dst, obs, grp, cast(element_at(embedding, e.src) AS double) AS xv, cast(element_at(embedding, e.dst) AS double) AS yv FROM (SELECT vec_id AS obs, {grp}, embedding, g.list FROM {{embeddings}} CROSS JOIN (SELECT /*+ BROADCAST */ collect_list(struct(src, dst)) AS list FROM (@places) p) g) m LATERAL VIEW explode(list) x AS e"
    return (
        {
            "long": matrix,
            "both": both,
            "edge_data": edge,
            "pair": "SELECT least(concat('v', i), concat('v', j)) AS x, greatest(concat('v', i), concat('v', j)) AS y, corr(xv, yv) AS r, covar_samp(xv, yv) AS cov, count(*) AS n FROM (@both) b GROUP BY i, j" if duck else "SELECT x, y, r, cov, n FROM {pairs}",
            "group_pair": "SELECT grp, least(concat('v', i), concat('v', j)) AS x, greatest(concat('v', i), concat('v', j)) AS y, corr(xv, yv) AS r, count(*) AS n FROM (@both) b GROUP BY grp, i, j" if duck else "SELECT grp, x, y, r, n FROM {group_pairs}",
            "trans": f"SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {t('events')}) s WHERE dst IS NOT NULL GROUP BY src, dst",
            "rawtrans": f"SELECT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {t('events')}) s WHERE dst IS NOT NULL",
            "supply": f"SELECT DISTINCT concat('p', cast(l_partkey AS string)) AS src, concat('s', cast(l_suppkey AS string)) AS dst FROM {t('lineitem')}",
            "parts": f"SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM {t('part')}",
            "lines": f"SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM {t('lineitem')}",
            "docs": f"SELECT doc_id, lang, source, n_chars FROM {t('documents')}",
            "labels": f"SELECT doc_id, quality, toxic FROM {t('labels')}",
            "turns": f"SELECT conv_id, turn, role FROM {t('conversations')}",
            "regions": f"SELECT r_regionkey, r_name FROM {t('region')}",
            "measures": f"SELECT event_id, event_type, value FROM {t('events')} WHERE value IS NOT NULL",
            "nations": f"SELECT n_nationkey, n_name, n_regionkey FROM {t('nation')}",
        }
        | _graphs(t)
        | (_published() if published else {})
    )
