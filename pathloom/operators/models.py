"""Analyses of a graph with data and groups, as one call each.

``edges`` are (from, to) places of columns, ``parts`` the moments of :func:`pathloom.plans.fits.moments` (group to n, means,
covariance), so an analysis never goes back to the rows unless it says so. Tasks that are independent of each other
(pathways, modules, pairs, replicates) run as rows of ``mapInPandas`` with the moments broadcast: p x p numbers, whatever n.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import kernels, learning

Edge = tuple[int, int]


def fan_out(tasks: DataFrame, parts: dict[int, tuple], work: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """``work(row, moments)`` of every task row, which may give any number of rows of the schema."""
    shared = tasks.sparkSession.sparkContext.broadcast(parts)
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([out for row in frame.itertuples(index=False) for out in work(row, shared.value)], columns=names)

    return tasks.mapInPandas(run, schema)


def narrowed(parts: dict[int, tuple], nodes: list[int]) -> dict[int, tuple]:
    return {g: (n, m[nodes], c[np.ix_(nodes, nodes)]) for g, (n, m, c) in parts.items()}


def correlation(parts: dict[int, tuple]) -> tuple[int, np.ndarray]:
    n, r = learning.with_group(parts) if len(parts) == 2 else (next(iter(parts.values()))[0], None)
    if r is not None:
        return n, r[1:, 1:]
    c = next(iter(parts.values()))[2]
    d = np.sqrt(np.diag(c))
    return n, c / np.outer(d, d)


def _local(edges: list[Edge]) -> tuple[list[int], list[Edge]]:
    nodes = sorted({v for e in edges for v in e})
    return nodes, [(nodes.index(a), nodes.index(b)) for a, b in edges]


def _two_sided(z: float) -> float:
    return 2 * kernels.normal_survival(abs(z))


def node_tests(parts: dict[int, tuple], edges: list[Edge]) -> tuple[list[tuple], dict[str, float], float, float]:
    """Rows of (node, t, p), fit indices, and the combined p-values of activation and inhibition."""
    nodes, own = _local(edges)
    n, r = learning.with_group(narrowed(parts, nodes))
    t, p, fit, corr = learning.perturbed(r, n, own)
    return list(zip(nodes, t, p, strict=True)), fit, learning.combined(p, np.sign(t), "positive", corr), learning.combined(p, np.sign(t), "negative", corr)


def edge_tests(parts: dict[int, tuple], edges: list[Edge]) -> list[tuple]:
    """Rows of (from, to, difference of the paths between groups, standard error, z, p)."""
    nodes, own = _local(edges)
    pa = {j: up for j, up in enumerate(learning.parents(own, len(nodes)))}
    fits = {}
    for g, (n, _, c) in narrowed(parts, nodes).items():
        d = np.sqrt(np.diag(c))
        fits[g] = kernels.dag_ols(c / np.outer(d, d), pa, n)
    out = []
    for (j, k, b0, s0), (_, _, b1, s1) in zip(fits[0], fits[1], strict=True):
        se = math.hypot(s0, s1)
        out.append((nodes[k], nodes[j], b1 - b0, se, (b1 - b0) / se, _two_sided((b1 - b0) / se)))
    return out


def status(total: float) -> int:
    """1 from 1 up, 0 for 0, else -1."""
    return 1 if total >= 1 else 0 if total == 0 else -1


def gene_sets(pathways: DataFrame, parts: dict[int, tuple], alpha: float = 0.05, method: str = "BH") -> DataFrame:
    """One row for each pathway (``pathway``, ``edges`` as an array of structs src, dst and, where known, weight; acyclic).

    ``pert`` is the direction of the smaller combined p-value, read with the status of the pathway's weighted in-degrees;
    null where that is 0.
    """

    def work(row, moments) -> list[tuple]:
        edges = [(int(e["src"]), int(e["dst"])) for e in row.edges]
        tests, fit, act, inh = node_tests(moments, edges)
        hits = sum(x < alpha for x in learning.adjusted([p for *_, p in tests], method))
        into: dict[int, float] = {}
        for e in row.edges:
            into[int(e["dst"])] = into.get(int(e["dst"]), 0.0) + (float(e["weight"]) if "weight" in e else 1.0)
        state = status(sum(status(x) for x in into.values()))
        pert = {(1, True): "up act", (1, False): "down act", (-1, False): "up inh", (-1, True): "down inh"}.get((state, act < inh))
        return [(row.pathway, len(tests), hits, pert, act, inh, min(2 * min(act, inh), 1.0))]

    return fan_out(pathways, parts, work, "pathway string, no_nodes int, no_degs int, pert string, p_na double, p_ni double, pval double")


def differential_edges(modules: DataFrame, parts: dict[int, tuple], method: str = "BH") -> DataFrame:
    """Edges of every module (``pathway``, ``edges``) with their difference between groups, adjusted within the module."""

    def work(row, moments) -> list[tuple]:
        rows = edge_tests(moments, [(int(e["src"]), int(e["dst"])) for e in row.edges])
        return [(row.pathway, f"v{a}", f"v{b}", *rest, q) for (a, b, *rest), q in zip(rows, learning.adjusted([x[-1] for x in rows], method), strict=True)]

    return fan_out(modules, parts, work, "pathway string, src string, dst string, d_est double, d_se double, d_z double, pvalue double, padj double")


def effects(spark: SparkSession, parts: dict[int, tuple], edges: list[Edge], pairs: str = "all", kind: str = "optimal", by_group: bool = False) -> DataFrame:
    """Total effects of sources on sinks: "all" reachable pairs, "direct" ones, or from roots to leaves ("source2sink").

    Columns are scaled over all rows. With ``by_group`` the effect is that in group 1 less that in group 0.
    """
    nodes, own = _local(edges)
    p = len(nodes)
    d, roots, leaves = learning.distances(own, p), set(range(p)) - {b for _, b in own}, set(range(p)) - {a for a, _ in own}
    wanted = {"all": lambda x, y: True, "direct": lambda x, y: d[x, y] == 1, "source2sink": lambda x, y: x in roots and y in leaves}[pairs]
    tasks = spark.createDataFrame([(x, y) for x in range(p) for y in range(p) if x != y and np.isfinite(d[x, y]) and wanted(x, y)], "x int, y int")

    def work(row, moments) -> list[tuple]:
        given = learning.adjustment(own, p, row.x, row.y, kind)
        n = sum(k for k, *_ in moments.values())
        mean = sum(k * m for k, m, _ in moments.values()) / n
        within = {g: (k, ((k - 1) * c + k * np.outer(m - mean, m - mean)) / k) for g, (k, m, c) in moments.items()}
        total = sum(k * s for k, s in within.values()) / (n - 1)
        sd = np.sqrt(np.diag(total))
        scaled = {g: (k, s / np.outer(sd, sd)) for g, (k, s) in within.items()}
        if by_group:
            (b1, s1), (b0, s0) = (learning.regression(scaled[g][1], scaled[g][0], row.y, row.x, given) for g in (1, 0))
            est, se = b1 - b0, math.hypot(s1, s0)
        else:
            est, se = learning.regression(total / np.outer(sd, sd), n, row.y, row.x, given)
        z = est / se if se else 0.0
        return [(int(d[row.x, row.y]), f"v{nodes[row.y]}", "<-", f"v{nodes[row.x]}", est, se, z, _two_sided(z), est - 1.96 * se, est + 1.96 * se)]

    return fan_out(tasks, narrowed(parts, nodes), work, "path_l int, sink string, op string, source string, est double, se double, z double, pvalue double, ci_lower double, ci_upper double")


def separation_tests(spark: SparkSession, parts: dict[int, tuple], edges: list[Edge]) -> DataFrame:
    """Every missing edge, given the parents of both ends, against partial correlations that are nearly zero."""
    nodes, own = _local(edges)
    tasks = spark.createDataFrame(learning.missing(own, len(nodes)), "x int, y int")

    def work(row, moments) -> list[tuple]:
        n, r = correlation(moments)
        return [(f"v{nodes[row.x]}", f"v{nodes[row.y]}", *learning.basis_test(r, n, own, (row.x, row.y)))]

    return fan_out(tasks, narrowed(parts, nodes), work, "x string, y string, n_z int, estimate double, pvalue double, lower double, upper double")


def local_tests(spark: SparkSession, parts: dict[int, tuple], edges: list[Edge], most: int = 3) -> DataFrame:
    """Every missing edge that at most ``most`` nodes separate, given the smallest such set; ``z`` names its nodes."""
    nodes, own = _local(edges)
    d = learning.distances(own, len(nodes))
    tasks = spark.createDataFrame(learning.missing(own, len(nodes)), "x int, y int")

    def work(row, moments) -> list[tuple]:
        given = learning.separator(own, len(nodes), row.x, row.y, most, d)
        if given is None:
            return []
        n, r = correlation(moments)
        value = learning.partial(r, row.x, row.y, list(given))
        p, low, high = learning.not_close(value, n, len(given))
        return [(f"v{nodes[row.x]}", f"v{nodes[row.y]}", ",".join(f"v{nodes[k]}" for k in given), value, p, low, high)]

    return fan_out(tasks, narrowed(parts, nodes), work, "x string, y string, z string, estimate double, pvalue double, lower double, upper double")


def find_paths(spark: SparkSession, parts: dict[int, tuple], edges: list[Edge], alpha: float = 1.0) -> DataFrame:
    """Sub-models of all directed paths from roots to leaves whose total effect has p below ``alpha``."""
    nodes, own = _local(edges)
    d = np.isfinite(learning.distances(own, len(nodes)))
    found = effects(spark, parts, edges, "source2sink", "parents").where(f"pvalue < {float(alpha)} and path_l > 1")

    def work(row, moments) -> list[tuple]:
        a, b = nodes.index(int(row.source[1:])), nodes.index(int(row.sink[1:]))
        on = {v for v in range(len(nodes)) if d[a, v] and d[v, b]}
        inner = [e for e in own if e[0] in on and e[1] in on]
        _, fit, act, inh = node_tests(moments, inner)
        return [(row.sink, "<-", row.source, len(on), len(inner), fit["dev"] / fit["df"] if fit["df"] else None, fit["srmr"], act, inh)]

    return fan_out(found.select("source", "sink"), narrowed(parts, nodes), work, "sink string, op string, source string, n_nodes int, n_edges int, dev_df double, srmr double, v_pv_act double, v_pv_inh double")


def fit_modules(modules: DataFrame, parts: dict[int, tuple]) -> DataFrame:
    """Fit and group perturbation of every module."""

    def work(row, moments) -> list[tuple]:
        edges = [(int(e["src"]), int(e["dst"])) for e in row.edges]
        tests, fit, act, inh = node_tests(moments, edges)
        return [(row.pathway, len(tests), len(edges), fit["dev"] / fit["df"] if fit["df"] else None, fit["srmr"], act, inh)]

    return fan_out(modules, parts, work, "cluster string, n_nodes int, n_edges int, dev_df double, srmr double, v_pv_act double, v_pv_inh double")


def score_modules(modules: DataFrame, parts: dict[int, tuple], kind: str = "LV") -> DataFrame:
    """The group's shift of every module's score (LV, CV or UV)."""

    def work(row, moments) -> list[tuple]:
        edges = [(int(e["src"]), int(e["dst"])) for e in row.edges]
        nodes, own = _local(edges)
        n, r = learning.with_group(narrowed(moments, nodes))
        w = learning.module_weights(r[1:, 1:], kind, sorted({a for a, _ in own} - {b for _, b in own}))
        if w is None:
            return []
        c = float(w @ r[1:, 0])
        se = math.sqrt((1 - c * c) / n)
        return [(row.pathway, f"{kind}~group", c, se, c / se, _two_sided(c / se))]

    return fan_out(modules, parts, work, "cluster string, model string, est double, se double, z double, pvalue double")


def search(parts: dict[int, tuple], edges: list[Edge], known: list[Edge], width: int, d: int = 2, kind: str = "inner", alpha: float = 0.05, beta: float = 0.05) -> list[tuple[int, int, str]]:
    """A graph for the data: confounding is taken out, edges are learnt along the layers, and new ones are checked.

    ``known`` is the network that may vouch for a new edge: kind "basic" asks for none, "direct" for the edge itself, "inner"
    for a path of at most ``d`` steps, "outer" likewise and adds the nodes on it. Returns (from, to, "old" or "new").
    """
    n, r = correlation(parts)
    gaps = learning.missing(edges, width)
    padj = learning.adjusted([learning.basis_test(r, n, edges, e)[2] for e in gaps])
    strong = [e for e, q in zip(gaps, padj, strict=True) if q < alpha]
    if strong:
        root = kernels.power(kernels.covariance_graph(r, strong), -0.5)
        r = root @ r @ root
        sd = np.sqrt(np.diag(r))
        r = r / np.outer(sd, sd)
    levels = kernels.layers(r, 0.005)
    lam, there = math.sqrt(math.log(max(len(levels), 2)) / n), set(edges)
    far = learning.distances(known, width)
    out: set[tuple[int, int, str]] = set()
    for i, layer in enumerate(levels[:-1]):
        later = sorted(k for other in levels[i + 1 :] for k in other)
        for j in layer:
            free = np.array([0.0 if (k, j) in there else 1.0 for k in later])
            b = kernels.lasso(r[np.ix_(later, later)], r[later, j], lam, free)
            for k, x in zip(later, b, strict=True):
                if abs(x) <= beta:
                    continue
                if (k, j) in there or kind == "basic":
                    out.add((k, j, "old" if (k, j) in there else "new"))
                elif far[k, j] <= (1 if kind == "direct" else d):
                    at = k
                    while kind == "outer" and far[at, j] > 1:
                        step = min(v for a, v in known if a == at and far[v, j] == far[at, j] - 1)
                        out.add((at, step, "new"))
                        at = step
                    out.add((at, j, "new"))
    return sorted(out)


def simulate(spark: SparkSession, beta: np.ndarray, n: int, seed: int = 1, shift: dict[int, float] | None = None) -> DataFrame:
    """n rows (obs, x, grp) of the linear model with path matrix ``beta`` (child, parent); the later half is group 1, whose
    nodes are shifted. A row depends on its number and the seed only, so lost tasks give the same rows again.
    """
    p = len(beta)
    mix, move = np.linalg.inv(np.eye(p) - beta), np.array([(shift or {}).get(k, 0.0) for k in range(p)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            noise = np.array([np.random.Generator(np.random.Philox(key=[seed, i])).standard_normal(p) for i in frame["id"]]).reshape(-1, p)
            grp = (frame["id"] >= n // 2).astype("int32")
            yield pd.DataFrame({"obs": frame["id"], "x": list((noise + grp.to_numpy()[:, None] * move) @ mix.T), "grp": grp})

    return spark.range(n).mapInPandas(run, "obs long, x array<double>, grp int")
