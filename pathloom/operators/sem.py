"""Structural equation models of a graph table and a data table, of any width.

``Study.bind`` takes edges (``src``, ``dst``; a pair of opposite edges is a covariance) and a wide table with numeric columns, of
which one may be a 0/1 group. Nodes are the columns that the graph has, in the order of the columns; rows are read once,
for their moments. Fits follow: 0 a common model, 1 the group's shift of every node, 2 differences of the paths between groups;
by "ml" (maximum likelihood, also of mixed graphs), "cggm" (de-biased node-wise regressions) or "ricf" (residual iterative
fitting with permuted or resampled errors).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import communities, graphs, kernels, learning
from .rows import added, complete, moments

ESTIMATES = "lhs string, op string, rhs string, est double, se double, z double, pvalue double, ci_lower double, ci_upper double"
#: Edges of a model that the driver takes.
MOST_EDGES = 1_000_000
#: Other names of the fitting methods.
ALGORITHMS = {"ml": "ml", "lavaan": "ml", "cggm": "cggm", "ricf": "ricf"}


@dataclass
class Study:
    spark: SparkSession
    names: list[str]
    directed: list[tuple[int, int]]
    both: list[tuple[int, int]]
    rows: DataFrame
    parts: dict[int, tuple]
    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    @classmethod
    def bind(cls, edges: DataFrame, data: DataFrame, group: str | None = None, obs: str | None = None) -> Study:
        columns = [c for c in data.columns if c not in (group, obs)]
        given = data.sparkSession.createDataFrame([(c,) for c in columns], "name string")
        kept = graphs.induced(edges.where("src <> dst"), given)
        weight = F.max("weight") if "weight" in edges.columns else F.lit(None).cast("double")
        found = kept.groupBy("src", "dst").agg(weight.alias("weight")).limit(MOST_EDGES + 1).collect()
        if len(found) > MOST_EDGES:
            raise ValueError(f"a model has at most {MOST_EDGES} edges")
        inside = {v for e in found for v in (e["src"], e["dst"])}
        names = [c for c in columns if c in inside]
        place = {c: k for k, c in enumerate(names)}
        pairs = {(place[e["src"]], place[e["dst"]]) for e in found}
        both = sorted({(min(e), max(e)) for e in pairs if e[::-1] in pairs})
        number = F.col(obs).cast("long") if obs else F.xxhash64(*[F.col(c) for c in data.columns])
        grp = F.col(group).cast("int") if group else F.lit(0)
        rows = complete(data.select(number.alias("obs"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"), grp.alias("grp")))
        return cls(data.sparkSession, names, sorted(e for e in pairs if e[::-1] not in pairs), both, rows, moments(rows) if names else {}, {(e["src"], e["dst"]): e["weight"] for e in found if e["weight"] is not None})

    # -- statistics

    def pooled(self) -> tuple[int, np.ndarray]:
        """(n, correlation) of all rows, shrunk where it isn't positive definite."""
        n = sum(k for k, *_ in self.parts.values())
        mean = sum(k * m for k, m, _ in self.parts.values()) / n
        s = sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in self.parts.values()) / (n - 1)
        return n, self._definite(_correlation(s), n, mean, np.sqrt(np.diag(s)))

    def by_group(self, g: int) -> tuple[int, np.ndarray]:
        n, mean, c = self.parts[g]
        return n, self._definite(_correlation(c), n, mean, np.sqrt(np.diag(c)), g)

    def _definite(self, r: np.ndarray, n: int, mean: np.ndarray, sd: np.ndarray, g: int | None = None) -> np.ndarray:
        if not len(r) or kernels.positive(r):
            return r
        def squares(x, obs):
            z = ((x - mean) / np.where(sd > 0, sd, 1)) ** 2
            return (z.T @ z).ravel()

        rows = self.rows if g is None else self.rows.where(F.col("grp") == g)
        return kernels.shrunk(r, n, added(rows, len(r) ** 2, squares).reshape(r.shape) / n)[0]

    @property
    def parents(self) -> dict[int, list[int]]:
        return dict(enumerate(learning.parents(self.directed, len(self.names))))

    # -- fits

    def _fitted(self, r: np.ndarray, n: int, algo: str, directed=None, both=None) -> tuple[list[tuple], np.ndarray, int]:
        """Rows (lhs, op, rhs, estimate, error) over places, the implied matrix and the number of parameters."""
        directed, both = self.directed if directed is None else directed, self.both if both is None else both
        p = len(r)
        if algo == "cggm":
            found = kernels.node_wise(r, dict(enumerate(learning.parents(directed, p))), n)
            beta = np.zeros((p, p))
            for j, k, b, _ in found:
                beta[j, k] = b
            own = (np.eye(p) - beta) @ r @ (np.eye(p) - beta).T
            inv = np.linalg.inv(np.eye(p) - beta)
            sigma = inv @ np.diag(np.diag(own)) @ inv.T
            rows = [(j, "~", k, b, se) for j, k, b, se in found] + [(j, "~~", j, own[j, j], own[j, j] * math.sqrt(2 / n)) for j in range(p)]
            return rows, sigma, len(directed) + p
        beta, omega, sigma, _ = kernels.ricf(r, directed, both)
        places = [("~", b, a) for a, b in directed] + [("~~", b, a) for a, b in both] + [("~~", j, j) for j in range(p)]
        se = kernels.information_errors(beta, omega, n, places)
        return [(i, op, j, float((beta if op == "~" else omega)[i, j]), float(e)) for (op, i, j), e in zip(places, se, strict=True)], sigma, len(places)

    def estimates(self, algo: str = "ml", group: int | None = None) -> list[tuple]:
        """Rows of ``ESTIMATES`` of the common model, or of one group's."""
        n, r = self.pooled() if group is None else self.by_group(group)
        return [_row(self.names[i], op, self.names[j], b, se) for i, op, j, b, se in self._fitted(r, n, ALGORITHMS[algo])[0]]

    def indices(self, algo: str = "ml") -> dict[str, float]:
        n, r = self.pooled()
        _, sigma, npar = self._fitted(r, n, ALGORITHMS[algo])
        return kernels.all_indices(r, sigma, n, npar)

    def node_effects(self, algo: str = "ml") -> tuple[list[tuple], dict[str, float], tuple[float, float]]:
        """(rows node ~ group, fit indices, combined p of activation and of inhibition): the group points at every node."""
        n, r = learning.with_group(self.parts)
        p = len(r)
        directed = [(0, k) for k in range(1, p)] + [(a + 1, b + 1) for a, b in self.directed]
        if ALGORITHMS[algo] == "ricf":
            t, pv, fit, corr = learning.perturbed(r, n, self.directed)
            rows = [(self.names[k], "~", "group", float(x), 1.0, float(x), q, x - 1.96, x + 1.96) for k, (x, q) in enumerate(zip(t, pv, strict=True))]
        else:
            both = [(a + 1, b + 1) for a, b in self.both]
            found, sigma, npar = self._fitted(r, n, ALGORITHMS[algo], directed, both)
            rows = [_row(self.names[i - 1], "~", "group", b, se) for i, op, j, b, se in found if op == "~" and j == 0]
            fit = kernels.all_indices(r, sigma, n, npar)
            corr = r[1:, 1:]
        order = {v: k for k, v in enumerate(self.names)}
        rows.sort(key=lambda x: order[x[0]])
        z, pv = np.array([x[5] for x in rows]), np.array([x[6] for x in rows])
        return rows, fit, (learning.combined(pv, np.sign(z), "positive", corr), learning.combined(pv, np.sign(z), "negative", corr))

    def edge_differences(self, algo: str = "ml") -> tuple[list[tuple], tuple[float, float]]:
        """(rows of path differences between the groups, combined p of activation and of inhibition)."""
        one, zero = ({(x[0], x[2]): x for x in self.estimates(algo, g) if x[1] == "~"} for g in (1, 0))
        rows = [_row(*e[:1], "~", e[1], one[e][3] - zero[e][3], math.hypot(one[e][4], zero[e][4])) for e in one]
        pv, d = np.array([x[6] for x in rows]), np.array([x[3] for x in rows])
        return rows, (learning.combined(pv, np.sign(d), "positive"), learning.combined(pv, np.sign(d), "negative")) if rows else (1.0, 1.0)

    # -- resampling

    def bootstrap(self, reps: int = 1000, by_group: bool = False) -> DataFrame:
        """Errors of the paths and covariances from Poisson-weighted refits of the mixed model, as ``ESTIMATES``.

        One pass over the rows adds up the weighted moments of all replicates; replicates are fitted where these meet.
        """
        import pyarrow as pa

        p, names, directed, both = len(self.names), self.names, self.directed, self.both
        low = np.tril_indices(p)
        size = 1 + p + len(low[0])
        places = [("~", b, a) for a, b in directed] + [("~~", b, a) for a, b in both]

        def run(batches):
            sums = {0: np.zeros((reps, size)), 1: np.zeros((reps, size))}
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, p)
                    full = np.column_stack([np.ones(len(x)), x, x[:, low[0]] * x[:, low[1]]])
                    w, grp = poisson_weights(np.asarray(batch.column(0).to_pylist(), np.int64).astype(np.uint64), reps), np.asarray(batch.column(2).to_pylist())
                    for g in sums:
                        if (grp == g).any() if by_group else g == 0:
                            who = grp == g if by_group else slice(None)
                            sums[g] += w[who].T @ full[who]
            for g, s in sums.items():
                if s.any():
                    yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), pa.array([g] * reps, pa.int32()), pa.array([r.tobytes() for r in s], pa.binary())], names=["rep", "g", "sums"])

        def fit(table: pa.Table) -> pa.Table:
            total: dict[int, np.ndarray] = {}
            for g, s in zip(table.column("g").to_pylist(), table.column("sums").to_pylist(), strict=True):
                total[g] = total.get(g, 0) + np.frombuffer(s)
            found = []
            for g in sorted(total):
                s = total[g]
                mean, c = s[1 : 1 + p] / s[0], np.zeros((p, p))
                c[low] = s[1 + p :] / s[0]
                c = c + np.tril(c, -1).T - np.outer(mean, mean)
                beta, omega, *_ = kernels.ricf(_correlation(c), directed, both)
                found.append([float((beta if op == "~" else omega)[i, j]) for op, i, j in places])
            values = [b - a for a, b in zip(*found, strict=True)] if by_group else found[0]
            return pa.table({"k": pa.array(range(len(places)), pa.int32()), "b": pa.array(values, pa.float64())})

        drawn = self.rows.select("obs", "x", "grp").mapInArrow(run, "rep int, g int, sums binary").groupBy("rep").applyInArrow(fit, "k int, b double")
        spread = {r["k"]: r["se"] for r in drawn.groupBy("k").agg(F.stddev_samp("b").alias("se")).collect()}  # one row for each parameter
        if by_group:
            one, zero = ({x[:3]: x[3] for x in self.estimates("ricf", g)} for g in (1, 0))
            base = {k: one[k] - zero[k] for k in one}
        else:
            base = {x[:3]: x[3] for x in self.estimates("ricf")}
        keys = [(names[i], op, names[j]) for op, i, j in places]
        return frame(self.spark, [_row(*k, base[k], spread.get(n) or 0.0) for n, k in enumerate(keys)])

    # -- whole runs

    def run(self, fit: int | None = None, algo: str = "ml", n_rep: int = 0) -> dict[str, DataFrame]:
        """``fit`` (estimates), ``indices``, and for groups ``gest`` (nodes) or ``dest`` (paths) with ``combined`` p-values.

        Without two groups the common model is fitted; with them fit 1 unless 2 is asked for.
        """
        kind = ALGORITHMS[algo]
        fit = 0 if len(self.parts) < 2 else (fit or 1)
        if fit == 0:
            table = self.bootstrap(n_rep) if kind == "ricf" and n_rep else frame(self.spark, self.estimates(algo))
            return {"fit": table, "indices": self._indices(self.indices(algo))}
        if fit == 1:
            rows, found, tails = self.node_effects(algo)
            return {"fit": frame(self.spark, self.estimates(algo)), "gest": frame(self.spark, rows), "indices": self._indices(found), "combined": self._tails(tails)}
        if fit == 2:
            rows, tails = self.edge_differences(algo)
            both = [(*x, g) for g in (0, 1) for x in self.estimates(algo, g)]
            dest = self.bootstrap(n_rep, True) if kind == "ricf" and n_rep else frame(self.spark, rows)
            return {"fit": self.spark.createDataFrame(both, f"{ESTIMATES}, grp int"), "dest": dest, "combined": self._tails(tails)}
        raise ValueError("fit is 0, 1 or 2")

    def _indices(self, found: dict[str, float]) -> DataFrame:
        return self.spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found))

    def _tails(self, tails: tuple[float, float]) -> DataFrame:
        return self.spark.createDataFrame([("activation", float(tails[0])), ("inhibition", float(tails[1]))], "tail string, pvalue double")

    def summary(self, algo: str = "ml") -> str:
        """The common model as text: fit, regressions, covariances, variances."""
        found, rows = self.indices(algo), self.estimates(algo)
        lines = [f"{algo.upper()} solution: {len(self.names)} nodes, {len(self.directed)} directed and {len(self.both)} bidirected edges, {found['n']:.0f} rows", f"deviance/df {found['dev'] / found['df'] if found['df'] else math.nan:.4f}  srmr {found['srmr']:.4f}  rmsea {found['rmsea']:.4f}"]
        for title, keep in (("Regressions", lambda x: x[1] == "~"), ("Covariances", lambda x: x[1] == "~~" and x[0] != x[2]), ("Variances", lambda x: x[1] == "~~" and x[0] == x[2])):
            lines += [f"{title}:", *(f"  {a:>12} {op:<2} {b:<12} {est:9.4f} {se:8.4f} {z:8.3f} {pv:7.4f}" for a, op, b, est, se, z, pv, *_ in rows if keep((a, op, b)))]
        return "\n".join(lines)

    def colored(self, alpha: float = 0.05, method: str = "BH", algo: str = "ml") -> tuple[DataFrame, DataFrame]:
        """(nodes name, color; edges src, dst, color, width): pink or red where positive and significant, else blue, else plain."""
        one, *_ = self.node_effects(algo) if len(self.parts) == 2 else ([], None, None)
        nodes = [(x[0], "white" if q >= alpha else "pink" if x[3] > 0 else "lightblue") for x, q in zip(one, learning.adjusted([x[6] for x in one], method), strict=True)]
        paths = [x for x in self.estimates(algo) if x[1] == "~"]
        edges = [(x[2], x[0], "gray" if q >= alpha else "red2" if x[3] > 0 else "royalblue3", 1.0 if q >= alpha else 2.0) for x, q in zip(paths, learning.adjusted([x[6] for x in paths], method), strict=True)]
        return self.spark.createDataFrame(nodes, "name string, color string"), self.spark.createDataFrame(edges, "src string, dst string, color string, width double")

    def starts(self, a: float = 0.1) -> DataFrame:
        """Start values: ``a`` times the weight of an edge, half of that for covariances, whose two weights count together."""
        rows = [(self.names[j], "~", self.names[i], a * self.weights.get((self.names[i], self.names[j]), 0.0)) for i, j in self.directed]
        for i, j in self.both:
            w = self.weights.get((self.names[i], self.names[j]), 0.0) + self.weights.get((self.names[j], self.names[i]), 0.0)
            rows.append((self.names[j], "~~", self.names[i], a * w / 2))
        return self.spark.createDataFrame(rows, "lhs string, op string, rhs string, start double")

    # -- weights

    def weighted(self, method: str = "r2z", seed: int = 1) -> tuple[DataFrame, DataFrame]:
        """(edges src, dst, zsign, pv; nodes name, zsign, pv) of the giant component.

        r2z: Fisher's z of the correlation, with groups of its difference; sem and cov: shifts of both ends (and of the
        covariance); cfa: the group's shift of the common factor; lmi: the slope's difference. All but r2z need groups. A p-value that can't be
        had is drawn from a hash of the edge; all lie within 1e-15 of 0 and 1.
        """
        grouped = len(self.parts) == 2
        if method != "r2z" and not grouped:
            raise ValueError(f"{method} needs two groups")
        every = [(i, j) for i, j in self.directed] + [e for i, j in self.both for e in ((i, j), (j, i))]
        label = communities.parts(communities.adjacency(every, len(self.names)))
        giant = max(sorted(set(label)), key=label.count) if label else 0
        degree = np.bincount([v for e in every for v in e], minlength=len(self.names))
        edges = []
        for i, j in every:
            if label[i] != giant:
                continue
            z = edge_z(self._scaled(i, j), method, degree[i], degree[j], grouped)
            pv = 2 * kernels.normal_survival(abs(z)) if z is not None and math.isfinite(z) else 0.05 + 0.9 * _uniform(seed, self.names[i], self.names[j])
            edges.append((self.names[i], self.names[j], 0 if z is None or not abs(z) >= 1.96 else int(math.copysign(1, z)), float(min(max(pv, 1e-15), 1 - 1e-15))))
        nodes = []
        if grouped:
            n, r = learning.with_group(self.parts)
            for k, v in enumerate(self.names):
                if label[k] == giant:
                    t = r[0, k + 1] * math.sqrt((n - 2) / max(1 - r[0, k + 1] ** 2, 1e-15))
                    nodes.append((v, 0 if abs(t) < 2 else int(math.copysign(1, t)), float(2 * kernels.student_survival(abs(t), n - 2))))
        return self.spark.createDataFrame(edges, "src string, dst string, zsign int, pv double"), self.spark.createDataFrame(nodes, "name string, zsign int, pv double")

    def _scaled(self, i: int, j: int) -> dict[int, tuple]:
        """Moments by group of two columns, scaled over all rows."""
        n = sum(k for k, *_ in self.parts.values())
        at = np.array([i, j])
        mean = sum(k * m[at] for k, m, _ in self.parts.values()) / n
        s = sum((k - 1) * c[np.ix_(at, at)] + k * np.outer(m[at] - mean, m[at] - mean) for k, m, c in self.parts.values()) / (n - 1)
        sd = np.sqrt(np.diag(s))
        return {g: (k, (m[at] - mean) / sd, c[np.ix_(at, at)] / np.outer(sd, sd)) for g, (k, m, c) in self.parts.items()}


def edge_z(parts: dict[int, tuple], method: str, deg_x: int, deg_y: int, grouped: bool) -> float | None:
    """The z of an edge x -> y, from the moments by group of x and y (columns scaled over all rows)."""
    n = sum(k for k, *_ in parts.values())
    corr = lambda c: c[0, 1] / math.sqrt(c[0, 0] * c[1, 1])
    if method == "r2z":
        if not grouped:
            mean = sum(k * m for k, m, _ in parts.values()) / n
            c = sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values())
            return math.atanh(np.clip(corr(c), -0.9999999, 0.9999999)) * math.sqrt(n - 3)
        (n0, _, c0), (n1, _, c1) = parts[0], parts[1]
        z = [math.atanh(np.clip(corr(c), -0.9999999, 0.9999999)) for c in (c0, c1)]
        return (z[1] - z[0]) / math.sqrt(1 / (n1 - 3) + 1 / (n0 - 3))
    (n0, m0, c0), (n1, m1, c1) = parts[0], parts[1]
    a = c1 * (n1 - 1) / n1, c0 * (n0 - 1) / n0  # maximum-likelihood moments of the groups
    d = m1 - m0
    if method == "sem":
        # y = b0 + b1 g, x = a0 + a1 g with correlated errors: w = a1 / deg x + b1 / deg y
        rest = (n1 * a[0] + n0 * a[1]) / n
        w = np.array([1 / deg_x, 1 / deg_y])
        var = w @ rest @ w * (1 / n1 + 1 / n0)
        return float(w @ d / math.sqrt(var))
    if method == "cov":
        # shifts of the means and of the covariance, which are independent in normal data
        w = np.array([1 / deg_x, 1 / deg_y])
        var = sum(w @ s @ w / k + (s[0, 0] * s[1, 1] + s[0, 1] ** 2) / k for s, k in ((a[0], n1), (a[1], n0)))
        return float((w @ d + a[0][0, 1] - a[1][0, 1]) / math.sqrt(var))
    if method == "cfa":
        # one factor with loadings a = sqrt(cov), errors 1 - a^2: the half sum of the two columns carries all that is free
        gap = n1 * n0 / n / (n - 1)
        total = ((n1 - 1) * c1 + (n0 - 1) * c0) / (n - 1) + gap * np.outer(d, d)
        sign = -1.0 if total[0, 1] < 0 else 1.0
        load2 = abs(total[0, 1])
        half = np.array([sign, 1.0]) / 2
        rest = half @ (n1 * a[0] + n0 * a[1]) @ half / n
        if load2 <= 0 or rest - (1 - load2) / 2 < 0:  # no factor, or one of negative variance
            return None
        return float(half @ d / math.sqrt(rest * (1 / n1 + 1 / n0)))
    if method == "lmi":
        slopes = [(c[0, 1] / c[0, 0], (k - 1) * (c[1, 1] - c[0, 1] ** 2 / c[0, 0]), (k - 1) * c[0, 0]) for k, c in ((n1, c1), (n0, c0))]
        error = sum(s[1] for s in slopes) / (n - 4)
        return float((slopes[0][0] - slopes[1][0]) / math.sqrt(error * sum(1 / s[2] for s in slopes)))
    raise ValueError(method)


def poisson_weights(obs: np.ndarray, reps: int) -> np.ndarray:
    """Weights of rows (by id) in each replicate: Poisson draws from a hash of id and replicate."""
    key = obs[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(reps, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    u = ((key ^ (key >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), u).astype(float)


def model_simulated_p(spark: SparkSession, df: int, n: int, chi: float, reps: int = 10_000, seed: int = 1) -> tuple[float, float]:
    """(share of simulated deviances at or above ``chi``, its chi-square p): independence models with ``df`` degrees of freedom."""
    v = math.ceil((math.sqrt(1 + 8 * df) - 1) / 2)
    free = v * (v + 1) // 2 - df

    def run(frames):
        for frame_ in frames:
            hits = 0
            for i in frame_["id"]:
                x = np.random.Generator(np.random.Philox(key=[seed, int(i)])).standard_normal((n, v))
                s = np.cov(x, rowvar=False).reshape(v, v)
                d = np.ones(v)
                d[:free] = np.diag(s)[:free]
                hits += (n - 1) * (np.log(d).sum() + (np.diag(s) / d).sum() - np.linalg.slogdet(s)[1] - v) >= chi
            yield pd.DataFrame({"hits": [hits]})

    hits = spark.range(reps).mapInPandas(run, "hits long").agg(F.sum("hits")).first()[0] or 0
    return hits / reps, kernels.chi2_survival(chi, df)


def _correlation(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(c))
    d = np.where(d > 0, d, 1)
    return c / np.outer(d, d)


def _row(lhs: str, op: str, rhs: str, est: float, se: float) -> tuple:
    z = est / se if se else 0.0
    return lhs, op, rhs, float(est), float(se), float(z), 2 * kernels.normal_survival(abs(z)) if se else 1.0, float(est - 1.96 * se), float(est + 1.96 * se)


def frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), ESTIMATES)


def _uniform(seed: int, *names: str) -> float:
    import zlib

    return zlib.crc32("|".join([str(seed), *names]).encode()) / 2**32
