"""Searches over graphs and models on correlations: separation tests, adjustment sets, group perturbation, module scores,
ordinal associations and spline pair scores. Numpy only.

Nodes are 0 .. p-1, ``edges`` are (from, to) pairs of a directed graph, ``r`` a correlation matrix and ``n`` its rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

from . import kernels

Edge = tuple[int, int]

# -- graphs


def parents(edges: list[Edge], p: int) -> list[list[int]]:
    into: list[list[int]] = [[] for _ in range(p)]
    for a, b in sorted(set(edges)):
        into[b].append(a)
    return into


def distances(edges: list[Edge], p: int) -> np.ndarray:
    """Lengths of shortest directed paths; infinite where there is none, 0 to the node itself."""
    out: list[list[int]] = [[] for _ in range(p)]
    for a, b in edges:
        out[a].append(b)
    d = np.full((p, p), np.inf)
    for s in range(p):
        d[s, s], front, k = 0, [s], 0
        while front:
            k += 1
            front = [b for b in {b for a in front for b in out[a]} if np.isinf(d[s, b])]
            d[s, front] = k
    return d


def acyclic(edges: list[Edge], p: int, strength: np.ndarray) -> list[Edge]:
    """The edges that stay when, from the strongest on, each is taken unless it closes a cycle."""
    taken: list[Edge] = []
    before = np.eye(p, dtype=bool)  # before[a, b]: b can be reached from a
    for a, b in sorted(set(edges), key=lambda e: (-abs(strength[e]), e)):
        if a != b and not before[b, a]:
            taken.append((a, b))
            before |= np.outer(before[:, a], before[b])
    return sorted(taken)


def separated(edges: list[Edge], p: int, x: int, y: int, given: set[int], d: np.ndarray | None = None) -> bool:
    """d-separation: x and y fall apart in the moral graph of the ancestors once ``given`` is taken out. ``d`` are known distances."""
    d = distances(edges, p) if d is None else d
    kept = {v for v in range(p) if any(np.isfinite(d[v, t]) for t in {x, y} | given)}
    near: dict[int, set[int]] = {v: set() for v in kept}
    for v, pa in enumerate(parents(edges, p)):
        if v in kept:
            for a, b in itertools.combinations([*pa, v], 2):
                near[a].add(b)
                near[b].add(a)
    seen, front = {x}, [x]
    while front:
        front = [b for a in front for b in near[a] if b not in seen and b not in given]
        if y in front:
            return False
        seen.update(front)
    return True


def separator(edges: list[Edge], p: int, x: int, y: int, most: int = 3, d: np.ndarray | None = None) -> tuple[int, ...] | None:
    """The smallest separating set of ancestors, at most ``most`` nodes; None where there is none."""
    d = distances(edges, p) if d is None else d
    pool = [v for v in range(p) if v not in (x, y) and (np.isfinite(d[v, x]) or np.isfinite(d[v, y]))]
    return next((z for k in range(most + 1) for z in itertools.combinations(pool, k) if separated(edges, p, x, y, set(z), d)), None)


def adjustment(edges: list[Edge], p: int, x: int, y: int, kind: str) -> list[int]:
    """Nodes to hold fixed for the total effect of x on y: the parents of x, or the set of least variance ("optimal")."""
    pa = parents(edges, p)
    if kind == "parents":
        return pa[x]
    if kind != "optimal":
        raise ValueError(kind)
    d = np.isfinite(distances(edges, p))
    causal = [v for v in range(p) if v != x and d[x, v] and d[v, y]]
    forbidden = {v for c in causal for v in range(p) if d[c, v]} | {x}
    return sorted({v for c in causal for v in pa[c]} - forbidden)


# -- tests


def partial(r: np.ndarray, x: int, y: int, given: list[int]) -> float:
    k = np.linalg.pinv(r[np.ix_([x, y, *given], [x, y, *given])])
    return float(np.clip(-k[0, 1] / math.sqrt(k[0, 0] * k[1, 1]), -0.9999999, 0.9999999))


def not_close(value: float, n: int, q: int, null: float = 0.05) -> tuple[float, float, float]:
    """(p, lower, upper) of a partial correlation, against those that are at most ``null`` in size."""
    se = 1 / math.sqrt(n - 3 - q)
    z, delta = abs(math.atanh(value)) / se, math.atanh(null) / se
    p = kernels.normal_survival(z - delta) + kernels.normal_survival(z + delta)
    return p, math.tanh(math.atanh(value) - 1.96 * se), math.tanh(math.atanh(value) + 1.96 * se)


def missing(edges: list[Edge], p: int) -> list[Edge]:
    there = {frozenset(e) for e in edges}
    return [e for e in itertools.combinations(range(p), 2) if frozenset(e) not in there]


def basis_test(r: np.ndarray, n: int, edges: list[Edge], pair: Edge) -> tuple[int, float, float, float, float]:
    """(conditioning nodes, partial correlation, p, lower, upper) of a missing edge, given the parents of both ends."""
    pa = parents(edges, len(r))
    given = sorted({*pa[pair[0]], *pa[pair[1]]} - set(pair))
    value = partial(r, *pair, given)
    return len(given), value, *not_close(value, n, len(given))


def fisher(p: list[float]) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p)."""
    c = -2 * sum(math.log(x + 1e-16) for x in p)
    return c, 2 * len(p), kernels.chi2_survival(c, 2 * len(p)) if p else 1.0


# Covariances of -2 log p of two correlated tests, at correlations -1, -0.9, ..., 1.
BROWN = [-2.59, -2.382, -2.17, -1.946, -1.709, -1.458, -1.194, -0.916, -0.625, -0.320, 0, 0.334, 0.681, 1.044, 1.421, 1.812, 2.219, 2.641, 3.079, 3.531, 4]


def combined(p: np.ndarray, sign: np.ndarray, tail: str, r: np.ndarray | None = None) -> float:
    """Combination of two-sided p-values, towards one side (tail "positive" or "negative") or as they are ("both").

    The sum of -2 log p of k independent tests is a chi-square with 2k degrees of freedom. For tests with correlations ``r`` a scaled
    chi-square of the same mean and variance stands in (Brown 1975), the variance from the published table. Required: values
    of 1 and missing ones do not take part; correlation never counts as more than independence; a result that underflows is
    the Bonferroni bound of the least value. A value that has underflowed to 0 counts as 1e-300.
    """
    p, towards = np.asarray(p, float), np.asarray(sign) > 0
    use = np.flatnonzero(p < 1)
    if not len(use):
        return 1.0
    p = np.maximum(p[use], 1e-300)
    if tail != "both":
        with_tail = towards[use] == (tail == "positive")
        p = np.where(with_tail, 0.5 * p, 1 - 0.5 * p)
    k, total, spread = len(use), -2 * float(np.log(p).sum()), 0.0
    if r is not None:
        table = np.interp(r[np.ix_(use, use)], np.linspace(-1, 1, len(BROWN)), BROWN)
        spread = float(table.sum() - np.trace(table)) / (4 * k)  # how much the variance exceeds that of independent tests, relatively
    inflation = max(1 + spread, 1.0)
    found = kernels.chi2_survival(total / inflation, 2 * k / inflation)
    return found or min(1.0, k * float(p.min()))


def adjusted(p: list[float], method: str = "BH") -> list[float]:
    m = len(p)
    if method == "bonferroni":
        return [min(1.0, x * m) for x in p]
    if method == "none":
        return list(p)
    if method != "BH":
        raise ValueError(method)
    out, low = [0.0] * m, 1.0
    for rank, k in sorted(enumerate(sorted(range(m), key=lambda i: p[i]), 1), reverse=True):
        low = min(low, p[k] * m / rank)
        out[k] = low
    return out


# -- models


def with_group(parts: dict[int, tuple]) -> tuple[int, np.ndarray]:
    """(n, correlation) of the group indicator, at place 0, and all columns."""
    n = sum(k for k, *_ in parts.values())
    mean = sum(k * m for k, m, _ in parts.values()) / n
    within = sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values()) / (n - 1)
    n1 = parts[1][0]
    cross = n1 * (parts[1][1] - mean) / (n - 1)
    s = np.block([[np.array([[n1 * (n - n1) / n / (n - 1)]]), cross[None, :]], [cross[:, None], within]])
    d = np.sqrt(np.diag(s))
    return n, s / np.outer(d, d)


def perturbed(r: np.ndarray, n: int, edges: list[Edge]) -> tuple[list[float], list[float], dict[str, float], np.ndarray]:
    """(t, p, fit indices, residual correlations) of the nodes' own shift between groups; the group is at place 0 of ``r``.

    The group points at all nodes. A node's residual is what its parents leave; t is that of the residual against the group.
    Under all permutations of the group a correlation has mean 0 and variance 1 / (n - 1), so that the mean and the spread of
    t that repeated draws would estimate are known: 0 and sqrt((n - 2) / (n - 4)).
    """
    p = len(r)
    every = [(0, k) for k in range(1, p)] + [(a + 1, b + 1) for a, b in edges]
    beta, omega, sigma, _ = kernels.ricf(r, every, [])
    own = np.eye(p) - beta
    own[1:, 0] = 0  # the shift itself stays in the residual
    s = own @ r @ own.T
    d = np.sqrt(np.maximum(np.diag(s), 1e-300))
    corr = s / np.outer(d, d)
    c = np.clip(corr[0, 1:], -0.9999999, 0.9999999)
    t = c * np.sqrt((n - 2) / (1 - c * c))
    pv = [2 * kernels.normal_survival(abs(x) / math.sqrt((n - 2) / (n - 4))) for x in t]
    return [float(x) for x in t], pv, kernels.fit_indices(r, sigma, n, len(every) + p - 1, fixed=1), corr[1:, 1:]


def regression(s: np.ndarray, n: int, y: int, x: int, given: list[int]) -> tuple[float, float]:
    """(slope of y on x, standard error) with ``given`` held fixed, from second moments about zero."""
    cols = [x, *given]
    inv = np.linalg.pinv(s[np.ix_(cols, cols)])
    b = inv @ s[cols, y]
    rest = max(s[y, y] - b @ s[cols, y], 0.0) * n / max(n - len(cols), 1)
    return float(b[0]), math.sqrt(rest * inv[0, 0] / n)


def module_weights(s: np.ndarray, kind: str, sources: list[int] | None = None) -> np.ndarray | None:
    """Weights of the columns of a module whose weighted sum is its score, of unit variance.

    LV: scores of a one-factor model; CV: first principal component; UV: first component of what the sources explain
    (None without sources or without other nodes).
    """
    p = len(s)
    if kind == "LV":
        load, psi = kernels.factors(s, 1)
        w = load[:, 0] / psi
    elif kind == "CV":
        w = np.linalg.eigh(s)[1][:, -1]
    elif kind == "UV":
        rest = [k for k in range(p) if k not in (sources or [])]
        if not sources or not rest:
            return None
        b = np.linalg.pinv(s[np.ix_(sources, sources)]) @ s[np.ix_(sources, rest)]
        v = np.linalg.eigh(b.T @ s[np.ix_(sources, sources)] @ b)[1][:, -1]
        w = np.zeros(p)
        w[sources] = b @ v
    else:
        raise ValueError(kind)
    w = w * (1 if w.sum() >= 0 else -1)
    return w / math.sqrt(max(w @ s @ w, 1e-300))


def latent_count(r: np.ndarray, method: str = "knee", n: int = 1000, most: int = 10, seed: int = 1) -> int:
    """Number of hidden components by the singular values of the scaled data, which ``n`` rows and their correlations ``r`` give.

    "knee": the sharpest bend on the first half; "ed": eigenvalue gaps beyond the slope that the values after a candidate show
    (Onatski 2010); "ic": the least information criterion of 1 to ``most`` components (Bai and Ng 2002); "auto": values above the
    0.99 quantile of those of unrelated columns, of which 50 are drawn.
    """
    p = len(r)
    values = np.sort(np.maximum(np.linalg.eigvalsh(r), 0))[::-1]
    singular = np.sqrt(values * (n - 1))
    if method == "knee":
        half = singular[: max(len(singular) // 2, 3)]
        return int(np.abs(np.diff(half, 2)).argmax()) + 1 if len(half) > 2 else 1
    if method == "ed":
        limit, last = max(1, round(3 * math.sqrt(min(n, p)))), None
        limit = min(limit, p - 5)
        if limit < 1:
            return 1
        gaps, candidate = values[:limit] - values[1 : limit + 1], limit
        for _ in range(10):
            tail = values[candidate : candidate + 5]
            x = np.arange(candidate, candidate + len(tail)) ** (2 / 3)
            threshold = 2 * abs(float(np.cov(x, tail)[0, 1] / np.var(x, ddof=1))) if len(tail) > 1 else 0.0
            beyond = np.flatnonzero(gaps >= threshold)
            candidate = int(beyond[-1]) + 1 if len(beyond) else 0
            if candidate == last:
                break
            last = candidate
        return candidate
    if method == "ic":
        total = values.sum()
        penalty = (n + p) / (n * p) * math.log(n * p / (n + p))
        scores = [math.log(max(total - values[:k].sum(), 1e-300) / p) + k * penalty for k in range(1, min(most, p - 1) + 1)]
        return int(np.argmin(scores)) + 1
    if method == "auto":
        rng = np.random.default_rng(seed)
        rows = min(n, 1000)
        noise = (rng.standard_normal((rows, p)) for _ in range(50))
        drawn = np.sqrt([np.maximum(np.linalg.eigvalsh(np.corrcoef(x, rowvar=False))[::-1], 0) for x in noise])
        line = np.quantile(drawn, 0.99, axis=0)
        above = np.sqrt(values)[: len(line)] > line
        return int(min(most, above.argmin() if not above.all() else len(above)))
    raise ValueError(method)


# -- ordinal associations, from a table of counts


def kendall(table: np.ndarray) -> float:
    """Tau-b."""
    table = np.asarray(table, float)
    n = table.sum()
    below = table[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    left = table[::-1].cumsum(0)[::-1].cumsum(1)
    agree = (table[:-1, :-1] * below[1:, 1:]).sum()
    against = (table[:-1, 1:] * left[1:, :-1]).sum()
    pairs = n * (n - 1) / 2
    tx, ty = ((m * (m - 1) / 2).sum() for m in (table.sum(1), table.sum(0)))
    scale = math.sqrt((pairs - tx) * (pairs - ty))
    return float((agree - against) / scale) if scale else 0.0


def quantile(p: float) -> float:
    """Normal quantile by bisection on the distribution function."""
    low, high = -9.0, 9.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - kernels.normal_survival(mid) < p else (low, mid)
    return (low + high) / 2


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def bivariate(h: np.ndarray, k: np.ndarray, r: float) -> np.ndarray:
    """P(X < h, Y < k) of a standard bivariate normal for all pairs of bounds, by integrating the density over the correlation."""
    h, k = np.asarray(h, float)[:, None], np.asarray(k, float)[None, :]
    below = np.vectorize(lambda x: 1 - kernels.normal_survival(x))
    a = math.asin(r)
    t = np.sin(a * (1 + _NODES) / 2)
    inner = np.exp(-((h * h + k * k)[..., None] - 2 * (h * k)[..., None] * t) / (2 * (1 - t * t)))
    return below(h) * below(k) + inner @ _WEIGHTS * a / (4 * math.pi)


def polychoric(table: np.ndarray) -> float:
    """Maximum-likelihood correlation of the normal pair behind two ordinal codes; thresholds from the margins."""
    table = np.asarray(table, float)
    table = table[table.sum(1) > 0][:, table.sum(0) > 0]
    n = table.sum()
    cuts = [[-9.0, *[quantile(c) for c in np.cumsum(m)[:-1] / n], 9.0] for m in (table.sum(1), table.sum(0))]

    def loss(r: float) -> float:
        cell = np.maximum(np.diff(np.diff(bivariate(*cuts, r), axis=0), axis=1), 1e-12)
        return -float((table * np.log(cell)).sum())

    low, high, gold = -0.999, 0.999, (math.sqrt(5) - 1) / 2
    a, b = high - gold * (high - low), low + gold * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > 1e-7:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - gold * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + gold * (high - low)
            fb = loss(b)
    return (low + high) / 2


# -- additive pair scores

#: Knots of the cubic splines of a standardised column.
KNOTS = (-1.5, -0.75, 0.0, 0.75, 1.5)


def spline(z: np.ndarray) -> np.ndarray:
    """Features of a standardised column: the column, its square and cube, and truncated cubes at the knots."""
    return np.stack([z, z**2, z**3, *(np.maximum(z - k, 0) ** 3 for k in KNOTS)], axis=-1)


def smooth_residual(gram: np.ndarray, xy: np.ndarray, yy: float, n: int) -> float:
    """Residual variance of a penalised spline regression; the penalty on the bent features has the least GCV score."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    g, c = gram / np.outer(scale, scale), xy / scale
    bent = np.diag([1e-9] + [1.0] * (len(c) - 1))
    best = (np.inf, yy)
    for lam in 10.0 ** np.arange(-5, 5):
        inv = np.linalg.inv(g + lam * bent)
        b = inv @ c
        rest = max(yy - 2 * b @ c + b @ g @ b, 1e-12)
        dof = 1 + float(np.trace(inv @ g))
        best = min(best, (rest / (1 - dof / n) ** 2 if dof < n else np.inf, rest))
    return float(best[1])
