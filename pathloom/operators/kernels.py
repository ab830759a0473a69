"""Small dense numerics on sufficient statistics: one call per model, node, cluster or replicate. Numpy only.

``s`` is a covariance or correlation matrix, ``n`` the number of rows behind it.
"""

from __future__ import annotations

import math

import numpy as np


def positive(s: np.ndarray) -> bool:
    return bool(np.linalg.eigvalsh(s).min() > 1e-8)


def power(s: np.ndarray, exponent: float) -> np.ndarray:
    """A power of a symmetric matrix, on its positive part."""
    values, vectors = np.linalg.eigh(s)
    kept = values > 1e-10
    return (vectors[:, kept] * values[kept] ** exponent) @ vectors[:, kept].T


def shrunk(r: np.ndarray, n: int, fourth: np.ndarray) -> tuple[np.ndarray, float]:
    """Correlations shrunk to the identity; ``fourth`` has the means of squared products of standardised columns."""
    off = ~np.eye(len(r), dtype=bool)
    spread = (n / (n - 1) ** 3) * n * (fourth - (r * (n - 1) / n) ** 2)
    rate = float(np.clip(spread[off].sum() / max((r[off] ** 2).sum(), 1e-300), 0, 1))
    return np.where(off, (1 - rate) * r, r), rate


def dag_ols(s: np.ndarray, parents: dict[int, list[int]], n: int) -> list[tuple[int, int, float, float]]:
    """(child, parent, estimate, standard error): maximum likelihood of a recursive model."""
    out = []
    for j, pa in parents.items():
        if pa:
            inv = np.linalg.pinv(s[np.ix_(pa, pa)])
            b = inv @ s[pa, j]
            rest = max(s[j, j] - b @ s[pa, j], 0.0)
            out += [(j, k, float(x), math.sqrt(rest * v / n)) for k, x, v in zip(pa, b, np.diag(inv), strict=True)]
    return out


def node_wise(s: np.ndarray, parents: dict[int, list[int]], n: int) -> list[tuple[int, int, float, float]]:
    """(child, parent, estimate, standard error) of de-biased regressions: a lasso, corrected by the parents' sparse precision."""
    out = []
    for j, pa in parents.items():
        if not pa:
            continue
        x, xy = s[np.ix_(pa, pa)], s[pa, j]
        if len(pa) > 1:
            lam = math.sqrt(math.log(len(pa) + 1) / n) if len(pa) + 1 > n else 1e-3
            b, wi = lasso(x, xy, lam), glasso(x, lam)[1] / n
            b = b + wi @ (xy - x @ b)
        else:
            b, wi = xy / np.diag(x), np.array([[1 / (n * x[0, 0])]])
        rest = math.sqrt(max(s[j, j] - 2 * b @ xy + b @ x @ b, 0))
        out += [(j, k, float(v), rest * math.sqrt(wi[i, i])) for i, (k, v) in enumerate(zip(pa, b, strict=True))]
    return out


def ricf(s: np.ndarray, directed: list[tuple[int, int]], bidirected: list[tuple[int, int]], tol: float = 1e-6, most: int = 500):
    """Residual iterative conditional fitting of a mixed graph: (B, Omega, Sigma, iterations)."""
    p = len(s)
    pa = [[a for a, c in directed if c == j] for j in range(p)]
    sp = [[b if a == j else a for a, b in bidirected if j in (a, b)] for j in range(p)]
    beta, omega = np.zeros((p, p)), np.diag(np.diag(s)).astype(float)
    for step in range(1, most + 1):
        before = beta.copy(), omega.copy()
        for j in range(p):
            if not pa[j] and not sp[j]:
                continue
            rest = [k for k in range(p) if k != j]
            # pseudo-variables: rows of Omega_{-j}^{-1} (I - B) that belong to the spouses
            z = (np.linalg.solve(omega[np.ix_(rest, rest)], (np.eye(p) - beta)[rest]))[[rest.index(k) for k in sp[j]]] if sp[j] else np.zeros((0, p))
            design = np.vstack([np.eye(p)[pa[j]], z])
            coef = np.linalg.lstsq(design @ s @ design.T, design @ s[:, j], rcond=None)[0]
            rest_var = s[j, j] - coef @ (design @ s[:, j])
            beta[j] = 0
            beta[j, pa[j]] = coef[: len(pa[j])]
            w = coef[len(pa[j]) :]
            omega[j, sp[j]] = omega[sp[j], j] = w
            inner = np.linalg.inv(omega[np.ix_(rest, rest)])[np.ix_([rest.index(k) for k in sp[j]], [rest.index(k) for k in sp[j]])] if sp[j] else np.zeros((0, 0))
            omega[j, j] = rest_var + w @ inner @ w
        if np.abs(beta - before[0]).sum() + np.abs(omega - before[1]).sum() < tol:
            break
    else:
        raise RuntimeError(f"no fit within {most} iterations")
    inv = np.linalg.inv(np.eye(p) - beta)
    return beta, omega, inv @ omega @ inv.T, step


def fit_indices(s: np.ndarray, sigma: np.ndarray, n: int, npar: int, fixed: int = 0) -> dict[str, float]:
    p = len(s)
    df = p * (p + 1) // 2 - npar - fixed * (fixed + 1) // 2
    d = np.linalg.svd(s, compute_uv=False)
    d = d[d > 1e-18]
    dev = n * (np.linalg.slogdet(sigma)[1] + np.trace(s @ np.linalg.inv(sigma)) - np.log(d).sum() - p)
    low = np.tril_indices(p)
    return {"dev": float(dev), "df": df, "srmr": float(np.sqrt(((s - sigma)[low] ** 2).mean())), "rmsea": math.sqrt(max(dev - df, 0) / (df * (n - 1))) if df else 0.0, "n": n, "npar": npar}


def all_indices(s: np.ndarray, sigma: np.ndarray, n: int, npar: int, fixed: int = 0) -> dict[str, float]:
    """``fit_indices`` with what compares to the model of independence (cfi, tli), the ULS goodness of fit and the p of a close rmsea."""
    out = fit_indices(s, sigma, n, npar, fixed)
    p = len(s)
    base, base_df = max(-n * np.linalg.slogdet(s)[1], 0.0), p * (p - 1) / 2
    dev, df = out["dev"], out["df"]
    worst = max(base - base_df, dev - df, 1e-12)
    out["cfi"] = 1 - max(dev - df, 0.0) / worst
    out["tli"] = (base / base_df - dev / df) / (base / base_df - 1) if df and base_df and base != base_df else 1.0
    out["gfi"] = 1 - float(((s - sigma) ** 2).sum() / (s**2).sum())
    out["p_rmsea"] = noncentral_survival(dev, df, 0.05**2 * n * df) if df else 1.0
    return out


def noncentral_survival(x: float, df: float, ncp: float) -> float:
    """Survival of a noncentral chi-square: Poisson mixture of central ones around its largest weights."""
    half, start = ncp / 2, int(ncp / 2)
    total = weights = 0.0
    for way in (range(start, start + 2000), range(start - 1, -1, -1)):
        for k in way:
            w = math.exp(-half + k * math.log(half) - math.lgamma(k + 1)) if half > 0 else float(k == 0)
            total, weights = total + w * chi2_survival(x, df + 2 * k), weights + w
            if w < 1e-14:
                break
    return min(1.0, total / weights) if weights else 1.0


def information_errors(beta: np.ndarray, omega: np.ndarray, n: int, places: list[tuple[str, int, int]]) -> np.ndarray:
    """Standard errors of paths ("~", child, parent) and (co)variances ("~~", i, j) from the expected information."""
    p = len(beta)
    inv = np.linalg.inv(np.eye(p) - beta)
    sigma = inv @ omega @ inv.T
    white = power(sigma, -0.5)
    rows = []
    for op, i, j in places:
        if op == "~":
            change = np.outer(inv[:, i], sigma[j])
            change = change + change.T
        else:
            change = np.outer(inv[:, i], inv[:, j])
            change = change + change.T if i != j else change
        rows.append((white @ change @ white).ravel())
    if not rows:
        return np.zeros(0)
    g = np.array(rows)
    return np.sqrt(np.maximum(np.diag(np.linalg.pinv(n / 2 * g @ g.T)), 0))


def correlated_columns(r: np.ndarray, cutoff: float = 0.99) -> list[int]:
    """Columns to drop so that no pair correlates above the cutoff: of the strongest pair left, the one nearer to all others."""
    a, out = np.abs(r).copy(), []
    np.fill_diagonal(a, 0)
    left = list(range(len(r)))
    while len(left) > 1:
        sub = a[np.ix_(left, left)]
        i, j = np.unravel_index(sub.argmax(), sub.shape)
        if sub[i, j] <= cutoff:
            break
        out.append(left.pop(int(i) if sub[i].mean() >= sub[j].mean() else int(j)))
    return sorted(out)


def lasso(gram: np.ndarray, xy: np.ndarray, lam: float, weights: np.ndarray | None = None, tol: float = 1e-9, most: int = 2000) -> np.ndarray:
    """Coordinate descent for 1/2 b'Gb - b'xy + lam * sum(w |b|); weights are scaled to add up to their number."""
    w = np.ones(len(xy)) if weights is None else np.asarray(weights, float)
    if w.sum() == 0 or lam == 0:
        return np.linalg.pinv(gram) @ xy
    w = w * len(w) / w.sum()
    b = np.zeros(len(xy))
    for _ in range(most):
        moved = 0.0
        for k in range(len(b)):
            r = xy[k] - gram[k] @ b + gram[k, k] * b[k]
            new = math.copysign(max(abs(r) - lam * w[k], 0.0), r) / gram[k, k] if gram[k, k] > 0 else 0.0
            moved = max(moved, abs(new - b[k]))
            b[k] = new
        if moved < tol:
            return b
    raise RuntimeError(f"no lasso fit within {most} sweeps")


def glasso(s: np.ndarray, rho: float, zero: set[tuple[int, int]] | None = None, tol: float = 1e-6, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) by block coordinate descent; the diagonal is penalised, ``zero`` pairs have precision 0."""
    p = len(s)
    w = s + rho * np.eye(p)
    betas = np.zeros((p, p))
    for _ in range(most):
        old = w.copy()
        for j in range(p):
            rest = [k for k in range(p) if k != j]
            free = [k for k in rest if not zero or ((j, k) not in zero and (k, j) not in zero)]
            b = lasso(w[np.ix_(free, free)], s[free, j], rho) if rho and free else (np.linalg.solve(w[np.ix_(free, free)], s[free, j]) if free else np.zeros(0))
            betas[j] = 0
            betas[j, free] = b
            w[rest, j] = w[j, rest] = w[np.ix_(rest, free)] @ b
        if np.abs(w - old).max() < tol:
            break
    else:
        raise RuntimeError(f"no sparse precision within {most} sweeps")
    theta = np.zeros((p, p))
    for j in range(p):
        rest = [k for k in range(p) if k != j]
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ betas[j, rest])
        theta[rest, j] = -theta[j, j] * betas[j, rest]
    return w, (theta + theta.T) / 2


def covariance_graph(s: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """The matrix that agrees with ``s`` on the edges and the diagonal and whose inverse is zero elsewhere."""
    on = {frozenset(e) for e in edges}
    zero = {(i, j) for i in range(len(s)) for j in range(i) if frozenset((i, j)) not in on}
    return glasso(s, 0.0, zero)[0]


def spectral(x_gram: np.ndarray, method: str, q: int) -> np.ndarray:
    """The p x p matrix by which rows are multiplied: trim, lava, rsvp, pcss or pc of the singular values of the data."""
    values, v = np.linalg.eigh(x_gram)
    kept = values > 1e-9 * values.max()
    d, v = np.sqrt(values[kept])[::-1], v[:, kept][:, ::-1]
    f = {"trim": lambda: np.minimum(d, np.median(d)) / d, "lava": lambda: np.sqrt(len(d) * np.median(d) ** 2 / (len(d) * np.median(d) ** 2 + d**2)), "rsvp": lambda: 1 / d, "pcss": lambda: (np.arange(len(d)) >= q).astype(float), "pc": lambda: (np.arange(len(d)) < q).astype(float)}[method]()
    return (v * f) @ v.T


def laplacian_components(r: np.ndarray, edges: list[tuple[int, int]], q: int) -> np.ndarray:
    """Weights of ``q`` components that vary over the graph's groups: leading vectors of a blend of the correlations and the
    signed Laplacian of the graph, as graph-Laplacian principal components. A graph in more than three parts has the Laplacian alone.
    """
    p = len(r)
    adjacent = np.zeros((p, p))
    for a, b in edges:
        adjacent[a, b] = adjacent[b, a] = 1
    signed = r * adjacent
    lap = np.diag(np.abs(signed).sum(axis=0)) - signed
    if not adjacent.any():
        blend = 0.0
    else:
        reach, parts = np.linalg.matrix_power(np.eye(p) + adjacent, p) > 0, 0
        parts = len({tuple(row) for row in reach})
        blend = 1.0 if parts > 3 else 0.75
    # small values of g: the shares of largest correlation, smoothest over the graph
    g = (1 - blend) * (np.eye(p) - r / np.linalg.eigvalsh(r)[-1])
    if blend:
        g = g + blend * (lap / max(np.linalg.eigvalsh(lap)[-1], 1e-12) + np.full((p, p), 1 / p))
    return np.linalg.eigh(g)[1][:, :q]


def factors(s: np.ndarray, q: int, most: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, uniquenesses) of a factor model by EM on the covariance."""
    values, vectors = np.linalg.eigh(s)
    load, psi = vectors[:, -q:] * np.sqrt(np.maximum(values[-q:], 1e-8)), np.maximum(np.diag(s) * 0.5, 1e-6)
    last = -np.inf
    for _ in range(most):
        sigma = load @ load.T + np.diag(psi)
        like = -(np.linalg.slogdet(sigma)[1] + np.trace(np.linalg.solve(sigma, s)))
        if like - last < tol * abs(like):
            return load, psi
        last = like
        beta = load.T @ np.linalg.inv(sigma)
        load = s @ beta.T @ np.linalg.inv(np.eye(q) - beta @ load + beta @ s @ beta.T)
        psi = np.maximum(np.diag(s - load @ beta @ s), 1e-6)
    raise RuntimeError(f"no factor model within {most} steps")


def layers(s: np.ndarray, eta: float) -> list[list[int]]:
    """Bottom-up layers: the nodes whose conditional variance is least, removed in turn by marginalising."""
    left, out = list(range(len(s))), []
    while left:
        var = 1 / np.diag(np.linalg.pinv(s[np.ix_(left, left)]))
        precision = 1 / var
        layer = [k for k, v in zip(left, precision, strict=True) if v <= precision.min() + eta]
        out.append(layer)
        left = [k for k in left if k not in layer]
    return out


def arborescence(weights: np.ndarray) -> list[tuple[int, int]]:
    """Chu-Liu-Edmonds: the branching with the largest total weight among those that span all nodes from one root.

    ``weights[i, j]`` is that of i -> j. A virtual root leads to all nodes at a cost that allows one such edge.
    """
    p = len(weights)
    if p < 2:
        return []
    w = np.full((p + 1, p + 1), -np.inf)
    w[:p, :p] = weights
    np.fill_diagonal(w, -np.inf)
    w[p, :p] = -(np.abs(weights).sum() + 1)
    return sorted((int(a), int(b)) for b, a in _branching(w, p).items() if a != p)


def _branching(w: np.ndarray, root: int) -> dict[int, int]:
    """Node to parent in the best branching from ``root``; missing edges weigh minus infinity. Cycles of best parents are
    contracted, one level each, and opened again from the last on.
    """
    w, alive, levels = w.copy(), set(range(len(w))), []
    inner = {v: {v} for v in alive}  # the nodes that a contracted one stands for
    source = [{j: (i, j) for j in range(len(w))} for i in range(len(w))]  # the edge that stands behind i -> j
    while True:
        up = {v: max((u for u in alive if u != v), key=lambda u: (w[u, v], -u)) for v in alive if v != root}
        cycle = _cycle(up)
        if not cycle:
            break
        new = cycle[0]  # the cycle goes on under its first node
        inside = {v: (w[up[v], v], source[up[v]][v]) for v in cycle}
        gain, entry = {}, {}
        for u in alive - set(cycle):
            best = max(cycle, key=lambda v: (w[u, v] - inside[v][0], -v))
            gain[u], entry[u] = w[u, best] - inside[best][0], source[u][best]
            leave = max(cycle, key=lambda v: (w[v, u], -v))
            w[new, u], source[new][u] = w[leave, u], source[leave][u]
        for u, x in gain.items():
            w[u, new], source[u][new] = x, entry[u]
        levels.append([(inside[v][1], inner[v]) for v in cycle])
        alive -= set(cycle) - {new}
        inner[new] = set().union(*(inner[v] for v in cycle))
    found = {source[u][v][1]: source[u][v][0] for v, u in up.items()}
    for edges in reversed(levels):  # a node of the cycle keeps its parent there unless an edge from outside has come in
        found |= {b: a for (a, b), own in edges if own.isdisjoint(found)}
    return found


def _cycle(up: dict[int, int]) -> list[int]:
    done: set[int] = set()
    for start in up:
        path, at = [], start
        while at in up and at not in done and at not in path:
            path.append(at)
            at = up[at]
        if at in path:
            return sorted(path[path.index(at) :])
        done.update(path)
    return []


def shortest(weights: dict[tuple[int, int], float], start: int) -> tuple[dict[int, float], dict[int, int]]:
    """Dijkstra over undirected weights: distances and predecessors."""
    import heapq

    near: dict[int, list[tuple[int, float]]] = {}
    for (a, b), x in weights.items():
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))
    dist, back, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, x in near.get(v, ()):
            if d + x < dist.get(u, math.inf) - 1e-15:
                dist[u], back[u] = d + x, v
                heapq.heappush(heap, (d + x, u))
    return dist, back


def neighbours(a, b, n: int) -> tuple[list[int], list[int]]:
    """Where each node's neighbours begin, and the neighbours, of edges from ``a`` to ``b`` over nodes 0 to n - 1."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()


def distances(a, b, n: int, starts: list[int]) -> list[int]:
    """The fewest steps from ``starts`` to each node, -1 where no walk leads."""
    first, to = neighbours(a, b, n)
    out = [-1] * n
    for v in starts:
        out[v] = 0
    queue = list(dict.fromkeys(starts))
    for v in queue:
        for w in to[first[v] : first[v + 1]]:
            if out[w] < 0:
                out[w] = out[v] + 1
                queue.append(w)
    return out


def longest(a, b, n: int) -> list[int]:
    """The steps of the longest walk that ends in each node, -1 on or behind a cycle."""
    first, to = neighbours(a, b, n)
    left = np.bincount(b, minlength=n).tolist()
    out = [0] * n
    queue = [v for v in range(n) if not left[v]]
    for v in queue:
        for w in to[first[v] : first[v + 1]]:
            out[w] = max(out[w], out[v] + 1)
            left[w] -= 1
            if not left[w]:
                queue.append(w)
    return [k if not m else -1 for k, m in zip(out, left, strict=True)]


def spanning(weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Kruskal's minimum spanning forest; ties by names."""
    up: dict[int, int] = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for (a, b), _ in sorted(weights.items(), key=lambda e: (e[1], e[0])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            out.append((a, b))
    return out


def steiner(weights: dict[tuple[int, int], float], seeds: list[int]) -> list[tuple[int, int]]:
    """Kou, Markowsky and Berman's tree: seeds joined by shortest paths, spanned, and pruned of leaves that are no seeds."""
    found = {s: shortest(weights, s) for s in seeds}
    complete = {(a, b): found[a][0][b] for a in seeds for b in seeds if a < b and b in found[a][0]}
    nodes = set(seeds)
    for a, b in spanning(complete):
        while b != a:
            nodes.add(b)
            b = found[a][1][b]
    tree = spanning({e: x for e, x in weights.items() if e[0] in nodes and e[1] in nodes})
    while True:
        degree: dict[int, int] = {}
        for a, b in tree:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        kept = [(a, b) for a, b in tree if not any(degree[v] == 1 and v not in seeds for v in (a, b))]
        if len(kept) == len(tree):
            return sorted(tree)
        tree = kept


def minimax(dissimilarity: np.ndarray, h: float) -> list[tuple[list[int], int]]:
    """Clusters and prototypes of minimax linkage, cut at height ``h``."""
    clusters = [[k] for k in range(len(dissimilarity))]

    def height(members):
        radius = dissimilarity[np.ix_(members, members)].max(axis=1)
        return float(radius.min()), members[int(radius.argmin())]

    while len(clusters) > 1:
        best = min(((height(a + b)[0], i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=None)
        if best[0] > h:
            break
        _, i, j = best
        clusters[i] = clusters[i] + clusters.pop(j)
    return [(sorted(c), height(c)[1]) for c in clusters]


def greedy_modularity(edges: list[tuple[int, int]], p: int) -> list[int]:
    """Communities by merging the pair that raises modularity most, until none does."""
    label, m = list(range(p)), max(len(edges), 1)
    degree = np.bincount([v for e in edges for v in e], minlength=p)

    def quality(of):
        inner = sum(of[a] == of[b] for a, b in edges) / m
        total: dict[int, float] = {}
        for v in range(p):
            total[of[v]] = total.get(of[v], 0) + degree[v] / (2 * m)
        return inner - sum(x * x for x in total.values())

    now = quality(label)
    while True:
        tried = [(quality(new), new) for a, b in sorted({tuple(sorted((label[a], label[b]))) for a, b in edges if label[a] != label[b]}) if (new := [a if x == b else x for x in label])]
        if not tried or max(tried)[0] <= now + 1e-12:
            return label
        now, label = max(tried, key=lambda t: (t[0], [-x for x in t[1]]))


def chi2_survival(x: float, df: float) -> float:
    """Survival of a chi-square with real degrees of freedom, by the incomplete gamma series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def student_survival(t: float, df: float) -> float:
    """P(T > t) of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    half = beta_regular(df / 2, 0.5, x) / 2
    return half if t >= 0 else 1 - half


def beta_regular(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regular(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz evaluation
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def normal_survival(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))
