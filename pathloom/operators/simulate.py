"""Generators of graphs, covariances and data. Every draw comes from a hash or a counter-based generator keyed by seed and place,
so results do not depend on partitions and lost tasks give the same rows again."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .rows import moments, multiplied

Edge = tuple[int, int]


def uniform(seed: int, *cols: Column) -> Column:
    """A uniform number in [0, 1) for each row, by a hash of the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


def path_weights(edges: DataFrame, seed: int = 1, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """The edges with a weight between ``low`` and ``high``, of either sign."""
    size = F.lit(low) + (high - low) * uniform(seed, F.col("src"), F.col("dst"))
    return edges.withColumn("weight", F.when(uniform(seed + 1, F.col("src"), F.col("dst")) < 0.5, -size).otherwise(size))


def confounding_pairs(spark: SparkSession, edges: list[Edge], p: int, size: int, seed: int = 1) -> list[Edge]:
    """At most ``size`` random pairs of nodes that no edge joins: the bidirected part of a bow-free graph."""
    rng, taken = np.random.default_rng(seed), {frozenset(e) for e in edges}
    drawn = rng.integers(0, p, (size, 2))
    return sorted({(int(min(a, b)), int(max(a, b))) for a, b in drawn if a != b and frozenset((int(a), int(b))) not in taken})


def small_world(edges: list[Edge], p: int, nei: int = 5, rewire: float = 0.9, seed: int = 1) -> list[Edge]:
    """Pairs of a small-world graph (a ring of ``nei`` neighbours each way, ends moved at random) that no edge joins."""
    rng, taken = np.random.default_rng(seed), {frozenset(e) for e in edges}
    out = set()
    for a in range(p):
        for k in range(1, nei + 1):
            b = int(rng.integers(0, p)) if rng.random() < rewire else (a + k) % p
            if a != b and frozenset((a, b)) not in taken:
                out.add((min(a, b), max(a, b)))
    return sorted(out)


def covariances(pairs: list[Edge], p: int, low: float = 0.0, high: float = 1.0, seed: int = 1) -> np.ndarray:
    """A matrix with uniform values at the pairs, and 1 less a uniform value between 0.1 and 0.9 on the diagonal."""
    rng, out = np.random.default_rng(seed), np.eye(p)
    for a, b in sorted(pairs):
        out[a, b] = out[b, a] = rng.uniform(low, high)
    return out - np.diag(rng.uniform(0.1, 0.9, p))


def normal_rows(spark: SparkSession, root: np.ndarray, n: int, seed: int = 1, mean: np.ndarray | None = None, group_from: int | None = None) -> DataFrame:
    """n rows (obs, x, grp) of ``root`` times standard normal numbers; from row ``group_from`` on the group is 1 and the mean is added."""
    p, start = len(root), n if group_from is None else group_from
    shift = np.zeros(len(root)) if mean is None else np.asarray(mean, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            noise = np.array([np.random.Generator(np.random.Philox(key=[seed, i])).standard_normal(p) for i in frame["id"]]).reshape(-1, p)
            grp = (frame["id"] >= start).astype("int32")
            yield pd.DataFrame({"obs": frame["id"], "x": list(noise @ root.T + grp.to_numpy()[:, None] * shift), "grp": grp})

    return spark.range(n).mapInPandas(run, "obs long, x array<double>, grp int")


def exact_data(spark: SparkSession, s: np.ndarray, n: int, seed: int = 1) -> DataFrame:
    """n rows (obs, x) whose sample covariance is exactly ``s``: normal rows, whitened by their own moments and coloured."""
    drawn = normal_rows(spark, np.eye(len(s)), n, seed)
    (_, mean, cov), = moments(drawn).values()
    return multiplied(drawn, kernels.power(cov, -0.5) @ kernels.power(s, 0.5))


def model_data(spark: SparkSession, beta: np.ndarray, omega: np.ndarray, n: int, seed: int = 1, shifted: int = 6) -> DataFrame:
    """Two groups of rows of a linear model (beta: child, parent) with covariances omega of the errors.

    In group 1, the later three quarters, one in ``shifted`` nodes has its mean moved by 0.05 to 0.75 either way.
    """
    p = len(beta)
    rng, values = np.random.default_rng(seed), np.linalg.eigvalsh(omega)
    omega = omega + max(0.0, 0.01 - values.min()) * np.eye(p)
    mix = np.linalg.inv(np.eye(p) - beta)
    move = np.zeros(p)
    who = rng.choice(p, max(1, p // shifted), replace=False)
    move[who] = rng.uniform(0.05, 0.75, len(who)) * rng.choice([-1, 1], len(who))
    return normal_rows(spark, mix @ kernels.power(omega, 0.5), n, seed, mix @ move, n // 4)


#: Designs of the module study: mean shift of the first and second half of the module, and the correlations within and between halves.
DESIGNS = {1: (0, 0, 0.0, 0.0), 2: (1, 1, 0.6, 0.6), 3: (1, 1, 0.0, 0.0), 4: (0, 0, 0.6, 0.6), 5: (1, -1, 0.6, -0.6), 7: (0, 0, 0.0, 0.0)}


def module_design(spark: SparkSession, design: int, mu: float = 1.0, n: int = 20, p: int = 500, size: int = 50, seed: int = 1) -> DataFrame:
    """n rows (obs, x) of one of the designs 1 to 6 and the control 7: the first ``size`` of ``p`` columns are the module.

    Design 6 takes a fifth of the module from each of the designs 2, 3, 4 and 5, and the rest from design 1.
    """

    def moved(k: int) -> tuple[np.ndarray, np.ndarray]:
        first, second, within, between = DESIGNS[k]
        s, half, root = np.full((size, size), between), size // 2, np.eye(p)
        s[:half, :half] = s[half:, half:] = within
        np.fill_diagonal(s, 1)
        root[:size, :size] = kernels.power(s, 0.5)
        return root, mu * np.r_[np.full(half, first), np.full(size - half, second), np.zeros(p - size)]

    if design != 6:
        root, mean = moved(design)
        return normal_rows(spark, root, n, seed * 10 + design, mean, 0).select("obs", "x")
    fifth = size // 5
    rows = None
    for k in (2, 3, 4, 5, 1):
        take = fifth if k != 1 else p - 4 * fifth
        part = module_design(spark, k, mu, n, p, size, seed).select("obs", F.slice("x", 1, take).alias(f"x{k}"))
        rows = part if rows is None else rows.join(part, "obs")
    return rows.select("obs", F.concat("x2", "x3", "x4", "x5", "x1").alias("x"))


def shifted_design(rows: DataFrame, signs: dict[int, int], mu: float, seed: int = 1) -> DataFrame:
    """Rows (obs, x, grp) scaled within their group, with standard normal noise and, in group 1, ``mu`` times the sign of a column added."""
    parts = moments(rows)
    scale = {g: (m, np.sqrt(np.maximum(np.diag(c), 1e-300))) for g, (_, m, c) in parts.items()}
    width = len(next(iter(scale.values()))[0])
    move = mu * np.array([signs.get(k, 0) for k in range(width)], float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for obs, x, g in zip(frame["obs"], frame["x"], frame["grp"], strict=True):
                noise = np.random.Generator(np.random.Philox(key=[seed, int(obs)])).standard_normal(width)
                out.append((np.asarray(x) - scale[g][0]) / scale[g][1] + noise + (move if g == 1 else 0))
            yield pd.DataFrame({"obs": frame["obs"], "x": out, "grp": frame["grp"]})

    return rows.mapInPandas(run, "obs long, x array<double>, grp int")


def distance_shift(rows: DataFrame) -> tuple[float, float]:
    """(z, p) of the group's shift of each row's whitened sum, whose permutation law is taken as normal."""
    parts = moments(rows)
    n = sum(k for k, *_ in parts.values())
    mean = sum(k * m for k, m, _ in parts.values()) / n
    s = sum((k - 1) * c + k * np.outer(m - mean, m - mean) for k, m, c in parts.values()) / (n - 1)
    w = kernels.power(s, -0.5).sum(axis=1)
    (n0, m0, _), (n1, m1, _) = parts[0], parts[1]
    z = float(w @ (m1 - m0)) / math.sqrt(float(w @ s @ w) * (1 / n0 + 1 / n1))
    return z, 2 * kernels.normal_survival(abs(z))
