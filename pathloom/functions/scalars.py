"""Distribution functions as SQL text for both engines, so that values agree to rounding."""

from __future__ import annotations


def phi(x: str) -> str:
    """Normal distribution function by the Chebyshev fit of erfc with relative error below 1.2e-7."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    # Coefficients of the published fit.
    fit = "-1.26551223 1.00002368 0.37409196 0.09678418 -0.18628806 0.27886807 -1.13520398 1.48851587 -0.82215223 0.17087277".split()
    poly = fit[-1]
    for c in reversed(fit[:-1]):
        poly = f"({c} + {t} * {poly})"
    tail = f"(0.5 * {t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN ({x}) < 0 THEN {tail} ELSE 1.0 - {tail} END)"


def two_sided(z: str) -> str:
    return f"(2.0 * {phi(f'(-abs({z}))')})"


def student(t: str, df: str) -> str:
    """Two-sided p-value of Student's t, by Hill's normalising transformation (error below 1e-5 from 20 degrees of freedom on)."""
    # Coefficients of the published transformation.
    a = f"({df} - 0.5)"
    b = f"(48.0 * {a} * {a})"
    y = f"({a} * ln(1.0 + ({t}) * ({t}) / ({df})))"
    z = f"((((((-0.4 * {y} - 3.3) * {y} - 24.0) * {y} - 85.5) / (0.8 * {y} * {y} + 100.0 + {b}) + {y} + 3.0) / {b} + 1.0) * sqrt({y}))"
    return f"(2.0 * {phi(f'(-{z})')})"


def probit(p: str) -> str:
    """Normal quantile by Acklam's rational approximation, relative error below 1.2e-9."""
    # Coefficients of the published approximation.
    a = "-39.69683028665376 220.9460984245205 -275.9285104469687 138.3577518672690 -30.66479806614716 2.506628277459239".split()
    b = "-54.47609879822406 161.5858368580409 -155.6989798598866 66.80131188771972 -13.28068155288572".split()
    c = "-0.007784894002430293 -0.3223964580411365 -2.400758277161838 -2.549732539343734 4.374664141464968 2.938163982698783".split()
    d = "0.007784695709041462 0.3224671290700398 2.445134137142996 3.754408661907416".split()

    def horner(coefficients: list[str], x: str) -> str:
        out = coefficients[0]
        for k in coefficients[1:]:
            out = f"({out} * {x} + {k})"
        return out

    def tail(q: str) -> str:
        return f"({horner(c, q)} / {horner([*d, '1.0'], q)})"

    low, high, q = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))", f"({p} - 0.5)"
    mid = f"({horner(a, f'({q} * {q})')} * {q} / {horner([*b, '1.0'], f'({q} * {q})')})"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -{tail(high)} ELSE {mid} END)"


def not_close_fit(r: str, n: str, q: str, null: float = 0.05) -> str:
    """Survival of a noncentral chi-square with one degree of freedom at the squared z of a partial correlation."""
    root = f"sqrt({n} - 3.0 - {q})"
    z, delta = f"(abs(atanh({r})) * {root})", f"(atanh({null}) * {root})"
    return f"(1.0 - ({phi(f'({z} - {delta})')} - {phi(f'(-{z} - {delta})')}))"


def adjust(p: str, rows: str, method: str, keys: str) -> str:
    """A SELECT of keys, p and ``padj`` over the relation ``rows``."""
    if method == "bonferroni":
        return f"SELECT {keys}, {p}, least(1.0, {p} * count(*) OVER ()) AS padj FROM {rows}"
    ranked = f"SELECT {keys}, {p}, row_number() OVER (ORDER BY {p}, {keys}) AS rk, count(*) OVER () AS m FROM {rows}"
    if method == "BH":
        return f"SELECT {keys}, {p}, least(1.0, min({p} * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM ({ranked}) r"
    if method == "holm":
        return f"SELECT {keys}, {p}, least(1.0, max({p} * (m - rk + 1)) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM ({ranked}) r"
    raise ValueError(method)
