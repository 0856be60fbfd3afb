"""SQL text for what SQL has no function for: small ridges, the error function, Student's distribution."""

from __future__ import annotations


def ridge(source: str, xs: list[str], y: str, alpha: float, name: str, keys: str = "") -> str:
    """CTEs ending in `name` (keys, b0, w1..wd): the ridge of two or three population-scaled features by
    Cramer's rule; `source` is a table or a sub-select in parentheses."""
    d = len(xs)
    k, by = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    cells = [f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}, covar_pop({x}, {y}) AS d{i}" for i, x in enumerate(xs)]
    cells += [f"covar_pop({xs[i]}, {xs[j]}) AS c{i}{j}" for i in range(d) for j in range(i + 1, d)]
    moments = f"{name}_m AS (SELECT {k}count(*)::DOUBLE AS n, avg({y}) AS my, {', '.join(cells)} FROM {source}{by})"
    a = [[f"(n + {alpha!r}::DOUBLE)" if i == j else f"(n * c{min(i, j)}{max(i, j)} / (s{i} * s{j}))" for j in range(d)] for i in range(d)]
    b = [f"(n * d{i} / s{i})" for i in range(d)]

    def determinant(m: list[list[str]]) -> str:
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        minor = [[[m[r][c] for c in range(3) if c != skip] for r in (1, 2)] for skip in range(3)]
        return f"({m[0][0]} * {determinant(minor[0])} - {m[0][1]} * {determinant(minor[1])} + {m[0][2]} * {determinant(minor[2])})"

    whole = determinant(a)
    weights = ", ".join(f"{determinant([[b[r] if c == i else a[r][c] for c in range(d)] for r in range(d)])} / {whole} / s{i} AS w{i + 1}" for i in range(d))
    start = " - ".join(["my", *(f"w{i + 1} * m{i}" for i in range(d))])
    return f"{moments}, {name}_w AS (SELECT *, {weights} FROM {name}_m), {name} AS (SELECT *, {start} AS b0 FROM {name}_w)"


def predicted(xs: list[str]) -> str:
    return " + ".join(["b0", *(f"w{i + 1} * {x}" for i, x in enumerate(xs))])


def erf(x: str) -> str:
    """The error function by its series of positive terms; 1 beyond 6."""
    term = f"exp((2 * n * ln(2) + (2 * n + 1) * ln(greatest(abs({x}), 1e-300)) + lgamma(n + 1.0::DOUBLE) - lgamma(2 * n + 2.0::DOUBLE))::DOUBLE)"
    return f"(CASE WHEN abs({x}) > 6 THEN sign({x}) ELSE sign({x}) * 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 160), lambda n: {term})) END)"


def within_t(t: str, df: str) -> str:
    """P(|T| <= t) for a whole number of degrees of freedom, by the finite sums of its angle."""
    angle = f"atan({t} / sqrt({df}))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: exp((2 * j * ln(2) + 2 * lgamma(j + 1.0::DOUBLE) - lgamma(2 * j + 2.0::DOUBLE))::DOUBLE) * pow(cos({angle}), 2 * j + 1))), 0)"
    even = f"coalesce(list_sum(list_transform(range(0, {df} // 2), lambda j: exp((lgamma(2 * j + 1.0::DOUBLE) - 2 * j * ln(2) - 2 * lgamma(j + 1.0::DOUBLE))::DOUBLE) * pow(cos({angle}), 2 * j))), 0)"
    return f"(CASE WHEN {df} % 2 = 1 THEN 2 / pi() * ({angle} + sin({angle}) * {odd}) ELSE sin({angle}) * {even} END)"
