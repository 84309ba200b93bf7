"""DuckDB text of a logistic regression fitted by Newton steps: an independent twin of the fitted coefficients.

A recursive query keeps the coefficients as a list; each step sums the gradient
and the Hessian over the training rows and solves the system by Gauss-Jordan
elimination on one flat list.
"""

from __future__ import annotations

STEPS = 14


def newton_ctes(source: str, features: list[str], train: str) -> str:
    """CTEs ``lr_stats`` (m0, s0, ...), ``lr_rows`` (all columns of ``source``, x0, ..., xd) and ``lr_beta`` (beta) for the rows with ``train``."""
    d, w = len(features), len(features) + 2
    n = d + 1
    stats = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m{j}, stddev_pop(CAST({f} AS DOUBLE)) AS s{j}"
                      for j, f in enumerate(features))
    scaled = ", ".join(f"(CAST({f} AS DOUBLE) - m{j}) / CASE WHEN s{j} = 0 THEN 1.0 ELSE s{j} END AS x{j}"
                       for j, f in enumerate(features))
    xs = [f"x{j}" for j in range(n)]
    margin = " + ".join(f"beta[{j + 1}] * {x}" for j, x in enumerate(xs))
    cells = []
    for i in range(n):
        for j in range(n):
            a, b = xs[min(i, j)], xs[max(i, j)]
            cells.append(f"sum(h * {a} * {b})" + (" + 1.0" if i == j < d else ""))
        cells.append(f"sum(g * {xs[i]})" + (f" + any_value(beta)[{i + 1}]" if i < d else ""))
    sums = sorted({c.split(")")[0] + ")" for c in cells})
    names = {s: f"q{i}" for i, s in enumerate(sums)}
    summed = ", ".join(f"{s} AS {names[s]}" for s in sums)
    matrix = ", ".join(names[c.split(")")[0] + ")"] + c[len(c.split(")")[0]) + 1:].replace("any_value(beta)", "beta")
                       for c in cells)
    at = "CAST(k[1] AS BIGINT)"
    swept = (f"list_transform(range(0, {n * w}), lambda t: CASE WHEN t // {w} = {at} THEN m[t + 1] / m[{at} * {w} + {at} + 1] "
             f"ELSE m[t + 1] - m[(t // {w}) * {w} + {at} + 1] * m[{at} * {w} + t % {w} + 1] / m[{at} * {w} + {at} + 1] END)")
    solved = (f"list_reduce(list_prepend([{matrix}], list_transform(range(0, {n}), lambda i: [CAST(i AS DOUBLE)])), "
              f"lambda m, k: {swept})")
    return f"""
lr_stats AS (SELECT {stats}, count(*) AS n, sum(is_fraud) AS pos FROM {source} WHERE {train}),
lr_rows AS (SELECT {source}.*, {scaled}, CAST(1 AS DOUBLE) AS x{d},
   CASE WHEN is_fraud = 1 THEN n / (2.0 * pos) ELSE n / (2.0 * (n - pos)) END AS w FROM {source}, lr_stats),
lr_train AS MATERIALIZED (SELECT {', '.join(xs)}, w, CAST(is_fraud AS DOUBLE) AS y FROM lr_rows WHERE {train}),
lr_steps(step, beta) AS (
  SELECT 0, list_transform(range(0, {n}), lambda i: CAST(0 AS DOUBLE))
  UNION ALL
  SELECT step + 1, list_transform(range(0, {n}), lambda i: beta[i + 1] - delta[i * {w} + {n + 1}]) FROM (
    SELECT step, beta, {solved} AS delta FROM (
      SELECT step, beta, {summed} FROM (
        SELECT *, w * (p - y) AS g, w * p * (1 - p) AS h FROM (
          SELECT *, 1.0 / (1.0 + exp(-({margin}))) AS p FROM lr_steps, lr_train WHERE step < {STEPS}) a) b
      GROUP BY step, beta) c) e),
lr_beta AS (SELECT beta FROM lr_steps WHERE step = {STEPS})"""


def probability(features: list[str]) -> str:
    margin = " + ".join(f"beta[{j + 1}] * x{j}" for j in range(len(features) + 1))
    return f"1.0 / (1.0 + exp(-({margin})))"
