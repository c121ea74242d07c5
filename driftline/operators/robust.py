"""Robust least squares over tables of any size (E12 and E13 for N4, N5, N8).

Each pass is one aggregate: the weighted normal equations of all rows are sums of column expressions, so what reaches the
driver is a handful of numbers whatever the table's size, and a lost executor costs its part of one sum. The driver solves them
and the next pass's weights are expressions of the solution."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.lsq import EPS, LIMIT, PASSES, chi2_quantile
from driftline.storage import written

#: An observation's terms, one for each coefficient, and what was observed; a row where that is null has no part in it.
Equation = tuple[list[Column], Column]


class Solution(NamedTuple):
    """coefficients; sigma, the deviation of an observation of full weight; covariance; how many passes and observations."""

    coefficients: np.ndarray
    sigma: float
    covariance: np.ndarray
    passes: int
    observations: int


def residual(equation: Equation, coefficients: np.ndarray) -> Column:
    """Observed less computed."""
    return equation[1] - sum((t * float(c) for t, c in zip(equation[0], coefficients)), F.lit(0.0))


def weight(left: Column, sigma: float | None, limit: float = LIMIT) -> Column:
    """1 up to limit deviations, a power of ten less for each further one."""
    if not sigma:
        return F.lit(1.0)
    beyond = F.abs(left) / sigma - limit
    return F.when(beyond > 0, F.greatest(F.pow(F.lit(10.0), -beyond), F.lit(EPS))).otherwise(1.0)


def sums(rows: DataFrame, equations: list[Equation], at: np.ndarray, sigma: float | None, limit: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Normal matrix and right side of the corrections to the coefficients `at`, squares of the residuals there, observations."""
    k, parts = len(at), []
    for e in equations:
        left = residual(e, at)
        w = weight(left, sigma, limit)
        known = left.isNotNull()
        parts.append((known, w * w, e[0], left))
    total = lambda f: F.sum(sum((F.when(known, w2 * f(terms, left)).otherwise(0.0) for known, w2, terms, left in parts), F.lit(0.0)))
    columns = [total(lambda t, v, i=i, j=j: t[i] * t[j]).alias(f"n{i}_{j}") for i in range(k) for j in range(i, k)]
    columns += [total(lambda t, v, i=i: t[i] * v).alias(f"l{i}") for i in range(k)]
    columns += [total(lambda t, v: v * v).alias("vv"), F.sum(sum((p[0].cast("long") for p in parts), F.lit(0))).alias("n")]
    r = rows.agg(*columns).first()
    n = np.array([[r[f"n{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return n, np.array([r[f"l{i}"] or 0.0 for i in range(k)]), r["vv"] or 0.0, int(r["n"] or 0)


def fitted(rows: DataFrame, equations: list[Equation], limit: float = LIMIT, passes: int = PASSES) -> Solution:
    """The coefficients of all equations of all rows.

    A pass weighs by the one before. It is the last one if the variance has changed by no more than chi-square allows at
    95 %. Without redundancy the exact solution stands. Coefficients that no row determines are zero.
    An unweighted pass goes ahead, as corrections to its result keep their digits."""
    k = len(equations[0][0])
    # what the passes read is written once: neither is the table's own plan run again, nor its expressions
    named = {f"t{e}_{i}": t for e, (terms, _) in enumerate(equations) for i, t in enumerate(terms)} | {f"l{e}": seen for e, (_, seen) in enumerate(equations)}
    rows = written(rows.select(*[v.cast("double").alias(name) for name, v in named.items()]), "equations")
    equations = [([F.col(f"t{e}_{i}") for i in range(k)], F.col(f"l{e}")) for e in range(len(equations))]
    n, l, _, count = sums(rows, equations, np.zeros(k), None, limit)  # noqa: E741
    at = np.linalg.lstsq(n, l, rcond=None)[0]
    dof, before, sigma, turn = count - k, 1.0, None, 0
    if dof <= 0:
        return Solution(at, 1.0, np.linalg.pinv(n), 1, count)
    low, high = chi2_quantile(0.025, dof), chi2_quantile(0.975, dof)
    for turn in range(1, passes + 1):
        n, l, squares, _ = sums(rows, equations, at, sigma, limit)  # noqa: E741
        step = np.linalg.lstsq(n, l, rcond=None)[0]
        at, sigma = at + step, (max(squares - float(step @ l), 0.0) / dof) ** 0.5
        if not sigma or low <= (sigma / before) ** 2 * dof <= high:
            break
        before = sigma
    return Solution(at, sigma, sigma**2 * np.linalg.pinv(n), turn, count)
