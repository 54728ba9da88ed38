"""A power law of loss fitted by iteration: damped Gauss-Newton steps with robust weights, one aggregate for each step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = ["e", "a", "alpha", "b", "beta"]


@dataclass(frozen=True)
class Law:
    """loss = e + a n^-alpha + b d^-beta."""

    e: float
    a: float
    alpha: float
    b: float
    beta: float

    def parts(self, n: Column, d: Column) -> tuple[Column, list[Column]]:
        """The loss, and its slopes by e, a, alpha, b and beta."""
        x, y = F.exp(F.ln(n) * -self.alpha), F.exp(F.ln(d) * -self.beta)
        return self.e + self.a * x + self.b * y, [F.lit(1.0), x, -self.a * x * F.ln(n), y, -self.b * y * F.ln(d)]

    def moved(self, step: np.ndarray) -> Law:
        return Law(*(float(v + s) for v, s in zip((self.e, self.a, self.alpha, self.b, self.beta), step)))


def step_sums(df: DataFrame, n: str, d: str, loss: str, law: Law, scale: float | None = None) -> DataFrame:
    """One row of sums over rows with n and d above zero and a known loss: rows, sse, cost, r_TERM (slope times residual) and TERM_TERM (products of slopes).

    With a scale, residuals beyond it weigh scale / |residual| (Huber): far-off rows pull, but no harder than rows at the scale. cost is
    the sum that the steps lower; sse that of plain squares.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (n, d, loss)]).filter((F.col(n) > 0) & (F.col(d) > 0) & F.col(loss).isNotNull() & ~F.isnan(loss))
    fit, slopes = law.parts(F.col(n), F.col(d))
    r = F.col(loss) - fit
    rows = rows.select(r.alias("r"), *[s.alias(f"s{i}") for i, s in enumerate(slopes)])
    size, far = F.abs("r"), F.lit(scale) if scale else None
    w = F.when(size > far, far / size).otherwise(1.0) if scale else F.lit(1.0)
    cost = F.when(size > far, far * (2 * size - far)).otherwise(F.col("r") * F.col("r")) if scale else F.col("r") * F.col("r")
    own = [F.sum(w * F.col(f"s{i}") * F.col("r")).alias(f"r_{t}") for i, t in enumerate(TERMS)]
    both = [F.sum(w * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"{t}_{u}") for i, t in enumerate(TERMS) for j, u in enumerate(TERMS) if i <= j]
    return rows.agg(F.count("*").alias("rows"), F.sum(F.col("r") * F.col("r")).alias("sse"), F.sum(cost).alias("cost"), *own, *both)


def _solved(sums, damp: float) -> np.ndarray:
    g = np.zeros((5, 5))
    for i, t in enumerate(TERMS):
        for j, u in enumerate(TERMS):
            g[i, j] = sums[f"{t}_{u}"] if i <= j else sums[f"{u}_{t}"]
    right = np.array([sums[f"r_{t}"] for t in TERMS])
    return np.linalg.lstsq(g + damp * np.diag(np.diag(g)), right, rcond=None)[0]


def power_law_fit(df: DataFrame, n: str, d: str, loss: str, start: Law, robust: float | None = None, rounds: int = 60, close: float = 1e-9) -> tuple[Law, dict]:
    """The law that fits best near start, and how it came about: rows, sse, rounds, converged.

    Each step solves the normal equations of its sums on the driver, 21 numbers whatever the rows, and is damped more until it lowers the cost.
    robust is the scale beyond which residuals count less (in units of loss). ValueError with fewer than six usable rows.
    """
    law, damp = start, 1e-3
    sums = step_sums(df, n, d, loss, law, robust).first()
    if sums["rows"] < len(TERMS) + 1:
        raise ValueError(f"{sums['rows']} rows are too few")
    for turn in range(1, rounds + 1):
        step = _solved(sums, damp)
        to = law.moved(step)
        then = step_sums(df, n, d, loss, to, robust).first()
        if then["cost"] is not None and then["cost"] <= sums["cost"]:
            gain = (sums["cost"] - then["cost"]) / max(sums["cost"], 1e-300)
            law, sums, damp = to, then, max(damp / 10, 1e-12)
            if gain < close or sums["cost"] < 1e-20 * sums["rows"]:
                return law, {"rows": sums["rows"], "sse": sums["sse"], "rounds": turn, "converged": True}
        else:
            damp *= 10
            if damp > 1e12:
                break
    return law, {"rows": sums["rows"], "sse": sums["sse"], "rounds": turn, "converged": damp > 1e12}
