"""Minimizers whose state is a table: a row of parameters for each voxel, the cost a sum over rows.

cost(row) gives a row's cost as a dual number from a dictionary of dual numbers (the parameters) and
columns by name (`dual`); derivatives are exact. Every row brings its own data, so a fit of any number of
voxels keeps nothing but scalars on the driver.

`lbfgs` minimizes the sum with the history of steps and gradient changes as columns of the table. The
two-loop recursion needs only the inner products of these columns, which are one aggregate an iteration;
the direction is then a projection. A line search tries all its steps in one aggregate.

`adam` keeps both moments beside each parameter. As rows do not see each other, all steps of a round run
inside one projection, as a fold over a struct; rounds are cut by a written table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.dual import Dual
from lattica.workers import dropped, kept

#: Steps that a line search tries, longest first.
STEPS = tuple(2.0**-k for k in range(-1, 12))
SUFFICIENT = 1e-4


def _evaluated(cost: Callable, values: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """A row's cost, and its derivative by each parameter."""
    got = cost({p: Dual(v, {p: F.lit(1.0)}) for p, v in values.items()})
    return got.value, {p: got.parts.get(p, F.lit(0.0)).cast("double") for p in values}


def _recursion(dots: np.ndarray, m: int) -> np.ndarray:
    """Weights of the direction over the columns s_1..s_m, y_1..y_m, g, given their inner products."""
    weights, kept_ = np.zeros(2 * m + 1), np.zeros(m)
    weights[2 * m] = -1.0
    for k in reversed(range(m)):
        kept_[k] = dots[k] @ weights / dots[k, m + k]
        weights[m + k] -= kept_[k]
    if m:
        weights *= dots[m - 1, 2 * m - 1] / dots[2 * m - 1, 2 * m - 1]
    for k in range(m):
        weights[k] += kept_[k] - dots[m + k] @ weights / dots[k, m + k]
    return weights


def lbfgs(df: DataFrame, cost: Callable, start: dict[str, Column], max_iterations: int = 50, history: int = 5, tolerance: float = 1e-8, callback: Callable | None = None) -> DataFrame:
    """df with a column for each parameter, where the sum of cost over all rows is least. start: the first value
    of each parameter. Ends when no derivative is larger than the tolerance."""
    names, own = list(start), df.columns
    if clash := set(names) & set(own):
        raise ValueError(f"columns named like parameters: {sorted(clash)}")
    columns = [F.col(c) for c in own]
    first = df.select(*columns, *(v.cast("double").alias(f"__x_{p}") for p, v in start.items()))
    at = lambda kind: {p: F.col(f"__{kind}_{p}") for p in names}
    state = kept(first.select("*", *(g.alias(f"__g_{p}") for p, g in _evaluated(cost, at("x"))[1].items())), "fit")
    m = 0
    for turn in range(max_iterations):
        basis = [*(f"s{k}" for k in range(m)), *(f"y{k}" for k in range(m)), "g"]
        inner = [(i, j) for i in range(len(basis)) for j in range(i + 1)]
        product = lambda i, j: sum((at(basis[i])[p] * at(basis[j])[p] for p in names), F.lit(0.0))
        row = state.agg(F.sum(_evaluated(cost, at("x"))[0]), F.max(F.greatest(*(F.abs(g) for g in at("g").values()), F.lit(0.0))), *(F.sum(product(i, j)) for i, j in inner)).first()
        value, steepest = row[0], row[1]
        if value is None or steepest <= tolerance:
            break
        dots = np.zeros((len(basis),) * 2)
        for (i, j), v in zip(inner, row[2:]):
            dots[i, j] = dots[j, i] = v
        used = [k for k in range(m) if dots[k, m + k] > 1e-14]  # pairs with curvature
        rows = [*used, *(m + k for k in used), 2 * m]
        weights = np.zeros(2 * m + 1)
        weights[rows] = _recursion(dots[np.ix_(rows, rows)], len(used))
        slope = float(dots[2 * m] @ weights)
        if slope >= 0:  # rounding has spoilt the history
            weights, slope = np.r_[np.zeros(2 * m), -1.0], -dots[2 * m, 2 * m]
        direction = {p: sum((at(b)[p] * float(w) for b, w in zip(basis, weights)), F.lit(0.0)) for p in names}
        moved = state.select("*", *(d.alias(f"__d_{p}") for p, d in direction.items()))
        tried = moved.agg(*(F.sum(_evaluated(cost, {p: at("x")[p] + at("d")[p] * t for p in names})[0]) for t in STEPS)).first()
        good = [(v, t) for v, t in zip(tried, STEPS) if v is not None and v <= value + SUFFICIENT * t * slope]
        if not good:
            break
        value, step = min(good)
        made = moved.withColumns({f"__n_{p}": at("x")[p] + at("d")[p] * step for p in names})
        gradient = _evaluated(cost, at("n"))[1]
        out = [*columns, *(at("n")[p].alias(f"__x_{p}") for p in names), *(gradient[p].alias(f"__g_{p}") for p in names)]
        past = range(max(0, m + 1 - history), m)
        for k, old in enumerate(past):
            out += [F.col(f"__{kind}{old}_{p}").alias(f"__{kind}{k}_{p}") for kind in "sy" for p in names]
        m = len(past)
        out += [(at("d")[p] * step).alias(f"__s{m}_{p}") for p in names] + [(gradient[p] - at("g")[p]).alias(f"__y{m}_{p}") for p in names]
        m += 1
        old, state = state, kept(made.select(*out), "fit")
        dropped(old)
        if callback and callback(turn, value) is False:
            break
    return state.select(*columns, *(F.col(f"__x_{p}").alias(p) for p in names))


def adam(df: DataFrame, cost: Callable, start: dict[str, Column], max_iterations: int = 100, rate: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, decay: float = 0.0, a_round: int = 500) -> DataFrame:
    """df with a column for each parameter after so many steps of Adam (with decoupled decay) on each row's cost."""
    names, own = list(start), df.columns
    if clash := set(names) & set(own):
        raise ValueError(f"columns named like parameters: {sorted(clash)}")
    state = df.select("*", F.struct(*(v.cast("double").alias(f"x_{p}") for p, v in start.items()), *(F.lit(0.0).alias(f"{k}_{p}") for k in "mv" for p in names)).alias("__a"))

    def step(a: Column, k: Column) -> Column:
        gradient = _evaluated(cost, {p: a[f"x_{p}"] for p in names})[1]
        made = {}
        for p in names:
            mean = a[f"m_{p}"] * betas[0] + gradient[p] * (1 - betas[0])
            spread = a[f"v_{p}"] * betas[1] + gradient[p] * gradient[p] * (1 - betas[1])
            far = mean / (1 - F.pow(F.lit(betas[0]), k)) / (F.sqrt(spread / (1 - F.pow(F.lit(betas[1]), k))) + eps)
            made |= {f"x_{p}": a[f"x_{p}"] * (1 - rate * decay) - far * rate, f"m_{p}": mean, f"v_{p}": spread}
        return F.struct(*(made[f"{k_}_{p}"].alias(f"{k_}_{p}") for k_ in "xmv" for p in names))

    for begin in range(0, max_iterations, a_round):
        turns = F.sequence(F.lit(begin + 1), F.lit(min(max_iterations, begin + a_round)))
        state = state.withColumn("__a", F.aggregate(turns, F.col("__a"), lambda a, k: step(a, k.cast("double"))))
        if begin + a_round < max_iterations:
            state = kept(state, "fit")
    return state.select(*(F.col(c) for c in own), *(F.col("__a")[f"x_{p}"].alias(p) for p in names))
