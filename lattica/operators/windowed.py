"""Neighbourhoods along an axis: differences, separable filters, dictionaries, wavelets, averages.

Functions take rows with key columns, an index column without gaps and a value column, and use
window frames: one shuffle on the keys, whatever the number of filter taps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.algebra import LinearOperator
from lattica.tensor import TensorFrame


def _frame(by: list[str], at: str):
    return Window.partitionBy(*by).orderBy(at)


def tap(v, k: int, by: list[str], at: str, mode: str = "zeros", n: Column | None = None, value: float = 0.0) -> Column:
    """The value k places further on. mode: what lies outside."""
    w, v = _frame(by, at), F.col(v) if isinstance(v, str) else v
    if k == 0:
        return v
    inside = F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w)
    if mode in ("zeros", "constant"):
        return F.coalesce(inside, F.lit(0.0 if mode == "zeros" else value))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if mode == "replicate":
        return F.coalesce(inside, (F.last(v) if k > 0 else F.first(v)).over(every))
    n = F.count(F.lit(1)).over(every) if n is None else n
    if mode == "circular":
        place = F.pmod(F.col(at) + k, n)
    elif mode == "reflect":
        place = (n - 1) - F.abs((n - 1) - F.abs(F.col(at) + k))
    else:
        raise ValueError(mode)
    # What lies outside is one of the few values at an end, counted from there.
    back = (mode == "circular") == (k < 0)
    ends = Window.partitionBy(*by).orderBy(F.desc(at) if back else F.asc(at)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = n - 1 - place if back else place
    return F.coalesce(inside, *(F.when(place == j, F.nth_value(v, j + 1).over(ends)) for j in range(abs(k) + 1)))


#: Taps at -1, 0 and 1.
DIFFERENCES = {"central": (-0.5, 0.0, 0.5), "forward": (0.0, -1.0, 1.0), "backward": (-1.0, 1.0, 0.0)}


def correlate(df: DataFrame, by: list[str], at: str, value: str, kernel, mode: str = "zeros", out: str = "v", fill: float = 0.0) -> DataFrame:
    """Cross-correlation of the same length; the kernel's middle, or the place after it, is 0."""
    left = (len(kernel) - 1) // 2
    total = F.lit(0.0)
    for k, c in enumerate(kernel):
        if c:
            total = total + tap(value, k - left, by, at, mode, value=fill) * float(c)
    return df.withColumn(out, total)


def finite_difference(df: DataFrame, by: list[str], at: str, value: str, mode: str = "central", pad: str = "zeros", out: str = "v") -> DataFrame:
    return correlate(df, by, at, value, DIFFERENCES[mode], pad, out)


def uniform_filter(df: DataFrame, by: list[str], at: str, value: str, width: int, mode: str = "zeros", out: str = "v") -> DataFrame:
    """Mean of `width` places; what lies outside counts, so the divisor is always the width."""
    if mode == "zeros":
        left = (width - 1) // 2
        return df.withColumn(out, F.sum(value).over(_frame(by, at).rowsBetween(-left, width - 1 - left)) / width)
    return correlate(df, by, at, value, [1 / width] * width, mode, out)


def gaussian_kernel(sigma: float, truncate: float = 3) -> list[float]:
    half = math.ceil(truncate * sigma)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [v / sum(k) for v in k]


def gaussian_filter(df: DataFrame, by: list[str], at: str, value: str, sigma: float, truncate: float = 3, mode: str = "zeros", out: str = "v") -> DataFrame:
    return correlate(df, by, at, value, gaussian_kernel(sigma, truncate), mode, out)


class FilterOp(LinearOperator):
    """Cross-correlation along one axis of a dense tensor; the adjoint turns the kernel around."""

    def __init__(self, axis: str, kernel, mode: str = "zeros"):
        if mode not in ("zeros", "circular") or len(kernel) % 2 == 0:
            raise ValueError("the adjoint needs an odd kernel and zeros or circular borders")
        self.axis, self.kernel, self.mode = axis, list(map(float, kernel)), mode

    def _run(self, x: TensorFrame, kernel) -> TensorFrame:
        n, left, rows = x.axes[self.axis], (len(kernel) - 1) // 2, []
        for k, c in enumerate(kernel):  # a row gives its weighted value to each place that reads it
            if c:
                rows.append(F.struct((F.col(self.axis) - (k - left)).alias("i"), F.lit(c).alias("w")))
        df = x.df.withColumn("__e", F.explode(F.array(*rows)))
        place = F.pmod(F.col("__e.i"), F.lit(n)) if self.mode == "circular" else F.col("__e.i")
        df = df.withColumns({self.axis: place.cast("int"), "re": F.col("re") * F.col("__e.w"), "im": F.col("im") * F.col("__e.w")})
        return x.summed([], df.where(F.col(self.axis).between(0, n - 1)))

    def forward(self, x):
        return self._run(x, self.kernel)

    def adjoint(self, y):
        return self._run(y, self.kernel[::-1])


class FiniteDifferenceOp(LinearOperator):
    """One result for each axis, stacked along `direction`; the adjoint adds them up."""

    def __init__(self, axes: list[str], mode: str = "central", pad: str = "zeros"):
        self.ops = [FilterOp(a, DIFFERENCES[mode], pad) for a in axes]

    def forward(self, x):
        from lattica.operators.structure import stack

        return stack([o.forward(x) for o in self.ops], "direction")

    def adjoint(self, y):
        parts = [o.adjoint(TensorFrame(y.df.where(F.col("direction") == k).drop("direction"), {n: s for n, s in y.axes.items() if n != "direction"})) for k, o in enumerate(self.ops)]
        return sum(parts[1:], parts[0])


class ConvAnalysisOp(LinearOperator):
    """Responses of several filters along one axis, numbered by `filter`."""

    def __init__(self, axis: str, kernels, mode: str = "circular"):
        self.ops = [FilterOp(axis, k, mode) for k in kernels]

    def forward(self, x):
        from lattica.operators.structure import stack

        return stack([o.forward(x) for o in self.ops], "filter")

    def adjoint(self, y):
        axes = {n: s for n, s in y.axes.items() if n != "filter"}
        parts = [o.adjoint(TensorFrame(y.df.where(F.col("filter") == k).drop("filter"), axes)) for k, o in enumerate(self.ops)]
        return sum(parts[1:], parts[0])


def conv_synthesis(axis: str, kernels, mode: str = "circular") -> LinearOperator:
    """Sum of filtered channels: the adjoint of the analysis with turned kernels."""
    return ConvAnalysisOp(axis, [list(k)[::-1] for k in kernels], mode).H


#: Low-pass synthesis filters of Daubechies' wavelets.
WAVELETS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db2": (0.48296291314453416, 0.8365163037378079, 0.2241438680420134, -0.12940952255126037),
    "db4": (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278),
}


class WaveletOp(LinearOperator):
    """Orthonormal periodic wavelet transform along one axis of even length at each level: places
    0..n/2 hold the low band, the rest the high band; further levels split the low band."""

    def __init__(self, axis: str, wavelet: str = "db4", levels: int = 1):
        low = WAVELETS[wavelet]
        high = [(-1) ** k * c for k, c in enumerate(low[::-1])]
        self.axis, self.levels, self.taps = axis, levels, (low, high)

    def _times(self, x, n, swap):
        """Each value goes to the places that its taps reach, by index arithmetic, and they are summed."""
        a, half, to = self.axis, n // 2, []
        for b, taps in enumerate(self.taps):
            for k, c in enumerate(taps):
                if swap:  # from place i of band b to 2 i + k
                    at = F.pmod(2 * (F.col(a) - b * half) + k, F.lit(n))
                    fits = F.col(a) >= half if b else F.col(a) < half
                else:
                    at, fits = b * half + F.pmod(F.col(a) - k, F.lit(n)) / 2, F.pmod(F.col(a) - k, F.lit(n)) % 2 == 0
                to.append(F.when(fits, F.struct(at.cast("int").alias("i"), F.lit(float(c)).alias("w"))))
        band = x.df.where(F.col(a) < n).withColumn("__e", F.explode(F.array_compact(F.array(*to))))
        band = band.withColumns({a: F.col("__e.i"), "re": F.col("re") * F.col("__e.w"), "im": F.col("im") * F.col("__e.w")})
        out = x.summed([], band)
        return out if n == x.axes[a] else TensorFrame(out.df.unionByName(x.df.where(F.col(a) >= n).select(*out.df.columns)), x.axes)

    def forward(self, x):
        for k in range(self.levels):
            x = self._times(x, x.axes[self.axis] >> k, False)
        return x

    def adjoint(self, y):
        for k in reversed(range(self.levels)):
            y = self._times(y, y.axes[self.axis] >> k, True)
        return y


def ema(df: DataFrame, by: list[str], order: list[str], value: str, decay: float, out: str = "ema") -> DataFrame:
    """Exponential moving average of each key: e = decay * e + (1 - decay) * v, from the first value.

    Blocks of rows are folded apart and the value carried into a block is added with its power of the
    decay, so that a long key is not one task's list: only one row a block is ordered across blocks.
    """
    size = 4096
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumns({"__b": F.floor(F.col("__i") / size), "__j": F.pmod(F.col("__i"), F.lit(size))})
    grouped = rows.groupBy(*by, "__b").agg(F.array_sort(F.collect_list(F.struct("__j", F.col(value).cast("double").alias("v"), F.struct(*df.columns).alias("row")))).alias("xs"))
    step = f"(a, x) -> named_struct('e', if(__b = 0 and x.__j = 0, x.v, {decay}D * a.e + {1 - decay}D * x.v), 'out', a.out || array(if(__b = 0 and x.__j = 0, x.v, {decay}D * a.e + {1 - decay}D * x.v)))"
    folded = grouped.withColumn("own", F.expr(f"aggregate(xs, named_struct('e', 0D, 'out', cast(array() as array<double>)), {step}, a -> a.out)"))
    n = F.size("own")
    folded = folded.withColumns({"__last": F.element_at("own", -1), "__n": n})
    # Blocks further back than this add less than 1e-18 of their value.
    reach = 1 + math.ceil(42 / (size * -math.log(decay))) if 0 < decay < 1 else 1
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(-reach, -1)
    ends = folded.select(*by, "__b", F.collect_list(F.struct("__last", "__n")).over(before).alias("ends"))
    carried = ends.select(*by, "__b", F.expr(f"aggregate(ends, 0D, (a, x) -> a * power({decay}D, x.__n) + x.__last)").alias("carry"))
    joined = folded.join(carried, [*by, "__b"])
    flat = joined.select(F.explode(F.arrays_zip("xs", "own")).alias("z"), "carry")
    return flat.select("z.xs.row.*", (F.col("z.own") + F.col("carry") * F.pow(F.lit(decay), F.col("z.xs.__j") + 1)).alias(out))
