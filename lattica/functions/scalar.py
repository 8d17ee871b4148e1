"""Constraints, unit and time conversions, slice profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.complexpair import Pair, column
from lattica.functions.models import GYROMAGNETIC_RATIO_PROTON

# Constraints


def sigmoid(x, beta=1.0) -> Column:
    return 1 / (1 + F.exp(-column(x) * beta))


def sigmoid_inverse(x, beta=1.0) -> Column:
    return F.log(column(x) / (1 - column(x))) / beta


def softplus(x, beta=1.0) -> Column:
    y = column(x) * beta
    return (F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y)))) / beta


def softplus_inverse(x, beta=1.0) -> Column:
    return column(x) + F.log(-F.expm1(-column(x) * beta)) / beta


def constrain(x, low=None, high=None, beta_sigmoid=1.0, beta_softplus=1.0):
    """From the whole line into (low, high); a missing or infinite bound is none. Pairs part by part."""
    if isinstance(x, Pair):
        return Pair(*(constrain(p, low, high, beta_sigmoid, beta_softplus) for p in (x.re, x.im)))
    low, high = _bounds(low, high)
    if low is not None and high is not None:
        return low + (high - low) * sigmoid(x, beta_sigmoid)
    if low is not None:
        return low + softplus(x, beta_softplus)
    return high - softplus(-column(x), beta_softplus) if high is not None else column(x)


def unconstrain(y, low=None, high=None, beta_sigmoid=1.0, beta_softplus=1.0):
    """Inverse of `constrain`."""
    if isinstance(y, Pair):
        return Pair(*(unconstrain(p, low, high, beta_sigmoid, beta_softplus) for p in (y.re, y.im)))
    low, high = _bounds(low, high)
    if low is not None and high is not None:
        return sigmoid_inverse((column(y) - low) / (high - low), beta_sigmoid)
    if low is not None:
        return softplus_inverse(column(y) - low, beta_softplus)
    return -softplus_inverse(high - column(y), beta_softplus) if high is not None else column(y)


def _bounds(low, high):
    low = None if low is None or low == -math.inf else low
    high = None if high is None or high == math.inf else high
    if low is not None and high is not None and low >= high:
        raise ValueError("the lower bound must be below the upper one")
    return low, high


# Units: internal values are in s, m, rad


def _factor(k: float):
    return lambda x: column(x) * k


s_to_ms, m_to_mm, m_to_micrometer = _factor(1e3), _factor(1e3), _factor(1e6)


def ms_to_s(x) -> Column:
    return column(x) / 1e3


def mm_to_m(x) -> Column:
    return column(x) / 1e3


def micrometer_to_m(x) -> Column:
    return column(x) / 1e6


def deg_to_rad(x) -> Column:
    return column(x) * (math.pi / 180)


def rad_to_deg(x) -> Column:
    return column(x) * (180 / math.pi)


def larmor_frequency_to_field(f, gamma=GYROMAGNETIC_RATIO_PROTON) -> Column:
    return column(f) / gamma


def field_to_larmor_frequency(b, gamma=GYROMAGNETIC_RATIO_PROTON) -> Column:
    return column(b) * gamma


#: Seconds in a tick of the scanner's clock, by vendor.
TICKS = {"siemens": 2.5e-3, "osi2": 1e-3}


def ticks_to_seconds(ticks, vendor="siemens") -> Column:
    return column(ticks) * TICKS[vendor]


def seconds_to_ticks(seconds, vendor="siemens") -> Column:
    return (column(seconds) / TICKS[vendor]).cast("long")


# Slice profiles


def slice_gaussian(x, fwhm) -> Column:
    return F.exp(-(column(x) ** 2) / (0.36 * fwhm * fwhm))


def erf(x) -> Column:
    """Error function: Maclaurin series below 3, and beyond it 1 less a continued fraction."""
    v = F.abs(column(x))
    u, total = v * v, F.lit(0.0)
    for k in range(49, -1, -1):  # Horner: one term deeper each time
        total = total * u + (-1) ** k / (math.factorial(k) * (2 * k + 1))
    total = total * v
    return F.signum(column(x)) * F.when(v < 3, total * (2 / math.sqrt(math.pi))).otherwise(1 - F.exp(-v * v) / (v * math.sqrt(math.pi) * (1 + 1 / (2 * v * v + 2))))


def slice_smoothed_rectangular(x, fwhm_rect, fwhm_gauss) -> Column:
    """A box convolved with a Gaussian; either width may be 0, but not both."""
    if not fwhm_rect and not fwhm_gauss:
        raise ValueError("one of the widths must be positive")
    x = column(x)
    if not fwhm_gauss:
        return (F.abs(x) <= fwhm_rect / 2).cast("double")
    if not fwhm_rect:
        return F.exp(-math.log(2) * (x * 2 / fwhm_gauss) ** 2)
    n = 2 * math.sqrt(math.log(2)) / fwhm_gauss
    top = 2 * math.erf(n * fwhm_rect / 2)
    return (erf(n * (x + fwhm_rect / 2)) - erf(n * (x - fwhm_rect / 2))) / top


def slice_interpolate(x, positions, values) -> Column:
    """Piecewise linear between given points, 0 outside."""
    x, points = column(x), sorted(zip(map(float, positions), map(float, values)))
    out = F.lit(0.0)
    for (a, fa), (b, fb) in zip(points, points[1:]):
        out = F.when((x >= a) & (x <= b), fa + (x - a) * ((fb - fa) / (b - a))).otherwise(out)
    return out


class SliceProfile:
    """A profile with its parameters; `sample` draws places in proportion to it by inverting its running
    sum on a grid of at most 10,000 places."""

    def __init__(self, expression, *parameters):
        self.expression, self.parameters = expression, parameters

    def __call__(self, x) -> Column:
        return self.expression(x, *self.parameters)

    def sample(self, df, out: str, low: float, high: float, seed: int = 0, steps: int = 1000):
        from lattica.operators.gather import interp

        if not 2 <= steps <= 9_999:
            raise ValueError("from 2 to 9,999 steps")
        width = (high - low) / steps
        grid = df.sparkSession.range(steps).select((low + (F.col("id") + 0.5) * width).alias("__x"), "id")
        rows = [(r.id, float(r.p)) for r in grid.select("id", self(F.col("__x")).alias("p")).orderBy("id").collect()]  # `steps` rows
        total, so_far, table, last = sum(p for _, p in rows), 0.0, [], -1
        for k, p in rows:
            if p > 0:
                if last != k - 1 or not table:  # a stretch begins
                    table.append((so_far / total, low + k * width))
                so_far, last = so_far + p, k
                table.append((so_far / total, low + (k + 1) * width))
        known = df.sparkSession.createDataFrame(table, "xp double, fp double")
        return interp(df.withColumn("__u", F.rand(seed)), known, "__u").withColumnRenamed("f", out).drop("__u")
