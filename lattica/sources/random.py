"""Random columns and tensors: each value depends on the seed and its row's place only, so that a task
that runs again gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.complexpair import Pair
from lattica.sources.records import check_bounds
from lattica.tensor import TensorFrame


def unit(seed: int, *place) -> Column:
    """Uniform in (0, 1), from a hash of the seed and the places."""
    h = F.xxhash64(F.lit(seed), *(F.col(p) if isinstance(p, str) else p for p in place))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def uniform(seed: int, *place, low: float = 0.0, high: float = 1.0) -> Column:
    return unit(seed, *place) * (high - low) + low


def integer(seed: int, *place, low: int = 0, high: int = 2, kind: str = "long") -> Column:
    """From low to high - 1, within the range of the type."""
    low, most = check_bounds(low, high - 1, kind)
    return (F.floor(unit(seed, *place) * (most - low + 1)) + low).cast(kind)


def boolean(seed: int, *place) -> Column:
    return unit(seed, *place) < 0.5


def normal(seed: int, *place) -> Column:
    return F.sqrt(-2 * F.log(unit(seed, *place))) * F.cos(2 * math.pi * unit(seed + 1, *place))


def complex_(seed: int, *place, low: float = 0.0, high: float = 1.0) -> Pair:
    """Amplitude from low to high, any phase."""
    size, turn = uniform(seed, *place, low=low, high=high), 2 * math.pi * unit(seed + 1, *place)
    return Pair(size * F.cos(turn), size * F.sin(turn))


def ascii_(seed: int, *place, size: int = 8) -> Column:
    """Printable characters."""
    return F.concat(*(F.char(integer(seed + k, *place, low=33, high=127)) for k in range(size)))


def tensor(spark: SparkSession, axes: dict[str, int], kind: str = "complex", seed: int = 0, low: float = 0.0, high: float = 1.0) -> TensorFrame:
    """Dense values: complex, uniform, normal or integer."""
    shape = TensorFrame(spark.range(0).select(*(F.lit(0).alias(n) for n in axes), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), axes)
    value = {
        "complex": lambda: complex_(seed, *axes, low=low, high=high),
        "uniform": lambda: Pair(uniform(seed, *axes, low=low, high=high), F.lit(0.0)),
        "normal": lambda: Pair(normal(seed, *axes), F.lit(0.0)),
        "integer": lambda: Pair(integer(seed, *axes, low=int(low), high=int(high)).cast("double"), F.lit(0.0)),
    }[kind]()
    return TensorFrame(shape.grid(spark).select(*axes, value.re.alias("re"), value.im.alias("im")), axes)


def permutation(df: DataFrame, by: list[str], place: str, seed: int = 0, out: str = "turn") -> DataFrame:
    """Rows of each group numbered from 0 in a random order; ties of the hash go by the place."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *by, place), place)
    return df.withColumn(out, F.row_number().over(w) - 1)


def augment(x: TensorFrame, size: int, seed: int = 0, max_shear: float = 5.0, max_rotation: float = 10.0, max_scaling: float = 0.1, flips: tuple[float, float] = (0.5, 0.5)) -> TensorFrame:
    """Maps over y and x under one random affine map (angles in degrees) and flips, resampled to a square."""
    import random as plain

    from lattica.operators.gather import GridSamplingOp

    rng, spark = plain.Random(seed), x.df.sparkSession
    angle, shear = (math.radians(rng.uniform(-m, m)) for m in (max_rotation, max_shear))
    scale = 1 + rng.uniform(-max_scaling, max_scaling)
    flip_x, flip_y = (-1.0 if rng.random() < p else 1.0 for p in flips)
    c, s, t = math.cos(angle), math.sin(angle), math.tan(shear)
    at = spark.range(size * size).select(F.expr(f"cast(id div {size} as int)").alias("v"), F.pmod("id", F.lit(size)).cast("int").alias("u"))
    gy, gx = (2 * F.col("v") + 1) / size - 1, (2 * F.col("u") + 1) / size - 1
    points = at.withColumns({"g_y": (s * gx + (c + s * t) * gy) * (flip_y / scale), "g_x": (c * gx + (c * t - s) * gy) * (flip_x / scale)})
    out = GridSamplingOp(points, {"v": size, "u": size}, {"y": x.axes["y"], "x": x.axes["x"]})(x)[0]
    return out.renamed({"v": "y", "u": "x"})


def resized(x: TensorFrame, size: int) -> TensorFrame:
    """The longer of y and x scaled to the size, the other in proportion, centered in a square."""
    from lattica.operators.gather import interpolate_axis
    from lattica.operators.structure import PadOrCropOp

    most = max(x.axes["y"], x.axes["x"])
    for n in ("y", "x"):
        x = interpolate_axis(x, n, max(1, round(x.axes[n] * size / most)))
    return PadOrCropOp({n: x.axes[n] for n in ("y", "x")}, {"y": size, "x": size}).forward(x)
