"""Generators: trajectories, phantoms, coil maps, random samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.models import GYROMAGNETIC_RATIO_PROTON
from lattica.tensor import TensorFrame
from lattica.workers import reachable

GOLDEN = math.pi * 0.618034


def readout(k0: str | Column, center: int, reversed_: Column | None = None) -> Column:
    c = (F.col(k0) if isinstance(k0, str) else k0) - center
    return c if reversed_ is None else F.when(reversed_, -1 - c).otherwise(c)


def cartesian(df: DataFrame, centers: tuple[int, int, int]) -> DataFrame:
    """Adds kz, ky, kx from k2, k1, k0."""
    return df.withColumns({n: (F.col(k) - c).cast("double") for n, k, c in zip(("kz", "ky", "kx"), ("k2", "k1", "k0"), centers)})


def radial_2d(df: DataFrame, center: int, angle: float = GOLDEN) -> DataFrame:
    r = readout("k0", center)
    return df.withColumns({"kz": F.lit(0.0), "ky": r * F.sin(F.col("k1") * angle), "kx": r * F.cos(F.col("k1") * angle)})


def radial_phase_encoding(df: DataFrame, centers: tuple[int, int], angle: float, shifts=(0, 0.5, 0.25, 0.75)) -> DataFrame:
    """Phase encoding points on turned lines that are shifted in turn; the center is not."""
    at = F.col("k1") - centers[0]
    shift = F.element_at(F.array(*(F.lit(float(s)) for s in shifts)), F.pmod(F.col("k2"), F.lit(len(shifts))).cast("int") + 1)
    r = F.when(at == 0, F.lit(0.0)).otherwise(at + shift)
    return df.withColumns({"kz": r * F.sin(F.col("k2") * angle), "ky": r * F.cos(F.col("k2") * angle), "kx": readout("k0", centers[1]).cast("double")})


def spiral_2d(spark: SparkSession, interleaves: int, samples: int, matrix: int, fov: float = 0.5, acceleration: float = 20.0, density: float = 1.0, max_gradient: float = 0.1, max_slew: float = 100.0, gamma: float = GYROMAGNETIC_RATIO_PROTON, angle: float = 2.39996) -> DataFrame:
    """Variable-density spiral k(t) = lam * u(t)^density * exp(i w u(t)) that stays within the limits of
    gradient (T/m) and slew rate (T/m/s): u follows the slew limit first and, from where that would pass
    the gradient limit, the gradient limit. Coordinates are in 1/m; density above 1 samples the center more."""
    if min(fov, acceleration, density, max_gradient, max_slew) <= 0:
        raise ValueError("field of view, acceleration, density and limits must be positive")
    lam, half, whole = matrix / (2 * fov), density / 2 + 1, density + 1
    w = 2 * math.pi / (1 - (1 - 2 * acceleration / matrix) ** (1 / density))
    by_slew = w / half * math.sqrt(lam / (max_slew * gamma))  # duration under the slew limit alone
    by_gradient = lam * w / (max_gradient * gamma * whole)
    switch = (by_slew ** (whole / half) * half / (by_gradient * whole)) ** (1 + 2 / density)
    end = by_gradient if switch < by_slew else by_slew
    df = spark.range(interleaves * samples).select(F.expr(f"cast(id div {samples} as int)").alias("k1"), F.pmod("id", F.lit(samples)).cast("int").alias("k0"))
    t = F.col("k0") * (end / (samples - 1))
    u = F.pow(t / by_slew, F.lit(1 / half))
    if switch < by_slew:
        u = F.when(t <= switch, u).otherwise(F.pow(F.least(t / by_gradient, F.lit(1.0)), F.lit(1 / whole)))
    phi, r = u * w + F.col("k1") * angle, F.pow(u, F.lit(density)) * lam
    return df.withColumns({"kz": F.lit(0.0), "ky": r * F.sin(phi), "kx": r * F.cos(phi)})


def dummy(df: DataFrame) -> DataFrame:
    """Coordinates of 0, where only the readings matter."""
    return df.withColumns({n: F.lit(0.0) for n in ("kz", "ky", "kx")})


def stored(df: DataFrame, trajectory: str, encoding: tuple[int, int, int], normalized: bool = True) -> DataFrame:
    """Coordinates that came with the readings: an array of (x, y[, z]) for each sample, or of numbers in
    this order. Normalized ones lie in [-0.5, 0.5] and are scaled to the encoding size (z, y, x)."""
    c = F.col(trajectory)
    scale = dict(zip("zyx", encoding)) if normalized else dict.fromkeys("zyx", 1.0)
    return df.withColumns({f"k{n}": F.coalesce(F.get(c, F.lit(k)).cast("double") * scale[n], F.lit(0.0)) for k, n in enumerate("xyz")})


def as_tensor(df: DataFrame, axes: dict[str, int], direction: str = "direction") -> TensorFrame:
    """Coordinates kz, ky, kx stacked along a first axis."""
    rows = df.select(*axes, F.posexplode(F.array("kz", "ky", "kx")).alias(direction, "re")).select(direction, *axes, F.col("re").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return TensorFrame(rows, {direction: 3} | axes)


def from_tensor(x: TensorFrame, direction: str = "direction", order: str = "zyx") -> DataFrame:
    """Rows with kz, ky, kx of coordinates stacked along an axis in the given order."""
    rest = [n for n in x.names if n != direction]
    pick = [F.coalesce(F.max(F.when(F.col(direction) == k, F.col("re"))), F.lit(0.0)).alias(f"k{n}") for k, n in enumerate(order)]
    return x.df.groupBy(*rest).agg(*pick)


def on_grid(df: DataFrame, columns: list[str], by: list[str] | None = None, tolerance: float = 1e-3) -> DataFrame:
    """For each coordinate: does every point lie on the grid, and is there one value only?"""
    aggs = []
    for c in columns:
        aggs += [(F.max(F.abs(F.col(c) - F.rint(c))) <= tolerance).alias(f"{c}_on_grid"), ((F.max(c) - F.min(c)) <= tolerance).alias(f"{c}_single")]
    return df.groupBy(*(by or [])).agg(*aggs)


def variable_density(spark: SparkSession, low: int, high: int, n: int, fwhm: float, always: list[int] = (), seed: int = 0) -> DataFrame:
    """n places of low..high-1 without replacement, with Gaussian weights: the largest keys win, and
    places that are always taken come first. Sorted."""
    at = F.col("id")
    w = F.exp(-4 * math.log(2) * ((at - (low + high) // 2) / fwhm) ** 2) if math.isfinite(fwhm) else F.lit(1.0)
    key = F.when(at.isin(list(always)), F.lit(math.inf)).otherwise(F.log(w) - F.log(-F.log(F.rand(seed))))
    return spark.range(low, high).withColumn("key", key).orderBy(F.desc("key"), "id").limit(n).orderBy("id").select(F.col("id").cast("int").alias("place"))


def birdcage(spark: SparkSession, coils: int, ny: int, nx: int, radius: float = 1.5, normalize: bool = True) -> TensorFrame:
    """Coil maps 1 / distance * exp(i angle), in pixels, of coils on a circle of radius times the matrix."""
    shape = TensorFrame(spark.range(0).select(F.lit(0).alias("coil"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), {"coil": coils, "y": ny, "x": nx})
    df = shape.grid(spark)
    phi = F.col("coil") * (2 * math.pi / coils)
    y, x = F.col("y") - -(-ny // 2) - ny * radius * F.sin(phi), F.col("x") - -(-nx // 2) - nx * radius * F.cos(phi)
    r, turn = F.sqrt(x * x + y * y), F.atan2(x, -y) - phi
    df = df.select("coil", "y", "x", (F.cos(turn) / r).alias("re"), (F.sin(turn) / r).alias("im"))
    out = TensorFrame(df, shape.axes)
    if normalize:
        power = df.groupBy("y", "x").agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("__n"))
        df = df.join(power, ["y", "x"]).select("coil", "y", "x", (F.col("re") / (F.col("__n") + 1e-8)).alias("re"), (F.col("im") / (F.col("__n") + 1e-8)).alias("im"))
        out = TensorFrame(df, shape.axes)
    return out


#: Center x, center y, radius x, radius y, intensity.
ELLIPSES = ((0.2, 0.2, 0.1, 0.25, 1.0), (0.1, -0.1, 0.3, 0.1, 2.0), (-0.2, 0.2, 0.18, 0.25, 4.0))


def ellipse_image(spark: SparkSession, ny: int, nx: int, ellipses=ELLIPSES) -> TensorFrame:
    """Sum of the intensities of the ellipses around each pixel, in expressions."""
    df = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("y"), F.pmod("id", F.lit(nx)).cast("int").alias("x"))
    py, px = (F.col("y") - ny // 2) / ny, (F.col("x") - nx // 2) / nx
    value = F.lit(0.0)
    for cx, cy, rx, ry, a in ellipses:
        value = value + F.when(((px - cx) / rx) ** 2 + ((py - cy) / ry) ** 2 <= 1, F.lit(float(a))).otherwise(0.0)
    return TensorFrame(df.select("y", "x", value.alias("re"), F.lit(0.0).alias("im")), {"y": ny, "x": nx})


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """J1 by its integral over half a turn; the trapezoid rule converges at once for periodic functions."""
    t = (np.arange(256) + 0.5) * math.pi / 256
    return np.cos(t - np.multiply.outer(x, np.sin(t))).mean(-1)


def ellipse_kspace(points: DataFrame, ky: str, kx: str, ny: int, nx: int, ellipses=ELLIPSES) -> DataFrame:
    """Rows with re, im: the analytic transform of the ellipses at any coordinates."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    reachable(points.sparkSession)
    schema = StructType([*points.schema, StructField("re", DoubleType()), StructField("im", DoubleType())])

    def run(batches):
        for pdf in batches:
            y, x = pdf[ky].to_numpy(float), pdf[kx].to_numpy(float)
            v = np.zeros(len(pdf), complex)
            for cx, cy, rx, ry, a in ellipses:
                q = 2 * math.pi * np.hypot(rx * x, ry * y)
                jinc = np.where(q < 1e-9, 0.5, bessel_j1(q) / np.where(q < 1e-9, 1, q))
                v += a * 2 * math.pi * rx * ry * jinc * np.exp(-2j * math.pi * (cx * x + cy * y))
            v *= math.sqrt(ny * nx)
            yield pdf.assign(re=v.real, im=v.imag)

    return points.mapInPandas(run, schema)


def tissue_map(fractions: DataFrame, tissues: DataFrame, by: list[str]) -> DataFrame:
    """Tissue-weighted parameter of each voxel and its main class: fractions (by, tissue, fraction),
    tissues (tissue, value)."""
    from lattica.operators.gather import small

    rows = fractions.join(small(tissues), "tissue")
    return rows.groupBy(*by).agg((F.sum(F.col("fraction") * F.col("value")) / F.sum("fraction")).alias("value"), F.max_by("tissue", F.struct("fraction", -F.col("tissue"))).alias("main"))


def bounding_box(df: DataFrame, mask: Column, by: list[str], axes: list[str]) -> DataFrame:
    """First place and place after the last of a mask, by axis."""
    return df.where(mask).groupBy(*by).agg(*(a for n in axes for a in (F.min(n).alias(f"{n}_from"), (F.max(n) + 1).alias(f"{n}_to"))))


def solid_harmonics(z: Column, y: Column, x: Column, degree: int) -> dict[tuple[int, int], Column]:
    """r^n Y_nm of real, normalized spherical harmonics by (n, m), as polynomials: powers of x + iy times
    a recurrence in z and r^2. Negative m are the sine parts."""
    r2, out = z * z + y * y + x * x, {}
    c, s = F.lit(1.0), F.lit(0.0)
    for m in range(degree + 1):
        low, high = F.lit(0.0), F.lit(math.prod(range(2 * m - 1, 0, -2)) * 1.0)  # (2m - 1)!!
        for n in range(m, degree + 1):
            if n > m:
                low, high = high, ((2 * n - 1) * z * high - (n + m - 1) * r2 * low) / (n - m)
            norm = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - m) / math.factorial(n + m) * (2 if m else 1))
            out[n, m] = norm * high * c
            if m:
                out[n, -m] = norm * high * s
        c, s = x * c - y * s, x * s + y * c
    return out


def field_map(spark: SparkSession, shape: tuple[int, int, int], fov: tuple[float, float, float], degree: int = 3, sigma: float = 1.0, seed: int = 0) -> TensorFrame:
    """Random field (z, y, x) in a source-free volume: solid harmonics of degree 1 to `degree` around the
    center, over half the largest field of view, with normal coefficients of deviation sigma / degree."""
    rng = np.random.default_rng(seed)
    axes = dict(zip("zyx", shape))
    grid = TensorFrame(spark.range(0).select(*(F.lit(0).alias(n) for n in axes), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), axes).grid(spark)
    at = [(F.col(n) * (f / max(1, k - 1)) - f / 2 * (k > 1)) * (2 / max(fov)) for n, k, f in zip("zyx", shape, fov)]
    value = F.lit(0.0)
    for (n, _), harmonic in sorted(solid_harmonics(*at, degree).items(), key=lambda e: e[0]):
        if n:
            value = value + float(rng.normal(0, sigma / n)) * harmonic
    return TensorFrame(grid.select(*axes, value.alias("re"), F.lit(0.0).alias("im")), axes)


def random_directions(df: DataFrame, kappa: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds dz, dy, dx: von Mises-Fisher directions around z (uniform for kappa 0), by inverting the
    distribution of the cosine, which is closed in three dimensions."""
    u = 1 - F.rand(seed)
    w = 2 * u - 1 if kappa == 0 else 1 + F.log(u + (1 - u) * math.exp(-2 * kappa)) / kappa
    df = df.withColumns({"dz": w, "__phi": F.rand(seed + 1) * (2 * math.pi)})
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("dz") * F.col("dz")))
    return df.withColumns({"dy": s * F.sin("__phi"), "dx": s * F.cos("__phi")}).drop("__phi")


def random_rotations(df: DataFrame, seed: int = 0) -> DataFrame:
    """Adds qz, qy, qx, qw: uniform rotations, four normal numbers divided by their norm."""
    names = ("qz", "qy", "qx", "qw")
    df = df.withColumns({f"__{n}": F.randn(seed + k) for k, n in enumerate(names)})
    norm = F.sqrt(sum((F.col(f"__{n}") ** 2 for n in names[1:]), F.col("__qz") ** 2))
    return df.withColumns({n: F.col(f"__{n}") / norm for n in names}).drop(*(f"__{n}" for n in names))


def sunflower(df: DataFrame, center: int) -> DataFrame:
    """Golden-angle radial phase encoding. Line k2 is shifted by the golden ratio times the rank of its
    angle, modulo 1 and less a half; the samples with k1 = 0 lie in the center. One row a line is
    ranked, not one a sample."""
    from pyspark.sql import Window

    angle = F.pmod(F.col("k2") * GOLDEN, F.lit(math.pi))
    lines = df.select("k2").distinct().withColumn("__a", angle)
    rank = F.row_number().over(Window.orderBy("__a")) - 1
    out = df.join(lines.withColumn("__s", F.pmod(rank * ((1 + math.sqrt(5)) / 2), F.lit(1.0)) - 0.5), "k2")
    r = F.when(F.col("k1") == 0, F.lit(0.0)).otherwise(F.col("k1") - center + F.col("__s"))
    return out.withColumns({"ky": r * F.cos("__a"), "kz": r * F.sin("__a")}).drop("__a", "__s")


def projection_matrix(spark: SparkSession, volume: tuple[int, int, int], rotation: np.ndarray, shift: float, profile, half_width: int) -> DataFrame:
    """(target, source, w) of a slice through a volume: each pixel's ray across the slice is sampled at
    -half_width..half_width, weighted by profile(distance) and spread over eight voxels by distance. A
    row's weights add up to the part of its profile that lies in the volume. rotation: 3 x 3, z y x."""
    nz, ny, nx = volume
    size = max(ny, nx)
    df = spark.range(size * size).select(F.col("id").alias("target"), (F.floor(F.col("id") / size) - size / 2 + 0.5).alias("v"), (F.pmod("id", F.lit(size)) - size / 2 + 0.5).alias("u"))
    df = df.withColumn("s", F.explode(F.sequence(F.lit(-half_width), F.lit(half_width))))
    total = sum(float(profile(k)) for k in range(-half_width, half_width + 1))
    table = F.array(*(F.lit(float(profile(k)) / total) for k in range(-half_width, half_width + 1)))
    df = df.withColumn("w", F.get(table, F.col("s") + half_width))
    for name, row, n in zip("zyx", np.asarray(rotation, float), volume):
        at = (F.col("s") + shift) * float(row[0]) + F.col("v") * float(row[1]) + F.col("u") * float(row[2]) + (n / 2 - 0.5)
        df = df.withColumn(f"p{name}", at)
    source = F.lit(0)
    for name, n in zip("zyx", volume):
        p = F.col(f"p{name}")
        df = df.withColumn("__e", F.explode(F.array(F.struct(F.floor(p).alias("i"), (1 - p + F.floor(p)).alias("w")), F.struct((F.floor(p) + 1).alias("i"), (p - F.floor(p)).alias("w")))))
        df = df.withColumns({f"i{name}": F.col("__e.i"), "w": F.col("w") * F.col("__e.w")}).drop("__e").where((F.col(f"i{name}") >= 0) & (F.col(f"i{name}") < n) & (F.col("w") > 0))
        source = source * n + F.col(f"i{name}")
    return df.groupBy("target", source.alias("source")).agg(F.sum("w").alias("w"))
