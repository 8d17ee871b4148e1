"""From readings to images: direct, iterative, regularized and total-variation reconstructions.

Readings are rows (coil, sample, k_<axis>..., re, im): one row a sample of a coil, with the same
coordinates for all coils. An image is a TensorFrame over the axes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.fourier import fourier_op
from lattica.operators.gather import DensityCompensationOp, SensitivityOp
from lattica.operators.gridding import GriddedFourierOp
from lattica.operators.reduce import ZeroFunctional, coil_maps_frame, density_2d
from lattica.plans.algebra import Identity, LinearOperator
from lattica.plans.solvers import cg, difference_terms, direct_reconstruction, distance_squared, pdhg, sense
from lattica.tensor import TensorFrame, checkpointed
from lattica.workers import numbered_in_order


@dataclass
class Reconstruction:
    """What is needed to get an image from the readings of one data set."""

    data: TensorFrame
    fourier: LinearOperator
    image: dict[str, int]
    maps: LinearOperator | None = None
    weights: LinearOperator | None = None
    options: dict = field(default_factory=dict)

    @classmethod
    def from_readings(cls, readings: DataFrame, image: dict[str, int], encoding: dict[str, int] | None = None, maps: str | TensorFrame | None = "walsh", weights: bool | None = None, width: int = 5) -> Reconstruction:
        """The Fourier operator comes from the coordinates; maps are estimated from the image of each coil
        (walsh, inati), given or left out; density weights are used where samples lie off the grid."""
        names = [f"k_{n}" for n in image]
        size = readings.agg(F.max("coil") + 1, F.max("sample") + 1).first()
        data = TensorFrame(readings.select("coil", "sample", "re", "im"), {"coil": size[0], "sample": size[1]}).cut()
        points = checkpointed(readings.where(F.col("coil") == 0).select("sample", *names))  # solvers come back to both in each step
        fourier = fourier_op(image, encoding or image, points, {"sample": size[1]})
        on_grid = not isinstance(fourier, GriddedFourierOp)
        out = cls(data, fourier, image)
        if weights or (weights is None and not on_grid and len(image) == 2):
            w = density_2d(points.withColumn("g", F.lit(0)), ["g"], *names).select("sample", F.col("w").alias("re"), F.lit(0.0).alias("im"))
            out.weights = DensityCompensationOp(TensorFrame(w, {"sample": size[1]}))
        if isinstance(maps, TensorFrame):
            out.maps = SensitivityOp(maps)
        elif maps:
            coils = direct_reconstruction(data, fourier, None, out.weights)
            one = TensorFrame(coils.df.withColumn("other", F.lit(0)), {"other": 1} | coils.axes)
            found = coil_maps_frame(one, width=width, method=maps)
            out.maps = SensitivityOp(TensorFrame(found.df.drop("other"), {n: s for n, s in found.axes.items() if n != "other"}).cut())
        return out

    def direct(self) -> TensorFrame:
        return direct_reconstruction(self.data, self.fourier, self.maps, self.weights)

    def _maps(self) -> LinearOperator:
        return self.maps or Identity()

    def sense(self, iterations: int = 5) -> TensorFrame:
        return sense(self.data, self.fourier, self._maps(), iterations, weights=self.weights)

    def regularized(self, strength: float, prior: TensorFrame | None = None, transform: LinearOperator | None = None, iterations: int = 5) -> TensorFrame:
        """argmin |A x - y|^2 + strength |B x - prior|^2."""
        a = self.fourier @ self._maps()
        b = transform or Identity()
        weighted = self.weights(self.data)[0] if self.weights else self.data
        op = (a.H @ self.weights @ a if self.weights else a.gram) + strength * b.gram
        rhs = a.H(weighted)[0]
        if prior is not None:
            rhs = rhs + b.H(prior)[0] * strength
        return cg(op, rhs.cut(), max_iterations=iterations, tolerance=0.0)

    def total_variation(self, strength: float | dict[str, float], iterations: int = 20, tolerance: float = 0.0, **steps) -> TensorFrame:
        """argmin |A x - y|^2 + sum over axes of strength * (|re| + |im|) of forward differences (zeros behind the
        last place), from the direct image on. strength: a number for the image's axes, or by axis."""
        weights = strength if isinstance(strength, dict) else dict.fromkeys(self.image, strength)
        terms, differences = difference_terms(weights)
        a = self.fourier @ self._maps()
        return pdhg([distance_squared(self.data), *terms], ZeroFunctional(), [a, *differences], self.direct(), iterations, tolerance=tolerance, **steps)


def undersampled(readings: DataFrame, keep) -> DataFrame:
    """Readings of the samples that a condition keeps, numbered anew in their order."""
    samples = readings.where(F.col("coil") == 0).where(keep).select("sample")
    numbered = numbered_in_order(samples, "sample", "__s")
    return readings.join(numbered, "sample").drop("sample").withColumnRenamed("__s", "sample")


def simulate(image: TensorFrame, maps: TensorFrame, points: np.ndarray, encoding: dict[str, int] | None = None) -> DataFrame:
    """Readings of an image at coordinates (samples, axes), without noise."""
    spark, names = image.df.sparkSession, [f"k_{n}" for n in image.axes]
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "sample int, " + ", ".join(f"{n} double" for n in names))
    op = fourier_op(image.axes, encoding or image.axes, table, {"sample": len(points)})
    data = op(SensitivityOp(maps)(image)[0])[0]
    return data.df.join(table, "sample").select("coil", "sample", *names, "re", "im")
