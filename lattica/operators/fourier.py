"""Fourier operators: centered orthonormal transforms, non-uniform transforms and their Gram forms.

`dft` is the plain definition as a join with twiddle factors, in expressions. `FastFourierOp` transforms
lines (`gridding`). `NonUniformFourierOp` evaluates separable sums per group with broadcast coordinates,
for few samples; `gridding.GriddedFourierOp` takes any number, and `fourier_op` picks it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.gather import CartesianSamplingOp
from lattica.operators.gridding import GriddedFourierOp, SplitFourierOp
from lattica.operators.structure import PadOrCropOp
from lattica.plans.algebra import LinearOperator
from lattica.tensor import TensorFrame
from lattica.workers import reachable


def dft(df: DataFrame, by: list[str], at: str, n: int, inverse: bool = False) -> DataFrame:
    """(by, at, re, im) of rows with columns re, im: each value goes to all n frequencies with its
    phase, and phases are summed before the shuffle."""
    k = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = (F.col("__k") - n // 2) * (F.col(at) - n // 2) * ((1 if inverse else -1) * 2 * math.pi / n)
    c, s, root = F.cos(angle), F.sin(angle), math.sqrt(n)
    re, im = (F.col("re") * c - F.col("im") * s) / root, (F.col("re") * s + F.col("im") * c) / root
    return k.groupBy(*by, F.col("__k").alias(at)).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def grouped(x: TensorFrame, axes: list[str], new: dict[str, int], f) -> TensorFrame:
    """Apply a numpy function to the dense block over `axes`, for each combination of the others."""
    reachable(x.df.sparkSession)
    rest = [n for n in x.names if n not in axes]
    shape = tuple(x.axes[n] for n in axes)

    def run(pdf):
        import pandas as pd

        block = np.zeros(shape, complex)
        block[tuple(pdf[n].to_numpy() for n in axes)] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        out = f(block)
        at = np.indices(out.shape).reshape(out.ndim, -1)
        cols = {n: np.full(out.size, pdf[n].iloc[0], "int32") for n in rest} | {n: a.astype("int32") for n, a in zip(new, at)}
        return pd.DataFrame(cols | {"re": out.real.ravel(), "im": out.imag.ravel()})

    schema = ", ".join([f"`{n}` int" for n in [*rest, *new]] + ["re double", "im double"])
    df = x.df if rest else x.df.withColumn("__all", F.lit(0))
    rows = df.groupBy(*(rest or ["__all"])).applyInPandas(run, schema)
    return TensorFrame(rows, {n: x.axes[n] for n in rest} | new)


class FastFourierOp(SplitFourierOp):
    """Centered orthonormal FFT over axes, after centering the image in the encoding size: lines of one axis
    after the other, long ones split over tasks."""


class NonUniformFourierOp(LinearOperator):
    """Image to samples at any coordinates: sum over pixels of x exp(-2πi k·r / n), over the root of
    the encoding size. points: (number of samples, number of axes) coordinates, broadcast (checked)."""

    MOST = 4_000_000

    def __init__(self, axes: dict[str, int], points: np.ndarray, encoding: dict[str, int] | None = None, sample: str = "sample"):
        if points.size > self.MOST:
            raise ValueError("too many points for one operator: split the samples")
        self.axes, self.points, self.sample = axes, np.asarray(points, float), sample
        self.sizes = [(encoding or axes)[n] for n in axes]

    def _phases(self):
        return [np.exp(-2j * math.pi / e * np.outer(self.points[:, d], np.arange(n) - n // 2)) for d, (n, e) in enumerate(zip(self.axes.values(), self.sizes))]

    def forward(self, x):
        scale = 1 / math.sqrt(math.prod(self.sizes))

        def f(block):
            letters = "abc"[: block.ndim]
            return np.einsum(f"{letters},{','.join('s' + c for c in letters)}->s", block, *self._phases(), optimize=True) * scale

        return grouped(x, list(self.axes), {self.sample: len(self.points)}, f)

    def adjoint(self, y):
        scale = 1 / math.sqrt(math.prod(self.sizes))

        def f(line):
            letters = "abc"[: len(self.axes)]
            return np.einsum(f"s,{','.join('s' + c for c in letters)}->{letters}", line, *(p.conj() for p in self._phases()), optimize=True) * scale

        return grouped(y, [self.sample], dict(self.axes), f)

    @property
    def gram(self):
        return ToeplitzGramOp(self)


class ToeplitzGramOp(LinearOperator):
    """Adjoint after forward as one convolution: FFT in twice the size, product, FFT back, crop."""

    def __init__(self, op: NonUniformFourierOp, weights: np.ndarray | None = None):
        self.op, w = op, np.ones(len(op.points)) if weights is None else weights
        phases = [np.exp(2j * math.pi / e * np.outer(op.points[:, d], np.arange(-n, n))) for d, (n, e) in enumerate(zip(op.axes.values(), op.sizes))]
        letters = "abc"[: len(phases)]
        kernel = np.einsum(f"s,{','.join('s' + c for c in letters)}->{letters}", w.astype(complex), *phases, optimize=True) / math.prod(op.sizes)
        self.kernel = np.fft.fftn(np.fft.ifftshift(kernel))

    def forward(self, x):
        axes = list(self.op.axes)

        def f(block):
            full = np.fft.ifftn(np.fft.fftn(block, [2 * n for n in block.shape]) * self.kernel)
            return full[tuple(slice(0, n) for n in block.shape)]

        return grouped(x, axes, dict(self.op.axes), f)

    adjoint = forward


def fourier_op(image: dict[str, int], encoding: dict[str, int], trajectory: DataFrame, samples: dict[str, int], tolerance: float = 1e-3):
    """Pick by the trajectory: axes where all points lie on the grid get an FFT and Cartesian
    sampling; if any does not, all points go through the non-uniform transform. Returns the operator
    and the number of points on grid by axis."""
    stats = trajectory.agg(*(F.max(F.abs(F.col(f"k_{n}") - F.rint(f"k_{n}"))).alias(n) for n in image)).first()
    if all((stats[n] or 0) <= tolerance for n in image):
        return CartesianSamplingOp(trajectory, samples, encoding) @ FastFourierOp(list(image), image, encoding)
    return GriddedFourierOp(image, trajectory, samples, encoding)


def off_resonance_op(op: LinearOperator, spatial: list[TensorFrame], temporal: list[TensorFrame]) -> LinearOperator:
    """Sum over l of temporal_l * op(spatial_l * x): segments of a field map in an existing operator."""
    parts = [t * (op * s) for s, t in zip(spatial, temporal)]
    return sum(parts[1:], parts[0])


def frequency_bins(b0: np.ndarray, times: np.ndarray, bins: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Interpolation weights in space (bins, pixels) between quantiles of a field map, and the phase
    of each center over time (bins, times)."""
    centers = np.unique(np.quantile(b0, np.linspace(0, 1, bins)))
    at = np.clip(np.searchsorted(centers, b0) - 1, 0, max(0, len(centers) - 2))
    w = np.zeros((len(centers), b0.size))
    if len(centers) == 1:
        w[0] = 1
    else:
        part = (b0 - centers[at]) / (centers[at + 1] - centers[at])
        w[at, np.arange(b0.size)], w[at + 1, np.arange(b0.size)] = 1 - part, part
    return w, np.exp(2j * np.pi * np.outer(centers, times))


def time_segments(b0: np.ndarray, times: np.ndarray, segments: int = 32, frequencies: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Phases in space at segment times (segments, pixels), and the least-squares weights over time
    (segments, times) on a range of design frequencies."""
    t = np.linspace(times.min(), times.max(), segments)
    f = np.linspace(b0.min(), b0.max(), frequencies)
    w = np.linalg.lstsq(np.exp(2j * np.pi * np.outer(f, t)), np.exp(2j * np.pi * np.outer(f, times)), rcond=None)[0]
    return np.exp(2j * np.pi * np.outer(t, b0)), w


def remove_oversampling(x: TensorFrame, axis: str, size: int) -> TensorFrame:
    """Readouts over an axis as if they had been taken without oversampling: to the image, its middle
    `size` places, and back."""
    if size > x.axes[axis]:
        raise ValueError(f"{size} places of {x.axes[axis]}")
    if size == x.axes[axis]:
        return x
    crop = PadOrCropOp({axis: x.axes[axis]}, {axis: size})
    plain = FastFourierOp([axis])
    return plain.forward(crop.forward(plain.adjoint(x)))


def symmetrized(kernel: np.ndarray) -> np.ndarray:
    """The mean of a kernel and its reflected conjugate, about place 0 of each axis; of the last axis the
    half that tells the rest."""
    turned = kernel
    for axis in range(kernel.ndim):
        turned = np.roll(np.flip(turned, axis), 1, axis)
    return ((kernel + turned.conj()) / 2)[..., : kernel.shape[-1] // 2 + 1]


class ConjugatePhaseOp(LinearOperator):
    """The conjugate-phase image of samples taken at times in a field: its adjoint is the exact forward
    model, sum over pixels of x exp(-2 pi i (k r / n + f t)); this operator is the model's adjoint with the
    phase taken back at each pixel. Samples, times and field of one image are one task's."""

    def __init__(self, axes: dict[str, int], points: np.ndarray, times: np.ndarray, b0: np.ndarray, encoding: dict[str, int] | None = None, sample: str = "sample"):
        self.model = NonUniformFourierOp(axes, points, encoding, sample)
        self.times, self.b0 = np.asarray(times, float), np.asarray(b0, float)

    def _matrix(self, rows: slice):
        phases = self.model._phases()
        out = np.ones((len(self.model.points[rows]), 1), complex)
        for p in phases:
            out = (out[:, :, None] * p[rows][:, None, :]).reshape(len(out), -1)
        out *= np.exp(-2j * math.pi * np.outer(self.times[rows], self.b0.ravel()))
        return out / math.sqrt(math.prod(self.model.sizes))

    def _parts(self):
        step = max(1, (1 << 22) // self.b0.size)
        return [slice(k, k + step) for k in range(0, len(self.times), step)]

    def adjoint(self, y):
        def f(block):
            return np.concatenate([self._matrix(rows) @ block.ravel() for rows in self._parts()])

        return grouped(y, list(self.model.axes), {self.model.sample: len(self.times)}, f)

    def forward(self, x):
        def f(line):
            return sum(self._matrix(rows).conj().T @ line[rows] for rows in self._parts()).reshape(tuple(self.model.axes.values()))

        return grouped(x, [self.model.sample], dict(self.model.axes), f)
