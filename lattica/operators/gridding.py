"""Fourier transforms of arrays and sample sets of any size.

`SplitFourierOp` transforms one axis after the other: the lines of an axis are gathered by the other axes,
many a batch, and a line longer than LINE is split in four steps: places modulo a factor are lines of
their own, their frequencies are turned by twiddle factors, dealt anew by frequency (the transpose) and
transformed over the other factor. No task holds more than a batch of lines of at most LINE values.

`GriddedFourierOp` is the non-uniform transform by Kaiser-Bessel gridding: the image is divided by the
kernel's transform, padded to a finer grid and transformed there; samples are sums over the `width`
nearest cells an axis. The trajectory stays a table. For the adjoint each batch of samples adds its cells
up before they are shuffled, so that the crowded center is no hot key. Forward, the grid is cut into
tiles with a halo of the kernel's reach, and the samples of a tile into packs of bounded size, so that a
tile may hold any share of all samples. With a width of 6 the error is about 1e-5 of the largest value,
with 12 about 1e-11.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.structure import PadOrCropOp
from lattica.plans.algebra import LinearOperator
from lattica.tensor import TensorFrame
from lattica.workers import reachable

#: Values of the longest line that one task transforms whole.
LINE = 1 << 16
#: Cells of a tile's side, by number of axes, and samples of a pack.
TILE = {1: 4096, 2: 64, 3: 16}
PACK = 2048


def _lines(df: DataFrame, by: list[str], axis: str, n: int, inverse: bool, shift: bool, out: str) -> DataFrame:
    """(by, out, re, im): the transforms of lines over an axis of n places, unscaled; what is absent is 0. With
    shift, places and frequencies are counted from the middle."""
    gathered = df.groupBy(*by).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias("a"), "re", "im")).alias("v"))

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 1
            for start in range(0, batch.num_rows, step := max(1, (1 << 20) // n)):
                part = batch.slice(start, step)
                lists = part.column(k)
                values = lists.flatten()
                at, re, im = (values.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                line = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                block = np.zeros((len(lists), n), complex)
                np.add.at(block, (line, (at - n // 2) % n if shift else at), re + 1j * im)
                got = np.fft.ifft(block, norm="forward") if inverse else np.fft.fft(block)
                if shift:
                    got = np.fft.fftshift(got, 1)
                keys = pa.array(np.repeat(np.arange(len(lists)), n))
                made = [c.take(keys) for c in part.columns[:k]] + [pa.array(np.tile(np.arange(n, dtype=np.int64), len(lists))), pa.array(got.real.ravel()), pa.array(got.imag.ravel())]
                yield pa.RecordBatch.from_arrays(made, [*batch.schema.names[:k], out, "re", "im"])

    kinds = dict(gathered.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"`{out}` long", "re double", "im double"])
    return gathered.mapInArrow(run, schema)


def _factors(n: int, most: int) -> tuple[int, int]:
    """Two factors near the root of n."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            if n // a > most or a == 1:
                break
            return a, n // a
    raise ValueError(f"an axis of {n} places has no two factors of at most {most}; pad it")


def line_transform(x: TensorFrame, axis: str, inverse: bool = False, most: int = LINE) -> TensorFrame:
    """Centered orthonormal transform over one axis."""
    reachable(x.df.sparkSession)
    n, rest = x.axes[axis], [a for a in x.names if a != axis]
    df = x.df.select(*x.names, "re", "im")
    if n <= most:
        out = _lines(df, rest, axis, n, inverse, True, "__f")
    else:
        first, second = _factors(n, most)
        sign = 1 if inverse else -1
        at = F.pmod(F.col(axis).cast("long") - n // 2, F.lit(n))
        split = df.select(*rest, F.pmod(at, F.lit(second)).alias("__j"), F.floor(at / second).cast("int").alias("__i"), "re", "im")
        inner = _lines(split, [*rest, "__j"], "__i", first, inverse, False, "__k")
        angle = F.pmod(F.col("__j") * F.col("__k"), F.lit(n)).cast("double") * (sign * 2 * math.pi / n)
        c, s = F.cos(angle), F.sin(angle)
        turned = inner.select(*rest, "__k", F.col("__j").cast("int").alias("__j"), (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
        outer = _lines(turned, [*rest, "__k"], "__j", second, inverse, False, "__l")
        out = outer.withColumn("__f", F.pmod(F.col("__k") + F.col("__l") * first + n // 2, F.lit(n)))
    scale = 1 / math.sqrt(n)
    names = [F.col("__f").cast("int").alias(axis) if a == axis else F.col(a) for a in x.names]
    return TensorFrame(out.select(*names, (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im")), x.axes)


class SplitFourierOp(LinearOperator):
    """Centered orthonormal transform over axes, after centering the image in the encoding size."""

    def __init__(self, axes: list[str], image: dict[str, int] | None = None, encoding: dict[str, int] | None = None, most: int = LINE):
        self.axes, self.most = axes, most
        self.pad = PadOrCropOp(image, encoding) if image else None

    def forward(self, x):
        x = self.pad.forward(x) if self.pad else x
        for a in self.axes:
            x = line_transform(x, a, most=self.most)
        return x

    def adjoint(self, y):
        for a in reversed(self.axes):
            y = line_transform(y, a, inverse=True, most=self.most)
        return self.pad.adjoint(y) if self.pad else y


class GriddedFourierOp(LinearOperator):
    """Image over `axes` to samples at any coordinates: sum over pixels of x exp(-2 pi i k r / n), over the root
    of the encoding size. trajectory: a table of the samples' axes and a column k_<axis> for each axis."""

    def __init__(self, axes: dict[str, int], trajectory: DataFrame, samples: dict[str, int], encoding: dict[str, int] | None = None, width: int = 6, most: int = LINE):
        if len(axes) not in TILE:
            raise ValueError("one to three axes")
        self.axes, self.samples, self.width = axes, samples, width
        self.encoding = {a: (encoding or axes)[a] for a in axes}
        self.grid = {a: 2 * max(n + n % 2, width) for a, n in axes.items()}
        self.beta = math.pi * math.sqrt((width / 2) ** 2 * 2.25 - 0.8)
        self.pad = PadOrCropOp(axes, self.grid)
        self.fft = SplitFourierOp(list(axes), most=most)
        # Coordinates in cells of the grid, counted from its first place.
        self.trajectory = trajectory.select(*samples, *((F.col(f"k_{a}") * (m / self.encoding[a]) + m // 2).cast("double").alias(f"__u_{a}") for a, m in self.grid.items()))

    def _shaped(self, x: TensorFrame) -> TensorFrame:
        """Divided by the transform of the kernel, and scaled."""
        factor = F.lit(math.sqrt(math.prod(self.grid.values()) / math.prod(self.encoding.values())))
        for a, n in self.axes.items():
            root = F.sqrt(self.beta**2 - F.pow((F.col(a) - n // 2) * (math.pi * self.width / self.grid[a]), 2))
            factor = factor * root / F.sinh(root)
        return x.map(lambda v: v * factor)

    def forward(self, x):
        reachable(x.df.sparkSession)
        rest = [n for n in x.names if n not in self.axes]
        grid = self.fft.forward(self.pad.forward(self._shaped(x)))
        tile, reach, names = TILE[len(self.axes)], self.width // 2 + 1, list(self.axes)
        # Tiles with a halo: a cell goes to each tile whose margin it lies in, wrapped around.
        cells = grid.df
        for a, m in self.grid.items():
            count = -(-m // tile)
            here = F.expr(f"sequence(cast(floor((`{a}` - {reach} - {m}) / {tile}) as int), cast(floor((`{a}` + {reach} + {m}) / {tile}) as int))")
            # All places of the wrapped cell near a tile: p = cell + turn * m with tile * t - reach <= p < tile * (t + 1) + reach.
            spots = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda turn: F.transform(here, lambda t: F.struct(t.alias("t"), (F.col(a) + turn * m - t * tile + reach).alias("p")))))
            kept = F.filter(F.array_distinct(spots), lambda s: (s["t"] >= 0) & (s["t"] < count) & (s["p"] >= 0) & (s["p"] < min(tile, m) + 2 * reach if count == 1 else s["p"] < tile + 2 * reach))
            cells = cells.withColumn(f"__s_{a}", F.explode(kept))
        side = tile + 2 * reach
        place = F.lit(0).cast("long")
        for a in names:
            place = place * side + F.col(f"__s_{a}.p")
        keys = [f"__t_{a}" for a in names]
        blocks = cells.select(*rest, *(F.col(f"__s_{a}.t").alias(f"__t_{a}") for a in names), place.alias("p"), "re", "im").groupBy(*rest, *keys).agg(F.collect_list(F.struct("p", "re", "im")).alias("cells"))
        # Samples in packs: those of a tile dealt over as many as it needs.
        points = self.trajectory
        for a, m in self.grid.items():
            points = points.withColumn(f"__u_{a}", F.pmod(F.col(f"__u_{a}"), F.lit(float(m)))).withColumn(f"__t_{a}", F.floor(F.col(f"__u_{a}") / tile).cast("int"))
        number = list(self.samples)
        packs = points.groupBy(*keys).agg(F.ceil(F.count("*") / PACK).cast("int").alias("__n"))
        dealt = points.join(packs, keys).withColumn("__pack", F.pmod(F.xxhash64(*number), F.col("__n")).cast("int"))
        packed = dealt.groupBy(*keys, "__pack").agg(F.collect_list(F.struct(*number, *(f"__u_{a}" for a in names))).alias("points"))
        both = packed.join(blocks, keys).select(*rest, *keys, "points", "cells")
        width, beta, dims, n_rest = self.width, self.beta, len(names), len(rest)

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1)
                    points, cells = row.column(n_rest + dims).flatten(), row.column(n_rest + dims + 1).flatten()
                    block = np.zeros(side**dims, complex)
                    block[cells.field(0).to_numpy()] = cells.field(1).to_numpy() + 1j * cells.field(2).to_numpy()
                    n = len(points)
                    at, weight = np.zeros((n, 1), np.int64), np.ones((n, 1))
                    for d in range(dims):
                        u = points.field(len(number) + d).to_numpy(zero_copy_only=False)
                        cell, w = _cells(u, width, beta)
                        local = cell - row.column(n_rest + d)[0].as_py() * tile + reach
                        at = (at[:, :, None] * side + local[:, None, :]).reshape(n, -1)
                        weight = (weight[:, :, None] * w[:, None, :]).reshape(n, -1)
                    value = (block[at] * weight).sum(1)
                    keys = pa.array(np.zeros(n, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*(row.column(k).take(keys) for k in range(n_rest)), *(points.field(k) for k in range(len(number))), pa.array(value.real), pa.array(value.imag)],
                        [*rest, *number, "re", "im"],
                    )

        schema = ", ".join([f"`{c}` int" for c in [*rest, *number]] + ["re double", "im double"])
        typed = both.select(*(F.col(c).cast("int").alias(c) for c in rest), *keys, F.transform("points", lambda p: F.struct(*(p[c].cast("int").alias(c) for c in number), *(p[f"__u_{a}"].alias(f"__u_{a}") for a in names))).alias("points"), "cells")
        return TensorFrame(typed.mapInArrow(run, schema), {n: x.axes[n] for n in rest} | self.samples)

    def adjoint(self, y):
        reachable(y.df.sparkSession)
        rest, names, number = [n for n in y.names if n not in self.samples], list(self.axes), list(self.samples)
        rows = y.df.join(self.trajectory, number).select(*(F.col(c).cast("int").alias(c) for c in rest), *(f"__u_{a}" for a in names), "re", "im")
        width, beta, sizes, n_rest, dims = self.width, self.beta, list(self.grid.values()), len(rest), len(names)

        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, step := max(1, (1 << 20) // width**dims)):
                    part = batch.slice(start, step)
                    n = part.num_rows
                    at, weight = np.zeros((n, 1), np.int64), np.ones((n, 1))
                    for k in range(n_rest):
                        at = at * (1 << 20) + part.column(k).to_numpy()[:, None]
                    for d, m in enumerate(sizes):
                        cell, w = _cells(part.column(n_rest + d).to_numpy(), width, beta)
                        at = (at[:, :, None] * m + (cell % m)[:, None, :]).reshape(n, -1)
                        weight = (weight[:, :, None] * w[:, None, :]).reshape(n, -1)
                    value = (part.column(n_rest + dims).to_numpy() + 1j * part.column(n_rest + dims + 1).to_numpy())[:, None] * weight
                    cells, back = np.unique(at.ravel(), return_inverse=True)
                    columns, left = [], cells
                    for m in reversed(sizes):
                        columns.insert(0, left % m)
                        left = left // m
                    for _ in range(n_rest):
                        columns.insert(0, left % (1 << 20))
                        left = left // (1 << 20)
                    sums = [pa.array(np.bincount(back, v.ravel(), len(cells))) for v in (value.real, value.imag)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), *sums], [*rest, *names, "re", "im"])

        for n in rest:
            if y.axes[n] >= 1 << 20:
                raise ValueError(f"axis {n} of {y.axes[n]} places is too long")
        if math.prod(self.grid.values()) * (1 << 20) ** len(rest) >= 1 << 63:
            raise ValueError("too many other axes: join them first")
        schema = ", ".join([f"`{c}` int" for c in [*rest, *names]] + ["re double", "im double"])
        axes = {n: y.axes[n] for n in rest} | self.grid
        spread = TensorFrame(rows.mapInArrow(run, schema), axes).summed([])
        return self._shaped(self.pad.adjoint(self.fft.adjoint(spread)))

    @cached_property
    def gram(self):
        return GriddedGramOp(self)


class GriddedGramOp(LinearOperator):
    """Adjoint after forward as one convolution: its kernel is the adjoint of ones on twice the image, made
    once; then transforms of twice the size and a product by place. weights: a value a sample."""

    def __init__(self, op: GriddedFourierOp, weights: TensorFrame | None = None):
        self.axes = op.axes
        double = {a: 2 * n for a, n in op.axes.items()}
        twice = GriddedFourierOp(double, op.trajectory.select(*op.samples, *(((F.col(f"__u_{a}") - m // 2) * (op.encoding[a] / m)).alias(f"k_{a}") for a, m in op.grid.items())), op.samples, op.encoding, op.width, op.fft.most)
        ones = weights or TensorFrame(op.trajectory.select(*op.samples, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), op.samples)
        self.pad, self.fft = PadOrCropOp(op.axes, double), SplitFourierOp(list(op.axes), most=op.fft.most)
        scale = math.sqrt(math.prod(double.values()) / math.prod(op.encoding.values()))
        self.kernel = (self.fft.forward(twice.adjoint(ones)) * scale).cut()

    def forward(self, x):
        return self.pad.adjoint(self.fft.adjoint(self.fft.forward(self.pad.forward(x)) * self.kernel))

    adjoint = forward


def _cells(u: np.ndarray, width: int, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest cells of places on an axis, not wrapped, and the kernel's values there."""
    first = np.floor(u - width / 2).astype(np.int64) + 1
    cell = first[:, None] + np.arange(width)
    inside = np.maximum(0.0, 1 - ((u[:, None] - cell) * (2 / width)) ** 2)
    return cell, np.i0(beta * np.sqrt(inside)) / width
