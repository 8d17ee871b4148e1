"""Wavelet transforms with zero or mirrored borders, over one to three axes, for several families.

Filters come from spectral factorization: `haar` and `db<N>` have the factor of the half-band polynomial
whose roots lie within the unit circle, `bior<p>.<q>` a spline of order p (1 to 3) and its dual of order q, placed
against each other so that analysis and synthesis undo each other. With borders a band of n values and a
filter of L has (n + L - 1) // 2 coefficients. An axis is one pass: a value goes to the coefficients that its
taps reach, of both bands at once, and they are summed before the shuffle.

Coefficients are packed behind each other along one axis: the coarse band, then the details of each level
from the coarsest on, bands of a level by name (ad, da, dd), each in row-major order.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from lattica.plans.algebra import LinearOperator
from lattica.tensor import ShapeError, TensorFrame


def _half_band(k: int) -> np.ndarray:
    """Roots in z, within the unit circle, of the sum over j < k of C(k - 1 + j, j) y^j with y = (2 - z - 1/z) / 4."""
    y = np.roots([math.comb(k - 1 + j, j) for j in reversed(range(k))])
    b = 1 - 2 * y
    z = b + np.sqrt(b.astype(complex) ** 2 - 1)
    return np.where(abs(z) < 1, z, 1 / z)


def _restored(n: int, f: tuple[np.ndarray, ...]) -> float:
    """How far synthesis after analysis is from the input, away from the borders."""
    x = np.sin(np.arange(n) * 1.7) + np.arange(n) % 3
    low, high, back_low, back_high = f
    half = (n + len(low) - 1) // 2
    out = np.zeros(2 * half + len(low))
    for taps, back in ((low, back_low), (high, back_high)):
        c = np.convolve(x, taps)[1::2][:half]
        up = np.zeros(2 * half)
        up[::2] = c
        out[: 2 * half + len(low) - 1] += np.convolve(up, back)
    got = out[len(low) - 2 : len(low) - 2 + n]
    return float(abs(got - x).max())


@cache
def filters(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Analysis low and high, synthesis low and high."""
    if name == "haar" or (m := re.fullmatch(r"db(\d+)", name)):
        order = 1 if name == "haar" else int(m[1])
        if not 1 <= order <= 12:
            raise ValueError(f"{name} is not known")
        low = np.real(np.poly(np.r_[-np.ones(order), _half_band(order)]))
        low = low * math.sqrt(2) / low.sum()
        high = low[::-1] * (-1.0) ** np.arange(len(low))
        return low[::-1], high[::-1], low, high
    if m := re.fullmatch(r"bior(\d)\.(\d)", name):
        p, q = int(m[1]), int(m[2])
        if not 1 <= p <= 3 or q < 1 or (p + q) % 2:  # those of higher order share the roots between both filters
            raise ValueError(f"{name} is not known")
        spline = np.poly(-np.ones(p)).real
        roots = _half_band((p + q) // 2)
        dual = np.real(np.poly(np.r_[-np.ones(q), roots, 1 / roots]))
        spline, dual = (v * math.sqrt(2) / v.sum() for v in (spline, dual))
        size = len(dual) + len(dual) % 2
        for at in range(size - len(spline) + 1):
            for shift in range(size - len(dual) + 1):
                low, back = np.zeros(size), np.zeros(size)
                low[shift : shift + len(dual)], back[at : at + len(spline)] = dual, spline
                for sign in (1, -1):
                    high, back_high = sign * back * (-1.0) ** np.arange(size), -sign * low * (-1.0) ** np.arange(size)
                    if _restored(64, found := (low, high, back, back_high)) < 1e-8:
                        return found
    raise ValueError(f"{name} is not known")


def size_of(n: int, name: str) -> int:
    return (n + len(filters(name)[0]) - 1) // 2


class BorderWaveletOp(LinearOperator):
    """Axes of even size to packed coefficients, and back: `adjoint` is the synthesis, which undoes the
    analysis (for orthonormal filters with zero borders it is the adjoint as well)."""

    def __init__(self, axes: dict[str, int], wavelet: str = "db4", levels: int = 1, mode: str = "zero", packed: str = "coefficient"):
        if not 1 <= len(axes) <= 3:
            raise ShapeError("one to three axes")
        if any(n % 2 for n in axes.values()):
            raise ShapeError("sizes must be even")
        if mode not in ("zero", "symmetric"):
            raise ValueError(mode)
        self.axes, self.mode, self.packed, self.bank = axes, mode, packed, filters(wavelet)
        self.sizes = [dict(axes)]
        for _ in range(levels):
            self.sizes.append({a: size_of(n, wavelet) for a, n in self.sizes[-1].items()})
        names = [""]
        for _ in axes:
            names = [n + b for n in names for b in "ad"]
        self.details = names[1:]
        #: (level, band): place of its first coefficient.
        self.start, self.total = {}, 0
        for level in range(levels, 0, -1):
            for band in names if level == levels else self.details:
                self.start[level, band] = self.total
                self.total += math.prod(self.sizes[level].values())

    def _split(self, df, rest, axis: str, n: int, size: int):
        """Both bands of one axis; their letter goes behind `__b`."""
        length, i, to = len(self.bank[0]), F.col(axis), []
        images = [i]
        if self.mode == "symmetric":
            turns = range(-(length // (2 * n)) - 1, length // (2 * n) + 2)
            images = [i + 2 * n * t for t in turns] + [-1 - i + 2 * n * t for t in turns]
        for letter, taps in zip("ad", self.bank[:2]):
            for m in images:
                for j, c in enumerate(taps):
                    if c:
                        k = m + j - 1  # 2 k of the coefficient that tap j brings the value to
                        fits = (F.pmod(k, F.lit(2)) == 0) & (k >= 0) & (k < 2 * size)
                        to.append(F.when(fits, F.struct(F.lit(letter).alias("b"), (k / 2).cast("int").alias("k"), F.lit(float(c)).alias("w"))))
        e = df.withColumn("__e", F.explode(F.array_compact(F.array(*to))))
        others = [a for a in self.axes if a != axis]
        moved = e.select(*rest, *others, F.concat("__b", F.col("__e.b")).alias("__b"), F.col("__e.k").alias(axis), (F.col("re") * F.col("__e.w")).alias("re"), (F.col("im") * F.col("__e.w")).alias("im"))
        return moved.groupBy(*rest, "__b", *self.axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def _join(self, df, rest, axis: str, n: int):
        """One axis of both bands back; the last letter of `__b` goes."""
        length, k, to = len(self.bank[0]), F.col(axis), []
        for letter, taps in zip("ad", self.bank[2:]):
            for t, c in enumerate(taps):
                if c:
                    i = 2 * k - (length - 2) + t
                    to.append(F.when((F.substring("__b", -1, 1) == letter) & (i >= 0) & (i < n), F.struct(i.cast("int").alias("i"), F.lit(float(c)).alias("w"))))
        e = df.withColumn("__e", F.explode(F.array_compact(F.array(*to))))
        others = [a for a in self.axes if a != axis]
        moved = e.select(*rest, *others, F.expr("substring(__b, 1, length(__b) - 1)").alias("__b"), F.col("__e.i").alias(axis), (F.col("re") * F.col("__e.w")).alias("re"), (F.col("im") * F.col("__e.w")).alias("im"))
        return moved.groupBy(*rest, "__b", *self.axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def forward(self, x):
        rest = [n for n in x.names if n not in self.axes]
        if any(x.axes.get(a) != n for a, n in self.axes.items()):
            raise ShapeError(f"{x.axes}")
        now, parts = x.df.select(*rest, *self.axes, "re", "im"), []
        for level in range(1, len(self.sizes)):
            rows = now.withColumn("__b", F.lit(""))
            for a in self.axes:
                rows = self._split(rows, rest, a, self.sizes[level - 1][a], self.sizes[level][a])
            coarse = "a" * len(self.axes)
            last = level == len(self.sizes) - 1
            place = F.lit(0).cast("long")
            for a, n in self.sizes[level].items():
                place = place * n + F.col(a)
            start = F.create_map(*(F.lit(v) for (lv, band), s in self.start.items() if lv == level for v in (band, s)))
            parts.append((rows if last else rows.where(F.col("__b") != coarse)).select(*rest, (start[F.col("__b")] + place).cast("int").alias(self.packed), "re", "im"))
            now = rows.where(F.col("__b") == coarse).drop("__b")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return TensorFrame(out, {n: x.axes[n] for n in rest} | {self.packed: self.total})

    def adjoint(self, y):
        rest, now = [n for n in y.names if n != self.packed], None
        for level in range(len(self.sizes) - 1, 0, -1):
            size = math.prod(self.sizes[level].values())
            own = [(band, s) for (lv, band), s in self.start.items() if lv == level]
            first, beyond = own[0][1], own[-1][1] + size
            rows = y.df.where((F.col(self.packed) >= first) & (F.col(self.packed) < beyond))
            number = F.expr(f"cast((`{self.packed}` - {first}) div {size} as int)")
            names = F.array(*(F.lit(band) for band, _ in own))
            at, left = {}, F.pmod(F.col(self.packed) - first, F.lit(size))
            for a, n in reversed(self.sizes[level].items()):
                at[a], left = F.pmod(left, F.lit(n)).cast("int"), F.floor(left / n)
            rows = rows.select(*rest, names[number].alias("__b"), *(at[a].alias(a) for a in self.axes), "re", "im")
            if now is not None:  # the coarse band that came from below; what it has beyond this level's size goes
                inside = [F.col(a) < n for a, n in self.sizes[level].items()]
                for c in inside:
                    now = now.where(c)
                rows = rows.unionByName(now.withColumn("__b", F.lit("a" * len(self.axes))).select(*rows.columns))
            for a in reversed(self.axes):
                rows = self._join(rows, rest, a, self.sizes[level - 1][a])
            now = rows.drop("__b")
        return TensorFrame(now.select(*rest, *self.axes, "re", "im"), {n: y.axes[n] for n in rest} | self.axes)
