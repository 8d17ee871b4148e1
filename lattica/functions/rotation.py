"""Rotations as columns (qz, qy, qx, qw, improper) and vectors as (z, y, x), in expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.complexpair import column


@dataclass(frozen=True)
class Vec:
    """A (z, y, x) triple; comparisons hold when they hold for all three."""

    z: Column
    y: Column
    x: Column

    @staticmethod
    def of(v) -> Vec:
        return v if isinstance(v, Vec) else Vec(column(v), column(v), column(v))

    @staticmethod
    def from_xyz(x, y, z) -> Vec:
        return Vec(column(z), column(y), column(x))

    @staticmethod
    def from_array_zyx(a) -> Vec:
        """Of an array column with three entries in the order z, y, x."""
        a = F.col(a) if isinstance(a, str) else a
        return Vec(*(F.get(a, F.lit(k)) for k in range(3)))

    @staticmethod
    def from_array_xyz(a) -> Vec:
        a = F.col(a) if isinstance(a, str) else a
        return Vec(*(F.get(a, F.lit(k)) for k in (2, 1, 0)))

    @property
    def zyx(self) -> tuple[Column, Column, Column]:
        return self.z, self.y, self.x

    def array_zyx(self) -> Column:
        return F.array(*self.zyx)

    def map(self, f) -> Vec:
        """The same function of each component."""
        return Vec(*map(f, self.zyx))

    def _with(self, o, f) -> Vec:
        o = Vec.of(o)
        return Vec(f(self.z, o.z), f(self.y, o.y), f(self.x, o.x))

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: a / b)

    def __floordiv__(self, o):
        return self._with(o, lambda a, b: F.floor(a / b))

    def __neg__(self):
        return Vec(-self.z, -self.y, -self.x)

    def _all(self, o, f) -> Column:
        v = self._with(o, f)
        return v.z & v.y & v.x

    def lt(self, o):
        return self._all(o, lambda a, b: a < b)

    def le(self, o):
        return self._all(o, lambda a, b: a <= b)

    def gt(self, o):
        return self._all(o, lambda a, b: a > b)

    def ge(self, o):
        return self._all(o, lambda a, b: a >= b)

    def eq(self, o):
        return self._all(o, lambda a, b: a == b)

    def stored(self, df: DataFrame, name: str) -> tuple[DataFrame, Vec]:
        """As columns of a table; long chains of products otherwise repeat their inputs."""
        cols = {f"{name}_{k}": c for k, c in zip("zyx", (self.z, self.y, self.x))}
        return df.withColumns(cols), Vec(*map(F.col, cols))

    def dot(self, o) -> Column:
        v = self * o
        return v.z + v.y + v.x

    def cross(self, o) -> Vec:
        return Vec(self.x * o.y - self.y * o.x, self.z * o.x - self.x * o.z, self.y * o.z - self.z * o.y)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))


@dataclass(frozen=True)
class Rot:
    """Unit quaternion v + w; improper ones also turn the vector around."""

    v: Vec
    w: Column
    improper: Column

    @staticmethod
    def from_quat(qz, qy, qx, qw, improper=False) -> Rot:
        v, w = Vec(column(qz), column(qy), column(qx)), column(qw)
        n = F.sqrt(v.dot(v) + w * w)
        return Rot(v / n, w / n, improper if isinstance(improper, Column) else F.lit(bool(improper)))

    @staticmethod
    def identity() -> Rot:
        return Rot.from_quat(0.0, 0.0, 0.0, 1.0)

    @staticmethod
    def from_rotvec(r: Vec, degrees: bool = False) -> Rot:
        angle = r.norm()
        half = angle * (math.pi / 360 if degrees else 0.5)
        k = F.when(angle == 0, F.lit(0.0)).otherwise(F.try_divide(F.sin(half), angle))
        return Rot(r * k, F.cos(half), F.lit(False))

    @staticmethod
    def about(axis: str, angle, degrees: bool = False) -> Rot:
        a = column(angle) * (math.pi / 180 if degrees else 1.0) / 2
        zero = F.lit(0.0)
        return Rot(Vec(*(F.sin(a) if k == axis else zero for k in "zyx")), F.cos(a), F.lit(False))

    @staticmethod
    def from_euler(seq: str, angles, degrees: bool = False) -> Rot:
        """Capital axes turn with the body, small ones are fixed."""
        out = None
        for axis, angle in zip(seq, angles):
            out = Rot.about(axis.lower(), angle, degrees) if out is None else out._turned(axis.lower(), angle, degrees, seq.isupper())
        return out or Rot.identity()

    def _turned(self, axis: str, angle, degrees: bool, right: bool) -> Rot:
        """The product with a turn about an axis (`right`: it is the second factor), without its zeros."""
        a = column(angle) * (math.pi / 180 if degrees else 1.0) / 2
        c, s, v = F.cos(a), F.sin(a), dict(zip("zyx", self.v.zyx))
        before, after = {"x": "zy", "y": "xz", "z": "yx"}[axis]  # the axis across each of the others
        across = {before: -v[after], after: v[before]}
        part = {n: v[n] * c + (self.w if n == axis else across[n] * (1 if right else -1)) * s for n in "zyx"}
        return Rot(Vec(*(part[n] for n in "zyx")), self.w * c - v[axis] * s, self.improper)

    @staticmethod
    def from_matrix(m) -> Rot:
        """m[row][column] in z, y, x order; the largest of four candidates divides."""
        det = sum((1 if p in ("012", "120", "201") else -1) * m[0][int(p[0])] * m[1][int(p[1])] * m[2][int(p[2])] for p in ("012", "120", "201", "021", "102", "210"))
        sign = F.when(det < 0, -1.0).otherwise(1.0)
        r = {(a, b): m["zyx".index(a)]["zyx".index(b)] * sign for a in "zyx" for b in "zyx"}
        trace = r["x", "x"] + r["y", "y"] + r["z", "z"]
        w, x = 1 + trace, 1 + 2 * r["x", "x"] - trace
        y, z = 1 + 2 * r["y", "y"] - trace, 1 + 2 * r["z", "z"] - trace
        a, b, c = r["z", "y"] - r["y", "z"], r["x", "z"] - r["z", "x"], r["y", "x"] - r["x", "y"]
        xy, xz, yz = r["x", "y"] + r["y", "x"], r["x", "z"] + r["z", "x"], r["y", "z"] + r["z", "y"]
        rows = F.array(F.array(c, b, a, w), F.array(xz, xy, x, a), F.array(yz, y, xy, b), F.array(z, yz, xz, c))  # (z, y, x, w) from w, x, y, z
        size = F.array(w, x, y, z)
        best = F.get(rows, F.array_position(size, F.array_max(size)).cast("int") - 1)
        return Rot.from_quat(*(F.get(best, F.lit(k)) for k in range(4)), improper=det < 0)

    def matrix(self) -> list[list[Column]]:
        v, w = {"z": self.v.z, "y": self.v.y, "x": self.v.x}, self.w
        sign = F.when(self.improper, -1.0).otherwise(1.0)
        turn = {("x", "y"): -1, ("y", "x"): 1, ("x", "z"): 1, ("z", "x"): -1, ("y", "z"): -1, ("z", "y"): 1}

        def entry(a, b):
            if a == b:
                return sign * (1 - 2 * sum(v[k] * v[k] for k in "zyx" if k != a))
            third = next(k for k in "zyx" if k not in (a, b))
            return sign * 2 * (v[a] * v[b] + turn[a, b] * w * v[third])

        return [[entry(a, b) for b in "zyx"] for a in "zyx"]

    def __matmul__(self, o: Rot) -> Rot:
        v = o.v * self.w + self.v * o.w + self.v.cross(o.v)
        return Rot(v, self.w * o.w - self.v.dot(o.v), self.improper != o.improper)

    def stored(self, df: DataFrame, name: str) -> tuple[DataFrame, Rot]:
        """As columns of a table; long chains of products otherwise repeat their inputs."""
        cols = {f"{name}_{k}": c for k, c in zip(("z", "y", "x", "w", "i"), (self.v.z, self.v.y, self.v.x, self.w, self.improper))}
        z, y, x, w, i = map(F.col, cols)
        return df.withColumns(cols), Rot(Vec(z, y, x), w, i)

    def inv(self) -> Rot:
        return Rot(-self.v, self.w, self.improper)

    def invert_axes(self) -> Rot:
        return Rot(self.v, self.w, ~self.improper)

    def apply(self, p: Vec, inverse: bool = False) -> Vec:
        q = self.inv() if inverse else self
        t = q.v.cross(p) * 2.0
        out = p + t * q.w + q.v.cross(t)
        return out * F.when(q.improper, -1.0).otherwise(1.0)

    def canonical(self) -> Rot:
        s = F.when(self.w < 0, -1.0).otherwise(1.0)
        return Rot(self.v * s, self.w * s, self.improper)

    def magnitude(self) -> Column:
        return 2 * F.atan2(self.v.norm(), F.abs(self.w))

    def rotvec(self) -> Vec:
        q = self.canonical()
        n = q.v.norm()
        return q.v * F.when(n < 1e-12, F.lit(2.0)).otherwise(F.try_divide(self.magnitude(), n))

    def power(self, n) -> Rot:
        out = Rot.from_rotvec(self.rotvec() * n)
        return Rot(out.v, out.w, self.improper & (F.pmod(F.lit(n), F.lit(2)) == 1))

    def approx_equal(self, o: Rot, atol: float = 1e-6) -> Column:
        return ((self @ o.inv()).magnitude() < atol) & (self.improper == o.improper)

    @property
    def det(self) -> Column:
        return F.when(self.improper, -1.0).otherwise(1.0)

    def reflect(self) -> Rot:
        """Combined with the mirror at the plane across the rotation axis: a mirror is an inversion with
        half a turn about the axis. Without an axis (no turn) the plane across z, the first axis, is taken."""
        n = self.v.norm()
        scale = F.when(n < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), n))
        none = F.when(n < 1e-12, F.lit(1.0)).otherwise(0.0)
        half = Rot(Vec(self.v.z * scale + none, self.v.y * scale, self.v.x * scale), F.lit(0.0), F.lit(True))
        return half @ self

    @staticmethod
    def from_directions(b1: Vec, b2: Vec, b3: Vec) -> Rot:
        """From the columns of the matrix, in the order z, y, x of what they are images of. Rows whose
        columns do not form a rotation (a volume off 1 by more than a tenth) raise an error."""
        cols = [b.zyx for b in (b1, b2, b3)]
        volume = b1.dot(Vec(b2.y * b3.x - b2.x * b3.y, b2.x * b3.z - b2.z * b3.x, b2.z * b3.y - b2.y * b3.z))
        out = Rot.from_matrix([[cols[j][i] for j in range(3)] for i in range(3)])
        wrong = F.raise_error(F.lit("the directions do not form a rotation")).cast("double")
        return Rot(out.v, F.when(F.abs(1 - F.abs(volume)) > 0.1, wrong).otherwise(out.w), out.improper)

    def directions(self) -> tuple[Vec, Vec, Vec]:
        m = self.matrix()
        return tuple(Vec(*(m[i][j] for i in range(3))) for j in range(3))

    def quat(self, canonical: bool = False) -> tuple[Column, Column, Column, Column]:
        """(z, y, x, w); canonical: the sign of the first of w, z, y, x that is not zero is positive."""
        q = (*self.v.zyx, self.w)
        if not canonical:
            return q
        first = F.coalesce(*(F.when(c != 0, c) for c in (self.w, *self.v.zyx)))
        return tuple(c * F.when(first < 0, -1.0).otherwise(1.0) for c in q)

    def euler(self, seq: str, degrees: bool = False) -> tuple[Column, Column, Column]:
        """Angles of any sequence of three axes, no two neighbours equal; capital ones turn with the body.
        Where the middle angle leaves the outer ones open (both ends on one axis: 0 or half a turn; else a
        quarter), the last angle is 0. Of the quaternion e is taken: its parts along the first axis, the
        middle axis and the third direction tell half sums and half differences of the outer angles."""
        if len(seq) != 3 or seq[0].lower() == seq[1].lower() or seq[1].lower() == seq[2].lower() or not (seq.isupper() or seq.islower()):
            raise ValueError(f"no sequence of three axes: {seq}")
        body, part = seq.isupper(), dict(zip("zyx", self.v.zyx))
        i, j, k = seq.lower() if not body else seq.lower()[::-1]
        proper = i == k
        third = next(a for a in "xyz" if a not in (i, j))
        sign = 1.0 if (i + j + third) in ("xyz", "yzx", "zxy") else -1.0
        a, b, c, d = (self.w, part[i], part[j], part[third] * sign)
        if not proper:
            a, b, c, d = a - c, b + d, c + a, d - b
        middle = 2 * F.atan2(F.sqrt(c * c + d * d), F.sqrt(a * a + b * b))
        half_sum, half_diff = F.atan2(b, a), F.atan2(d, c)
        low, high = middle < 1e-7, middle > math.pi - 1e-7
        first, last = half_sum - half_diff, half_sum + half_diff
        if body:  # the reversed sequence was solved: its third angle is the first of the body's
            first = F.when(low | high, F.lit(0.0)).otherwise(first)
            last = F.when(low, 2 * half_sum).when(high, 2 * half_diff).otherwise(last)
        else:
            last = F.when(low | high, F.lit(0.0)).otherwise(last)
            first = F.when(low, 2 * half_sum).when(high, -2 * half_diff).otherwise(first)
        if not proper:
            last, middle = last * sign, middle - math.pi / 2
        turn = lambda t: t - 2 * math.pi * F.rint(t / (2 * math.pi))
        out = (turn(first), middle, turn(last))
        out = out[::-1] if body else out
        return tuple(t * (180 / math.pi) for t in out) if degrees else out

    def euler_zyx(self) -> tuple[Column, Column, Column]:
        """Angles of the body sequence ZYX; at the pole the last one is 0."""
        m = self.matrix()
        xx, yx, zx, zy, zz, xy, yy = m[2][2], m[1][2], m[0][2], m[0][1], m[0][0], m[2][1], m[1][1]
        pole = F.abs(zx) > 1 - 1e-12
        return (
            F.when(pole, F.atan2(-xy, yy)).otherwise(F.atan2(yx, xx)),
            F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -zx))),
            F.when(pole, F.lit(0.0)).otherwise(F.atan2(zy, zz)),
        )
