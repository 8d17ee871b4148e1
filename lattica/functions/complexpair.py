"""Complex numbers as pairs of DOUBLE columns; everything stays inside generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.dual import Dual


def column(x) -> Column:
    return x if isinstance(x, (Column, Dual)) else F.col(x) if isinstance(x, str) else F.lit(float(x))


@dataclass(frozen=True)
class Pair:
    re: Column
    im: Column

    @staticmethod
    def of(x) -> Pair:
        if isinstance(x, Pair):
            return x
        if isinstance(x, complex):
            return Pair(F.lit(x.real), F.lit(x.imag))
        return Pair(column(x), F.lit(0.0))

    def __add__(self, o):
        o = Pair.of(o)
        return Pair(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        o = Pair.of(o)
        return Pair(self.re - o.re, self.im - o.im)

    def __mul__(self, o):
        if not isinstance(o, (Pair, complex)):
            o = column(o)
            return Pair(self.re * o, self.im * o)
        o = Pair.of(o)
        return Pair(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    __radd__, __rmul__ = __add__, __mul__

    def conj(self) -> Pair:
        return Pair(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def magnitude(self) -> Column:
        return F.sqrt(self.abs2())

    def phase(self) -> Column:
        return F.atan2(self.im, self.re)

    @staticmethod
    def polar(r, phi) -> Pair:
        r, phi = column(r), column(phi)
        return Pair(r * F.cos(phi), r * F.sin(phi))
