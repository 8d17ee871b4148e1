"""Dual numbers over columns: a value and its derivatives by the parameters, both exact expressions.

`exp`, `log`, `sin`, `cos` and `sqrt` take columns and dual numbers, so that a model written with them is
differentiated by calling it with dual numbers. Absent derivatives are zero.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dual:
    value: Column
    parts: dict[str, Column] = field(default_factory=dict)

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x)))

    def _with(self, value: Column, *terms: tuple[Dual, Column | float]) -> Dual:
        """value, and the sum of each term's derivatives times its factor."""
        out: dict[str, Column] = {}
        for d, factor in terms:
            for name, part in d.parts.items():
                own = part * factor
                out[name] = out[name] + own if name in out else own
        return Dual(value, out)

    def __add__(self, o):
        o = Dual.of(o)
        return self._with(self.value + o.value, (self, 1.0), (o, 1.0))

    def __sub__(self, o):
        o = Dual.of(o)
        return self._with(self.value - o.value, (self, 1.0), (o, -1.0))

    def __mul__(self, o):
        o = Dual.of(o)
        return self._with(self.value * o.value, (self, o.value), (o, self.value))

    def __truediv__(self, o):
        o = Dual.of(o)
        value = self.value / o.value
        return self._with(value, (self, 1 / o.value), (o, -value / o.value))

    def __neg__(self):
        return self._with(-self.value, (self, -1.0))

    def __pow__(self, k: float):
        return self._with(F.pow(self.value, F.lit(float(k))), (self, F.pow(self.value, F.lit(float(k - 1))) * float(k)))

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return Dual.of(o) - self

    def __rtruediv__(self, o):
        return Dual.of(o) / self


def _lifted(f: Callable, slope: Callable) -> Callable:
    def g(x):
        if not isinstance(x, Dual):
            return f(x)
        value = f(x.value)
        return x._with(value, (x, slope(x.value, value)))

    return g


exp = _lifted(F.exp, lambda x, y: y)
log = _lifted(F.log, lambda x, y: 1 / x)
sin = _lifted(F.sin, lambda x, y: F.cos(x))
cos = _lifted(F.cos, lambda x, y: -F.sin(x))
sqrt = _lifted(F.sqrt, lambda x, y: F.try_divide(F.lit(0.5), y))


def _sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(x), x))


#: sin(x) / x, 1 at 0; near 0 the slope by its series.
sinc = _lifted(_sinc, lambda x, y: F.when(F.abs(x) < 1e-3, x * (x * x / 30 - F.lit(1 / 3))).otherwise(F.try_divide(F.cos(x) - y, x)))


def differentiate(f: Callable, wrt: list[str], **arguments) -> Dual:
    """f of columns, names or numbers, with its derivatives by the arguments named."""
    if unknown := set(wrt) - set(arguments):
        raise ValueError(f"no such arguments: {sorted(unknown)}")
    defaults = {k: p.default for k, p in inspect.signature(f).parameters.items() if p.default is not p.empty}
    return Dual.of(f(**{k: Dual(Dual.of(v).value, {k: F.lit(1.0)} if k in wrt else {}) for k, v in (defaults | arguments).items()}))
