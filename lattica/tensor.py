"""Dense arrays as relations: one row a value, one INT column an axis, DOUBLE re and im."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.complexpair import Pair


#: Values of the second factor of an outer product that are broadcast.
OUTER_ROWS = 1_000_000


class ShapeError(ValueError):
    """Axes do not fit each other."""


@dataclass(frozen=True)
class TensorFrame:
    """axes: name -> size, the last varies fastest. Rows that are absent are 0."""

    df: DataFrame
    axes: dict[str, int]

    @property
    def names(self) -> list[str]:
        return list(self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.axes.values())

    @property
    def value(self) -> Pair:
        return Pair(F.col("re"), F.col("im"))

    @classmethod
    def from_numpy(cls, spark: SparkSession, x: np.ndarray, names: list[str]) -> TensorFrame:
        if x.ndim != len(names):
            raise ShapeError(f"{x.ndim} axes, {len(names)} names")
        import pandas as pd

        at = np.indices(x.shape).reshape(x.ndim, -1)
        cols = {n: a.astype("int32") for n, a in zip(names, at)} | {"re": np.real(x).ravel().astype(float), "im": np.imag(x).ravel().astype(float)}
        schema = ", ".join([f"`{n}` int" for n in names] + ["re double", "im double"])
        return cls(spark.createDataFrame(pd.DataFrame(cols), schema), dict(zip(names, x.shape)))

    def to_numpy(self) -> np.ndarray:
        """For results of a known small size."""
        out, rows = np.zeros(self.shape, complex), self.df.select(*self.names, "re", "im").toPandas()
        out[tuple(rows[n].to_numpy() for n in self.names)] = rows.re.to_numpy() + 1j * rows.im.to_numpy()
        return out

    def with_value(self, value: Pair, df: DataFrame | None = None, axes: dict[str, int] | None = None) -> TensorFrame:
        axes = axes or self.axes
        return TensorFrame((self.df if df is None else df).select(*axes, value.re.alias("re"), value.im.alias("im")), axes)

    def map(self, f: Callable[[Pair], Pair]) -> TensorFrame:
        return self.with_value(f(self.value))

    def summed(self, drop: list[str], df: DataFrame | None = None, axes: dict[str, int] | None = None) -> TensorFrame:
        """Sum over axes: partial sums are made before the shuffle."""
        axes = {n: s for n, s in (axes or self.axes).items() if n not in drop}
        rows = (self.df if df is None else df).groupBy(*axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        return TensorFrame(rows, axes)

    def grid(self, spark: SparkSession | None = None, names: list[str] | None = None) -> DataFrame:
        """All index combinations, from one range and index arithmetic."""
        names = names or self.names
        spark = spark or self.df.sparkSession
        out, step = spark.range(math.prod(self.axes[n] for n in names)), 1
        for n in reversed(names):
            out = out.withColumn(n, F.pmod(F.expr(f"id div {step}"), F.lit(self.axes[n])).cast("int"))
            step *= self.axes[n]
        return out.drop("id")

    def dense(self) -> TensorFrame:
        rows = self.grid().join(self.df, self.names, "left").na.fill(0.0, ["re", "im"])
        return TensorFrame(rows, self.axes)

    def __add__(self, o: TensorFrame) -> TensorFrame:
        if self.axes != o.axes:
            raise ShapeError(f"{self.axes} and {o.axes}")
        cols = [*self.names, "re", "im"]
        return self.summed([], self.df.select(*cols).unionByName(o.df.select(*cols)))

    def __sub__(self, o: TensorFrame) -> TensorFrame:
        return self + o * -1.0

    def __mul__(self, s) -> TensorFrame:
        """By a number, or by a tensor over some of the axes (missing axes broadcast)."""
        if not isinstance(s, TensorFrame):
            return self.map(lambda v: v * (s if isinstance(s, complex) else float(s)))
        shared = [n for n in s.names if n in self.axes]
        axes = self.axes | {n: k for n, k in s.axes.items() if n not in self.axes}
        right = s.df.select(*s.names, F.col("re").alias("re2"), F.col("im").alias("im2"))
        if not shared and math.prod(s.shape) <= OUTER_ROWS:  # an outer product has all pairs
            right = F.broadcast(right)
        rows = self.df.join(right, shared) if shared else self.df.crossJoin(right)
        return self.with_value(self.value * Pair(F.col("re2"), F.col("im2")), rows, axes)

    __rmul__ = __mul__

    def conj(self) -> TensorFrame:
        return self.map(Pair.conj)

    def vdot(self, o: TensorFrame) -> complex:
        """Sum of conj(self) * other: two numbers come to the driver."""
        right = o.df.select(*o.names, F.col("re").alias("re2"), F.col("im").alias("im2"))
        v = self.value.conj() * Pair(F.col("re2"), F.col("im2"))
        r = self.df.join(right, self.names).agg(F.sum(v.re), F.sum(v.im)).first()
        return complex(r[0] or 0.0, r[1] or 0.0)

    def norm2(self) -> float:
        return self.df.agg(F.sum(self.value.abs2())).first()[0] or 0.0

    def renamed(self, names: dict[str, str]) -> TensorFrame:
        return TensorFrame(self.df.withColumnsRenamed(names), {names.get(n, n): s for n, s in self.axes.items()})

    def cut(self) -> TensorFrame:
        """End the lineage with a checkpoint in the shared folder; for loops."""
        return replace(self, df=checkpointed(self.df))


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared folder; a temporary folder serves only where all runs in one machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        import tempfile

        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
    return df.checkpoint()
