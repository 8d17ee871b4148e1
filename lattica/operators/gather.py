"""Gather, scatter and join-like operators: sampling, coil maps, sums of products, resampling,
sparse products, dictionary matching and table lookup."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.complexpair import Pair
from lattica.plans.algebra import LinearOperator
from lattica.tensor import TensorFrame
from lattica.workers import numbered_in_order
from lattica.workers import reachable

#: Rows of a dictionary or table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a lookup table that is searched inside the row.
TABLE_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has at most so many rows; else leave the choice to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grid_key(k, n: int) -> Column:
    """Grid index of a coordinate: halves round to even, the middle of n places is 0."""
    return (F.rint(k) + n // 2).cast("int")


class CartesianSamplingOp(LinearOperator):
    """Values of a grid at the points of a trajectory.

    trajectory: sample axes and one coordinate column k_<axis> for each sampled axis. Points outside
    the grid give 0. The adjoint scatters; of several samples of a place the one with the smallest
    index counts, as they are copies of one place and are not added.
    """

    def __init__(self, trajectory: DataFrame, samples: dict[str, int], grid: dict[str, int]):
        self.samples, self.grid = samples, grid
        keys = {f"__g_{a}": grid_key(F.col(f"k_{a}"), n) for a, n in grid.items()}
        inside = F.lit(True)
        for a, n in grid.items():
            inside = inside & F.col(f"__g_{a}").between(0, n - 1)
        self.points = trajectory.withColumns(keys).where(inside).select(*samples, *keys)

    def forward(self, x: TensorFrame) -> TensorFrame:
        rest = {n: s for n, s in x.axes.items() if n not in self.grid}
        rows = x.df.withColumnsRenamed({a: f"__g_{a}" for a in self.grid}).join(self.points, [f"__g_{a}" for a in self.grid])
        return TensorFrame(rows.select(*rest, *self.samples, "re", "im"), rest | self.samples)

    def adjoint(self, y: TensorFrame) -> TensorFrame:
        rest = {n: s for n, s in y.axes.items() if n not in self.samples}
        rows = y.df.join(self.points, list(self.samples))
        keys = [F.col(f"__g_{a}").alias(a) for a in self.grid]
        first = F.min_by(F.struct("re", "im"), F.struct(*self.samples)).alias("v")
        out = rows.groupBy(*rest, *keys).agg(first).select(*rest, *self.grid, "v.re", "v.im")
        return TensorFrame(out, rest | self.grid)

    @property
    def gram(self):
        return CartesianMaskingOp(self.points.select(*(F.col(f"__g_{a}").alias(a) for a in self.grid)).distinct())


class CartesianMaskingOp(LinearOperator):
    """Keeps the places in a mask relation; the rest is 0."""

    def __init__(self, mask: DataFrame | None):
        self.mask = mask

    def forward(self, x: TensorFrame) -> TensorFrame:
        return x if self.mask is None else TensorFrame(x.df.join(self.mask, self.mask.columns, "left_semi"), x.axes)

    adjoint = forward


class SensitivityOp(LinearOperator):
    """Images times coil maps; the adjoint sums conj(map) * data over coils."""

    def __init__(self, maps: TensorFrame, coil: str = "coil"):
        self.maps, self.coil = maps, coil

    def forward(self, x):
        out = x * self.maps
        order = {n: s for n, s in out.axes.items()}
        return TensorFrame(out.df, order)

    def adjoint(self, y):
        return (y * self.maps.conj()).summed([self.coil])


class DensityCompensationOp(LinearOperator):
    """Values times real weights of some of the axes."""

    def __init__(self, weights: TensorFrame):
        self.weights = weights

    def forward(self, x):
        return x * self.weights

    adjoint = forward


class EinsumOp(LinearOperator):
    """Sum of products with a matrix: 'i j, j -> i' over named axes; other axes pass through."""

    def __init__(self, matrix: TensorFrame, rule: str):
        self.matrix = matrix
        left, self.out = rule.split("->")
        self.inner, self.into = left.split(",")[1].split(), self.out.split()

    def forward(self, x):
        return (x * self.matrix).summed([n for n in self.inner if n not in self.into])

    def adjoint(self, y):
        return (y * self.matrix.conj()).summed([n for n in self.into if n not in self.inner])


class SparseProjectionOp(LinearOperator):
    """A sparse matrix as a relation (target, source, w): product = join and grouped sum."""

    def __init__(self, matrix: DataFrame, source: tuple[str, int], target: tuple[str, int]):
        self.matrix, self.source, self.target = matrix, source, target

    def _times(self, x, a, b, came, goes):
        m = self.matrix.select(F.col(a).alias(came[0]), F.col(b).alias(goes[0]), "w")
        rows = x.df.join(m, came[0]).withColumns({"re": F.col("re") * F.col("w"), "im": F.col("im") * F.col("w")})
        axes = {n: s for n, s in x.axes.items() if n != came[0]} | {goes[0]: goes[1]}
        return x.summed([], rows, axes)

    def forward(self, x):
        return self._times(x, "source", "target", self.source, self.target)

    def adjoint(self, y):
        return self._times(y, "target", "source", self.target, self.source)

    @staticmethod
    def stacked(matrices: list[tuple[DataFrame, int]]) -> DataFrame:
        """Blocks below each other: targets are offset by the rows before."""
        out, at = None, 0
        for m, rows in matrices:
            moved = m.withColumn("target", F.col("target") + at)
            out, at = moved if out is None else out.unionByName(moved), at + rows
        return out


class GridSamplingOp(LinearOperator):
    """Linear or nearest resampling at points in [-1, 1]; outside is 0 or the border.

    points: sample axes and one column g_<axis> for each resampled axis. Each point becomes 2 ** d
    weighted neighbours, which are a sparse matrix; the adjoint swaps its sides.
    """

    def __init__(self, points: DataFrame, samples: dict[str, int], grid: dict[str, int], mode: str = "linear", padding: str = "zeros", align_corners: bool = False):
        self.samples, self.grid = samples, grid
        rows = points.withColumn("w", F.lit(1.0))
        for a, n in grid.items():
            g = F.col(f"g_{a}")
            at = (g + 1) / 2 * (n - 1) if align_corners else ((g + 1) * n - 1) / 2
            if padding == "border":
                at = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), at))
            if mode == "nearest":
                rows = rows.withColumn(f"__n_{a}", F.rint(at).cast("int"))
            else:
                low, part = F.floor(at), at - F.floor(at)
                near = F.explode(F.array(F.struct(low.cast("int").alias("i"), (1 - part).alias("w")), F.struct((low + 1).cast("int").alias("i"), part.alias("w"))))
                rows = rows.withColumn("__e", near).withColumns({f"__n_{a}": F.col("__e.i"), "w": F.col("w") * F.col("__e.w")}).drop("__e")
            rows = rows.where(F.col(f"__n_{a}").between(0, n - 1) & (F.col("w") != 0))
        self.pairs = rows.select(*samples, *(f"__n_{a}" for a in grid), "w")

    def forward(self, x):
        rest = {n: s for n, s in x.axes.items() if n not in self.grid}
        rows = x.df.withColumnsRenamed({a: f"__n_{a}" for a in self.grid}).join(self.pairs, [f"__n_{a}" for a in self.grid])
        return x.summed([], rows.withColumns({"re": F.col("re") * F.col("w"), "im": F.col("im") * F.col("w")}), rest | self.samples)

    def adjoint(self, y):
        rest = {n: s for n, s in y.axes.items() if n not in self.samples}
        rows = y.df.join(self.pairs, list(self.samples)).withColumns({"re": F.col("re") * F.col("w"), "im": F.col("im") * F.col("w")})
        return y.summed([], rows.withColumnsRenamed({f"__n_{a}": a for a in self.grid}), rest | self.grid)


#: Bytes of atoms that a worker holds, and of the products of a block of signals with a block of atoms.
ATOM_BYTES, PRODUCT_BYTES = 32 << 20, 16 << 20


def dictionary_match(signals: DataFrame, atoms: DataFrame, key: str, scale: bool = False, digits: int | None = None) -> DataFrame:
    """Best atom of each signal: the largest squared product with a normalized atom, the first atom
    of a tie: of products equal when rounded to `digits`, or else to 40 bits. signals: key, re [, im] arrays;
    atoms: atom_id, re [, im] arrays.

    Atoms are packed into matrices of ATOM_BYTES at most and broadcast; a larger dictionary is matched in
    parts whose winners are compared. Products are taken block by block, so a worker's memory grows neither with
    signals nor with atoms. Returns key, atom_id, similarity [, scale_re, scale_im].
    """
    import pandas as pd
    from pyspark.sql import types as T

    reachable(signals.sparkSession)
    complex_ = "im" in signals.columns and "im" in atoms.columns
    total, width = atoms.agg(F.count("*"), F.max(F.size("re"))).first()
    number = 16 if complex_ else 8
    parts = max(1, -(-total * max(1, width or 1) * number // ATOM_BYTES))
    step = math.isqrt(PRODUCT_BYTES // number)
    schema = T.StructType([signals.schema[key], T.StructField("atom_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("scale_re", T.DoubleType()), T.StructField("scale_im", T.DoubleType()), T.StructField("__rank", T.DoubleType())])
    sc = signals.sparkSession.sparkContext

    def matrix(rows):
        x = np.array([r.re for r in rows], float).reshape(len(rows), -1) + (1j * np.array([r.im for r in rows], float).reshape(len(rows), -1) if complex_ else 0)
        norm = np.linalg.norm(x, axis=1)
        return np.array([r.atom_id for r in rows]), x / np.where(norm == 0, 1, norm)[:, None], np.where(norm == 0, 1, norm)

    def rounded(power):
        if digits is not None:
            return np.round(power, digits)
        part, exponent = np.frexp(power)
        return np.ldexp(np.round(part * 2.0**40), exponent - 40)

    def first_best(power):
        """Place and rounded value of each row's largest: only rows with others close to it are rounded whole."""
        k, top = np.arange(len(power)), power.max(1)
        slack = 2 * 10.0**-digits if digits is not None else top * 2.0**-39
        near, rank = np.argmax(power >= (top - slack)[:, None], axis=1), rounded(top)
        unsure = np.flatnonzero(rounded(power[k, near]) != rank)
        near[unsure] = np.argmax(rounded(power[unsure]), axis=1)
        return near, rank

    def run_of(held):
        def run(batches):
            ids, unit, norm = held.value
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    some = pdf.iloc[at : at + step]
                    x = np.stack(some.re.to_numpy()) + (1j * np.stack(some.im.to_numpy()) if complex_ else 0)
                    k, rank = np.arange(len(x)), None
                    for low in range(0, len(ids), step):
                        dot = x @ unit[low : low + step].conj().T
                        near, value = first_best(np.abs(dot) ** 2 if complex_ else dot * dot)
                        new = (value, low + near, dot[k, near])
                        if rank is None:
                            rank, best, got = new
                            continue
                        better = new[0] > rank
                        rank, best, got = (np.where(better, a, b) for a, b in zip(new, (rank, best, got)))
                    factor = got / norm[best]
                    yield pd.DataFrame({key: some[key].to_numpy(), "atom_id": ids[best], "similarity": np.abs(got) ** 2, "scale_re": factor.real, "scale_im": factor.imag if complex_ else np.zeros(len(got)), "__rank": rank})

        return run

    out = None
    for k in range(parts):  # by hash: numbers may have common divisors
        rows = atoms.where(F.pmod(F.xxhash64("atom_id"), F.lit(parts)) == k).orderBy("atom_id").collect()  # about ATOM_BYTES
        if not rows:
            continue
        cols = [key, "re", *(["im"] if complex_ else [])]
        one = signals.select(*cols).mapInPandas(run_of(sc.broadcast(matrix(rows))), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = signals.sparkSession.createDataFrame([], schema)
    if parts > 1:
        best = F.max_by(F.struct("atom_id", "similarity", "scale_re", "scale_im"), F.struct("__rank", -F.col("atom_id"))).alias("b")
        out = out.groupBy(key).agg(best).select(key, "b.*")
    return out.select(key, "atom_id", "similarity", *(["scale_re", "scale_im"] if scale else []))


def interp(points: DataFrame, table: DataFrame, x: str = "x", xp: str = "xp", fp: str = "fp") -> DataFrame:
    """Piecewise-linear lookup clamped to the ends; adds `f`. A table of at most TABLE_ROWS rows
    (checked) becomes one sorted array that each row searches by halving; larger ones are joined."""
    known = table.where(F.col(xp).isNotNull()).select(F.col(xp).cast("double").alias("x"), F.col(fp).cast("double").alias("f"))
    if known.limit(TABLE_ROWS + 1).count() > TABLE_ROWS:
        return interp_join(points, table, x, xp, fp)
    held = known.agg(F.array_sort(F.collect_list(F.struct("x", "f"))).alias("__t"))
    out = points.join(F.broadcast(held)).withColumn("__x", F.col(x).cast("double"))
    halve = "(a, k) -> if(a.hi - a.lo <= 1, a, if(get(__t, cast((a.lo + a.hi) div 2 as int)).x <= __x, named_struct('lo', cast((a.lo + a.hi) div 2 as int), 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))))"
    out = out.withColumn("__i", F.expr(f"aggregate(sequence(1, {TABLE_ROWS.bit_length() + 1}), named_struct('lo', -1, 'hi', size(__t)), {halve}, a -> a.lo)"))
    a, b = F.get("__t", F.greatest(F.col("__i"), F.lit(0))), F.get("__t", F.least(F.greatest(F.col("__i") + 1, F.lit(0)), F.size("__t") - 1))
    out = out.withColumns({"__a": a, "__b": b})
    at, span = F.greatest(F.col("__x"), F.col("__a.x")), F.col("__b.x") - F.col("__a.x")
    value = F.when(span <= 0, F.col("__a.f")).otherwise(F.col("__a.f") + (at - F.col("__a.x")) * F.try_divide(F.col("__b.f") - F.col("__a.f"), span))
    return out.select(*(F.col(f"`{c}`") for c in points.columns), value.alias("f"))


def interp_join(points: DataFrame, table: DataFrame, x: str = "x", xp: str = "xp", fp: str = "fp") -> DataFrame:
    """The same as a sort-based as-of join: table and points are sorted together in ranges, and the
    last table row before a point and the first one after it come from two running values."""
    t = table.select(F.col(xp).cast("double").alias("__x"), F.struct(F.col(xp).cast("double").alias("x"), F.col(fp).cast("double").alias("f")).alias("__t"), F.lit(None).cast(points.schema.simpleString()).alias("__p"))
    p = points.select(F.col(x).cast("double").alias("__x"), F.lit(None).cast("struct<x:double,f:double>").alias("__t"), F.struct(*points.columns).alias("__p"))
    # A bucket holds a range of x, as many points as any other; the rows at its edges are added from the
    # nearest table rows. There are as many buckets as shuffle partitions, and four times as many ranges.
    from pyspark.ml.feature import Bucketizer

    parts = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(t.select("__x").unionByName(p.select("__x")).approxQuantile("__x", [k / parts for k in range(1, parts)], 0.2 / parts)))
    buckets = len(cuts) + 2  # the last one is for points that are no number
    dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__x", outputCol="__b", handleInvalid="keep") if cuts else None
    t, p = ((dealt.transform(v) if dealt else v.withColumn("__b", F.lit(0))).withColumn("__b", F.col("__b").cast("int")) for v in (t, p))
    ends = t.groupBy("__b").agg(F.min("__t").alias("first"), F.max("__t").alias("last"))
    at = Window.orderBy("__b")  # at most `buckets` rows
    every = points.sparkSession.range(buckets).select(F.col("id").cast("int").alias("__b")).join(ends, "__b", "left")
    edges = every.select("__b", F.last("last", True).over(at.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(at.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    # Both are running values: frames that look ahead would be summed anew for each row.
    up = Window.partitionBy("__b").orderBy("__x", F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__b").orderBy(F.desc("__x"), F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = t.unionByName(p).withColumns({"__lo": F.last("__t", True).over(up), "__hi": F.last("__t", True).over(down)})
    rows = rows.where("__p is not null").join(F.broadcast(edges), "__b")
    a, b = F.coalesce("__lo", "before"), F.coalesce("__hi", "after")
    a, b = F.coalesce(a, b), F.coalesce(b, a)
    span = b["x"] - a["x"]
    value = F.when(span == 0, a["f"]).otherwise(a["f"] + (F.col("__x") - a["x"]) * F.try_divide(b["f"] - a["f"], span))
    return rows.select("__p.*", value.alias("f"))


def interpolate_axis(x: TensorFrame, axis: str, size: int, mode: str = "linear") -> TensorFrame:
    """Resize an axis; place i of the result lies at (i + 1/2) * old / new - 1/2."""
    old = x.axes[axis]
    spark = x.df.sparkSession
    at = F.greatest(F.lit(0.0), F.least(F.lit(old - 1.0), (F.col("id") + 0.5) * (old / size) - 0.5))
    if mode == "nearest":
        pairs = spark.range(size).select(F.col("id").cast("int").alias("new"), F.floor(F.col("id") * (old / size)).cast("int").alias(axis), F.lit(1.0).alias("w"))
    else:
        part = at - F.floor(at)
        near = F.array(F.struct(F.floor(at).cast("int").alias("i"), (1 - part).alias("w")), F.struct(F.least(F.floor(at) + 1, F.lit(old - 1)).cast("int").alias("i"), part.alias("w")))
        pairs = spark.range(size).select(F.col("id").cast("int").alias("new"), F.explode(near).alias("e")).select("new", F.col("e.i").alias(axis), F.col("e.w").alias("w"))
    pairs = F.broadcast(pairs) if size <= BROADCAST_ROWS // 2 else pairs
    rows = x.df.join(pairs, axis).withColumns({"re": F.col("re") * F.col("w"), "im": F.col("im") * F.col("w")})
    rows = rows.drop(axis).withColumnRenamed("new", axis)
    return x.summed([], rows, x.axes | {axis: size})


def times(df: DataFrame, pair: Pair) -> DataFrame:
    return df.withColumns({"re": pair.re, "im": pair.im})


def downsampled_size(size: dict[str, int], wanted: int | dict[str, int] | None) -> dict[str, int]:
    """By axis the smaller of the size that is wanted and the one there is."""
    return {n: min(s, wanted if isinstance(wanted, int) else (wanted or {}).get(n, s)) for n, s in size.items()}


def apply_lowres(f, x: TensorFrame, size: dict[str, int]) -> TensorFrame:
    """A function of the downsampled tensor, and its result on the old grid."""
    small_ = x
    for n, s in size.items():
        small_ = interpolate_axis(small_, n, s)
    out = f(small_)
    for n in size:
        out = interpolate_axis(out, n, x.axes[n])
    return out


def grid_from_displacement(moves: DataFrame, grid: dict[str, int], prefix: str = "d_") -> DataFrame:
    """Sampling points g_<axis> in [-1, 1] of rows with the axes of a grid and displacements d_<axis>, in
    the same units: the middle of place i lies at (2 i + 1) / n - 1."""
    return moves.withColumns({f"g_{a}": (2 * F.col(a) + 1) / n - 1 + F.col(f"{prefix}{a}") for a, n in grid.items()})


def append_atoms(atoms: DataFrame, more: DataFrame) -> DataFrame:
    """A dictionary with more atoms, numbered behind those there are."""
    last = atoms.agg(F.coalesce(F.max("atom_id") + 1, F.lit(0)).alias("__n"))
    numbered = numbered_in_order(more.select("atom_id").distinct(), "atom_id", "__k")
    moved = more.join(numbered, "atom_id").join(F.broadcast(last)).withColumn("atom_id", F.col("__n") + F.col("__k"))
    return atoms.unionByName(moved.select(*atoms.columns))
