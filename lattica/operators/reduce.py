"""Reductions, functionals with proximal mappings, statistics and coil estimates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lattica.functions.complexpair import Pair
from lattica.plans.algebra import LinearOperator, Operator
from lattica.tensor import ShapeError, TensorFrame
from lattica.workers import reachable

# Sums over axes


def rss(x: TensorFrame, coil: str = "coil") -> TensorFrame:
    """Root of the sum of squared magnitudes over coils."""
    axes = {n: s for n, s in x.axes.items() if n != coil}
    rows = x.df.groupBy(*axes).agg(F.sqrt(F.sum(x.value.abs2())).alias("re")).withColumn("im", F.lit(0.0))
    return TensorFrame(rows, axes)


class AveragingOp(LinearOperator):
    """Means over groups of places of an axis; groups is a relation (group, <axis>) and may overlap."""

    def __init__(self, groups: DataFrame, axis: str, size: int):
        self.axis, self.size = axis, size
        self.pairs = groups.select("group", axis)
        self.count = groups.agg(F.max("group")).first()[0] + 1
        self.n = groups.groupBy("group").agg(F.count("*").alias("__n"))

    def forward(self, x):
        rest = {n: s for n, s in x.axes.items() if n != self.axis}
        sums = x.df.join(self.pairs, self.axis).groupBy(*rest, "group").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        rows = sums.join(self.n, "group").withColumns({"re": F.col("re") / F.col("__n"), "im": F.col("im") / F.col("__n")})
        return TensorFrame(rows.select(*rest, "group", "re", "im"), rest | {"group": self.count})

    def adjoint(self, y):
        rest = {n: s for n, s in y.axes.items() if n != "group"}
        rows = y.df.join(self.pairs.join(self.n, "group"), "group").withColumns({"re": F.col("re") / F.col("__n"), "im": F.col("im") / F.col("__n")})
        return y.summed([], rows, rest | {self.axis: self.size})


# Functionals


class Functional(Operator):
    """f(x) = sum over `dim` of a cost of weight * (x - target); other axes stay.

    weight: number; target: number or None; dim None takes all axes; divide_by_n gives the mean.
    """

    def __init__(self, target: complex = 0.0, weight: float = 1.0, dim: list[str] | None = None, divide_by_n: bool = False):
        self.target, self.weight, self.dim, self.divide_by_n = complex(target), float(weight), dim, divide_by_n

    def _n(self, x: TensorFrame) -> int:
        return math.prod(x.axes[n] for n in (self.dim or x.names)) if self.divide_by_n else 1

    def cost(self, d: Pair) -> Column:
        raise NotImplementedError

    def forward(self, x: TensorFrame) -> TensorFrame:
        axes = {n: s for n, s in x.axes.items() if n not in (self.dim or x.names)}
        cost = self.cost((x.value - self.target) * self.weight)
        rows = x.df.groupBy(*axes).agg((F.sum(cost) / self._n(x)).alias("re")).withColumn("im", F.lit(0.0))
        return TensorFrame(rows, axes)

    def __rmul__(self, s):
        return ScaledFunctional(self, s)

    def __or__(self, other):
        return SeparableSum(self, other)


def _positive(sigma: float) -> float:
    if isinstance(sigma, complex) or sigma < 0:
        raise ValueError("sigma must be real and not negative")
    return float(sigma)


class ProximableFunctional(Functional):
    """prox(x, s) = argmin_y s f(y) + |y - x|² / 2; the conjugate's comes from Moreau's identity."""

    def prox_value(self, v: Pair, sigma: float) -> Pair:
        raise NotImplementedError

    def prox(self, x: TensorFrame, sigma: float = 1.0) -> TensorFrame:
        return x.map(lambda v: self.prox_value(v, _positive(sigma) / self._n(x)))

    def prox_convex_conj(self, x: TensorFrame, sigma: float = 1.0) -> TensorFrame:
        s = max(_positive(sigma), 1e-8)
        return x.map(lambda v: v - self.prox_value(v * (1 / s), 1 / s / self._n(x)) * s)


class L1Norm(ProximableFunctional):
    def cost(self, d):
        return d.magnitude()

    def prox_value(self, v, sigma):
        d = v - self.target
        m = d.magnitude()
        return d * F.when(m == 0, F.lit(0.0)).otherwise(F.try_divide(F.greatest(m - abs(self.weight) * sigma, F.lit(0.0)), m)) + self.target


class L1NormViewAsReal(ProximableFunctional):
    """Real and imaginary parts count apart."""

    def cost(self, d):
        return F.abs(d.re) + F.abs(d.im)

    def prox_value(self, v, sigma):
        d, t = v - self.target, abs(self.weight) * sigma
        return Pair(*(F.signum(p) * F.greatest(F.abs(p) - t, F.lit(0.0)) for p in (d.re, d.im))) + self.target


class L2NormSquared(ProximableFunctional):
    def cost(self, d):
        return d.abs2()

    def prox_value(self, v, sigma):
        k = 2 * sigma * self.weight**2
        return (v + Pair.of(self.target) * k) * (1 / (1 + k))


class MSE(L2NormSquared):
    def __init__(self, target=0.0, weight=1.0, dim=None, divide_by_n=True):
        super().__init__(target, weight, dim, divide_by_n)


class ZeroFunctional(ProximableFunctional):
    def cost(self, d):
        return F.lit(0.0)

    def prox_value(self, v, sigma):
        return v

    def prox_convex_conj(self, x, sigma=1.0):
        return x if sigma == 0 else x * 0.0


class ScaledFunctional(ProximableFunctional):
    def __init__(self, f: ProximableFunctional, scale: float):
        self.f, self.scale = f, _positive(scale)

    def forward(self, x):
        return self.f.forward(x) * self.scale

    def prox(self, x, sigma=1.0):
        return self.f.prox(x, sigma * self.scale)

    def prox_convex_conj(self, x, sigma=1.0):
        if self.scale == 0:
            return x * 0.0
        return self.f.prox_convex_conj(x * (1 / self.scale), sigma / self.scale) * self.scale


class SeparableSum(Operator):
    """f1(x1) + f2(x2) + ...; proximal mappings input by input."""

    def __init__(self, *fs):
        self.fs = [g for f in fs for g in (f.fs if isinstance(f, SeparableSum) else [f])]

    def _check(self, x):
        if len(x) != len(self.fs):
            raise ShapeError(f"{len(self.fs)} inputs, not {len(x)}")

    def forward(self, *x):
        self._check(x)
        outs = [f.forward(v) for f, v in zip(self.fs, x)]
        return sum(outs[1:], outs[0])

    def prox(self, *x, sigma=1.0):
        self._check(x)
        return tuple(f.prox(v, sigma) for f, v in zip(self.fs, x))

    def prox_convex_conj(self, *x, sigma=1.0):
        self._check(x)
        return tuple(f.prox_convex_conj(v, sigma) for f, v in zip(self.fs, x))

    def __or__(self, other):
        return SeparableSum(self, other)


def ssim(target: TensorFrame, image: TensorFrame, window: dict[str, int], data_range: float | None = None, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """Structural similarity of each whole window: window start columns and `ssim`. Each place is
    dealt to the windows that hold it, and five sums are taken for each window."""
    rows = target.df.select(*target.names, F.col("re").alias("a")).join(image.df.select(*image.names, F.col("re").alias("b")), target.names, "full").na.fill(0.0, ["a", "b"])
    if data_range is None:
        lo, hi = target.df.agg(F.min("re"), F.max("re")).first()
        data_range = hi - lo
    for n, size in window.items():
        first, last = F.greatest(F.lit(0), F.col(n) - size + 1), F.least(F.lit(target.axes[n] - size), F.col(n))
        rows = rows.where(last >= first).withColumn(n, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    n = math.prod(window.values())
    a, b = F.col("a"), F.col("b")
    m = rows.groupBy(*target.names).agg((F.sum(a) / n).alias("a"), (F.sum(b) / n).alias("b"), (F.sum(a * a) / n).alias("aa"), (F.sum(b * b) / n).alias("bb"), (F.sum(a * b) / n).alias("ab"))
    c1, c2, unbias = (k1 * data_range) ** 2, (k2 * data_range) ** 2, n / (n - 1)
    va, vb, cab = unbias * (F.col("aa") - a * a), unbias * (F.col("bb") - b * b), unbias * (F.col("ab") - a * b)
    return m.select(*target.names, ((2 * a * b + c1) * (2 * cab + c2) / ((a * a + b * b + c1) * (va + vb + c2))).alias("ssim"))


# Statistics


#: Entries of partial matrices that a task holds before it passes them on.
HELD_ENTRIES = 1 << 20


def covariance(df: DataFrame, by: list[str], sample: list[str], channel: str, center: bool = False) -> DataFrame:
    """(by, i, j, re, im): mean over samples of x_i conj(x_j). Vectors of a sample are gathered in one
    array; each task adds its outer products up and passes on one row a pair of channels, so neither
    samples nor pairs of a sample are shuffled a second time. Absent entries do not count."""
    import pyarrow as pa

    vec = df.groupBy(*by, *sample).agg(F.array_sort(F.collect_list(F.struct(channel, "re", "im"))).alias("x"))
    vec = vec.select(*by, F.col(f"x.{channel}").alias("c"), F.col("x.re").alias("re"), F.col("x.im").alias("im"))
    reachable(df.sparkSession)
    names = [*by, "i", "j", "n", "re", "im", "ar", "ai", "br", "bi"]
    kind = df.schema[channel].dataType
    schema = StructType([*(vec.schema[k] for k in by), StructField("i", kind), StructField("j", kind), StructField("n", LongType()), *(StructField(k, DoubleType()) for k in names[-6:])])

    def run(batches):
        held: dict = {}

        def out(types):
            cols = [[] for _ in names]
            for (key, channels), (n, total, mean) in held.items():
                k = len(channels)
                left, right = np.repeat(mean, k), np.tile(mean, k)
                parts = ([channels[i] for i in range(k) for _ in range(k)], [*channels] * k, [n] * (k * k), total.real.ravel(), total.imag.ravel(), left.real, left.imag, right.real, right.imag)
                for c, v in zip(cols, (*([x] * (k * k) for x in key), *(list(p) for p in parts))):
                    c += v
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        types = []
        for batch in batches:
            types = [*(batch.column(k).type for k in range(len(by))), *(2 * [batch.column(len(by)).type.value_type]), pa.int64(), *(6 * [pa.float64()])]
            rows: dict = {}
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))))) if by else [()] * batch.num_rows
            for key, c, re, im in zip(keys, *(batch.column(len(by) + k).to_pylist() for k in range(3))):
                rows.setdefault((key, tuple(c)), []).append((re, im))
            for key, got in rows.items():
                x = np.array(got, float)
                x = x[:, 0] + 1j * x[:, 1]
                n, total, mean = held.get(key, (0, 0, 0))
                held[key] = n + len(x), total + x.T @ x.conj(), mean + x.sum(0)
            if sum(len(c) ** 2 for _, c in held) > HELD_ENTRIES:
                yield out(types)
        if held:
            yield out(types)

    sums = vec.mapInArrow(run, schema).groupBy(*by, "i", "j").agg(*(F.sum(k).alias(k) for k in names[len(by) + 2 :]))
    m = sums.select(*by, "i", "j", *((F.col(k) / F.col("n")).alias(k) for k in names[-6:]))
    if center:
        p = Pair(F.col("ar"), F.col("ai")) * Pair(F.col("br"), F.col("bi")).conj()
        m = m.withColumns({"re": F.col("re") - p.re, "im": F.col("im") - p.im})
    return m.select(*by, "i", "j", "re", "im")


def _matrix(rows, n: int) -> np.ndarray:
    m = np.zeros((n, n), complex)
    for r in rows:
        m[r.i, r.j] = complex(r.re, r.im)
    return m


def pca_matrix(x: TensorFrame, channel: str, components: int, center: bool = True, rotate: bool = False) -> np.ndarray:
    """Leading eigenvectors (rows) of the channel covariance; channels are few, so their matrix is
    decomposed on the driver. Centering concerns the matrix only."""
    sample = [n for n in x.names if n != channel]
    m = _matrix(covariance(x.df, [], sample, channel, center).collect(), x.axes[channel])  # channels² rows
    _, v = np.linalg.eigh(m)
    top = v[:, ::-1][:, :components].conj().T
    return varimax(top.T).T if rotate else top


def varimax(phi: np.ndarray, gamma: float = 1.0, steps: int = 20) -> np.ndarray:
    """Orthogonal rotation of columns that spreads their squared entries."""
    n, k = phi.shape
    r = np.eye(k, dtype=phi.dtype)
    for _ in range(steps):
        a = phi @ r
        b = np.abs(a) ** 2 * a - gamma / n * a @ np.diag((np.abs(a) ** 2).sum(0))
        u, _, v = np.linalg.svd(phi.conj().T @ b)
        r = u @ v
    return phi @ r


def matrix_operator(x: TensorFrame, m: np.ndarray, channel: str, out: str):
    from lattica.operators.gather import EinsumOp

    t = TensorFrame.from_numpy(x.df.sparkSession, m, [out, channel])
    return EinsumOp(t, f"{out} {channel}, {channel} -> {out}")


def compress_coils(x: TensorFrame, components: int, coil: str = "coil") -> TensorFrame:
    m = pca_matrix(x, coil, components)
    return matrix_operator(x, m, coil, "__c")(x)[0].renamed({"__c": coil})


def whitening_matrix(noise: TensorFrame, coil: str = "coil", scale: float = 1.0) -> np.ndarray:
    """Inverse Cholesky factor of the noise covariance (means stay in), times the root of scale."""
    sample = [n for n in noise.names if n != coil]
    m = _matrix(covariance(noise.df, [], sample, coil).collect(), noise.axes[coil])
    return np.linalg.inv(np.linalg.cholesky(m)) * math.sqrt(scale)


def prewhiten(x: TensorFrame, noise: TensorFrame, scale: float = 1.0, coil: str = "coil") -> TensorFrame:
    m = whitening_matrix(noise, coil, scale)
    return matrix_operator(x, m, coil, "__c")(x)[0].renamed({"__c": coil})


def density_1d(df: DataFrame, by: list[str], k: str, digits: int = 15) -> DataFrame:
    """Rows with `w`: half the distance between the neighbouring distinct points, the whole distance
    at the ends, divided by the number of equal points; 1 for a single point."""
    point = F.round(F.col(k), digits)
    distinct = df.groupBy(*by, point.alias("__k")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__k")
    before, after = F.col("__k") - F.lag("__k").over(w), F.lead("__k").over(w) - F.col("__k")
    width = F.when(before.isNull() & after.isNull(), F.lit(1.0)).otherwise((F.coalesce(before, after) + F.coalesce(after, before)) / 2)
    weights = distinct.withColumn("w", width / F.col("__n")).drop("__n")
    return df.withColumn("__k", point).join(weights, [*by, "__k"]).drop("__k")


#: Points of a leaf of the search tree, and cells that are cut together.
LEAF, CELLS = 8, 16384


class _Nearest:
    """The nearest of many points: a balanced tree of boxes, cut at the median of each box's longer side; all
    queries go down together."""

    def __init__(self, points: np.ndarray):
        self.levels = max(0, math.ceil(math.log2(max(1, len(points) / LEAF))))
        at = np.resize(np.arange(len(points)), (1, -(-len(points) // 2**self.levels) * 2**self.levels))  # the last places repeat points
        self.boxes = []
        for level in range(self.levels + 1):
            x = points[at]
            low, high = x.min(1), x.max(1)
            self.boxes.append([np.ascontiguousarray(v) for v in (*low.T, *high.T)])
            if level < self.levels:
                along = np.take_along_axis(x, np.argmax(high - low, 1)[:, None, None], 2)[:, :, 0]
                half = at.shape[1] // 2
                at = np.take_along_axis(at, np.argpartition(along, half, 1), 1).reshape(-1, half)
        self.at, (self.x, self.y) = at, np.moveaxis(points[at], 2, 0)

    def _away(self, level, node, qx, qy):
        left, low, right, high = self.boxes[level]
        dx = np.maximum(np.maximum(left[node] - qx, qx - right[node]), 0)
        dy = np.maximum(np.maximum(low[node] - qy, qy - high[node]), 0)
        return dx * dx + dy * dy

    def __call__(self, q: np.ndarray, bound: np.ndarray):
        """(index, squared distance) of the nearest point within the bound; -1 if none is."""
        bound, best = bound.copy(), np.full(len(q), -1)
        qx, qy = np.ascontiguousarray(q.T)

        def leaves(query, node):
            d = (self.x[node] - qx[query, None]) ** 2 + (self.y[node] - qy[query, None]) ** 2
            k = np.argmin(d, 1)
            return d[np.arange(len(k)), k], self.at[node, k]

        node = np.zeros(len(q), np.int64)
        for level in range(self.levels):  # down to the nearer box each time: a first bound
            left, right = self._away(level + 1, 2 * node, qx, qy), self._away(level + 1, 2 * node + 1, qx, qy)
            node = 2 * node + (right < left)
        d, which = leaves(np.arange(len(q)), node)
        near = d < bound
        bound[near], best[near] = d[near], which[near]
        query, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.levels):
            query, node = np.repeat(query, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            open_ = self._away(level + 1, node, qx[query], qy[query]) < bound[query]
            query, node = query[open_], node[open_]
        if len(query):
            d, which = leaves(query, node)
            order = np.lexsort((which, d, query))
            query, d, which = query[order], d[order], which[order]
            first = np.r_[True, query[1:] != query[:-1]]
            query, d, which = query[first], d[first], which[first]
            near = d < bound[query]
            bound[query[near]], best[query[near]] = d[near], which[near]
        return best, bound


def _cut(x, y, done, n, nx, ny, off):
    """Polygons (rows of corners, n of each) cut to nx * x + ny * y <= off; done marks go with their corners."""
    width = x.shape[1]
    k = np.arange(width)
    held = k < n[:, None]
    after = np.where(k + 1 < n[:, None], k + 1, 0)
    side = np.where(held, x * nx[:, None] + y * ny[:, None] - off[:, None], 0.0)
    take = lambda v: np.take_along_axis(v, after, 1)
    other = take(side)
    inside, cross = held & (side <= 0), held & (side * other < 0)
    t = side / np.where(cross, side - other, 1.0)
    both = np.stack([inside, cross], 2).reshape(len(x), -1)
    corner = lambda v, w: np.stack([v, w], 2).reshape(len(v), -1)
    cols = [corner(x, x + (take(x) - x) * t), corner(y, y + (take(y) - y) * t), corner(done, np.zeros_like(done))]
    n = both.sum(1)
    row, col = np.nonzero(both)
    to = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for v in cols:
        c = np.zeros((len(x), max(width, n.max(initial=0))), v.dtype)
        c[row, to] = v[row, col]
        out.append(c)
    return *out, n


def voronoi_2d(points: np.ndarray) -> np.ndarray:
    """Areas of the Voronoi cells of distinct points inside a box ten times their extent. A cell is whole when no
    point is nearer to one of its corners than its own; else the nearest one's bisector cuts that corner off. Corners'
    nearest points come from a tree, so the time grows like n log n however the points lie."""
    center, half = (points.max(0) + points.min(0)) / 2, np.maximum((points.max(0) - points.min(0)) / 2, 1e-9) * 10
    points, out = points - center, np.zeros(len(points))
    # Some of the points first, by a sixteenth of the next ones: corners are near by when all are asked.
    drawn, sizes = np.random.default_rng(0).permutation(len(points)), [len(points)]
    while sizes[-1] > 64:
        sizes.append(sizes[-1] // 16)
    trees = [(drawn[:k], _Nearest(points[drawn[:k]])) for k in reversed(sizes)]
    for at in range(0, len(points), CELLS):
        own = np.arange(at, min(at + CELLS, len(points)))
        m = len(own)
        px, py = points[own].T
        x, y = np.tile(half[0] * np.array([-1.0, 1, 1, -1]), (m, 1)), np.tile(half[1] * np.array([-1.0, -1, 1, 1]), (m, 1))
        n = np.full(m, 4)
        for names, tree in trees:
            done, left = np.zeros(x.shape, bool), np.arange(m)
            while len(left):
                far = (x[left] - px[left, None]) ** 2 + (y[left] - py[left, None]) ** 2
                far[done[left] | (np.arange(x.shape[1]) >= n[left, None])] = -1
                k = far.argmax(1)
                d = far[np.arange(len(left)), k]
                left, k, d = left[d >= 0], k[d >= 0], d[d >= 0]
                near, _ = tree(np.stack([x[left, k], y[left, k]], 1), d * (1 - 1e-12))
                qx, qy = points[names[near]].T
                nx, ny = qx - px[left], qy - py[left]
                off = ((qx + px[left]) * nx + (qy + py[left]) * ny) / 2
                cuts = (near >= 0) & (x[left, k] * nx + y[left, k] * ny > off)
                done[left[~cuts], k[~cuts]] = True
                rows = left[cuts]
                if len(rows):
                    cx, cy, cd, cn = _cut(x[rows], y[rows], done[rows], n[rows], nx[cuts], ny[cuts], off[cuts])
                    more = ((0, 0), (0, max(0, cx.shape[1] - x.shape[1])))
                    x, y, done = np.pad(x, more), np.pad(y, more), np.pad(done, more)
                    x[rows], y[rows], done[rows], n[rows] = cx, cy, cd, cn
        held = np.arange(x.shape[1]) < n[:, None]
        after = np.where(np.arange(x.shape[1]) + 1 < n[:, None], np.arange(x.shape[1]) + 1, 0)
        u, v = x - px[:, None], y - py[:, None]
        out[own] = abs(np.where(held, u * np.take_along_axis(v, after, 1) - v * np.take_along_axis(u, after, 1), 0).sum(1)) / 2
    return out


def density_2d(df: DataFrame, by: list[str], k1: str, k2: str) -> DataFrame:
    """Rows with `w`: the area of the point's Voronoi cell over the number of equal points; areas
    beyond the third quartile + 1.5 quartile ranges become the mean of the largest 1 % of the rest.
    One group's distinct points are one task's."""
    def run(pdf):
        pts, where, count = np.unique(pdf[[k1, k2]].to_numpy(float).round(12), axis=0, return_inverse=True, return_counts=True)
        area = voronoi_2d(pts) if len(pts) > 1 else np.ones(1)
        q1, q3 = np.percentile(area, [25, 75])
        ok = area <= q3 + 1.5 * (q3 - q1)
        top = np.sort(area[ok])[::-1][: max(1, round(0.01 * ok.sum()))].mean()
        area = np.where(ok, area, top)
        return pdf.assign(w=(area / count)[where.ravel()])

    reachable(df.sparkSession)
    schema = StructType([*df.schema, StructField("w", DoubleType())])
    return df.groupBy(*by).applyInPandas(run, schema)


def coil_maps(images: np.ndarray, width: int = 5, method: str = "walsh", steps: int = 10) -> np.ndarray:
    """Coil sensitivities of one bounded image (coil, [z,] y, x). Used inside grouped functions.

    walsh: the top eigenvector of the coil covariance smoothed over the neighbourhood (zeros outside).
    inati: of the neighbourhood (edges repeated) as a matrix of coils and voxels the top left vector, from
    the sum of its voxels on, with the phase that the combined voxels of the neighbourhood have."""
    if method == "inati" and width % 2 == 0:
        raise ValueError("the width must be odd")
    axes = range(1, images.ndim)

    def smooth(a, mode):
        for axis in axes:
            axis -= images.ndim
            w = 1 if a.shape[axis] == 1 and method == "inati" else width
            pad = [(0, 0)] * a.ndim
            pad[axis] = ((w - 1) // 2, w - 1 - (w - 1) // 2)
            c = np.cumsum(np.pad(a, pad, mode=mode), axis=axis)
            c = np.concatenate([np.zeros_like(np.take(c, [0], axis)), c], axis)
            a = np.take(c, range(w, c.shape[axis]), axis) - np.take(c, range(c.shape[axis] - w), axis)
        return a

    norm = lambda v: np.sqrt((np.abs(v) ** 2).sum(0))
    if method == "walsh":
        cov = smooth(images[:, None] * images[None].conj(), "constant") / width ** len(axes)
        v = cov.sum(0)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                v = np.einsum("ij...,j...->i...", cov, v / norm(v))
            v = v / norm(v)
        return np.where(np.isfinite(v), v, 0)
    cov, sums = smooth(images[:, None].conj() * images[None], "edge"), smooth(images, "edge")
    v = sums / (norm(sums) + 1e-8)
    for _ in range(steps):
        v = np.einsum("ij...,j...->i...", cov, v)
        v = v / (norm(v) + 1e-8)
    phase = (sums * v).sum(0)
    return v.conj() * (phase / (np.abs(phase) + 1e-8))


def coil_maps_frame(x: TensorFrame, other: str = "other", coil: str = "coil", width: int = 5, method: str = "walsh") -> TensorFrame:
    """Coil maps of each `other`, over the axes y, x and z if there is one; one image is one task's."""
    reachable(x.df.sparkSession)
    names = [coil, *(n for n in ("z", "y", "x") if n in x.axes)]
    shape = tuple(x.axes[n] for n in names)

    def run(pdf):
        img = np.zeros(shape, complex)
        img[tuple(pdf[n] for n in names)] = pdf.re + 1j * pdf.im
        m, at = coil_maps(img, width, method), np.indices(shape).reshape(len(shape), -1)
        import pandas as pd

        return pd.DataFrame({other: pdf[other].iloc[0], **dict(zip(names, at)), "re": m.real.ravel(), "im": m.imag.ravel()})

    rows = x.df.groupBy(other).applyInPandas(run, ", ".join(f"{n} int" for n in (other, *names)) + ", re double, im double")
    return TensorFrame(rows, {other: x.axes[other]} | dict(zip(names, shape)))


def mean_rotation(df: DataFrame, by: list[str], q=("qz", "qy", "qx", "qw"), weight: str | None = None) -> DataFrame:
    """Mean quaternion of each group: the top eigenvector of the sum of w q qT, found by power
    iteration on ten sums, in expressions."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.groupBy(*by).agg(*(F.sum(w * F.col(q[i]) * F.col(q[j])).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)))
    m = [[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(4)] for i in range(4)]
    start = F.array(*(m[i][i] for i in range(4)))
    best = F.array_position(start, F.array_max(start)).cast("int") - 1
    rows = F.array(*(F.array(*m[i]) for i in range(4)))
    flat = sums.withColumns({"__m": rows, "__v": F.get(rows, best)})
    step = "(v, k) -> transform(__m, r -> aggregate(zip_with(r, v, (a, b) -> a * b), 0D, (s, t) -> s + t) / greatest(1e-300D, sqrt(aggregate(transform(__m, u -> power(aggregate(zip_with(u, v, (a, b) -> a * b), 0D, (s, t) -> s + t), 2)), 0D, (s, t) -> s + t))))"
    flat = flat.withColumn("__v", F.expr(f"aggregate(sequence(1, 40), __v, {step})"))
    sign = F.when(F.get("__v", F.lit(3)) < 0, -1.0).otherwise(1.0)
    return flat.select(*by, *((F.get("__v", F.lit(i)) * sign).alias(q[i]) for i in range(4)))


def align_vectors(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], weight: str | None = None) -> tuple[np.ndarray, float]:
    """The rotation that takes b closest to a (least squares), and the root of the residual: nine sums,
    then one 3 x 3 decomposition."""
    w = F.col(weight) if weight else F.lit(1.0)
    row = df.agg(*(F.sum(w * F.col(a[i]) * F.col(b[j])).alias(f"m{i}{j}") for i in range(3) for j in range(3)), F.sum(w * sum((F.col(c) ** 2 for c in (*a, *b)), F.lit(0.0))).alias("n")).first()
    m = np.array([[row[f"m{i}{j}"] or 0.0 for j in range(3)] for i in range(3)])
    u, s, v = np.linalg.svd(m)
    d = np.sign(np.linalg.det(u @ v))
    s[2] *= d
    u[:, 2] *= d
    return u @ v, math.sqrt(max(0.0, (row["n"] or 0.0) - 2 * s.sum()))
