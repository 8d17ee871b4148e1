"""Structure: rearranging, padding, unions, windows of blocks, patches, index arithmetic."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.algebra import LinearOperator
from lattica.tensor import ShapeError, TensorFrame


def _parse(side: str) -> list[list[str]]:
    return [m.group(1).split() if m.group(1) is not None else [m.group(2)] for m in re.finditer(r"\(([^)]*)\)|(\S+)", side)]


def rearrange(x: TensorFrame, pattern: str, **sizes: int) -> TensorFrame:
    """'a b c -> (a c) b': merging and splitting axes are index arithmetic, so no data move."""
    left, right = (_parse(s) for s in pattern.split("->"))
    if len(left) != len(x.axes):
        raise ShapeError(f"{pattern} for {x.axes}")
    df, known, temp = x.df, dict(sizes), {}
    for name, group in zip(x.names, left):
        size = x.axes[name]
        open_ = [g for g in group if g not in known]
        if len(open_) > 1:
            raise ShapeError(f"sizes of {open_} are not given")
        if open_:
            known[open_[0]] = size // math.prod(known[g] for g in group if g in known)
        step = 1
        for g in reversed(group):
            temp[g] = F.pmod(F.floor(F.col(f"`{name}`") / step), F.lit(known[g])).cast("int")
            step *= known[g]
        if step != size:
            raise ShapeError(f"{group} have {step} places, {name} has {size}")
    axes, cols = {}, []
    for group in right:
        name, at = "_".join(group), F.lit(0)
        for g in group:
            at = at * known[g] + temp[g]
        axes[name] = math.prod(known[g] for g in group)
        cols.append(at.cast("int").alias(name))
    return TensorFrame(df.select(*cols, "re", "im"), axes)


class RearrangeOp(LinearOperator):
    def __init__(self, pattern: str, **sizes: int):
        self.pattern, self.sizes, self.names = pattern, sizes, None

    def forward(self, x):
        left, _ = self.pattern.split("->")
        for group, size in zip(_parse(left), x.shape):
            if len(group) == 1:
                self.sizes.setdefault(group[0], size)
        self.names = x.names
        return rearrange(x, self.pattern, **self.sizes)

    def adjoint(self, y):
        left, right = self.pattern.split("->")
        out = rearrange(y, f"{right.strip()} -> {left.strip()}", **self.sizes)
        return out.renamed(dict(zip(out.names, self.names))) if self.names else out


class PadOrCropOp(LinearOperator):
    """Center axes in a new size: indices shift, rows outside go, absent rows are 0. Of an odd
    difference the larger half is in front."""

    def __init__(self, old: dict[str, int], new: dict[str, int]):
        self.old, self.new = old, new

    @staticmethod
    def _to(x: TensorFrame, old, new) -> TensorFrame:
        df = x.df
        for n in new:
            more = new[n] - old[n]
            df = df.withColumn(n, (F.col(n) + (more - math.trunc(more / 2))).cast("int")).where((F.col(n) >= 0) & (F.col(n) < new[n]))
        return TensorFrame(df, x.axes | new)

    def forward(self, x):
        return self._to(x, self.old, self.new)

    def adjoint(self, y):
        return self._to(y, self.new, self.old)


def concatenate(parts: list[TensorFrame], axis: str) -> TensorFrame:
    out, at = None, 0
    for p in parts:
        moved = p.df.withColumn(axis, (F.col(axis) + at).cast("int"))
        out = moved if out is None else out.unionByName(moved)
        at += p.axes[axis]
    return TensorFrame(out, parts[0].axes | {axis: at})


def stack(parts: list[TensorFrame], axis: str = "stack") -> TensorFrame:
    if any(p.axes != parts[0].axes for p in parts):
        raise ShapeError("stacked tensors differ in shape")
    out = None
    for k, p in enumerate(parts):
        one = p.df.select(F.lit(k).alias(axis), *p.names, "re", "im")
        out = one if out is None else out.unionByName(one)
    return TensorFrame(out, {axis: len(parts)} | parts[0].axes)


def ravel_index(index: list, dims: list[int]):
    """Row-major flat index of columns."""
    out = F.lit(0)
    for c, n in zip(index, dims):
        out = out * n + c
    return out


def unravel_index(flat, dims: list[int]) -> list:
    out, step = [], 1
    for n in reversed(dims):
        out.append(F.pmod(F.floor(flat / step), F.lit(n)))
        step *= n
    return out[::-1]


def split_blocks(df: DataFrame, at: str, size: int, overlap: int = 0, cyclic: bool = False, n: str | None = None) -> DataFrame:
    """Rows with the block they are in and their place there; a row is in several blocks if they
    overlap. Only whole blocks count. at: place from 0; n: column with the number of places."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be below the block size")
    count = F.col(n)
    if cyclic:
        # The first `step` places are appended once more.
        rows = df.withColumn("__at", F.explode(F.when(F.col(at) < F.least(F.lit(step), count), F.array(F.col(at), F.col(at) + count)).otherwise(F.array(F.col(at)))))
        count = count + F.least(F.lit(step), count)
    else:
        rows = df.withColumn("__at", F.col(at))
    last = F.floor((count - size) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("__at") - size + 1) / step))
    until = F.least(last, F.floor(F.col("__at") / step))
    rows = rows.where(until >= first).withColumn("block", F.explode(F.sequence(first.cast("int"), until.cast("int"))))
    return rows.withColumn("place", (F.col("__at") - F.col("block") * step).cast("int")).drop("__at")


class PatchOp(LinearOperator):
    """Windows along axes; the adjoint adds overlapping patches up."""

    def __init__(self, axes: dict[str, int], size: dict[str, int], stride: dict[str, int] | None = None, dilation: dict[str, int] | None = None):
        self.axes, self.size = axes, size
        self.stride = {n: (stride or size)[n] for n in size}
        self.dilation = {n: (dilation or {}).get(n, 1) for n in size}
        self.count = {n: (axes[n] - self.dilation[n] * (size[n] - 1) - 1) // self.stride[n] + 1 for n in size}

    def forward(self, x):
        df, patch = x.df, F.lit(0)
        for n, size in self.size.items():
            df = df.withColumn(f"__k_{n}", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
            start = F.col(n) - F.col(f"__k_{n}") * self.dilation[n]
            df = df.withColumn(f"__s_{n}", start).where((start >= 0) & (F.pmod(start, F.lit(self.stride[n])) == 0) & (start / self.stride[n] < self.count[n]))
            patch = patch * self.count[n] + F.floor(F.col(f"__s_{n}") / self.stride[n])
        axes = {"patch": math.prod(self.count.values())} | {n: self.size.get(n, s) for n, s in x.axes.items()}
        cols = [patch.cast("int").alias("patch"), *(F.col(f"__k_{n}").alias(n) if n in self.size else F.col(n) for n in x.names)]
        return TensorFrame(df.select(*cols, "re", "im"), axes)

    def adjoint(self, y):
        df, starts = y.df, unravel_index(F.col("patch"), list(self.count.values()))
        cols = {n: (s * self.stride[n] + F.col(n) * self.dilation[n]).cast("int") for n, s in zip(self.size, starts)}
        axes = {n: self.axes.get(n, s) for n, s in y.axes.items() if n != "patch"}
        return y.summed([], df.withColumns(cols), axes)


def reduce_repeat(x: TensorFrame, axis: str, tol: float = 1e-6) -> TensorFrame:
    """Collapse an axis along which nothing varies by more than tol."""
    others = [n for n in x.names if n != axis]
    spread = x.df.groupBy(*others).agg((F.max("re") - F.min("re")).alias("a"), (F.max("im") - F.min("im")).alias("b")).agg(F.max("a"), F.max("b")).first()
    if max(spread[0] or 0, spread[1] or 0) > tol:
        return x
    return TensorFrame(x.df.where(F.col(axis) == 0), x.axes | {axis: 1})


def select_in_order(df: DataFrame, label: str, values: list, order: list[str]) -> DataFrame:
    """Rows by label, in the order in which values are asked for; unknown values raise."""
    known = {r[0] for r in df.where(F.col(label).isin(values)).select(label).distinct().collect()}  # as many as values
    if missing := [v for v in values if v not in known]:
        raise ValueError(f"no such label: {missing}")
    wanted = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], f"{label} {df.schema[label].dataType.simpleString()}, position int")
    return df.join(F.broadcast(wanted), label).orderBy("position", *order)


#: Labels by significance, the last one sorts first.
SORT_LABELS = ("k1", "k2", "average", "slice", "contrast", "phase", "repetition", "set", "user0", "user1", "user2", "user3", "user4", "user7")


def regroup(df: DataFrame, labels: list[str], inner: list[str], by: list[str] | None = None) -> DataFrame:
    """Dense places of sorted rows: `other` numbers the label combinations and `place` the rows in
    one. Later labels are more significant. `by` parts independent data sets. Combinations are
    numbered apart from the rows, so only they meet in one order."""
    by = by or []
    keys, inside = [*by, *labels], Window.partitionBy(*by, *labels).orderBy(*reversed(inner))
    order = Window.partitionBy(*by).orderBy(*reversed(labels))
    numbered = df.select(*keys).distinct().withColumn("other", F.row_number().over(order) - 1)
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    placed = df.withColumn("place", F.row_number().over(inside) - 1)
    return placed.alias("a").join(numbered.alias("b"), same).select(*(F.col(f"a.`{c}`") for c in df.columns), "b.other", "a.place")


# Axes: what moves no data


def normalize_axis(x: TensorFrame, axis: str | int) -> str:
    """The name of an axis given by name or place; places may count from the end."""
    if isinstance(axis, str):
        if axis not in x.axes:
            raise IndexError(f"no axis {axis} in {x.names}")
        return axis
    if not -len(x.axes) <= axis < len(x.axes):
        raise IndexError(f"axis {axis} of {len(x.axes)}")
    return x.names[axis]


def normalize_axes(x: TensorFrame, axes, unique: bool = True) -> list[str]:
    out = [normalize_axis(x, a) for a in axes]
    if unique and len(set(out)) != len(out):
        raise ValueError(f"axes named twice: {out}")
    return out


def unsqueeze_at(x: TensorFrame, place: int, names: list[str]) -> TensorFrame:
    """New axes of size 1 before a place (from the end if negative)."""
    if not -len(x.axes) - 1 <= place <= len(x.axes):
        raise IndexError(f"place {place} of {len(x.axes)} axes")
    place = place + len(x.axes) + 1 if place < 0 else place
    if clash := set(names) & set(x.axes):
        raise ShapeError(f"axes there already: {sorted(clash)}")
    order = [*x.names[:place], *names, *x.names[place:]]
    return TensorFrame(x.df.withColumns({n: F.lit(0) for n in names}).select(*order, "re", "im"), {n: x.axes.get(n, 1) for n in order})


def unsqueeze_left(x: TensorFrame, names: list[str]) -> TensorFrame:
    return unsqueeze_at(x, 0, names)


def unsqueeze_right(x: TensorFrame, names: list[str]) -> TensorFrame:
    return unsqueeze_at(x, len(x.axes), names)


def aligned(*tensors: TensorFrame, side: str = "left") -> list[TensorFrame]:
    """All tensors with all axes, new ones of size 1 on the left or right of their own."""
    every = list(dict.fromkeys(n for t in sorted(tensors, key=lambda t: -len(t.axes)) for n in t.names))
    out = []
    for t in tensors:
        more = [n for n in every if n not in t.axes]
        out.append(unsqueeze_left(t, more) if side == "left" else unsqueeze_right(t, more))
    return out


def aligned_at(*tensors: TensorFrame, place: int) -> list[TensorFrame]:
    every = list(dict.fromkeys(n for t in sorted(tensors, key=lambda t: -len(t.axes)) for n in t.names))
    return [unsqueeze_at(t, place, [n for n in every if n not in t.axes]) for t in tensors]


def expand(x: TensorFrame, axis: str, size: int) -> TensorFrame:
    """An axis of size 1 repeated."""
    if x.axes[axis] not in (1, size):
        raise ShapeError(f"{axis} has {x.axes[axis]} places")
    if x.axes[axis] == size:
        return x
    rows = x.df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return TensorFrame(rows.select(*x.names, "re", "im"), x.axes | {axis: size})


def broadcast(*tensors: TensorFrame) -> list[TensorFrame]:
    """All tensors with the same axes and sizes: axes of size 1, or not there, are repeated."""
    out = aligned(*tensors)
    sizes = {n: max(t.axes[n] for t in out) for n in out[0].names}
    for n in sizes:
        out = [expand(t, n, sizes[n]) for t in out]
    order = list(max(tensors, key=lambda t: len(t.axes)).names)
    order = [n for n in sizes if n not in order] + order
    return [TensorFrame(t.df.select(*order, "re", "im"), {n: sizes[n] for n in order}) for t in out]


def reduce_view(x: TensorFrame, axes: list[str] | None = None, tol: float = 0.0) -> TensorFrame:
    """Axes along which nothing varies become size 1."""
    for n in axes or x.names:
        if x.axes[n] > 1 and len(x.axes) > 1:
            x = reduce_repeat(x, n, tol)
    return x


def fill_range(x: TensorFrame, axis: str) -> TensorFrame:
    """Every value becomes its place along the axis."""
    return TensorFrame(x.grid().select(*x.names, F.col(axis).cast("double").alias("re"), F.lit(0.0).alias("im")), x.axes)


def reshape(x: TensorFrame, axes: dict[str, int]) -> TensorFrame:
    """The same values in row-major order over other axes; one size may be -1."""
    total, known = math.prod(x.shape), math.prod(s for s in axes.values() if s != -1)
    if list(axes.values()).count(-1) > 1:
        raise ShapeError("only one size can be inferred")
    if any(s == -1 for s in axes.values()):
        if known == 0 or total % known:
            raise ShapeError(f"{axes} for {total} values")
        axes = {n: total // known if s == -1 else s for n, s in axes.items()}
    elif known != total:
        raise ShapeError(f"{axes} for {total} values")
    flat = F.lit(0).cast("long")
    for n, s in x.axes.items():
        flat = flat * s + F.col(n)
    rows = x.df.select(flat.alias("__flat"), "re", "im")
    cols = [i.cast("int").alias(n) for n, i in zip(axes, unravel_index(F.col("__flat"), list(axes.values())))]
    return TensorFrame(rows.select(*cols, "re", "im"), axes)


def swap_axes(x: TensorFrame, a: str, b: str) -> TensorFrame:
    """Places of two axes in the order exchanged; names stay with their values."""
    order = [{a: b, b: a}.get(n, n) for n in x.names]
    return TensorFrame(x.df.select(*order, "re", "im"), {n: x.axes[n] for n in order})


def equal(x: TensorFrame, y: TensorFrame, tol: float = 0.0) -> bool:
    """Same axes, and no value differs by more than tol; absent rows are 0."""
    if x.axes != y.axes:
        return False
    return (x - y).df.where(F.greatest(F.abs("re"), F.abs("im")) > tol).limit(1).count() == 0


def index(x: TensorFrame, /, **at) -> TensorFrame:
    """Parts by axis: a number keeps the axis with one place, slices have a step of at least 1, a list of
    numbers takes them in its order, a list of bools the places that are true. Places from the end are
    negative; numbers outside raise an error. Lists of numbers for several axes go one by one together,
    over a new first axis `picked`."""
    lists = {}
    for n, s in list(at.items()):
        size = x.axes[n]
        if isinstance(s, (list, tuple)) and s and all(isinstance(v, bool) for v in s):
            if len(s) != size:
                raise IndexError(f"{len(s)} bools for {size} places of {n}")
            s = [k for k, v in enumerate(s) if v]
            at[n] = s
        if isinstance(s, slice):
            start, stop, step = s.indices(size)
            if step < 1:
                raise IndexError("steps must be positive")
            inside = (F.col(n) >= start) & (F.col(n) < stop) & (F.pmod(F.col(n) - start, F.lit(step)) == 0)
            rows = x.df.where(inside).withColumn(n, F.floor((F.col(n) - start) / step).cast("int"))
            x = TensorFrame(rows, x.axes | {n: len(range(start, stop, step))})
            continue
        many = [s] if isinstance(s, int) else list(s)
        if any(not -size <= v < size for v in many):
            raise IndexError(f"{many} outside {size} places of {n}")
        many = [v % size for v in many]
        if isinstance(s, int):
            x = TensorFrame(x.df.where(F.col(n) == many[0]).withColumn(n, F.lit(0)), x.axes | {n: 1})
        else:
            lists[n] = many
    if len({len(v) for v in lists.values()}) > 1:
        raise IndexError("lists of different lengths")
    if not lists:
        return x
    spark, count = x.df.sparkSession, len(next(iter(lists.values())))
    wanted = spark.createDataFrame([(k, *v) for k, v in enumerate(zip(*lists.values()))], "__k int, " + ", ".join(f"{n} int" for n in lists))
    rows = x.df.join(wanted, list(lists))
    if len(lists) == 1:
        n = next(iter(lists))
        return TensorFrame(rows.withColumn(n, F.col("__k")).select(*x.names, "re", "im"), x.axes | {n: count})
    rest = [n for n in x.names if n not in lists]
    return TensorFrame(rows.select(F.col("__k").alias("picked"), *rest, "re", "im"), {"picked": count} | {n: x.axes[n] for n in rest})
