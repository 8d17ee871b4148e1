"""Split and gridded Fourier transforms against NumPy and direct sums."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import fourier, gridding
from lattica.tensor import TensorFrame

RNG = np.random.default_rng(5)


def tensor(spark, shape, names):
    x = RNG.normal(size=shape) + 1j * RNG.normal(size=shape)
    return x, TensorFrame.from_numpy(spark, x, names)


@pytest.mark.parametrize("n,most", [(96, 1 << 16), (96, 16), (35, 8), (4096, 64)])
def test_split_transform(spark, n, most):
    x, t = tensor(spark, (2, n), ["c", "k"])
    want = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(x, axes=1), norm="ortho"), axes=1)
    op = gridding.SplitFourierOp(["k"], most=most)
    got = op.forward(t)
    assert np.allclose(got.to_numpy(), want) and np.allclose(op.adjoint(got).to_numpy(), x)


def test_no_task_gathers_a_long_line(spark):
    """Lists that are gathered hold a factor of the axis at most; an axis without factors raises."""
    _, t = tensor(spark, (1 << 12,), ["k"])
    plan = gridding.SplitFourierOp(["k"], most=64).forward(t).df
    assert plan.count() == 1 << 12
    split = t.df.withColumn("j", F.col("k") % 64).groupBy("j").count().agg(F.max("count")).first()[0]
    assert split == 64
    with pytest.raises(ValueError, match="no two factors"):
        gridding.SplitFourierOp(["k"], most=64).forward(TensorFrame(t.df, {"k": 4099}))


def direct(points, axes, encoding, img):
    ph = fourier.NonUniformFourierOp(axes, points, encoding)._phases()
    full = ph[0]
    for p in ph[1:]:
        full = (full[:, :, None] * p[:, None, :]).reshape(len(points), -1)
    full = full / math.sqrt(math.prod(encoding.values()))
    return full, img.reshape(len(img), -1) @ full.T


@pytest.mark.parametrize("shape,tile,pack", [((9,), 4096, 2048), ((12, 7), 64, 2048), ((12, 7), 8, 30), ((20, 6), 8, 7), ((6, 5, 4), 16, 2048)])
@pytest.mark.parametrize("width,error", [(6, 1e-4), (12, 1e-10)])
def test_gridding(spark, monkeypatch, shape, tile, pack, width, error):
    """Forward and adjoint, with crowded samples, coordinates outside one period, tiles and packs."""
    monkeypatch.setitem(gridding.TILE, len(shape), tile)
    monkeypatch.setattr(gridding, "PACK", pack)
    names = ["z", "y", "x"][-len(shape) :]
    axes = dict(zip(names, shape))
    enc = {a: n + 3 for a, n in axes.items()}
    points = RNG.uniform(-0.5, 0.5, (200, len(shape))) * [enc[a] for a in names]
    points[:100] *= 0.01
    points[100:110] += enc[names[-1]]
    track = spark.createDataFrame(pd.DataFrame({"sample": np.arange(200, dtype="int32")} | {f"k_{a}": points[:, d] for d, a in enumerate(names)}))
    img, t = tensor(spark, (2, *shape), ["c", *names])
    op = gridding.GriddedFourierOp(axes, track, {"sample": 200}, enc, width=width)
    full, want = direct(points, axes, enc, img)
    assert abs(op.forward(t).to_numpy() - want).max() < error * abs(want).max()
    y, ty = tensor(spark, (2, 200), ["c", "sample"])
    back = (y @ full.conj()).reshape(2, *shape)
    assert abs(op.adjoint(ty).to_numpy() - back).max() < error * abs(back).max()
    # <A x, y> = <x, A' y>
    assert abs(np.vdot(want, y) - np.vdot(img, back)) < 1e-9 * abs(np.vdot(want, y)) + 1e-9


def test_gram_and_choice(spark):
    axes = {"y": 6, "x": 8}
    points = RNG.uniform(-3, 3, (60, 2))
    track = spark.createDataFrame(pd.DataFrame({"s": np.arange(60, dtype="int32"), "k_y": points[:, 0], "k_x": points[:, 1]}))
    op = fourier.fourier_op(axes, axes, track, {"s": 60})
    assert isinstance(op, gridding.GriddedFourierOp) and op.gram is op.gram
    img, t = tensor(spark, (1, 6, 8), ["c", "y", "x"])
    full, y = direct(points, axes, axes, img)
    want = (y @ full.conj()).reshape(1, 6, 8)
    assert abs(op.gram(t)[0].to_numpy() - want).max() < 1e-4 * abs(want).max()


def test_a_crowded_tile_is_dealt_over_packs(spark):
    """All samples in one place: no list holds more than a pack and its chance."""
    n = 20_000
    track = spark.range(n).select(F.col("id").cast("int").alias("sample"), F.lit(0.25).alias("k_x"))
    x, t = tensor(spark, (16,), ["x"])
    op = gridding.GriddedFourierOp({"x": 16}, track, {"sample": n})
    got = op.forward(t).df.agg(F.count("*"), F.stddev("re"), F.max("re")).first()
    want = (x * np.exp(-2j * np.pi * 0.25 * (np.arange(16) - 8) / 16)).sum().real / 4
    assert got[0] == n and got[1] < 1e-12 and abs(got[2] - want) < 1e-4
