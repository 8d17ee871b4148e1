"""Wavelets with borders against NumPy convolutions."""

import numpy as np
import pytest

from lattica.operators import windowed
from lattica.operators.wavelets import BorderWaveletOp, filters, size_of
from lattica.tensor import ShapeError, TensorFrame

RNG = np.random.default_rng(6)


def split(x, name, mode, axis):
    """Coefficients of one axis by convolution with the borders written out."""
    low, high, *_ = filters(name)
    n, length = x.shape[axis], len(low)
    edge = [(0, 0)] * x.ndim
    edge[axis] = (length - 1, length - 1)
    wide = np.pad(x, edge, "constant" if mode == "zero" else "symmetric")
    out = []
    for taps in (low, high):
        full = np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), axis, wide)
        out.append(full.take(range(1, 2 * size_of(n, name), 2), axis))
    return out


def test_filters():
    """Known values, and analysis and synthesis of all families undo each other."""
    for name in ("haar", "db2", "db4"):
        assert np.allclose(filters(name)[2], windowed.WAVELETS[name], atol=1e-7)
    s = np.sqrt(2)
    assert np.allclose(sorted(filters("bior2.2")[0] / s), sorted([0, -0.125, 0.25, 0.75, 0.25, -0.125]), atol=1e-9)
    for name in ("db3", "db8", "bior1.3", "bior2.4", "bior3.3"):
        low, high, back, back_high = filters(name)
        assert abs(low.sum() - s) < 1e-6 and abs(high.sum()) < 1e-6 and abs(back.sum() - s) < 1e-6 and abs(back_high.sum()) < 1e-6
    for bad in ("db0", "bior1.2", "bior4.4", "sym4"):
        with pytest.raises(ValueError):
            filters(bad)


@pytest.mark.parametrize("name, mode", [("db4", "zero"), ("db2", "symmetric"), ("bior2.2", "zero"), ("bior1.3", "symmetric")])
def test_one_axis(spark, name, mode):
    x = RNG.normal(size=(2, 12)) + 1j * RNG.normal(size=(2, 12))
    op = BorderWaveletOp({"x": 12}, name, 2, mode)
    got = op.forward(TensorFrame.from_numpy(spark, x, ["c", "x"]))
    a, d1 = split(x, name, mode, 1)
    a2, d2 = split(a, name, mode, 1)
    packed = got.to_numpy()
    assert np.allclose(packed, np.concatenate([a2, d2, d1], 1)) and packed.shape[1] == op.total
    assert np.allclose(op.adjoint(got).to_numpy(), x, atol=1e-7)


def test_two_axes_packed(spark):
    x = RNG.normal(size=(8, 6))
    op = BorderWaveletOp({"y": 8, "x": 6}, "db2", 1)
    got = op.forward(TensorFrame.from_numpy(spark, x, ["y", "x"]))
    a, d = split(x, "db2", "zero", 0)
    bands = [b for part in (a, d) for b in split(part, "db2", "zero", 1)]
    assert np.allclose(got.to_numpy(), np.concatenate([b.ravel() for b in bands]))
    assert np.allclose(op.adjoint(got).to_numpy(), x)


def test_adjoint_of_orthonormal_filters(spark):
    """<W x, y> = <x, W' y>, for one level with zero borders."""
    op = BorderWaveletOp({"x": 10}, "db3", 1)
    x, y = RNG.normal(size=10), RNG.normal(size=op.total)
    left = op.forward(TensorFrame.from_numpy(spark, x, ["x"])).to_numpy().real @ y
    right = op.adjoint(TensorFrame.from_numpy(spark, y, ["coefficient"])).to_numpy().real @ x
    assert left == pytest.approx(right)


def test_shapes():
    with pytest.raises(ShapeError):
        BorderWaveletOp({"x": 7})
    with pytest.raises(ValueError):
        BorderWaveletOp({"x": 8}, mode="odd")
