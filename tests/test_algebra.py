"""Adjoints, rewrites and solvers against numpy."""

import math

import numpy as np
import pytest

from lattica.operators import epg, fourier, gather, reduce, structure, windowed
from lattica.plans import solvers
from lattica.plans.algebra import Adjoint, Identity, OperatorMatrix, Zero
from lattica.sources import generators
from lattica.tensor import ShapeError, TensorFrame

RNG = np.random.default_rng(0)


def tensor(spark, shape, names):
    x = RNG.normal(size=shape) + 1j * RNG.normal(size=shape)
    return x, TensorFrame.from_numpy(spark, x, names)


def operators(spark):
    pts = RNG.uniform(-4, 4, (9, 1))
    xy = {"y": 6, "x": 8}
    traj = spark.createDataFrame([(k, float(k - 4)) for k in range(7)], "sample int, k_x double")
    grid = spark.createDataFrame([(k, float(g)) for k, g in enumerate(np.linspace(-1, 1, 5))], "sample int, g_x double")
    groups = spark.createDataFrame([(0, 0), (0, 3), (1, 3), (1, 4), (1, 5)], "`group` int, x int")
    m = TensorFrame.from_numpy(spark, RNG.normal(size=(3, 8)) + 1j * RNG.normal(size=(3, 8)), ["o", "x"])
    coils = TensorFrame.from_numpy(spark, RNG.normal(size=(2, 6, 8)) + 1j, ["coil", "y", "x"])
    return {
        "pad": structure.PadOrCropOp({"x": 8}, {"x": 13}),
        "crop": structure.PadOrCropOp({"x": 8}, {"x": 5}),
        "patch": structure.PatchOp(xy, {"y": 3, "x": 4}, {"y": 2, "x": 2}),
        "rearrange": structure.RearrangeOp("y (a b) -> (a y) b", a=2),
        "einsum": gather.EinsumOp(m, "o x, x -> o"),
        "coils": gather.SensitivityOp(coils),
        "sampling": gather.CartesianSamplingOp(traj, {"sample": 7}, {"x": 8}),
        "grid": gather.GridSamplingOp(grid, {"sample": 5}, {"x": 8}),
        "averaging": reduce.AveragingOp(groups, "x", 8),
        "difference": windowed.FiniteDifferenceOp(["y", "x"], "forward", "circular"),
        "difference_zeros": windowed.FiniteDifferenceOp(["x"]),
        "analysis": windowed.ConvAnalysisOp("x", [(1, 2, 0.5), (0, 1, -1)]),
        "wavelet": windowed.WaveletOp("x", "db2", 2),
        "fft": fourier.FastFourierOp(["y", "x"], {"y": 6, "x": 8}, {"y": 9, "x": 8}),
        "nufft": fourier.NonUniformFourierOp({"x": 8}, pts),
    }


NAMES = ["pad", "crop", "patch", "rearrange", "einsum", "coils", "sampling", "grid", "averaging", "difference", "difference_zeros", "analysis", "wavelet", "fft", "nufft"]


@pytest.mark.parametrize("name", NAMES)
def test_adjoint(spark, name):
    """<A x, y> = <x, Aᴴ y>."""
    op = operators(spark)[name]
    _, x = tensor(spark, (6, 8), ["y", "x"])
    ax = op(x)[0]
    _, y = tensor(spark, tuple(ax.axes.values()), ax.names)
    back = op.H(y)[0]
    assert set(back.names) == set(x.names)
    assert np.isclose(ax.vdot(y), x.vdot(back), rtol=1e-6)
    assert isinstance(op.H, Adjoint) and op.H.H is op


def test_values_against_numpy(spark):
    x, t = tensor(spark, (6, 8), ["y", "x"])
    got = fourier.FastFourierOp(["x"])(t)[0].to_numpy()
    want = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(x, 1), axis=1, norm="ortho"), 1)
    assert np.allclose(got, want)
    assert np.allclose(TensorFrame(fourier.dft(t.df, ["y"], "x", 8), t.axes).to_numpy(), want)
    assert np.allclose(structure.PadOrCropOp({"x": 8}, {"x": 11})(t)[0].to_numpy()[:, 2:10], x)
    assert np.allclose(windowed.WaveletOp("x", "db4").H(*windowed.WaveletOp("x", "db4")(t))[0].to_numpy(), x)
    nufft = fourier.NonUniformFourierOp({"x": 8}, RNG.uniform(-4, 4, (9, 1)))
    assert np.allclose(nufft.gram(t)[0].to_numpy(), nufft.H(*nufft(t))[0].to_numpy())


def test_algebra(spark):
    x, t = tensor(spark, (4, 4), ["y", "x"])
    a, one = windowed.FilterOp("x", (1, 2, 3)), Identity()
    assert np.allclose((2 * a + a * 3)(t)[0].to_numpy(), 5 * a(t)[0].to_numpy())
    assert (a @ one) is a and (one @ a) is a and (a + Zero()) is a
    m = OperatorMatrix([[a, one], [Zero(), a]])
    p, q = m(t, t * 2)
    assert np.allclose(p.to_numpy(), a(t)[0].to_numpy() + 2 * x) and np.allclose(q.to_numpy(), 2 * a(t)[0].to_numpy())
    assert m.H.shape == (2, 2) and (a | one).shape == (1, 2) and (a % one).shape == (2, 1)
    with pytest.raises(ShapeError):
        m(t)
    with pytest.raises(ShapeError):
        t + TensorFrame(t.df, {"y": 4, "x": 5})


def test_solvers(spark):
    w = np.arange(1.0, 7.0)
    op = gather.DensityCompensationOp(TensorFrame.from_numpy(spark, w, ["x"]))
    b, t = tensor(spark, (6,), ["x"])
    assert np.allclose(solvers.cg(op, t, max_iterations=10, tolerance=1e-9).to_numpy(), b / w)
    assert abs(op.operator_norm(TensorFrame.from_numpy(spark, np.ones(6), ["x"]), steps=15) - 6) < 0.05
    x = solvers.pgd(lambda v: (v - t).norm2() / 2, lambda v: v - t, 0.3 * reduce.L1Norm(), t * 0.0, 1.0, 4)
    mag = np.abs(b)
    assert np.allclose(x.to_numpy(), b * np.maximum(mag - 0.3, 0) / mag, atol=1e-6)

    def rosenbrock(v):
        a, c = 1 - v[0], v[1] - v[0] ** 2
        return a * a + 100 * c * c, np.array([-2 * a - 400 * v[0] * c, 200 * c])

    assert np.allclose(solvers.lbfgs(rosenbrock, np.array([-1.2, 1.0]), 200), 1, atol=1e-4)
    assert np.allclose(solvers.adam(rosenbrock, np.array([0.8, 0.7]), 3000, 0.02), 1, atol=0.05)
    flat = solvers.total_variation_denoising(TensorFrame.from_numpy(spark, np.array([0.0, 0, 0, 4, 4, 4.2]), ["x"]), ["x"], 0.1, 8)
    assert flat.to_numpy().real.std() < 2.1


def test_epg_matches_exponentials(spark):
    df = spark.createDataFrame([(k, 1.0, 0.8 + k / 10, 0.05 + k / 50) for k in range(5)], "v int, m0 double, t1 double, t2 double")
    rows = epg.simulate(df, epg.multi_echo_spin_echo([math.pi] * 4, [0.0] * 4), "v", 10).orderBy("v").collect()
    for r, t2 in zip(rows, (0.05 + k / 50 for k in range(5))):
        assert np.allclose(np.hypot(r.re, r.im), np.exp(-0.02 * np.arange(1, 5) / t2), atol=1e-6)
    inverted = epg.Sequence_([epg.Inversion(0.3), epg.Pulse(math.pi / 2), epg.Acquire()])
    r = epg.simulate(df, inverted, "v").orderBy("v").first()
    assert np.isclose(abs(complex(r.re[0], r.im[0])), abs(1 - 2 * math.exp(-0.3 / 0.8)))
    with pytest.raises(ValueError):
        epg.Delay(-1)
    with pytest.raises(ValueError):
        epg.cardiac_fingerprinting([k / 10 for k in range(15)])
    assert len(epg.ramp_angles()) == 500 and len(epg.simulate(df, epg.cardiac_fingerprinting(), "v").first().re) == 705
    prep = epg.Sequence_([epg.T2Prep(0.04), epg.Pulse(math.pi / 2), epg.Acquire()])
    r = epg.simulate(df, prep, "v").orderBy("v").first()
    assert np.isclose(abs(complex(r.re[0], r.im[0])), math.exp(-0.04 / 0.05), atol=1e-6)


def test_phantom_and_voronoi():
    assert np.allclose(generators.bessel_j1(np.array([0.0, 1.0, 5.0])), [0, 0.4400505857, -0.3275791376])
    pts = np.array([[y, x] for y in range(3) for x in range(3)], float)
    assert np.isclose(reduce.voronoi_2d(pts)[4], 1)


def test_interpolation_and_dictionary_parts(spark):
    t = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 0.0)], "xp double, fp double")
    p = spark.createDataFrame([(k, v) for k, v in enumerate((-1.0, 0.0, 0.5, 1.0, 2.5, 9.0))], "k int, x double")
    got = [r.f for r in gather.interp(p, t).orderBy("k").collect()]
    assert np.allclose(got, np.interp((-1, 0, 0.5, 1, 2.5, 9), (0, 1, 4), (1, 3, 0)))
    got = [r.f for r in gather.interp_join(p, t).orderBy("k").collect()]
    assert np.allclose(got, np.interp((-1, 0, 0.5, 1, 2.5, 9), (0, 1, 4), (1, 3, 0)))


def test_moving_average_of_long_key(spark):
    df = spark.range(5000).selectExpr("1 as k", "id as i", "cast(id % 7 as double) as v")
    got = [r.ema for r in windowed.ema(df, ["k"], ["i"], "v", 0.9).orderBy("i").collect()]
    e, want = 0.0, []
    for i in range(5000):
        e = float(i % 7) if i == 0 else 0.9 * e + 0.1 * (i % 7)
        want.append(e)
    assert np.allclose(got, want)


def test_total_variation_steps(spark):
    """Against the same steps in NumPy: zeros behind the last place, a weight an axis, parts of a complex value apart."""
    b = RNG.normal(size=(4, 5)) + 1j * RNG.normal(size=(4, 5))
    weights, step = {"y": 0.3, "x": 0.7}, 0.3

    def difference(x, axis):
        return np.concatenate([x.take(range(1, x.shape[axis]), axis), np.zeros_like(x.take([0], axis))], axis) - x

    def back(z, axis):
        return np.concatenate([np.zeros_like(z.take([0], axis)), z.take(range(z.shape[axis] - 1), axis)], axis) - z

    clip = lambda z, w: np.clip(z.real, -w, w) + 1j * np.clip(z.imag, -w, w)
    x = relaxed = b
    a, z = np.zeros_like(b), [np.zeros_like(b)] * 2
    for _ in range(5):
        a = (a + step * (relaxed - b)) / (1 + step / 2)
        z = [clip(z[k] + step * difference(relaxed, k), w) for k, w in enumerate(weights.values())]
        new = x - step * (a + sum(back(z[k], k) for k in range(2)))
        relaxed, x = 2 * new - x, new
    t = TensorFrame.from_numpy(spark, b, ["y", "x"])
    got = solvers.total_variation_denoising(t, ["y", "x"], [0.3, 0.7], 5, primal_step=step, dual_step=step)
    assert np.allclose(got.to_numpy(), x) and not np.allclose(x, b, atol=0.1)
    with pytest.raises(ValueError):
        solvers.total_variation_denoising(t, ["y", "x"], [0.3], 5)


def test_total_variation_flattens_a_reconstruction(spark):
    """A weight that changes the image: its differences get smaller, the more the larger the weight."""
    from lattica.plans import reconstruction

    img = np.kron(np.array([[1.0, 3.0], [2.0, 0.0]]), np.ones((2, 2))) + 0.3 * RNG.normal(size=(4, 4))
    t, maps = TensorFrame.from_numpy(spark, img, ["y", "x"]), generators.birdcage(spark, 2, 4, 4)
    grid = np.stack(np.meshgrid(np.arange(4) - 2.0, np.arange(4) - 2.0, indexing="ij"), -1).reshape(-1, 2)
    own = reconstruction.Reconstruction.from_readings(reconstruction.simulate(t, maps, grid), {"y": 4, "x": 4}, maps=maps)
    rough = [abs(np.diff(own.total_variation(s, 4, primal_step=0.3, dual_step=0.3).to_numpy().real, axis=0)).sum() for s in (0.0, 1.0)]
    assert rough[0] > rough[1] + 0.1


def test_voronoi_cells_of_many_points():
    """Against cells cut by all bisectors, on random points, lines and a lattice; and in n log n: 20,000 points on lines."""
    import time

    def brute(p):
        center, half = (p.max(0) + p.min(0)) / 2, np.maximum((p.max(0) - p.min(0)) / 2, 1e-9) * 10
        out = []
        for a in p:
            cell = [center + half * c for c in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            for q in p:
                n = q - a
                if not n.any():
                    continue
                side, cut = [(c - (q + a) / 2) @ n for c in cell], []
                for i, c in enumerate(cell):
                    j = i + 1 - len(cell)
                    if side[i] <= 0:
                        cut.append(c)
                    if side[i] * side[j] < 0:
                        cut.append(c + (cell[j] - c) * side[i] / (side[i] - side[j]))
                cell = cut
            x, y = np.array(cell).T
            out.append(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)
        return np.array(out)

    rng = np.random.default_rng(5)
    lines = lambda n: np.unique(np.stack([rng.integers(0, 31, n) * 1.0, rng.integers(-99999, 999999, n) / 50000], 1), axis=0)
    lattice = np.stack(np.meshgrid(np.arange(6.0), np.arange(5.0)), -1).reshape(-1, 2)
    for p in (rng.random((90, 2)), lines(90), lattice, lattice[:6], lattice[:2]):
        np.testing.assert_allclose(reduce.voronoi_2d(p), brute(p), rtol=1e-7)
    began = time.monotonic()
    area = reduce.voronoi_2d(lines(20_000))
    assert (area > 0).all() and time.monotonic() - began < 40


def test_total_variation_is_solved_in_rows(spark, monkeypatch):
    """Packed lines and images: the steps of the general solver, with one shuffle in all."""
    from lattica.plans import solvers

    rng = np.random.default_rng(6)
    t = TensorFrame.from_numpy(spark, rng.normal(size=(3, 4, 5)) + 1j * rng.normal(size=(3, 4, 5)), ["z", "y", "x"])
    t = TensorFrame(t.df.where("not (z = 1 and y = 2 and x > 2)"), t.axes)  # absent rows are 0
    for axes, w, steps in ((["x"], 0.3, {"primal_step": 0.4, "dual_step": 0.3}), (["x", "z"], [0.2, 0.5], {}), (["y", "x", "z"], 0.1, {"norm": 4.0})):
        got = solvers.total_variation_denoising(t, axes, w, 4, **steps)
        plan = got.df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        with monkeypatch.context() as m:
            m.setattr(solvers, "PACKED", 0)
            want = solvers.total_variation_denoising(t, axes, w, 4, **steps)
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_dictionary_is_matched_in_blocks(spark, monkeypatch):
    """Small blocks and several parts, even atom numbers, copies among the atoms: the first atom of a tie."""
    from lattica.operators import gather

    monkeypatch.setattr(gather, "ATOM_BYTES", 400)
    monkeypatch.setattr(gather, "PRODUCT_BYTES", 200)
    rng = np.random.default_rng(7)
    atoms = rng.normal(size=(20, 4))
    atoms = np.concatenate([atoms, atoms])
    x = rng.normal(size=(50, 4))
    a = spark.createDataFrame([(2 * k, v.tolist()) for k, v in enumerate(atoms)], "atom_id long, re array<double>")
    s = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key long, re array<double>").repartition(3)
    power = (x @ (atoms / np.linalg.norm(atoms, axis=1)[:, None]).T) ** 2
    for digits in (None, 9):
        got = sorted(gather.dictionary_match(s, a, "key", digits=digits).collect())
        assert [r.atom_id for r in got] == [2 * k for k in power[:, :20].argmax(1)]
        np.testing.assert_allclose([r.similarity for r in got], power.max(1))
    assert gather.dictionary_match(s, a.limit(0), "key").count() == 0
