"""Files, axes, maps, implicit operators and reconstructions against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import rotation
from lattica.operators import fourier, reduce, structure, windowed
from lattica.plans import implicit, reconstruction, solvers
from lattica.plans.algebra import Operator
from lattica.sources import files, generators, records
from lattica.tensor import ShapeError, TensorFrame

RNG = np.random.default_rng(7)


def tensor(spark, shape, names):
    x = RNG.normal(size=shape) + 1j * RNG.normal(size=shape)
    return x, TensorFrame.from_numpy(spark, x, names)


def test_dicom_round_trip(spark, tmp_path):
    data = RNG.uniform(0, 100, (2, 3, 4, 5))
    x = TensorFrame.from_numpy(spark, data, ["other", "z", "y", "x"])
    turn = np.array([[1, 0, 0], [0, math.cos(0.3), -math.sin(0.3)], [0, math.sin(0.3), math.cos(0.3)]])
    head = {"te": 0.005, "ti": 0.1, "tr": 0.02, "fa": 0.4, "resolution": (0.003, 0.002, 0.001), "position": (0.01, 0.02, 0.03), "directions": turn, "normalize": False, "slope": 0.01, "intercept": -1.0}
    written = files.write_dicom_folder(x.df, str(tmp_path / "d"), head).collect()
    assert len(written) == 2
    items = files.read_dicom_items(spark, str(tmp_path / "d"))
    h = files.dicom_headers(items).orderBy("file_order").collect()
    assert [r.frames for r in h] == [3, 3] and all(r.is_3d for r in h)
    assert np.allclose([h[0].resolution_z, h[0].resolution_y, h[0].resolution_x], [0.003, 0.002, 0.001])
    assert np.allclose([h[0].te[0], h[0].ti[0], h[0].tr[0], h[0].fa[0]], [0.005, 0.1, 0.02, 0.4])
    assert np.allclose([[h[0][f"{k}_{n}"] for n in "zyx"] for k in ("slice", "phase", "readout")], turn, atol=1e-6)
    assert np.allclose([h[0][f"position_{n}"] for n in "zyx"], np.tile([[0.01], [0.02], [0.03]], 3), atol=1e-6)
    got = np.zeros(data.shape)
    for r in files.dicom_images(items).collect():
        got[r.other, r.frame, r.y, r.x] = r.value
    assert np.allclose(got, data, atol=0.0051)
    assert files.get_items(items, "EchoTime").count() == 0 and files.get_items(items, "EffectiveEchoTime").count() == 6
    assert len(files.get_items(items, "ImagePositionPatient").first()["values"]) == 3


def test_dicom_implicit_and_broken():
    import struct

    raw = struct.pack("<HHI", 0x0028, 0x0010, 2) + struct.pack("<H", 7) + struct.pack("<HHI", 0x0018, 0x0050, 4) + b"1.5 "
    raw += struct.pack("<HHI", 0x0009, 0x0010, 200) + b"x" * 200
    assert [(t, v) for t, v, _ in files.parse_dicom(raw)][:2] == [("00280010", ["7"]), ("00180050", ["1.5"])]
    with pytest.raises(ValueError):
        files.parse_dicom(b"\0" * 128 + b"DICM" + files._element("00020000", "UL", 26) + files._element("00020010", "UI", "1.2.840.10008.1.2.4.50"))


def test_nifti_round_trip(spark, tmp_path):
    data = RNG.normal(size=(2, 3, 2, 4, 5)) + 1j * RNG.normal(size=(2, 3, 2, 4, 5))
    x = TensorFrame.from_numpy(spark, data, ["other", "coil", "z", "y", "x"])
    df = x.df.withColumn("image", F.lit(4))
    for magnitude in (False, True):
        folder = str(tmp_path / f"n{magnitude}")
        assert files.write_nifti_folder(df, folder, (3.0, 2.0, 1.0), (7.0, 8.0, 9.0), magnitude_only=magnitude, description="TE=1ms").count() == 1
        got = np.zeros(data.shape, complex)
        for r in files.read_nifti(spark, folder).collect():
            got[r.other, r.coil, r.z, r.y, r.x] = r.re + 1j * r.im
        assert np.allclose(got, abs(data) if magnitude else data, atol=1e-6)
        raw = open(f"{folder}/im_4.nii", "rb").read()
        assert np.allclose(files.parse_nifti(raw)[1][:3, 3], [9, 8, 7])
        assert len(raw) == (352 if magnitude else 544) + data.size * (4 if magnitude else 8)


def holds(df, condition):
    """Of every row; as a column, as filters are written out into what makes their inputs."""
    return all(r.c for r in df.select(condition.alias("c")).collect())


def test_rotations_of_random_vectors(spark):
    q = RNG.normal(size=(40, 4))
    df = spark.createDataFrame([tuple(map(float, v)) for v in q], "z double, y double, x double, w double")
    rot = rotation.Rot.from_quat("z", "y", "x", "w")
    df, rot = rot.stored(df, "q")
    for seq in ("ZXY", "zxz", "xzy"):
        angles = df.select("q_z", "q_y", "q_x", "q_w", "q_i", *(c.alias(f"a{k}") for k, c in enumerate(rot.euler(seq))))
        angles, back = rotation.Rot.from_euler(seq, ["a0", "a1", "a2"]).stored(angles, "back")
        assert holds(angles, rot.approx_equal(back, 1e-6)), seq
    turned, columns = df, []
    for k, v in enumerate(rot.directions()):
        turned, v = v.stored(turned, f"b{k}")
        columns.append(v)
    turned, back = rotation.Rot.from_directions(*columns).stored(turned, "back")
    assert holds(turned, rot.approx_equal(back, 1e-6))
    df, mirrored = rot.reflect().stored(df, "m")
    m = [[float(v) for v in r] for r in df.select(*(c for row in mirrored.matrix() for c in row)).collect()]
    for r, v in zip(m, q):
        axis = v[:3] / np.linalg.norm(v[:3])
        m = np.array(r).reshape(3, 3)
        assert np.allclose(np.linalg.det(m), -1) and np.allclose(m @ axis, -axis)
    with pytest.raises(ValueError):
        rot.euler("xxz")


def test_euler_at_the_poles(spark):
    df = spark.createDataFrame([(0.3, 0.0, 0.4), (0.3, math.pi, 0.4), (0.3, math.pi / 2, 0.4), (0.3, -math.pi / 2, 0.4)], "a double, b double, c double")
    for seq in ("zxz", "ZYX"):
        rows, rot = rotation.Rot.from_euler(seq, ["a", "b", "c"]).stored(df, "q")
        rows = rows.withColumns({f"a{k}": c for k, c in enumerate(rot.euler(seq))})
        at_pole = [r for r in rows.select("b", "a2").collect() if abs(math.sin(r.b) if len(set(seq.lower())) == 2 else math.cos(r.b)) < 1e-9]
        assert len(at_pole) == 2 and all(abs(r.a2) < 1e-9 for r in at_pole)
        rows, back = rotation.Rot.from_euler(seq, ["a0", "a1", "a2"]).stored(rows, "back")
        assert holds(rows, rot.approx_equal(back, 1e-5))


@pytest.mark.parametrize("method", ["walsh", "inati"])
def test_coil_maps(spark, method):
    """Voxel by voxel from the neighbourhood, in two and three dimensions."""
    for shape in ((3, 5, 6), (2, 3, 4, 5)):
        x = RNG.normal(size=shape) + 1j * RNG.normal(size=shape)
        got, width, dims = reduce.coil_maps(x, 3, method), 3, len(shape) - 1
        padded = np.pad(x, [(0, 0)] + [(1, 1)] * dims, mode="edge" if method == "inati" else "constant")
        for at in np.ndindex(*shape[1:]):
            n = padded[(slice(None), *(slice(k, k + width) for k in at))].reshape(shape[0], -1)
            if method == "walsh":
                cov = n @ n.conj().T
                v = cov.sum(0)
                for _ in range(10):
                    v = cov @ (v / np.linalg.norm(v))
                want = v / np.linalg.norm(v)
            else:
                cov, v = n.conj() @ n.T, n.sum(1)
                v = v / np.linalg.norm(v)
                for _ in range(10):
                    v = cov @ v
                    v = v / np.linalg.norm(v)
                phase = (n * v[:, None]).sum()
                want = v.conj() * phase / abs(phase)
            assert np.allclose(got[(slice(None), *at)], want, atol=1e-5)
    t = TensorFrame.from_numpy(spark, x[None], ["other", "coil", "z", "y", "x"])
    assert np.allclose(reduce.coil_maps_frame(t, width=3, method=method).to_numpy()[0], got)


def test_field_map_is_source_free(spark):
    """The discrete Laplacian of the field vanishes inside."""
    m = generators.field_map(spark, (9, 9, 9), (1.0, 1.0, 1.0), 3, 1.0, 5).to_numpy().real
    inner = (slice(1, -1),) * 3
    lap = sum(np.roll(m, s, a)[inner] for a in range(3) for s in (1, -1)) - 6 * m[inner]
    assert abs(lap).max() < 1e-9 and m.std() > 0.01


def test_solid_harmonics_are_orthonormal(spark):
    t, p = np.meshgrid((np.arange(200) + 0.5) * np.pi / 200, np.arange(60) * 2 * np.pi / 60, indexing="ij")
    pts = [(float(np.cos(a)), float(np.sin(a) * np.sin(b)), float(np.sin(a) * np.cos(b)), float(np.sin(a) * np.pi / 200 * 2 * np.pi / 60)) for a, b in zip(t.ravel(), p.ravel())]
    df = spark.createDataFrame(pts, "z double, y double, x double, w double")
    h = generators.solid_harmonics(F.col("z"), F.col("y"), F.col("x"), 2)
    names = sorted(h)
    rows = np.array(df.select(*(h[k] for k in names), "w").collect(), float)
    assert np.allclose(rows[:, :-1].T @ (rows[:, :-1] * rows[:, -1:]), np.eye(len(names)), atol=1e-3)


def test_axes(spark):
    x, t = tensor(spark, (2, 3, 4), ["a", "b", "c"])
    assert structure.normalize_axis(t, -1) == "c" and structure.normalize_axes(t, [0, "b"]) == ["a", "b"]
    for bad in (lambda: structure.normalize_axis(t, 3), lambda: structure.index(t, a=2), lambda: structure.index(t, a=slice(None, None, -1))):
        with pytest.raises(IndexError):
            bad()
    with pytest.raises(ValueError):
        structure.normalize_axes(t, ["a", 0])
    with pytest.raises(ShapeError):
        structure.reshape(t, {"p": 5, "q": -1})
    assert structure.unsqueeze_at(t, 1, ["n"]).axes == {"a": 2, "n": 1, "b": 3, "c": 4}
    assert structure.unsqueeze_right(t, ["n"]).names[-1] == "n" and structure.unsqueeze_at(t, -2, ["n"]).names == ["a", "b", "n", "c"]
    y, u = tensor(spark, (4,), ["c"])
    assert structure.aligned(t, u)[1].axes == {"a": 1, "b": 1, "c": 4} and structure.aligned(t, u, side="right")[1].names == ["c", "a", "b"]
    assert structure.aligned_at(t, u, place=0)[1].names == ["a", "b", "c"]
    wide = structure.broadcast(t, u)
    assert np.allclose(wide[1].to_numpy(), np.broadcast_to(y, x.shape)) and structure.equal(wide[0], t)
    assert np.allclose(structure.index(t, b=[True, False, True], a=[1, 0]).to_numpy(), x[[1, 0], [0, 2]])
    assert np.allclose(structure.index(t, b=-1, c=slice(1, 4, 2)).to_numpy(), x[:, 2:, 1:4:2])


@pytest.mark.parametrize("mode", ["circular", "reflect"])
def test_taps_at_the_ends(spark, mode):
    v = RNG.normal(size=9)
    df = spark.createDataFrame([(0, k, float(a)) for k, a in enumerate(v)], "g int, i int, v double")
    for kernel in ([1.0, 0.5, 2.0, -1.0, 3.0], [1.0, 2.0, 4.0]):
        got = [r.out for r in windowed.correlate(df, ["g"], "i", "v", kernel, mode, "out").orderBy("i").collect()]
        half = (len(kernel) - 1) // 2
        p = np.pad(v, half, mode="wrap" if mode == "circular" else "reflect")
        assert np.allclose(got, [p[k : k + len(kernel)] @ kernel for k in range(9)])


def test_symmetrized():
    k = RNG.normal(size=(4, 6)) + 1j * RNG.normal(size=(4, 6))
    full = np.fft.fftn(RNG.normal(size=(4, 6)))  # already symmetric
    assert np.allclose(fourier.symmetrized(full), full[:, :4])
    assert fourier.symmetrized(k).shape == (4, 4)


class Cube(Operator):
    def forward(self, x):
        return x.map(lambda v: v * v * v)


def test_jacobian(spark):
    x, t = tensor(spark, (5,), ["x"])
    v, u = tensor(spark, (5,), ["x"])
    y, w = tensor(spark, (5,), ["x"])
    j = implicit.Jacobian(Cube(), t)
    assert np.allclose(j(u)[0].to_numpy(), 3 * x**2 * v, atol=1e-6)
    assert np.allclose(j.adjoint(w).to_numpy(), (3 * x**2).conj() * y, atol=1e-6)
    assert np.allclose(j.taylor(t).to_numpy(), x**3, atol=1e-6)


def test_conjugate_gradient_operator(spark):
    from lattica.operators.gather import DensityCompensationOp

    b, t = tensor(spark, (4,), ["x"])
    w = TensorFrame.from_numpy(spark, np.array([1.0, 2.0, 3.0, 4.0]), ["x"])
    op = implicit.ConjugateGradientOp(lambda c, r: DensityCompensationOp(c), lambda c, r: r, 20, 1e-10)
    d = np.arange(1.0, 5.0)
    assert np.allclose(op(w, t)[0].to_numpy(), b / d, atol=1e-6)
    e, s = tensor(spark, (4,), ["x"])
    zero = w * 0.0
    assert np.allclose(op.derivative((w, t), (zero, s)).to_numpy(), e / d, atol=1e-4)
    seen = []
    solvers.cg(DensityCompensationOp(w), t, max_iterations=2, callback=implicit.with_status(implicit.CGStatus, lambda status: seen.append(status.iteration)))
    assert seen == [0, 1]
    started = solvers.cg(DensityCompensationOp(w), t, start=s, max_iterations=10, tolerance=1e-10)
    assert np.allclose(started.to_numpy(), b / d, atol=1e-6)


def test_optimizer_operator():
    def problem(a):
        return lambda x: (float(((x - a) ** 2 * [1, 3]).sum() / 2), (x - a) * [1, 3])

    op = implicit.OptimizerOp(problem, lambda a: np.zeros(2), tolerance=1e-10)
    a = np.array([1.0, -2.0])
    assert np.allclose(op(a), a, atol=1e-6)
    assert np.allclose(op.derivative((a,), (np.array([1.0, 1.0]),)), [1, 1], atol=1e-4)


def test_pdhg_steps(spark):
    from lattica.operators.gather import DensityCompensationOp
    from lattica.operators.reduce import L2NormSquared

    x, t = tensor(spark, (4,), ["x"])
    w = TensorFrame.from_numpy(spark, np.array([1.0, 2.0, 2.0, 1.0]), ["x"])
    out = solvers.pdhg([L2NormSquared()], L2NormSquared(target=1.0), [DensityCompensationOp(w)], t * 0.0, 25)  # a start of zero is no obstacle
    d = np.array([1.0, 2.0, 2.0, 1.0])
    assert np.allclose(out.to_numpy(), 1 / (1 + d**2), atol=0.03)


def test_reconstruction_from_readings(spark):
    yy, xx = np.meshgrid(np.arange(12) - 6, np.arange(12) - 6, indexing="ij")
    img = ((yy**2 + xx**2) < 16).astype(float)
    image, maps = TensorFrame.from_numpy(spark, img, ["y", "x"]), generators.birdcage(spark, 3, 12, 12)
    angle = np.arange(20) * math.pi * 0.618034
    radial = np.stack([np.outer(np.sin(angle), np.arange(-8, 8) * 0.75), np.outer(np.cos(angle), np.arange(-8, 8) * 0.75)], -1).reshape(-1, 2)
    own = reconstruction.Reconstruction.from_readings(reconstruction.simulate(image, maps, radial), {"y": 12, "x": 12}, maps=maps)
    assert own.weights is not None
    got = own.sense(8).to_numpy()
    assert np.linalg.norm(got - img) < 0.35 * np.linalg.norm(img)
    estimated = reconstruction.Reconstruction.from_readings(reconstruction.simulate(image, maps, radial), {"y": 12, "x": 12}, maps="inati").direct().to_numpy()
    assert np.corrcoef(abs(estimated).ravel(), img.ravel())[0, 1] > 0.8


def test_records(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 3.0]), (2, [float(k) for k in range(9)]), (3, [])], "k int, v array<double>")
    got = {r.k: r.s for r in df.select("k", records.summary(F.col("v")).alias("s")).collect()}
    assert got == {1: "1.0, 3.0", 2: "[0.0, ..., 8.0]", 3: "none"}
    assert records.check_bounds(-1e9, 300, "byte") == (-128, 127)
    with pytest.raises(ValueError):
        records.check_bounds(2, 1, "int")
    with pytest.raises(Exception, match="varies"):
        records.reduced(spark.range(3).withColumn("g", F.lit(0)), ["g"], ["id"]).collect()
    idx = records.record(records.ACQ_INDEX, slice=4, k1=9)
    assert spark.range(1).select(records.image_index(idx)["slice"].alias("s")).first().s == 4
    assert {r.column: r.rows for r in records.summarize(df).collect()} == {"k": 3, "v": 3}


HEADER = """<?xml version="1.0"?><ismrmrdHeader xmlns="http://www.ismrm.org/ISMRMRD">
<measurementInformation><measurementID>m1</measurementID><seriesDate>2024-05-06</seriesDate><patientPosition>HFS</patientPosition><protocolName>scan</protocolName></measurementInformation>
<studyInformation><studyTime>10:11:12</studyTime></studyInformation>
<acquisitionSystemInformation><systemVendor>V</systemVendor></acquisitionSystemInformation>
<experimentalConditions><H1resonanceFrequency_Hz>123000000</H1resonanceFrequency_Hz></experimentalConditions>
<encoding><encodedSpace><matrixSize><x>256</x><y>128</y><z>1</z></matrixSize><fieldOfView_mm><x>512</x><y>256.5</y><z>5</z></fieldOfView_mm></encodedSpace>
<reconSpace><matrixSize><x>128</x><y>128</y><z>1</z></matrixSize><fieldOfView_mm><x>256</x><y>256.5</y><z>5</z></fieldOfView_mm></reconSpace><trajectory>radial</trajectory></encoding>
<sequenceParameters><TR>10</TR><TE>2</TE><TE>4.5</TE><flipAngle_deg>90</flipAngle_deg></sequenceParameters></ismrmrdHeader>"""


def test_headers(spark):
    from lattica.sources import headers

    df = spark.createDataFrame([(7, HEADER)], "k int, xml string")
    r = headers.headers(df, defaults={"ti": [0.5], "vendor": "W"}, overwrite={"model": "M"}).first()
    assert (r.k, r.vendor, r.model, r.datetime, r.trajectory_type, r.patient_position) == (7, "V", "M", "2024-05-06 10:11:12", "radial", "HFS")
    assert np.allclose([*r.te, *r.tr, *r.fa, *r.ti], [0.002, 0.0045, 0.01, math.pi / 2, 0.5])
    assert (r.encoding_matrix.x, r.recon_matrix.x, r.encoding_fov.y) == (256, 128, 0.2565) and r.echo_train_length is None
    one = headers.parse(HEADER)
    again = headers.parse(headers.to_xml(one))
    for k in ("te", "tr", "fa"):
        assert np.allclose(again[k], one[k])
    assert all(again[k] == one[k] for k in ("encoding_fov", "encoding_matrix", "recon_matrix", "datetime", "trajectory_type", "vendor", "protocol_name"))
    with pytest.raises(ValueError):
        headers.parse(HEADER, 1)


def test_random(spark):
    from lattica.sources import random

    t = random.tensor(spark, {"a": 50, "b": 40}, "complex", 3, 1.0, 2.0).to_numpy()
    assert (abs(t) >= 1).all() and (abs(t) <= 2).all() and np.allclose(t, random.tensor(spark, {"a": 50, "b": 40}, "complex", 3, 1.0, 2.0).to_numpy())
    n = random.tensor(spark, {"a": 50, "b": 40}, "normal", 4).to_numpy().real
    assert abs(n.mean()) < 0.1 and abs(n.std() - 1) < 0.1
    k = random.tensor(spark, {"a": 500}, "integer", 5, -2, 3).to_numpy().real
    assert set(k) == {-2, -1, 0, 1, 2}
    p = random.permutation(spark.range(30).withColumn("g", F.lit(0)), ["g"], "id", 9).orderBy("id").collect()
    assert sorted(r.turn for r in p) == list(range(30)) != [r.turn for r in p]
    s = spark.range(5).select(random.ascii_(1, "id", size=6).alias("s"), random.boolean(2, "id").alias("b")).collect()
    assert all(len(r.s) == 6 and r.s.isprintable() for r in s)


def test_augment_and_resize(spark):
    from lattica.sources import random

    x = TensorFrame.from_numpy(spark, np.ones((6, 8)), ["y", "x"])
    got = random.augment(x, 10, 1).to_numpy().real
    assert got.shape == (10, 10) and abs(got[3:7, 3:7] - 1).max() < 1e-9
    plain = random.augment(x, 8, 0, 0, 0, 0, (0, 0)).to_numpy().real
    assert abs(plain[2:6, 2:6] - 1).max() < 1e-9
    small = random.resized(x, 4)
    assert small.axes == {"y": 4, "x": 4} and np.allclose(small.to_numpy().real.sum(0), 3)


def test_trajectories_as_tensors(spark):
    df = spark.range(6).select(F.col("id").cast("int").alias("i"), F.array(F.col("id") / 12, F.col("id") / 24).alias("t"))
    got = generators.stored(df, "t", (1, 48, 24))
    assert [(r.kx, r.ky, r.kz) for r in got.orderBy("i").collect()] == [(2.0 * k, 2.0 * k, 0.0) for k in range(6)]
    t = generators.as_tensor(got, {"i": 6})
    assert t.axes == {"direction": 3, "i": 6}
    back = {r.i: (r.kx, r.ky, r.kz) for r in generators.from_tensor(t).collect()}
    assert back == {k: (2.0 * k, 2.0 * k, 0.0) for k in range(6)}
    assert generators.dummy(df).select("kx").distinct().count() == 1


def test_model_and_profile_objects(spark):
    from lattica.functions import models, scalar

    m = models.SignalModel(models.mono_exponential_decay, "t", "m0", "t2")
    df = spark.createDataFrame([(0.1, 2.0, 0.05)], "t double, a double, t2 double")
    assert m(df, m0="a").first().signal == pytest.approx(2 * math.exp(-2))
    with pytest.raises(ValueError):
        m(df, m9="a")
    box = scalar.SliceProfile(scalar.slice_smoothed_rectangular, 2.0, 0)
    drawn = np.array([r.x for r in box.sample(spark.range(4000), "x", -3.0, 3.0, 1).select("x").collect()])
    assert (abs(drawn) <= 1.01).all() and abs(drawn.mean()) < 0.06 and abs(drawn.var() - 1 / 3) < 0.03


def test_rows_are_numbered_in_order(spark):
    """Over ranges, with ties and a null; and nothing is numbered from nothing."""
    from lattica.workers import numbered_in_order

    values = [float(v) for v in RNG.integers(0, 30, 200)] + [None]
    got = numbered_in_order(spark.createDataFrame([(v,) for v in values], "v double").repartition(7), "v", "k").collect()
    assert sorted(r.k for r in got) == list(range(201))
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == sorted(values, key=lambda v: (v is not None, v or 0.0))
    assert numbered_in_order(spark.createDataFrame([], "v double"), "v", "k").count() == 0
