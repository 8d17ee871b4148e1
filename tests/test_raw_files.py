"""HDF5 layout, raw-data source and sink, data sets of arrays, and writing in two phases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import acquisitions, datasets, hdf5, headers, rawdata

RNG = np.random.default_rng(3)


def complex_array(*shape):
    return (RNG.normal(size=shape) + 1j * RNG.normal(size=shape)).astype("c8")


def test_layouts_round_trip(tmp_path):
    build, z, a = hdf5.Builder(), complex_array(4, 3, 10), RNG.normal(size=(7, 5, 33)).astype("f4")
    build.dataset("z", z)
    build.dataset("deep/er/packed", a, chunk=(2, 3, 10), deflate=True)
    build.dataset("deep/many", np.arange(10_000), chunk=(1,))
    build.dataset("empty", np.zeros((0, 3)))
    build.text("note", "ä<x>" * 100)
    for k in range(100):
        build.dataset(f"wide/n{k:03d}", np.array([k], "<i4"))
    path = tmp_path / "a.h5"
    path.write_bytes(build.bytes())
    with hdf5.File(str(path)) as f:
        got = f.dataset("z").rows(1, 3)
        assert np.array_equal(got["r"] + 1j * got["i"], z[1:3])
        assert np.array_equal(f.dataset("deep/er/packed").rows(1, 6), a[1:6])
        many = f.dataset("deep/many")
        assert np.array_equal(many.rows(4000, 4500), np.arange(4000, 4500)) and len(many.chunks(4000, 4010)) == 10
        assert f.text("note") == "ä<x>" * 100 and f.dataset("empty").shape == (0, 3)
        assert [f.dataset(f"wide/n{k:03d}").rows(0, 1)[0] for k in (0, 50, 99)] == [0, 50, 99]
        with pytest.raises(KeyError):
            f.dataset("deep/none")
    (tmp_path / "b.h5").write_bytes(b"no such file")
    with pytest.raises(ValueError):
        hdf5.File(str(tmp_path / "b.h5"))


def test_only_the_pages_asked_for_are_read(tmp_path):
    build = hdf5.Builder()
    build.dataset("x", np.arange(2_000_000, dtype="<f8"), chunk=(1000,))
    path = tmp_path / "a.h5"
    path.write_bytes(build.bytes())
    with hdf5.File(str(path)) as f:
        read, own = [], f.handle

        class Counted:
            def read_at(self, n, at):
                read.append(n)
                return own.read_at(n, at)

        f.handle = Counted()
        assert f.dataset("x").rows(1_500_000, 1_501_000)[0] == 1_500_000
        f.handle = own
    assert sum(read) < 10 * hdf5.PAGE


def lines(spark):
    rows = [(a, c, a % 5, 1 << 18 if a % 7 == 0 else 0, 0.0025 * a, [0.1, 0.2, 0.3], RNG.normal(size=6).tolist(), RNG.normal(size=6).tolist()) for a in range(300) for c in range(3)]
    return spark.createDataFrame(rows, "acq_id long, coil int, k1 int, flags long, acquisition_time_stamp double, position array<double>, re array<double>, im array<double>")


def test_readings_round_trip(spark, tmp_path):
    given, path = lines(spark).withColumn("ds", F.lit("a")).cache(), str(tmp_path / "raw")
    own = headers.to_xml({"lamor_frequency_proton": 6.35e7, "vendor": "Siemens", "echo_train_length": 1})
    rawdata.write_readings(acquisitions.to_readings(given, ["ds"]), path, by="ds", xml=own)
    found = rawdata.readings(spark, path, [], per_partition=64)
    assert found.count() == 300 and found.rdd.getNumPartitions() >= 5
    back = acquisitions.coil_lines(found, headers.headers(rawdata.headers_xml(spark, path)))
    key = found.select("file", F.col("acq_id").alias("at"), F.col("scan_counter").alias("number"))
    got = {(r.number, r.coil): r for r in back.join(key, [back.file == key.file, back.acq_id == key["at"]]).drop(key.file).collect()}
    for r in given.collect():
        g = got[r.acq_id, r.coil]
        assert np.allclose(g.re, r.re, atol=1e-6) and np.allclose(g.im, r.im, atol=1e-6) and np.allclose(g.position, r.position)
        assert g.k1 == r.k1 and abs(g.acquisition_time_stamp - r.acquisition_time_stamp) < 1e-9
    stored = rawdata.readings(spark, path, []).where("scan_counter = 1").first()
    assert np.allclose(stored.im[:6], [-v for v in given.where("acq_id = 1 and coil = 0").first().im])  # Siemens files are conjugated
    noise = rawdata.readings(spark, path, [("is_noise", "=", True), ("k1", "in", [1, 2])])
    assert noise.count() == sum(a % 7 == 0 and a % 5 in (1, 2) for a in range(300))
    assert acquisitions.noise_lines(noise).count() == 3 * noise.count()
    assert rawdata.readings(spark, path).count() == sum(a % 7 != 0 for a in range(300))
    assert rawdata.readings(spark, path, samples=False).where("size(re) > 0").count() == 0
    with pytest.raises(Exception, match="no condition"):
        rawdata.readings(spark, path, [("position", "=", 1)]).count()


def test_coils_and_lengths_are_made_equal(spark, tmp_path):
    rows = [(k, 2 if k < 5 else 4, 6 if k != 9 else 8, [float(k)] * (2 if k < 5 else 4) * (6 if k != 9 else 8)) for k in range(12)]
    df = spark.createDataFrame(rows, "scan_counter int, active_channels int, number_of_samples int, re array<float>").withColumn("im", F.col("re"))
    rawdata.write_readings(df, str(tmp_path / "r"))
    found = rawdata.readings(spark, str(tmp_path / "r"))
    one = found.withColumn("file", F.lit("all"))
    back = acquisitions.coil_lines(one).collect()
    assert {tuple(r.re) for r in back} == {(9.0,) * 8} and len(back) == 4  # the largest number of samples stays


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    good = spark.range(20).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    bad = good.select("name", F.when(F.col("name") == "f7", F.raise_error(F.lit("stop"))).otherwise(F.col("content")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        rawdata.write_files(bad, str(path))
    assert not path.exists() or not os.listdir(path)
    rawdata.write_files(good, str(path))
    assert sorted(os.listdir(path)) == sorted(f"f{k}" for k in range(20)) and (path / "f7").read_bytes() == b"7"
    rawdata.write_files(good.limit(3), str(path), mode="overwrite")
    assert len(os.listdir(path)) == 3
    with pytest.raises(Exception, match="same file"):
        rawdata.write_files(good.withColumn("name", F.lit("x")), str(path))
    with pytest.raises(Exception, match="no name"):
        rawdata.write_files(good.withColumn("name", F.lit("../x")), str(path))
    assert len(os.listdir(path)) == 3
    with pytest.raises(Exception):
        rawdata.write_files(good, "nosuchscheme://x/y")


@pytest.mark.parametrize("chunk", [None, (1, 2, 3, 4)])
def test_fastmri(spark, tmp_path, chunk):
    data = complex_array(3, 2, 5, 12)
    data[..., :2], data[..., 10:] = 0, 0
    build = hdf5.Builder()
    build.dataset("kspace", data, chunk=chunk, deflate=bool(chunk))
    build.text("ismrmrd_header", headers.to_xml({"lamor_frequency_proton": 6.35e7, "vendor": "x", "echo_train_length": 3, "encoding_matrix": {"x": 12.0, "y": 5.0, "z": 1.0}}))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.h5").write_bytes(build.bytes())
    other = hdf5.Builder()
    other.text("note", "no data here")
    (tmp_path / "a" / "g.h5").write_bytes(other.bytes())
    rows = datasets.fastmri_kspace(spark, str(tmp_path / "a")).toPandas()
    got = np.zeros_like(data)
    got[rows.slice, rows.coil, rows.k0, rows.k1] = rows.re + 1j * rows.im
    assert np.allclose(got, data) and sorted(set(rows.k1)) == list(range(2, 10)) and len(rows) == 3 * 2 * 5 * 8
    traj = datasets.fastmri_trajectory(datasets.fastmri_kspace(spark, str(tmp_path / "a"))).toPandas()
    assert set(traj.ky) == set(range(-4, 4)) and set(traj.kx) == set(range(-2, 3))
    (tmp_path / "a" / "g.h5").unlink()
    assert datasets.fastmri_headers(spark, str(tmp_path / "a")).first().echo_train_length == 3


def test_m4raw(spark, tmp_path):
    data = complex_array(2, 3, 2, 4, 7)  # repetitions
    for k in range(2):
        build = hdf5.Builder()
        build.dataset("kspace", data[k])
        (tmp_path / f"2022_T1{k + 1:02d}.h5").write_bytes(build.bytes())
        (tmp_path / f"other{k}.h5").write_bytes(build.bytes())
    rows = datasets.m4raw_kspace(spark, str(tmp_path)).toPandas()
    got = np.zeros_like(data)
    got[rows.repetition, rows.slice, rows.coil, rows.k0, rows.k1 - 30] = rows.re + 1j * rows.im
    assert np.allclose(got, data) and set(rows.scan) == {"2022_T1"} and len(rows) == data.size
