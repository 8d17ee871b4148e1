"""Reading, writing and streams."""

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import rotation
from lattica.operators import reduce
from lattica.sources import acquisitions, generators
from lattica.streaming import windows
from lattica.tensor import TensorFrame


def readings(spark):
    rows = [("a", k, 0 if k % 3 else 1 << 18, k % 4, k // 4, 1, 2, [float(v) for v in range(10 + (k == 5))]) for k in range(12)]
    return spark.createDataFrame(rows, "dataset string, acquisition_time_stamp long, flags long, k1 int, k2 int, discard_pre int, discard_post int, data array<double>")


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "acq")
    acquisitions.write(readings(spark), path)
    got = acquisitions.read(spark, path)
    assert got.count() == 8 and acquisitions.read(spark, path, acquisitions.is_noise()).count() == 4
    assert "flags" in got._jdf.queryExecution().toString()
    cut = acquisitions.longest_only(acquisitions.trim(got).withColumn("n", F.size("data")), ["dataset"], "n").collect()
    assert [r.n for r in cut] == [8] and cut[0].data[0] == 1.0
    one = acquisitions.k_center(got.withColumns({k: (F.col("k1") - 2.0) if k == "ky" else F.lit(0.0) for k in ("kz", "ky", "kx")}), ["dataset"]).first()
    assert one.k1_center == 2


def test_datetime_and_vendor(spark):
    df = spark.createDataFrame([("20240131235959.5+01:00", "Siemens", 2.0), ("20240131235959", "other", 2.0)], "t string, vendor string, im double")
    rows = acquisitions.conjugated(df.withColumn("p", acquisitions.parse_datetime(F.col("t")).cast("string")), "vendor").collect()
    assert [r.p for r in rows] == ["2024-01-31 23:59:59.5", "2024-01-31 23:59:59"] and [r.im for r in rows] == [-2.0, 2.0]


def test_ignore_mask_quirk(spark):
    got = {r.f for r in spark.createDataFrame([(0,), (1 << 2,), (1 << 6,), (1 << 18,), (1 << 21,), (1 << 29,), (1 << 30,)], "f long").where(acquisitions.is_image("f")).collect()}
    assert got == {0, 1 << 6, 1 << 21, 1 << 30}


def test_coil_maps_and_density(spark):
    maps = generators.birdcage(spark, 3, 12, 12)
    img = maps * TensorFrame.from_numpy(spark, np.ones((12, 12)), ["y", "x"])
    frame = TensorFrame(img.df.withColumn("other", F.lit(0)), {"other": 1} | img.axes)
    got = reduce.coil_maps_frame(frame, width=3).to_numpy()[0]
    want = maps.to_numpy()
    inner = (slice(None), slice(3, -3), slice(3, -3))
    assert np.allclose(np.abs((got * want.conj()).sum(0))[3:-3, 3:-3], 1, atol=0.05) and got[inner].shape == (3, 6, 6)


def test_rotations(spark):
    one = spark.range(1)
    q = rotation.Rot.about("z", 0.3) @ rotation.Rot.about("z", 0.4)
    row = one.select(q.magnitude().alias("a"), q.power(2).magnitude().alias("b"), q.rotvec().z.alias("z"), q.euler_zyx()[0].alias("e")).first()
    assert np.allclose([row.a, row.b, row.z, row.e], [0.7, 1.4, 0.7, 0.7])


def stream(spark, tmp_path):
    src = str(tmp_path / "in")
    base = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 10).alias("at"), F.col("id").cast("double").alias("v"))
    for k in range(4):  # one file after another: a stream reads them by age
        base.where(f"i div 10 = {k}").coalesce(1).write.mode("append").parquet(src)
    return base, spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(src)


def run(spark, out, name, mode):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_sliding_stream(spark, tmp_path):
    base, s = stream(spark, tmp_path)
    got = run(spark, windows.sliding_sums(s, "at", ["k"], "v", "60 seconds", "30 seconds", "10 minutes"), "sliding", "complete")
    w = F.window("at", "60 seconds", "30 seconds")
    want = base.groupBy(w.alias("w"), "k").agg(F.count("*").alias("n"), F.sum("v").alias("total")).select("w.start", "k", "n", "total")
    assert sorted(map(tuple, got.select("start", "k", "n", "total").collect())) == sorted(map(tuple, want.collect()))


def test_moving_average_stream(spark, tmp_path):
    _, s = stream(spark, tmp_path)
    got = {(r.k, r.i): r.ema for r in run(spark, windows.moving_average(s, "k", "i", "v", 0.5), "ema", "append").collect()}
    assert len(got) == 40 and got[0, 0] == 0.0 and got[0, 3] == 1.5


def test_random_directions_and_alignment(spark):
    df = generators.random_rotations(generators.random_directions(spark.range(4000), 5.0, 3), 9)
    got = df.selectExpr("avg(dz) z", "avg(dy) y", "max(abs(dz * dz + dy * dy + dx * dx - 1)) e", "max(abs(qz * qz + qy * qy + qx * qx + qw * qw - 1)) q").first()
    assert abs(got.z - (1 / np.tanh(5) - 1 / 5)) < 0.02 and abs(got.y) < 0.03 and got.e < 1e-9 and got.q < 1e-9
    q = rotation.Rot.about("z", 0.5)
    v = q.apply(rotation.Vec(F.col("dz"), F.col("dy"), F.col("dx")))
    turned = df.withColumns({"az": v.z, "ay": v.y, "ax": v.x})
    m, rest = reduce.align_vectors(turned, ("az", "ay", "ax"), ("dz", "dy", "dx"))
    want = np.array([[1, 0, 0], [0, np.cos(0.5), np.sin(0.5)], [0, -np.sin(0.5), np.cos(0.5)]])
    assert np.allclose(m, want, atol=1e-6) and rest < 1e-3


def test_projection_matrix_rows(spark):
    m = generators.projection_matrix(spark, (6, 6, 6), np.eye(3), 0.0, lambda s: np.exp(-s * s), 1)
    rows = m.groupBy("target").agg(F.sum("w").alias("w")).collect()
    assert len(rows) == 36 and all(abs(r.w - 1) < 1e-9 for r in rows)
    outside = generators.projection_matrix(spark, (6, 6, 6), np.eye(3), 20.0, lambda s: 1.0, 1)
    assert outside.count() == 0


def test_sunflower(spark):
    df = spark.range(40).selectExpr("cast(id div 8 as int) k2", "cast(id % 8 as int) k1")
    got = generators.sunflower(df, 4).collect()
    assert len(got) == 40 and all(r.ky == 0 and r.kz == 0 for r in got if r.k1 == 0)
