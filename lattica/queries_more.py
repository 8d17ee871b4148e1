"""Further queries, one an operator, on the carriers of `queries`."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import rotation, scalar
from lattica.operators import epg, fourier, gather, reduce, structure, windowed
from lattica.plans import reconstruction, solvers
from lattica.plans.algebra import Identity, Operator, OperatorMatrix
from lattica.queries import IMAGE, LINES, VECTORS, _prox, image, lines, query, r, table, values, vector_frame
from lattica.sources import generators, records
from lattica.tensor import TensorFrame

# Units and records


@query("""SELECT p_partkey, round(p_size / 1000, 9) AS m, p_size * 1e3 AS mm, p_size * 1e6 AS um, round(p_size * 180 / pi(), 6) AS degrees, round(p_retailprice * 42.5764, 4) AS mhz,
(p_size / 0.0025::DOUBLE)::BIGINT AS siemens, round(p_size * 0.001::DOUBLE, 9) AS osi FROM part""")
def unit_conversions_back(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", r(scalar.mm_to_m("p_size"), 9).alias("m"), scalar.m_to_mm("p_size").alias("mm"), scalar.m_to_micrometer("p_size").alias("um"), r(scalar.rad_to_deg("p_size")).alias("degrees"),
        r(scalar.field_to_larmor_frequency("p_retailprice") / 1e6, 4).alias("mhz"), scalar.seconds_to_ticks("p_size").alias("siemens"), r(scalar.ticks_to_seconds("p_size", "osi2"), 9).alias("osi"),
    )


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-2 * t1)), 6) AS s, round(ln(1 + exp(3 * x)) / 3, 6) AS p, round(x, 6) AS back_s, round(t1, 5) AS back_p FROM l""")
def sigmoid_and_softplus(spark, d):
    back_s = scalar.sigmoid(scalar.sigmoid_inverse(F.col("x"), 2.0), 2.0)
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", r(scalar.sigmoid(F.col("t1"), 2.0)).alias("s"), r(scalar.softplus(F.col("x"), 3.0)).alias("p"),
        r(back_s).alias("back_s"), r(scalar.softplus_inverse(scalar.softplus(F.col("t1"), 3.0), 3.0), 5).alias("back_p"),
    )


def _erf(u: str) -> str:
    """By a series without cancellation: exp(-u^2) times the sum of u^(2k+1) / gamma(k + 3/2)."""
    return f"(sign({u}) * exp(0 - ({u}) ** 2) * list_sum(list_transform(range(120), lambda k: exp((2 * k + 1) * ln(greatest(abs({u}), 1e-300)) - lgamma(k + 1.5)))))"


_STEEP = 2 * math.sqrt(math.log(2)) / 0.1


@query(f"""WITH {LINES}, e AS (SELECT x, ({_erf(f"{_STEEP!r}::DOUBLE * (x + 0.1)")} - {_erf(f"{_STEEP!r}::DOUBLE * (x - 0.1)")}) / {2 * math.erf(_STEEP * 0.1)!r}::DOUBLE AS p FROM (SELECT DISTINCT x FROM l))
SELECT l_orderkey, l_linenumber, round(p, 6) + 0.0 AS profile FROM l JOIN e USING (x)""")
def slice_smoothed_rectangular(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", r(scalar.slice_smoothed_rectangular("x", 0.2, 0.1)).alias("profile"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'spiral' ELSE 'other' END AS kind, o_custkey AS k1, o_custkey - 3 AS "min", 4 AS length, 0 AS float7 FROM orders""")
def acquisition_records(spark, d):
    kind = records.known(F.when(F.col("o_orderpriority") == "1-URGENT", "Spiral").otherwise(F.col("o_orderpriority")), records.TrajectoryType)
    limits = records.record(records.LIMITS, min=F.col("o_custkey") - 3, max=F.col("o_custkey"))
    index = records.record(records.ACQ_INDEX, k1=F.col("o_custkey"))
    return table(spark, d, "orders").select(
        "o_orderkey", kind.alias("kind"), index["k1"].cast("long").alias("k1"), limits["min"].cast("long").alias("min"), records.length(limits).alias("length"),
        records.record(records.USER_VALUES)["float7"].cast("int").alias("float7"),
    )


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) <= 2 THEN string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) ELSE '[' || min(o_orderstatus) || ', ..., ' || max(o_orderstatus) || ']' END AS text FROM orders GROUP BY 1")
def summarize_values(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s")).select("o_custkey", records.summary(F.col("s"), 2).alias("text"))


@query("SELECT l_orderkey, max(l_orderkey % 7) AS v FROM lineitem GROUP BY 1")
def reduce_field(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 7).alias("v"))
    return records.reduced(df, ["l_orderkey"], ["v"])


# Rotations


_ABOUT_Z = "round({z}, 6) + 0.0 AS z, round({s} * (sin({a}) * x + cos({a}) * t1), 6) + 0.0 AS y, round({s} * (cos({a}) * x - sin({a}) * t1), 6) + 0.0 AS x"


def _rotated(name, rot, angle="t2", z="t2", sign="1"):
    def f(spark, d):
        v = rot().apply(rotation.Vec.from_xyz("x", "t1", "t2"))
        return lines(spark, d).select("l_orderkey", "l_linenumber", r(v.z).alias("z"), r(v.y).alias("y"), r(v.x).alias("x"))

    f.__name__ = f"rotation_{name}"
    query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, {_ABOUT_Z.format(a=angle, z=z, s=sign)} FROM l")(f)


_rotated("from_quaternion", lambda: rotation.Rot.from_quat(3 * F.sin(F.col("t2") / 2), F.lit(0.0), F.lit(0.0), 3 * F.cos(F.col("t2") / 2)))
_rotated("from_vector", lambda: rotation.Rot.from_rotvec(rotation.Vec(F.col("t2"), F.lit(0.0), F.lit(0.0))))
_rotated("vector_and_back", lambda: rotation.Rot.from_rotvec(rotation.Rot.about("z", "t2").rotvec()))
_rotated("identity", rotation.Rot.identity, "0")
_rotated("power", lambda: rotation.Rot.about("z", "t2").power(3), "3 * t2")
_rotated("inverted_axes", lambda: rotation.Rot.about("z", "t2").invert_axes(), z="-t2", sign="-1")
_rotated("reflected", lambda: rotation.Rot.about("z", "t2").reflect(), z="-t2")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, {_ABOUT_Z.format(a='t2', z='t2', s='1')} FROM l")
def rotation_from_directions(spark, d):
    df, columns = lines(spark, d), []
    for k, v in enumerate(rotation.Rot.about("z", "t2").directions()):
        df, v = v.stored(df, f"b{k}")
        columns.append(v)
    df, q = rotation.Rot.from_directions(*columns).stored(df, "q")
    v = q.apply(rotation.Vec.from_xyz("x", "t1", "t2"))
    return df.select("l_orderkey", "l_linenumber", r(v.z).alias("z"), r(v.y).alias("y"), r(v.x).alias("x"))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, round(sin(t2 / 2), 6) + 0.0 AS z, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x, round(cos(t2 / 2), 6) + 0.0 AS w, round(cos(t2), 6) + 0.0 AS yy, round(-sin(t2), 6) + 0.0 AS xy FROM l")
def rotation_as_quaternion_and_directions(spark, d):
    df, q = rotation.Rot.from_quat(-F.sin(F.col("t2") / 2), F.lit(0.0), F.lit(0.0), -F.cos(F.col("t2") / 2)).stored(lines(spark, d), "q")
    z, y, x, w = q.quat(canonical=True)
    b = q.directions()
    return df.select("l_orderkey", "l_linenumber", r(z).alias("z"), r(y).alias("y"), r(x).alias("x"), r(w).alias("w"), r(b[1].y).alias("yy"), r(b[1].x).alias("xy"))


@query(f"""WITH {LINES}, s AS (SELECT unnest(['xyz', 'ZYX', 'zxz', 'YXY', 'yzx', 'XZX']) AS seq), a AS (SELECT l_orderkey, l_linenumber, seq, t1 - 2.6 AS a, CASE WHEN seq IN ('zxz', 'YXY', 'XZX') THEN 0.3 + 10 * t2 ELSE 10 * t2 - 1 END AS b, 20 * x - 2.4 AS c FROM l, s)
SELECT l_orderkey, l_linenumber, seq, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(c, 5) + 0.0 AS c FROM a""")
def rotation_euler_angles(spark, d):
    out = None
    for seq in ("xyz", "ZYX", "zxz", "YXY", "yzx", "XZX"):
        a, c = F.col("t1") - 2.6, 20 * F.col("x") - 2.4
        b = 0.3 + 10 * F.col("t2") if seq in ("zxz", "YXY", "XZX") else 10 * F.col("t2") - 1
        df, q = rotation.Rot.from_euler(seq, [a, b, c]).stored(lines(spark, d), "q")
        got = q.euler(seq)
        one = df.select("l_orderkey", "l_linenumber", F.lit(seq).alias("seq"), *(r(v, 5).alias(n) for v, n in zip(got, "abc")))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS z, round(embedding[3]::DOUBLE, 6) AS x, round(embedding[3]::DOUBLE, 6) AS back_z FROM embeddings")
def vector_from_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v, w = rotation.Vec.from_array_zyx("e"), rotation.Vec.from_array_xyz("e")
    return e.select("vec_id", r(v.z).alias("z"), r(v.x).alias("x"), r(w.z).alias("back_z"))


# Axes


@query(f"WITH {IMAGE} SELECT ((y * 16 + x) // 32)::INT AS a, ((y * 16 + x) // 4 % 8)::INT AS b, ((y * 16 + x) % 4)::INT AS c, round(re, 6) AS re, round(im, 6) AS im FROM img")
def tensor_reshape(spark, d):
    return values(structure.reshape(image(spark, d), {"a": -1, "b": 8, "c": 4}))


@query(f"WITH {IMAGE} SELECT ((y - 1) // 3)::INT AS y, (CASE x WHEN 5 THEN 0 WHEN 15 THEN 1 ELSE 2 END)::INT AS x, round(re, 6) AS re, round(im, 6) AS im FROM img WHERE y % 3 = 1 AND y >= 1 AND x IN (5, 15, 0)")
def tensor_index(spark, d):
    return values(structure.index(image(spark, d), y=slice(1, None, 3), x=[5, -1, 0]))


@query(f"WITH {IMAGE} SELECT k::INT AS picked, round(re, 6) AS re, round(im, 6) AS im FROM img JOIN (VALUES (0, 3, 7), (1, 3, 7), (2, 15, 0)) t(k, y, x) USING (y, x)")
def tensor_index_together(spark, d):
    return values(structure.index(image(spark, d), y=[3, 3, -1], x=[7, 7, 0]))


@query(f"WITH {IMAGE} SELECT c::INT AS c, y, x, round(re, 6) AS re, round(im, 6) AS im FROM img, (SELECT unnest(range(3)) AS c)")
def tensor_broadcast(spark, d):
    three = TensorFrame(spark.range(3).select(F.col("id").cast("int").alias("c"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), {"c": 3, "y": 1, "x": 1})
    wide, _ = structure.broadcast(image(spark, d), three)
    return values(wide).select("c", "y", "x", "re", "im")


@query("SELECT 'swapped' AS name, true AS holds UNION ALL SELECT 'reduced', true UNION ALL SELECT 'range', true UNION ALL SELECT 'equal', true UNION ALL SELECT 'differs', false")
def tensor_views(spark, d):
    x = image(spark, d)
    wide = structure.expand(structure.unsqueeze_left(x, ["c"]), "c", 4)
    reduced = structure.reduce_view(wide, ["c"])
    rows = [
        ("swapped", structure.swap_axes(x, "y", "x").names == ["x", "y"] and structure.equal(structure.swap_axes(structure.swap_axes(x, "y", "x"), "y", "x"), x)),
        ("reduced", reduced.axes == {"c": 1, "y": 16, "x": 16}),
        ("range", structure.fill_range(x, "x").norm2() == 16 * sum(k * k for k in range(16))),
        ("equal", structure.equal(x, x * 1.0)),
        ("differs", structure.equal(x, x * 2.0)),
    ]
    return spark.createDataFrame(rows, "name string, holds boolean")


# Operators and their algebra


class _Square(Operator):
    def forward(self, x):
        return x.map(lambda v: v * v)


_SQUARE = "round({a} * (re * re - im * im) + {b} * re, 5) + 0.0 AS re, round({a} * 2 * re * im + {b} * im, 5) + 0.0 AS im"


@query(f"WITH {IMAGE} SELECT y, x, {_SQUARE.format(a=4, b=0)} FROM img")
def operator_composition(spark, d):
    return values((_Square() @ (Identity() * 2.0))(image(spark, d))[0], 5)


@query(f"WITH {IMAGE} SELECT y, x, {_SQUARE.format(a=1, b=1)} FROM img")
def operator_sum(spark, d):
    return values((_Square() + _Square() * 0.0 + Identity())(image(spark, d))[0], 5)


@query(f"WITH {IMAGE} SELECT y, x, {_SQUARE.format(a=3, b=0)} FROM img")
def operator_product_right(spark, d):
    return values((3.0 * _Square())(image(spark, d))[0], 5)


@query(f"WITH {IMAGE} SELECT y, x, {_SQUARE.format(a=9, b=0)} FROM img")
def operator_product_left(spark, d):
    return values((_Square() * 3.0)(image(spark, d))[0], 5)


def _ramp(spark):
    return TensorFrame(spark.range(16).select(F.col("id").cast("int").alias("y"), (1 + F.col("id") / 16).alias("re"), F.lit(0.0).alias("im")), {"y": 16})


@query(f"WITH {IMAGE} SELECT 'a' AS part, y, x, round((1 + y / 16) * re + 2 * re, 5) + 0.0 AS re FROM img UNION ALL SELECT 'b', y, x, round(3 * re - (1 + y / 16) * 2 * re, 5) + 0.0 FROM img")
def operator_block_matrix(spark, d):
    x, w = image(spark, d), gather.DensityCompensationOp(_ramp(spark))
    m = OperatorMatrix([[w, Identity()], [3.0 * Identity(), -1.0 * w]])
    a, b = m(x, x * 2.0)
    return a.df.select(F.lit("a").alias("part"), "y", "x", r(F.col("re"), 5).alias("re")).unionByName(b.df.select(F.lit("b").alias("part"), "y", "x", r(F.col("re"), 5).alias("re")))


@query(f"WITH {IMAGE} SELECT y, x, round((1 + y / 16) ** 2 * re + 9 * re, 5) + 0.0 AS re, round((1 + y / 16) ** 2 * im + 9 * im, 5) + 0.0 AS im FROM img")
def operator_matrix_gram(spark, d):
    w = gather.DensityCompensationOp(_ramp(spark))
    return values(OperatorMatrix([[w], [3.0 * Identity()]]).gram(image(spark, d))[0], 5)


@query(f"""WITH {IMAGE}, k AS (SELECT * FROM (VALUES (0, -1, 1.0), (0, 0, -2.0), (0, 1, 1.0), (1, -1, -1.0), (1, 1, 1.0)) k(filter, o, c)),
f AS (SELECT filter, y, x, (filter + 1) * re AS re FROM img, (SELECT unnest([0, 1]) AS filter))
SELECT y, ((x + o + 16) % 16)::INT AS x, round(sum(c * re), 5) + 0.0 AS re FROM f JOIN k USING (filter) GROUP BY 1, 2""")
def convolution_synthesis(spark, d):
    x = image(spark, d)
    op = windowed.ConvAnalysisOp("x", [(1, -2, 1), (-1, 0, 1)])
    return values(op.H(structure.stack([x, x * 2.0], "filter"))[0], 5).select("y", "x", "re")


@query(f"WITH {IMAGE} SELECT y, x, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM img")
def wavelet_two_axes_and_back(spark, d):
    op = windowed.WaveletOp("y", "db2", 2) @ windowed.WaveletOp("x", "db4", 2)
    return values(op.gram(image(spark, d))[0], 5)


_prox("scaled", lambda x: (2.0 * reduce.L1Norm(1 + 1j)).prox(x, 0.25), "1 + a * greatest(sqrt(a * a + b * b) - 0.5, 0) / sqrt(a * a + b * b)", "1 + b * greatest(sqrt(a * a + b * b) - 0.5, 0) / sqrt(a * a + b * b)")


@query(f"""WITH {IMAGE} SELECT y, round(sum(sqrt(re * re + im * im)) + sum(4 * (re * re + im * im)), 4) AS cost FROM img GROUP BY 1""")
def functional_separable_sum(spark, d):
    x = image(spark, d)
    f = reduce.L1Norm(dim=["x"]) | reduce.L2NormSquared(dim=["x"])
    return f.forward(x, x * 2.0).df.select("y", r(F.col("re"), 4).alias("cost"))


@query(f"""WITH {IMAGE}, w AS (SELECT y // 4 AS y, x // 4 AS x, avg(re) AS re, avg(im) AS im FROM img GROUP BY 1, 2) SELECT y::INT AS y, x::INT AS x, round(2 * re, 5) + 0.0 AS re, round(2 * im, 5) + 0.0 AS im FROM w""")
def averaging_two_axes(spark, d):
    def groups(axis):
        return spark.range(16).select(F.floor(F.col("id") / 4).cast("int").alias("group"), F.col("id").cast("int").alias(axis))

    out = reduce.AveragingOp(groups("x"), "x", 16)(image(spark, d))[0].renamed({"group": "gx"})
    out = reduce.AveragingOp(groups("y"), "y", 16)(out)[0].renamed({"group": "gy"})
    return values(out.renamed({"gy": "y", "gx": "x"}) * 2.0, 5).select("y", "x", "re", "im")


@query(f"""WITH {IMAGE}, n AS (SELECT sample, greatest(0, least(15, round_even(((sample % 23) / 11 - 1 + 1) / 2 * 15, 0)))::INT AS x FROM (SELECT unnest(range(60))::INT AS sample))
SELECT y, sample, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM n JOIN img USING (x)""")
def grid_sampling_nearest(spark, d):
    pts = spark.range(60).select(F.col("id").cast("int").alias("sample"), (F.col("id") % 23 / 11 - 1).alias("g_x"))
    return values(gather.GridSamplingOp(pts, {"sample": 60}, {"x": 16}, "nearest", "border", True)(image(spark, d))[0], 5).select("y", "sample", "re", "im")


@query(f"""WITH {IMAGE}, n AS (SELECT x AS sample, greatest(0, least(15, x + 0.25 * 8)) AS p FROM (SELECT unnest(range(16))::INT AS x)),
w AS (SELECT sample, (floor(p) + k)::INT AS x, CASE k WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS w FROM n, (SELECT unnest([0, 1]) AS k))
SELECT y, sample, round(sum(w * re), 5) + 0.0 AS re FROM w JOIN img USING (x) WHERE w > 0 GROUP BY 1, 2""")
def grid_sampling_displaced(spark, d):
    moves = spark.range(16).select(F.col("id").cast("int").alias("x"), F.lit(0.25).alias("d_x"))
    pts = gather.grid_from_displacement(moves, {"x": 16}).withColumnRenamed("x", "sample")
    return values(gather.GridSamplingOp(pts, {"sample": 16}, {"x": 16}, padding="border")(image(spark, d))[0], 5).select("y", "sample", "re")


@query(f"""WITH {IMAGE}, p AS (SELECT sample, (sample % 13) / 6 - 1 AS g FROM (SELECT unnest(range(40))::INT AS sample)), a AS (SELECT sample, ((g + 1) * 16 - 1) / 2 AS a FROM p),
n AS (SELECT sample, (floor(a) + k)::INT AS x, CASE k WHEN 0 THEN 1 - (a - floor(a)) ELSE a - floor(a) END AS w FROM a, (SELECT unnest([0, 1]) AS k))
SELECT x, round(sum(w * (1 + sample / 10)), 5) + 0.0 AS re FROM n WHERE w <> 0 AND x BETWEEN 0 AND 15 GROUP BY 1""")
def grid_sampling_adjoint(spark, d):
    pts = spark.range(40).select(F.col("id").cast("int").alias("sample"), (F.col("id") % 13 / 6 - 1).alias("g_x"))
    y = TensorFrame(spark.range(40).select(F.col("id").cast("int").alias("sample"), (1 + F.col("id") / 10).alias("re"), F.lit(0.0).alias("im")), {"sample": 40})
    return values(gather.GridSamplingOp(pts, {"sample": 40}, {"x": 16}).H(y)[0], 5).select("x", "re")


@query(f"WITH {IMAGE} SELECT y, (x // 2)::INT AS x, round((sum(re) / 2) * 3, 5) + 0.0 AS re FROM img GROUP BY 1, 2")
def low_resolution(spark, d):
    got = {}

    def f(t):
        got["low"] = t
        return t * 3.0

    gather.apply_lowres(f, image(spark, d), {"x": 8})
    return values(got["low"] * 3.0, 5).select("y", "x", "re")


@query("""WITH a AS (SELECT vec_id AS atom_id, embedding FROM embeddings WHERE label = 0), n AS (SELECT coalesce(max(atom_id) + 1, 0) AS n FROM a)
SELECT atom_id, round(embedding[1]::DOUBLE, 6) AS first FROM a UNION ALL SELECT n + row_number() OVER (ORDER BY vec_id) - 1, round(embedding[1]::DOUBLE, 6) FROM embeddings, n WHERE label = 1""")
def dictionary_append(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("atom_id"), F.col("embedding").cast("array<double>").alias("re"), "label")
    out = gather.append_atoms(e.where("label = 0").drop("label"), e.where("label = 1").drop("label"))
    return out.select("atom_id", r(F.get("re", F.lit(0))).alias("first"))


# Fourier


_CROP = "(2 * pi() * (k - 8) * (j + 4 - 8) / 16)"
_AGAIN = "(-2 * pi() * (o - 4) * (j - 4) / 8)"


@query(f"""WITH {IMAGE}, mid AS (SELECT y, j, sum(re * cos({_CROP}) - im * sin({_CROP})) / 4 AS a, sum(re * sin({_CROP}) + im * cos({_CROP})) / 4 AS b FROM (SELECT y, x AS k, re, im FROM img), (SELECT unnest(range(8)) AS j) GROUP BY 1, 2)
SELECT y, o::INT AS x, round(sum(a * cos({_AGAIN}) - b * sin({_AGAIN})) / sqrt(8), 4) + 0.0 AS re, round(sum(a * sin({_AGAIN}) + b * cos({_AGAIN})) / sqrt(8), 4) + 0.0 AS im FROM mid, (SELECT unnest(range(8)) AS o) GROUP BY 1, 2""")
def remove_oversampling(spark, d):
    return values(fourier.remove_oversampling(image(spark, d), "x", 8), 4)


_FIELD = "(2 * pi() * (x - 8) / 64 * sample / 40)"


@query(f"""WITH {IMAGE}, t AS (SELECT sample, (sample * 0.37) % 16 - 8 AS k_y, (sample * 0.73) % 16 - 8 AS k_x FROM (SELECT unnest(range(40))::INT AS sample)),
p AS (SELECT sample, re, im, -2 * pi() * (k_y * (y - 8) + k_x * (x - 8)) / 16 - {_FIELD} AS p FROM img, t)
SELECT sample, round(sum(re * cos(p) - im * sin(p)) / 16, 4) + 0.0 AS re, round(sum(re * sin(p) + im * cos(p)) / 16, 4) + 0.0 AS im FROM p GROUP BY 1""")
def conjugate_phase_model(spark, d):
    s = np.arange(40)
    b0 = np.tile((np.arange(16) - 8) / 64, (16, 1))
    op = fourier.ConjugatePhaseOp({"y": 16, "x": 16}, np.stack([s * 0.37 % 16 - 8, s * 0.73 % 16 - 8], 1), s / 40, b0)
    return values(op.H(image(spark, d))[0], 4)


# Spins


def _prep(name, blocks, factor):
    def f(spark, d):
        df = table(spark, d, "customer").select("c_custkey", F.lit(2.0).alias("m0"), (0.5 + F.col("c_nationkey") / 20).alias("t1"), (0.05 + F.col("c_nationkey") / 100).alias("t2"), (0.8 + F.col("c_custkey") % 5 / 10).alias("b1"), F.lit(0.07).alias("t1_rho"))
        out = epg.simulate(df, epg.Sequence_([*blocks, epg.Fisp([0.5], [0.0], 0.01, 0.02)]), "c_custkey", 8)
        return out.select("c_custkey", r(F.sqrt(F.get("re", F.lit(0)) ** 2 + F.get("im", F.lit(0)) ** 2), 5).alias("signal"))

    f.__name__ = f"spin_preparation_{name}"
    query(f"SELECT c_custkey, round(abs(2 * ({factor.format(t1='(0.5 + c_nationkey / 20)', t2='(0.05 + c_nationkey / 100)')}) * sin((0.8::DOUBLE + c_custkey % 5 / 10) * 0.5) * exp(-0.01::DOUBLE / (0.05 + c_nationkey / 100))), 5) AS signal FROM customer")(f)


_prep("none", [], "1")
_prep("inversion", [epg.Inversion(0.3)], "1 - 2 * exp(-0.3::DOUBLE / {t1})")
_prep("t2", [epg.T2Prep(0.06)], "exp(-0.06::DOUBLE / {t2})")
_prep("t1_rho", [epg.T1RhoPrep(0.04)], "exp(-0.04::DOUBLE / 0.07::DOUBLE)")
_prep("delay", [epg.Pulse(math.pi / 2), epg.Dephase(), epg.Delay(0.4)], "1 - (1 - cos((0.8::DOUBLE + c_custkey % 5 / 10) * pi() / 2)) * exp(-0.4::DOUBLE / {t1})")


# Trajectories


@query("""WITH c AS (SELECT 0.5 * 64 / 0.3 AS lam, 2 * pi() / (1 - (1 - 2 * 12 / 64) ** (1 / 1.5)) AS w), e AS (SELECT lam, w, w / 1.75 * sqrt(lam / (100 * 42.5764e6)) AS s, lam * w / (0.02::DOUBLE * 42.5764e6 * 2.5) AS g FROM c),
h AS (SELECT *, (s ** (2.5 / 1.75) * 1.75 / (g * 2.5)) ** (1 + 2 / 1.5) AS turn FROM e), n AS (SELECT *, CASE WHEN turn < s THEN g ELSE s END AS t_end FROM h),
p AS (SELECT k1, k0, lam, w, k0 * t_end / 199 AS t, s, g, turn FROM n, (SELECT unnest(range(3)) AS k1), (SELECT unnest(range(200)) AS k0)),
u AS (SELECT *, CASE WHEN turn >= s OR t <= turn THEN (t / s) ** (1 / 1.75) ELSE least(t / g, 1) ** (1 / 2.5) END AS u FROM p)
SELECT k1::INT AS k1, k0::INT AS k0, round(lam * u ** 1.5 * sin(w * u + 2.39996 * k1), 4) + 0.0 AS ky, round(lam * u ** 1.5 * cos(w * u + 2.39996 * k1), 4) + 0.0 AS kx FROM u""")
def trajectory_spiral(spark, d):
    df = generators.spiral_2d(spark, 3, 200, 64, fov=0.3, acceleration=12.0, density=1.5, max_gradient=0.02)
    return df.select("k1", "k0", r(F.col("ky"), 4).alias("ky"), r(F.col("kx"), 4).alias("kx"))


@query("""WITH l AS (SELECT k2, (k2 * pi() * 0.618034) % pi() AS a FROM (SELECT unnest(range(25)) AS k2)), s AS (SELECT k2, a, ((row_number() OVER (ORDER BY a) - 1) * (1 + sqrt(5)) / 2) % 1 - 0.5 AS s FROM l),
p AS (SELECT k2, k1, a, CASE WHEN k1 = 0 THEN 0 ELSE k1 - 4 + s END AS r FROM s, (SELECT unnest(range(9)) AS k1))
SELECT k2::INT AS k2, k1::INT AS k1, round(r * sin(a), 5) + 0.0 AS kz, round(r * cos(a), 5) + 0.0 AS ky FROM p""")
def trajectory_sunflower(spark, d):
    df = spark.range(225).select(F.floor(F.col("id") / 9).cast("int").alias("k2"), F.pmod("id", F.lit(9)).cast("int").alias("k1"))
    return generators.sunflower(df, 4).select("k2", "k1", r(F.col("kz"), 5).alias("kz"), r(F.col("ky"), 5).alias("ky"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber * 0.4 AS a, CASE WHEN l_quantity = 25 THEN 0 ELSE l_quantity - 25 + [0, 0.5, 0.25, 0.75][l_linenumber % 4 + 1] END AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(r * sin(a), 5) + 0.0 AS kz, round(r * cos(a), 5) + 0.0 AS ky FROM p""")
def trajectory_radial_phase_encoding(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("k1"), F.col("l_linenumber").alias("k2"), F.lit(0).alias("k0"))
    return generators.radial_phase_encoding(df, (25, 0), 0.4).select("l_orderkey", "l_linenumber", r(F.col("kz"), 5).alias("kz"), r(F.col("ky"), 5).alias("ky"))


# Solvers and reconstructions


@query(f"WITH {IMAGE}, p AS (SELECT y, x, sqrt(re * re + im * im) AS m, re, im FROM img) SELECT y, x, round(re * greatest(m - 0.4, 0) / greatest(m, 1e-300), 4) + 0.0 AS re, round(im * greatest(m - 0.4, 0) / greatest(m, 1e-300), 4) + 0.0 AS im FROM p")
def proximal_gradient(spark, d):
    x = image(spark, d)
    return values(solvers.pgd(lambda v: (v - x).norm2() / 2, lambda v: v - x, reduce.L1Norm(weight=0.4), x * 0.0, max_iterations=3), 4)


@query("SELECT round(avg(l_quantity), 3) AS q, round(avg(l_extendedprice / 1000), 3) AS p, round(avg(l_quantity), 2) AS q2, round(avg(l_extendedprice / 1000), 2) AS p2 FROM lineitem")
def minimizers(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))

    def value(v):
        a, b = F.col("a") - float(v[0]), F.col("b") - float(v[1])
        row = df.agg(F.avg(a * a + b * b) / 2, -F.avg(a), -F.avg(b)).first()
        return row[0], np.array(row[1:3])

    x, y = solvers.lbfgs(value, np.zeros(2), tolerance=1e-7), solvers.adam(value, solvers.lbfgs(value, np.zeros(2), max_iterations=2), max_iterations=3, rate=1e-6)
    return spark.createDataFrame([(round(float(x[0]), 3), round(float(x[1]), 3), round(float(y[0]), 2), round(float(y[1]), 2))], "q double, p double, q2 double, p2 double")


def _readings(spark, d):
    at = np.stack(np.meshgrid(np.arange(16) - 8.0, np.arange(16) - 8.0, indexing="ij"), -1).reshape(-1, 2)
    return reconstruction.simulate(image(spark, d), generators.birdcage(spark, 3, 16, 16), at)


_SAME = f"WITH {IMAGE} SELECT y, x, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM img"


@query(_SAME)
def reconstruct_direct(spark, d):
    return values(reconstruction.Reconstruction.from_readings(_readings(spark, d), {"y": 16, "x": 16}, maps=generators.birdcage(spark, 3, 16, 16)).direct(), 3)


@query(_SAME)
def reconstruct_sense(spark, d):
    """Every second line is left out; the sensitivities of three coils make up for it."""
    coils = generators.birdcage(spark, 3, 16, 16, radius=0.6)
    at = np.stack(np.meshgrid(np.arange(-8.0, 8.0, 2), np.arange(16) - 8.0, indexing="ij"), -1).reshape(-1, 2)
    half = reconstruction.simulate(image(spark, d), coils, at)
    return values(reconstruction.Reconstruction.from_readings(half, {"y": 16, "x": 16}, maps=coils).sense(16), 3)


@query(f"WITH {IMAGE} SELECT y, x, round((re + 0.5 * 2) / 1.5, 3) + 0.0 AS re, round(im / 1.5, 3) + 0.0 AS im FROM img")
def reconstruct_regularized(spark, d):
    prior = image(spark, d).map(lambda v: v * 0.0 + 2.0)
    own = reconstruction.Reconstruction.from_readings(_readings(spark, d), {"y": 16, "x": 16}, maps=generators.birdcage(spark, 3, 16, 16))
    return values(own.regularized(0.5, prior, iterations=3), 3)


@query(_SAME)
def reconstruct_total_variation(spark, d):
    """Without weight on the differences the image comes back."""
    own = reconstruction.Reconstruction.from_readings(_readings(spark, d), {"y": 16, "x": 16}, maps=generators.birdcage(spark, 3, 16, 16))
    return values(own.total_variation(0.0, iterations=2), 3)


def _tv_steps(steps: int, weight: float, size: float) -> str:
    """Primal-dual steps on lines, by window: x and r are the iterate and the relaxed one, a and z the duals."""
    w = "(PARTITION BY vec_id ORDER BY k)"
    out = "s0 AS (SELECT vec_id, k, v AS b, v AS x, v AS r, 0.0::DOUBLE AS a, 0.0::DOUBLE AS z FROM v)"
    for n in range(steps):
        out += f""", d{n + 1} AS (SELECT vec_id, k, b, x, (a + {size} * (r - b)) / {1 + size / 2}::DOUBLE AS a,
        greatest(-{weight}::DOUBLE, least({weight}::DOUBLE, z + {size} * (coalesce(lead(r) OVER {w}, 0) - r))) AS z FROM s{n}),
        p{n + 1} AS (SELECT *, x - {size} * (a + coalesce(lag(z) OVER {w}, 0) - z) AS y FROM d{n + 1}),
        s{n + 1} AS (SELECT vec_id, k, b, y AS x, 2 * y - x AS r, a, z FROM p{n + 1})"""
    return out


@query(f"WITH {VECTORS}, {_tv_steps(4, 0.05, 0.4)} SELECT vec_id::INT AS y, k::INT AS x, round(x, 6) + 0.0 AS re, 0.0 AS im FROM s4".replace("s4.x", "x"))
def total_variation_lines(spark, d):
    """Four steps of denoising every vector along its entries, with a weight that flattens them."""
    return values(solvers.total_variation_denoising(vector_frame(spark, d), ["x"], 0.05, 4, primal_step=0.4, dual_step=0.4), 6)
