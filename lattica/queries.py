"""One query an operator, on the driver's tables as carriers, and the same in DuckDB SQL.

Carriers: `signal` numbers each user's events, `vectors` has one row an embedding entry, `image` is a
16 x 16 array of mean prices, and `lines` gives parameters of signal models. Floats are rounded, and
orders are total, so that both sides give the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import models, rotation, scalar
from lattica.functions.complexpair import Pair
from lattica.operators import epg, fourier, gather, gridding, reduce, structure, windowed
from lattica.plans import solvers
from lattica.sources import acquisitions, generators
from lattica.tensor import TensorFrame

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signal(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "value", (F.row_number().over(w) - 1).alias("i"))


SIGNAL = "s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


VECTORS = "v AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def vector_frame(spark, d) -> TensorFrame:
    n = (table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    df = vectors(spark, d).select(F.col("vec_id").cast("int").alias("y"), F.col("k").alias("x"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return TensorFrame(df, {"y": n, "x": 64})


def image(spark, d) -> TensorFrame:
    key = F.col("p_partkey")
    df = table(spark, d, "part").groupBy(F.pmod(key, F.lit(16)).cast("int").alias("y"), F.pmod(F.floor(key / 16), F.lit(16)).cast("int").alias("x")).agg((F.sum("p_retailprice") / F.count("*") / 1013).alias("re"), (F.sum("p_size") / F.count("*") / 10.7).alias("im"))
    return TensorFrame(df, {"y": 16, "x": 16}).dense()


IMAGE = "i AS (SELECT (p_partkey % 16)::INT AS y, ((p_partkey // 16) % 16)::INT AS x, sum(p_retailprice) / count(*) / 1013 AS re, sum(p_size) / count(*) / 10.7::DOUBLE AS im FROM part GROUP BY 1, 2), img AS (SELECT y, x, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM ((SELECT unnest(range(16))::INT AS y) CROSS JOIN (SELECT unnest(range(16))::INT AS x)) LEFT JOIN i USING (y, x))"


def values(x: TensorFrame, digits: int = 6) -> DataFrame:
    return x.df.select(*x.names, r(F.col("re"), digits).alias("re"), r(F.col("im"), digits).alias("im"))


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("m0"), (F.col("l_quantity") / 10 + 0.1).alias("t1"), (F.col("l_discount") + 0.05).alias("t2"), (F.col("l_tax") + 0.05).alias("x"))


LINES = "l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS m0, l_quantity / 10 + 0.1::DOUBLE AS t1, l_discount + 0.05::DOUBLE AS t2, l_tax + 0.05::DOUBLE AS x FROM lineitem)"


# Signal models, constraints, units, profiles


def _model(name, expression, sql):
    def f(spark, d):
        times = F.explode(F.array(*map(F.lit, (0.05, 0.4, 1.5))))
        return lines(spark, d).withColumn("t", times).select("l_orderkey", "l_linenumber", "t", r(expression()).alias("signal"))

    f.__name__ = f"model_{name}"
    query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, t, round({sql}, 6) + 0.0 AS signal FROM l, (SELECT unnest([0.05, 0.4, 1.5])::DOUBLE AS t)")(f)


_PI2 = "(pi() * 3.7e-6::DOUBLE * (0.8 + x) * 42.5764e6::DOUBLE * 0.005::DOUBLE) ** 2"
_ARG = "(pi() * 0.005::DOUBLE * sqrt((3.7e-6::DOUBLE * (0.8 + x) * 42.5764e6::DOUBLE) ** 2 + (t * 100 - t2 * 100) ** 2))"
_model("inversion_recovery", lambda: models.inversion_recovery("t", "m0", "t1"), "m0 * (1 - 2 * exp(-t / t1))")
_model("saturation_recovery", lambda: models.saturation_recovery("t", "m0", "t1"), "m0 * (1 - exp(-t / t1))")
_model("mono_exponential_decay", lambda: models.mono_exponential_decay("t", "m0", "t2"), "m0 * exp(-t / t2)")
_model("molli", lambda: models.molli("t", "m0", "t2", "t1"), "m0 * (1 - (1 + t2) * exp(-t / t1 * t2))")
_model("spoiled_gre", lambda: models.spoiled_gre(0.3, "t", 2.0, "m0", "t1", "t2"), "m0 * sin(0.3::DOUBLE) * (1 - exp(-2 / t1)) / (1 - cos(0.3::DOUBLE) * exp(-2 / t1)) * exp(-t / t2)")
_model(
    "transient_steady_state",
    lambda: models.transient_steady_state("t", 0.01, "m0", "t1", 0.1, -1.0, 0.02),
    "m0 / (1 - t1 * (ln(cos(0.1::DOUBLE)) / 0.01::DOUBLE)) + (m0 - 2 * m0 * exp(-0.02::DOUBLE / t1) - m0 / (1 - t1 * (ln(cos(0.1::DOUBLE)) / 0.01::DOUBLE))) * exp(-t * (1 / t1 - ln(cos(0.1::DOUBLE)) / 0.01::DOUBLE))",
)
_model("wasabi", lambda: models.wasabi(F.col("t") * 100, F.col("t2") * 100, F.col("x") + 0.8, "m0", "t1"), f"m0 * (1 - t1 * {_PI2} * (sin({_ARG}) / {_ARG}) ** 2)")
_model(
    "wasabiti",
    lambda: models.wasabiti(F.col("t") * 100, "t", F.col("t2") * 100, F.col("x") + 0.8, "t1", b1_nominal=3.7e-6),
    f"(1 - exp(-t / t1)) * (1 - 2 * {_PI2} * (sin({_ARG}) / {_ARG}) ** 2)",
)


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(0.1 + 2.9::DOUBLE / (1 + exp(-m0 * 0.05::DOUBLE)), 6) AS both_bounds,
round(0.5 + ln(1 + exp(-abs(t1))) + greatest(t1, 0), 6) AS low_only, round(2 - (ln(1 + exp(-abs(-t1))) + greatest(-t1, 0)), 6) AS high_only,
round(t1, 6) + 0.0 AS back FROM l""")
def constraints(spark, d):
    out = lines(spark, d)
    low = scalar.constrain("t1", 0.5)
    return out.select(
        "l_orderkey", "l_linenumber", r(scalar.constrain("m0", 0.1, 3.0, beta_sigmoid=0.05)).alias("both_bounds"), r(low).alias("low_only"),
        r(scalar.constrain("t1", None, 2.0)).alias("high_only"), r(scalar.unconstrain(low, 0.5)).alias("back"),
    )


@query("""SELECT p_partkey, p_size / 1e3 AS ms_s, p_size * 1e3 AS s_ms, p_size / 1e6 AS um_m, round(p_size * pi() / 180, 9) AS rad, round(p_retailprice / 42.5764, 6) AS field,
round(p_size * 0.0025::DOUBLE, 9) AS siemens, (p_retailprice * 1000)::DECIMAL(18, 6)::DOUBLE::BIGINT AS osi FROM part""")
def unit_conversions(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", scalar.ms_to_s("p_size").alias("ms_s"), scalar.s_to_ms("p_size").alias("s_ms"), scalar.micrometer_to_m("p_size").alias("um_m"), F.round(scalar.deg_to_rad("p_size"), 9).alias("rad"),
        F.round(scalar.larmor_frequency_to_field(F.col("p_retailprice") * 1e6), 6).alias("field"), F.round(scalar.ticks_to_seconds("p_size"), 9).alias("siemens"), F.round(F.col("p_retailprice") / 1e-3).cast("long").alias("osi"),
    )


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(exp(-(x * x) / (0.36 * 0.04)), 6) AS gauss,
CASE WHEN abs(t2) <= 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS box, round(CASE WHEN x <= 0.1::DOUBLE THEN x * 10 WHEN x <= 0.3::DOUBLE THEN 1 - (x - 0.1::DOUBLE) * 5 ELSE 0 END, 6) AS points FROM l""")
def slice_profiles(spark, d):
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", r(scalar.slice_gaussian("x", 0.2)).alias("gauss"), scalar.slice_smoothed_rectangular("t2", 0.2, 0).alias("box"),
        r(scalar.slice_interpolate("x", [0, 0.1, 0.3], [0, 1, 0])).alias("points"),
    )


@query("SELECT c_custkey, round(sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey), 6) AS magnitude, round(atan2(c_nationkey, c_acctbal), 9) AS phase FROM customer")
def magnitude_phase(spark, d):
    p = Pair(F.col("c_acctbal"), F.col("c_nationkey").cast("double"))
    return table(spark, d, "customer").select("c_custkey", r(p.magnitude()).alias("magnitude"), r(p.phase(), 9).alias("phase"))


# Rotations


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(t2, 6) + 0.0 AS z, round(sin(m0) * x + cos(m0) * t1, 6) + 0.0 AS y, round(cos(m0) * x - sin(m0) * t1, 6) + 0.0 AS x FROM l""")
def rotation_apply(spark, d):
    v = rotation.Rot.from_euler("z", ["m0"]).apply(rotation.Vec.from_xyz("x", "t1", "t2"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", r(v.z).alias("z"), r(v.y).alias("y"), r(v.x).alias("x"))


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(t2, 6) + 0.0 AS z, round(t1, 6) + 0.0 AS y, round(x, 6) + 0.0 AS x, true AS same FROM l""")
def rotation_inverse_and_matrix(spark, d):
    df, q = rotation.Rot.from_euler("ZY", ["m0", "t1"]).stored(lines(spark, d), "a")
    df, q = (q @ rotation.Rot.about("x", "x")).stored(df, "q")
    df, back = q.apply(rotation.Vec.from_xyz("x", "t1", "t2")).stored(df, "turned")
    df, back = q.apply(back, inverse=True).stored(df, "back")
    m = {f"m{i}{j}": c for i, row in enumerate(q.matrix()) for j, c in enumerate(row)}
    df, again = rotation.Rot.from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]).stored(df.withColumns(m), "again")
    return df.select("l_orderkey", "l_linenumber", r(back.z).alias("z"), r(back.y).alias("y"), r(back.x).alias("x"), q.approx_equal(again, 1e-5).alias("same"))


@query(f"""WITH {LINES} SELECT l_orderkey, l_linenumber, round(2 * asin(least(1.0, abs(sin(t1 / 2)))), 6) AS angle FROM l""")
def rotation_magnitude(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", r(rotation.Rot.about("y", "t1").magnitude()).alias("angle"))


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey % 100 AS g, atan2(2 * sum(sin(t2 / 2) * cos(t2 / 2)), sum(cos(t2 / 2) ** 2 - sin(t2 / 2) ** 2)) / 2 AS half FROM l GROUP BY 1)
SELECT g, round(sin(half), 5) + 0.0 AS qz, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qx, round(cos(half), 5) + 0.0 AS qw FROM m""")
def rotation_mean(spark, d):
    q = rotation.Rot.about("z", "t2")
    df = lines(spark, d).select(F.pmod("l_orderkey", F.lit(100)).alias("g"), q.v.z.alias("qz"), q.v.y.alias("qy"), q.v.x.alias("qx"), q.w.alias("qw"))
    return reduce.mean_rotation(df, ["g"]).select("g", *(r(c, 5).alias(c) for c in ("qz", "qy", "qx", "qw")))


# Filters and selection


def readings(spark, d):
    """Readings with flag bits made from status columns."""
    flags = F.when(F.col("l_returnflag") == "R", 1 << 18).when(F.col("l_linenumber") == 7, 1 << 19).when(F.col("l_linenumber") == 6, (1 << 20) + 64).when(F.col("l_linestatus") == "O", 1 << 21).otherwise(4)
    return table(spark, d, "lineitem").withColumn("flags", flags.cast("long"))


READINGS = "f AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 262144 WHEN l_linenumber = 7 THEN 524288 WHEN l_linenumber = 6 THEN 1048640 WHEN l_linestatus = 'O' THEN 2097152 ELSE 4 END::BIGINT AS flags FROM lineitem)"


@query(f"WITH {READINGS} SELECT l_orderkey, l_linenumber, flags FROM f WHERE flags & 785121340 = 0")
def filter_image_readings(spark, d):
    return readings(spark, d).where(acquisitions.is_image()).select("l_orderkey", "l_linenumber", "flags")


@query(f"WITH {READINGS} SELECT l_orderkey, l_linenumber FROM f WHERE flags & 262144 <> 0")
def filter_noise_readings(spark, d):
    return readings(spark, d).where(acquisitions.is_noise()).select("l_orderkey", "l_linenumber")


@query(f"WITH {READINGS} SELECT l_orderkey, l_linenumber FROM f WHERE flags & 1572864 <> 0")
def filter_calibration_readings(spark, d):
    return readings(spark, d).where(acquisitions.is_coil_calibration()).select("l_orderkey", "l_linenumber")


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def filter_coil_count(spark, d):
    return table(spark, d, "embeddings").where(acquisitions.has_n_coils(64, "embedding")).select("vec_id")


@query("SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 0 ELSE 1 END AS position, c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def select_subset_in_order(spark, d):
    return structure.select_in_order(table(spark, d, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING"], ["c_custkey"]).select("position", "c_custkey")


@query(f"""WITH {SIGNAL}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT user_id, unnest(range(0, ((n - 6) // 4 + 1)::BIGINT)) AS block FROM n WHERE n >= 6)
SELECT user_id, block::INT AS block, (i - block * 4)::INT AS place, value FROM b JOIN s USING (user_id) WHERE i BETWEEN block * 4 AND block * 4 + 5""")
def split_overlapping_blocks(spark, d):
    df = signal(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return structure.split_blocks(df, "i", 6, 2, n="n").select("user_id", "block", "place", "value")


@query(f"""WITH {SIGNAL}, m AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), e AS (SELECT user_id, i, value FROM s UNION ALL SELECT user_id, i + n, value FROM s JOIN m USING (user_id) WHERE i < 4),
c AS (SELECT user_id, n + least(4, n) AS n FROM m), b AS (SELECT user_id, unnest(range(0, ((n - 6) // 4 + 1)::BIGINT)) AS block FROM c WHERE n >= 6)
SELECT user_id, block::INT AS block, (i - block * 4)::INT AS place, value FROM b JOIN e USING (user_id) WHERE i BETWEEN block * 4 AND block * 4 + 5""")
def split_cyclic_blocks(spark, d):
    df = signal(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return structure.split_blocks(df, "i", 6, 2, True, "n").select("user_id", "block", "place", "value")


@query("SELECT o_custkey, o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1)::INT AS other, (row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_custkey, o_orderkey) - 1)::INT AS place FROM orders")
def regroup_by_labels(spark, d):
    df = table(spark, d, "orders")
    return structure.regroup(df, ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey"]).select("o_custkey", "o_orderkey", "other", "place")


@query("SELECT o_orderstatus, min(o_custkey) AS o_custkey_min, max(o_custkey) AS o_custkey_max, max(o_custkey) - min(o_custkey) + 1 AS o_custkey_length FROM orders GROUP BY 1")
def encoding_limits(spark, d):
    return acquisitions.limits(table(spark, d, "orders"), ["o_orderstatus"], ["o_custkey"])


@query("SELECT name, n FROM (SELECT 'img' || (p_partkey * 7 % 1000) || '.dcm' AS name, p_partkey * 7 % 1000 AS n FROM part)")
def natural_sort_key(spark, d):
    df = table(spark, d, "part").select(F.concat(F.lit("img"), (F.col("p_partkey") * 7 % 1000).cast("string"), F.lit(".dcm")).alias("name"))
    return df.withColumn("n", acquisitions.natural_key("name"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y%m%d%H%M%S') AS text, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def parse_datetimes(spark, d):
    df = table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("second", "ts"), "yyyyMMddHHmmss").alias("text"))
    return df.withColumn("parsed", F.date_format(acquisitions.parse_datetime(F.col("text")), "yyyy-MM-dd HH:mm:ss"))


# Structure


@query(f"WITH {IMAGE} SELECT (y // 4 * 16 + x)::INT AS a_x, (y % 4)::INT AS b, round(re, 6) AS re, round(im, 6) AS im FROM img")
def rearrange_axes(spark, d):
    return values(structure.rearrange(image(spark, d), "(a b) x -> (a x) b", a=4))


@query(f"WITH {IMAGE} SELECT (y + 3)::INT AS y, (x - 4)::INT AS x, round(re, 6) AS re, round(im, 6) AS im FROM img WHERE x - 4 BETWEEN 0 AND 8")
def pad_or_crop(spark, d):
    return values(structure.PadOrCropOp({"y": 16, "x": 16}, {"y": 21, "x": 9})(image(spark, d))[0])


@query(f"WITH {IMAGE} SELECT y, x, round(re, 6) AS re, round(im, 6) AS im FROM img UNION ALL SELECT y + 16, x, round(2 * re, 6), round(2 * im, 6) FROM img")
def concatenate_axis(spark, d):
    x = image(spark, d)
    return values(structure.concatenate([x, x * 2], "y"))


@query(f"WITH {IMAGE} SELECT 0 AS stack, y, x, round(re, 6) AS re, round(im, 6) AS im FROM img UNION ALL SELECT 1, y, x, round(-re, 6), round(-im, 6) FROM img")
def stack_axis(spark, d):
    x = image(spark, d)
    return values(structure.stack([x, x * -1]))


@query(f"""WITH {IMAGE}, p AS (SELECT unnest(range(0, 7)) AS py), q AS (SELECT unnest(range(0, 5)) AS px)
SELECT (py * 5 + px)::INT AS patch, (y - py * 2)::INT AS y, ((x - px * 3) // 1)::INT AS x, round(re, 6) AS re, round(im, 6) AS im FROM img, p, q WHERE y - py * 2 BETWEEN 0 AND 3 AND x - px * 3 BETWEEN 0 AND 2""")
def patches(spark, d):
    return values(structure.PatchOp({"y": 16, "x": 16}, {"y": 4, "x": 3}, {"y": 2, "x": 3})(image(spark, d))[0])


@query(f"WITH {IMAGE} SELECT y, x, round(re * (1 + (y BETWEEN 2 AND 13)::INT), 6) AS re, round(im * (1 + (y BETWEEN 2 AND 13)::INT), 6) AS im FROM img WHERE x < 15")
def patches_adjoint(spark, d):
    op = structure.PatchOp({"y": 16, "x": 16}, {"y": 4, "x": 3}, {"y": 2, "x": 3})
    return values(op.H(*op(image(spark, d)))[0])


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 7 + (l_linenumber - 1) AS flat, l_linenumber - 1 AS back FROM lineitem")
def ravel_indices(spark, d):
    flat = structure.ravel_index([F.col("l_orderkey"), F.col("l_linenumber") - 1], [0, 7])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flat.alias("flat"), structure.unravel_index(flat, [1 << 40, 7])[1].cast("int").alias("back"))


# Gather and scatter


def trajectory(spark, d):
    """Sample coordinates around a 16 x 16 grid, some of them outside."""
    return table(spark, d, "customer").select((F.col("c_custkey") - 1).cast("int").alias("sample"), (F.pmod(F.col("c_custkey") * 7, F.lit(19)) - 8.6).alias("k_y"), (F.pmod(F.col("c_custkey") * 5, F.lit(17)) - 8.2).alias("k_x"))


TRAJ = "t AS (SELECT (c_custkey - 1)::INT AS sample, (c_custkey * 7 % 19) - 8.6 AS k_y, (c_custkey * 5 % 17) - 8.2 AS k_x FROM customer), g AS (SELECT sample, round_even(k_y, 0)::INT + 8 AS y, round_even(k_x, 0)::INT + 8 AS x FROM t)"


def sampling(spark, d):
    df = trajectory(spark, d)
    return gather.CartesianSamplingOp(df, {"sample": df.count()}, {"y": 16, "x": 16})


@query(f"WITH {IMAGE}, {TRAJ} SELECT sample, round(re, 6) AS re, round(im, 6) AS im FROM g JOIN img USING (y, x)")
def cartesian_sampling(spark, d):
    return values(sampling(spark, d)(image(spark, d))[0])


@query(f"WITH {IMAGE}, {TRAJ} SELECT y::INT AS y, x::INT AS x, round(re * 1, 6) AS re, round(im * 1, 6) AS im FROM img SEMI JOIN g USING (y, x)")
def cartesian_sampling_adjoint(spark, d):
    op = sampling(spark, d)
    return values(op.H(*op(image(spark, d)))[0])


@query(f"WITH {IMAGE}, {TRAJ} SELECT y, x, round(re, 6) AS re, round(im, 6) AS im FROM img SEMI JOIN g USING (y, x)")
def cartesian_masking(spark, d):
    return values(sampling(spark, d).gram(image(spark, d))[0])


def maps(spark) -> TensorFrame:
    grid = TensorFrame(spark.createDataFrame([], "coil int, y int, x int, re double, im double"), {"coil": 4, "y": 16, "x": 16}).grid(spark)
    return TensorFrame(grid.select("coil", "y", "x", ((F.col("coil") + 1) / 4).alias("re"), ((F.col("x") - F.col("y")) / 16).alias("im")), {"coil": 4, "y": 16, "x": 16})


MAPS = "m AS (SELECT coil, y, x, (coil + 1) / 4 AS mr, (x - y) / 16 AS mi FROM (SELECT unnest(range(4))::INT AS coil), (SELECT unnest(range(16))::INT AS y), (SELECT unnest(range(16))::INT AS x))"


@query(f"WITH {IMAGE}, {MAPS} SELECT coil, y, x, round(re * mr - im * mi, 6) + 0.0 AS re, round(re * mi + im * mr, 6) + 0.0::DOUBLE AS im FROM img JOIN m USING (y, x)")
def coil_sensitivity(spark, d):
    return values(gather.SensitivityOp(maps(spark))(image(spark, d))[0])


@query(f"WITH {IMAGE}, {MAPS} SELECT y, x, round(sum(re * (mr * mr + mi * mi)), 5) + 0.0 AS re, round(sum(im * (mr * mr + mi * mi)), 5) + 0.0::DOUBLE AS im FROM img JOIN m USING (y, x) GROUP BY y, x")
def coil_combination(spark, d):
    op = gather.SensitivityOp(maps(spark))
    return values(op.gram(image(spark, d))[0], 5)


@query(f"WITH {IMAGE} SELECT y, x, round(re * (1 + y / 16), 6) AS re, round(im * (1 + y / 16), 6) AS im FROM img")
def density_compensation(spark, d):
    w = TensorFrame(spark.range(16).select(F.col("id").cast("int").alias("y"), (1 + F.col("id") / 16).alias("re"), F.lit(0.0).alias("im")), {"y": 16})
    return values(gather.DensityCompensationOp(w)(image(spark, d))[0])


@query(f"WITH {VECTORS} SELECT o::INT AS o, vec_id::INT AS y, round(sum(v * cos(o * k)), 5) + 0.0 AS re, 0.0::DOUBLE AS im FROM v, (SELECT unnest(range(8)) AS o) GROUP BY 1, 2")
def einsum_matrix_product(spark, d):
    grid = TensorFrame(spark.createDataFrame([], "o int, x int, re double, im double"), {"o": 8, "x": 64}).grid(spark)
    m = TensorFrame(grid.select("o", "x", F.cos(F.col("o") * F.col("x")).alias("re"), F.lit(0.0).alias("im")), {"o": 8, "x": 64})
    return values(gather.EinsumOp(m, "o x, x -> o")(vector_frame(spark, d))[0], 5)


@query(f"""WITH {IMAGE}, p AS (SELECT (c_custkey - 1)::INT AS sample, (c_custkey % 23) / 11 - 1 AS gy, (c_custkey % 29) / 14 - 1 AS gx FROM customer),
a AS (SELECT sample, ((gy + 1) * 16 - 1) / 2 AS ay, ((gx + 1) * 16 - 1) / 2 AS ax FROM p),
n AS (SELECT sample, (floor(ay) + dy)::INT AS y, (floor(ax) + dx)::INT AS x, (CASE dy WHEN 0 THEN 1 - (ay - floor(ay)) ELSE ay - floor(ay) END) * (CASE dx WHEN 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END) AS w
FROM a, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
SELECT sample, round(sum(w * re), 5) AS re, round(sum(w * im), 5) AS im FROM n JOIN img USING (y, x) WHERE w <> 0 GROUP BY 1""")
def grid_sampling(spark, d):
    pts = table(spark, d, "customer").select((F.col("c_custkey") - 1).cast("int").alias("sample"), (F.col("c_custkey") % 23 / 11 - 1).alias("g_y"), (F.col("c_custkey") % 29 / 14 - 1).alias("g_x"))
    return values(gather.GridSamplingOp(pts, {"sample": pts.count()}, {"y": 16, "x": 16})(image(spark, d))[0], 5)


@query("""WITH m AS (SELECT o_custkey % 50 AS target, l_partkey % 100 AS source, avg(l_discount) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
v AS (SELECT p_partkey % 100 AS source, sum(p_retailprice) / count(*) AS p FROM part GROUP BY 1) SELECT target::INT AS target, round(sum(w * p), 4) AS re, 0.0::DOUBLE AS im FROM m JOIN v USING (source) GROUP BY 1""")
def sparse_projection(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).groupBy((F.col("o_custkey") % 50).cast("int").alias("target"), (F.col("l_partkey") % 100).cast("int").alias("source")).agg(F.avg("l_discount").alias("w"))
    v = table(spark, d, "part").groupBy((F.col("p_partkey") % 100).cast("int").alias("voxel")).agg((F.sum("p_retailprice") / F.count("*")).alias("re")).withColumn("im", F.lit(0.0))
    return values(gather.SparseProjectionOp(m, ("voxel", 100), ("target", 50))(TensorFrame(v, {"voxel": 100}))[0], 4)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), a AS (SELECT vec_id AS atom_id, x FROM e WHERE vec_id % 10 = 0), p AS (
SELECT e.vec_id, atom_id, list_dot_product(e.x, a.x) AS dot, list_dot_product(a.x, a.x) AS nn FROM e, a)
SELECT vec_id, arg_max(atom_id, (round(dot * dot / nn, 9), -atom_id)) AS atom_id, round(max(dot * dot / nn), 6) AS similarity FROM p GROUP BY 1""")
def dictionary_matching(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("re"))
    atoms = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "atom_id")
    return gather.dictionary_match(e, atoms, "vec_id", digits=9).select("vec_id", "atom_id", r(F.col("similarity")).alias("similarity"))


@query("""WITH t AS (SELECT p_size::DOUBLE AS xp, avg(p_retailprice) AS fp FROM part GROUP BY 1), q AS (SELECT l_orderkey, l_linenumber, l_quantity * 1.1 - 2.05 AS x FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, x, xp AS xa, fp AS fa FROM q ASOF LEFT JOIN t ON x >= xp), c AS (SELECT b.*, xp AS xb, fp AS fb FROM b ASOF LEFT JOIN t ON x <= xp)
SELECT l_orderkey, l_linenumber, round(CASE WHEN xa IS NULL THEN fb WHEN xb IS NULL THEN fa WHEN xa = xb THEN fa ELSE fa + (x - xa) * (fb - fa) / (xb - xa) END, 4) AS f FROM c""")
def table_interpolation(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("xp")).agg(F.avg("p_retailprice").alias("fp"))
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.1 - 2.05).alias("x"))
    return gather.interp(q, t).select("l_orderkey", "l_linenumber", r(F.col("f"), 4).alias("f"))


@query(f"""WITH {IMAGE}, n AS (SELECT i, greatest(0.0, least(15.0, (i + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5)) AS p FROM (SELECT unnest(range(10)) AS i)),
w AS (SELECT i, (floor(p) + k)::INT AS x, CASE k WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS w FROM n, (SELECT unnest([0, 1]) AS k))
SELECT y, i::INT AS x, round(sum(w * re), 5) AS re, round(sum(w * im), 5) AS im FROM w JOIN img USING (x) GROUP BY 1, 2""")
def resize_axis(spark, d):
    return values(gather.interpolate_axis(image(spark, d), "x", 10), 5)


# Reductions, functionals, statistics


@query(f"WITH {IMAGE}, {MAPS} SELECT y, x, round(sqrt(sum((re * mr - im * mi) ** 2 + (re * mi + im * mr) ** 2)), 5) AS re, 0.0::DOUBLE AS im FROM img JOIN m USING (y, x) GROUP BY 1, 2")
def root_sum_of_squares(spark, d):
    return values(reduce.rss(gather.SensitivityOp(maps(spark))(image(spark, d))[0]), 5)


@query(f"""WITH {IMAGE}, g AS (SELECT x, x // 4 AS "group" FROM (SELECT unnest(range(16)) AS x) UNION ALL SELECT x, 4 FROM (SELECT unnest(range(0, 16, 3)) AS x))
SELECT y, "group"::INT AS "group", round(avg(re), 5) AS re, round(avg(im), 5) AS im FROM img JOIN g USING (x) GROUP BY 1, 2""")
def averaging(spark, d):
    x = F.col("id").cast("int").alias("x")
    g = spark.range(16).select(F.floor(F.col("id") / 4).cast("int").alias("group"), x).unionByName(spark.range(0, 16, 3).select(F.lit(4).alias("group"), x))
    return values(reduce.AveragingOp(g, "x", 16)(image(spark, d))[0], 5)


def _functional(name, op, sql):
    def f(spark, d):
        return op().forward(image(spark, d)).df.select("y", r(F.col("re"), 5).alias("cost"))

    f.__name__ = f"functional_{name}"
    query(f"WITH {IMAGE} SELECT y, round({sql}, 5) AS cost FROM img GROUP BY 1")(f)


_functional("l1", lambda: reduce.L1Norm(1 + 1j, 2.0, ["x"]), "sum(2 * sqrt((re - 1) ** 2 + (im - 1) ** 2))")
_functional("l1_view_as_real", lambda: reduce.L1NormViewAsReal(1 + 1j, 2.0, ["x"]), "sum(2 * (abs(re - 1) + abs(im - 1)))")
_functional("l2_squared", lambda: reduce.L2NormSquared(1 + 1j, 2.0, ["x"]), "sum(4 * ((re - 1) ** 2 + (im - 1) ** 2))")
_functional("mse", lambda: reduce.MSE(1 + 1j, 2.0, ["x"]), "sum(4 * ((re - 1) ** 2 + (im - 1) ** 2)) / 16")
_functional("zero", lambda: reduce.ZeroFunctional(dim=["x"]), "sum(0.0)")


def _prox(name, run, re, im):
    def f(spark, d):
        return values(run(image(spark, d)))

    f.__name__ = f"prox_{name}"
    query(f"WITH {IMAGE}, p AS (SELECT y, x, re - 1 AS a, im - 1 AS b, re, im FROM img) SELECT y, x, round({re}, 6) + 0.0 AS re, round({im}, 6) + 0.0::DOUBLE AS im FROM p")(f)


_M = "sqrt(a * a + b * b)"
_prox("l1", lambda x: reduce.L1Norm(1 + 1j).prox(x, 0.5), f"1 + a * greatest({_M} - 0.5, 0) / {_M}", f"1 + b * greatest({_M} - 0.5, 0) / {_M}")
_prox("l1_view_as_real", lambda x: reduce.L1NormViewAsReal(1 + 1j).prox(x, 0.5), "1 + sign(a) * greatest(abs(a) - 0.5, 0)", "1 + sign(b) * greatest(abs(b) - 0.5, 0)")
_prox("l2_squared", lambda x: reduce.L2NormSquared(1 + 1j, 2.0).prox(x, 0.5), "(re + 4) / 5", "(im + 4) / 5")
_N = "sqrt((re - 0.5) ** 2 + (im - 0.5) ** 2)"
_prox("l1_conjugate", lambda x: reduce.L1Norm(1 + 1j).prox_convex_conj(x, 0.5), f"(re - 0.5) * least(1, 1 / {_N})", f"(im - 0.5) * least(1, 1 / {_N})")
_prox("l2_conjugate", lambda x: reduce.L2NormSquared(1 + 1j).prox_convex_conj(x, 0.5), "re - 0.5 * (2 * re + 4) / 5", "im - 0.5 * (2 * im + 4) / 5")


@query(f"""WITH {IMAGE}, w AS (SELECT wy, wx, re AS a, re * 0.9 + im * 0.1 AS b FROM img, (SELECT unnest(range(10)) AS wy), (SELECT unnest(range(10)) AS wx) WHERE y BETWEEN wy AND wy + 6 AND x BETWEEN wx AND wx + 6),
m AS (SELECT wy, wx, avg(a) AS a, avg(b) AS b, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM w GROUP BY 1, 2)
SELECT wy::INT AS y, wx::INT AS x, round((2 * a * b + 1e-4) * (2 * 49 / 48 * (ab - a * b) + 9e-4) / ((a * a + b * b + 1e-4) * (49 / 48 * (aa - a * a) + 49 / 48 * (bb - b * b) + 9e-4)), 4) AS ssim FROM m""")
def ssim_windows(spark, d):
    x = image(spark, d)
    y = x.map(lambda v: Pair(v.re * 0.9 + v.im * 0.1, F.lit(0.0)))
    return reduce.ssim(x, y, {"y": 7, "x": 7}, data_range=1.0).select("y", "x", r(F.col("ssim"), 4).alias("ssim"))


@query(f"""WITH {VECTORS}
SELECT a.label, a.k::INT AS i, b.k::INT AS j, round(avg(a.v * b.v), 6) + 0.0 AS re FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2, 3""")
def channel_covariance(spark, d):
    df = vectors(spark, d).select("label", "vec_id", "k", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return reduce.covariance(df, ["label"], ["vec_id"], "k").select("label", "i", "j", r(F.col("re")).alias("re"))


@query()
def coil_compression(spark, d):
    x = vector_frame(spark, d)
    return values(reduce.compress_coils(x, 3, "x").map(lambda v: Pair(v.magnitude(), F.lit(0.0))))


@query()
def noise_prewhitening(spark, d):
    x = vector_frame(spark, d)
    return values(reduce.prewhiten(x, x, coil="x"))


@query(f"""WITH {SIGNAL}, p AS (SELECT user_id, round(value, 0) AS k, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT *, k - lag(k) OVER w AS b, lead(k) OVER w - k AS a FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k)),
d AS (SELECT user_id, k, CASE WHEN a IS NULL AND b IS NULL THEN 1 ELSE (coalesce(b, a) + coalesce(a, b)) / 2 END / n AS w FROM g)
SELECT user_id, i::INT AS i, round(w, 6) AS w FROM s JOIN d ON s.user_id = d.user_id AND round(value, 0) = k""".replace("SELECT user_id, i::INT", "SELECT s.user_id, i::INT"))
def density_weights_1d(spark, d):
    df = signal(spark, d).select("user_id", "i", F.round("value", 0).alias("k"))
    return reduce.density_1d(df, ["user_id"], "k").select("user_id", "i", r(F.col("w")).alias("w"))


@query()
def density_weights_2d(spark, d):
    df = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey", (F.col("c_custkey") * 7 % 31).cast("double").alias("k1"), (F.col("c_acctbal") / 500).alias("k2"))
    return reduce.density_2d(df, ["g"], "k1", "k2").select("g", "c_custkey", r(F.col("w"), 4).alias("w"))


@query("SELECT l_returnflag, max(abs(l_quantity - round_even(l_quantity, 0))) <= 0.001 AS l_quantity_on_grid, max(l_quantity) - min(l_quantity) <= 0.001 AS l_quantity_single, max(abs(l_tax - round_even(l_tax, 0))) <= 0.001 AS l_tax_on_grid, max(l_tax) - min(l_tax) <= 0.001 AS l_tax_single FROM lineitem GROUP BY 1")
def trajectory_types(spark, d):
    return generators.on_grid(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], ["l_returnflag"])


@query("SELECT p_brand, min(p_size) AS p_size_from, max(p_size) + 1 AS p_size_to FROM part WHERE p_retailprice > 950 GROUP BY 1")
def mask_bounding_box(spark, d):
    return generators.bounding_box(table(spark, d, "part"), F.col("p_retailprice") > 950, ["p_brand"], ["p_size"])


@query("SELECT l_orderkey, round(sum(l_quantity * l_linenumber * 0.0987654321::DOUBLE) / sum(l_quantity), 6) AS value, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS main FROM lineitem GROUP BY 1")
def tissue_weighted_map(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("tissue"), F.col("l_quantity").alias("fraction"))
    t = spark.range(1, 8).select(F.col("id").cast("int").alias("tissue"), (F.col("id") * 0.0987654321).alias("value"))
    return generators.tissue_map(f, t, ["l_orderkey"]).select("l_orderkey", r(F.col("value")).alias("value"), "main")


# Windows


def _window(name, run, sql):
    def f(spark, d):
        return run(signal(spark, d)).select("user_id", "i", r(F.col("v"), 5).alias("v"))

    f.__name__ = name
    query(f"WITH {SIGNAL} SELECT user_id, i::INT AS i, round({sql}, 5) + 0.0 AS v FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)")(f)


_AT = (["user_id"], "i", "value")
_window("difference_central", lambda s: windowed.finite_difference(s, *_AT), "(coalesce(lead(value) OVER w, 0) - coalesce(lag(value) OVER w, 0)) / 2")
_window("difference_forward", lambda s: windowed.finite_difference(s, *_AT, "forward"), "coalesce(lead(value) OVER w, 0) - value")
_window("difference_backward", lambda s: windowed.finite_difference(s, *_AT, "backward"), "value - coalesce(lag(value) OVER w, 0)")
_ALL = "(PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_window("difference_circular", lambda s: windowed.finite_difference(s, *_AT, "forward", "circular"), f"coalesce(lead(value) OVER w, first_value(value) OVER {_ALL}) - value")
_window("filter_uniform", lambda s: windowed.uniform_filter(s, *_AT, 5), "sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5")
_G = windowed.gaussian_kernel(0.7)
_window("filter_gaussian", lambda s: windowed.gaussian_filter(s, *_AT, 0.7), " + ".join(f"{c!r}::DOUBLE * coalesce({'lead' if k > 3 else 'lag'}(value, {abs(k - 3)}) OVER w, 0)" for k, c in enumerate(_G)))
_window(
    "filter_separable_replicate", lambda s: windowed.correlate(s, *_AT, [1, 2, 1], "replicate"),
    f"coalesce(lag(value) OVER w, first_value(value) OVER {_ALL}) + 2 * value + coalesce(lead(value) OVER w, last_value(value) OVER {_ALL})",
)


@query(f"""WITH RECURSIVE {SIGNAL}, e AS (SELECT user_id, i, value AS e FROM s WHERE i = 0 UNION ALL SELECT s.user_id, s.i, 0.87::DOUBLE * e.e + 0.13::DOUBLE * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)
SELECT user_id, i::INT AS i, round(e, 4) AS ema FROM e""")
def moving_average(spark, d):
    return windowed.ema(signal(spark, d), ["user_id"], ["i"], "value", 0.87).select("user_id", "i", r(F.col("ema"), 4).alias("ema"))


@query(f"""WITH {IMAGE}, k AS (SELECT * FROM (VALUES (0, -1, 1.0), (0, 0, -2.0), (0, 1, 1.0), (1, -1, -1.0), (1, 1, 1.0)) k(filter, o, c))
SELECT filter, y, ((x - o + 16) % 16)::INT AS x, round(sum(c * re), 5) + 0.0 AS re, round(sum(c * im), 5) + 0.0::DOUBLE AS im FROM img, k GROUP BY 1, 2, 3""")
def convolution_dictionary(spark, d):
    return values(windowed.ConvAnalysisOp("x", [(1, -2, 1), (-1, 0, 1)])(image(spark, d))[0], 5)


@query(f"""WITH {IMAGE}, a AS (SELECT y, x // 2 AS i, x % 2 AS o, re, im FROM img)
SELECT y, (i + b * 8)::INT AS x, round(sum(re * CASE WHEN b = 1 AND o = 1 THEN -1 ELSE 1 END) / sqrt(2), 5) + 0.0 AS re, round(sum(im * CASE WHEN b = 1 AND o = 1 THEN -1 ELSE 1 END) / sqrt(2), 5) + 0.0::DOUBLE AS im
FROM a, (SELECT unnest([0, 1]) AS b) GROUP BY 1, 2""")
def wavelet_haar(spark, d):
    return values(windowed.WaveletOp("x", "haar")(image(spark, d))[0], 5)


# Fourier


def _ft(sign, columns="x"):
    angle = f"({sign} * 2 * pi() * (k - 8) * (x - 8) / 16)"
    return f"round(sum(re * cos({angle}) - im * sin({angle})) / 4, 5) + 0.0 AS re, round(sum(re * sin({angle}) + im * cos({angle})) / 4, 5) + 0.0::DOUBLE AS im"


_K = "(SELECT unnest(range(16)) AS k)"


@query(f"WITH {IMAGE} SELECT y, k::INT AS x, {_ft(-1)} FROM img, {_K} GROUP BY 1, 2")
def fourier_fft(spark, d):
    return values(fourier.FastFourierOp(["x"])(image(spark, d))[0], 5)


@query(f"WITH {IMAGE} SELECT y, k::INT AS x, {_ft(1)} FROM img, {_K} GROUP BY 1, 2")
def fourier_dft_join_inverse(spark, d):
    x = image(spark, d)
    return values(TensorFrame(fourier.dft(x.df, ["y"], "x", 16, True), x.axes), 5)


def _gridded(spark):
    points = [F.pmod(F.col("id") * step, F.lit(16.0)) - 8 for step in (0.37, 0.73)]
    track = spark.range(40).select(F.col("id").cast("int").alias("sample"), points[0].alias("k_y"), points[1].alias("k_x"))
    return gridding.GriddedFourierOp({"y": 16, "x": 16}, track, {"sample": 40}, width=12)


_NUFFT = "(-2 * pi() * (k_y * (y - 8) + k_x * (x - 8)) / 16)"


@query(f"""WITH {IMAGE}, t AS (SELECT sample, (sample * 0.37) % 16 - 8 AS k_y, (sample * 0.73) % 16 - 8 AS k_x FROM (SELECT unnest(range(40))::INT AS sample))
SELECT sample, round(sum(re * cos({_NUFFT}) - im * sin({_NUFFT})) / 16, 4) + 0.0 AS re, round(sum(re * sin({_NUFFT}) + im * cos({_NUFFT})) / 16, 4) + 0.0::DOUBLE AS im FROM img, t GROUP BY 1""")
def fourier_nonuniform(spark, d):
    return values(_gridded(spark)(image(spark, d))[0], 4)


@query(f"""WITH {IMAGE}, t AS (SELECT sample, (sample * 0.37) % 16 - 8 AS k_y, (sample * 0.73) % 16 - 8 AS k_x FROM (SELECT unnest(range(40))::INT AS sample)),
f AS (SELECT sample, k_y, k_x, sum(re * cos({_NUFFT}) - im * sin({_NUFFT})) / 16 AS a, sum(re * sin({_NUFFT}) + im * cos({_NUFFT})) / 16 AS b FROM img, t GROUP BY 1, 2, 3)
SELECT y, x, round(sum(a * cos({_NUFFT}) + b * sin({_NUFFT})) / 16, 4) + 0.0 AS re, round(sum(b * cos({_NUFFT}) - a * sin({_NUFFT})) / 16, 4) + 0.0 AS im
FROM f, (SELECT unnest(range(16))::INT AS y), (SELECT unnest(range(16))::INT AS x) GROUP BY 1, 2""")
def fourier_toeplitz_gram(spark, d):
    return values(_gridded(spark).gram(image(spark, d))[0], 4)


# Simulation, generators, solvers


@query("SELECT c_custkey, round(c_acctbal * exp(-0.02 / (0.05 + c_nationkey / 100)), 4) AS echo1, round(c_acctbal * exp(-0.06 / (0.05 + c_nationkey / 100)), 4) AS echo3 FROM customer")
def spin_echo_train(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("m0"), F.lit(1.0).alias("t1"), (0.05 + F.col("c_nationkey") / 100).alias("t2"))
    out = epg.simulate(df, epg.multi_echo_spin_echo([math.pi] * 3, [0.0] * 3, 0.02), "c_custkey", 8)
    mag = lambda k: F.sqrt(F.get("re", F.lit(k)) ** 2 + F.get("im", F.lit(k)) ** 2)
    s = df.select("c_custkey", F.signum("m0").alias("s"))
    return out.join(s, "c_custkey").select("c_custkey", r(mag(0) * F.col("s"), 4).alias("echo1"), r(mag(2) * F.col("s"), 4).alias("echo3"))


@query()
def magnetic_fingerprint(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.lit(1.0).alias("m0"), (0.5 + F.col("s_nationkey") / 20).alias("t1"), (0.02 + F.col("s_nationkey") / 500).alias("t2"))
    out = epg.simulate(df, epg.cardiac_fingerprinting(), "s_suppkey")
    return out.select("s_suppkey", F.size("re").alias("n"), r(F.expr("aggregate(zip_with(re, im, (a, b) -> a * a + b * b), 0D, (a, x) -> a + x)")).alias("energy"))


@query("SELECT y, x, sum(CASE WHEN ((x - 16) / 32 - cx) ** 2 / rx ** 2 + ((y - 16) / 32 - cy) ** 2 / ry ** 2 <= 1 THEN a ELSE 0 END) AS re FROM (SELECT unnest(range(32))::INT AS y), (SELECT unnest(range(32))::INT AS x), (VALUES (0.2::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 1.0::DOUBLE), (0.1, -0.1, 0.3, 0.1, 2.0), (-0.2, 0.2, 0.18, 0.25, 4.0)) e(cx, cy, rx, ry, a) GROUP BY 1, 2")
def ellipse_phantom(spark, d):
    return generators.ellipse_image(spark, 32, 32).df.select("y", "x", "re")


@query(f"""WITH {TRAJ}, q AS (SELECT sample, k_y, k_x, a, rx * ry AS area, cx * k_x + cy * k_y AS shift, 2 * pi() * sqrt(rx * rx * k_x * k_x + ry * ry * k_y * k_y) AS q
FROM t, (VALUES (0.2::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 1.0::DOUBLE), (0.1, -0.1, 0.3, 0.1, 2.0), (-0.2, 0.2, 0.18, 0.25, 4.0)) e(cx, cy, rx, ry, a)),
j AS (SELECT sample, a, area, shift, q, avg(cos(u - q * sin(u))) AS j FROM q, (SELECT (unnest(range(256)) + 0.5) * pi() / 256 AS u) GROUP BY ALL)
SELECT sample, round(32 * sum(a * 2 * pi() * area * CASE WHEN q < 1e-9 THEN 0.5 ELSE j / q END * cos(2 * pi() * shift)), 5) + 0.0 AS re,
round(-32 * sum(a * 2 * pi() * area * CASE WHEN q < 1e-9 THEN 0.5 ELSE j / q END * sin(2 * pi() * shift)), 5) + 0.0 AS im FROM j GROUP BY 1""")
def ellipse_phantom_kspace(spark, d):
    out = generators.ellipse_kspace(trajectory(spark, d).select("sample", "k_y", "k_x"), "k_y", "k_x", 32, 32)
    return out.select("sample", r(F.col("re"), 5).alias("re"), r(F.col("im"), 5).alias("im"))


@query("""WITH g AS (SELECT coil, y, x, y - 8 - 15 * 1.5 * sin(coil * 2 * pi() / 5) AS dy, x - 8 - 16 * 1.5 * cos(coil * 2 * pi() / 5) AS dx FROM (SELECT unnest(range(5))::INT AS coil), (SELECT unnest(range(15))::INT AS y), (SELECT unnest(range(16))::INT AS x)),
n AS (SELECT y, x, sqrt(sum(1 / (dx * dx + dy * dy))) AS rss FROM g GROUP BY 1, 2)
SELECT coil, y, x, round(cos(atan2(dx, -dy) - coil * 2 * pi() / 5) / sqrt(dx * dx + dy * dy) / (rss + 1e-8), 5) + 0.0 AS re, round(sin(atan2(dx, -dy) - coil * 2 * pi() / 5) / sqrt(dx * dx + dy * dy) / (rss + 1e-8), 5) + 0.0 AS im FROM g JOIN n USING (y, x)""")
def birdcage_coils(spark, d):
    return values(generators.birdcage(spark, 5, 15, 16), 5)


@query("SELECT l_orderkey, l_linenumber, (l_linenumber - 4)::DOUBLE AS ky, (l_quantity - 25)::DOUBLE AS kx, (CASE WHEN l_linestatus = 'O' THEN -1 - (l_quantity - 25) ELSE l_quantity - 25 END)::DOUBLE AS readout FROM lineitem")
def trajectory_cartesian(spark, d):
    df = table(spark, d, "lineitem").select("*", F.lit(0).alias("k2"), F.col("l_linenumber").alias("k1"), F.col("l_quantity").alias("k0"))
    return generators.cartesian(df, (0, 4, 25)).select("l_orderkey", "l_linenumber", "ky", "kx", generators.readout("k0", 25, F.col("l_linestatus") == "O").cast("double").alias("readout"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - 25) * sin(l_linenumber * pi() * 0.618034), 6) + 0.0 AS ky, round((l_quantity - 25) * cos(l_linenumber * pi() * 0.618034), 6) + 0.0 AS kx FROM lineitem")
def trajectory_radial(spark, d):
    df = table(spark, d, "lineitem").select("*", F.col("l_linenumber").alias("k1"), F.col("l_quantity").alias("k0"))
    return generators.radial_2d(df, 25).select("l_orderkey", "l_linenumber", r(F.col("ky")).alias("ky"), r(F.col("kx")).alias("kx"))


@query()
def trajectory_variable_density(spark, d):
    return generators.variable_density(spark, -32, 32, 24, 20.0, [-1, 0, 1])


@query(f"""WITH {IMAGE} SELECT y, x, round(re / (3 + (y % 4) / 4), 4) AS re, round(im / (3 + (y % 4) / 4), 4) AS im FROM img""")
def conjugate_gradient(spark, d):
    from lattica.plans.algebra import Identity

    w = TensorFrame(spark.range(16).select(F.col("id").cast("int").alias("y"), (2 + F.col("id") % 4 / 4).alias("re"), F.lit(0.0).alias("im")), {"y": 16})
    op = gather.DensityCompensationOp(w) + Identity()
    return values(solvers.cg(op, image(spark, d), max_iterations=6, tolerance=1e-12), 4)


@query(f"WITH {IMAGE} SELECT y, x, round(2 * re, 6) AS re, round(2 * im, 6) AS im FROM img")
def operator_algebra(spark, d):
    a = structure.PadOrCropOp({"x": 16}, {"x": 24})
    op = 0.5 * (a.gram + a.gram) + a.H @ a
    return values(op(image(spark, d))[0])


@query("SELECT name, s FROM (VALUES ('norm', 4.0::DOUBLE)) t(name, s)")
def operator_norm(spark, d):
    w = TensorFrame(spark.range(16).select(F.col("id").cast("int").alias("y"), F.when(F.col("id") == 3, 4.0).otherwise(0.5).alias("re"), F.lit(0.0).alias("im")), {"y": 16})
    s = gather.DensityCompensationOp(w).operator_norm(image(spark, d), steps=8)
    return spark.createDataFrame([("norm", round(s, 3))], "name string, s double")


from lattica import queries_files, queries_fit, queries_fourier, queries_more  # noqa: E402, F401
