"""Queries of Fourier transforms whose arrays and sample sets grow with the tables, and direct sums in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lattica.operators import gridding, wavelets
from lattica.queries import VECTORS, query, r, table, values, vector_frame
from lattica.tensor import TensorFrame

#: A sample a vector, off the grid.
_TRACK = "t AS (SELECT vec_id, embedding[2]::DOUBLE * 50 AS value, sin(vec_id * 0.7::DOUBLE) * 4.5 AS ky, cos(embedding[1]::DOUBLE * 90) * 30 AS kx FROM embeddings)"


def _size(df, column: str) -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def _track(spark, d):
    e = table(spark, d, "embeddings")
    entry = lambda k: F.col("embedding")[k].cast("double")
    track = e.select(F.col("vec_id").cast("int").alias("sample"), (entry(1) * 50).alias("value"), (F.sin(F.col("vec_id") * 0.7) * 4.5).alias("k_y"), (F.cos(entry(0) * 90) * 30).alias("k_x"))
    return track, {"sample": _size(e, "vec_id")}


def _label_image(spark, d) -> TensorFrame:
    """Mean vectors by label: 10 x 64."""
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("x", "v"))
    rows = long.groupBy(F.col("label").cast("int").alias("y"), "x").agg(F.avg(F.col("v").cast("double")).alias("re"))
    return TensorFrame(rows.withColumn("im", F.lit(0.0)), {"y": 10, "x": 64})


_PHASE = "2 * pi() * (ky * (y - 5) / 10 + kx * (x - 32) / 64)"


@query(f"""WITH {_TRACK}, i AS (SELECT label AS y, x, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(range(64)) AS x, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2)
SELECT vec_id AS sample, round(sum(v * cos({_PHASE})) / sqrt(640), 6) + 0.0 AS re, round(sum(0 - v * sin({_PHASE})) / sqrt(640), 6) + 0.0 AS im FROM t, i GROUP BY vec_id""")
def fourier_gridded(spark, d):
    """A sample a vector of the image of mean vectors."""
    track, samples = _track(spark, d)
    op = gridding.GriddedFourierOp({"y": 10, "x": 64}, track, samples, width=12)
    return op.forward(_label_image(spark, d)).df.select(F.col("sample").cast("long").alias("sample"), r("re").alias("re"), r("im").alias("im"))


@query(f"""WITH {_TRACK}, i AS (SELECT y, x FROM (SELECT unnest(range(10)) AS y), (SELECT unnest(range(64)) AS x))
SELECT y::INT AS y, x::INT AS x, round(sum(value * cos({_PHASE})) / sqrt(640), 4) + 0.0 AS re, round(sum(value * sin({_PHASE})) / sqrt(640), 4) + 0.0 AS im FROM t, i GROUP BY y, x""")
def fourier_gridded_adjoint(spark, d):
    """The image of all vectors' values, summed on the finer grid."""
    track, samples = _track(spark, d)
    values = TensorFrame(track.select("sample", F.col("value").alias("re"), F.lit(0.0).alias("im")), samples)
    op = gridding.GriddedFourierOp({"y": 10, "x": 64}, track.drop("value"), samples, width=12)
    return op.adjoint(values).df.select("y", "x", r("re", 4).alias("re"), r("im", 4).alias("im"))


@query("""WITH n AS (SELECT CAST(pow(2, ceil(log2(max(vec_id) + 1))) AS BIGINT) AS n FROM embeddings), k AS (SELECT unnest(range(n)) AS k, n FROM n),
p AS (SELECT k, n, embedding[1]::DOUBLE AS re, embedding[2]::DOUBLE AS im, 2 * pi() * (((k - n // 2) * (vec_id - n // 2)) % n) / n AS a FROM k, embeddings)
SELECT k::INT AS k, round(sum(re * cos(a) + im * sin(a)) / sqrt(max(n)), 6) + 0.0 AS re, round(sum(im * cos(a) - re * sin(a)) / sqrt(max(n)), 6) + 0.0 AS im FROM p GROUP BY k""")
def fourier_split_axis(spark, d):
    """The spectrum of the first two entries of all vectors as one complex line, padded to a power of two and
    transformed in four steps."""
    e = table(spark, d, "embeddings")
    n = 1 << max(2, math.ceil(math.log2(_size(e, "vec_id"))))
    entry = lambda k: F.col("embedding")[k].cast("double")
    x = TensorFrame(e.select(F.col("vec_id").cast("int").alias("k"), entry(0).alias("re"), entry(1).alias("im")), {"k": n})
    most = 1 << -(-n.bit_length() // 2)
    return gridding.SplitFourierOp(["k"], most=most).forward(x).df.select("k", r("re").alias("re"), r("im").alias("im"))


def _taps(name: str) -> str:
    """Both analysis filters as rows (band, j, c), band 1 the high one."""
    return ", ".join(f"({band}, {j}, {float(c)!r}::DOUBLE)" for band, taps in enumerate(wavelets.filters(name)[:2]) for j, c in enumerate(taps))


@query(f"""WITH {VECTORS}, f(band, j, c) AS (VALUES {_taps("db4")}), o AS (SELECT unnest(range({wavelets.size_of(64, "db4")})) AS o)
SELECT vec_id::INT AS y, (band * {wavelets.size_of(64, "db4")} + o)::INT AS coefficient, round(sum(c * v), 6) + 0.0 AS re, 0.0 AS im
FROM v JOIN f ON true JOIN o ON k = 2 * o + 1 - j GROUP BY vec_id, band, o""")
def wavelet_borders(spark, d):
    """Every vector in one level of db4 with zeros beyond its ends."""
    return values(wavelets.BorderWaveletOp({"x": 64}, "db4").forward(vector_frame(spark, d)), 6)
