"""Public data sets of k-space arrays in HDF5, read line by line through `rawdata.array`.

Files stay where they are; a task reads a bounded range of slices. What depends on a whole file (the
padding, the repetition) is a small aggregate or a part of its name, joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources import headers, rawdata

#: Fixed values of the low-field data set: first phase encoding, matrix and field of view (z, y, x in m) of all files.
M4_FIRST, M4_MATRIX, M4_FOV = 30, (1, 256, 256), (0.005, 0.24, 0.24)
M4_NAME = r"(\d+_(?:FLAIR|T1|T2|GRE))(\d+)\.h5$"


def _samples(lines: DataFrame, *names: str) -> DataFrame:
    """A row a sample: the leading axes by name, and the place on the last axis."""
    at = [F.col("at")[k].cast("int").alias(n) for k, n in enumerate(names)]
    spread = lines.select("file", *at, "start", F.posexplode(F.arrays_zip("re", "im")).alias("p", "v"))
    return spread.select("file", *names, (F.col("start") + F.col("p")).cast("int").alias("last"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def fastmri_kspace(spark: SparkSession, path: str) -> DataFrame:
    """(file, slice, coil, k1, k0, re, im) of all files below a folder whose data set `kspace` is (slices, coils,
    k0, k1). Zero padding along k1 goes: what lies outside the values of the first line of the first
    slice and coil; k1 keeps its number in the padded array."""
    lines = rawdata.array(spark, path, "kspace").where(F.size("at") == 3)
    first = _samples(lines.where((F.col("at")[0] == 0) & (F.col("at")[1] == 0) & (F.col("at")[2] == 0)), "slice", "coil", "k0")
    inside = first.where("re * re + im * im > 1e-24").groupBy("file").agg(F.min("last").alias("lo"), F.max("last").alias("hi"))  # a row a file
    low = F.greatest(F.lit(0), F.col("lo") - F.col("start")).cast("int")
    size = (F.least(F.col("start") + F.size("re") - 1, F.col("hi")) - F.col("start") + 1).cast("int") - low
    cut = lines.join(inside, "file").where((F.col("start") <= F.col("hi")) & (F.col("start") + F.size("re") > F.col("lo")))
    cut = cut.select("file", "at", (F.col("start") + low).alias("start"), *(F.slice(c, low + 1, size).alias(c) for c in ("re", "im")))
    return _samples(cut, "slice", "coil", "k0").select("file", "slice", "coil", F.col("last").alias("k1"), "k0", "re", "im")


def fastmri_trajectory(kspace: DataFrame) -> DataFrame:
    """(file, k1, k0, kz, ky, kx): Cartesian, centered on the middle of what is left of each file."""
    size = kspace.groupBy("file").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), (F.max("k0") + 1).alias("n"))
    places = kspace.where("slice = 0 and coil = 0").select("file", "k1", "k0").join(size, "file")
    center = F.col("lo") + F.expr("(hi - lo + 1) div 2")
    return places.select("file", "k1", "k0", F.lit(0.0).alias("kz"), (F.col("k1") - center).cast("double").alias("ky"), (F.col("k0") - F.expr("n div 2")).cast("double").alias("kx"))


def fastmri_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header of each file, as columns."""
    return headers.headers(rawdata.headers_xml(spark, path, "ismrmrd_header"))


def m4raw_kspace(spark: SparkSession, path: str) -> DataFrame:
    """(scan, repetition, slice, coil, k1, k0, re, im) of files named <subject>_<contrast><repetition>.h5 whose data
    set `kspace` is (slices, coils, k0, k1); others are passed over. Repetitions are numbered by name."""
    lines = rawdata.array(spark, path, "kspace").where(F.col("file").rlike(r"/" + M4_NAME))
    name = F.element_at(F.split("file", "/"), -1)
    named = lines.select("*", F.regexp_extract(name, M4_NAME, 1).alias("scan"), F.regexp_extract(name, M4_NAME, 2).alias("turn"))
    turns = named.select("scan", "file", "turn").distinct()
    number = turns.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("turn", "file"))).alias("f")).select("scan", F.posexplode("f").alias("repetition", "f")).select("repetition", F.col("f.file").alias("file"), "scan")
    rows = _samples(lines, "slice", "coil", "k0").join(number, "file")
    return rows.select("scan", "repetition", "slice", "coil", (F.col("last") + M4_FIRST).alias("k1"), "k0", "re", "im")
