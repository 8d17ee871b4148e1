"""Acquisitions: readings as rows, filtered by flag bits, trimmed, sorted and regrouped.

`coil_lines` turns the readings of raw files (`rawdata.readings`) or of Parquet into lines of samples;
`read_binary` takes a decoder for any other format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.scalar import ticks_to_seconds
from lattica.operators.structure import SORT_LABELS, regroup

#: Flags of readings by name.
FLAGS = {
    "noise": 1 << 18,
    "parallel_calibration": 1 << 19,
    "parallel_calibration_and_imaging": 1 << 20,
    "reverse": 1 << 21,
    "navigation": 1 << 22,
    "phase_correction": 1 << 23,
    "hp_feedback": 1 << 25,
    "dummy": 1 << 26,
    "rt_feedback": 1 << 27,
    "surface_coil_correction": 1 << 28,
}
#: Fixed value: a reading with one of these bits is no image reading. Bits 2 to 5 belong to it as the
#: format's usual flag for phase stabilization is written as 60.
IGNORED = 785121340
#: The same with bit 29 of phase stabilization reference and bit 30 in their places.
IGNORED_CORRECTED = (IGNORED & ~60) | (1 << 30)


def has_any(flags: str | Column, mask: int) -> Column:
    c = F.col(flags) if isinstance(flags, str) else flags
    return c.bitwiseAND(F.lit(mask).cast("long")) != 0


def is_image(flags="flags", mask: int = IGNORED) -> Column:
    return ~has_any(flags, mask)


def is_noise(flags="flags") -> Column:
    return has_any(flags, FLAGS["noise"])


def is_coil_calibration(flags="flags") -> Column:
    return has_any(flags, FLAGS["parallel_calibration"] | FLAGS["parallel_calibration_and_imaging"])


def has_n_coils(n: int, data: str = "data") -> Column:
    return F.size(data) == n


def read(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """Readings that a predicate keeps (image readings by default); it reaches the Parquet scan as
    far as columns allow."""
    return spark.read.parquet(path).where(is_image() if keep is None else keep)


def read_binary(spark: SparkSession, path: str, decode: Callable, schema: str, suffix: str = "*.h5") -> DataFrame:
    """Files of any format, decoded one by one: decode(path, bytes) gives a pandas frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content):
                yield decode(p, bytes(c))

    return files.mapInPandas(run, schema)


def natural_key(name: str | Column) -> Column:
    """Sort key by the last number in a file name."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.regexp_extract(c, r"(\d+)\D*$", 1).try_cast("long"), F.lit(-1))


def trim(df: DataFrame, data: str = "data", pre: str = "discard_pre", post: str = "discard_post") -> DataFrame:
    """Drop the samples to discard at both ends of each line."""
    return df.withColumn(data, F.slice(data, F.col(pre) + 1, F.size(data) - F.col(pre) - F.col(post)))


def longest_only(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """Readings of the largest length of their data set: a small aggregate joined back."""
    most = df.groupBy(*by).agg(F.max(size).alias(size))
    return df.join(most, [*by, size], "left_semi")


def coil_lines(readings: DataFrame, headers: DataFrame | None = None, by: list[str] = ["file"]) -> DataFrame:  # noqa: B006
    """(by, acq_id, coil, labels, acquisition_time_stamp in s, position and patient_table_position in m, re, im) of
    readings of one number of coils and samples: that of the header's receiver channels, else the largest
    number of coils, then the largest number of samples after those to discard. headers (by, vendor, misc)
    decides about time stamps and conjugation; without it Siemens is assumed for time stamps, and nothing
    is conjugated."""
    samples = F.col("number_of_samples") - F.col("discard_pre") - F.col("discard_post")
    kinds = readings.groupBy(*by, "active_channels").agg(F.max(samples).alias("samples")).groupBy(*by).agg(F.collect_list(F.struct("active_channels", "samples")).alias("__kinds"))
    coils = F.array_max("__kinds")["active_channels"]
    if headers is not None:
        said = F.col("misc")["acquisitionSystemInformation/receiverChannels"].cast("int").alias("__said")
        kinds = kinds.join(headers.select(*by, F.lower("vendor").alias("__vendor"), said), by, "left")
        coils = F.when(F.size("__kinds") > 1, F.coalesce("__said", coils)).otherwise(coils)
    else:
        kinds = kinds.withColumn("__vendor", F.lit(None).cast("string"))
    kinds = kinds.withColumn("__coils", coils).select(*by, "__vendor", "__coils", F.array_max(F.filter("__kinds", lambda k: k["active_channels"] == F.col("__coils")))["samples"].alias("__samples"))
    own = readings.withColumn("samples", samples).join(kinds, by).where((F.col("active_channels") == F.col("__coils")) & (F.col("samples") == F.col("__samples")))
    labels = [c for c in ("k1", "k2", "average", "slice", "contrast", "phase", "repetition", "set", "segment", "flags", "center_sample", "sample_time_us", "scan_counter") if c in own.columns]
    meters = [F.transform(c, lambda v: v.cast("double") / 1000).alias(c) for c in ("position", "patient_table_position") if c in own.columns]
    step = F.when(F.col("__vendor") == "osi2", 0.001).otherwise(0.0025)
    line = lambda c, sign: F.transform(F.slice(c, F.col("coil") * F.col("number_of_samples") + F.col("discard_pre") + 1, F.col("samples")), lambda v: v.cast("double") * sign)
    conjugate = F.when(F.coalesce(F.col("__vendor") == "siemens", F.lit(False)), -1.0).otherwise(1.0)
    spread = own.withColumn("coil", F.explode(F.sequence(F.lit(0), F.col("__coils") - 1)))
    return spread.select(*by, "acq_id", "coil", *labels, (F.col("acquisition_time_stamp") * step).alias("acquisition_time_stamp"), *meters, line("re", F.lit(1.0)).alias("re"), line("im", conjugate).alias("im"))


def noise_lines(readings: DataFrame, by: list[str] = ["file"]) -> DataFrame:  # noqa: B006
    """(by, acq_id, coil, re, im) of noise readings: nothing is discarded."""
    n = F.col("number_of_samples")
    spread = readings.where(is_noise()).withColumn("coil", F.explode(F.sequence(F.lit(0), F.col("active_channels") - 1)))
    return spread.select(*by, "acq_id", "coil", *(F.transform(F.slice(c, F.col("coil") * n + 1, n), lambda v: v.cast("double")).alias(c) for c in ("re", "im")))


def to_readings(lines: DataFrame, by: list[str], vendor: str = "siemens") -> DataFrame:
    """Readings from coil lines (by, acq_id, coil, labels, re, im): coils behind each other, numbered in order of
    time, back in the vendor's ticks and m as mm. A group is one reading."""
    sign = -1.0 if vendor.lower() == "siemens" else 1.0
    tick = 0.001 if vendor.lower() == "osi2" else 0.0025
    known = [c for c in lines.columns if c not in (*by, "acq_id", "coil", "re", "im")]
    gathered = lines.groupBy(*by, "acq_id").agg(*(F.first(c).alias(c) for c in known), F.array_sort(F.collect_list(F.struct("coil", "re", "im"))).alias("__c"))
    flat = lambda part, s: F.flatten(F.transform("__c", lambda c: F.transform(c[part], lambda v: (v * s).cast("float"))))
    out = gathered.select(*by, "acq_id", *known, F.size("__c").alias("active_channels"), F.size("__c").alias("available_channels"), F.size(F.col("__c")[0]["re"]).alias("number_of_samples"), flat("re", 1.0).alias("re"), flat("im", sign).alias("im"))
    for c in ("position", "patient_table_position"):
        if c in known:
            out = out.withColumn(c, F.transform(c, lambda v: v * 1000))
    if "acquisition_time_stamp" in known:
        out = out.withColumn("acquisition_time_stamp", F.rint(F.col("acquisition_time_stamp") / tick).cast("long"))
    order = Window.partitionBy(*by).orderBy(*([c for c in ("acquisition_time_stamp",) if c in known] + ["acq_id"]))
    return out.withColumn("scan_counter", F.row_number().over(order) - 1)


def with_seconds(df: DataFrame, column: str, vendor: str) -> DataFrame:
    return df.withColumn(column, ticks_to_seconds(column, vendor))


def conjugated(df: DataFrame, vendor: str, im: str = "im") -> DataFrame:
    """Siemens readings come conjugated."""
    return df.withColumn(im, F.when(F.lower(vendor) == "siemens", -F.col(im)).otherwise(F.col(im)))


def reshaped(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sorted and numbered by the labels; see structure.regroup."""
    labels = [c for c in SORT_LABELS if c in df.columns]
    return regroup(df, [c for c in labels if c not in ("k1", "k2")], [c for c in ("k1", "k2") if c in labels], by)


def limits(df: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Least, largest and middle value and length of each counter."""
    aggs = []
    for c in counters:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), (F.max(c) - F.min(c) + 1).alias(f"{c}_length")]
    return df.groupBy(*by).agg(*aggs)


def k_center(df: DataFrame, by: list[str]) -> DataFrame:
    """Counters of the reading nearest to the middle of k-space."""
    near = F.abs("kz") + F.abs("ky") + F.abs("kx")
    best = F.min_by(F.struct("k1", "k2"), F.struct(near, "k1", "k2"))
    return df.groupBy(*by).agg(best.alias("c")).select(*by, F.col("c.k1").alias("k1_center"), F.col("c.k2").alias("k2_center"))


def write(df: DataFrame, path: str, by: str = "dataset") -> None:
    """Parquet by data set, rows numbered in order."""
    w = Window.partitionBy(by).orderBy(*(c for c in ("acquisition_time_stamp", "k2", "k1") if c in df.columns))
    df.withColumn("scan_counter", F.row_number().over(w) - 1).write.partitionBy(by).parquet(path)


def rescaled(value: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return value * slope + intercept


def parse_datetime(text: Column) -> Column:
    """YYYYMMDDHHMMSS[.f], with any offset cut off."""
    plain = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")
    return F.regexp_replace(plain, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\.\d+)?$", "$1-$2-$3 $4:$5:$6$7").cast("timestamp_ntz")
