"""Queries through raw files: what a table holds is written by the sink and read back by the source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.queries import query, table
from lattica.sources import acquisitions, headers, rawdata
from lattica.workers import shared_folder


def _header(vendor: str) -> str:
    return headers.to_xml({"lamor_frequency_proton": 63.5e6, "vendor": vendor, "echo_train_length": 1, "tr": [0.01]})


def vector_readings(spark, d):
    """A reading a vector: two coils of 32 samples, the first and the last to be discarded; imaginary parts are
    the vector backwards. Vectors of label 0 are noise readings, those of label 1 calibration."""
    flags = F.when(F.col("label") == 0, acquisitions.FLAGS["noise"]).when(F.col("label") == 1, acquisitions.FLAGS["parallel_calibration"]).otherwise(0)
    return table(spark, d, "embeddings").select(
        F.pmod("vec_id", F.lit(4)).alias("dataset"), F.col("vec_id").alias("scan_counter"), flags.alias("flags"), F.pmod("vec_id", F.lit(97)).cast("int").alias("k1"),
        F.col("label").cast("int").alias("repetition"), F.lit(32).alias("number_of_samples"), F.lit(2).alias("active_channels"), F.lit(1).alias("discard_pre"), F.lit(1).alias("discard_post"),
        F.col("vec_id").alias("acquisition_time_stamp"), F.array(F.lit(2000.0), F.lit(0.0), F.col("label").cast("double")).alias("position"),
        F.col("embedding").alias("re"), F.reverse("embedding").alias("im"),
    )


def vector_files(spark, d) -> str:
    """The folder of raw files made of all vectors, a folder below it for each data set."""
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    rawdata.write_readings(vector_readings(spark, d), path, by="dataset", xml=_header("Siemens"))
    return path


@query("""SELECT vec_id AS scan_counter, coil, k0, (vec_id % 97)::INT AS k1, label::INT AS repetition, vec_id * 0.0025::DOUBLE AS seconds, label / 1000::DOUBLE AS position_x,
embedding[32 * coil + k0 + 2]::DOUBLE AS re, 0 - embedding[63 - 32 * coil - k0]::DOUBLE AS im
FROM embeddings, (SELECT unnest([0, 1])::INT AS coil), (SELECT unnest(range(30))::INT AS k0) WHERE label > 1""")
def raw_file_image_readings(spark, d):
    """Image readings of raw files as samples of coils: trimmed, in s and m, conjugated back as the vendor asks."""
    path = vector_files(spark, d)
    lines = acquisitions.coil_lines(rawdata.readings(spark, path), headers.headers(rawdata.headers_xml(spark, path)))
    samples = lines.select("scan_counter", "coil", "k1", "repetition", "acquisition_time_stamp", "position", F.posexplode(F.arrays_zip("re", "im")).alias("k0", "v"))
    return samples.select(
        "scan_counter", "coil", "k0", "k1", "repetition", F.round("acquisition_time_stamp", 6).alias("seconds"), F.round(F.col("position")[2], 6).alias("position_x"),
        F.col("v.re").alias("re"), F.col("v.im").alias("im"),
    )


@query("""SELECT vec_id % 4 AS dataset, count(*) AS readings, min(vec_id % 97)::INT AS k1_min, max(vec_id % 97)::INT AS k1_max
FROM embeddings WHERE label = 0 AND vec_id % 97 BETWEEN 10 AND 60 GROUP BY 1""")
def raw_file_noise_headers(spark, d):
    """Headers of noise readings in a range of phase encodings: decided before samples are read, which are not."""
    keep = [("is_noise", "=", True), ("k1", ">=", 10), ("k1", "<=", 60)]
    found = rawdata.readings(spark, vector_files(spark, d), keep, samples=False)
    return found.groupBy(F.element_at(F.split("file", "/"), -2).cast("long").alias("dataset")).agg(F.count("*").alias("readings"), F.min("k1").alias("k1_min"), F.max("k1").alias("k1_max"))
