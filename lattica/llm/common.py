"""What the training-data operators share: table access, word rules, shared-folder tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = str.maketrans(UPPER, LOWER)

#: Rows in an Arrow batch: long texts make thousands of rows too large for a Python worker.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """For operators that run Python: small Arrow batches (a smaller size set by the user stays), and
    this library's folder on the workers' path where they share the driver's file system. Clusters
    that do not get the library with --py-files."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864", "64MB", "9223372036854775807"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in path:
        env["PYTHONPATH"] = os.pathsep.join([*path, root])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.filter(F.split(trimmed, SPACE_CLASS + "+"), lambda w: w != "")


def once(value: Column) -> Column:
    """The same value, which filters above are not pushed through: the optimizer would write whole
    chains of array expressions out in them, once for each use."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def running(values: str, step: str = "{a} + {b}", chunk: int = 256) -> str:
    """SQL of the running sum (or other step from 0) before each of an array of int, in chunks, as
    each step of an aggregate copies what it has gathered."""
    gather = "aggregate({of}, named_struct('t', 0, 'd', cast(array() as array<int>)), (a, x) -> named_struct('t', {step}, 'd', a.d || array(a.t)){end})"
    parts = f"transform(sequence(0, (size({values}) - 1) div {chunk}), k -> slice({values}, k * {chunk} + 1, {chunk}))"
    inner = f"transform({parts}, c -> {gather.format(of='c', step=step.format(a='a.t', b='x'), end='')})"
    outer = gather.format(of="v", step=step.format(a="a.t", b="x.t"), end=", a -> a.d")
    return f"transform(array({inner}), v -> transform(array({outer}), o -> flatten(transform(v, (c, i) -> transform(c.d, x -> {step.format(a='get(o, i)', b='x')}))))[0])[0]"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and all runs in one
    machine (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_lattica_dir", None)
    if own is None:
        own = spark.sparkContext._lattica_dir = "file://" + tempfile.mkdtemp(prefix="lattica-")
        atexit.register(_remove, own)
    return own


def _remove(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there and a lost
    executor costs nothing. What is not discarded the caller's cluster clears with its job."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `written` that no table still to be computed reads."""
    path = getattr(df, "_lattica_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
