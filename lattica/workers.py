"""What workers share with the driver: this library, where they share its file system (clusters that do
not get it with --py-files), and a folder."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> None:
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in path:
        env["PYTHONPATH"] = os.pathsep.join([*path, root])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs in one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_lattica_shared", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import atexit
    import shutil
    import tempfile

    sc._lattica_shared = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, sc._lattica_shared, ignore_errors=True)
    return sc._lattica_shared


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of `kept` that nothing still to be computed reads."""
    path = getattr(df, "_lattica_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def numbered_in_order(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a column: within ranges side by side, then by the ranges' counts."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = kept(df.repartitionByRange(ranges, by).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__range").count()  # a row a range
    before = counts.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return parts.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__range", "__own", "__before")
