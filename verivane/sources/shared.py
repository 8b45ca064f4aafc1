"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; one of our own only where it names none and all is on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def land(rows: DataFrame, by: Column, path: str, files: int) -> None:
    """Writes rows as files that a stream finds in the order of `by`: a range each, their times a second apart."""
    spark = rows.sparkSession
    rows.withColumn("_by", by).repartitionByRange(files, "_by").sortWithinPartitions("_by").drop("_by").write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    for k, f in enumerate(found):
        fs.setTimes(f.getPath(), f.getModificationTime() - 1000 * (len(found) - k), -1)
