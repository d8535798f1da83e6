"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder: ``spark.checkpoint.dir``, a temporary one only where that is absent and Spark runs in one process."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quire.shared.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("quire.shared.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: lineage and plan end there."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, as Spark's own readers see it; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
