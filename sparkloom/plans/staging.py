"""Tables written to the folder that driver and executors share, read back without lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        sc = spark.sparkContext
        found = getattr(sc, "_sparkloom_shared", None)
        if found is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = sc._sparkloom_shared = "file://" + tempfile.mkdtemp(prefix="sparkloom-shared-")
    return found.rstrip("/")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path is of; an existing one is replaced."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
