"""What the operators of this subpackage share: shipping code to executors and the shared staging folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.shipping import ship
from sparkloom.plans.staging import shared_dir

#: White space as the operators split words: \x20 and \x09-\x0D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
#: The same for Java regular expressions in Spark SQL.
WORD_SQL = "[^\\\\x20\\\\x09-\\\\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, spark: SparkSession | None = None, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, no lineage to recompute, survives lost executors."""
    spark = spark or df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete what stage() wrote for df; df can't be used afterwards."""
    path = getattr(df, "_sparkloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
