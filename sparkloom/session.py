"""Session factory and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "sparkloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session as the engine expects it: UTC, ANSI arithmetic, adaptive execution with skew handling."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    from sparkloom.plans.shipping import ship

    spark = b.getOrCreate()
    ship(spark)
    return spark


class Tables:
    """Lazily read Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def spark_range(self, n: int) -> DataFrame:
        return self._spark.range(n)

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def folder(self) -> str:
        return self._folder

    def views(self) -> None:
        """Register every table as a temporary view."""
        for t in TABLES:
            getattr(self, t).createOrReplaceTempView(t)
