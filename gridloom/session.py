"""A small catalogue of entity tables with dense 1-based ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROWTH = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see.

    A local session without one gets a folder of its own; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='gridloom-')}")
        path = _own[0]
    return path.rstrip("/")


_own: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_report(df: DataFrame) -> DataFrame:
    """(n, lo, hi, distinct_ids, dense) of column id."""
    stats = df.agg(F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("distinct_ids"))
    return stats.withColumn("dense", (F.col("n") == 0) | (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("distinct_ids") == F.col("n")))


class MeshSession:
    """Registers, grows, lists and frees entity tables as temporary views."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._initial: dict[str, int] = {}

    def register(self, name: str, df: DataFrame) -> None:
        report = id_report(df).first()
        if not report["dense"]:
            raise ValueError(f"ids of {name} are not 1..{report['n']}")
        self._initial[name] = report["n"]
        df.createOrReplaceTempView(name)

    def resize(self, name: str, more: DataFrame) -> None:
        """Append rows whose ids go on where the table ends; at most twice the first size in all."""
        old = self.spark.table(name)
        size, grown = old.count(), id_report(more).first()
        if grown["n"] and (grown["lo"] != size + 1 or grown["hi"] != size + grown["n"] or grown["distinct_ids"] != grown["n"]):
            raise ValueError(f"ids of the new rows of {name} must be {size + 1}..{size + grown['n']}")
        if size + grown["n"] > GROWTH * self._initial[name]:
            raise ValueError(f"{name} may grow to {GROWTH * self._initial[name]} rows")
        old.unionByName(more).createOrReplaceTempView(name)

    def free(self, name: str) -> None:
        self._initial.pop(name)
        self.spark.catalog.dropTempView(name)

    def information(self) -> dict[str, int]:
        return {"workers": self.spark.sparkContext.defaultParallelism, "types": len(self._initial)}
