"""Helpers that the text operators share: tables in the shared folder and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's spark.checkpoint.dir.

    A local session that names none (tests) gets a folder of its own; on a cluster that is
    an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.conf.get("gridloom.checkpoint.dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="gridloom-checkpoint-")
            spark.conf.set("gridloom.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there.

    Unlike a cached or locally checkpointed frame, the files outlive any executor. They
    are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = place
    return found


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again; other frames are left alone."""
    place = getattr(df, "_stored_at", None)
    if place is not None:
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores put in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Return the memory that a worker no longer uses to the system: Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not this C library
        pass


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """df.mapInArrow with a function of one batch; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        give_back()

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as no bytes."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blank_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))
