"""Engine settings and the session built from them."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import blocks


@dataclass(frozen=True)
class EngineConfig:
    """Tuning attributes. Zero workers: all cores. Block sizes of zero follow the default rules."""

    workers: int = 0
    small_block: int = 0
    dependency_block: int = 0
    interleaving_factor: int = 0
    interleaving_size: int = 0
    block_sorting: bool = False
    static_scheduling: bool = False
    adaptive_sizing: bool = True
    shuffle_partitions: int = 0

    def with_attribute(self, name: str, value: int | bool) -> EngineConfig:
        """One attribute changed; unknown names raise."""
        return replace(self, **{name: value})

    def threads(self) -> int:
        return self.workers or cores()

    def small_size(self, rows: int) -> int:
        return blocks.small_size(rows, self.threads(), self.small_block or blocks.SMALL_BLOCKS)

    def dependency_size(self, rows: int, previous: int = 0) -> int:
        return blocks.dependency_size(rows, self.threads(), previous, self.dependency_block or blocks.DEPENDENCY_BLOCKS)

    def interleaved(self, ids: DataFrame, rows: int) -> DataFrame:
        """Slices and owners of ids under the interleaving attributes; without any, one slice a worker."""
        return blocks.interleaved(ids, rows, self.threads(), self.interleaving_factor, self.interleaving_size)

    def scheduled(self, matrix: DataFrame) -> DataFrame:
        """Blocks (blk, grp, worker, pos) in the order of their launch.

        Static: conflict-free groups. Dynamic: one group, workers as Spark has them (null),
        blocks of many dependencies first if block_sorting says so.
        """
        spark = matrix.sparkSession
        if self.static_scheduling:
            plan = blocks.static_schedule([(r["blk"], r["dep"]) for r in matrix.collect()], self.threads())  # block counts bound it
            return spark.createDataFrame([(b, g, w, i + 1) for i, (b, g, w) in enumerate(plan)], "blk long, grp long, worker long, pos long")
        order = blocks.block_order(matrix) if self.block_sorting else blocks.block_order(matrix.select("blk", F.lit(0).alias("dep")).distinct())
        return order.select("blk", F.lit(0).cast("long").alias("grp"), F.lit(None).cast("long").alias("worker"), "pos")

    def spark_settings(self) -> dict[str, str]:
        adaptive = str(self.adaptive_sizing).lower()
        out = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": adaptive, "spark.sql.adaptive.skewJoin.enabled": adaptive}
        if self.shuffle_partitions:
            out["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        return out


def start(config: EngineConfig = EngineConfig(), master: str | None = None) -> SparkSession:
    """A session under the settings; without a master the number of workers decides."""
    cores = str(config.workers) if config.workers else "*"
    return SparkSession.builder.master(master or f"local[{cores}]").config(map=config.spark_settings()).getOrCreate()


def cores() -> int:
    return os.cpu_count() or 1


def wall_clock() -> float:
    return time.perf_counter()
