"""Loops whose body is an opaque procedure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def launch(rows: DataFrame, procedure: Callable[..., pa.RecordBatch], schema: str, *args: Any, slices: int = 0) -> DataFrame:
    """procedure(batch, *args) for every Arrow batch of rows; any number of arguments goes along.

    slices: deal the rows to so many contiguous ranges of column id first; 0 leaves them
    where they are, which costs no shuffle. What a body can say in column expressions is
    better left to select.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield procedure(batch, *args)

    return (rows.repartitionByRange(slices, "id") if slices else rows).mapInArrow(run, schema)


def concurrency(rows: DataFrame) -> int:
    """How many slices with rows a loop over `rows` runs: a figure of the run, no part of its result."""
    return rows.select(F.spark_partition_id().alias("slice")).distinct().count()
