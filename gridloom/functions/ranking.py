"""Global ranks and running sums without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient of non-negative longs, without a detour over doubles."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def ranked(df: DataFrame, order: list[Column], name: str = "new_id", ranges: int = 0) -> DataFrame:
    """df with its 1-based rank by `order`; ranges: how many, as the session has it if 0.

    Rows go to ranges of the whole order, whose ends Spark samples, so clustered or skewed
    keys spread as evenly as others; a row's place in its sorted range, plus the sizes of
    the ranges before, is its rank. The sorted ranges are stored once: a lost task cannot
    cut them anew. Only the ranges' sizes pass through one task.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    rows = stored(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # one row a range
    inner = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + inner + 1).cast("long")).drop("__at", "__part", "__before")


def unsigned(key: Column) -> Column:
    """A sort key that orders longs as unsigned numbers."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def running_before(df: DataFrame, key: str, value: Column, name: str, width: int = 1 << 16) -> DataFrame:
    """df with the sum of `value` over all rows of a smaller key (a dense long)."""
    rows = df.withColumn("__value", value).withColumn("__bucket", div(F.col(key), width))
    sums = rows.groupBy("__bucket").agg(F.sum("__value").alias("__sum"))
    prior = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__bucket", prior("__sum").alias("__before"))
    inner = F.coalesce(F.sum("__value").over(Window.partitionBy("__bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inner", inner).join(offsets, "__bucket").withColumn(name, (F.col("__before") + F.col("__inner")).cast("long")).drop("__value", "__bucket", "__before", "__inner")
