"""Uniform distribution of rows over shards of exact size, in DataFrame functions only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import blank_null, pick, stored

BLOCK_ROWS = 1 << 20
MOST_BLOCKS = 1024


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of `draws` rows taken without replacement are among the `good` ones.

    Inversion that walks outwards from the mode; its steps grow with the standard
    deviation, so it serves any population.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(ln(good, mode) + ln(bad, draws - mode) - ln(good + bad, draws))
    left, up, down, above, below = rng.random() - p, mode, mode, p, p
    while left > 0:
        moved = False
        if up < high and above > 0:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, left, moved = up + 1, left - above, True
            if left <= 0:
                return up
        if down > low and below > 0:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, left, moved = down - 1, left - below, True
            if left <= 0:
                return down
        if not moved:  # rounding left a rest
            return mode
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard in a uniform permutation.

    Row sums are `counts`, column sums are `sizes`; both add up to the same number.
    """
    rng, room, matrix = random.Random(seed), list(sizes), []
    for count in counts:
        row, left, rest = [], count, sum(room)
        for j, size in enumerate(room):
            rest -= size
            x = hypergeometric(size, rest, left, rng)
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def _running(values: list[int], start: int = 0) -> list[int]:
    out = []
    for v in values:
        start += v
        out.append(start)
    return out


def _passed(bounds: Column, rank: Column) -> Column:
    return F.size(F.filter(bounds, lambda x: x <= rank))


def uniform_shards(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): a uniform permutation dealt to shards.

    size: UTF-8 bytes of the text plus 1, 1 for null. text_crc32: 0 for null or empty.
    Shards differ by one row at most; slots are gapless from 0 in each. Rows go to blocks
    by a hash; the hypergeometric matrix says how many of a block go to each shard and
    range of slots; each block is put in random order and cut by its row of the matrix; and
    each range of slots is put in random order again. Only the block counts (at most 1,024)
    reach the driver. Equal rows are told apart by a running number, so any number of
    repeated rows or null ids is spread as evenly as other rows, and the result depends on
    the rows and the seed alone, not on how files were read. Other columns are ignored. An
    empty table gives no rows.
    """
    text = blank_null("text")
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    kinds = stored(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "sizes")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    blocks = min(MOST_BLOCKS, max(shards, -(-total // block_rows)))
    ranges = min(max(1, MOST_BLOCKS // shards), max(1, -(-total // (shards * block_rows))))
    same = ["doc_id", "size", "text_crc32", "copy"]
    mixed = lambda k: F.xxhash64(F.lit(seed + k), *same)
    dealt = kinds.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).withColumn("block", F.pmod(mixed(0), F.lit(blocks)).cast("int"))
    counts = dict(dealt.groupBy("block").agg(F.count("*").alias("n")).collect())
    sizes = _even(total, shards)
    fine = [x for size in sizes for x in _even(size, ranges)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], fine, seed)
    # Per block: where each shard's part of its order ends, and within it each range's.
    ends = [_running(row) for row in matrix]
    text_of = lambda row: ",".join(map(str, row))
    values = ", ".join(f"({b}, '{text_of(row[ranges - 1 :: ranges])}', '{text_of(row)}')" for b, row in enumerate(ends))
    cuts = docs.sparkSession.sql(f"select block, cast(split(s, ',') as array<bigint>) as shard_ends, cast(split(f, ',') as array<bigint>) as range_ends from values {values} as t(block, s, f)")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(mixed(1), *same)).cast("long") - 1
    cut = dealt.withColumn("rank", rank).join(F.broadcast(cuts), "block")  # at most 1,024 rows of 1,040 numbers
    cut = cut.withColumn("shard", _passed(F.col("shard_ends"), F.col("rank")))
    own = F.slice("range_ends", F.col("shard") * ranges + 1, ranges) if ranges > 1 else None
    cut = cut.withColumn("part", _passed(own, F.col("rank")) if ranges > 1 else F.lit(0))
    size = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    base = F.col("part") * F.floor(size / ranges) + F.least(F.col("part").cast("long"), size % ranges)
    slot = base + F.row_number().over(Window.partitionBy("shard", "part").orderBy(mixed(2), *same)) - 1
    return cut.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
