"""Blocks of dense ids, their dependency matrix, and coarsening."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.ranking import div
from gridloom.session import stored

SMALL_BLOCKS, DEPENDENCY_BLOCKS = 64, 256


def small_size(rows: int, workers: int, per_worker: int = SMALL_BLOCKS) -> int:
    """Rows of a small block: about 64 blocks a worker, one block alone if there are fewer rows."""
    return rows // (per_worker * workers) if rows >= per_worker * workers else rows


def dependency_size(rows: int, workers: int, previous: int = 0, per_worker: int = DEPENDENCY_BLOCKS) -> int:
    """Rows of a dependency block: about 256 blocks a worker; one block alone if there are fewer rows, or fewer than 32 times the size in use before."""
    return rows // (per_worker * workers) if rows >= per_worker * workers and rows >= 32 * previous else rows


def block_of(id_: Column, size: int) -> Column:
    """0-based block of a 1-based id."""
    return div((id_ - 1).cast("long"), size)


def ranges(ids: DataFrame, size: int) -> DataFrame:
    """(blk, beg, end_): the ids of each block, both ends included."""
    return ids.groupBy(block_of(F.col("id"), size).alias("blk")).agg(F.min("id").alias("beg"), F.max("id").alias("end_"))


def big_ranges(ids: DataFrame, rows: int, workers: int) -> DataFrame:
    """(blk, beg, end_) of one block a worker; the last takes the rest."""
    size = max(1, rows // workers)
    blk = F.least(block_of(F.col("id"), size), F.lit(workers - 1).cast("long"))
    return ids.groupBy(blk.alias("blk")).agg(F.min("id").alias("beg"), F.max("id").alias("end_"))


def interleaved(ids: DataFrame, rows: int, workers: int, factor: int = 0, size: int = 0) -> DataFrame:
    """(id, slice, owner): slices of ids dealt to the workers in turn, the last one up to the end.

    Either `factor` slices a worker, of rows / (factor * workers) ids each, a size that need
    not be whole; or slices of `size` ids. Where that leaves a worker without a slice, each
    gets one. Empty slices are not dealt.
    """
    if not factor and size:
        factor, length = rows // (size * workers), Fraction(size)
    else:
        length = Fraction(rows, max(1, factor * workers))
    if not factor:
        factor, length = 1, Fraction(rows, workers)
    # Slice k ends at floor((k + 1) * length), so an id is in the slice before the least k that reaches it.
    top, bottom = length.numerator, length.denominator
    piece = F.least(div(F.col("id") * bottom + (top - 1), top) - 1, F.lit(factor * workers - 1).cast("long"))
    turn = piece if length >= 1 else F.col("id") - 1
    return ids.select("id", piece.alias("slice"), (turn % workers).alias("owner"))


def dependency_matrix(links: DataFrame, size: int, dep_size: int) -> DataFrame:
    """(blk, dep): which blocks of nodes each block of elements touches."""
    return links.select(block_of(F.col("elem"), size).alias("blk"), block_of(F.col("node"), dep_size).alias("dep")).distinct()


def added(matrix: DataFrame, pairs: DataFrame, size: int, dep_size: int) -> DataFrame:
    """matrix with the blocks of further (elem, node) pairs."""
    return matrix.union(dependency_matrix(pairs, size, dep_size)).distinct()


def added_fast(matrix: DataFrame, groups: DataFrame, size: int, dep_size: int) -> DataFrame:
    """matrix with every element of a row's array `elems` linked to every node of its array `nodes`."""
    pairs = groups.select(F.explode("elems").alias("elem"), "nodes").select("elem", F.explode("nodes").alias("node"))
    return added(matrix, pairs, size, dep_size)


def counted(matrix: DataFrame, pairs: DataFrame, rows: int, nodes: int, size: int, dep_size: int) -> DataFrame:
    """(elem, node, n): for each pair the dependencies of its block once all pairs are added, 0 if an id is out of range."""
    inside = F.col("elem").between(1, rows) & F.col("node").between(1, nodes)
    held = added(matrix, pairs.where(inside), size, dep_size).groupBy("blk").agg(F.count("*").alias("n"))
    marked = pairs.withColumn("blk", F.when(inside, block_of(F.col("elem"), size)))
    return marked.join(held, "blk", "left").select("elem", "node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dependency_stats(matrix: DataFrame, blocks: int, deps: int) -> DataFrame:
    """(avg_pct, max_pct) of the dependency blocks that a block touches."""
    counts = matrix.groupBy("blk").agg(F.count("*").alias("n"))
    return counts.agg((F.sum("n") * 100.0 / (float(blocks) * deps)).alias("avg_pct"), (F.max("n") * 100.0 / float(deps)).alias("max_pct"))


def collisions(matrix: DataFrame) -> DataFrame:
    """(b1, b2) with b1 < b2: blocks that share a dependency block."""
    one, two = matrix.withColumnRenamed("blk", "b1"), matrix.withColumnRenamed("blk", "b2")
    return one.join(two, "dep").where("b1 < b2").select("b1", "b2").distinct()


def block_order(matrix: DataFrame) -> DataFrame:
    """(blk, n, pos): blocks by falling number of dependencies. One row a block passes through the window."""
    counts = matrix.groupBy("blk").agg(F.count("*").alias("n"))
    return counts.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "blk")).cast("long"))


def halved(matrix: DataFrame, column: str) -> DataFrame:
    """matrix with pairs of neighbouring blocks (column blk) or dependency blocks (dep) merged."""
    other = "dep" if column == "blk" else "blk"
    return matrix.select(div(F.col(column), 2).alias(column), other).distinct().select("blk", "dep")


def halved_while(matrix: DataFrame, column: str, measure: Callable[[DataFrame], float]) -> tuple[DataFrame, int]:
    """(matrix, halvings): blocks are halved as long as the measure, a time for instance, falls and two are left."""
    least, times = measure(matrix), 0
    while matrix.select(column).distinct().count() > 1:
        coarser = stored(halved(matrix, column), "halved")
        found = measure(coarser)
        if found >= least:
            break
        matrix, least, times = coarser, found, times + 1
    return matrix, times


def bit_algebra(matrix: DataFrame, a: int, b: int) -> DataFrame:
    """(op, dep): dependency sets of blocks a and b: their intersection, union and difference."""
    one, two = matrix.where(F.col("blk") == a).select("dep"), matrix.where(F.col("blk") == b).select("dep")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "dep")
    return tag(one.intersect(two), "and").union(tag(one.union(two).distinct(), "or")).union(tag(one.exceptAll(two), "sub"))


def adaptive_split(weights: DataFrame, workers: int) -> DataFrame:
    """(part, beg, end_): blocks (blk, weight) re-split so that each part's running weight is about equal.

    One row a block passes through the window.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    before = F.coalesce(F.sum("weight").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.least(F.floor(F.col("before") * workers / F.col("total")), F.lit(workers - 1)).cast("long")
    return weights.withColumn("before", before).crossJoin(F.broadcast(total)).groupBy(part.alias("part")).agg(F.min("blk").alias("beg"), F.max("blk").alias("end_"))


def static_schedule(matrix: list[tuple[int, int]], workers: int, per_group: int = 8) -> list[tuple[int, int, int]]:
    """(blk, group, worker): groups in which blocks of different workers share no dependency.

    Greedy over the collected block matrix, whose size the block counts bound. Blocks of
    one worker may share dependencies: they run one after the other.
    """
    deps: dict[int, int] = {}
    for blk, dep in matrix:
        deps[blk] = deps.get(blk, 0) | 1 << dep
    waiting, out, group = sorted(deps), [], 0
    while waiting:
        held, taken, grew = [0] * workers, [0] * workers, True
        while grew:
            grew = False
            for w in range(workers):
                others = 0
                for v in range(workers):
                    others |= held[v] if v != w else 0
                fits = [b for b in waiting if not deps[b] & others][: per_group - taken[w]]
                for b in fits:
                    held[w] |= deps[b]
                    out.append((b, group, w))
                taken[w] += len(fits)
                if fits:
                    grew, gone = True, set(fits)
                    waiting = [b for b in waiting if b not in gone]
        group += 1
    return out
