"""Nearest neighbours by blocks: int8 product tiles with error bounds, heaps of candidates, exact scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, pick, stored

TILE_ROWS = 4096
#: Codes of queries that are sent to every executor at once.
GROUP_BYTES = 32 << 20


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows at length one, each row's step, and the length of its rounding error."""
    rows = scaled(rows)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(unit - codes * step[:, None], axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; floats hold them exactly and multiply faster."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision; sums run over components in order, so equal rows score equally."""
    query, rows = scaled(query[None, :])[0], scaled(rows)
    dot, length = np.zeros(len(rows)), np.zeros(len(rows))
    own = 0.0
    for j, q in enumerate(query):
        dot += rows[:, j] * q
        length += rows[:, j] * rows[:, j]
        own += q * q
    return dot / (np.sqrt(own) * np.sqrt(length))


class Codes:
    """A block of vectors as int8 codes with what bounds their products."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, codes: np.ndarray, step: np.ndarray, error: np.ndarray):
        self.rids, self.ids, self.codes, self.step, self.error = rids, ids, codes, step, error

    @classmethod
    def of(cls, row: dict) -> Codes:
        ids = np.frombuffer(row["ids"], np.int64)
        rids = row["block"] if isinstance(row["block"], np.ndarray) else row["block"] + np.arange(len(ids))
        return cls(rids, ids, np.frombuffer(row["codes"], np.int8).reshape(len(ids), -1), np.frombuffer(row["step"]), np.frombuffer(row["error"]))


def bounds(a: Codes, b: Codes, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of rows `part` of a with those of b."""
    near = _products(a.codes[part], b.codes) * a.step[part, None] * b.step
    # |x.y - x'.y'| <= |x - x'||y| + |x'||y - y'|, with |y| = 1 and |x'| <= 1 + |x - x'|.
    slack = a.error[part, None] + (1 + a.error[part, None]) * b.error + 1e-9
    return near - slack, near + slack


class Nearest:
    """For each query of a block, what may be among its k nearest: a heap of lower bounds sets the limit."""

    def __init__(self, queries: Codes, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[float]] = [[] for _ in queries.ids]
        self.limit = np.full(len(queries.ids), -np.inf)
        self.found: list[list[tuple[float, float, int]]] = [[] for _ in queries.ids]

    def _offer(self, i: int, low: float, high: float, rid: int) -> None:
        heap = self.heaps[i]
        if len(heap) < self.k:
            heapq.heappush(heap, low)
        elif low > heap[0]:
            heapq.heapreplace(heap, low)
        if len(heap) == self.k:
            self.limit[i] = heap[0]
        held = self.found[i]
        held.append((low, high, rid))
        if len(held) > 8 * self.k + 64:  # what the limit has passed by goes
            self.found[i] = [x for x in held if x[1] >= self.limit[i]]

    def tile(self, rows: Codes) -> None:
        for at in range(0, len(self.queries.ids), 256):
            part = slice(at, at + 256)
            low, high = bounds(self.queries, rows, part)
            other = self.queries.ids[part, None] != rows.ids
            if len(rows.ids) > self.k:  # a tile's own k best already limit what it offers
                best = np.partition(np.where(other, low, -np.inf), -self.k, axis=1)[:, -self.k]
                best = np.maximum(best, self.limit[part])
            else:
                best = self.limit[part]
            for i, j in np.argwhere((high >= best[:, None]) & other).tolist():
                if high[i, j] >= self.limit[at + i]:
                    self._offer(at + i, float(low[i, j]), float(high[i, j]), int(rows.rids[j]))

    def rows(self) -> list[tuple[int, int, float, float]]:
        return [(int(q), rid, low, high) for i, q in enumerate(self.queries.rids) for low, high, rid in self.found[i] if high >= self.limit[i]]


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows (block, dim, ids, codes, step, error, data): up to `rows` vectors of one length each, packed.

    block + i numbers the i-th vector. Blocks are cut as the rows are read, without a
    shuffle; the caller stores them, so that a lost task does not cut them anew.
    """
    names = ["dim", "ids", "codes", "step", "error", "data"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def full(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            parts = [ids, *quantised(data), data]
            return pa.record_batch([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                while len(at):
                    room = rows - sum(len(x[0]) for x in held.get(int(dim), []))
                    part, at = at[:room], at[room:]
                    held.setdefault(int(dim), []).append((ids[part], flat[starts[part, None] + np.arange(dim)]))
                    if len(part) == room:
                        yield full(int(dim))
        for dim in list(held):
            yield full(dim)

    packed = vectors.mapInArrow(pack, "dim int, ids binary, codes binary, step binary, error binary, data binary")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # blocks of a partition are few
    return packed.select((F.shiftleft(F.spark_partition_id().cast("long"), 40) + inside * rows).alias("block"), *names)


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & v.isNotNull() & good)


def _survivors(blocks: DataFrame, sent: Broadcast, dim: int, k: int) -> DataFrame:
    """Rows (q, c, low, high): what each part of the blocks offers to a group of queries. Codes alone are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            for row in batch.to_pylist():
                asked = asked or [Nearest(Codes.of(q), k) for q in sent.value]
                rows = Codes.of(row)
                for a in asked:
                    a.tile(rows)
        for a in asked or []:
            c = list(zip(*a.rows())) or [()] * 4
            yield pa.record_batch([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["q", "c", "low", "high"])

    own = blocks.where(F.col("dim") == dim).select("block", "ids", "codes", "step", "error")
    return own.mapInArrow(run, "q long, c long, low double, high double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Rows (q, c): survivors of all tasks whose upper bound reaches the k-th largest lower bound of their query.

    Heaps merge the stream of each query's task; a query holds its survivors alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[float]] = {}
        held: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, c, low, high in zip(*(x.to_pylist() for x in batch.columns)):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, low)
                elif low > heap[0]:
                    heapq.heapreplace(heap, low)
                if len(heap) < k or high >= heap[0]:
                    own = held.setdefault(q, [])
                    own.append((high, c))
                    if len(own) > 8 * k + 64 and len(heap) == k:
                        held[q] = [x for x in own if x[0] >= heap[0]]
        out = [(q, c) for q, own in held.items() for high, c in own if len(heaps[q]) < k or high >= heaps[q][0]]
        c = list(zip(*out)) or [()] * 2
        yield pa.record_batch([pa.array(x, pa.int64()) for x in c], names=["q", "c"])

    return found.repartition("q").mapInArrow(run, "q long, c long")


def _scored(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (q, query_id, vec_id, score): the pairs' cosines on the original vectors, which only they fetch."""
    wanted = pairs.select(F.col("q").alias("rid")).union(pairs.select(F.col("c").alias("rid"))).distinct()

    def unpack(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for row in batch.to_pylist():
            ids, width = np.frombuffer(row["ids"], np.int64), 8 * row["dim"]
            data = [row["data"][i : i + width] for i in range(0, len(row["data"]), width)]
            parts.append(pa.record_batch([pa.array(row["block"] + np.arange(len(ids))), pa.array(ids), pa.array(data, pa.binary())], names=["rid", "id", "v"]))
        return pa.Table.from_batches(parts)

    vectors = by_batch(blocks.select("block", "dim", "ids", "data"), unpack, "rid long, id long, v binary").join(wanted, "rid", "left_semi")
    vectors = stored(vectors, "wanted-vectors")
    a = vectors.select(F.col("rid").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("a"))
    b = vectors.select(F.col("rid").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("b"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [float(exact_cosine(np.frombuffer(x), np.frombuffer(y)[None, :])[0]) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        return pa.record_batch([*batch.columns[:3], pa.array(scores, pa.float64())], names=["q", "query_id", "vec_id", "score"])

    joined = pairs.join(a, "q").join(b, "c").select("q", "query_id", "vec_id", "a", "b")
    return by_batch(joined, score, "q long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 5, query_step: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = TILE_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest vectors by cosine of each query.

    Queries are the rows whose id is divisible by query_step; candidates are all rows of
    other ids, each for itself if an id repeats. A repeated query id gives k rows for each
    of its rows. Ties go to the smaller id. Vectors that are null, empty or zero or hold
    null or non-finite components, and rows without id, take no part; very large or small
    components do not overflow. Vectors are compared with those of their own length. Other
    columns are ignored. Fewer candidates than k: all of them. An empty table gives no rows.

    Vectors are packed once into blocks with int8 codes. Queries go out in groups of at most
    group_bytes of codes; each group is one scan over the candidates' codes, in which a task
    multiplies tile by tile and keeps, per query, only what the error bounds leave in doubt
    beside its k best. Heaps merge the tasks' survivors, and those alone fetch vectors.
    """
    spark = vectors.sparkSession
    usable = _usable(pick(vectors, id=id_col, vector=vector_col).select(F.col("id").cast("long"), F.col("vector").cast("array<double>")))
    blocks = stored(_blocks(usable, tile_rows), "vector-blocks")

    def ask(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for row in batch.to_pylist():
            codes = Codes.of(row)
            at = np.flatnonzero(codes.ids % query_step == 0)
            columns = [pa.array(np.full(len(at), row["dim"], np.int32)), pa.array(codes.rids[at]), pa.array(codes.ids[at]), pa.array([codes.codes[i].tobytes() for i in at], pa.binary()), pa.array(codes.step[at]), pa.array(codes.error[at])]
            parts.append(pa.record_batch(columns, names=["dim", "rid", "id", "code", "step", "error"]))
        return pa.Table.from_batches(parts)

    asked = stored(by_batch(blocks.select("block", "dim", "ids", "codes", "step", "error"), ask, "dim int, rid long, id long, code binary, step double, error double"), "queries")
    found = None
    for dim, n in sorted((r["dim"], r["n"]) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        groups = max(1, -(-n * (dim + 32) // group_bytes))
        for g in range(groups):
            rows = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rid"), F.lit(groups)) == g)).toArrow()  # about group_bytes
            own = [_query_block(rows.slice(i, tile_rows)) for i in range(0, rows.num_rows, tile_rows)]
            if own:
                part = _survivors(blocks, spark.sparkContext.broadcast(own), dim, k)
                found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scored = _scored(stored(_merged(found, k), "survivors"), blocks)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_block(rows: pa.Table) -> dict:
    """Query rows as a block; their row numbers need not follow each other."""
    column = lambda name: rows.column(name).to_numpy()
    return {"block": column("rid"), "ids": column("id").tobytes(), "codes": b"".join(rows.column("code").to_pylist()), "step": column("step").tobytes(), "error": column("error").tobytes()}
