"""Removal of lines that many documents share, by a sharded minimal perfect hash."""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, pick, raw_texts, stored

SHARD_KEYS = 1 << 18
MOST_COUNT = 2**16 - 1
BROADCAST_BYTES = 64 << 20
#: Distinct texts for one salt of the routed way, and the most salts.
SALT_TEXTS, MOST_SALTS = 50_000, 4096


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: ASCII white space and letters only


def distinct_keys(text: bytes) -> set[bytes]:
    """The text's line keys that have any character."""
    return {k for line in text.split(b"\n") if (k := line_key(line))}


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Two signed longs for each key: its 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.int64).reshape(-1, 2)


def _mixed(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of distinct longs: per level, the places that one key alone hits.

    About three bits a key. A long that is no key gives any place or -1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, n = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            size = -(-max(64, len(keys)) // 64) * 64
            at = _mixed(keys, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(rest):
                break
            at = _mixed(keys[rest], level, len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = (bits[word] >> bit) & np.uint64(1) == 1
            under = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[held]] = (self.before[level][word] + np.bitwise_count(under))[held]
            rest = rest[~held]
        return out


def _print(hashes: np.ndarray) -> np.ndarray:
    return hashes[:, 1].astype(np.uint64).astype(np.uint32)


class CountIndex:
    """One shard: perfect hash of the first long of each line hash, with arrays of fingerprints and counts.

    A fingerprint is half of the second long, a count has two bytes and stops at MOST_COUNT.
    Lines of the table that was counted are all in its index, so what they find is exact; a
    line from elsewhere passes for one in it with a chance of 2**-32.
    """

    def __init__(self, places: PerfectHash, prints: np.ndarray, counts: np.ndarray, spare: np.ndarray):
        self.places, self.prints, self.counts, self.spare = places, prints, counts, spare

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> CountIndex:
        first = np.unique(hashes[:, 0], return_index=True)[1]
        aside = np.setdiff1d(np.arange(len(hashes)), first)  # lines that share a first long with another: next to none
        spare = np.column_stack([hashes[aside], counts[aside]])
        hashes, counts = hashes[first], counts[first]
        places = PerfectHash.build(hashes[:, 0].copy())
        at = places(hashes[:, 0])
        prints, held = np.empty(len(at), np.uint32), np.empty(len(at), np.uint16)
        prints[at], held[at] = _print(hashes), np.minimum(counts, MOST_COUNT)
        return cls(places, prints, held, spare)

    def counts_of(self, hashes: np.ndarray) -> np.ndarray:
        """Documents that have each line; 0 for lines outside the index."""
        if not len(self.prints):
            return np.zeros(len(hashes), np.int64)
        at = self.places(hashes[:, 0])
        out = np.where((at >= 0) & (self.prints[at] == _print(hashes)), self.counts[at], 0).astype(np.int64)
        for h0, h1, n in self.spare:
            out[(hashes[:, 0] == h0) & (hashes[:, 1] == h1)] = n
        return out

    def dumped(self) -> bytes:
        np.savez(to := io.BytesIO(), prints=self.prints, counts=self.counts, spare=self.spare, **{f"level{i}": x for i, x in enumerate(self.places.levels)})
        return to.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> CountIndex:
        with np.load(io.BytesIO(data)) as z:
            return cls(PerfectHash([z[f"level{i}"] for i in range(len(z.files) - 3)]), z["prints"], z["counts"], z["spare"])


def line_counts(texts: DataFrame) -> DataFrame:
    """Rows (h0, h1, n): in how many documents (rows) each non-empty line key occurs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[bytes] = Counter()
        for text in raw_texts(batch.column(0)):
            found.update(distinct_keys(text))
        h = key_hashes(list(found))
        return pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(found.values()), pa.int64())], names=["h0", "h1", "n"])

    return by_batch(texts, run, "h0 long, h1 long, n long").groupBy("h0", "h1").agg(F.sum("n").alias("n"))


def build_index(texts: DataFrame) -> tuple[DataFrame, int]:
    """Stored rows (shard, data): the index of all distinct lines; number of shards.

    The shards follow the number of lines, so each holds about 260,000 keys at most.
    """
    counts = stored(line_counts(texts), "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        h = np.stack([table.column(c).to_numpy() for c in ("h0", "h1")], axis=1)
        shard = int(table.column("shard")[0].as_py())
        return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([CountIndex.build(h, table.column("n").to_numpy()).dumped()], pa.binary())})

    placed = counts.withColumn("shard", F.pmod("h0", F.lit(shards)).cast("int"))
    return stored(placed.groupBy("shard").applyInArrow(build, "shard int, data binary"), "line-index"), shards


def _rewritten(text: bytes, drop: list[bool] | np.ndarray) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [line for line, d in zip(lines, drop) if not d]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _lines_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    keys, ends = [], []
    for text in texts:
        keys += map(line_key, text.split(b"\n"))
        ends.append(len(keys))
    return keys, np.array(ends, np.int64)


def _finished(batch: pa.RecordBatch, at: int, drops: list[np.ndarray]) -> pa.RecordBatch:
    """batch with its text rewritten, and the numbers of lines before and of dropped ones."""
    done = [_rewritten(t, d) for t, d in zip(raw_texts(batch.column(at)), drops)]
    columns = list(batch.columns)
    columns[at] = pa.array([x[0].decode() for x in done], pa.string())
    counts = [pa.array([x[i] for x in done], pa.int64()) for i in (1, 2)]
    return pa.record_batch([*columns, *counts], names=[f"c{i}" for i in range(len(columns) + 2)])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs without the lines that min_docs documents or more have, and two columns of counts.

    Lines end at \\n. They are compared without ASCII white space at their ends and with
    A-Z lower-cased; lines without other characters always stay. Each row is a document:
    repeated rows count each. A null text is one empty line and comes back empty. Columns
    of docs keep their values; should docs have columns of the counts' names, give others
    in `counts`. An empty table gives no rows.

    Document counts are aggregated by line hash; all distinct lines go into perfect-hash
    shards, which documents probe. An index of up to broadcast_bytes is sent
    to every executor. A larger one stays distributed: distinct line hashes are routed to
    their shard, and each shard's part of the stream is probed against its arrays alone.
    """
    spark, schema = docs.sparkSession, docs.schema
    if min_docs > MOST_COUNT:
        raise ValueError(f"counts stop at {MOST_COUNT}")
    index, shards = build_index(pick(docs, text=text_col))
    at = docs.columns.index(text_col)
    out = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)), f"c{len(schema)} long, c{len(schema) + 1} long"])
    names = [*docs.columns, *counts]
    size = index.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in index.collect()})
        loaded: dict[int, CountIndex] = {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not loaded:
                loaded.update((s, CountIndex.loaded(data)) for s, data in held.value.items())
            keys, ends = _lines_of(raw_texts(batch.column(at)))
            number: dict[bytes, int] = {}
            at_key = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
            h = key_hashes(list(number))
            often = np.zeros(len(h), bool)
            shard = h[:, 0] % shards
            for s, own in loaded.items():
                here = np.flatnonzero(shard == s) if shards > 1 else slice(None)
                often[here] = own.counts_of(h[here]) >= min_docs
            frequent = often[at_key]
            frequent &= np.fromiter(map(bool, keys), bool, len(keys))
            return _finished(batch, at, np.split(frequent, ends[:-1]))

        return by_batch(docs, run, out).toDF(*names)

    marks = _routed(pick(docs, text=text_col), index, shards, min_docs)
    keyed = docs.toDF(*[f"c{i}" for i in range(len(schema))]).withColumn("t0", F.xxhash64(f"c{at}")).withColumn("t1", F.sha2(F.coalesce(f"c{at}", F.lit("")), 256))
    joined = keyed.join(marks, ["t0", "t1"], "left").select(*[f"c{i}" for i in range(len(schema))], "dropped")

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        drops = []
        for text, dropped in zip(raw_texts(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
            keys, dropped = list(map(line_key, text.split(b"\n"))), set(dropped or ())
            drops.append(np.array([bool(k) and h in dropped for k, h in zip(keys, map(bytes, key_hashes(keys)))]))
        return _finished(batch.select(range(batch.num_columns - 1)), at, drops)

    return by_batch(joined, rewrite, out).toDF(*names)


def _routed(texts: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """Rows (t0, t1, dropped): for each distinct text, the hashes of its lines that the index has.

    Equal texts lose equal lines, so texts are merged first. The salt spreads a line that
    very many texts have over tasks, each with its copy of the shard; salts follow the
    number of texts.
    """
    distinct = stored(texts.select(F.xxhash64("text").alias("t0"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t1"), "text").dropDuplicates(["t0", "t1"]), "distinct-texts")
    salts = min(MOST_SALTS, 1 + distinct.count() // SALT_TEXTS)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, t0, t1 = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, text in zip(t0, t1, raw_texts(batch.column(2))):
            rows += [(a, b, *map(int, h)) for h in key_hashes(list(distinct_keys(text)))]
        rows = list(dict.fromkeys(rows))
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["t0", "t1", "h0", "h1"])

    probes = by_batch(distinct, hashed, "t0 long, t1 string, h0 long, h1 long").select(F.pmod("h0", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("t0", "t1"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), "t0", "t1", "h0", "h1")
    none = F.lit(None)
    heads = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "data", none.cast("long").alias("t0"), none.cast("string").alias("t1"), none.cast("long").alias("h0"), none.cast("long").alias("h1"))
    stream = heads.union(probes).repartition(max(shards * salts, 8), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            cuts = [*np.flatnonzero(kind == 0), batch.num_rows]
            for a, b in zip([0, *(c + 1 for c in cuts[:-1])], cuts):
                if a and kind[a - 1] == 0:
                    own = CountIndex.loaded(batch.column(3)[int(a) - 1].as_py())
                part = batch.slice(int(a), int(b - a))
                if own is None or not part.num_rows:
                    continue
                h = np.stack([part.column(i).to_numpy() for i in (6, 7)], axis=1)
                hit = pa.array(own.counts_of(h) >= min_docs)
                yield pa.record_batch([part.column(4).filter(hit), part.column(5).filter(hit), pa.array([bytes(x) for x in h[hit.to_numpy(zero_copy_only=False)]], pa.binary())], names=["t0", "t1", "h"])

    return stream.mapInArrow(probe, "t0 long, t1 string, h binary").groupBy("t0", "t1").agg(F.collect_set("h").alias("dropped"))


def line_report(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256): what drop_frequent_lines does to each row."""
    done = drop_frequent_lines(pick(docs, doc_id=id_col, text=text_col), min_docs, "text", broadcast_bytes)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
