"""Passages that start in an earlier document too: routing of candidate segments, shared by two operators.

Every window of WINDOW tokens has a key, the least hash of the grams inside it, so equal
windows have equal keys wherever they stand. Neighbouring windows mostly share a key, and
such a run of windows travels as one segment to the task of its key. Only keys that two
documents have are sent at all. What is found inside a task is the matcher's business.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, pick, raw_texts, stored

WINDOW, GRAM = 50, 20
#: A key of more documents than FULL_KEY is dealt by window, SALT_DOCS documents a salt.
FULL_KEY, SALT_DOCS = 1024, 64
_SIZE_BITS = 31
CHUNK_BYTES = 1 << 20
PART_ROWS = 20_000
#: Ids of two longs that are broadcast at most: 16 MB.
ID_ROWS = 1_000_000
#: A key is common if so many documents of a sample have it, which then has SAMPLE_DOCS documents about.
SAMPLE_DOCS, COMMON_DOCS = 20_000, 40
#: (segments, their groups, their documents) to (segment, first token, tokens) of every part that an
#: earlier document of the group has too, each at least WINDOW long.
Matcher = Callable[[list[bytes], list[int], list[int]], list[tuple[int, int, int]]]


class Bytes:
    """Texts as their UTF-8 bytes."""

    width = 1

    @staticmethod
    def tokens(text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    @staticmethod
    def kept(text: bytes, keep: np.ndarray) -> bytes:
        return np.frombuffer(text, np.uint8)[keep].tobytes()

    @staticmethod
    def whole(text: bytes) -> tuple[int, bytes]:
        return len(text), text


class Words:
    """Texts as words between ASCII white space, each by a 64-bit hash."""

    width = 8

    @staticmethod
    def tokens(text: bytes) -> np.ndarray:
        return np.array(list(map(xxhash.xxh3_64_intdigest, text.split())), np.uint64)

    @staticmethod
    def kept(text: bytes, keep: np.ndarray) -> bytes:
        return b" ".join([w for w, k in zip(text.split(), keep.tolist()) if k])

    @staticmethod
    def whole(text: bytes) -> tuple[int, bytes]:
        words = text.split()
        return len(words), b" ".join(words)


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` tokens: doubled in size, then two overlapping ones joined."""
    h, size = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    while size * 2 <= gram:
        h = h[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + h[size:]
        size *= 2
    if rest := gram - size:
        h = h[:-rest] * np.uint64(0xC2B2AE3D27D4EB4F) + h[rest:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def window_keys(tokens: np.ndarray) -> np.ndarray:
    """The key of each window: least hash of the GRAM-grams inside it."""
    if len(tokens) < WINDOW:
        return np.empty(0, np.uint64)
    h, span, wanted = gram_hashes(tokens, GRAM), 1, WINDOW - GRAM + 1
    while span * 2 <= wanted:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = wanted - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def meeting(tokens: np.ndarray, sizes: list[int], groups: list[int]) -> np.ndarray:
    """Which of several segments, laid end to end, hold a window that another place of their group may hold too.

    Windows are compared by a hash, so none that is held elsewhere is missed.
    """
    ends = np.cumsum(sizes)
    h = gram_hashes(tokens, WINDOW) if len(tokens) >= WINDOW else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    inside = np.arange(len(h)) + WINDOW <= ends[owner]
    h, owner = h[inside], owner[inside]
    h = h + np.array(groups, np.uint64)[owner] * np.uint64(0x9FB21C651E98DF25)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(sizes), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        out[owner[twice[at] == h]] = True
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of each run of equal keys."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.empty(0, np.int64)
    return keys[starts], starts, np.diff(np.append(starts, len(keys)))


def _narrowed(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on (d, rk): the ids are broadcast up to ID_ROWS rows of two longs, else joined by a shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= ID_ROWS else ids, ["d", "rk"], how)


def _measured(rows: DataFrame, kind: type) -> DataFrame:
    """Rows (d, rk, n, sha): number of tokens, and SHA-256 of the text with nothing removed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, shas = [], []
        for text in raw_texts(batch.column(2)):
            n, data = kind.whole(text)
            sizes.append(n)
            shas.append(hashlib.sha256(data).digest())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary())], names=["d", "rk", "n", "sha"])

    return by_batch(rows, run, "d long, rk long, n long, sha binary")


def _shared_keys(rows: DataFrame, kind: type) -> DataFrame:
    """Rows (d, shared): for each document its keys that another document has too, with the salts of each.

    A key of more than FULL_KEY documents gets a salt for every SALT_DOCS of them. Keys that
    a sample finds common never bring their documents into one task; whatever the sample
    says, the result is the same.
    """

    def keys(of: DataFrame, known: Broadcast | None = None, common: bool = False) -> DataFrame:
        """Rows (h, d): all keys, or those that are among the known ones (common) or are not."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, found = batch.column(0).to_numpy(), []
            for text in raw_texts(batch.column(1)):
                found.append(np.unique(window_keys(kind.tokens(text))))
            sizes = list(map(len, found))
            h, d = np.concatenate(found), np.repeat(ids, sizes)
            if known is not None:
                wanted = np.isin(h, known.value) == common
                h, d = h[wanted], d[wanted]
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(d)], names=["h", "d"])

        return by_batch(of.select("d", "text"), run, "h long, d long")

    share = max(1, rows.count() // SAMPLE_DOCS)
    sample = keys(rows.where(F.pmod(F.xxhash64("d"), F.lit(share)) == 0)) if share > 1 else keys(rows)
    often = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_DOCS)
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in often.select("h").collect()], np.int64).view(np.uint64)))  # the sample bounds it
    # Common keys are counted with partial sums and joined back by broadcast; only others meet by a window.
    same = Window.partitionBy("h")
    rare = keys(rows, known).select("h", "d", F.min("d").over(same).alias("lo"), F.max("d").over(same).alias("hi"), F.count("*").over(same).alias("n")).where("lo < hi")
    met = rare.select("h", "d", "n")
    if len(known.value):
        counts = keys(rows, known, True).groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        met = met.union(keys(rows, known, True).join(F.broadcast(counts), "h").select("h", "d", "n"))
    salts = F.when(F.col("n") > FULL_KEY, F.ceil(F.col("n") / SALT_DOCS)).otherwise(0).cast("int")
    return met.groupBy("d").agg(F.collect_list(F.struct("h", salts.alias("salts"))).alias("shared"))


SEGMENT = "h long, salt int, d long, rk long, start long, size long, seg binary"


def _segments(joined: DataFrame, kind: type) -> DataFrame:
    """Segments of the shared keys; without bytes where the batch itself holds the segment in an earlier document."""

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def made(out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out)) or [()] * 7
        return pa.record_batch([pa.array(np.array(c[0], np.uint64).view(np.int64)), *(pa.array(x, t) for x, t in zip(c[1:], kinds))], names=[f.split()[0] for f in SEGMENT.split(", ")])

    def run(batch: pa.RecordBatch) -> pa.Table:
        ids, rks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw_texts(batch.column(2))
        shared, first, out, done = batch.column(3), {}, [], []
        lists = shared.flatten()
        h_all, salts_all = lists.field(0).to_numpy().view(np.uint64), lists.field(1).to_numpy()
        ends = np.cumsum(shared.value_lengths().to_numpy())
        for i in np.argsort(ids, kind="stable"):
            if len(out) >= PART_ROWS:
                done.append(made(out))
                out = []
            a, b = int(ends[i - 1]) if i else 0, int(ends[i])
            order = np.argsort(h_all[a:b])
            own, salts = h_all[a:b][order], salts_all[a:b][order]
            tokens = kind.tokens(texts[i])
            h, starts, counts = runs(window_keys(tokens))
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            data, w, d, rk = tokens.tobytes(), kind.width, int(ids[i]), int(rks[i])
            for j in np.flatnonzero(own[at] == h):
                key, start, count, m = int(h[j]), int(starts[j]), int(counts[j]), int(salts[at[j]])
                # Under a full key each window goes alone, salted by what it holds.
                for s, n in [(start + x, 1) for x in range(count)] if m else [(start, count)]:
                    seg, size = data[s * w : (s + n + WINDOW - 1) * w], n + WINDOW - 1
                    if first.setdefault(xxhash.xxh3_128_digest(key.to_bytes(8) + seg), d) == d:
                        out.append((key, 1 + xxhash.xxh3_64_intdigest(seg) % m if m else 0, d, rk, s, size, seg))
                    elif out and out[-1][6] is None and out[-1][2:4] == (d, rk) and s <= out[-1][4] + out[-1][5]:
                        last = out[-1]  # goes on where the mark before it ends
                        out[-1] = (*last[:5], s + size - last[4], None)
                    else:
                        out.append((d & (2**64 - 1), 0, d, rk, s, size, None))  # settled: any task will do
        return pa.Table.from_batches([*done, made(out)])

    return by_batch(joined, run, SEGMENT)


def _span(start: int, size: int) -> int:
    return start << _SIZE_BITS | size


def _matched(stream: DataFrame, match: Matcher, width: int) -> DataFrame:
    """Rows (d, rk, span): the parts of segments that an earlier document has, packed by _span.

    The stream comes sorted by key, salt and document. Whole groups are matched together,
    as many as make CHUNK_BYTES; FULL_KEY and SALT_DOCS bound the documents of a group.
    """

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        out, index, segs, groups, docs, same = [], {}, [], [], [], []
        group, last = -1, None
        for h, salt, d, rk, start, size, seg in rows:
            if (h, salt) != last:
                group, last, index = group + 1, (h, salt), {}
            at = index.get(seg)
            if at is None:
                index[seg] = len(segs)
                segs.append(seg)
                groups.append(group)
                docs.append(d)
                same.append([(rk, start)])
            elif docs[at] < d:
                out.append((d, rk, _span(start, size)))
            else:
                same[at].append((rk, start))
        several = np.bincount(groups, minlength=group + 1)[groups] > 1 if segs else np.empty(0, bool)
        at = np.flatnonzero(several).tolist()
        if at:
            tokens = np.frombuffer(b"".join([segs[i] for i in at]), np.uint8 if width == 1 else np.uint64)
            met = meeting(tokens, [len(segs[i]) // width for i in at], [groups[i] for i in at])
            at = [i for i, m in zip(at, met.tolist()) if m]
        if at:
            for i, begin, size in match([segs[i] for i in at], [groups[i] for i in at], [docs[i] for i in at]):
                out += [(docs[at[i]], rk, _span(start + begin, size)) for rk, start in same[at[i]]]
        return made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out)) or [()] * 3
        return pa.record_batch([pa.array(x, pa.int64()) for x in c], names=["d", "rk", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            resolved = batch.filter(batch.column(6).is_null())
            if resolved.num_rows:
                d, rk, start, n = (resolved.column(i).to_numpy() for i in (2, 3, 4, 5))
                yield pa.record_batch([pa.array(d), pa.array(rk), pa.array(start << _SIZE_BITS | n)], names=["d", "rk", "span"])
            batch = batch.filter(batch.column(6).is_valid())
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK_BYTES and row[:2] != held[-1][:2]:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solved(held)

    return stream.mapInArrow(run, "d long, rk long, span long")


def _covered(n: int, spans: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    if len(spans):
        starts = spans >> _SIZE_BITS
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + (spans & ((1 << _SIZE_BITS) - 1)), -1)
    return np.cumsum(edge[:-1]) > 0


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Each list of longs as an array; null as an empty one."""
    values, sizes = column.flatten().to_numpy(), column.value_lengths().fill_null(0).to_numpy()
    return np.split(values, np.cumsum(sizes)[:-1])


class Repeats:
    """The repeated passages of a table of documents, by (d, rk): document and hash of document and text.

    measured: every row with its size and hash. copies: rows whose whole text stands in an
    earlier document. marks: spans of the others. Rows without doc_id are no one's copy.
    """

    def __init__(self, docs: DataFrame, kind: type, match: Matcher, id_col: str = "doc_id", text_col: str = "text"):
        self.kind = kind
        self.rows = pick(docs, d=id_col, text=text_col).select(F.col("d").cast("long").alias("d"), F.xxhash64("d", "text").alias("rk"), "text")
        self.measured = stored(_measured(self.rows, kind), "measured")
        whole = self.measured.where("d is not null")
        first = whole.where(F.col("n") >= WINDOW).groupBy("sha").agg(F.min("d").alias("first"))
        self.copies = stored(whole.join(first, "sha").where("first < d").select("d", "rk").distinct(), "copies")
        texts = _narrowed(self.rows.where("d is not null"), self.copies, "left_anti")
        shared = stored(_shared_keys(texts, kind), "shared-keys")
        some = shared.select("d")
        if some.count() <= ID_ROWS:
            texts = texts.join(F.broadcast(some), "d", "left_semi")
        sent = _segments(texts.join(shared, "d").select("d", "rk", "text", "shared"), kind)
        parts = max(self.rows.sparkSession.sparkContext.defaultParallelism, int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        stream = sent.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "d")
        found = _matched(stream, match, kind.width)
        self.marks = stored(found.groupBy("d", "rk").agg(F.collect_list("span").alias("spans")), "marks")

    def report(self) -> DataFrame:
        """Rows (doc_id, n, n_removed, n_spans, kept_sha256), one for each row of the table."""
        marked, kind = _narrowed(self.rows, self.marks.select("d", "rk"), "left_semi").join(self.marks, ["d", "rk"]).select("d", "text", "spans"), self.kind

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, spans in zip(raw_texts(batch.column(1)), _lists(batch.column(2))):
                n, _ = kind.whole(text)
                gone = _covered(n, spans)
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((n, int(gone.sum()), starts, hashlib.sha256(kind.kept(text, ~gone)).hexdigest()))
            c = list(zip(*out))
            return pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], names=["doc_id", "n", "n_removed", "n_spans", "kept_sha256"])

        schema = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string"
        plain = _narrowed(_narrowed(self.measured, self.marks.select("d", "rk"), "left_anti"), self.copies, "left_anti")
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        kept = plain.select(F.col("d").alias("doc_id"), "n", zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"))
        gone = _narrowed(self.measured, self.copies, "left_semi").select(F.col("d").alias("doc_id"), "n", F.col("n").alias("n_removed"), one.alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
        return by_batch(marked, run, schema).union(kept).union(gone)

    def kept_texts(self) -> DataFrame:
        """Rows (doc_id, kept binary): what is left of each row's text; null texts as none, repeated rows each."""
        kind = self.kind
        whole = self.rows.join(self.marks, ["d", "rk"], "left").join(self.copies.withColumn("copy", F.lit(True)), ["d", "rk"], "left").select("d", "text", "spans", "copy")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, spans, copy in zip(raw_texts(batch.column(1)), _lists(batch.column(2)), batch.column(3).to_pylist()):
                n, plain = kind.whole(text)
                out.append(b"" if copy else kind.kept(text, ~_covered(n, spans)) if len(spans) else plain)
            return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "kept"])

        return by_batch(whole, run, "doc_id long, kept binary")
