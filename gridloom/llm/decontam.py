"""Benchmark passages in documents, found within an edit budget by pigeonhole pieces and Myers' bit vectors."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, pick, stored, unused

ITEM_BYTES = 4 << 20
#: Lengths in bytes of the openings by which pieces are looked up, and words of the filter of their hashes.
OPENINGS, FILTER_WORDS = (16, 8, 4, 2, 1), 1 << 20
GAP = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Case-folded words with one space between them."""
    return GAP.sub(" ", text.casefold()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 parts; one of them survives any `budget` edits."""
    parts = budget + 1
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers_best(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end): the best match of the whole pattern anywhere in text, if within limit.

    Myers' bit-parallel columns on Python integers: one step a character of text, whatever
    the pattern's length. The earliest end wins among equal distances.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top, score = (1 << m) - 1, 1 << (m - 1), m
    pv, mv, best = full, 0, None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = full & (ph << 1), full & (mh << 1)
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = score, at + 1
    return best


def _runs(starts: list[int], reach: int) -> list[tuple[int, int]]:
    """(first, last) of groups of starts that lie within reach of the group's first."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s - out[-1][0] <= reach:
            out[-1] = out[-1][0], s
        else:
            out.append((s, s))
    return out


def best_match(item: str, text: str, starts: list[int], budget: int) -> int | None:
    """Least distance, up to budget, of the item to a passage of text near one of the starts."""
    if any(s >= 0 and text.startswith(item, s) for s in starts):
        return 0
    best = None
    for first, last in _runs(sorted(set(starts)), budget):
        window = text[max(0, first - budget) : last + len(item) + budget]
        if got := myers_best(item, window, budget if best is None else best - 1):
            best = got[0]
    return best


class Finder:
    """Searches texts for benchmark items, named by their numbers."""

    def __init__(self, items: list[str | None], error_rate: float):
        self.items: dict[str, list[int]] = {}
        for number, text in enumerate(items):
            if plain := normalised(text or ""):
                self.items.setdefault(plain, []).append(number)
        self.budgets = {item: int(len(item) * error_rate) for item in self.items}
        places: dict[str, list[tuple[str, int]]] = {}
        for item in self.items:
            for offset, piece in pieces(item, self.budgets[item]):
                places.setdefault(piece, []).append((item, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _starts(self, text: str) -> dict[str, set[int]]:
        starts: dict[str, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for item, offset in where:
                starts.setdefault(item, set()).add(end - length + 1 - offset)
        return starts

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, least distance) of each item that text holds within its budget."""
        if not self.items or not text:
            return []
        text, out = normalised(text), []
        for item, found in self._starts(text).items():
            best = best_match(item, text, list(found), self.budgets[item])
            if best is not None:
                out += [(number, best) for number in self.items[item]]
        return out

    def holds(self, text: str | None) -> bool:
        """If text holds any item."""
        if not self.items or not text:
            return False
        text = normalised(text)
        return any(best_match(item, text, list(found), self.budgets[item]) is not None for item, found in self._starts(text).items())


def _items(benchmark: DataFrame) -> DataFrame:
    return pick(benchmark, item_id="item_id", text="text").where("text is not null")


def _sent(items: DataFrame, item_bytes: int) -> pa.Table | None:
    """The items on the driver if their texts have at most item_bytes, else None."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items.toArrow() if size <= item_bytes else None


def _finder(table: pa.Table, error_rate: float, docs: DataFrame) -> Callable[[], Finder]:
    """A function that gives each worker its finder, built once."""
    sent = docs.sparkSession.sparkContext.broadcast(table.column("text").to_pylist())  # at most item_bytes
    held: list[Finder] = []

    def get() -> Finder:
        if not held:
            held.append(Finder(sent.value, error_rate))
        return held[0]

    return get


def opening(piece: bytes) -> int:
    """Length of the opening by which a piece is looked up: the longest of OPENINGS that fits."""
    return next(n for n in OPENINGS if n <= len(piece))


def opening_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes (a power of two), by doubling."""
    h, n = (text.astype(np.uint64) + np.uint64(1 + (size << 9))) * np.uint64(0xD6E8FEB86659FD93), 1
    while n < size:
        h = h[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _char_starts(data: np.ndarray) -> np.ndarray:
    """For each byte, which character of the text it belongs to."""
    return np.cumsum((data & 0xC0) != 0x80) - 1


def _routed(docs: DataFrame, items: DataFrame, error_rate: float) -> DataFrame:
    """Rows (doc_id, item_id, distance) for benchmarks of any size: one pass looks up the openings of all pieces.

    Pieces' openings are hashed and shuffled, as are the places of documents that pass a
    filter of fixed size over those hashes; where both meet, the document's text joins the
    item and Myers' distance decides. Only texts with such a place travel.
    """
    kinds = dict(items.dtypes) | {"doc_id": dict(docs.dtypes)["doc_id"]}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(0).to_pylist():
            if plain := normalised(text):
                data = plain.encode()
                item = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                for offset, piece in pieces(plain, int(len(plain) * error_rate)):
                    raw = np.frombuffer(piece.encode(), np.uint8)
                    size = opening(raw)
                    rows.append((int(opening_hashes(raw[:size], size).view(np.int64)[0]), size, item, offset, plain))
        c = list(zip(*rows)) or [()] * 5
        return pa.record_batch([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()))], names=["h", "size", "item", "off", "plain"])

    parts = stored(by_batch(items.select("text").distinct(), cut, "h long, size int, item long, off int, plain string").dropDuplicates(["h", "item", "off"]), "pieces")
    wanted = sorted(r[0] for r in parts.select("size").distinct().collect())  # at most five
    bit = F.shiftrightunsigned("h", 6)
    words = parts.groupBy(F.pmod(bit, F.lit(FILTER_WORDS)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()  # FILTER_WORDS rows at most
    table = np.zeros(FILTER_WORDS, np.int64)
    for r in words:
        table[r["at"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))  # eight megabytes
    keyed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, hashes, where = [], [], []
        for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = np.frombuffer(normalised(text or "").encode(), np.uint8)
            for size in wanted:
                if len(data) < size:
                    continue
                h = opening_hashes(data, size)
                at = np.flatnonzero((sent.value[(h >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (h & np.uint64(63))) & np.uint64(1))
                if len(at):
                    keys += [key] * len(at)
                    hashes.append(h[at].view(np.int64))
                    where.append(_char_starts(data)[at])
        none = np.empty(0, np.int64)
        return pa.record_batch([pa.array(keys, pa.string()), pa.array(np.concatenate([*hashes, none])), pa.array(np.concatenate([*where, none]).astype(np.int32))], names=["key", "h", "at"])

    met = by_batch(keyed.select("text", "key"), places, "key string, h long, at int").join(parts.select("h", "item", "off"), "h").groupBy("key", "item").agg(F.collect_set(F.col("at") - F.col("off")).alias("starts"))
    met = stored(met, "piece-hits")
    texts = keyed.join(met.select("key").distinct(), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    pairs = met.join(texts, "key").join(parts.select("item", "plain").dropDuplicates(["item"]), "item").select("key", "item", "starts", "text", "plain")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [best_match(plain, normalised(text), starts, int(len(plain) * error_rate)) for starts, text, plain in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        kept = pa.array([f is not None for f in found])
        return pa.record_batch([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array([f for f in found if f is not None], pa.int32())], names=["key", "item", "distance"])

    held = stored(by_batch(pairs, verify, "key string, item long, distance int"), "held-items")

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [xxhash.xxh3_64_intdigest(p.encode()) - (1 << 63) if (p := normalised(t)) else None for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(own, pa.int64())], names=["item_id", "item"])

    names = by_batch(items.select("item_id", "text"), named, f"item_id {kinds['item_id']}, item long")
    return held.join(names, "item").join(keyed.select("doc_id", "key"), "key").select("doc_id", "item_id", "distance")


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, distance): the benchmark items that each document holds.

    Texts and items are case-folded and their gaps (all but letters and digits) made one
    space; words and their order stay. An item of n characters matches a passage within
    int(n * error_rate) edits, found anywhere in the whole text. Items without letters or
    digits match nothing; null and empty texts hold nothing. Repeated items give a row
    each, repeated documents too. Rows without any match do not appear. Ids keep their
    types. Other columns are ignored. Empty tables give no rows.

    Items of up to item_bytes go to every executor as one automaton, and documents stay
    where they are. Larger benchmarks are looked up by the hashes of their pieces. Either
    way documents are read for it once, whatever the benchmark's size.
    """
    rows, items = pick(docs, doc_id=id_col, text=text_col), _items(benchmark)
    table = _sent(items, item_bytes)
    if table is None:
        return _routed(rows, items, error_rate)
    get, ids = _finder(table, error_rate, docs), table.column("item_id").combine_chunks()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [(i, number, d) for i, text in enumerate(batch.column(1).to_pylist()) for number, d in get().find(text)]
        at, numbers, distances = zip(*hits) if hits else ((), (), ())
        return pa.record_batch([batch.column(0).take(pa.array(at, pa.int32())), ids.take(pa.array(numbers, pa.int32())), pa.array(distances, pa.int32())], names=["doc_id", "item_id", "distance"])

    return by_batch(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, distance int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns as they were.

    Each row is judged by its own text, whatever its doc_id: null and repeated ids too. The
    scan that searches a row also drops it; only a benchmark of more than item_bytes makes
    texts travel.
    """
    items = _items(benchmark)
    table = _sent(items, item_bytes)
    if table is None:
        key = unused(docs, "key")
        keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
        spoilt = _routed(pick(keyed, doc_id=key, text=text_col), items, error_rate).select(F.col("doc_id").alias(key)).distinct()
        return keyed.join(spoilt, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    get, at = _finder(table, error_rate, docs), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not get().holds(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return by_batch(numbered, run, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))).toDF(*docs.columns)
