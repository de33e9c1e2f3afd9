"""Near-duplicate detection by SimHash fingerprints and pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, pick, raw_texts, stored
from gridloom.llm.components import star_components

SEED = 42
_CHUNK = 1 << 16
#: Distinct fingerprints from which keys are long: under a short key about one in sixteen then meets another by chance.
LONG_FROM = 1 << 28
_LANE = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    total = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), _CHUNK):
        lanes = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8) + _LANE
        total += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(total.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' hashes have it."""
    tokens = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, fp): each row's fingerprint as a signed long. Null and empty texts: 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in raw_texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return by_batch(pick(docs, id=id_col, text=text_col), run, "id long, fp long")


def _mask(width: int) -> int:
    return (1 << width) - 1


def _segments(boxes: int) -> list[tuple[int, int]]:
    """(shift, width) of each box of the 64-bit ring."""
    bounds = [64 * i // boxes for i in range(boxes + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _box(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(_mask(width)))


def _ring_keys(fp: Column, max_bits: int, long: bool = False) -> Column:
    """Keys under which two fingerprints within max_bits meet.

    With max_bits + 1 boxes on a ring some chain of consecutive boxes starts with equal
    boxes and has at most one differing bit in its first two. So one half of the second box
    is equal as well: a key is the first box and either half of the next, about half the
    fingerprint, instead of one box alone. Long keys, for large tables, add a third of the
    box after: the whole chain has max_bits differing bits at most, so one of max_bits + 1
    parts of it is equal too.
    """
    boxes = _segments(max_bits + 1)
    keys = []
    for i, (shift, width) in enumerate(boxes):
        at, next_width = boxes[(i + 1) % len(boxes)]
        low = next_width // 2
        last, last_width = boxes[(i + 2) % len(boxes)]
        cuts = [last_width * j // (max_bits + 1) for j in range(max_bits + 2)]
        thirds = [_box(fp, last + a, b - a) for a, b in zip(cuts, cuts[1:])] if long else [F.lit(0).cast("long")]
        for part, (s, w) in enumerate([(at, low), (at + low, next_width - low)]):
            for j, third in enumerate(thirds):
                keys.append(F.struct(F.lit(2 * i + part).alias("start"), F.lit(j).alias("piece"), _box(fp, shift, width).alias("first"), _box(fp, s, w).alias("half"), third.alias("third")))
    return F.array(*keys)


def _chain_holds(a: Column, b: Column, start: Column, max_bits: int) -> Column:
    """The pigeonring condition: each prefix of the chain from the key's box is within its share of max_bits."""
    boxes = _segments(max_bits + 1)
    differ = a.bitwiseXOR(b)
    found = F.lit(False)
    for i in range(len(boxes)):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, len(boxes) + 1):
            shift, width = boxes[(i + length - 1) % len(boxes)]
            total = total + F.bit_count(_box(differ, shift, width))
            ok = ok & (total <= length * max_bits // len(boxes))
        found = found | (F.shiftright(start, 1).eqNullSafe(F.lit(i)) & ok)
    return found


def linked_fingerprints(fps: DataFrame, max_bits: int = 2, bucket: int = 16, long_from: int = LONG_FROM) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that span every link of max_bits or fewer.

    Keys grow with the table: from `long_from` fingerprints on they have 39 bits instead of
    32, so that chance seldom fills one. Keys met by at most `bucket` give candidate pairs,
    which the chain condition prunes before the full count of differing bits. Fingerprints
    under a fuller key are not paired: each is sent to the 65 points within one bit of it. Two
    fingerprints are within two bits exactly if they share such a point, and all that share
    one are within two bits of each other, so an edge to the least of them keeps the same
    components. At most 65 fingerprints share a point, however large a group of copies is.
    """
    if max_bits != 2:
        raise ValueError("links are found for max_bits = 2 only; the star points of full keys rest on it")
    long = fps.count() >= long_from
    key = ["start", "piece", "first", "half", "third"]
    keys = fps.select("fp", F.explode(_ring_keys(F.col("fp"), max_bits, long)).alias("k")).select("fp", *(f"k.{c}" for c in key))
    counts = keys.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keys.join(counts, key), "ring")
    cold = met.where(F.col("n") <= bucket).drop("n")
    a, b = cold.withColumnRenamed("fp", "u"), cold.withColumnRenamed("fp", "v")
    pairs = a.join(b, key).where("u < v").where(_chain_holds(F.col("u"), F.col("v"), F.col("start"), max_bits)).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")
    full = met.where(F.col("n") > bucket).select("fp").distinct()
    points = full.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("c"))
    stars = points.groupBy("c").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.union(points.join(stars, "c").where("fp <> v").select(F.col("fp").alias("u"), "v")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each input row.

    fingerprint: 16 lowercase hex digits over the ASCII-lowercased whole text. component_id:
    least doc_id reachable over links of max_bits or fewer differing bits. Texts without
    words (null, empty, white space) have fingerprint zero and link like any other. Equal
    fingerprints are merged before any link is looked for, so copies cost one row. Repeated
    rows each get their row; a null doc_id is never a component_id unless its whole
    component has none. Other columns are ignored. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    roots = star_components(linked_fingerprints(fps, max_bits))
    rooted = fps.join(roots, fps.fp == roots.u, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
