"""Near copies by exact Jaccard similarity of word shingles.

SimHash fingerprints of the shingle sets, linked by pigeonring filtering, give the first
candidates. At similarity 0.8 fingerprints differ in about ten of 64 bits, beyond any radius
that still tells sets apart, so prefix filtering finds the pairs that they leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, forget, give_back, pick, raw_texts, stored, unused
from gridloom.llm.components import star_components
from gridloom.llm.simhash import linked_fingerprints, majority

WORDS, PERCENT = 5, 80
FULL = 32
#: Pivots of a full shingle in each round; None: all sets outside its largest component.
ROUNDS = (8, None)
PAIR_ROWS = 50_000
SKETCH = 1024
SAMPLE_DOCS, COMMON = 20_000, 100_000
_TEXT_KEY = ("t1", "t2")


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; all words make one if they are fewer.

    Words are split at ASCII white space and ASCII lower-cased. No words: no shingles.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The shingles of which two similar sets share at least one: rare ones first, then `common` (sorted hashes, ranks from 1) by rank.

    Sets of n shingles that reach the similarity share ceil(n * percent / 100) of them, so
    the first n less that, plus one, of any order that all sets follow hold a shared one.
    """
    need = -(-len(hashes) * percent // 100)
    rank = np.zeros(len(hashes), np.int64)
    known, ranks = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - need + 1]


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH parity bits: two sets' sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _may_hold(na, nb, left_a, left_b, percent: int):
    """If sets of na and nb shingles with so many left from their first shared one on can be similar."""
    return np.minimum(left_a, left_b) * (100 + percent) >= percent * (na + nb)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2): 128 bits stand for each text."""
    text = F.col("text")
    return pick(docs, id=id_col, text=text_col).select("id", "text", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _common_shingles(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the shingles that a sample of the distinct texts has three times or more, rarest first.

    They only set the order of prefixes; any order finds every pair.
    """
    keyed, total = _keyed(docs, id_col, text_col), docs.count()
    share = max(1, -(-total // SAMPLE_DOCS))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [shingles(t) for t in raw_texts(batch.column(0))]
        return pa.record_batch([pa.array(np.concatenate(parts).view(np.int64))], names=["h"])

    sample = keyed.where(F.pmod("t1", F.lit(share)) == 0).dropDuplicates(_TEXT_KEY).select("text")
    rows = by_batch(sample, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes = np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order + 1


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A stored row (r, id, t1, t2, s1, s2, n, fp, prefix, sketch) for each document; s1 and s2 stand for its set."""
    sent = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, id_col, text_col))
    keyed = _keyed(docs, id_col, text_col)
    kind = dict(keyed.dtypes)["id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in raw_texts(batch.column(1))]
        both = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        heads = [prefix(s, sent.value) for s in sets]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in heads]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
        columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), lists, pa.array([sketch(s) for s in sets], pa.binary())]
        return pa.record_batch(columns, names=["id", "t1", "t2", "s1", "s2", "n", "fp", "prefix", "sketch"])

    rows = by_batch(keyed, run, f"id {kind}, t1 long, t2 long, s1 long, s2 long, n int, fp long, prefix array<long>, sketch binary")
    return stored(rows.select(F.monotonically_increasing_id().alias("r"), "*"), "shingle-marks")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in the order of column tok, cut so that no run of one tok is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tok = batch.column(0).to_numpy()
        last = int(np.searchsorted(tok, tok[-1]))
        if held and held[-1].column(0)[0].as_py() != tok[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _met(sets: DataFrame, percent: int, full: int) -> DataFrame:
    """Stored rows (tok, u, v, n, pos): pairs that meet under shingle tok, or with null v the sets of a full tok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            tok, r, n, pos = (table.column(i).to_numpy() for i in range(4))
            bounds = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1], [True])))
            size = np.repeat(np.diff(bounds), np.diff(bounds))
            few = np.flatnonzero((size > 1) & (size <= full))
            us, vs = [], []
            for step in range(1, full):
                a = few[few + step < len(tok)]
                a = a[tok[a] == tok[a + step]]
                if not len(a):
                    break
                b = a + step
                ok = _may_hold(n[a], n[b], n[a] - pos[a], n[b] - pos[b], percent)
                us.append(r[a[ok]])
                vs.append(r[b[ok]])
            crowd = np.flatnonzero(size > full)
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
            none, zero = pa.array(np.zeros(len(u), np.int64)), pa.array(np.zeros(len(u), np.int64))
            if len(u):
                yield pa.record_batch([none, pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), zero, zero], names=["tok", "u", "v", "n", "pos"])
            if len(crowd):
                yield pa.record_batch([pa.array(tok[crowd]), pa.array(r[crowd]), pa.nulls(len(crowd), pa.int64()), pa.array(n[crowd]), pa.array(pos[crowd])], names=["tok", "u", "v", "n", "pos"])

    rows = sets.select("r", "n", F.posexplode("prefix").alias("pos", "tok")).repartition("tok").sortWithinPartitions("tok")
    rows = rows.select("tok", "r", F.col("n").cast("long"), F.col("pos").cast("long"))
    return stored(rows.mapInArrow(run, "tok long, u long, v long, n long, pos long"), "prefix-meetings")


def _alike_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are linked by pigeonring filtering: each set with the first of its fingerprint, and firsts along the links."""
    first = stored(sets.where("n > 0").groupBy("fp").agg(F.min("r").alias("first")), "fingerprints")
    same = sets.join(first, "fp").where("r <> first").select(F.col("first").alias("u"), F.col("r").alias("v"))
    links = linked_fingerprints(first.select("fp"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"r{c}")) for c in "uv")
    return same.union(links.join(one, "u").join(two, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))).distinct()


def _crossing(crowd: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, pivots: int | None) -> DataFrame:
    """Pairs (u, v) of different components under one full shingle that size, place and sketch let pass.

    Each pivot meets all sets of the shingle. Pivots are sets of different components, those
    whose shared shingle comes first, as an original's does among its copies; or all sets
    outside the largest component, which leaves no pair out.
    """
    rows = crowd.join(labels, F.col("u") == F.col("node"), "left").select("tok", "u", "n", "pos", F.coalesce("root", "u").alias("label"))
    rows = rows.join(sets.select(F.col("r").alias("u"), "sketch"), "u").select("tok", "u", "n", "pos", "label", "sketch")

    def made(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for table in _whole_runs(batches):
            tok, u, n, pos, label = (table.column(i).to_numpy() for i in range(5))
            bits = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            bounds = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1], [True]))).tolist()
            for a, b in zip(bounds, bounds[1:]):
                names, which, counts = np.unique(label[a:b], return_inverse=True, return_counts=True)
                if len(names) < 2:
                    continue
                probes = np.lexsort((u[a:b], pos[a:b]))
                if pivots is None:
                    probes = probes[which[probes] != np.argmax(counts)]
                else:
                    probes = probes[np.sort(np.unique(which[probes], return_index=True)[1])][:pivots]
                for p in (a + probes).tolist():
                    other = a + np.flatnonzero(label[a:b] != label[p])
                    other = other[_may_hold(n[p], n[other], n[p] - pos[p], n[other] - pos[other], percent)]
                    other = other[np.bitwise_count(bits[other] ^ bits[p]).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n[other] + n[p])]
                    us.append(np.minimum(u[other], u[p]))
                    vs.append(np.maximum(u[other], u[p]))
                    held += len(other)
                    if held > PAIR_ROWS:
                        yield made(us, vs)
                        us, vs, held = [], [], 0
        if held:
            yield made(us, vs)
        give_back()

    return rows.repartition("tok").sortWithinPartitions("tok").mapInArrow(run, "u long, v long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the similarity; texts of candidates alone are read for it."""
    left = sets.select(F.col("r").alias("u"), F.col("n").alias("na"), F.col("sketch").alias("a"))
    right = sets.select(F.col("r").alias("v"), F.col("n").alias("nb"), F.col("sketch").alias("b"))

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for i in (4, 5))
        na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        ok = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (na + nb)
        return batch.select(["u", "v"]).filter(pa.array(ok))

    close = stored(by_batch(pairs.join(left, "u").join(right, "v").select("u", "v", "na", "nb", "a", "b"), near, "u long, v long"), "near-pairs")
    ends = close.select(F.col("u").alias("r")).union(close.select(F.col("v").alias("r"))).distinct()
    wanted = stored(sets.join(ends, "r").select("r", *_TEXT_KEY), "near-sets")
    texts = _keyed(docs, id_col, text_col).join(wanted, list(_TEXT_KEY)).select("r", "text")

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in raw_texts(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in found], pa.large_binary()).cast(pa.binary())], names=["r", "hs"])

    held = stored(by_batch(texts, whole, "r long, hs binary").dropDuplicates(["r"]), "near-shingles")

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(shared * 100 >= percent * (len(x) + len(y) - shared))
        return batch.select(["u", "v"]).filter(pa.array(ok))

    joined = close.join(held.select(F.col("r").alias("u"), F.col("hs").alias("a")), "u").join(held.select(F.col("r").alias("v"), F.col("hs").alias("b")), "v")
    similar = stored(by_batch(joined.select("u", "v", "a", "b"), alike, "u long, v long"), "similar-pairs")
    for table in (close, wanted, held):
        forget(table)
    return similar


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, full: int = FULL) -> DataFrame:
    """A row (id, t1, t2, root) for each input row; rows of one root are copies of each other.

    Groups are the components over links of Jaccard similarity percent/100 or more between
    the sets of five-word shingles. Candidates are sets whose SimHash fingerprints are
    linked, and, as no similar pair may be missed, sets that share a shingle of their
    prefixes. All sets under one shingle are paired if they are at most `full`; of a fuller
    one only those that are not linked yet, first with few pivots, in the end each outside
    the largest component with all. Sizes, places in the prefix and parity sketches prune
    pairs that cannot reach the similarity; the rest are settled by their whole sets.
    Shingles are told apart by 64 bits, sets and texts by 128. Texts without words are
    copies of each other.
    """
    marks = _marks(docs, id_col, text_col)
    firsts = stored(marks.groupBy("s1", "s2").agg(F.min("r").alias("first")), "distinct-sets")
    sets = stored(marks.join(firsts.select(F.col("first").alias("r")), "r").select("r", "t1", "t2", "n", "fp", "prefix", "sketch"), "shingle-sets")
    met = _met(sets, percent, full)
    candidates = met.where("v is not null").select("u", "v").union(_alike_fingerprints(sets)).distinct()
    known = _verified(candidates, sets, docs, id_col, text_col, percent)
    crowd = met.where("v is null").drop("v")
    roots = star_components(known)
    if not crowd.isEmpty():
        for pivots in ROUNDS:
            pairs = stored(_crossing(crowd, roots.withColumnRenamed("u", "node"), sets, percent, pivots), "crossing-pairs")
            if not pairs.isEmpty():
                more = _verified(pairs, sets, docs, id_col, text_col, percent)
                roots = star_components(roots.select("u", F.col("root").alias("v")).union(more))  # what is linked is a star already
            forget(pairs)
    named = firsts.join(roots, F.col("first") == F.col("u"), "left").select("s1", "s2", F.coalesce("root", "first").alias("root"))
    return marks.join(named, ["s1", "s2"]).select("id", "t1", "t2", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each group of near copies; columns as they were.

    Rows are judged one by one: the least doc_id stays, null after all others, and of several
    texts under that doc_id the one of the least hash. Of rows repeated with doc_id and text
    any one stays. A doc_id of two texts in different groups can keep both.
    """
    groups = stored(near_copy_groups(docs, id_col, text_col), "near-copy-groups")
    rows = groups.groupBy("root", "id", *_TEXT_KEY).agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *_TEXT_KEY, "n")).alias("k"))
    kept = stored(best.select(F.col("k.id").alias("__id"), F.col("k.t1").alias("__k1"), F.col("k.t2").alias("__k2"), F.col("k.n").alias("__n")), "kept-keys")
    text, names = F.col(f"`{text_col}`"), [unused(docs, c) for c in ("t1", "t2", "id", "k1", "k2", "n")]
    t1, t2, own, k1, k2, n = names
    keyed = docs.withColumn(t1, F.xxhash64(text)).withColumn(t2, F.xxhash64(F.lit(1), text))
    found = keyed.join(kept.toDF(own, k1, k2, n), (F.col(t1) == F.col(k1)) & (F.col(t2) == F.col(k2)) & F.col(f"`{id_col}`").eqNullSafe(F.col(own)))
    if not kept.where("__n > 1").isEmpty():
        found = found.dropDuplicates([t1, t2])
    return found.drop(*names)
