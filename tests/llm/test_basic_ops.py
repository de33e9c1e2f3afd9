import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridloom.llm import ann, line_dedup, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, id string, fp string, shard string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z", "w") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    texts += [None, "", " \t\n", texts[0], texts[0].upper(), "one", "one two", "é" * 5000 + " x" * 3000]
    for t in texts[:20]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    return texts


def plain_fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [root(i) for i in range(len(fps))]


def test_simhash_is_the_brute_force(spark):
    texts = corpus()
    got = {r[0]: (r[1], r[2]) for r in simhash.simhash_components(frame(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, components(fps)))}


def test_links_of_full_buckets_are_whole(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 250:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.6 and 1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for bucket, long_from in ((4, 1 << 28), (1000, 1 << 28), (1000, 0)):
        edges = simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket, long_from=long_from)
        roots = dict(simhash.star_components(edges).collect())
        want = components(fps)
        groups = Counter(want)
        assert sum(1 for f in signed if f in roots) == len(fps) - len(groups)
        assert len({(roots.get(f, f), w) for f, w in zip(signed, want)}) == len(groups)


def test_simhash_of_no_rows_and_repeated_rows(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    got = simhash.simhash_components(frame(spark, ["a b c", "a b c", None], [7, 7, None])).collect()
    assert sorted((r[0] or -1, r[2]) for r in got) == [(-1, None), (7, 7), (7, 7)]


def test_hypergeometric_law():
    rng = random.Random(5)
    n = 40000
    seen = Counter(sharding.hypergeometric(7, 9, 6, rng) for _ in range(n))
    from math import comb

    for x in range(7):
        p = comb(7, x) * comb(9, 6 - x) / comb(16, 6)
        assert abs(seen[x] / n - p) < 0.015
    m = sharding.communication_matrix([5, 0, 11, 3], [10, 9], 1)
    assert [sum(r) for r in m] == [5, 0, 11, 3] and [sum(c) for c in zip(*m)] == [10, 9]
    assert 0 <= sharding.hypergeometric(10**10, 10**10, 10**9, rng) <= 10**9


@pytest.mark.parametrize("block_rows", [1 << 20, 3])
def test_shards_are_exact(spark, block_rows):
    texts = corpus(200)
    got = sharding.uniform_shards(frame(spark, texts), 16, block_rows=block_rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    assert got and sorted(got) == sorted(sharding.uniform_shards(frame(spark, texts).repartition(7), 16, block_rows=block_rows).collect())


def test_shards_of_odd_tables(spark):
    assert sharding.uniform_shards(frame(spark, []), 16).count() == 0
    got = sharding.uniform_shards(frame(spark, ["same"] * 40, [None] * 40), 16).collect()
    assert Counter(r.shard for r in got) == {s: 2 + (s < 8) for s in range(16)}
    assert len(sharding.uniform_shards(frame(spark, ["a"]), 16).collect()) == 1


def test_shards_are_uniform(spark):
    n = 160
    where = np.zeros(16)
    for seed in range(12):
        got = sharding.uniform_shards(frame(spark, ["t"] * n), 16, seed=seed).where("doc_id < 80").groupBy("shard").count().collect()
        for s, c in got:
            where[s] += c
    assert abs(where / 12 - 5).max() < 2


def plain_lines(texts, least):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or df[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_is_the_brute_force(spark, bound):
    rng = random.Random(2)
    lines = ["A line", " a LINE\t", "É", "é", "", "  ", "x "] + [f"l{i}" for i in range(30)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(80)] + [None, "", "A line"]
    got = {r[0]: tuple(r)[1:] for r in line_dedup.line_report(frame(spark, texts), 5, broadcast_bytes=bound).collect()}
    assert got == dict(enumerate(plain_lines(texts, 5)))
    assert line_dedup.line_report(frame(spark, []), 5, broadcast_bytes=bound).count() == 0
    copies = ["same\nlines\nhere"] * 10_000 + ["same\nother"]
    many = line_dedup.line_report(frame(spark, copies), 10, broadcast_bytes=bound).groupBy("n_lines", "n_dropped").count().collect()
    assert {tuple(r) for r in many} == {(3, 3, 10_000), (2, 1, 1)}
    kept = line_dedup.drop_frequent_lines(frame(spark, texts), 5, broadcast_bytes=bound, counts=("a", "b"))
    assert kept.columns[:9] == frame(spark, []).columns and {r.n_lines for r in kept.collect()} == {"x"}


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000))
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h(keys)) == list(range(len(keys)))
    pairs = np.array([[1, 2], [1, 3], [5, 6]])
    index = line_dedup.CountIndex.loaded(line_dedup.CountIndex.build(pairs, np.array([4, 5, 6])).dumped())
    assert index.counts_of(np.array([[1, 2], [1, 3], [5, 6], [5, 7], [9, 9]])).tolist() == [4, 5, 6, 0, 0]


def plain_nearest(rows, k, step):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    out = Counter()
    for q, a in good:
        if q % step == 0:
            found = sorted((-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)).__round__(12), i) for i, b in good if i != q and len(a) == len(b))
            out.update((q, r + 1, i) for r, (s, i) in enumerate(found[:k]))
    return out


def test_nearest_is_the_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(30)] + [(400, None), (401, []), (402, [0.0] * 8), (403, [None] * 8), (404, [float("nan")] * 8), (450, [1.0, 2.0]), (451, [1.0, 3.0]), (500, [float("inf")] + [1.0] * 7), (None, rows[1][1]), (10, rows[10][1])]
    rows += [(7, rows[7][1])] * 3 + [(20, rows[21][1])]  # rows that repeat an id
    df = spark.createDataFrame([(i, v, 0, "q") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    for tile, group in ((4096, 1 << 20), (16, 1 << 20), (16, 200)):
        got = ann.nearest(df, k=5, query_step=10, tile_rows=tile, group_bytes=group).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id) for r in got) == plain_nearest(rows, 5, 10)
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_very_large_and_small_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.choice([-300, -5, 0, 200, 300])).tolist()) for i in range(60)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, query_step=20).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id) for r in got) == plain_nearest(rows, 3, 20) and all(-1.001 < r.score < 1.001 for r in got)


def test_int8_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 33)), rng.normal(size=(40, 33))
    x, y = (ann.Codes(np.arange(40), np.arange(40), *ann.quantised(v)) for v in (a, b))
    low, high = ann.bounds(x, y, slice(0, 40))
    true = np.array([ann.exact_cosine(q, b) for q in a])
    assert (low <= true).all() and (true <= high).all() and (high - low).max() < 0.1
