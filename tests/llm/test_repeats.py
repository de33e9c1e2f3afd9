import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import repeats, rlz_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, n string, d string, spans string"


def plain(docs, tokens, glue):
    """Brute force: windows of 50 tokens by content, against those of smaller ids."""
    first = {}
    for i, t in docs:
        s = tokens(t)
        for a in range(len(s) - 49):
            if i is not None:
                w = tuple(s[a : a + 50])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        s = tokens(t)
        gone = [False] * len(s)
        for a in range(len(s) - 49):
            if i is not None and first[tuple(s[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(s), sum(gone), spans, hashlib.sha256(glue([x for x, g in zip(s, gone) if not g])).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, unit, common=30):
    rng = random.Random(seed)
    fresh = lambda n: [rng.choice(unit) for _ in range(n)]
    base = [fresh(rng.randint(0, 260)) for _ in range(12)]
    passage, short = fresh(70), fresh(53)
    docs = []
    for _ in range(common):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(unit)
        docs.append(t)
        docs.append(fresh(rng.randint(0, 90)) + (passage if rng.random() < 0.5 else short) + fresh(rng.randint(0, 60)))
    docs += [passage[:60] + short[10:], ["a"] * 300, ["a"] * 200, ["a", "b"] * 120, base[0], base[0], [], fresh(49)]
    return docs


def bytes_docs(seed=1):
    unit = list("abcdefgh ") + ["é", "🙂"]
    texts = ["".join(t) for t in corpus(seed, unit)]
    docs = list(enumerate(texts)) + [(500, None), (None, texts[0]), (3, texts[3]), (3, texts[5]), (501, texts[1] * 40)]
    random.Random(2).shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA)


@pytest.mark.parametrize("full", [1024, 3])
def test_suffix_dedup_is_the_brute_force(spark, full, monkeypatch):
    monkeypatch.setattr(repeats, "FULL_KEY", full)
    monkeypatch.setattr(repeats, "SALT_DOCS", 4)
    monkeypatch.setattr(repeats, "COMMON_DOCS", 40 if full == 3 else 2)
    docs = bytes_docs()
    found = suffix_dedup.repeated_bytes(frame(spark, docs).repartition(5))
    got = sorted((tuple(r) for r in found.report().collect()), key=repr)
    assert got == plain(docs, lambda t: list((t or "").encode()), bytes)
    kept = found.kept_texts().collect()
    assert sorted((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in kept if r.doc_id is not None) == sorted((r[0], r[4]) for r in got if r[0] is not None)


@pytest.mark.parametrize("full", [1024, 3])
def test_rlz_dedup_is_the_brute_force(spark, full, monkeypatch):
    monkeypatch.setattr(repeats, "FULL_KEY", full)
    monkeypatch.setattr(repeats, "SALT_DOCS", 4)
    monkeypatch.setattr(repeats, "COMMON_DOCS", 40 if full == 3 else 2)
    texts = ["\t".join(t) + "\n" for t in corpus(5, ["red", "Red", "blue", "é", "x1", "of", "the"])]
    docs = list(enumerate(texts)) + [(500, None), (None, texts[0]), (3, texts[5]), (501, " ".join(texts[1:4]))]
    got = sorted((tuple(r) for r in rlz_dedup.repeated_words(frame(spark, docs).repartition(5)).report().collect()), key=repr)
    assert got == plain(docs, lambda t: (t or "").encode().split(), b" ".join)


def test_no_rows(spark):
    for f in (suffix_dedup.repeated_bytes, rlz_dedup.repeated_words):
        found = f(frame(spark, []))
        assert found.report().count() == 0 and found.kept_texts().count() == 0


def test_previous_factors():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 12)
        values, lcp = [rng.randint(0, 4) for _ in range(n)], [0] + [rng.randint(0, 9) for _ in range(n - 1)]
        want = [max([0, *(min(lcp[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if values[j] < values[i])]) for i in range(n)]
        assert suffix_dedup.longest_previous_factors(values, lcp) == want


def test_suffix_array_sorts_and_measures():
    rng = random.Random(2)
    segs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 90))) for _ in range(6)] + [b"a" * 80, b"a" * 70]
    groups = [0, 0, 0, 1, 1, 1, 2, 2]
    s = suffix_dedup.SuffixArray(segs, groups)
    order = [(groups[s.owner[p]], segs[s.owner[p]][p - s.begins[p] :]) for p in s.order]
    assert [(g, x[:56]) for g, x in order] == sorted((g, x[:56]) for g, x in order)
    for (g, x), (h, y), lcp in zip(order, order[1:], s.common()[1:]):
        want = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) if g == h else 0
        assert lcp == min(want, lcp if want > 111 else want)


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 400).astype(np.uint8)
    keys = repeats.window_keys(np.concatenate([t, t[100:300], t]))
    assert (keys[:351] == keys[600:951]).all() and (keys[400:551] == keys[100:251]).all()
    assert len(repeats.window_keys(t[:49])) == 0 and len(repeats.window_keys(t[:50])) == 1
