import itertools
import random

import pytest

import corpus_pipeline
from gridloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """Least index of each text's component over links of Jaccard 0.8 or more."""
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for n in (3, 5, 6, 9, 30, 60, 60, 120, 240):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(24):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w[rng.randint(0, n // 20) :]))
    texts += [None, "", " \t\n", texts[80].upper(), texts[80], "é È x y z", "é è x y z"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("full", [32, 4])
def test_groups_are_brute_force_jaccard(spark, full):
    texts = corpus()
    got = near_copies.near_copy_groups(frame(spark, enumerate(texts)), full=full).collect()
    roots, want = {r.id: r.root for r in got}, groups(texts)
    assert len(got) == len(texts)
    assert len({(roots[i], w) for i, w in enumerate(want)}) == len(set(roots.values())) == len(set(want)) < len(texts) / 2


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = groups([t for _, t in rows])
    kept = {r.doc_id for r in corpus_pipeline.simhash(spark, docs, "").collect()}
    assert kept == {d for i, (d, _) in enumerate(rows) if want[i] == i} and 56 not in kept
    assert corpus_pipeline.simhash(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("rounds", [(2, None)])
def test_crowds_of_sets_apart_are_linked_whole(spark, rounds, monkeypatch):
    """Many sets share shingles of their prefixes, in several groups that are no copies of each other."""
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = random.Random(3)
    passage, texts = [f"p{i}" for i in range(40)], []
    for g in range(6):
        own = [f"g{g}w{i}" for i in range(8)]
        for _ in range(20):
            w = passage + own
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w))
    got = near_copies.near_copy_groups(frame(spark, enumerate(texts)), full=4).collect()
    roots, want = {r.id: r.root for r in got}, groups(texts)
    assert len({(roots[i], w) for i, w in enumerate(want)}) == len(set(roots.values())) == len(set(want))


def test_columns_of_the_same_names_stay(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "y")], "doc_id long, text string, t1 string, k1 string")
    assert [tuple(r) for r in near_copies.drop_near_copies(rows).collect()] == [(1, "a b c d e f", "x", "y")]


def test_stages_decide_by_row(spark):
    from gridloom.llm import decontam

    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey")
    rows = [(None, a), (3, a), (3, a), (5, a), (5, b), (None, c), (None, c), (7, None), (None, "")]
    kept = near_copies.drop_near_copies(frame(spark, rows))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r) for r in [(3, a), (5, b), (None, c), (7, None)])
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    clean = decontam.drop_contaminated(frame(spark, rows), items)
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(r) for r in rows if r[1] != a) and clean.columns == kept.columns
