"""Jaccard components against brute force, on groups whose similarities lie around the threshold."""

import random
import re

import numpy as np
import pytest

from lyrebird.llm.ngram_join import Signatures, jaccard_components
from lyrebird.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, node long, sig string"


def shingles(text, k):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, p, q):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def group(rng, vocab, words, copies, edits):
    base = [rng.choice(vocab) for _ in range(words)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        yield " ".join(w)


@pytest.mark.parametrize(("k", "p", "q"), [(3, 90, 100), (5, 80, 100), (1, 70, 100)])
def test_components_equal_brute_force(spark, k, p, q):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    texts = [t for words, copies, edits in ((200, 60, 9), (60, 40, 3), (12, 30, 1), (500, 20, 20), (30, 40, 4)) for t in group(rng, vocab, words, copies, edits)]
    shared = " ".join(rng.choice(vocab) for _ in range(80))
    texts += [shared + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40))) for _ in range(40)]  # one passage that many share
    texts += ["", None, "  \n", "one", "ONE", "one two", "one two three", "a b c d", "É é", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, k, p, q).collect()}
    assert got == brute(rows, k, p, q)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 12, 1 << 17)
    for p in (70, 80, 90, 95):
        sign = Signatures(counts, p, 100)
        for n in [*range(1, 40), 100, 333, 1000]:
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            for _ in range(4):
                y = x.copy()
                lost = len(x) - -(-p * len(x) // 100)
                drop = rng.choice(len(x), rng.integers(0, lost + 1), replace=False)
                y = np.delete(y, drop)
                spare = 100 * len(y) // p - len(x)  # new tokens that keep the pair at p
                y = np.unique(np.concatenate([y, rng.integers(0, 2**63, max(0, spare)).astype(np.uint64) * np.uint64(2)]))
                both = len(np.intersect1d(x, y))
                if 100 * both >= p * (len(x) + len(y) - both):
                    assert np.intersect1d(sign(x), sign(y)).size, (p, n)


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "alpha beta gamma delta epsilon zeta"
    df = spark.createDataFrame([(4, long, "", 0, ""), (4, long, "", 0, ""), (None, long, "", 0, ""), (7, None, "", 0, "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df, 3, 90, 100).collect())
    assert got == [(0, 4, 4), (4, 4, 4), (4, 4, 4), (7, 0, 7)]
    assert jaccard_components(df.limit(0), 3, 90, 100).collect() == []


def test_connected_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
