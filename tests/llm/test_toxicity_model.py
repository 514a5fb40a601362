"""The toxicity model against a plain forward pass, finite differences and byte bounds."""

import random
import zlib
from collections import Counter

import numpy as np

from lyrebird.llm import toxicity

SCHEMA = "doc_id long, text string"


def plain_grams(word):
    w = f"<{word}>"
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS for g in (w, *(w[i : i + n] for n in toxicity.SIZES for i in range(len(w) - n + 1)))] if word else []


def plain_score(model, text):
    """Mean over words, by the roots of their counts, of means over n-grams; softmax of the layer."""
    counts = Counter((text or "").lower().split())
    mean = np.zeros(toxicity.DIM)
    whole = sum(c**0.5 for c in counts.values())
    for word, c in counts.items():
        grams = plain_grams(toxicity.spelled(word))
        if grams:
            mean += c**0.5 / whole * model.table[grams].astype(float).mean(axis=0)
    z = toxicity.SCALE * (mean @ model.layer.astype(float)) + model.bias.astype(float)
    e = np.exp(z - z.max())
    return e[1] / e.sum()


def odd_texts():
    rng = random.Random(2)
    parts = ["you", "idi0t", "Stüpid!", "...", "天気がいい", "𝒳\ud800y", "a" * 70, "x", "ß", "​", "w1", "-", "4ever", "n\x00m"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "   ", "天気" * 2000, "ab" * 90_000]


def test_scores_equal_a_plain_forward_pass(monkeypatch):
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.standard_normal((toxicity.BUCKETS, toxicity.DIM)).astype("f4") * 0.02, rng.standard_normal((toxicity.DIM, 2)).astype("f4"), np.array([0.3, -0.2], "f4"))
    texts = odd_texts()
    want = [plain_score(model, t) for t in texts]
    for chars in (7, 100_000):
        monkeypatch.setattr(toxicity, "CHUNK_CHARS", chars if chars > 7 else 1000)
        scorer = toxicity.Scorer(model)
        assert np.allclose(scorer.scores(texts), want, atol=1e-9)
        assert np.allclose([scorer.score(t) for t in texts], want, atol=1e-9)


def test_cached_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 10)
    model = toxicity.train(["good day", "you idiot"], [0, 1])
    scorer, fresh = toxicity.Scorer(model), toxicity.Scorer(model)
    texts = [f"word{i} you idiot{i % 3} " + "z" * 80 for i in range(50)]
    assert [scorer.score(t) for t in texts] == [fresh.scores([t])[0] for t in texts]
    assert len(scorer) <= 10 + 4


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(4)
    table, layer, bias = rng.standard_normal((30, 4)) * 0.05, rng.standard_normal((4, 2)) * 0.3, rng.standard_normal(2)
    rows, weights, cut, y = rng.integers(0, 30, 25), rng.random(25), np.array([0, 7, 8, 25]), np.array([1, 0, 1])
    _, *slopes = toxicity.gradients(table, layer, bias, rows, weights, cut, y)
    for x, slope in zip((table, layer, bias), slopes, strict=True):
        for at in np.ndindex(x.shape):
            kept, sides = x[at], []
            for step in (1e-6, -1e-6):
                x[at] = kept + step
                sides.append(toxicity.gradients(table, layer, bias, rows, weights, cut, y)[0])
            x[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - slope[at]) < 1e-4


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i, "you idiot scum" if i % 2 else "fine day today") for i in range(80)] + [(1, "you idiot scum"), (3, "x" * 300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 1), (900, 1)], "doc_id long, toxic int")
    whole, part, none = toxicity.fit(df, labels), toxicity.fit(df, labels, max_bytes=200), toxicity.fit(df, labels, max_bytes=3)
    assert whole.known and part.known and not none.known
    assert toxicity.fit(df, labels, max_rows=1).known in (True, False)
    assert toxicity.Scorer(whole).score("you idiot") > 0.5 > toxicity.Scorer(whole).score("fine day")
    again = toxicity.fit(df.repartition(7), labels)
    assert (again.table == whole.table).all() and (again.bias == whole.bias).all()


def test_repeated_rows_score_alike(spark):
    df = spark.createDataFrame([(1, "good day"), (1, "good day"), (None, "good day"), (2, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id != 2}) == 1
