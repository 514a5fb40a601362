"""Stages decide by a row's text: repeated and null ids, odd texts, clashing columns, empty tables; proximity against brute force."""

import random
from collections import Counter

import pytest

from lyrebird.llm import decontam, ngram_join, secrets, toxicity
from lyrebird.llm.common import materialize, scratch_scope
from lyrebird.llm.rows import with_keys, without_keys
from pyspark.sql import functions as F
from tests.llm.test_ngram_join import brute

WIDE = "doc_id long, text string, source string, key string, score double, _key int, found int, live string, n int, parity int"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 0.5, 1, 2, "l", 3, 4) for i, t, s in rows], WIDE).repartition(3)


T = " ".join(f"word{i}" for i in range(30))
OTHER = " ".join(f"other{i}" for i in range(30))


def kept_ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    df = wide(spark, [(1, T, "a"), (5, T, "a"), (5, OTHER, "a"), (7, T + " more", "a"), (9, None, "a"), (9, "", "a"), (None, OTHER + " x", "b"), (None, "alone here", "b")])
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    assert kept_ids(out) == [(False, 1, T), (False, 5, OTHER), (False, 9, ""), (False, 9, ""), (True, 0, "alone here")]


def test_of_repeated_rows_one_stays(spark):
    df = wide(spark, [(3, T, "a"), (3, T, "b"), (3, T, "a"), (4, OTHER, "a"), (None, "one two", "a"), (None, "one two", "c"), (2, "", "a"), (2, "", "a")])
    assert kept_ids(ngram_join.keep_one(df)) == [(False, 2, ""), (False, 2, ""), (False, 3, T), (False, 4, OTHER), (True, 0, "one two")]
    assert ngram_join.keep_one(df.limit(0)).collect() == []


def test_kept_rows_equal_brute_force_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 8)
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 20 + [" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    groups = brute(rows, 5, 80, 100)
    df = wide(spark, [(i, t, "s") for i, t in rows])
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == {i for i, (_, root) in groups.items() if root == i}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 5, 80, 100).collect()}
    assert got == groups


def test_very_long_texts_meet(spark):
    rng = random.Random(1)
    w = [str(rng.random()) for _ in range(60_000)]
    v = list(w)
    for _ in range(300):
        v[rng.randrange(len(v))] = "changed"
    df = wide(spark, [(2, " ".join(w), "a"), (1, " ".join(v), "a"), (3, "x" * 3_000_000, "a")])
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [1, 3]


def test_contaminated_rows_go_by_their_text(spark):
    passage = " ".join(f"term{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = wide(spark, [(1, "clean text", "a"), (1, f"see {passage} end", "a"), (None, passage, "a"), (None, "fine", "a"), (2, None, "a")])
    out = decontam.keep_uncontaminated(df, bench)
    assert out.columns == df.columns
    assert kept_ids(out) == [(False, 1, "clean text"), (False, 2, ""), (True, 0, "fine")]
    assert decontam.keep_uncontaminated(df.limit(0), bench).collect() == []


def test_secrets_go_from_every_row_with_the_value(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HOT_ROWS", 2)
    live, copied = "ghp_" + "a1B2" * 8, "ghp_" + "EXAMPLE0" * 4
    rows = [(1, f"x {live}", "o"), (1, "plain", "o"), (None, f"{live} y", "o"), (None, f"see {copied}", "o0"), *((i, f"see {copied}", f"o{i}") for i in range(5, 15)), (3, None, None), (4, "p " * 400_000 + live, "o")]
    df = wide(spark, rows)
    out = secrets.redact_corpus(df)
    assert out.columns == df.columns
    assert Counter(r.text for r in out.collect()) == Counter(t.replace(live, "[secret]") if t else t for _, t, _ in rows)
    spans = {r.doc_id: r.spans for r in secrets.digest(secrets.scan_corpus(df)).collect() if r.doc_id}
    assert spans[1] in ("", f"token:2:{2 + len(live)}") and spans[7] == ""


def test_toxic_stage_with_clashing_columns(spark):
    df = wide(spark, [(i, "you idiot" if i % 3 == 0 else "good day", "s") for i in range(60)] + [(None, "good day", "s"), (5, None, "s")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    out = toxicity.keep_clean(df, labels)
    assert out.columns == df.columns
    assert toxicity.keep_clean(df.limit(0), labels).collect() == []
    assert {r.text for r in out.collect()} <= {"good day", None}


def test_rows_by_key(spark):
    df = spark.range(2000).withColumn("text", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id"))))
    keys = spark.range(0, 900).select(F.concat(F.lit("t"), "id").alias("k"))
    assert sorted(r.id for r in without_keys(df, F.col("text"), keys).collect()) == [i for i in range(2000) if i % 7 == 0 or i >= 900]
    assert {i for i in range(900) if i % 7} <= {r.id for r in with_keys(df, F.col("text"), keys).collect()}
    assert without_keys(df, F.col("text"), keys.limit(0)).count() == 2000


def test_scope_drops_what_it_wrote(spark):
    with scratch_scope() as keep:
        gone, stays = materialize(spark.range(3).toDF("a"), "gone"), materialize(spark.range(4).toDF("a"), "stays")
        keep(stays)
    assert stays.count() == 4
    with pytest.raises(Exception):
        gone.count()


def brute_near(w, window, slack):
    need = Counter(window)
    has = lambda a, b: not need - Counter(w[a:b])
    out = set()
    for a in range(len(w)):
        for b in range(a + len(window), min(len(w), a + len(window) + slack) + 1):
            if has(a, b) and not has(a + 1, b) and not has(a, b - 1) and w[a:b] != window:
                out.add((a, b))
    return out


@pytest.mark.parametrize("block", [25, 1_500_000])
def test_proximity_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", block)
    rng = random.Random(9)
    vocab = ["rare", "bb", "cc", "dd", "q", "z"]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(1, ["rare", "bb", "cc"]), (2, ["bb", "bb", "q", "rare"]), (3, ["dd"]), (4, line(7)), (5, line(6))]
    rows = [(0, "q q rare q q bb cc".split()), (1, "bb q rare q q bb cc".split()), (2, []), *((i, line(rng.randint(0, 40))) for i in range(3, 120))]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    df = wide(spark, [(i, " ".join(t), "s") for i, t in rows])
    windows = [(str(i), t[k : k + 4]) for i, t in items for k in range(max(1, len(t) - 3))]
    got = {r.doc_id: {(m.item, m.start, m.end) for m in r.found if m.kind == "near"} for r in decontam.find_matches(df, bench, 4, slack=2).collect()}
    assert got == {i: {(item, a, b) for item, win in windows for a, b in brute_near(t, win, 2)} for i, t in rows}
    near = {r.doc_id: r.n_near_items for r in decontam.contamination(df, bench, 4, slack=2).collect()}
    assert near == {i: len({x[0] for x in found}) for i, found in got.items()}


@pytest.mark.parametrize(("piece", "slice_bytes"), [(3, 1 << 24), (5, 40), (200_000, 1 << 24)])
def test_long_items_in_pieces(spark, monkeypatch, piece, slice_bytes):
    monkeypatch.setattr(decontam, "PIECE_WORDS", piece)
    monkeypatch.setattr(decontam, "SLICE_BYTES", slice_bytes)
    rng = random.Random(21)
    line = lambda n: [rng.choice("abcdé") for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate((0, 1, 3, 4, 5, 6, 7, 8, 11, 30))]
    rows = [(i, line(rng.randint(0, 50))) for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    df = wide(spark, [(i, " ".join(t), "s") for i, t in rows])
    got = {r.doc_id: {(m.item, m.start, m.end) for m in r.found if m.kind == "exact"} for r in decontam.find_matches(df, bench, 4).collect()}
    windows = {(str(i), tuple(t[k : k + 4])) for i, t in items if t for k in range(max(1, len(t) - 3))}
    assert got == {i: {(item, a, a + len(w)) for item, w in windows for a in range(len(t) - len(w) + 1) if tuple(t[a : a + len(w)]) == w} for i, t in rows}


def test_very_long_documents_and_items(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(400_000)]
    bench = spark.createDataFrame([(1, " ".join(words[100_000:130_000])), (2, "short item")], "item_id long, text string")
    df = wide(spark, [(1, " ".join(words), "a"), (2, "a short item here", "a"), (3, "clean", "a")])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(df, bench).collect()}
    assert got[1] == (400_000, 3 * 30_000 + 29_997, 1, True)  # the words repeat every 100003, and the first time without three
    assert got[2] == (4, 2, 1, True) and got[3] == (1, 0, 0, False)
