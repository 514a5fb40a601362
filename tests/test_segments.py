"""Folds against list programs written from the rules, on random segments and at the thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import cluster, intervals, segments as seg, speakers

SCHEMA = "media_id long, seq int, start_sec double, end_sec double, speaker_label string, text string, speaker_conf double"


def rows_of(rng, media, n):
    t, out = 0.0, []
    for i in range(n):
        t = round(t + rng.choice([0, 0.3, 0.5, 1, 2.9, 3, 3.1, 9]), 2)
        end = round(t + rng.choice([0, 1, 4, 12, 20]), 2)
        words = " ".join(rng.choice(["ab", "sentence", "more. And", "x"]) for _ in range(rng.choice([1, 3, 6, 12, 90, 260])))
        out.append((media, i, t, end, rng.choice(["A", "A", "A", "B"]), words, rng.choice([0.6, 0.68, 0.7, 0.75, 0.9])))
        t = end
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    return [r for m in range(12) for r in rows_of(rng, m, rng.choice([1, 2, 30]))]


def by_media(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def test_short_merge(spark, data):
    want = []
    for m, rows in by_media(data).items():
        cur = None
        for _, _, s, e, who, t, _ in rows:
            n = len(t)
            if cur and cur[2] == who and s - cur[1] <= 3 and e - cur[0] <= 60 and (cur[3] < 30 or n < 30 or (cur[3] + n + 1 < 1200 and (cur[3] < 400 or n < 400))):
                cur = [cur[0], e, who, cur[3] + n + 1, cur[4] + 1, f"{cur[5]} {t}"]
            else:
                if cur:
                    want.append((m, *cur))
                cur = [s, e, who, n, 1, t]
        want.append((m, *cur))
    got = seg.merge_short(seg.complete(spark.createDataFrame(data, SCHEMA))).collect()
    assert sorted((r.media_id, r.start_sec, r.end_sec, r.speaker_label, len(r.text), r.original_count, r.text) for r in got) == sorted(want)


def test_very_short_merge(spark, data):
    want = []
    for m, rows in by_media(data).items():
        out, i = [], 0
        while i < len(rows):
            _, _, s, e, who, t, _ = rows[i]
            if len(t) < 50 and i + 1 < len(rows) and rows[i + 1][4] == who and rows[i + 1][3] - s <= 60:
                out.append([s, rows[i + 1][3], who, f"{t} {rows[i + 1][5]}"])
                i += 2
                continue
            if len(t) < 50 and out and out[-1][2] == who and e - out[-1][0] <= 60:
                out[-1] = [out[-1][0], e, who, f"{out[-1][3]} {t}"]
            else:
                out.append([s, e, who, t])
            i += 1
        want += [(m, *o) for o in out]
    got = seg.merge_very_short(seg.complete(spark.createDataFrame(data, SCHEMA))).collect()
    assert sorted((r.media_id, r.start_sec, r.end_sec, r.speaker_label, r.text) for r in got) == sorted(want)


def test_duration_chunks(spark, data):
    want = []
    for m, rows in by_media(data).items():
        cur = None
        for _, _, s, e, _, t, _ in rows:
            if cur and e - cur[0] > 45:
                want.append((m, *cur))
                cur = None
            cur = [cur[0], e, f"{cur[2]} {t}"] if cur else [s, e, t]
        want.append((m, *cur))
    got = seg.duration_chunks(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.media_id, r.start_sec, r.end_sec, r.text) for r in got) == sorted(want)


def test_hysteresis(spark, data):
    want = []
    for rows in by_media(data).values():
        on, run = False, 0
        for r in rows:
            hit = r[6] <= 0.68 if on else r[6] >= 0.75
            run = run + 1 if hit else 0
            if hit and run >= 2:
                on = not on
            want.append((r[0], r[1], "PRIMARY" if on else "GUEST"))
    got = seg.hysteresis(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.media_id, r.seq, r.state_label) for r in got) == sorted(want)


def test_split_is_gapless_and_keeps_words(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(120))
    df = seg.complete(spark.createDataFrame([(1, 0, 10.0, 110.0, "A", text, 0.5), (1, 1, 120.0, 121.0, "A", "y" * 2000, 0.5)], SCHEMA))
    out = sorted(seg.split_long(df).collect(), key=lambda r: r.seq)
    parts = out[:-1]
    assert len(parts) > 1 and out[-1].text == "y" * 2000
    assert parts[0].start_sec == 10.0 and parts[-1].end_sec == 110.0
    assert all(a.end_sec == pytest.approx(b.start_sec) and a.end_sec > a.start_sec for a, b in zip(parts, parts[1:]))
    assert all(len(p.text) <= 1200 for p in parts)
    # every sentence is closed by a full stop, also the last, which has its own already
    assert " ".join(p.text for p in parts).split() == (text + ".").split()


def test_optimiser_is_stable_and_handles_edges(spark, data):
    odd = [(90, 0, 0.0, 0.0, None, None, None), (91, 0, 0.0, 1.0, "A", "   ", 0.1), (92, 0, 1.0, 2.0, "A", "Same.", 0.1), (92, 1, 300.0, 301.0, "B", "same. ", 0.1)]
    df = spark.createDataFrame([*data, *odd], SCHEMA)
    out = {(r.media_id, r.start_sec): r for r in seg.optimise(df).collect()}
    assert (92, 1.0) in out and (92, 300.0) not in out
    assert seg.optimise(df.limit(0)).count() == 0


def test_gap_clusters_at_the_threshold(spark):
    rows = [(1, 0, 0.0, 10.0), (1, 1, 130.0, 140.0), (1, 2, 260.5, 261.0), (2, 3, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, i int, start_sec double, end_sec double")
    got = {r.i: r.cluster for r in cluster.gap_clusters(df, "k", "i", 120).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1}


def test_range_join_equals_the_plain_join(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randrange(3), i, s := round(rng.uniform(0, 300), 1), round(s + rng.choice([0.0, 0.1, 5, 70]), 1)) for i in range(n)]
    a, b = make(80), make(70)
    schema = "k long, i int, start_sec double, end_sec double"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k").select("i", "r_i").collect()
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] > y[2] and x[2] < y[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_attribution_needs_a_margin(spark):
    profiles = spark.createDataFrame([("p", [1.0, 0.0], 0.6), ("q", [0.0, 1.0], 0.6)], "name string, centroid array<double>, threshold double")
    clusters = spark.createDataFrame([(0, 20.0, [1.0, 0.0]), (1, 20.0, [1.0, 0.97]), (2, 2.0, [1.0, 0.0])], "cluster int, seconds double, centroid array<double>")
    got = {r.cluster: r.label for r in speakers.attribute_clusters(clusters, profiles).collect()}
    assert got == {0: "p", 1: "Unknown", 2: "Unknown"}


def test_majority_prefers_the_first_of_equals(spark):
    rows = [(1, 5.0, "b", 0.5), (1, 1.0, "a", 0.7), (2, 1.0, "x", 0.2), (2, 2.0, "y", 0.4), (2, 3.0, "y", 0.6)]
    df = spark.createDataFrame(rows, "k int, start_sec double, label string, confidence double")
    got = {r.k: (r.label, r.votes, r.mean_confidence) for r in speakers.majority_label(df, ["k"]).collect()}
    assert got == {1: ("a", 1, 0.7), 2: ("y", 2, 0.5)}


def test_overlap_windows(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, True), (2, 0.0, 0.3, True), (3, 0.0, 9.0, False)], "i int, start_sec double, end_sec double, is_overlap boolean")
    got = seg.overlap_windows(df).groupBy("i").agg(F.count("*").alias("n"), F.max("end_sec").alias("e")).collect()
    assert {r.i: (r.n, r.e) for r in got} == {1: (4, 1.0), 2: (1, 0.3), 3: (1, 9.0)}


def test_folds_of_a_long_item_with_repeated_rows(spark):
    from lyrebird.operators.fold import fold_groups

    n = 30_000
    rows = [("m", i // 2, float(i % 10), "x" * 5) for i in range(n)] + [("m", 3, 6.0, "x" * 5)] * 2 + [(None, 1, 9.0, "y"), ("w", None, 9.0, "z")]
    df = spark.createDataFrame(rows, "k string, i int, w double, text string").repartition(4)
    step = lambda s, r: (s["sum"] + r["w"] > 40, F.struct(F.when(s["sum"] + r["w"] > 40, r["w"]).otherwise(s["sum"] + r["w"]).alias("sum")))
    out = fold_groups(df, "k", ["i"], {"w": F.col("w")}, F.struct(F.lit(0.0).alias("sum")), step)
    got = sorted((r.i, r.w, r.no) for r in out.filter("k = 'm'").collect())
    want, total, no = [], 0.0, 0
    for i, w in sorted((r[1], r[2]) for r in rows if r[0] == "m"):
        if total + w > 40:
            total, no = w, no + 1
        else:
            total += w
        want.append((i, w, no))
    assert got == want and out.count() == len(rows)
