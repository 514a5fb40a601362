"""Filter audit, mixing and centroid clustering against SQL and brute force, odd tables included."""

import hashlib
import math
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.llm import centroids, filter_audit, mixing, queries
from tests.test_oracle import rows

ORDERS = ["".join(p) for p in permutations("ABCDE")]


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op13_centroid_clustering"])
def test_query_equals_its_sql(spark, medium, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    got, want = queries.queries()[name](spark, medium), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


# --- filter audit


def plain_audit(docs, labels):
    texts = {}
    for i, _, t in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    out, masks = {}, []
    for i, source, t in docs:
        t = t or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t) if w]
        fails = {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), t in texts and (i is None or texts[t] < i))) if bad}
        masks.append((source or "", fails, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    for order in ORDERS:
        for part, fails, good, toxic in masks:
            for n in range(5):
                r = out.setdefault((part, order, n + 1), Counter())
                f, before = order[n], any(g in fails for g in order[:n])
                r["kept"] += not before and f not in fails
                r["removed"] += f in fails and not before
                r["redundant"] += f in fails and before
                r["unique_fails"] += fails == {f}
                r["good_lost"] += f in fails and not before and good
                r["toxic_lost"] += f in fails and not before and toxic
    shapley = Counter()
    for (part, order, step), r in out.items():
        shapley[part, order[step - 1]] += r["removed"]
    for (part, order, step), r in out.items():
        r["shapley"] = shapley[part, order[step - 1]]
    return out


def odd_documents():
    long = " ".join(f"w{i}" for i in range(400))
    deep = "é" * 300 + "x" * 3000 + "y" * 20_000
    docs = [(i, f"s{i % 3}", long + (" same" if i % 2 else f" {i}")) for i in range(40)]
    docs += [(None, None, long + " same"), (100, "", None), (101, None, ""), (102, "s0", "A # " * 90), (102, "s0", "A # " * 90), (102, "s1", "other"), (None, "s1", None)]
    docs += [(200, "s2", deep + "a"), (201, "s2", deep + "b"), (202, "s2", deep + "a"), (203, "s2", "z" + deep), (204, "s2", deep + "a")]
    docs += [(300 + i, "hot", "copied text of many") for i in range(700)] + [(None, "hot", "copied text of nobody")] * 3
    labels = [(1, 1, 0), (1, 0, 1), (3, 0, 1), (102, 1, 1), (300, 1, 0), (350, 1, None), (360, None, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("modulus", [None, 1, 2])
def test_audit_equals_a_walk_of_all_orders(spark, modulus):
    """With a modulus the hashes collide: only whole texts tell rows of a class apart."""
    docs, labels = odd_documents()
    if modulus:
        docs = [d for d in docs if d[1] != "hot"][:30] + docs[40:55]
    want = plain_audit(docs, labels)
    table = spark.createDataFrame([(*d, "n", 3, False) for d in docs], "doc_id long, source string, text string, key string, rows int, alive boolean").repartition(5)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), modulus).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == {k: [r[c] for c in names] for k, r in want.items()}


def test_large_classes_are_shared_out(spark):
    """Rows of one text that lie in one class are compared in shares, each with the smallest row's text."""
    docs = spark.createDataFrame([(i, "p", "same text") for i in range(1500)] + [(5000 + i, "p", "same tex" + c) for i, c in enumerate("xyzxyz")], "doc_id long, part string, text string").repartition(4)
    keyed = docs.withColumn("key", F.lit(1)).withColumn("mask", F.lit(0))
    classes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    got = filter_audit._compared(keyed.select("key", "doc_id", "part", "mask", "text"), classes)
    found = {r.doc_id: (r.same, r.mask) for r in got.collect()}
    assert len(found) == 1506 and found[0] == (True, 0) and all(found[i] == (True, 16) for i in range(1, 1500)) and not any(found[i][0] for i in range(5000, 5006))
    assert filter_audit.duplicates(docs, 1).filter("mask >= 16").count() == 1499 + 3


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    out = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.collect() == [] and out.columns[:3] == ["part", "filter_order", "step"]


# --- mixing


def plain_targets(docs):
    size = Counter()
    for _, source, text in docs:
        size[source] += len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w])
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        left = total - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            return size, target
        full |= over


def mixed_documents(n=900, sources=9, seed=3):
    rng = np.random.default_rng(seed)
    names = [None, "", *(f"s{i}" for i in range(sources - 2))]
    out = []
    for i in range(n):
        source = names[2] if i % 3 == 0 else names[int(rng.integers(0, len(names)))] if i % 50 else "tiny"
        words = int(rng.choice([0, 1, 7, 40, 300, 2500], p=[0.05, 0.1, 0.2, 0.4, 0.2, 0.05])) + int(rng.integers(0, 3))
        out.append((i, source, None if i % 41 == 0 else "\t".join(["wörd"] * min(words, 3 if source == "tiny" else words))))
    return out + [(7, "s1", "a b c"), (7, "s1", "a b c"), (None, "s2", "x y")]


def test_mix_meets_its_targets(spark):
    docs = mixed_documents()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, source string, text string, key string, place int").repartition(6)
    size, target = plain_targets(docs)
    out = mixing.mix(df).collect()
    assert len(out) == len(docs)
    source = {(i, len((t or "").split())): s for i, s, t in docs}
    taken, cut = Counter(), Counter()
    by_size = {}
    for r in out:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-12) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        cut[s] += r["size"] > 0 and r.taken % r["size"] > 0
        by_size.setdefault((s, r["size"]), []).append(r)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size) and max(cut.values()) <= 1
    assert {math.isclose(target[s], 3 * size[s]) for s in size if size[s]} == {True, False}
    for same in by_size.values():
        whole = [r.taken // r["size"] for r in same if r["size"] and r.taken % r["size"] == 0]
        assert not whole or max(whole) - min(whole) <= 1


def test_rates_are_exponential_in_size(spark):
    docs = mixed_documents(600, 5, 8)
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    source = {(i, len((t or "").split())): s for i, s, t in docs}
    slopes, sums, target = {}, Counter(), {}
    for r in out:
        s = source[r.doc_id, r["size"]]
        sums[s] += r.rate * r["size"]
        target[s] = r.target
        if r["size"] and r.rate < 3:
            slopes.setdefault(s, []).append(math.log(r.rate) / r["size"])
    assert len(slopes) >= 3
    for v in slopes.values():
        assert max(v) - min(v) < 1e-6 * max(1.0, abs(v[0]))
    assert all(abs(sums[s] - target[s]) <= 0.5 + 2e-6 * target[s] for s in target)


def test_mix_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(mixed_documents(500, 6, 5), "doc_id long, source string, text string")
    first = Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))
    assert first == Counter(map(tuple, mixing.mix(df.repartition(17, "text")).collect()))


def test_mix_of_odd_tables(spark):
    ddl = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], ddl)).collect() == []
    none = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " \t")], ddl)).collect()
    assert {(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in none} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    one = mixing.mix(spark.createDataFrame([(1, "a", "x " * 70)], ddl)).collect()
    assert [(r.taken, r.target) for r in one] == [(70, 70.0)]
    hot = mixing.mix(spark.createDataFrame([(i, "a", "x y z") for i in range(3000)] + [(9000, "b", "q " * 9000)], ddl)).collect()
    got = Counter()
    for r in hot:
        got[r.source_size] += r.taken
    assert sum(got.values()) == 18_000 and len({r.taken for r in hot if r["size"] == 3}) <= 3


def test_mix_plan_has_no_python(spark, small):
    plan = queries.op12_entropy_mixing(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- centroids


def plain_clusters(data, k, rounds):
    kept = [(i, [int(math.floor(256 * x)) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[1]))[:k]
    c = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(near(v)[1], []).append(v)
        for n, vs in parts.items():
            c[n] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    total, per = sum(d for _, d, _ in found), Counter()
    for _, d, n in found:
        per[n] += d
    fits = lambda x: x if x < 1 << 63 else None
    return Counter((i, n, fits(d), fits(per[n]), fits(total), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found)


def vectors(scale, n=120, seed=2):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in (rng.standard_normal(64) * scale).round(3)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e7, 1e30], ids=["float64", "below 2^53", "integers", "any size"])
def test_clusters_equal_plain_integers(spark, scale):
    data = vectors(1.0, 40, 9) + [(1000 + i, v) for i, v in vectors(scale)]
    got = centroids.clusters(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4), k=6, rounds=3)
    assert Counter(map(tuple, got.collect())) == plain_clusters(data, 6, 3)


def test_clusters_of_odd_rows(spark):
    data = vectors(1.0, 30)
    v = data[0][1]
    data += [(1, v), (1, v), (None, data[3][1]), (None, v), (500, None), (501, v[:63]), (502, [*v[:63], None]), (503, [*v[:63], float("nan")]), (504, [*v[:63], float("inf")]), (505, []), (506, [0.0] * 64), (507, [-0.001] * 64)]
    df = spark.createDataFrame([(i, e, 3, "c") for i, e in data], "vec_id long, embedding array<double>, cluster int, kind string").repartition(3)
    assert Counter(map(tuple, centroids.clusters(df, k=50, rounds=2).collect())) == plain_clusters(data, 50, 2)
    assert centroids.clusters(df.limit(0)).collect() == [] and centroids.clusters(df.filter("vec_id = 500")).collect() == []


def test_tied_distances_go_to_the_smaller_number():
    x = np.array([[0] * 64, [5] + [0] * 63])
    c = np.array([[2] + [0] * 63, [-2] + [0] * 63, [8] + [0] * 63, [2] + [0] * 63], object)
    label, distance = centroids.nearest(x, c)
    assert label.tolist() == [0, 0] and distance.tolist() == [4, 9]
    big = np.array([[10**30] + [0] * 63], object)
    assert centroids.nearest(big, c)[1].tolist() == [(10**30 - 8) ** 2]


def test_blocks_round_trip():
    for x in (np.array([[1, -2] + [0] * 62]), np.array([[1 << 20] * 64]), np.array([[-(1 << 50)] * 64]), np.array([[1 << 80] * 64], object)):
        assert (centroids.unpack(*centroids.pack(x)) == x).all()
    assert [centroids.pack(np.array([[n] * 64]))[0] for n in (32767, 32768, 1 << 31)] == ["<i2", "<i4", "<i8"]
