"""Nearest neighbours against a full scan, the contract queries against their SQL, and the pipeline's stages."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lyrebird.llm import ann, queries

TABLES = "documents embeddings pages benchmark labels".split()


def full_scan(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q, v in asked:
        d = np.sqrt(((x - np.asarray(v, np.float64)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def search(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df.repartition(3), df.filter("vec_id % 100 = 0"), k).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in got.items()}


def test_recall_and_exact_scores(spark, medium):
    e = spark.read.parquet(f"{medium}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    want = full_scan(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {}
    by = defaultdict(list)
    for r in queries.queries()["op10_nearest_neighbours"](spark, medium).collect():
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    got = {q: [(v, s) for _, v, s in sorted(x)] for q, x in by.items()}
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert all(s == dict(want[q]).get(v, s) for q in want for v, s in got[q])


def test_equal_vectors_bad_vectors_and_few_rows(spark):
    rng = np.random.default_rng(8)
    same = [float(x) for x in rng.standard_normal(6).astype(np.float32)]
    good = [(i, same if i % 3 == 0 else [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(900)]
    bad = [(1000, None), (1001, [0.0] * 6), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (None, same)]
    got = search(spark, good + bad)
    want = full_scan(good, [r for r in good if r[0] % 100 == 0], 10)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / 90 >= 0.95
    assert got[300] == want[300]  # a third of all rows are equal to it: the smallest ids win
    few = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [5.0, 5.0]), (3, [1.0, 2.0, 3.0])]
    assert search(spark, few) == {0: [(1, 1.0), (2, 5.0)]}
    assert search(spark, [(7, [1.0])]) == {}


def test_codes_survive_packing():
    codes = np.random.default_rng(1).integers(0, 16, (50, 7)).astype(np.uint8)
    assert (ann.unpack_codes(ann.pack_codes(codes), 7) == codes).all()


def test_anisotropic_codes_lower_the_parallel_error():
    x = np.random.default_rng(2).standard_normal((2000, 64))
    plain, aware = ann.Quantiser.fit(x), ann.Quantiser.fit(x)
    plain.eta = 1.0

    def parallel(q):
        codes = q.encode(x)
        near = np.stack([q.centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1).reshape(x.shape)
        return (((x - near) * x).sum(axis=1) ** 2 / (x**2).sum(axis=1)).mean()

    assert parallel(aware) < parallel(plain)


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_contract_query_equals_its_sql(spark, medium, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    got, want = queries.queries()[name](spark, medium), con.sql(queries.oracle_sql()[name])
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stages_keep_what_they_must(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        rows = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == columns
        assert set(rows) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(rows)
            assert sum(labels.get(i, 1) for i in gone) >= 0.6 * len(gone)
        if name == "near_duplicates":
            from tests.llm.test_ngram_join import brute

            groups = brute(sorted(before.items()), 5, 80, 100)
            assert set(rows) == {i for i, (_, root) in groups.items() if root == i}
        if name == "secrets":
            assert set(rows) == set(before)
        else:
            assert all(rows[i] == before[i] for i in rows)
        docs, before = spark.createDataFrame(out.collect(), out.schema), rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_pipeline_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
