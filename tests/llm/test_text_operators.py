"""Secrets, toxicity, decontamination and the archive against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.llm import decontam, secrets, toxicity, warc

DOCS = "doc_id long, text string, source string, spans int, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows], DOCS)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["token", "=", ": ", '"', "'", " ", "secret", "API_KEY", "apikey", "passwd", "AKIA" + "A1" * 8, "AKIAX", "abcdef12" * 4, "deadbeef", "xyz12345", "é", "\n", "ſecret", "to\u212aen", "Password=", "x" * 9, "-----BEGIN RSA PRIVATE KEY-----", "gh_", "sk-"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), f"s{i % 4}") for i in range(400)] + [(900, None, None), (901, "", "a"), (1, "token=abcdefgh", "a")]
    got = secrets.digest(secrets.scan_corpus(docs(spark, rows))).collect()
    want = sorted((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == want
    assert secrets.scan_corpus(docs(spark, rows).limit(0)).collect() == []


def test_copied_examples_and_live_secrets(spark):
    live, copied = "ghp_" + "a1B2" * 8, "ghp_" + "EXAMPLE0" * 4
    rows = [(0, f"x {live} y", "o1"), *((i, f"see {copied} here", f"o{i}") for i in range(1, 8))]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_corpus(docs(spark, rows))).collect()}
    assert got[0].spans == f"token:2:{2 + len(live)}" and got[1].spans == "" and got[0].n_live == 1
    clean = secrets.redact_corpus(docs(spark, [*rows, (99, None, "o"), (98, "plain", "o")]))
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[0] == "x [secret] y" and text[1] == f"see {copied} here" and text[99] is None and text[98] == "plain"
    assert clean.columns == ["doc_id", "text", "source", "spans", "kind"]


def test_redact_overlapping_spans():
    assert secrets.redact("abcdefghij", [(1, 4), (2, 6), (8, 9)], "#") == "a#gh#j"


def test_many_repositories_make_an_example(spark):
    few, many = "ghp_" + "a1B2" * 6, "ghp_" + "c3D4" * 6
    df = docs(spark, [(1, f"x {few} y", "s"), *((i, f"x {many} y", "s") for i in range(10, 14))])
    got = {r.doc_id: r for r in secrets.scan_corpus(df, max_repos=3).collect()}
    assert [(s.live, s.n_owners, s.n_repos) for s in got[1].spans] == [(True, 1, 1)]
    assert all(not got[i].spans for i in range(10, 14))
    texts = {r.doc_id: r.text for r in secrets.redact_corpus(df, max_repos=3).collect()}
    assert texts[1] == "x [secret] y" and texts[10] == f"x {many} y"
    assert {r.n_repos for r in secrets.ownership(secrets.find_candidates(df)).collect()} == {1, 4}


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = np.random.default_rng(5)
    clean = [f"w{i}" for i in range(400)]
    bad = ["idiot", "moron", "stupid", "scum", "loser"]

    def text(toxic):
        words = list(rng.choice(clean, rng.integers(30, 200)))
        if toxic:
            for at in rng.integers(0, len(words), max(2, len(words) // 40)):
                words[at] = rng.choice(bad)
        return " ".join(words)

    y = [int(i % 8 == 0) for i in range(1200)]
    return [(i, text(t), t) for i, t in enumerate(y)]


def test_toxicity_on_held_out_rows_and_misspellings(spark, toxic_corpus):
    rows = [(i, t, "s") for i, t, _ in toxic_corpus] + [(5001, None, None), (5002, "", "s"), (5003, "w1 w2 w3 you stupidd mor0n w4 w5 w6 idiott w7 w8", "s"), (None, "w1 w2", "s")]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in toxic_corpus] + [(5002, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in toxic_corpus}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert got[5003].predicted == 1
    assert got[5001].score == got[5002].score and 0 <= got[5001].score <= 1
    assert got[None].held_out is False
    kept = toxicity.keep_clean(docs(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "source", "spans", "kind"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_reads_long_words_to_their_end(toxic_corpus):
    model = toxicity.train([t for _, t, _ in toxic_corpus], [y for _, _, y in toxic_corpus])
    scorer = toxicity.Scorer(model)
    for clean in (".".join(f"w{i}" for i in range(100, 140)), "天気がいいので散歩に行きます" * 4):
        assert len(toxicity.spelled(clean)) > 40
        assert scorer.score(clean + ".you.stupid.idiot.moron." * 8) > scorer.score(clean) + 0.2
    for word in ("天気é" * 300 + "x", "ab" * 250, "𝒳\ud800y" * 200):
        w = f"<{word}>"
        slow = [zlib.crc32(g.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS for g in (w, *(w[i : i + n] for n in toxicity.SIZES for i in range(len(w) - n + 1)))]
        assert toxicity.ngrams_of(word) == slow
    scorer.score("z" * 1000)
    assert max(map(len, scorer)) <= toxicity.CACHED_CHARS


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(docs(spark, [(1, "a", "s")]), labels).collect()] == [0.0]
    assert toxicity.score_documents(docs(spark, [(1, "a", "s")]).limit(0), labels).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute_contamination(rows, items, width):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for k in range(max(1, len(b) - width + 1) if b else 0):
                win = b[k : k + width]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [10, 1_500_000])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", block)
    rng = random.Random(6)
    vocab = ["a", "b", "É", "é", "x9", "the"]
    line = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, line(rng.choice([0, 1, 3, 4, 5, 9]))) for k in range(25)] + [(77, None), (78, "!!"), (3, "a b a b")]
    rows = [(i, line(rng.randint(0, 60))) for i in range(120)] + [(500, None), (501, "..."), (5, "THE the The")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = docs(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    want = brute_contamination(rows, items, 4)
    assert sorted(map(tuple, decontam.contamination(df, bench, 4).collect())) == want
    monkeypatch.setattr(decontam, "SLICE_BYTES", 60)
    assert sorted(map(tuple, decontam.contamination(df, bench, 4).collect())) == want


def test_proximity_matches(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    df = docs(spark, [(1, "red green blue", "s"), (2, "x blue y red z green", "s"), (3, "red q q q q q q q green blue", "s"), (4, "blue red", "s")])
    got = {r.doc_id: [(m.kind, m.start, m.end) for m in r.found] for r in decontam.find_matches(df, bench, 13, slack=3).collect()}
    assert got == {1: [("exact", 0, 3)], 2: [("near", 1, 6)], 3: [], 4: []}
    assert decontam.contamination(df.limit(0), bench).collect() == []
    assert all(not r.contaminated for r in decontam.contamination(df, bench.limit(0)).collect())


def test_archive_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "u1", big), (2, "u\r\n2", big), (3, None, other), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, "u7", "x\r\n\r\ny" * 300), (2, "u\r\n2", big), (None, "u8", other), (8, "u9", "a" * 999)]
    pages = spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id long, url string, html string, record_type int")
    records, payloads = warc.write_archive(pages)
    assert payloads.count() == len({(h or "").encode() for _, _, h in rows})
    assert records.count() == len(rows)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(records, payloads).collect())
    want = []
    top = {big: 2, other: 3, "x\r\n\r\ny" * 300: 7}
    seen = set()
    for i, _, h in rows:
        body = (h or "").encode()
        again = h in top and (i != top[h] or (h, i) in seen)
        seen.add((h, i))
        want.append((i or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    record = next(r.record for r in warc.rebuild(records, payloads).collect() if b"X-Page-Id: 4" in bytes(r.record))
    assert bytes(record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(record).endswith(b"\r\n\r\nsmall\r\n\r\n")
    assert warc.read_archive(*warc.write_archive(pages.limit(0))).collect() == []


def test_a_damaged_payload_is_found(spark):
    pages = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    records, payloads = warc.write_archive(pages)
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(records, payloads.withColumn("payload", F.lit("jello").cast("binary"))).collect()
