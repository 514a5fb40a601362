"""Column functions on small inline rows, with each threshold's boundary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lyrebird.functions import keys, quality, text, time, vector


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v if hasattr(v, "_jc") else F.lit(v))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  hello   world [Music] (laughs) ok .Next one", "Hello world   ok. Next one"),
        ("", ""),
        (None, ""),
        ("a\n\nb ! C", "A b! C"),
        ("x.y", "X.y"),
    ],
)
def test_clean_transcript(spark, raw, want):
    assert one(spark, text.clean_transcript(F.col("t")), t=F.lit(raw).cast("string")) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ßheit ß", "ẞheit ß"), ("ﬁn", "ﬁn"), ("ŉa", "ŉa"), ("ᾀ", "ᾈ"), ("ᾧ", "ᾯ"), ("ᾳ", "ᾼ"), ("ῃ", "ῌ"), ("ῳ", "ῼ"), ("ᾈa", "ᾈa"), ("ǆa", "Ǆa"), ("äb", "Äb"), ("𐐨", "𐐀"), ("", "")],
)
def test_first_letter_stays_one_character(spark, raw, want):
    assert one(spark, text.clean_transcript(F.col("t")), t=F.lit(raw)) == want


def test_clean_segment_closes_long_texts_only(spark):
    clean = text.clean_segment(F.col("t"))
    assert one(spark, clean, t="x" * 20) == "x" * 20
    assert one(spark, clean, t="x" * 21) == "x" * 21 + "."
    assert one(spark, clean, t="is this a question for you?") == "is this a question for you?"


def test_word_functions(spark):
    assert one(spark, text.word_count(F.col("t")), t="  a b\t c \n") == 3
    assert one(spark, text.word_count(F.col("t")), t="   ") == 0
    assert one(spark, text.token_estimate(F.col("t")), t="a b c") == 3
    assert one(spark, text.word_blocks(F.col("t"), 2), t="a b c d e") == ["a b", "c d", "e"]
    assert one(spark, text.word_blocks(F.col("t"), 2), t=" ") == []


def test_preview_and_highlight(spark):
    assert one(spark, text.preview(F.col("t"), 3), t="abc") == "abc"
    assert one(spark, text.preview(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, text.highlight(F.col("t"), "of C++ abc"), t="ABC of c++") == "<mark>ABC</mark> of <mark>c++</mark>"


def test_wildcards_in_a_query_are_literal(spark):
    from lyrebird.operators.search import contains

    assert one(spark, contains(F.col("t"), "50%"), t="costs 50% more") is True
    assert one(spark, contains(F.col("t"), "50%"), t="costs 50 or more") is False
    assert one(spark, contains(F.col("t"), "a_b"), t="axb") is False


def test_match_classes(spark):
    from lyrebird.operators.search import match_class

    for t, want in (("the Fox", 1), ("a fox.", 2), ("foxes", 3)):
        assert one(spark, match_class(F.col("t"), "Fox"), t=t) == want


def test_clock_strings(spark):
    s = F.col("s")
    assert one(spark, time.m_ss(s), s=3675.9) == "61:15"
    assert one(spark, time.parse_m_ss(F.col("t")), t="61:15") == 3675
    assert one(spark, time.parse_m_ss(F.col("t")), t="") is None
    assert one(spark, time.h_mm_ss(s), s=59.0) == "0:59"
    assert one(spark, time.h_mm_ss(s), s=3600.0) == "1:00:00"
    assert one(spark, time.hh_mm_ss(s), s=F.lit(None).cast("double")) == "00:00:00"
    assert one(spark, time.cue_time(s), s=90061.5) == "25:01:01,500"
    assert one(spark, time.parse_cue_time(F.col("t")), t="01:02:03,5") == 3723.5
    assert one(spark, time.parse_cue_time(F.col("t")), t="02:03.250") == 123.25
    assert one(spark, time.parse_cue_time(F.col("t")), t="nonsense") is None
    assert one(spark, time.iso_duration(F.col("t")), t="PT1H2M3S") == 3723
    assert one(spark, time.iso_duration(F.col("t")), t="1:02") is None


def test_recency_boost_is_capped(spark):
    at = F.expr("TIMESTAMP '2024-01-31'")
    boost = lambda days, kind, sim: one(spark, time.recency_boosted(F.col("s"), F.col("p"), F.col("k"), at), s=sim, p=F.expr(f"TIMESTAMP '2024-01-31' - INTERVAL {days} DAYS"), k=kind)
    assert boost(365, "zoom", 0.5) == pytest.approx(0.5 * 1.10)
    assert boost(366, "zoom", 0.5) == pytest.approx(0.5 * 1.05)
    assert boost(731, "youtube", 0.5) == pytest.approx(0.5 * 1.05)
    assert boost(731, "zoom", 0.5) == pytest.approx(0.5)
    assert boost(1, "youtube", -0.5) == pytest.approx(0.5 * 1.15)
    assert boost(1, "youtube", 0.95) == 1.0


def test_content_hash_parts(spark):
    import hashlib

    h = lambda **v: one(spark, keys.content_hash(F.col("i"), F.col("d") if "d" in v else None), **v)
    assert h(i="video123") == hashlib.md5(b"video123").hexdigest()
    assert h(i="video123") != h(i="video456")
    a, b = (h(i="video123", d=F.lit(dt.datetime(2024, 1, d))) for d in (1, 2))
    assert a != b


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.youtube.com/watch?v=abcdefghij_&t=3s", "abcdefghij_"),
        ("https://youtu.be/abcdefghij-?si=x", "abcdefghij-"),
        ("https://youtube.com/embed/abcdefghijk", "abcdefghijk"),
        ("https://youtube.com/shorts/abcdefghijk", "abcdefghijk"),
        ("abcdefghijk", "abcdefghijk"),
        ("https://example.com/", None),
    ],
)
def test_video_id(spark, url, want):
    assert one(spark, keys.video_id(F.col("u")), u=url) == want


def test_links_and_labels(spark):
    link = keys.deep_link(F.col("u"), F.col("s"), F.col("k"))
    assert one(spark, link, u="u", s=12.7, k="youtube") == "u&t=12s"
    assert one(spark, link, u="u", s=0.0, k="youtube") == "u"
    assert one(spark, link, u="u", s=12.7, k="zoom") == "u"
    assert one(spark, keys.base_url(F.col("u")), u="u&t=12s") == "u"
    for raw, want in (("ch", "PRIMARY"), ("HOST", "PRIMARY"), ("g1", "GUEST"), (None, "GUEST"), ("Bob", "Bob")):
        assert one(spark, keys.normal_label(F.col("l")), l=F.lit(raw).cast("string")) == want


def test_quality_boundaries(spark):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert one(spark, quality.low_confidence(a, b), a=-0.35, b=1.0) is True
    assert one(spark, quality.low_confidence(a, b), a=-0.34, b=2.39) is False
    assert one(spark, quality.needs_refinement(a, b, c), a=-0.1, b=1.0, c=0.8) is True
    assert [one(spark, quality.not_short(a), a=F.lit(x).cast("int")) for x in (None, 0, 119, 120)] == [True, True, False, True]
    assert [one(spark, quality.preset(a, b), a=x, b=y) for x, y in ((20.0, False), (20.1, False), (30.0, True))] == ["short", "monologue_long", "interview"]
    assert [one(spark, quality.confidence_band(a, b), a=x, b=y) for x, y in ((0.86, 5), (0.86, 4), (0.85, 5), (0.75, 9))] == ["high", "medium", "medium", "low"]
    assert [one(spark, quality.clamp(a), a=x) for x in (-1.0, 0.5, 2.0)] == [0.0, 0.5, 1.0]
    assert one(spark, quality.captions_accepted(a), a=True) is False
    assert one(spark, quality.captions_accepted(a), a=False) is True


def test_transcript_score(spark):
    issues = quality.transcript_issues(F.col("t"), F.col("s"))
    assert one(spark, issues, t="too few", s=5.0) == ["too_short", "low_punctuation"]
    assert one(spark, quality.transcript_score(issues), t="too few", s=31.0) == 20
    good = "This is a fine sentence, with marks. It has enough words to pass the test."
    assert one(spark, issues, t=good, s=5.0) == []
    assert one(spark, quality.needs_upgrade(issues), t=good, s=5.0) is False
    assert "repetitive" in one(spark, issues, t="go go, go go, go go, go go, go go, go go.", s=1.0)


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    a, b = F.col("a"), F.col("b")
    assert one(spark, vector.cosine(a, b), a=v(0.0, 0.0), b=v(1.0, 0.0)) == 0.0
    assert one(spark, vector.cosine(a, b), a=v(2.0, 0.0), b=v(5.0, 0.0)) == pytest.approx(1.0)
    assert one(spark, vector.guarded_cosine(a, b), a=v(1.0, 0.0, 9.0), b=v(1.0, 0.0)) == pytest.approx(1.0)
    assert one(spark, vector.l2(a, b), a=v(0.0, 3.0), b=v(4.0, 0.0)) == 5.0


def test_answer_confidence_without_citations_is_zero(spark):
    from lyrebird.operators.answer import confidence

    c = confidence(*(F.lit(x) for x in (0.9, 0, 0, 0.9, 6, 4, True)))
    assert one(spark, c) == 0.0
    assert one(spark, confidence(*(F.lit(x) for x in (0.9, 4, 4, 0.9, 6, 4, True)))) == 1.0
    assert one(spark, confidence(*(F.lit(x) for x in (0.8, 1, 2, 0.25, 2, 0, False)))) == pytest.approx(0.2)


def test_rates(spark):
    from lyrebird.operators import monitor

    assert one(spark, monitor.real_time_factor(F.lit(600.0), F.lit(3600.0))) == pytest.approx(1 / 6)
    assert one(spark, monitor.real_time_factor(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, monitor.throughput(F.lit(180000.0), F.lit(3600.0))) == 50.0
    assert one(spark, monitor.throughput(F.lit(1000.0), F.lit(0.0))) == 0.0
    assert one(spark, monitor.quota_estimate(F.lit(10))) == 420.0
