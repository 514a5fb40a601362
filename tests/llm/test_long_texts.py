"""Texts that were once read again and again, and the pages that lost their text."""

import random
import re
import time

import pytest

from lyrebird.llm import secrets, urlfilter
from lyrebird.llm.html_text import main_text

WORDS = "<p>" + "plain words of an article " * 12 + "</p>"
#: The wider kinds with signed tokens in one pattern, as plain as can be.
PLAIN = re.compile(secrets.WIDE.pattern.replace("))|(?P<key>", r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))|(?P<key>"))


def seconds(run, *args):
    began = time.perf_counter()
    run(*args)
    return time.perf_counter() - began


@pytest.mark.parametrize("piece", ['<a ">"', "<a '>'\"", '<a b="', "<p ' \" ' >", '<a ">" \'<b>\''])
def test_unpaired_quotes_take_linear_time(piece):
    assert seconds(main_text, piece * (1_000_000 // len(piece))) < 15


def test_unpaired_quotes_end_tags_as_before():
    rng = random.Random(4)
    import lyrebird.llm.html_text as h

    for _ in range(3000):
        page = "".join(rng.choice(["<a ", "<p>", "</p>", '"', "'", ">", "x ", "<b ", "<!--", "-->", "< "]) for _ in range(rng.randrange(1, 30)))
        at, want, tags, got, here = 0, [], h._Tags(page), [], 0
        while m := h._TOKEN.search(page, at):
            want.append(m.span())
            at = m.end()
        while found := tags.next(here):
            got.append(found[:2])
            here = found[1]
        assert got == want, page


@pytest.mark.parametrize("text", ["eyJ-" * 250_000, "eyJabcdefgh." * 80_000, "eyJ" * 330_000 + ".abcdefgh.", "sk-eyJ_" * 150_000])
def test_heads_of_signed_tokens_take_linear_time(text):
    assert seconds(secrets.scan, text) < 15


def test_signed_tokens_stay_as_they_were():
    rng = random.Random(7)
    parts = ["eyJ", "abcdefgh", ".", "-", "_", " ", "é", "sk-", "ghp_" + "a" * 20, "-----BEGIN PRIVATE KEY-----", "x", "glpat-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [(s, e, t) for s, e, t in secrets._wide(text)] == [(m.start(), m.end(), bool(m["token"])) for m in PLAIN.finditer(text)], text


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id='aspnetForm'><div class='nav'>Menu</div>{WORDS * 3}<input><select><option>a</option></select></form></body>",
        f"<body><form><main>{WORDS}</main></form></body>",
        f"<body><form><fieldset><article>{WORDS}</article></fieldset></form></body>",
        f"<body><aside><article>{WORDS * 3}</article></aside></body>",
    ],
)
def test_a_form_that_holds_the_article_is_kept(page):
    assert main_text(page).count("plain") >= 12


def test_forms_beside_the_article_go():
    assert main_text(f"<article>{WORDS}<form>{WORDS}</form></article><form>{WORDS}</form>").count("plain") == 12
    assert main_text(f"<div>{WORDS * 3}</div><form><p>your name and mail</p></form>").count("your") == 0


def test_headings_named_like_boilerplate_are_text():
    page = f"<article><h2 id='related-work'>Related work</h2>{WORDS}<h2 id='search'>Search</h2>{WORDS}<section id='related-work'><h2>Related work</h2>{WORDS}</section></article>"
    assert main_text(page).count("plain") == 36 and main_text(page).split("\n")[0] == "Related work" and "Search" in main_text(page).split("\n")
    others = f"<article>{WORDS}<section id='comments'><h2>Comments</h2>{WORDS}</section><div id='related-articles'><h3>Related articles</h3>{WORDS}</div></article>"
    assert main_text(others).count("plain") == 12


def test_a_host_of_very_many_labels(spark):
    rules = spark.createDataFrame([("com", "/", "block"), ("b.com", "/a/", "allow")], "host string, path string, verdict string")
    host = "a." * 500_000
    pages = spark.createDataFrame([(1, f"http://{host}com/x"), (2, f"http://{host}b.com/a/x"), (3, f"http://{host}b.org/a/x"), (4, None)], "page_id long, url string")
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {1: ("com/", "block"), 2: ("b.com/a/", "allow"), 3: (None, "allow"), 4: (None, "allow")} and time.perf_counter() - began < 60


def test_rows_of_one_key_aren_t_joined_in_one_task(spark):
    """A list over the broadcast threshold, and one key that nearly all rows share."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rules = spark.createDataFrame([("com", "/", "block")] + [(f"h{i}.org", "/", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://x.com/{i}") for i in range(4000)] + [(5000 + i, f"http://h{i}.org/") for i in range(200)] + [(9000 + i, f"http://other.net/{i}") for i in range(100)], "page_id long, url string").repartition(8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        out = urlfilter.judge_urls(pages, rules)
        got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: ("com/", "block") for i in range(4000)} | {5000 + i: (f"h{i}.org/", "block") for i in range(200)} | {9000 + i: (None, "allow") for i in range(100)}
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
