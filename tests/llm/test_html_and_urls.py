"""Page extraction on hand-made pages, and the url filter against a plain program."""

import random

import pytest

from lyrebird.llm import html_text
from lyrebird.llm.html_text import extract, main_text, text_blocks
from lyrebird.llm.urlfilter import bloom_words, judge_urls, possible

PARA = "This paragraph has quite enough words to count as the running text of an article. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>A &amp; B</h1><p>One  <b>two</b>\n three</p><p>&lt;x&gt;&nbsp;y</p></article>", "A & B\nOne two three\n<x> y"),
        ("<nav>Menu</nav><article><p>a<br>b</p><aside>side</aside><div class='ad'>Buy</div><p>c</article><footer>f</footer>", "a\nb\nc"),
        ("<article><p>kept</p><section id='comments'><p>Nice!</p></section><form>Your name <input></form><p>end</p></article>", "kept\nend"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>", "Title\nx"),
        ("<article><p>x</p><script>if (a < b) '</article>'</script><style>p{}</style><!-- <p>no</p> --><p>y</p>", "x\ny"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1</td><td>c2</td></tr></table></article>", "one\ntwo\nc1\nc2"),
        ("<article class=teaser><p>short</p></article><article><p>" + PARA + "</p></article>", PARA.strip()),
        ("<main><p>in main</p></main><div class='cookie-notice'>cookies</div>", "in main"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut</p><p class='x", "cut"),
        ("<article><p title='a > b'>q</p></article>", "q"),
        ("<article><p>a <svg class=i/> b</p><video src=x>old</video><iframe src=y></article>c", "a b"),
        ("<title>T</title><article><noscript>turn it on</noscript><p>x<p>y</article>", "x\ny"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_line_blocks_without_marked_article():
    page = "<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><div><h2>Head</h2><p>" + PARA * 2 + "</p><p>Ok.</p><p>" + PARA + "</p></div><div class=sidebar>Links</div><p>tiny</p>"
    out = main_text(page).split("\n")
    assert out[-3:] == [(PARA * 2).strip(), "Ok.", PARA.strip()] and "Head" in out and "tiny" not in out
    assert text_blocks([0, 5, 90, 0, 0, 0, 3, 0, 0, 0], 80) == [(0, 3)]
    assert text_blocks([], 80) == []


def test_surges_choose_among_marked_containers():
    a, b, c = (f"{n} {PARA.strip()} {PARA.strip()}" for n in ("One.", "Two.", "Three."))
    # an article spread over siblings, with a teaser that doesn't surge between them
    assert main_text(f"<article><h2>H</h2><p>{a}</article><article><a href=x>More</a></article><article><p>{b}</p><p>Ok.</article>") == f"H\n{a}\n{b}\nOk."
    # the mark stands on a teaser, the text is in the main element around it, or in no container
    assert main_text(f"<main><p>{a}</p><article><p>tease</article><p>{b}</main>") == f"{a}\ntease\n{b}"
    assert main_text(f"<div class='post-meta'>by me</div><p>{a}</p><p>{b}</p>").endswith(f"{a}\n{b}")
    # two halves under one class name
    assert main_text(f"<div class=entry><p>{a}</div><div class=ad>x</div><div class=entry><p>{b}</p></div>") == f"{a}\n{b}"
    # a marked article with most of the surging text is kept alone
    assert main_text(f"<p>{c}</p><article><p>{a}</p><p>{b}</article>") == f"{a}\n{b}"


@pytest.mark.parametrize("name", ["class='page with-sidebar'", "class=no-sidebar", "class='has-banner'", "class=content-header-fixed", "id='search-and-content'", "id=sidebarPage class='x noSidebar'"])
def test_layout_names_around_the_text_skip_nothing(name):
    text = f"{PARA.strip()} {PARA.strip()}"
    for tag in ("article", "main", "section"):
        page = f"<nav>Menu</nav><div {name}><div class=toolbar-holder><div class=ad>Buy</div><{tag}><h1>H</h1><p>{text}</p></{tag}></div></div><footer>f</footer>"
        assert main_text(page.replace(" class=toolbar-holder", "")) == f"H\n{text}"
        assert main_text(page) == f"H\n{text}"


def test_names_still_mark_boilerplate():
    text, other = f"One. {PARA.strip()}", f"Two. {PARA.strip()} {PARA.strip()}"
    for box in (f"<div class=comments><article><p>{other}</article></div>", f"<div class='sidebar'><p>{other}</div>", f"<div id=related-posts><article>{other}</article></div>"):
        assert main_text(f"<article><p>{text}</article>{box}") == text
        assert main_text(f"<div class=post><p>{text}</div>{box}") == text
        assert main_text(f"<nav class=with-sidebar><p>{other}</nav><p>{text}") == text


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", "<article>é</article>", 5), (1, "u", "<article>é</article>", 5), (2, None, None, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    assert extract(df.limit(0)).collect() == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.org", "", "block")]


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_equal_a_plain_program(spark):
    urls = ["http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "http://example.com", "http://example.com/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/es/", "http://x.net/fr/", None, "", "no scheme", "a://b://c.com/", "http://b.org?q", "http://a.b.org/x", "http://com./", "http:///path", "http://é.com/É?", "http://x.com\n/y"]
    rows = [(i, u, "h", 1) for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, rules).collect()}
    assert got == {i: plain(u) for i, u, _, _ in rows}
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rules).collect() == []


def test_bloom_never_misses(spark):
    from pyspark.sql import functions as F

    keys = spark.range(2000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("key"))
    words = F.from_json(F.lit(bloom_words(keys, 64).select(F.to_json("bloom")).first()[0]), "array<long>")
    hits = spark.range(20000).select("id", possible(F.concat(F.lit("host"), F.col("id").cast("string")), words, 64).alias("p")).collect()
    assert all(r.p for r in hits if r.id < 2000)
    assert sum(r.p for r in hits if r.id >= 2000) < 900


def test_surge_and_dive_equal_brute_force():
    """A run is a longest stretch of windows with text, counted from its first window; it surges if one of them reaches the threshold."""
    rng = random.Random(8)
    for _ in range(3000):
        lengths = [rng.choice([0, 0, 0, 5, 20, 60, 200]) for _ in range(rng.randint(0, 25))]
        window, surge = rng.randint(1, 4), rng.randint(1, 150)
        sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
        want = []
        for a in range(len(sums)):
            for b in range(a + 1, len(sums) + 1):
                longest = all(sums[a:b]) and (a == 0 or not sums[a - 1]) and (b == len(sums) or not sums[b])
                if longest and max(sums[a:b]) >= surge:
                    want.append((a, b))
        assert html_text.text_blocks(lengths, surge, window) == want


def test_unmarked_page_is_cut_at_surge_and_dive():
    """Without marks the lines between surge and dive are the text, by a plain program over the lines."""
    rng = random.Random(5)
    for _ in range(200):
        lines = ["w" * rng.choice([4, 15, 50, 300]) if rng.random() < 0.7 else "" for _ in range(rng.randint(1, 30))]
        page = "".join(f"<div>{t}</div>" if t else "<nav>menu</nav>" for t in lines)
        seen = []
        for t in lines:  # a menu makes blank lines, once
            seen += [t] if t else [""] * html_text.WINDOW if seen and seen[-1] else []
        runs, run = [], []
        for t in [*seen, ""]:
            if t:
                run.append(t)
            elif run:
                runs.append(run)
                run = []
        best = [r for r in runs if max(sum(map(len, r[i : i + html_text.WINDOW])) for i in range(len(r))) >= html_text.SURGE]
        if not best and runs:
            best = [max(runs, key=lambda r: sum(map(len, r)))]
        assert html_text.main_text(page) == "\n".join(t for r in best for t in r)
