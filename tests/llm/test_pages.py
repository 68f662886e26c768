"""URL verdicts and page extraction: rules, trees, markup, page differencing and corner cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notespark.llm import html, urls

PAGES = "page_id bigint, url string, html string"


def judged(spark, addresses):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(addresses)], PAGES)
    df = df.withColumns({"host": F.lit("x"), "rule": F.lit(1), "id": F.lit(2), "merged": F.lit(3)})
    return {r["id"]: r for r in urls.judge_urls(df).collect()}


def test_rules_and_odd_urls(spark):
    cases = [
        (None, "", "", None), ("no scheme/fr/1", "", "", None), ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("http://example.org/en/2", "example.org", "/en/2", "org/"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/"), ("http://org", "org", "", None), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/"),
        ("http://x.com/fr", "x.com", "/fr", None), ("http://com/de/9#t", "com", "/de/9", "com/de/"), ("http://x.net#/y", "x.net", "", None),
        ("http://ÄB.net?q=/a", "Äb.net", "", None), ("a://b://c/d", "b:", "//c/d", None), ("", "", "", None), ("http:///fr/x", "", "/fr/x", None),
        ("http://h.com/fr/" + "s/" * 3000, "h.com", "/fr/" + "s/" * 3000, "com/fr/"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == ("block" if rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_tree(spark):
    rules = (urls.Rule("bad.net", "/shop/item/1", False), urls.Rule("bad.net", "/blog/1", True))
    pages = [f"http://bad.net/shop/item/{i}" for i in range(100, 200)] + [f"http://bad.net/shop/item/{i}" for i in range(200, 260)]
    pages += [f"http://bad.net/blog/{i}" for i in range(100, 300)] + [f"http://bad.net/news/{i}" for i in range(50)]
    pages += [f"http://bad.net/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/about" for i in range(80)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(pages)], PAGES)
    got = urls.judge_urls(df, rules=rules).collect()
    verdicts = {(r["template"], r["rule"] is None): r["verdict"] for r in got}
    assert verdicts[("shop/item/<n>", True)] == "block"  # by purity of the labelled pages of the template
    assert verdicts[("*/<n>", True)] == "allow"  # news has no labels and the shape of blog
    assert {r["template"] for r in got if "/user/" in r["path"]} == {"user/*/about"}
    assert {r["verdict"] for r in got if "/news/" in r["path"]} == {"allow"}


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row2 = [0]
        for j, y in enumerate(b):
            row2.append(row[j] + 1 if x == y else max(row[j + 1], row2[j]))
        row = row2
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        found = html.common_subsequence(a, b)
        assert found == sorted(set(found)) and len(found) == lcs_length(a, b)
        at = -1
        for i in found:
            at = b.index(a[i], at + 1)


def extract(spark, rows):
    df = spark.createDataFrame(rows, PAGES).withColumns({"id": F.lit("x"), "host": F.lit(1), "n": F.lit(2), "texts": F.lit("y")})
    return Counter(tuple(r) for r in html.main_texts(df).collect())


ARTICLE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a>Menu</a></li></ul>"
           "</nav><!-- ad --><div class=\"ad\">Buy</div><article><h1>Title &amp;  more</h1><p><b>First\n line.<br><p>a&lt;b&#233;</p>"
           "<div class='share-buttons'>Share</div><p>Last <span class=\"advert\">now!</span></p><section id=comments><p>me too</p></section>"
           "</article><aside>Side</aside><form><p>Mail</p></form><footer>&copy; x</footer></body></html>")


def test_markup(spark):
    want = "Title & more\nFirst line.\na<bé\nLast"
    rows = [(1, "http://a.com/1", ARTICLE), (2, None, None), (3, "", ""), (4, "x", "plain  text\n only"), (None, "http://b.com/", "<p>é"),
            (5, "http://c.com/", "<div class=cookie-notice>We use</div><p>Body text</p><script>x<"), (6, "http://d.com/", "<p>" + "w " * 50_000)]
    assert extract(spark, rows) == Counter([
        (1, "http://a.com/1", want), (2, None, ""), (3, "", ""), (4, "x", "plain text only"), (None, "http://b.com/", "é"),
        (5, "http://c.com/", "Body text"), (6, "http://d.com/", ("w " * 50_000).strip())])
    assert html.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_differencing(spark):
    def page(i):
        return f"<div>Site name</div><div>Home</div><div><p>Own text number {i}, {'long ' * i}enough</p><p>Second {i}</p></div><div>Terms</div>"

    rows = [(i, f"http://s.com/a/{i}", page(i)) for i in range(1, 9)] + [(20, "http://alone.com/a", page(3)), (3, "http://s.com/a/3", page(3))]
    rows += [(30, "http://copy.com/1", page(5)), (31, "http://copy.com/2", page(5))]
    rows += [(40 + i, f"http://t.com/{i}", ARTICLE) for i in range(3)]
    got = extract(spark, rows)
    for i in range(1, 9):
        text = f"Own text number {i}, {'long ' * i}enough\nSecond {i}"
        assert got[(i, f"http://s.com/a/{i}", text)] == (2 if i == 3 else 1)
    whole = "Site name\nHome\nOwn text number {0}, {1}enough\nSecond {0}\nTerms"
    assert got[(20, "http://alone.com/a", whole.format(3, "long " * 3))] == 1
    assert got[(30, "http://copy.com/1", whole.format(5, "long " * 5))] == 1
    assert got[(41, "http://t.com/1", "Title & more\nFirst line.\na<bé\nLast")] == 1


def test_long_furniture_and_near_copies():
    """Thirty menu lines above a short article go; a page that differs in a word of many is a copy and stays whole."""
    menu = [f"Menu entry number {i}" for i in range(30)]
    page = lambda *own: [(t, html.NEUTRAL) for t in [*menu, *own, "Imprint"]]
    hashes = lambda lines: [html.line_hash(t) for t, _ in lines]
    one, two = page("A short article of its own."), page("Another one, as short.")
    assert html.main_text(one, hashes(two)) == "A short article of its own."
    assert html.main_text(one, hashes(one)) == "\n".join(t for t, _ in one)
    long = [f"Line {i} of a long text that two hosts print." for i in range(100)]
    assert html.main_text(page(*long, "Read 17 times"), hashes(page(*long, "Read 9 times"))) == "\n".join([*menu, *long, "Read 17 times", "Imprint"])


def test_left_out_inside_a_line():
    left = [line for line in html.lines_of("<body><p>press <button>OK</button> now</p><p>a <span class=advert>x <b>y</b></span>b</p></body>") if line[1] != html.AROUND]
    assert [t for t, _ in left] == ["press now", "a b"]


@pytest.mark.parametrize("part", ["pages"])
def test_small_table(spark, part):
    """Against an extraction by regular expressions that knows the table's own layout."""
    import html as entities
    import re

    pages = spark.read.parquet(f"/root/testdata/sf0.001/{part}.parquet")
    got = {r["id"]: r["text"] for r in html.main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|b)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]] == want


@pytest.mark.parametrize("markup, want", [
    ('<div class="page has-sidebar"><article><p>Body</p></article></div>', "Body"),
    ('<div id="menu"><p>Home</p><article><p>Body</p></article></div>', "Body"),
    ('<aside><article><p>Teaser</p></article></aside><article><p>Body</p></article>', "Body"),
    ('<article><section id="discussion"><p>One</p></section><h2 id="related-work">Two</h2><p class="notice">Three</p><p id="search">Four</p>'
     '<div id="form"><p>Five</p></div><div class="related-posts">Six</div><p id="share">Seven</p></article>', "One\nTwo\nThree\nFour\nFive\nSeven"),
])
def test_words_that_name_layouts(markup, want):
    left = [line for line in html.lines_of(f"<body>{markup}</body>") if line[1] != html.AROUND]
    assert html.main_text(left, []) == want
