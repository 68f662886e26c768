"""Main text of web pages: pages of a host are compared with the one nearest by URL path, shared lines go."""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import defaultdict
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..scan import following, previous, scan
from ..session import staged
from .urls import host_of, path_of

#: Fixed values of HTML: elements without text for readers, parts around the article, and blocks.
HIDDEN = frozenset("head script style noscript template iframe svg math object canvas audio video map datalist".split())
ASIDE = frozenset("nav aside footer form button select textarea fieldset dialog menu".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
                  "td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark a part around the article, or the article itself.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side rail nav navbar "
                        "navigation menu menubar breadcrumb breadcrumbs footer header masthead toolbar cookie cookies consent gdpr notice "
                        "notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
                        "widget comment comments commentlist respond disqus discussion replies pagination pager copyright "
                        "contentinfo complementary dialog form".split())
MAIN_WORDS = frozenset("article articlebody main".split())
#: Of these words, those that also name layouts and parts of articles. Inside an article they count only in a class
#: with a companion or another of them, and never for headings and paragraphs; an article below such a wrapper is one.
WEAK_WORDS = frozenset("notice notices alert discussion replies related recommended search share sharing form dialog side rail menu nav "
                       "header masthead banner widget complementary copyright consent login respond promotion navigation overlay social "
                       "subscribe signup toolbar popup modal".split())
COMPANIONS = frozenset("buttons links bar posts articles icons form widget".split())
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANKS = re.compile(r"\s+")

#: LOOSE is around as well, but an article below it is an article.
ARTICLE, NEUTRAL, AROUND, LOOSE = 2, 1, 0, -1


class Lines(HTMLParser):
    """(text, place) per block in page order, with white space folded; place tells what encloses it.

    Closing tags without an open element are skipped; one that closes an outer element closes all
    inside it. A paragraph is closed by the next block, as browsers do.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # element, hidden, place
        self.text: list[str] = []

    @property
    def state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, NEUTRAL)

    def flush(self) -> None:
        line = _BLANKS.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if line:
            self.lines.append((line, max(self.state[1], AROUND)))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):  # an open paragraph ends at a block
                if self.open[k][0] == "p":
                    del self.open[k:]
                    break
                if self.open[k][0] in BLOCK:
                    break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        hidden, place = self.state
        named = {k: v or "" for k, v in attrs}
        marks = {k: {w.lower() for w in _WORDS.findall(_LAYOUT.sub(" ", named[k]))} for k in ("class", "id", "role") if named.get(k)}
        words = set().union(*marks.values())
        hidden = hidden or tag in HIDDEN or "hidden" in named or named.get("aria-hidden") == "true" or bool(
            re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")))
        if tag not in ("html", "body"):
            firm = tag in ASIDE or bool(words & (ASIDE_WORDS - WEAK_WORDS)) or tag == "header" and place != ARTICLE
            loose = bool(words & WEAK_WORDS)
            if place == ARTICLE:
                named_so = marks.get("class", set())
                loose = not re.fullmatch("p|h[1-6]", tag) and bool(named_so & WEAK_WORDS) and len(named_so & (WEAK_WORDS | COMPANIONS)) > 1
            if tag in MAIN:
                firm, loose = bool(words & {"comment", "comments", "ad", "advert", "related"}), False
            if place == LOOSE and tag in MAIN and not firm:
                place = ARTICLE
            elif place not in (AROUND, LOOSE):
                main = tag in MAIN or words & MAIN_WORDS or "articleBody" in named.get("itemprop", "")
                place = AROUND if firm else LOOSE if loose else ARTICLE if main else place
            elif firm:
                place = AROUND
        if tag not in BLOCK and place == AROUND != self.state[1]:
            hidden, place = True, self.state[1]  # what is left out inside a line does not break the line
        if tag not in BLOCK and place != self.state[1]:
            self.flush()
        self.open.append((tag, hidden, place))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if k and self.open[k - 1][2] != self.open[k][2]:
                    self.flush()
                del self.open[k:]
                break
            if tag not in BLOCK and self.open[k][0] in BLOCK:
                break  # a stray end tag of an inline element

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.text.append(data)


def lines_of(html: str) -> list[tuple[str, int]]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, by chains of matches (Hunt and Szymanski).

    Equal ends are matched first, so near-equal pages cost little more than a comparison.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where = defaultdict(list)
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []  # (position in a, chain before it)
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif ends[k] != j:
                ends[k], links[k] = j, link
    middle, chain = [], links[-1] if links else None
    while chain:
        middle.append(chain[0])
        chain = chain[1]
    return [*range(lo), *reversed(middle), *range(len(a) - hi, len(a))]


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


#: A page that differs from its neighbour in less than one in so many characters is a copy of it.
COPY_PART = 50


def main_text(lines: list[tuple[str, int]], other: list[int]) -> str:
    """What stays of the lines that markup leaves of a page: not those it shares with the nearest page.

    Lines inside a marked article are never shared furniture: neighbours quote and repeat each
    other. A page without a marked article is a copy of its neighbour, and keeps those lines, if
    they are all it has but for one character in COPY_PART: however much furniture there is, an
    article of its own is more.
    """
    shared = set(common_subsequence([line_hash(t) for t, _ in lines], other))
    if any(place == ARTICLE for _, place in lines):
        return "\n".join(t for t, place in lines if place == ARTICLE)
    own = sum(len(t) for i, (t, _) in enumerate(lines) if i not in shared)
    if COPY_PART * own < sum(len(t) for t, _ in lines):
        shared = set()
    return "\n".join(t for i, (t, _) in enumerate(lines) if i not in shared)


def _left(html: str) -> list[tuple[str, int]]:
    return [line for line in lines_of(html) if line[1] != AROUND]


def _hashes(pages: pd.Series) -> pd.Series:
    return pd.Series([[line_hash(t) for t, _ in _left(h)] for h in pages])


def _parse(pages: pd.Series) -> pd.DataFrame:
    found = [_left(h) for h in pages]
    return pd.DataFrame({"texts": [[t for t, _ in x] for x in found], "places": [[p for _, p in x] for x in found]})


def _after_is_nearer(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    def shared(a: str, b: str | None) -> int:
        return -1 if b is None else len(os.path.commonprefix((a, b)))

    return pd.Series([shared(p, a) > shared(p, b) for p, b, a in zip(path, before, after)])


def _keep(texts: pd.Series, places: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([main_text(list(zip(t, p)), [] if o is None else list(o)) for t, p, o in zip(texts, places, other)], dtype=object)


def main_texts(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text) per row of ``pages``.

    Pages of a host are ordered by path; each is paired with the neighbour that shares the longer
    beginning of the path, the one before if equal. Equal rows are one page, so a repeat is never
    its own neighbour. A host with one page has nothing to compare: its markup alone decides. A
    null html is empty, a null url has an empty host and path like one without ://. Ids play no
    part, so nulls and repeats do no harm. Other columns are not read.

    Only hosts, paths and content hashes are ordered, by a scan that cuts a large host into even
    runs. Line hashes travel to the page that needs them; the lines themselves are parsed anew
    for the one join that brings both together, which costs less than storing them.
    """
    hashes, parse = F.pandas_udf(_hashes, "array<bigint>"), F.pandas_udf(_parse, "texts array<string>, places array<tinyint>")
    after_is_nearer, keep = F.pandas_udf(_after_is_nearer, "boolean"), F.pandas_udf(_keep, "string")
    read = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = read.select("*", F.xxhash64("url", "html").alias("h1"), F.xxhash64(F.lit(1), "html", "url").alias("h2"))
    hashed = staged(keyed.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "h1", "h2",
                                 hashes("html").alias("hashes")), "hashes")
    nodes = staged(hashed.groupBy("host", "path", "h1", "h2").agg(F.any_value("hashes").alias("hashes")), "pages")
    place = [F.col(c) for c in ("path", "h1", "h2")]
    around = scan(nodes.drop("hashes"), ["host"], ["path", "h1", "h2"], before=previous(*place), after=following(*place))
    nearest = F.when(F.coalesce(after_is_nearer("path", "before.path", "after.path"), F.lit(True)), F.col("after")).otherwise(F.col("before"))
    pairs = around.select("h1", "h2", nearest.alias("n")).select("h1", "h2", F.col("n.h1").alias("o1"), F.col("n.h2").alias("o2"))
    others = pairs.join(nodes.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("hashes").alias("other")), ["o1", "o2"]).select(
        "h1", "h2", "other")
    parsed = keyed.select("id", "url", "h1", "h2", parse("html").alias("p")).select("id", "url", "h1", "h2", "p.texts", "p.places")
    return parsed.join(others, ["h1", "h2"], "left").select("id", "url", keep("texts", "places", "other").alias("text"))
