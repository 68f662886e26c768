"""Slide decks: furniture, outline slides, titles, overlay steps, deck numbers.

A slide is a row with the array of its lines, so trimming a slide stays in the row; only the
lines of whole decks are counted with a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..scan import following, row_number, running_min, scan

# --- Fixed values ----------------------------------------------------------------------
COUNTER = r"^\d+\s*/\s*\d+$"
OUTLINE_TITLES = [
    "outline", "overview", "agenda", "contents", "table of contents", "inhalt",
    "inhaltsverzeichnis", "gliederung", "übersicht",
]
FURNITURE_SHARE, FURNITURE_PAGES = 0.6, 5
HEADING_TOP = 0.2
#: Shares in which the lines of a deck meet its size; pages of a deck that take one copy of its lists.
LINE_SHARES, BLOCK_PAGES = 64, 256
# ---------------------------------------------------------------------------------------


def slide_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, lines): non-blank lines without outer whitespace."""
    return pages.select("doc_id", "page", F.filter(
        F.transform(F.split("text", "\n"), X.strip), lambda x: x != "").alias("lines"))


def furniture(lines: DataFrame, keys: list[str], page: str = "page", line: str = "line",
              share: float = FURNITURE_SHARE, min_pages: int = FURNITURE_PAGES) -> DataFrame:
    """(keys, line, pages): lines on ``share`` of the pages of a deck of ``min_pages`` or more.
    A page counts once. Counting is two pre-aggregated steps, so a line that fills a deck is
    no hot key; what is left meets the size of its deck in shares, so neither is a deck of many lines."""
    seen = lines.groupBy(*keys, page, line).agg(F.lit(1).alias("__one"))
    per_line = seen.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= share * min_pages).withColumn(
        "__share", F.pmod(F.xxhash64(line), F.lit(LINE_SHARES)).cast("int"))
    decks = lines.groupBy(*keys, page).agg(F.lit(1).alias("__one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    sizes = decks.filter(F.col("__all") >= min_pages).withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(LINE_SHARES - 1))))
    return per_line.join(sizes, [*keys, "__share"]).filter(
        F.col("pages") >= share * F.col("__all")).select(*keys, line, "pages")


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _block() -> Column:
    return F.coalesce(F.floor(F.col("page") / BLOCK_PAGES), F.lit(0))


def clean_slides(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, page, lines) without header, footer and slides that repeat the outline.
    ``outline`` has (doc_id, title).

    What repeats on 60 % of the slides is at most a slide's worth of lines per deck, so it
    travels to the slides as one small array, once for every block of pages: a long deck is no hot key.
    """
    slides = slide_lines(pages).withColumn("__block", _block())
    marks = furniture(slides.select("doc_id", "page", F.explode("lines").alias("line")), ["doc_id"])
    lists = marks.groupBy("doc_id").agg(F.collect_list("line").alias("furniture"))
    titles = outline.filter(X.strip(F.col("title")) != "").groupBy("doc_id").agg(
        F.collect_set(X.plain_title(F.col("title"))).alias("titles"))
    blocks = pages.select("doc_id", _block().alias("__block")).distinct()
    known = blocks.join(lists, "doc_id", "left").join(titles, "doc_id", "left")
    full = slides.join(known, ["doc_id", "__block"], "left").select(
        "doc_id", "page", "lines", _or_empty("furniture").alias("furniture"), _or_empty("titles").alias("titles"))
    return full.withColumn("lines", strip_furniture(F.col("lines"), F.col("furniture"), F.col("titles"))).filter(
        (F.size("lines") > 0) & ~is_outline(F.col("lines"), F.col("titles"))).select("doc_id", "page", "lines")


def strip_furniture(lines: Column, marks: Column, titles: Column) -> Column:
    """Without the run of furniture at the end (counters and outline titles count as well) and
    the run of furniture at the start."""
    def at_end(line: Column) -> Column:
        return F.array_contains(marks, line) | line.rlike(COUNTER) | F.array_contains(titles, X.plain_title(line))

    # Counted from the end; once a line is content, the lines above are not looked at.
    def upward(state: Column, line: Column) -> Column:
        return F.when(state["stop"], state).when(at_end(line), F.struct(
            (state["n"] + 1).alias("n"), F.lit(False).alias("stop"))).otherwise(F.struct(state["n"].alias("n"), F.lit(True).alias("stop")))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"))
    dropped = F.aggregate(F.reverse(lines), start, upward, lambda s: s["n"])
    head = F.slice(lines, F.lit(1), F.size(lines) - dropped)
    first = F.array_min(F.transform(head, lambda x, i: F.when(~F.array_contains(marks, x), i + 1)))
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(head, first, F.size(head)))


def is_outline(lines: Column, titles: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(t) for t in OUTLINE_TITLES]), X.plain_title(lines[0])) & F.forall(
        F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.array_contains(titles, X.plain_title(x)))


def headings(spans: DataFrame) -> DataFrame:
    """(doc_id, page, head, head_top, tops): the line in the largest type (the upper one on
    ties) if it is in the top fifth, and where each line starts. ``spans`` are lines with
    (size, top, text, height)."""
    named = spans.withColumn("text", X.strip(X.normalize(F.col("text")))).filter("text <> ''")
    tops = named.groupBy("doc_id", "page", "text").agg(F.min("top").alias("top"))
    by_page = tops.groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("text", "top"))).alias("tops"))
    best = named.groupBy("doc_id", "page").agg(
        F.max_by(F.struct("text", "top", "height"), F.struct(F.col("size"), -F.col("top"))).alias("b"))
    head = F.when(F.col("b.top") < HEADING_TOP * F.col("b.height"), F.col("b.text"))
    return best.select("doc_id", "page", head.alias("head")).join(by_page, ["doc_id", "page"])


def heading_first(slides: DataFrame, heads: DataFrame) -> DataFrame:
    """The heading goes first where it stands above the line that is first now."""
    lines, head = F.col("lines"), F.col("head")
    later = F.array_contains(F.slice(lines, F.lit(2), F.size(lines)), head)
    above = F.element_at("tops", head) < F.coalesce(F.element_at("tops", lines[0]), F.lit(0.0))
    at = F.array_position(lines, head).cast("int")
    moved = F.concat(F.array(head), F.slice(lines, F.lit(1), at - 1), F.slice(lines, at + 1, F.size(lines)))
    joined = slides.join(heads, ["doc_id", "page"], "left")
    return joined.withColumn("lines", F.when(F.coalesce(later & above, F.lit(False)), moved).otherwise(lines)).select(
        *slides.columns)


def slide_entries(slides: DataFrame) -> DataFrame:
    """(doc_id, page, name, text): first line and the rest."""
    return slides.select("doc_id", "page", F.col("lines")[0].alias("name"),
                         F.array_join(F.slice("lines", F.lit(2), F.size("lines")), "\n").alias("text"))


def drop_overlay(entries: DataFrame, keys: list[str], page: str = "page", name: str = "name",
                 text: str = "text") -> DataFrame:
    """Without rows that the next row (page + 1, same name) repeats and extends."""
    ahead = scan(entries, keys, [page], __next=following(F.col(page), F.col(name), F.col(text)))
    nxt = F.col("__next")
    step = (nxt[page] == F.col(page) + 1) & (nxt[name] == F.col(name)) & nxt[text].startswith(F.col(text))
    return ahead.filter(~F.coalesce(step, F.lit(False))).drop("__next")


def number_decks(decks: DataFrame, keys: list[str] = ["course"]) -> DataFrame:
    """Replace ``number``: decks in order of their number (unnumbered last, then by name); a
    missing or repeated one becomes one more than the largest so far.

    In that order the result is max(own number, previous + 1): a running maximum of
    ``number - position``.
    """
    marked = decks.withColumn("__none", F.col("number").isNull().cast("int"))
    ranked = scan(marked, keys, ["__none", "number", "name"], __i=row_number())
    low = scan(ranked, keys, ["__i"], __low=running_min(F.col("__i") - F.col("number")))
    return low.withColumn("number", (F.col("__i") - F.coalesce("__low", F.lit(0))).cast("int")).drop("__none", "__i", "__low")
