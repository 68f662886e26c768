"""The outline tree of a document and the place of every entry in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K
from ..functions.text import clean_title
from ..scan import key_sizes, last_value, row_number, running_min, running_sum, scan, upper_median
from .chains import fold

TRUSTED_SHARE = 0.8
MAX_ROWS, MAX_CHUNK = 10, 15_000


def outline_keys(outline_raw: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Positional keys ("2.1.3") for (seq, level, title, page) rows.

    A level may be at most one deeper than the one before, and is 1 at least. A fold carries the
    counters down to the last node's level: a node counts up the one of its own level and drops
    the deeper ones. Untitled nodes count but are not returned.
    """
    keys = list(keys)

    def step(counters: Column, x: Column) -> Column:
        level = F.least(F.greatest(x["__level"], F.lit(1)), F.size(counters) + 1)
        path = F.concat(F.slice(counters, 1, level - 1), F.array(F.coalesce(F.get(counters, level - 1), F.lit(0)) + 1))
        return F.struct(path.alias("s"), path.alias("o"))

    raw = outline_raw.withColumns({"title": clean_title(F.col("title")), "__level": F.col("level").cast("int")})
    placed = fold(raw, keys, ["seq"], ["__level"], "__path", F.array().cast("array<int>"), step)
    path = F.col("__path")
    rest = [c for c in outline_raw.columns if c not in (*keys, "seq", "level", "title")]
    return placed.filter("title <> ''").select(
        *keys, "seq", F.array_join(path.cast("array<string>"), ".").alias("key"),
        path.alias("key_path"), F.size(path).alias("level"), "title", *rest)


def assign_sections(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``section``: the last node on or before the entry's page (``page`` NULL is 0).

    Where the numbering of a document names its outline, a statement above the heading on a
    page it shares goes to the section its number names.
    """
    doc, pos = "doc_id", "pos"
    page = F.coalesce(F.col("page"), F.lit(0))
    none = F.lit(None).cast("string")
    # Per entry two probes: one behind the nodes of its page, one in front of them.
    probe = F.explode(F.array(F.lit(2), F.lit(0))).alias("side")
    marks = nodes.select(doc, F.col("page").alias("__p"), F.lit(1).alias("side"),
                         F.col("seq").cast("bigint").alias("__s"), "key").unionByName(
        entries.select(doc, page.alias("__p"), probe, F.col(pos).cast("bigint").alias("__s"),
                       none.alias("key")))
    found = scan(marks, [doc], ["__p", "side", "__s"], __key=last_value(F.col("key"))).filter("side <> 1")
    at = found.groupBy(doc, F.col("__s").alias(pos)).agg(
        F.max(F.when(F.col("side") == 2, F.col("__key"))).alias("last"),
        F.max(F.when(F.col("side") == 0, F.col("__key"))).alias("before"))

    prefix = K.num_prefix(F.col("number"))
    placed = (
        entries.withColumn("__pos", F.col(pos).cast("bigint")).withColumn("__prefix", prefix)
        .join(at.withColumnRenamed(pos, "__pos"), [doc, "__pos"], "left").drop("__pos")
    )
    numbered = F.col("__prefix").isNotNull() & F.col("last").isNotNull()
    agree = numbered & K.covers(F.col("__prefix"), F.col("last"))
    trusted = placed.groupBy(doc).agg(
        (F.count_if(numbered) > 0).alias("__any"),
        (F.count_if(agree) >= TRUSTED_SHARE * F.count_if(numbered)).alias("__agree"),
    ).select(doc, (F.col("__any") & F.col("__agree")).alias("__trusted"))
    starts = nodes.select(doc, F.col("key").alias("__prefix"), F.col("page").alias("__page"),
                          F.lit(True).alias("__starts")).distinct()
    refined = (
        placed.withColumn("__page", page).join(trusted, doc, "left")
        .join(starts, [doc, "__prefix", "__page"], "left")
    )
    named = F.coalesce(F.col("__starts"), F.lit(False)) | (
        F.coalesce(F.col("before") == F.col("__prefix"), F.lit(False)))
    use = F.coalesce(F.col("__trusted") & named & ~K.covers(F.col("__prefix"), F.col("last")), F.lit(False))
    return refined.select(
        *entries.columns, F.when(use, F.col("__prefix")).otherwise(F.col("last")).alias("section"))


def tree_from_numbers(entries: DataFrame) -> DataFrame:
    """The tree the numbers imply: chapters, and sections where most numbers have 3 parts."""
    doc = "doc_id"
    parts = F.split("number", r"\.")
    numbered = entries.filter(F.coalesce(F.col("number"), F.lit("")) != "").select(
        doc, "pos", parts.alias("parts"), F.size(parts).alias("n"))
    counts = numbered.groupBy(doc, "n").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first"))
    depth = counts.groupBy(doc).agg(F.max_by("n", F.struct("cnt", -F.col("first"))).alias("depth"))
    p = F.col("parts")
    keys = F.when((F.col("depth") >= 3) & (F.size(p) >= 2),
                  F.array(p[0], F.concat_ws(".", p[0], p[1]))).otherwise(F.array(p[0]))
    tree = numbered.join(depth, doc).select(doc, F.explode(keys).alias("key")).distinct()
    tree = tree.withColumn("key_path", K.sort_key(F.col("key")))
    return scan(tree, [doc], ["key_path", "key"], seq=row_number()).select(
        doc, "seq", "key", "key_path", F.size("key_path").alias("level"),
        F.lit("").alias("title"), F.lit(0).alias("page"))


def place_by_number(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``section``: the node of the first two numbers, else of the first, else NULL."""
    doc = "doc_id"
    parts = F.split(F.coalesce("number", F.lit("")), r"\.")
    keys = nodes.select(doc, "key").distinct()
    two = keys.withColumnRenamed("key", "__two").withColumn("__hit2", F.lit(True))
    one = keys.withColumnRenamed("key", "__one").withColumn("__hit1", F.lit(True))
    return (
        entries.withColumn("__one", parts[0])
        .withColumn("__two", F.when(F.size(parts) >= 2, F.concat_ws(".", parts[0], parts[1])))
        .join(two, [doc, "__two"], "left").join(one, [doc, "__one"], "left")
        .select(*entries.columns, F.coalesce(
            F.when(F.col("__hit2"), F.col("__two")), F.when(F.col("__hit1"), F.col("__one"))).alias("section"))
    )


def choose_tree(entries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with section, nodes): per document the outline if it places at least half of
    the entries, else the tree its numbers imply."""
    doc = "doc_id"
    outlined = assign_sections(entries, nodes)
    verdict = outlined.groupBy(doc).agg(
        (F.count("section") >= F.expr("count(1) div 2")).alias("__ok"))
    has_outline = nodes.select(doc).distinct()
    good = verdict.filter("__ok").join(has_outline, doc, "left_semi").select(doc)
    implied = tree_from_numbers(entries.join(good, doc, "left_anti"))
    by_number = place_by_number(entries.join(good, doc, "left_anti"), implied)
    cols = ["doc_id", "seq", "key", "key_path", "level", "title", "page"]
    no_entries = nodes.join(entries.select(doc).distinct(), doc, "left_anti")
    kept = nodes.join(good, doc, "left_semi").unionByName(no_entries)
    return (
        outlined.join(good, doc, "left_semi").unionByName(by_number),
        kept.select(*cols).unionByName(implied.select(*[F.col(c) for c in cols])),
    )


def section_extent(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Add ``end_page``: the page before the next node in reading order that starts on a
    later page, else the last page of the document.

    From the last node to the first a fold keeps the pages that may still be an answer: a
    stack of rising pages, whatever the order of the outline. A null page is 0.
    """
    doc = "doc_id"

    def step(ahead: Column, x: Column) -> Column:
        later = F.filter(ahead, lambda page: page > x["__page"])
        return F.struct(F.concat(F.array(x["__page"]), later).alias("s"), F.get(later, F.lit(0)).alias("o"))

    places = nodes.withColumns({"__back": -F.col("seq"), "__page": F.coalesce(F.col("page"), F.lit(0)).cast("int")})
    stops = fold(places, [doc], ["__back"], ["__page"], "__stop", F.array().cast("array<int>"), step)
    return stops.join(page_counts, doc, "left").select(
        *nodes.columns, F.coalesce((F.col("__stop") - 1).cast(nodes.schema["page"].dataType), F.col("n_pages")).alias("end_page"))


def with_ancestors(rows: DataFrame, key: str, name: str = "node") -> DataFrame:
    """One row per ancestor of ``key`` (itself included): a prefix join as an equi join."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn(
        name, F.explode(K.ancestors(F.col(key))))


def live_nodes(nodes: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with at least one statement at or beneath them."""
    used = with_ancestors(statements.select(*keys, "section").distinct(), "section", "key")
    return nodes.join(used.select(*keys, "key").distinct(), [*keys, "key"], "left_semi")


def display_depth(nodes: DataFrame, keys: list[str], max_rows: int = MAX_ROWS,
                  max_chunk: int = MAX_CHUNK) -> DataFrame:
    """(keys, depth): deepen while the nodes still fit the rows, or while the typical node at
    the level reached so far is too big. ``nodes`` has (level, size)."""
    deepest = nodes.groupBy(*keys).agg(F.max("level").alias("deepest"))
    levels = nodes.join(deepest, keys).select(
        *keys, "level", "size", "deepest",
        F.explode(F.sequence(F.greatest(F.col("level"), F.lit(1)), F.col("deepest"))).alias("depth"))
    counts = levels.groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("rows"))
    medians = upper_median(levels, [*keys, "depth"], "size")
    each = deepest.filter("deepest >= 2").select(
        *keys, "deepest", F.explode(F.sequence(F.lit(2), F.col("deepest"))).alias("candidate"))
    judged = (
        each.join(counts.withColumnRenamed("depth", "candidate"), [*keys, "candidate"], "left")
        .join(medians.withColumn("candidate", F.col("depth") + 1).drop("depth"), [*keys, "candidate"], "left")
        .withColumn("stop", ~((F.coalesce("rows", F.lit(0)) <= max_rows)
                              | (F.coalesce("median", F.lit(0)) > max_chunk)))
    )
    first_stop = judged.groupBy(*keys).agg(F.min(F.when(F.col("stop"), F.col("candidate"))).alias("first_stop"))
    return deepest.join(first_stop, keys, "left").select(
        *keys, F.coalesce(F.col("first_stop") - 1, F.greatest(F.col("deepest"), F.lit(1))).cast("int").alias("depth"))


def slide_sections(slides: DataFrame, parts: DataFrame) -> DataFrame:
    """Add ``section``: the deck's key and the number of parts starting on or before the
    slide's page; the deck itself before the first part. ``slides`` carries ``deck_key``."""
    doc = "doc_id"
    marks = parts.select(doc, F.col("page").alias("__p"), F.lit(0).alias("__side"),
                         F.col("seq").cast("bigint").alias("__s")).unionByName(
        slides.select(doc, F.col("page").alias("__p"), F.lit(1).alias("__side"),
                      F.col("page").cast("bigint").alias("__s")))
    counted = scan(marks, [doc], ["__p", "__side", "__s"],
                   part=running_sum((F.col("__side") == 0).cast("bigint")))
    numbers = counted.filter("__side = 1").select(doc, F.col("__p").alias("page"), "part")
    return slides.join(numbers, [doc, "page"], "left").withColumn(
        "section", F.when(F.col("part") > 0, F.concat_ws(".", "deck_key", F.col("part").cast("string")))
        .otherwise(F.col("deck_key"))).drop("part")
