"""Fragments of notebooks: which task each one quotes, and what was written below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..scan import following, key_sizes, previous, running_sum, scan
from ..session import staged

# --- Fixed values ----------------------------------------------------------------------
MIN_SCORE = 0.35
MIN_GRAMS = 15
BONUS, PART_MALUS = 0.3, 0.05
HEAD_CHARS = 120
EXERCISE_NUMBER = r"\((\d+(?:\.\d+)+)\)"
SHEET_TASK = r"(?U)\A\W{0,3}Aufgabe\s+(\d+)\b"
NOTES_STATEMENT = (
    r"(?U)\A\W{0,3}(Satz|Definition|Lemma|Korollar|Proposition|Bemerkung|Beispiel|Algorithmus"
    r"|Theorem|Corollary|Proof|Beweis|Remark)\b"
)
CLIP_MARGIN = 6
# ---------------------------------------------------------------------------------------
#: A pair is looked at only if it shares one in so many of a fragment's trigrams among the rarest ones.
SHARED_PART = 8


def match_candidates(tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """(scope, cand_ord, task, part, number, text): every task and each of its parts.

    ``tasks`` has (sheet_id, pos, number, text, subparts); ``resolved`` has per task the
    exercises it points at as (sheet_id, pos, found ARRAY<STRUCT<number,title,text,page>>).
    """
    joined = tasks.join(resolved, ["sheet_id", "pos"], "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<number:string,title:string,text:string,page:int>>"))
    whole = F.concat_ws("\n", F.concat(F.array("text"), F.transform(found, lambda e: e["text"])))
    only = F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    parts = F.when(only.isNotNull(), X.subparts(only["text"])).otherwise(F.col("subparts"))
    items = F.concat(
        F.array(F.struct(F.lit("").alias("label"), whole.alias("text"))),
        F.transform(parts, lambda p: F.struct(p["label"].alias("label"), p["text"].alias("text"))))
    return joined.select(
        F.col("sheet_id").alias("scope"), "pos", F.col("number").alias("task"), only["number"].alias("exercise"),
        F.posexplode(items).alias("part_no", "p"),
    ).select("scope", F.struct("pos", "part_no").alias("cand_ord"), "task", F.col("p.label").alias("part"),
             F.col("exercise").alias("number"), F.col("p.text").alias("text"))


def classify_fragments(fragments: DataFrame, cands: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(scope, frag_id, task, part, score) of the fragments that quote a candidate of their
    scope. ``fragments``: (scope, frag_id, text); ``cands``: as ``match_candidates``.

    score = containment * (0.5 + 0.5 * coverage) plus bonuses, containment being the share of
    the fragment's n trigrams in the candidate, coverage the share of the candidate's m. Without a
    bonus a score of ``min_score`` needs so many trigrams in common that depends on n and m alone, c
    say. Such a pair shares at least l of the n - c + l trigrams of the fragment that are rarest
    among the scope's candidates, for every l: only those are joined, and pairs that share
    fewer than l = n / SHARED_PART of them are out. Pairs with a bonus come from equi joins on the marker.
    What is left is scored on the full trigram sets.
    """
    head = X.strip(F.col("text"))
    opening = F.substring(head, 1, HEAD_CHARS)
    f = fragments.filter(~head.rlike(NOTES_STATEMENT)).select(
        "scope", "frag_id", X.trigram_codes(F.col("text")).alias("fg"),
        X.non_empty(F.regexp_extract(opening, EXERCISE_NUMBER, 1)).alias("f_number"),
        F.regexp_extract(head, SHEET_TASK, 1).try_cast("bigint").alias("f_task"),
    ).filter(F.size("fg") >= MIN_GRAMS)
    f = staged(f, "fragments")
    c = cands.select("scope", "cand_ord", F.col("task").cast("bigint").alias("task"), "part", "number",
                     X.trigram_codes(F.col("text")).alias("cg")).filter(F.size("cg") > 0)
    c = staged(c, "candidates")

    postings = c.select("scope", "cand_ord", F.size("cg").alias("m"), F.explode("cg").alias("gram"))
    spread = postings.groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("df"))
    used = f.select("scope", "frag_id", F.size("fg").alias("n"), F.explode("fg").alias("gram")).join(spread, ["scope", "gram"])
    # Per fragment its trigrams by rarity, a number of 31 bits behind each frequency; a fragment is one row, so its
    # list is short. Those of no candidate are the rarest: they only count.
    by_rarity = used.groupBy("scope", "frag_id", "n").agg(F.array_sort(F.collect_list(
        F.shiftleft("df", 31).bitwiseOR(F.col("gram").cast("bigint")))).alias("gs"))
    absent = F.col("n") - F.size("gs")
    n, m = F.col("n"), F.col("m")
    least = F.ceil(F.least(n / SHARED_PART, min_score * n)).cast("int")
    # The smallest candidates that will do have min_score * n trigrams, all of them in common.
    keep = n - F.ceil(min_score * n - 1e-9).cast("int") + least
    prefix = by_rarity.select("scope", "frag_id", "n", absent.alias("absent"), F.posexplode(
        F.slice("gs", F.lit(1), F.greatest(keep - absent, F.lit(0)))).alias("at", "g")).select(
        "scope", "frag_id", "n", (F.col("at") + F.col("absent")).alias("at"), F.col("g").bitwiseAND(0x7FFFFFFF).cast("int").alias("gram"))
    needed = F.ceil((F.sqrt(m * m + 8 * min_score * n * m) - m) / 2 - 1e-9).cast("int")
    near = prefix.join(postings, ["scope", "gram"]).filter((needed <= m) & (F.col("at") < n - needed + least))
    pairs = near.groupBy("scope", "frag_id", "cand_ord", "n").agg(F.count(F.lit(1)).alias("shared")).filter(
        F.col("shared") >= least).select("scope", "frag_id", "cand_ord")
    by_number = f.select("scope", "frag_id", F.col("f_number").alias("number")).join(
        c.select("scope", "cand_ord", "number"), ["scope", "number"]).select("scope", "frag_id", "cand_ord")
    by_task = f.select("scope", "frag_id", F.col("f_task").alias("task")).join(
        c.select("scope", "cand_ord", "task"), ["scope", "task"]).select("scope", "frag_id", "cand_ord")
    pairs = pairs.unionByName(by_number).unionByName(by_task).distinct()

    scored = pairs.join(f, ["scope", "frag_id"]).join(c, ["scope", "cand_ord"])
    common = F.size(F.array_intersect("fg", "cg"))
    contained, covered = common / F.size("fg"), common / F.size("cg")
    marker = F.col("f_number").isNotNull() | F.col("f_task").isNotNull()
    score = (
        contained * (0.5 + 0.5 * covered)
        + F.when(F.col("f_number") == F.col("number"), BONUS).otherwise(0.0)
        + F.when(F.col("f_task") == F.col("task"), BONUS).otherwise(0.0)
        - F.when(marker & (F.col("part") != ""), PART_MALUS).otherwise(0.0)
    )
    hits = scored.select("scope", "frag_id", "cand_ord", "task", "part", score.alias("score")).filter(
        F.col("score") >= min_score)
    # Best score, the first candidate on ties.
    return hits.groupBy("scope", "frag_id").agg(
        F.min_by(F.struct("task", "part", "score"), F.struct(-F.col("score"), F.col("cand_ord"))).alias("m")).select(
        "scope", "frag_id", "m.task", "m.part", "m.score")


def match_audit(fragments: DataFrame, matches: DataFrame) -> DataFrame:
    """Every fragment with what it was taken for, the score, and the start of its text."""
    return fragments.join(matches, ["scope", "frag_id"], "left").select(
        "scope", "frag_id", "task", F.coalesce("part", F.lit("")).alias("part"),
        F.bround(F.coalesce("score", F.lit(0.0)), 2).alias("score"), X.preview(F.col("text"), 80).alias("text"))


def merge_marks(marks: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Add ``run``: consecutive marks that agree on ``same`` are one run, numbered from 1."""
    sizes = key_sizes(marks, keys)
    before = scan(marks, keys, order, sizes, __prev=previous(*[F.col(c) for c in same]))
    changed = F.col("__prev").isNull()
    for c in same:
        changed = changed | ~F.col(f"__prev.{c}").eqNullSafe(F.col(c))
    flagged = before.withColumn("__new", changed.cast("bigint"))
    return scan(flagged, keys, order, sizes, run=running_sum(F.col("__new"))).drop("__prev", "__new")


def stretches(marks: DataFrame, pages: DataFrame, strokes: DataFrame) -> DataFrame:
    """(nb, stretch, task, part, page, top, bottom): what was written below each statement.

    ``marks`` (nb, page, top, bottom, task, part) are the pasted statements. A stretch runs
    from the end of a run of marks to the beginning of the next one, cut at page borders and
    clipped to the strokes in it; slices without a stroke are dropped.
    """
    nb = ["nb"]
    runs = merge_marks(marks, nb, ["page", "top", "bottom", "task", "part"], ["task", "part"])
    here = F.struct("page", "top", "bottom")
    spans = runs.groupBy("nb", "run", "task", "part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    ends = pages.groupBy("nb").agg(F.max_by(F.struct("page", F.col("height").alias("top")), "page").alias("end"))
    ahead = scan(spans, nb, ["run"], __next=following(F.col("first.page"), F.col("first.top")))
    bounds = ahead.join(ends, nb).select(
        "nb", F.col("run").alias("stretch"), "task", "part",
        F.col("last.page").alias("p0"), F.col("last.bottom").cast("double").alias("y0"),
        F.coalesce(F.col("__next.page"), F.col("end.page")).alias("p1"),
        F.coalesce(F.col("__next.top"), F.col("end.top")).cast("double").alias("y1"))
    slices = bounds.filter("p0 <= p1").withColumn("page", F.explode(F.sequence("p0", "p1"))).join(pages, ["nb", "page"])
    slices = slices.select(
        "nb", "stretch", "task", "part", "page",
        F.when(F.col("page") == F.col("p0"), F.col("y0")).otherwise(0.0).alias("top"),
        F.when(F.col("page") == F.col("p1"), F.col("y1")).otherwise(F.col("height")).alias("bottom"))
    return clip_slices(slices, strokes)


def clip_slices(slices: DataFrame, strokes: DataFrame, margin: int = CLIP_MARGIN) -> DataFrame:
    written = strokes.select("nb", "page", F.col("top").alias("__t"), F.col("bottom").alias("__b"))
    hit = slices.join(written, ["nb", "page"]).filter("__t < bottom and __b > top")
    return hit.groupBy(*slices.columns).agg(F.min("__t").alias("__t"), F.max("__b").alias("__b")).select(
        *[c for c in slices.columns if c not in ("top", "bottom")],
        F.greatest(F.col("top"), F.col("__t") - margin).alias("top"),
        F.least(F.col("bottom"), F.col("__b") + margin).alias("bottom"))


def up_to_part(slices: DataFrame, asked: DataFrame) -> DataFrame:
    """Slices that matter for the part asked: the whole task and the parts up to it."""
    return slices.join(asked, ["nb", "task"]).filter(
        "coalesce(asked_part, '') = '' or part = '' or part <= asked_part").drop("asked_part")


def lines_to_stretches(lines: DataFrame, slices: DataFrame) -> DataFrame:
    """Add ``stretch``: the first stretch with a slice around the line's centre, on its page."""
    centre = (F.col("top") + F.col("bottom")) / 2
    area = slices.select("nb", "page", "stretch", F.col("top").alias("__t"), F.col("bottom").alias("__b"))
    hit = lines.withColumn("__c", centre).join(area, ["nb", "page"]).filter("__t <= __c and __c < __b")
    return hit.groupBy(*lines.columns).agg(F.min("stretch").alias("stretch"))


def compose_stretches(lines: DataFrame, slices: DataFrame) -> DataFrame:
    """(nb, task, text, lines): the lines in the main colour and their number, under the label of their stretch where
    a task has several."""
    kept = lines.filter(F.coalesce("kind", F.lit("text")) == "text")
    labels = slices.select("nb", "task", "stretch", "part").distinct()
    several = labels.groupBy("nb", "task").agg((F.count(F.lit(1)) > 1).alias("labelled"))
    placed = lines_to_stretches(kept, slices).join(labels, ["nb", "stretch"])
    line = F.struct("page", "seq", "text")
    # One attempt is one text.
    blocks = placed.groupBy("nb", "task", "stretch", "part").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    title = F.when(F.col("part") != "", F.concat("part", F.lit(")"))).otherwise(
        F.concat(F.lit("Task "), F.col("task").cast("string"), F.lit(":")))
    body = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    texts = blocks.join(several, ["nb", "task"]).select(
        "nb", "task", "stretch", F.when(F.col("labelled"), F.concat_ws("\n", title, body)).otherwise(body).alias("t"), F.size("ls").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("stretch", "t"))), lambda x: x["t"])
    return texts.groupBy("nb", "task").agg(X.strip(F.array_join(ordered, "\n\n")).alias("text"), F.sum("n").alias("lines"))


def attempt_status(tasks: DataFrame, notebooks: DataFrame, slices: DataFrame, texts: DataFrame) -> DataFrame:
    """(nb, task, status, pages, text, lines): ok, no-notebook or nothing. ``tasks`` has (nb, task), nb NULL
    without a notebook."""
    pages = slices.groupBy("nb", "task").agg(F.array_sort(F.collect_set(F.col("page") + 1)).alias("pages"))
    known = notebooks.select("nb").distinct().withColumn("__nb", F.lit(True))
    status = F.when(F.col("__nb").isNull(), "no-notebook").when(
        F.coalesce("text", F.lit("")) == "", "nothing").otherwise("ok")
    return tasks.join(known, "nb", "left").join(pages, ["nb", "task"], "left").join(texts, ["nb", "task"], "left").select(
        "nb", "task", status.alias("status"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), "text",
        F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"))
