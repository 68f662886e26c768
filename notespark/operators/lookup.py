"""Lookups between sheets, tasks, exercises, entries, files and remembered state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P, text as X
from ..scan import row_number, scan
from .choose import script_order

FOUND = "array<struct<number:string,title:string,text:string,page:int>>"


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the smallest by ``order``: an aggregate, so hot keys shrink before
    the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def latest_sheet(sheets: DataFrame) -> DataFrame:
    """The newest sheet of a course, by number (none counts 0), then id."""
    return latest_by(sheets, ["course"], F.struct(F.coalesce("sheet_number", F.lit(0)), F.col("sheet_id")))


def newest_file(files: DataFrame, keys: list[str]) -> DataFrame:
    return latest_by(files, keys, F.struct(F.col("mtime"), F.col("path")))


def resolve_refs(tasks: DataFrame, exercises: DataFrame) -> DataFrame:
    """(course, sheet_id, pos, found, missing) for tasks with references: each reference is the
    first exercise of the course with that number; order is kept.

    ``tasks``: (course, sheet_id, pos, script_references); ``exercises``: (course, pos, number,
    title, text, page).
    """
    refs = tasks.select("course", "sheet_id", "pos", F.posexplode("script_references").alias("k", "number"))
    firsts = first_by(exercises.select("course", "number", "title", "text", "page", F.col("pos").alias("__p")),
                      ["course", "number"], F.col("__p"))
    joined = refs.join(firsts.withColumn("__hit", F.lit(True)), ["course", "number"], "left")
    item = F.struct("k", F.col("__hit").alias("hit"), "number", "title", "text", F.col("page").cast("int").alias("page"))
    # A task's references stand in its own text, so the list is short.
    lists = joined.groupBy("course", "sheet_id", "pos").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    found = F.transform(F.filter("xs", lambda x: x["hit"].isNotNull()),
                        lambda x: F.struct(x["number"].alias("number"), x["title"].alias("title"), x["text"].alias("text"), x["page"].alias("page")))
    missing = F.transform(F.filter("xs", lambda x: x["hit"].isNull()), lambda x: x["number"])
    return lists.select("course", "sheet_id", "pos", found.cast(FOUND).alias("found"), missing.alias("missing"))


def with_found(tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    none = F.array()
    return tasks.join(resolved, ["course", "sheet_id", "pos"], "left").withColumn(
        "found", F.coalesce("found", none.cast(FOUND))).withColumn("missing", F.coalesce("missing", none.cast("array<string>")))


def only_found() -> Column:
    """The exercise of a task that points at exactly one, else NULL."""
    return F.when(F.size("found") == 1, F.get("found", F.lit(0)))


def task_query() -> Column:
    """What a task asks, with the exercises it points at."""
    return F.concat_ws("\n", F.concat(F.array("text"), F.transform("found", lambda e: e["text"])))


def task_title() -> Column:
    only = only_found()
    named = F.concat(F.lit("("), only["number"], F.lit(")"),
                     F.when(F.coalesce(only["title"], F.lit("")) != "", F.concat(F.lit(" "), only["title"])).otherwise(""))
    return F.when(F.size("found") == 1, named).otherwise(P.guess_title(F.col("text")))


def task_parts() -> tuple[Column, Column]:
    """(preamble, parts) of what a task asks."""
    text = F.coalesce(only_found()["text"], F.col("text"))
    return X.preamble(text), X.subparts(text)


def task_listing(tasks: DataFrame, resolved: DataFrame, efforts: DataFrame, after: DataFrame) -> DataFrame:
    """Tasks as they are shown: title, reflowed text with the exercises, effort, predecessors,
    missing references, page and parts. ``efforts``: (sheet_id, number, effort); ``after``:
    (sheet_id, task, after)."""
    before, parts = task_parts()
    quoted = F.array_join(F.transform("found", lambda e: F.concat(
        F.lit("\n\n("), e["number"], F.lit(") "), X.readable(e["text"]))), "")
    full = with_found(tasks, resolved).join(efforts, ["sheet_id", "number"], "left").join(
        after.select("sheet_id", F.col("task").alias("number"), "after"), ["sheet_id", "number"], "left")
    return full.select(
        "course", "sheet_id", "number", F.coalesce(task_title(), F.lit("")).alias("title"),
        F.concat(X.readable(F.col("text")), quoted).alias("text"),
        X.effort_ten(F.col("effort")).alias("effort"), F.coalesce(X.effort_word(F.col("effort")), F.lit("")).alias("effort_word"),
        F.when(F.col("effort").isNotNull(), F.col("after")).alias("after"), "missing",
        F.get("found", F.lit(0))["page"].alias("page"), X.readable(before).alias("preamble"),
        F.transform(parts, lambda p: F.struct(p["label"].alias("label"), X.readable(p["text"]).alias("text"))).alias("parts"))


def unresolved_refs(tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tasks with references that no exercise answers, and which."""
    return tasks.select("course", "sheet_id", "pos", "number").join(
        resolved.filter(F.size("missing") > 0).select("course", "sheet_id", "pos", "missing"), ["course", "sheet_id", "pos"])


def earlier_tasks(sheets: DataFrame, tasks: DataFrame, current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(course, ref, label, text) of remembered tasks whose sheet lies before the current one.

    ``current``: (course, number); ``wanted``: (course, ref). The remembered references are
    resolved first, so nothing is paired with all earlier sheets.
    """
    named = tasks.join(sheets.select("course", "sheet_id", "sheet_number"), ["course", "sheet_id"]).withColumn(
        "ref", task_ref(F.col("sheet_id"), F.col("number")))
    asked = named.join(wanted.distinct(), ["course", "ref"], "left_semi").join(
        current.select("course", F.col("number").alias("__now")), "course")
    return asked.filter("sheet_number < __now").select(
        "course", "ref", "sheet_number", "sheet_id", "number", earlier_label(), "text")


def earlier_candidates(sheets: DataFrame, tasks: DataFrame, current: DataFrame) -> DataFrame:
    """(course, label, ref, text): every task of the sheets before the current one; of two
    versions of a sheet the first by id counts."""
    before = sheets.filter("sheet_number is not null").join(
        current.select("course", F.col("number").alias("__now")), "course").filter("sheet_number < __now").drop("__now")
    rows = tasks.join(before.select("course", "sheet_id", "sheet_number"), ["course", "sheet_id"]).select(
        "course", earlier_label(), task_ref(F.col("sheet_id"), F.col("number")).alias("ref"), "text", "sheet_id", "pos")
    return first_by(rows, ["course", "label"], F.struct("sheet_id", "pos")).select("course", "label", "ref", "text")


def task_ref(sheet_id: Column, number: Column) -> Column:
    return F.concat(sheet_id.cast("string"), F.lit("#"), number.cast("string"))


def earlier_label() -> Column:
    sheet = F.coalesce(F.when(F.col("sheet_number") != 0, F.col("sheet_number").cast("string")), F.col("sheet_id").cast("string"))
    return F.concat(F.lit("Sheet "), sheet, F.lit(", task "), F.col("number").cast("string")).alias("label")


def source_of(targets: DataFrame, nodes: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """(course, target, pdf, page, what): where a line of a selection stands. A target is
    ``section:<key>`` or an entry id; the first entry of an id counts; without a file of its
    own the course's notes."""
    prefix = "section:"
    key = F.when(F.col("target").startswith(prefix), F.substring(F.col("target"), F.lit(len(prefix) + 1), F.length("target")))
    n = nodes.groupBy("course", F.col("key").alias("__key")).agg(
        F.min_by(F.struct("pdf", "page", "title"), "seq").alias("__n"))
    e = first_by(entries.select("course", F.col("id").alias("__id"), "pdf", "page", "pos"), ["course", "__id"], F.col("pos"))
    e = e.select("course", "__id", F.struct("pdf", "page").alias("__e"))
    joined = (
        targets.withColumn("__key", key).withColumn("__id", F.when(key.isNull(), F.col("target")))
        .join(n, ["course", "__key"], "left").join(e, ["course", "__id"], "left")
        .join(notes.select("course", F.col("pdf").alias("__notes")), "course", "left")
    )
    hit = F.col("__n").isNotNull() | F.col("__e").isNotNull()
    return joined.select(
        "course", "target",
        F.when(hit, F.coalesce(F.col("__n.pdf"), F.col("__e.pdf"), F.col("__notes"))).alias("pdf"),
        F.coalesce(F.col("__n.page"), F.col("__e.page")).alias("page"),
        F.coalesce(X.non_empty(F.col("__n.title")), F.col("__key"), F.col("target")).alias("what"))


def page_of_task(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """(sheet_id, number, page): the page that holds the first 60 characters of the task's
    first line, else its first three words.

    A word with blanks on both sides in what is looked for is a whole word of the page, so
    pages are found by the longest such word and then checked; only a line of one or two
    words is compared with all pages of its sheet.
    """
    first = F.get(F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != ""), F.lit(0))
    words = F.array_join(F.slice(F.split(X.collapse(F.col("first")), " "), F.lit(1), F.lit(3)), " ")
    needles = tasks.select("sheet_id", "number", first.alias("first")).filter("first is not null").select(
        "sheet_id", "number", F.posexplode(F.array(F.substring("first", 1, 60), words)).alias("k", "needle"))
    parts = F.split("needle", r"(?U)\s+")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = needles.withColumn("word", longest["w"])
    tokens = pages.select("sheet_id", "page", F.explode(F.array_distinct(F.split("text", r"(?U)\s+"))).alias("word"))
    found = keyed.filter("word is not null").join(tokens, ["sheet_id", "word"]).select("sheet_id", "number", "k", "needle", "page")
    short = keyed.filter("word is null").join(pages.select("sheet_id", "page"), "sheet_id").select("sheet_id", "number", "k", "needle", "page")
    hits = found.unionByName(short).join(pages.select("sheet_id", "page", "text"), ["sheet_id", "page"]).filter(F.contains("text", "needle"))
    best = hits.groupBy("sheet_id", "number").agg(F.min(F.struct("k", "page")).alias("m"))
    return tasks.select("sheet_id", "number").join(best, ["sheet_id", "number"], "left").select("sheet_id", "number", F.col("m.page").alias("page"))


def resolve_state(state: DataFrame, sheets: DataFrame, tasks: DataFrame) -> DataFrame:
    """(course, sheet_id, task, part): the remembered place, repaired where it is gone.

    ``state``: (course, sheet, task, part); a sheet may be remembered without its course. A
    missing sheet becomes the latest, a missing task the first, a missing part none.
    ``tasks``: (sheet_id, pos, number, labels ARRAY<STRING>).
    """
    named = F.col("sheet_id").cast("string")
    one = sheets.select("course", named.alias("__one"), F.col("sheet_id").alias("__hit1"))
    two = sheets.select("course", named.alias("__two"), F.col("sheet_id").alias("__hit2"))
    last = latest_sheet(sheets).select("course", F.col("sheet_id").alias("__last"))
    at = (
        state.withColumn("__one", F.col("sheet").cast("string")).withColumn("__two", F.concat_ws("/", "course", "__one"))
        .join(one, ["course", "__one"], "left").join(two, ["course", "__two"], "left").join(last, "course", "left")
        .withColumn("sheet_id", F.coalesce("__hit1", "__hit2", "__last"))
    )
    first = tasks.groupBy("sheet_id").agg(F.min_by("number", "pos").alias("__first"))
    known = tasks.select("sheet_id", F.col("number").alias("task"), F.lit(True).alias("__known")).distinct()
    placed = at.join(known, ["sheet_id", "task"], "left").join(first, "sheet_id", "left").withColumn(
        "task", F.when(F.col("__known"), F.col("task")).otherwise(F.col("__first")))
    labels = first_by(tasks.select("sheet_id", F.col("number").alias("task"), "labels", "pos"), ["sheet_id", "task"], F.col("pos"))
    part = F.when(F.array_contains("labels", F.col("part")), F.col("part")).otherwise("")
    return placed.join(labels.select("sheet_id", "task", "labels"), ["sheet_id", "task"], "left").select(
        "course", "sheet_id", "task", F.coalesce(part, F.lit("")).alias("part"))


def fingerprint(tasks: DataFrame) -> DataFrame:
    """(sheet_id, tasks_key): a digest of the numbers and texts of a sheet's tasks, in order.
    Texts are hashed first, so a sheet's list holds digests."""
    each = tasks.select("sheet_id", F.struct("pos", F.sha1(F.to_json(F.array(
        F.col("number").cast("string"), F.col("text")))).alias("h")).alias("x"))
    return each.groupBy("sheet_id").agg(F.sha1(F.to_json(F.array_sort(F.collect_list("x")))).alias("tasks_key"))


def valid_plans(plans: DataFrame, keys: DataFrame, current_format: int) -> DataFrame:
    """Plans of the current format whose sheet still has the tasks they were made for. A plan
    without a fingerprint, or whose sheet is gone, holds."""
    now = keys.select("sheet_id", F.col("tasks_key").alias("__now"))
    return plans.filter(F.coalesce("format", F.lit(1)) >= current_format).join(now, "sheet_id", "left").filter(
        F.col("tasks_key").isNull() | F.col("__now").isNull() | (F.col("tasks_key") == F.col("__now"))).drop("__now")


def selection_for_task(state: DataFrame, planned: DataFrame) -> DataFrame:
    """Selection lines (course, kind, item) kept for the task each course stands on.
    ``planned``: (sheet_id, task, kind, item) of valid plans."""
    return state.select("course", "sheet_id", "task").join(planned, ["sheet_id", "task"]).select("course", "kind", "item")


def remember_selection(planned: DataFrame, state: DataFrame, selection: DataFrame) -> DataFrame:
    """Planned lines with those of the current tasks replaced by the edited selection; only
    for tasks that have a plan."""
    at = ["sheet_id", "task"]
    current = state.select("course", *at).join(planned.select(*at).distinct(), at, "left_semi")
    return planned.join(current.select(*at), at, "left_anti").unionByName(
        current.join(selection, "course").select(*at, "kind", "item"))


def locate_files(records: DataFrame, files: DataFrame, matched: DataFrame) -> DataFrame:
    """(record columns, found): the stored path if it is still there, else a file of that name in
    the course, else the newest file a rule assigns to the course.

    ``records``: (course, category, path, name); ``files``: (course, category, path, name, mtime).
    """
    slot = ["course", "category"]
    here = files.select(F.col("path"), F.lit(True).alias("__here")).distinct()
    named = files.groupBy(*slot, "name").agg(F.min("path").alias("__named"))
    newest = newest_file(matched.select(*slot, "path", "mtime"), slot).select(*slot, F.col("path").alias("__newest"))
    return records.join(here, "path", "left").join(named, [*slot, "name"], "left").join(newest, slot, "left").select(
        *records.columns, F.coalesce(F.when(F.col("__here"), F.col("path")), F.col("__named"), F.col("__newest")).alias("found"))


def notebook_for(sheets: DataFrame, notebooks: DataFrame) -> DataFrame:
    """(course, sheet_id, path): the newest notebook of the course whose last number is the
    sheet's. ``notebooks``: (course, path, stem, mtime)."""
    numbered = notebooks.withColumn("sheet_number", X.last_number(F.col("stem"))).filter("sheet_number is not null")
    best = newest_file(numbered.select("course", "sheet_number", "path", "mtime"), ["course", "sheet_number"])
    return sheets.select("course", "sheet_id", "sheet_number").join(
        best.select("course", "sheet_number", "path"), ["course", "sheet_number"], "left").select("course", "sheet_id", "path")


def stale(results: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``stale``: the file is there and has another mtime than the result was made from."""
    now = files.select("path", F.col("mtime").alias("__now"))
    return results.join(now, "path", "left").withColumn(
        "stale", F.coalesce(F.col("__now").isNotNull() & ~F.col("__now").eqNullSafe(F.col("mtime")), F.lit(False))).drop("__now")


def active(rules: DataFrame, semester: str) -> DataFrame:
    return rules.filter(F.col("semester") == semester)


def past(rules: DataFrame, semester: str) -> DataFrame:
    return rules.filter(F.col("semester") != semester)


def usage_totals(usage: DataFrame, keys: list[str], price: float, last: str) -> DataFrame:
    """Requests, tokens, cost and its estimated part; a missing cost is tokens x price.
    ``last`` names the pick order; cost and estimate of the last pick are returned as well."""
    tokens = F.coalesce("input_tokens", F.lit(0))
    cost = F.coalesce(F.col("cost"), tokens * F.lit(price))
    guess = F.col("cost").isNull()
    per_pick = usage.groupBy(*keys, last).agg(
        F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("t"), F.sum(cost).alias("c"),
        F.sum(F.when(guess, cost).otherwise(0.0)).alias("e"), F.bool_or(guess).alias("g"))
    return per_pick.groupBy(*keys).agg(
        F.sum("n").alias("requests"), F.sum("t").alias("input_tokens"), F.sum("c").alias("cost"),
        F.sum("e").alias("estimated"), F.max_by("c", last).alias("last_cost"), F.max_by("g", last).alias("last_estimated"))


def course_listing(courses: DataFrame, sheets: DataFrame, entries: DataFrame) -> DataFrame:
    """(course, name, sheets, has_notes)."""
    n = sheets.groupBy("course").agg(F.count(F.lit(1)).alias("sheets"))
    notes = entries.select("course").distinct().withColumn("has_notes", F.lit(True))
    return courses.join(n, "course", "left").join(notes, "course", "left").select(
        "course", "name", F.coalesce("sheets", F.lit(0)).alias("sheets"), F.coalesce("has_notes", F.lit(False)).alias("has_notes"))


def sheet_listing(sheets: DataFrame, tasks: DataFrame, planned: DataFrame) -> DataFrame:
    """(course, sheet_id, sheet_number, tasks, newest, planned)."""
    n = tasks.groupBy("course", "sheet_id").agg(F.count(F.lit(1)).alias("tasks"))
    top = latest_sheet(sheets).select("course", "sheet_id", F.lit(True).alias("newest"))
    plans = planned.select("sheet_id").distinct().withColumn("planned", F.lit(True))
    return sheets.join(n, ["course", "sheet_id"], "left").join(top, ["course", "sheet_id"], "left").join(plans, "sheet_id", "left").select(
        "course", "sheet_id", "sheet_number", F.coalesce("tasks", F.lit(0)).alias("tasks"),
        F.coalesce("newest", F.lit(False)).alias("newest"), F.coalesce("planned", F.lit(False)).alias("planned"))


def plan_summary(plan: DataFrame, lines: DataFrame, statements: DataFrame) -> DataFrame:
    """(sheet_id, task, effort, word, statements, proofs, earlier). ``plan``: (sheet_id, task,
    effort); ``lines``: (sheet_id, task, kind, item); ``statements``: (sheet_id, task, id) held."""
    at = ["sheet_id", "task"]
    kinds = lines.groupBy(*at).agg(
        F.count_if(F.col("kind") == "proof").alias("proofs"), F.count_if(F.col("kind") == "earlier").alias("earlier"))
    held = statements.groupBy(*at).agg(F.count(F.lit(1)).alias("statements"))
    zero = F.lit(0).cast("bigint")
    return plan.join(kinds, at, "left").join(held, at, "left").select(
        *at, X.effort_ten(F.col("effort")).alias("effort"), X.effort_word(F.col("effort")).alias("word"),
        *[F.coalesce(c, zero).alias(c) for c in ("statements", "proofs", "earlier")])


def judgement_items(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, statement, has_proof): what is asked about every statement, each id once,
    the first in script order; the name leads."""
    name = F.coalesce("name", F.lit(""))
    text = F.concat(F.when(name != "", F.concat(F.lit("("), name, F.lit(") "))).otherwise(""), F.coalesce("text", F.lit("")))
    rows = entries.select(*keys, "id", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(script_order())]).alias("__place"),
                          text.alias("statement"), P.has_proof(F.col("proof")).alias("has_proof"))
    return first_by(rows, [*keys, "id"], F.col("__place")).drop("__place")


def merged_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``place``: the number of a row in its key's order."""
    return scan(df, keys, order, place=row_number())
