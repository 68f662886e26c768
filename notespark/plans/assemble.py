"""One text per task from the task, its context and an attempt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K, predicates as P, text as X
from ..operators.choose import covered_sections
from ..operators.outline import with_ancestors

# --- Fixed values: the wording of the documents ------------------------------------------
HEAD = ("Solve {what} so that I can follow it: a complete, rigorous solution that also shows "
        "where it comes from.")
WHOLE_TASK = "the task below"
ONE_PART = "only part {label}) of the task below"
EARLIER_PARTS = " The parts before it may be used as given."
RULES = [
    "Open with the idea in two or three sentences: the strategy, and the key observation that "
    "makes it work.",
    "Then carry it out. Before each step that is not routine, say in one sentence why it comes "
    "now: what it is for, what it sets up, or what the goal requires at this point. Where a "
    "choice looks pulled out of thin air (an auxiliary function, an epsilon, a case split, a "
    "clever estimate), say what led to it.",
    "Justify every step. Routine steps get a line; the steps the argument rests on are carried "
    "out in full - never skipped or covered by \"clearly\" or \"similarly\".",
    "No padding: no restating the task, no general remarks, no alternative approaches, no "
    "summary of what was just shown.",
]
ATTEMPT_RULE = (
    "My attempt so far is at the end, read by machine from my handwriting. Where it is on a "
    "sensible route, continue from it instead of starting over; if it has a mistake, point to "
    "the first one. A symbol that makes no sense there is more likely misread than meant.")
DEFINITIONS_RULE = "Use the definitions below exactly as stated there, in their notation."
RESULTS_RULE = ("The {what} below may be cited where they help - they are offered, not required. "
                "Do not force them in.")
TAIL = [
    "Any other result must be well known (standard Bachelor material): name it and quote, right "
    "below, the exact statement you use.",
    "If the task is ambiguous or seems wrong, say so instead of guessing.",
    "Write in the language of the task, in later replies too.",
]
EARLIER_HEAD = "# Earlier exercises this task may build on"
EARLIER_NOTE = ("(their statements only - their results may be used as given; my solutions to "
                "them are not included)")
OWN_SLIDES = "the lecture slides"
OWN_BOTH = "the lecture notes and slides"
OWN_NOTES = "the lecture notes"
OTHER_SCRIPT = "another script, "
ALL_SLIDES = "every slide of these sections"
SOME_SLIDES = "the slides chosen for this task"
ALL_STATEMENTS = "every definition and theorem of these sections"
SOME_STATEMENTS = "the definitions and theorems chosen for this task"
PLUS_SINGLES = ", plus the single statements named"
WITH_ALGORITHMS = ", algorithms included"
SOME_PROOFS = ", proofs only for "
NO_PROOFS = ", proofs omitted"
ASKED_HEAD = "# Asked now: part "
ATTEMPT_HEAD = "# My attempt so far\n"
SHEET, DUE, COURSE_HEAD = "\nSheet ", ", due: ", "\n\n# Course: "
TASK, EXERCISE, FROM_NOTES = "# Task ", "\n## Exercise ", " from the lecture notes"
# ---------------------------------------------------------------------------------------
REF = ["task_ref"]


def assemble(blocks: DataFrame, keys: list[str], order: list[str], text: str = "text", sep: str = "\n") -> DataFrame:
    """(keys, text): texts of a key joined in order. A document is one value, so its blocks
    meet in one row by nature."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return blocks.groupBy(*keys).agg(F.array_join(joined, sep).alias("text"))


def _fill(template: str, slot: str, value: Column) -> Column:
    before, after = template.split(slot)
    return F.concat(F.lit(before), value, F.lit(after))


def instruction(part: Column, definitions: Column, results: Column, earlier: Column, attempt: Column) -> Column:
    """The opening of a document; each rule only where the document holds what it is about."""
    has_part = F.coalesce(part, F.lit("")) != ""
    what = F.when(has_part, _fill(ONE_PART, "{label}", part)).otherwise(WHOLE_TASK)
    head = F.concat(_fill(HEAD, "{what}", what), F.when(has_part, EARLIER_PARTS).otherwise(""))
    offered = F.concat_ws(" and ", F.when(results, "theorems"), F.when(earlier, "earlier exercises"))
    rules = [F.lit(r) for r in RULES] + [
        F.when(attempt, ATTEMPT_RULE), F.when(definitions, DEFINITIONS_RULE),
        F.when(offered != "", _fill(RESULTS_RULE, "{what}", offered)),
    ] + [F.lit(r) for r in TAIL]
    return F.concat_ws("\n", head, *[F.concat(F.lit("- "), r) for r in rules])


def source_blocks(context: DataFrame, sections: DataFrame) -> DataFrame:
    """(task_ref, source, head): per source of a context what it covers and holds.

    ``context``: chosen statements (task_ref, place, id, type, section, source, has_proof,
    proof_on, all_proofs); ``sections``: (task_ref, item, title, root_title), the keys chosen.
    """
    by = [*REF, "source"]
    ctx = context.withColumn("source", F.coalesce("source", F.lit("")))
    up = with_ancestors(ctx.select(*by, "section").distinct(), "section", "item")
    used = up.select(*by, "item").distinct().join(sections, [*REF, "item"])
    label = K.section_label(F.col("item"), F.col("title"), F.col("root_title"))
    named = used.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(K.sort_key(F.col("item")).alias("k"), label.alias("t")))),
        lambda x: x["t"]), ", ").alias("named"))
    inside = covered_sections(ctx, sections, REF).withColumn("inside", F.lit(True))
    marked = ctx.join(inside, [*REF, "section"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    prefix = F.concat("source", F.lit(": "))
    shown = F.when(F.col("source") != "", F.when(
        F.startswith("id", prefix), F.substring(F.col("id"), F.length(prefix) + 1, F.length("id"))).otherwise(F.col("id"))).otherwise(F.col("id"))

    def listed(cond: Column, value: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(cond, F.struct(F.col("place"), value.alias("t"))))), lambda x: x["t"]), ", ")

    with_proof = F.col("has_proof") & F.col("proof_on") & ~F.col("all_proofs")
    slide = F.col("type") == "Slide"
    facts = marked.groupBy(*by).agg(
        listed(~F.col("inside"), shown).alias("singles"), listed(with_proof, F.col("id")).alias("proofs"),
        F.bool_and(slide).alias("all_slides"), F.bool_or(slide).alias("any_slide"),
        F.bool_or(P.is_algorithm(F.col("type"))).alias("algorithms"), F.bool_or("all_proofs").alias("all_proofs"),
    ).join(named, by, "left").withColumn("named", F.coalesce("named", F.lit("")))
    has_sections, has_singles = F.col("named") != "", F.col("singles") != ""
    own = F.when(F.col("all_slides"), OWN_SLIDES).when(
        F.col("any_slide"), OWN_BOTH).otherwise(OWN_NOTES)
    source = F.when(F.col("source") == "", own).otherwise(F.concat(F.lit(OTHER_SCRIPT), F.col("source")))
    where = F.concat_ws("; ", F.when(has_sections, F.concat(F.lit("section "), F.col("named"))), F.when(has_singles, F.col("singles")))
    what = F.when(F.col("all_slides"), F.when(has_sections, ALL_SLIDES).otherwise(SOME_SLIDES)).otherwise(
        F.when(has_sections, ALL_STATEMENTS).otherwise(SOME_STATEMENTS))
    note = F.concat(
        what, F.when(has_sections & has_singles, PLUS_SINGLES).otherwise(""),
        F.when(F.col("algorithms"), WITH_ALGORITHMS).otherwise(""),
        F.when(F.col("proofs") != "", F.concat(F.lit(SOME_PROOFS), F.col("proofs")))
        .when(~F.col("all_proofs") & ~F.col("all_slides"), NO_PROOFS).otherwise(""))
    return facts.select(*by, F.concat(F.lit("# From "), source, F.lit(": "), where, F.lit("\n("), note, F.lit(")")).alias("head"))


def build_documents(tasks: DataFrame, context: DataFrame, sections: DataFrame, earlier: DataFrame) -> DataFrame:
    """(task_ref, text). A switched-off task leaves out instruction and task, a
    switched-off context leaves out statements and earlier tasks.

    ``tasks``: (task_ref, course_name, sheet_number, discussion_date, number, title, text, found,
    parts, asked, attempt, include_task, include_context); ``context``: statements as in
    ``source_blocks`` with name, text and proof; ``earlier``: (task_ref, place, label, text).
    """
    with_context = tasks.filter("include_context").select(*REF)
    ctx = context.join(with_context, REF, "left_semi").withColumn("source", F.coalesce("source", F.lit("")))
    past = earlier.join(with_context, REF, "left_semi")

    kind = P.kind_of(F.col("type"), F.col("name"))
    flags = ctx.groupBy(*REF).agg(F.bool_or(kind == "definition").alias("definitions"), F.bool_or(kind == "result").alias("results"))
    has_past = past.select(*REF).distinct().withColumn("has_past", F.lit(True))
    no = F.lit(False)
    full = tasks.join(flags, REF, "left").join(has_past, REF, "left").withColumn(
        "asked_part", F.get(F.filter("parts", lambda p: p["label"] == F.col("asked")), F.lit(0))).withColumn(
        "attempt", X.strip(F.coalesce("attempt", F.lit(""))))
    opening = instruction(F.col("asked_part.label"), F.coalesce("definitions", no), F.coalesce("results", no),
                          F.coalesce("has_past", no), F.col("attempt") != "")
    due = F.when(F.coalesce("discussion_date", F.lit("")) != "", F.concat(
        F.lit(SHEET), F.coalesce(F.col("sheet_number").cast("string"), F.lit("?")), F.lit(DUE), F.col("discussion_date"))).otherwise("")
    head = F.concat(F.lit(TASK), F.col("number").cast("string"),
                    F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(": "), F.col("title"))).otherwise(""))
    exercises = F.array_join(F.transform("found", lambda e: F.concat(
        F.lit(EXERCISE), e["number"], F.lit(FROM_NOTES),
        F.when(F.coalesce(e["title"], F.lit("")) != "", F.concat(F.lit(": "), e["title"])).otherwise(""),
        F.lit("\n"), e["text"], F.lit("\n"))), "")
    task_text = F.concat(opening, F.lit(COURSE_HEAD), F.col("course_name"), due, F.lit("\n\n"), head, F.lit("\n"),
                         F.col("text"), F.lit("\n"), exercises)

    def rows(df: DataFrame, block: int, source: Column, place: Column, text: Column) -> DataFrame:
        return df.select(*REF, F.lit(block).alias("block"), source.alias("source"), place.cast("bigint").alias("place"), text.alias("text"))

    empty, zero = F.lit(""), F.lit(0)
    past_text = F.concat(F.lit("## "), F.col("label"), F.lit("\n"), F.col("text"), F.lit("\n"))
    entry = F.concat(F.lit("\n"), X.entry_text(F.col("id"), F.col("name"), F.col("text")),
                     F.when(F.col("proof_on"), X.proof_text(F.col("proof"))).otherwise(""))
    last = ctx.groupBy(*REF, "source").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    sourced = ctx.join(last, [*REF, "source"])
    heads = source_blocks(ctx, sections).join(last, [*REF, "source"])
    # Own material first, then other scripts in the order they first appear.
    source_ord = F.when(F.col("source") == "", F.lit(-1)).otherwise(F.col("first")).cast("bigint")
    parts = [
        rows(full.filter("include_task"), 0, empty, zero, task_text),
        rows(past.select(*REF).distinct(), 1, empty, F.lit(-1), F.lit(f"{EARLIER_HEAD}\n{EARLIER_NOTE}\n")),
        rows(past, 1, empty, F.col("place"), past_text),
        rows(heads, 2, source_ord.cast("string"), F.lit(-1), F.col("head")),
        rows(sourced, 2, source_ord.cast("string"), F.col("place"),
             F.concat(entry, F.when(F.col("place") == F.col("last"), "\n").otherwise(""))),
        rows(full.filter("include_task and asked_part is not null"), 3, empty, zero,
             F.concat(F.lit(ASKED_HEAD), F.col("asked_part.label"), F.lit(")\n"), F.col("asked_part.text"), F.lit("\n"))),
        rows(full.filter("attempt <> ''"), 4, empty, zero, F.concat(F.lit(ATTEMPT_HEAD), F.col("attempt"), F.lit("\n"))),
    ]
    blocks = reduce(DataFrame.unionByName, parts).withColumn("source", F.coalesce(F.col("source").try_cast("bigint"), F.lit(0)))
    docs = assemble(blocks, REF, ["block", "source", "place"])
    return docs.select(*REF, F.concat(X.rstrip(F.col("text")), F.lit("\n")).alias("text"))
