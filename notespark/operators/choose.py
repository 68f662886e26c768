"""Selections over an outline: what is chosen, how it rolls up, how it is stored and edited.

A selection is rows ``(course, kind, item)`` with kind ``section``, ``statement``, ``proof``,
``proofs`` (all proofs) or ``earlier``. Statements are ``(course, pos, id, type, section, page,
name, text, proof)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K, predicates as P, text as X
from ..scan import row_number, running_sum, scan
from .chains import fold
from .outline import with_ancestors

COURSE = ["course"]
Sizes = tuple[int, int] | None  # an upper bound of scan.key_sizes, to save the count


def statements(entries: DataFrame, algorithms: bool = False) -> DataFrame:
    return entries.filter(P.is_statement(F.col("type"), algorithms))


def section_members(entries: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Statements grouped by section, as rows: each with its number in the section."""
    placed = entries.filter(F.col("section").isNotNull())
    return scan(placed, [*keys, "section"], [order], member=row_number())


def covered_sections(sections: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sections at or beneath a picked key. ``picked`` has (keys, item)."""
    up = with_ancestors(sections.select(*keys, "section").distinct(), "section", "item")
    return up.join(picked.select(*keys, "item").distinct(), [*keys, "item"], "left_semi").select(*keys, "section").distinct()


def entries_in(entries: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    return entries.join(covered_sections(entries, picked, keys), [*keys, "section"], "left_semi")


def script_order() -> list[Column]:
    section = F.coalesce(F.when(F.col("section") != "", F.col("section")), F.lit("0"))
    return [K.sort_key(section), F.coalesce(F.col("page"), F.lit(0)), F.col("pos")]


def chosen(entries: DataFrame, selection: DataFrame, algorithms: bool = False,
           keys: list[str] = COURSE) -> DataFrame:
    """Statements of the chosen sections and the single ones, each once. A single one may be
    an algorithm while those are off."""
    sections = selection.filter("kind = 'section'").select(*keys, "item")
    singles = selection.filter("kind = 'statement'").select(*keys, F.col("item").alias("id")).distinct()
    inside = covered_sections(entries, sections, keys).withColumn("__in", F.lit(True))
    picked = (
        statements(entries, True)
        .join(inside, [*keys, "section"], "left")
        .join(singles.withColumn("__single", F.lit(True)), [*keys, "id"], "left")
    )
    by_section = F.coalesce(F.col("__in"), F.lit(False)) & P.is_statement(F.col("type"), algorithms)
    return picked.filter(by_section | F.coalesce(F.col("__single"), F.lit(False))).select(*entries.columns)


def rollup_tree(entries: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """Every key of the tree with what lies at or beneath it: (keys, node, n, size)."""
    return with_ancestors(entries, "section").groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))


def tri_state(entries: DataFrame, selected: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """Per node: none, some or all of its statements chosen, how many, and its size."""
    marked = entries.join(selected.select(*keys, "id").distinct().withColumn("__on", F.lit(1)), [*keys, "id"], "left")
    # Sections first: one row per section goes up the tree instead of one per statement.
    per_section = marked.groupBy(*keys, "section").agg(
        F.count("__on").alias("on"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    nodes = with_ancestors(per_section, "section").groupBy(*keys, "node").agg(
        F.sum("on").alias("on"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    state = F.when(F.col("on") == 0, "none").when(F.col("on") == F.col("n"), "all").otherwise("some")
    return nodes.select(*keys, "node", state.alias("state"), "on", "n",
                        F.concat_ws("/", F.col("on").cast("string"), F.col("n").cast("string")).alias("count"), "size")


def compress(entries: DataFrame, ids: DataFrame, algorithms: bool = False,
             keys: list[str] = COURSE) -> DataFrame:
    """(keys, kind, item) selecting exactly ``ids``: outermost nodes whose statements are all
    chosen become sections, the rest stay single.

    A node is full only if all nodes beneath it are, so a full node is outermost exactly if
    its parent is not full.
    """
    every = statements(entries, True).join(
        ids.select(*keys, "id").distinct().withColumn("__on", F.lit(True)), [*keys, "id"], "left"
    ).withColumn("__on", F.coalesce("__on", F.lit(False)))
    counted = every.filter(P.is_statement(F.col("type"), algorithms))
    per_section = counted.groupBy(*keys, "section").agg(F.bool_and("__on").alias("__on"))
    full = with_ancestors(per_section, "section").groupBy(*keys, "node").agg(
        F.bool_and("__on").alias("__on")).filter("__on").select(*keys, "node")
    outer = full.withColumn("__up", K.parent(F.col("node"))).join(
        full.select(*keys, F.col("node").alias("__up")), [*keys, "__up"], "left_anti").select(*keys, "node")
    sections = outer.select(*keys, F.lit("section").alias("kind"), F.col("node").alias("item"))
    inside = covered_sections(counted, outer.withColumnRenamed("node", "item"), keys)
    covered = counted.join(inside, [*keys, "section"], "left_semi").select(*keys, "id").distinct()
    singles = every.filter("__on").join(covered, [*keys, "id"], "left_anti").select(
        *keys, F.lit("statement").alias("kind"), F.col("id").alias("item")).distinct()
    return sections.unionByName(singles)


def with_sizes(entries: DataFrame) -> DataFrame:
    """Add ``size``, ``proof_size`` and ``referral`` (a proof that only points elsewhere)."""
    proof = F.coalesce(F.col("proof"), F.lit(""))
    return entries.withColumn("size", X.entry_size(F.col("id"), F.col("name"), F.col("text"))).withColumn(
        "proof_size", X.proof_size(F.col("proof"))).withColumn("referral", (proof != "") & P.is_referral(proof))


def proof_wanted(entries: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``proof_on``: all proofs are on, or this one is picked."""
    every = selection.filter("kind = 'proofs'").select(*keys).distinct().withColumn("__all", F.lit(True))
    mine = selection.filter("kind = 'proof'").select(*keys, F.col("item").alias("id")).distinct().withColumn("__one", F.lit(True))
    return entries.join(every, keys, "left").join(mine, [*keys, "id"], "left").withColumn(
        "proof_on", F.coalesce("__all", "__one", F.lit(False))).drop("__all", "__one")


def context_size(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Characters the entries cost. ``entries`` has size, proof_size, proof_on."""
    cost = F.col("size") + F.when(F.col("proof_on"), F.col("proof_size")).otherwise(0)
    return entries.groupBy(*keys).agg(F.sum(cost).alias("size"))


def totals(entries: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Statements, proofs on, statements with a proof, earlier tasks and size per selection.
    ``entries`` are the chosen statements with sizes."""
    marked = proof_wanted(entries, selection, keys)
    offered = (F.col("proof_size") > 0) & ~F.col("referral")
    on = F.col("proof_on")
    counted = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("statements"), F.count_if(offered & on).alias("proofs"),
        F.count_if(offered).alias("with_proof"),
        F.sum(F.col("size") + F.when(on, F.col("proof_size")).otherwise(0)).alias("size"))
    earlier = selection.filter("kind = 'earlier'").groupBy(*keys).agg(F.countDistinct("item").alias("earlier"))
    zero = F.lit(0).cast("bigint")
    return counted.join(earlier, keys, "full").select(
        *keys, *[F.coalesce(c, zero).alias(c) for c in ("statements", "proofs", "with_proof", "earlier", "size")])


def context_flags(context: DataFrame, keys: list[str]) -> DataFrame:
    """Does a context hold definitions, results, slides, notes, and the name of its source."""
    kind = P.kind_of(F.col("type"), F.col("name"))
    slide = F.col("type") == "Slide"
    flags = context.groupBy(*keys).agg(
        F.bool_or(kind == "definition").alias("definitions"), F.bool_or(kind == "result").alias("results"),
        F.bool_or(slide).alias("slides"), F.bool_or(~slide).alias("notes"))
    source = F.when(F.col("slides") & F.col("notes"), "lecture notes and slides").when(
        F.col("slides"), "lecture slides").otherwise("lecture notes")
    return flags.withColumn("source_name", source)


def pick(scores: DataFrame, keys: list[str], threshold: float = 0.5,
         proof_threshold: float | None = None) -> DataFrame:
    """(keys, id, statement, proof) from probabilities (keys, id, kind, p): a wanted proof
    brings its statement along."""
    bar = threshold if proof_threshold is None else proof_threshold
    best = scores.groupBy(*keys, "id").agg(
        F.max(F.when(F.col("kind") == "statement", F.col("p"))).alias("sp"),
        F.max(F.when(F.col("kind") == "proof", F.col("p"))).alias("pp"))
    proof = F.coalesce(F.col("pp") >= bar, F.lit(False))
    statement = F.col("sp").isNotNull() & ((F.col("sp") >= threshold) | proof)
    return best.select(*keys, "id", statement.alias("statement"), proof.alias("proof")).filter("statement or proof")


# --- Budget ----------------------------------------------------------------------------

def trim(proofs: DataFrame, base: DataFrame, keys: list[str], limit: int, sizes: Sizes = None) -> DataFrame:
    """Add ``kept``, ``spent`` (base and kept proofs) and ``total``: proofs go least certain
    first (``p``, then ``ord``) until the rest fits ``limit``. ``base`` has (keys, base)."""
    sums = proofs.groupBy(*keys).agg(F.sum("cost").alias("__all"))
    ranked = scan(proofs, keys, ["p", "ord"], sizes, __before=running_sum(F.col("cost"), inclusive=False))
    left = ranked.join(sums, keys).join(base, keys, "left").withColumn("base", F.coalesce("base", F.lit(0)))
    fits = F.col("base") + F.col("__all") - F.col("__before") <= limit
    return left.select(*proofs.columns, "base", fits.alias("kept"))


def refill(trimmed: DataFrame, keys: list[str], limit: int, sizes: Sizes = None) -> DataFrame:
    """Put dropped proofs back, most certain first, where they still fit. Costs are whole
    numbers. Replaces ``kept``.

    Of the proofs of one cost c at most room/c can return, and these are the first of them:
    one that does not fit is never followed by an equally long one that does. So per key at
    most room * (1 + 1/2 + ... + 1/room) rows take part, however many were dropped.
    """
    room = trimmed.groupBy(*keys).agg(
        F.first("base").alias("__base"), F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("__kept"))
    dropped = trimmed.filter("not kept").join(room, keys).withColumn(
        "__room", (F.lit(limit) - F.col("__base") - F.col("__kept")).cast("bigint"))
    possible = dropped.filter("__room >= 0 and cost <= __room").withColumn("__np", -F.col("p"))
    ranked = scan(possible, [*keys, "cost"], ["__np", "ord"], sizes, __k=row_number())
    few = ranked.filter("cost = 0 or __k <= __room div cost")

    def step(left: Column, x: Column) -> Column:
        fits = x["cost"] <= left
        return F.struct(F.when(fits, left - x["cost"]).otherwise(left).alias("s"), fits.alias("o"))

    back = fold(few.select(*keys, "ord", "__np", F.col("cost").cast("bigint").alias("cost"), "__room"), keys,
                ["__np", "ord"], ["cost", "__room"], "__back", F.col("__room"), step).filter("__back")
    return trimmed.join(back.select(*keys, "ord", "__back"), [*keys, "ord"], "left").withColumn(
        "kept", F.col("kept") | F.coalesce("__back", F.lit(False))).select(*trimmed.columns)


# --- Set operations on selections ------------------------------------------------------

def toggle(selected: DataFrame, ids: DataFrame, keys: list[str], item: str = "id") -> DataFrame:
    """All of ``ids`` chosen -> none of them, else all of them. Others stay."""
    both = [*keys, item]
    wanted = ids.select(*both).distinct()
    have = selected.select(*both).distinct()
    verdict = wanted.join(have.withColumn("__on", F.lit(True)), both, "left").groupBy(*keys).agg(
        F.bool_and(F.coalesce("__on", F.lit(False))).alias("__all_on"))
    marked = have.withColumn("__have", F.lit(True)).join(wanted.withColumn("__want", F.lit(True)), both, "full").join(
        verdict, keys, "left")
    stays = F.when(F.col("__want"), ~F.col("__all_on")).otherwise(True)
    return marked.filter(stays).select(*both)


def toggle_proof(selection: DataFrame, target: DataFrame, with_proof: DataFrame,
                 keys: list[str] = COURSE) -> DataFrame:
    """Toggle one proof per selection (``target``: keys, id). Switching on brings the
    statement. Switching off under "all proofs" names all the others explicitly.
    ``with_proof`` lists (keys, id) that offer a proof."""
    t = target.select(*keys, F.col("id").alias("__t")).distinct()
    proofs = selection.filter("kind = 'proof'").select(*keys, F.col("item").alias("__t")).distinct()
    every = selection.filter("kind = 'proofs'").select(*keys).distinct().withColumn("__all", F.lit(True))
    state = t.join(every, keys, "left").join(proofs.withColumn("__one", F.lit(True)), [*keys, "__t"], "left").select(
        *keys, "__t", F.coalesce("__all", F.lit(False)).alias("__all"),
        F.coalesce("__all", "__one", F.lit(False)).alias("__on"))
    kept = selection.join(state, keys, "left").filter(
        F.col("__t").isNull() | ~F.col("__on")
        | ~(((F.col("kind") == "proof") & (F.col("item") == F.col("__t"))) | ((F.col("kind") == "proofs") & F.col("__all")))
    ).select(*selection.columns)
    added = state.filter("not __on").select(
        *keys, F.explode(F.array(F.lit("proof"), F.lit("statement"))).alias("kind"), F.col("__t").alias("item"))
    others = (
        selection.filter("kind = 'statement'").select(*keys, F.col("item").alias("id"))
        .join(with_proof.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")
        .join(state.filter("__on and __all"), keys).filter("id <> __t")
        .select(*keys, F.lit("proof").alias("kind"), F.col("id").alias("item"))
    )
    return kept.unionByName(added).unionByName(others).distinct()


def apply_off(selection: DataFrame, off: DataFrame, keys: list[str] = COURSE) -> DataFrame:
    """The selection without its unticked lines; an unticked statement takes its proof along."""
    line = [*keys, "kind", "item"]
    proofs = off.filter("kind = 'statement'").withColumn("kind", F.lit("proof"))
    return selection.join(off.select(*line).unionByName(proofs.select(*line)).distinct(), line, "left_anti")


def merge_edit(old: DataFrame, new: DataFrame, off: DataFrame, covered: DataFrame,
               keys: list[str] = COURSE) -> tuple[DataFrame, DataFrame]:
    """(selection, off) after an edit. The editor does not show unticked lines, so a line in
    ``off`` that was chosen stays chosen and unticked, unless the edit chose it again:
    then it is ticked. ``covered`` lists (keys, id) the new selection holds."""
    line = [*keys, "kind", "item"]
    again = new.select(*line).unionByName(
        covered.select(*keys, F.lit("statement").alias("kind"), F.col("id").alias("item"))).distinct()
    still = off.select(*line).distinct().join(again, line, "left_anti").join(old.select(*line).distinct(), line, "left_semi")
    proofs = still.filter("kind = 'statement'").withColumn("kind", F.lit("proof")).join(
        old.select(*line).distinct(), line, "left_semi")
    merged = new.select(*line).unionByName(still).unionByName(proofs).distinct()
    return merged, still


def merge_state(state: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of ``updates`` overwrite, NULLs leave what is stored."""
    values = [c for c in state.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    return state.join(new, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in values])


def selection_changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changed): whether two selections differ as sets of lines."""
    line = [*keys, "kind", "item"]
    one = before.select(*line).distinct().withColumn("__b", F.lit(True))
    two = after.select(*line).distinct().withColumn("__a", F.lit(True))
    return one.join(two, line, "full").groupBy(*keys).agg(
        F.bool_or(F.col("__b").isNull() | F.col("__a").isNull()).alias("changed"))


def selection_items(selection: DataFrame, entries: DataFrame, nodes: DataFrame, off: DataFrame,
                    keys: list[str] = COURSE) -> DataFrame:
    """One line per chosen section, single statement, proof inside a section and earlier task:
    (keys, ord, kind, item, text, off). ``ord`` counts from 1: own material before that of other
    scripts, earlier tasks last; sections by key, statements and proofs in script order, what
    is not known last."""
    def place(section: Column, page: Column = F.lit(0), pos: Column = F.lit(0)) -> Column:
        return F.struct(section.alias("section"), page.cast("int").alias("page"), pos.cast("bigint").alias("pos")).alias("__place")

    title = nodes.select(*keys, F.col("key").alias("item"), F.col("title").alias("__title"))
    root = nodes.select(*keys, F.col("key").alias("__root"), F.col("title").alias("__root_title"))
    label = K.section_label(F.col("item"), F.col("__title"), F.col("__root_title"))
    inner = F.regexp_replace("item", r"^[^.]*\.?", "")
    extra = F.when(inner == "", "the whole script").otherwise(
        F.rtrim(F.concat_ws(" ", F.lit("Section"), inner, F.col("__title"))))
    section_text = F.when(K.is_slides(F.col("item")), label).when(K.is_extra(F.col("item")), extra).otherwise(
        F.concat(F.lit("Section "), label))
    sections = (
        selection.filter("kind = 'section'").withColumn("__root", K.root(F.col("item")))
        .join(title, [*keys, "item"], "left").join(root, [*keys, "__root"], "left")
        .select(*keys, F.lit(0).alias("part"), "kind", "item", section_text.alias("text"),
                K.is_extra(F.col("item")).alias("extra"), place(K.sort_key(F.col("item"))))
    )
    known = statements(entries, True).select(
        *keys, F.col("id").alias("item"), "section", place(*script_order()),
        X.statement_label(F.col("id"), F.col("name"), F.col("text"), F.col("type")).alias("__label"))
    known = known.groupBy(*keys, "item").agg(F.first("__label").alias("__label"), F.first("section").alias("section"), F.min("__place").alias("__place"))
    proofs = selection.filter("kind = 'proof'").select(*keys, "item").distinct()
    singles = (
        selection.filter("kind = 'statement'").join(known, [*keys, "item"], "left")
        .join(proofs.withColumn("__p", F.lit("  + proof")), [*keys, "item"], "left")
        .select(*keys, F.lit(1).alias("part"), "kind", "item",
                F.concat(F.coalesce("__label", "item"), F.coalesce("__p", F.lit(""))).alias("text"),
                K.is_extra(F.col("section")).alias("extra"), "__place")
    )
    every = selection.filter("kind = 'proofs'").select(
        *keys, F.lit(2).alias("part"), "kind", "item", F.lit("+ all their proofs").alias("text"), F.lit(False).alias("extra"),
        place(F.array(F.lit(0))))
    picked = selection.filter("kind = 'section'").select(*keys, "item")
    inside = covered_sections(entries, picked, keys)
    within = (
        proofs.join(known, [*keys, "item"]).join(inside, [*keys, "section"], "left_semi")
        .join(selection.filter("kind = 'statement'").select(*keys, "item").distinct(), [*keys, "item"], "left_anti")
        .join(selection.filter("kind = 'proofs'").select(*keys).distinct(), keys, "left_anti")
        .select(*keys, F.lit(2).alias("part"), F.lit("proof").alias("kind"), "item",
                F.concat(F.lit("+ proof of "), F.col("item")).alias("text"), K.is_extra(F.col("section")).alias("extra"), "__place")
    )
    earlier = selection.filter("kind = 'earlier'").select(
        *keys, F.lit(3).alias("part"), "kind", "item", F.concat(F.lit("Earlier: "), F.col("item")).alias("text"),
        F.lit(False).alias("extra"), place(F.array(F.lit(0))))
    lines = reduce(DataFrame.unionByName, [sections, singles, every, within, earlier])
    ticked = off.select(*keys, "kind", "item").distinct().withColumn("__off", F.lit(True))
    block = F.coalesce(F.col("extra").cast("int"), F.lit(0)) + F.when(F.col("part") == 3, 2).otherwise(0)
    listed = lines.join(ticked, [*keys, "kind", "item"], "left").select(
        *keys, block.alias("block"), "part", "kind", "item", "text", F.coalesce("__off", F.lit(False)).alias("off"),
        F.coalesce("__place", F.struct(F.array(F.lit(2**31 - 1)).alias("section"), F.lit(0).alias("page"), F.lit(0).cast("bigint").alias("pos"))).alias("__place"))
    return scan(listed, keys, ["block", "part", "__place", "item"], ord=row_number()).drop("__place")
