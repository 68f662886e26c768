"""Folds along an order, where a row's fate depends on what became of earlier rows.

Keys whose rows fit one task are folded over a sorted list of what the fold looks at, by expressions. For larger
keys the same fold is a chain of pointers (from a taken row to the next row that would be taken after it), and
the rows on the chain are found by pointer doubling: log2(n) joins, no row limit; or, where there are
no such pointers, runs of a key follow each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from ..scan import group_rows, next_value, row_number, running_sum, scan
from ..session import staged

MAX_NUMBER_GAP = 3
#: Rows folded into one list of outputs.
PIECE = 256

Step = Callable[[Column, Column], Column]


def split_hot(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys that fit one task, rows of the others or None)."""
    limit = group_rows(df)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys)
    if not hot.limit(1).count():
        return df, None
    hot = staged(hot, "hot")  # at most rows / limit keys
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def on_chain(pointers: DataFrame, keys: list[str], start: DataFrame) -> DataFrame:
    """(keys, pos) reached from ``start`` (keys, pos) along ``pointers`` (keys, pos, to)."""
    at = [*keys, "pos"]
    jump = staged(pointers.filter(F.col("to").isNotNull()).select(*at, "to"), "jump")
    reached = staged(start.select(*at), "reached")
    while True:
        step = reached.join(jump, at).select(*keys, F.col("to").alias("pos"))
        new = step.join(reached, at, "left_anti").distinct()
        new = staged(new, "reached-new")
        if not new.limit(1).count():
            return reached
        reached = staged(reached.unionByName(new), "reached")
        landing = jump.select(*keys, F.col("pos").alias("to"), F.col("to").alias("__far"))
        jump = staged(jump.join(landing, [*keys, "to"]).select(*at, F.col("__far").alias("to")), "jump")


def _folded(rows: DataFrame, order: list[str], values: list[str], start: Column, step: Step) -> DataFrame:
    """(__key, rows, outputs, state): the rows of every ``__key`` in order, what the fold says to each, and its last state.

    The fold goes over pieces of PIECE rows, and over the pieces: appending to a list copies it,
    so one list of all outputs would cost the square of its length.
    """
    def appended(acc: Column, result: Column) -> Column:
        """The result's state, and its output behind those of ``acc``; the result is computed once."""
        return F.element_at(F.transform(F.array(result), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["o"], r["o"]).alias("o"))), 1)

    output = rows.select(step(start, F.struct(*order, *values))["o"]).schema[0].dataType
    none, nothing = F.array().cast(ArrayType(output)), F.array().cast(ArrayType(ArrayType(output)))

    def piece(acc: Column, xs: Column) -> Column:
        return appended(acc, F.aggregate(xs, F.struct(acc["s"].alias("s"), none.alias("o")), lambda inner, x: appended(inner, step(inner["s"], x))))

    lists = rows.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("rows"), F.first(start).alias("start"))
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(size(rows) - 1) div {PIECE}").cast("int")), lambda i: F.slice("rows", i * PIECE + 1, PIECE))
    folded = lists.select("__key", "rows", F.aggregate(pieces, F.struct(F.col("start").alias("s"), nothing.alias("o")), piece).alias("r"))
    return folded.select("__key", "rows", F.flatten("r.o").alias("outputs"), F.col("r.s").alias("state"))


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str, start: Column, step: Step, whole: bool = False) -> DataFrame:
    """Add ``name``: the output of ``step(state, row)``, a struct (s, o) of the next state and the output, for the rows
    of each key in ``order``, from ``start`` (an expression that is the same in all rows of a key).

    Only keys, ``order`` and ``values`` are gathered, a list per key, and folded by expressions;
    the outputs are joined back. Ties are broken by ``values``, so tied rows that differ in
    neither may take each other's output. A null key is a key. ``whole`` says that no key has more rows than a
    task holds; else longer keys are cut into runs, folded one after the other from the state the run before ended with.
    """
    at = F.to_json(F.struct(*[F.col(c).cast("string") for c in (*keys, *order)]))
    named = df.withColumn("__key", F.to_json(F.struct(*[F.col(k).cast("string") for k in keys]))).withColumn("__at", at)
    rest = [v for v in values if v not in order]
    narrow = named.select("__key", "__at", *order, *rest)
    small, hot = (narrow, None) if whole else split_hot(narrow, ["__key"])
    parts = [_folded(small, order, [*rest, "__at"], start, step).drop("state")]
    if hot is not None:
        ranked = staged(scan(hot, ["__key"], order, __i=row_number()), "ranked")
        limit, state = group_rows(df), None
        for run in range(-(-(ranked.agg(F.max("__i")).first()[0] or 0) // limit)):
            now = ranked.filter(F.expr(f"(__i - 1) div {limit} = {run}"))
            if state is not None:
                now = now.join(state, "__key")
            done = staged(_folded(now, order, [*rest, "__at"], start if state is None else F.col("state"), step), "run")
            parts.append(done.drop("state"))
            state = done.select("__key", "state")
    zipped = reduce(DataFrame.unionByName, parts).select(F.explode(F.arrays_zip("rows", "outputs")).alias("x"))
    outs = zipped.groupBy(F.col("x.rows.__at").alias("__at")).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(f"x.rows.{c}").alias(c) for c in rest], F.col("x.outputs").alias("o")))).alias("outs"))
    twin = F.row_number().over(Window.partitionBy("__at").orderBy(*rest))
    return named.join(outs, "__at").withColumn(name, F.element_at("outs", twin)["o"]).drop("__key", "__at", "outs")


def pack_batches(items: DataFrame, keys: list[str], room: int, size: str = "size",
                 order: str = "pos") -> DataFrame:
    """Add ``batch`` (0-based): items in order, a new batch where the size would exceed
    ``room``; an oversized item is a batch of its own. Sizes are not negative; a null one is 0."""
    sized = items.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    small, hot = split_hot(sized, keys)

    def step(state: Column, x: Column) -> Column:
        opens = (state["batch"] < 0) | (state["used"] + x["__size"] > room)
        batch = F.when(opens, state["batch"] + 1).otherwise(state["batch"])
        used = F.when(opens, x["__size"]).otherwise(state["used"] + x["__size"])
        return F.struct(F.struct(batch.alias("batch"), used.alias("used")).alias("s"), batch.alias("o"))

    start = F.struct(F.lit(-1).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("used"))
    packed = fold(small, keys, [order], ["__size"], "batch", start, step, whole=True).drop("__size")
    if hot is None:
        return packed
    # pos -> first item beyond the room of a batch that starts at pos
    summed = staged(scan(hot, keys, [order], __i=row_number(), __upto=running_sum(F.col("__size"))), "sums")
    marks = summed.select(*keys, F.col("__upto").alias("__v"), F.lit(0).alias("__side"), F.col("__i"))
    probes = summed.select(*keys, (F.col("__upto") - F.col("__size") + room).alias("__v"),
                           F.lit(1).alias("__side"), F.col("__i"))
    found = scan(marks.unionByName(probes), keys, ["__v", "__side", "__i"],
                 __to=next_value(F.when(F.col("__side") == 0, F.col("__i"))))
    pointers = found.filter("__side = 1").select(
        *keys, F.col("__i").alias("pos"),
        F.when(F.col("__to").isNotNull(), F.greatest(F.col("__to"), F.col("__i") + 1)).alias("to"))
    starts = on_chain(pointers, keys, summed.filter("__i = 1").select(*keys, F.lit(1).cast("bigint").alias("pos")))
    flagged = summed.join(starts.select(*keys, F.col("pos").alias("__i"), F.lit(1).alias("__start")),
                          [*keys, "__i"], "left")
    numbered = scan(flagged, keys, [order], __b=running_sum(F.coalesce("__start", F.lit(0)).cast("bigint")))
    return packed.unionByName(numbered.select(*items.columns, (F.col("__b") - 1).alias("batch")))


def monotone(cands: DataFrame, keys: list[str], value: str = "last", order: str = "pos",
             exempt: str | None = None, gap: int = MAX_NUMBER_GAP) -> DataFrame:
    """Keep a candidate if its value is 1..gap above that of the last kept one (0 before the
    first). Candidates with ``exempt`` set are always kept. A null value is 0, a null exemption none."""
    cands = cands.withColumns({"__v": F.coalesce(F.col(value), F.lit(0)).cast("bigint"),
                               "__exempt": F.coalesce(F.col(exempt), F.lit(False)) if exempt else F.lit(False)})
    small, hot = split_hot(cands, keys)

    def step(previous: Column, x: Column) -> Column:
        take = x["__exempt"] | ((previous < x["__v"]) & (x["__v"] <= previous + gap))
        return F.struct(F.when(take, x["__v"]).otherwise(previous).alias("s"), take.alias("o"))

    kept = fold(small, keys, [order], ["__v", "__exempt"], "__keep", F.lit(0).cast("bigint"), step, whole=True)
    if hot is not None:
        kept = kept.unionByName(_monotone_hot(hot, keys, "__v", order, "__exempt", gap))
    return kept.filter("__keep").drop("__keep", "__v", "__exempt")


def _monotone_hot(hot, keys, value, order, exempt, gap):
    ranked = staged(scan(hot, keys, [order], __i=row_number()), "ranked")
    head = ranked.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("__i"), F.lit(0).cast("bigint").alias("__v"))
    rows = ranked.select(*keys, "__i", F.col(value).alias("__v")).unionByName(head)
    probes = rows.select(*keys, "__i", F.explode(F.array(*[F.col("__v") + d for d in range(1, gap + 1)])).alias("__v"),
                         F.lit(1).alias("__side"), F.col("__i").alias("__from"))
    marks = ranked.select(*keys, "__i", F.col(value).alias("__v"), F.lit(0).alias("__side"), F.col("__i").alias("__from"))
    # One probe per wanted value; its own row comes first at the same position.
    stepped = scan(marks.unionByName(probes), [*keys, "__v"], ["__i", "__side"],
                   __to=next_value(F.when(F.col("__side") == 0, F.col("__i"))))
    by_step = stepped.filter("__side = 1").select(*keys, F.col("__from").alias("pos"), F.col("__to").alias("to"))
    free = scan(ranked.select(*keys, "__i", exempt).unionByName(head.select(*keys, "__i", F.lit(False).alias(exempt))),
                keys, ["__i"], __to=next_value(F.when(F.col(exempt), F.col("__i"))))
    by_free = free.select(*keys, F.col("__i").alias("pos"), F.col("__to").alias("to"))
    pointers = by_step.unionByName(by_free).groupBy(*keys, "pos").agg(F.min("to").alias("to"))
    taken = on_chain(pointers, keys, head.select(*keys, F.col("__i").alias("pos")))
    return ranked.join(taken.select(*keys, F.col("pos").alias("__i"), F.lit(True).alias("__keep")),
                       [*keys, "__i"]).select(*hot.columns, "__keep")
