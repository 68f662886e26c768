"""Exact duplicates by progressive refinement. Columns and SQL functions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .lines import BLANKS

#: Bits of a mark table: 65,536 words of 64, whatever the data. Broadcast for that reason.
MARK_BITS = 22
PREFIX_CHARS = 64


def without_blanks(text: Column) -> Column:
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _place(keys: list[str]) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << MARK_BITS) - 1))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(word, bits): marks the hashed places of keys that occur more than once."""
    again = rows.groupBy(*keys).count().filter("count > 1").select(_place(keys).alias("p"))
    return again.groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))


def _marked(rows: DataFrame, keys: list[str], marks: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag: true for every row whose key is repeated, and for few others."""
    place = _place(keys)
    marks = F.broadcast(marks.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    found = rows.withColumn("__p", place).join(marks, F.expr("__p div 64 = __word"), "left")
    return found.withColumn(name, F.expr("coalesce(shiftright(__bits, cast(__p % 64 as int)) & 1, 0) = 1")).drop(
        "__p", "__word", "__bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept) per row of ``docs``, with ``carry`` expressions over (id, text, norm).

    Texts are equal when equal without the characters \\x20 and \\x09-\\x0D; null counts as
    empty. Of equal texts the row with the most code points, then the smallest id, stays; a null
    id is last among ties. A repeated row (same id, equal text, same length) counts in
    ``group_size`` and shares the decision of its twin. Other columns are not read.

    Refinement: texts of a length of their own are out; of the rest, those with a prefix hash
    of their own; the full hash is taken of what is left. Repeated keys are marked in a table of
    fixed size, so no text is shuffled: a mark hit by chance only costs one more full hash.
    Groups are aggregates joined back to narrow rows; the side of the groups is staged, so
    adaptive execution can split the rows of a huge group.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = source.select("id", "text", without_blanks(F.col("text")).alias("norm")).select(
        "*", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))
    keys = staged(read.select("len", "prefix"), "keys")
    by_length = staged(_repeated(keys, ["len"]), "lengths")
    longer = _marked(keys, ["len"], by_length, "again").filter("again").drop("again")
    by_prefix = staged(_repeated(longer, ["len", "prefix"]), "prefixes")
    carried = [c.alias(name) for name, c in (carry or {}).items()]
    rows = staged(_marked(read, ["len", "prefix"], by_prefix, "again").select(
        "id", F.char_length("text").alias("chars"), "len", "prefix",
        F.when(F.col("again"), F.sha2("norm", 256)).alias("full"), *carried), "rows")
    best = F.max(F.struct("chars", (-F.col("id")).alias("minus")))
    groups = staged(rows.filter("full is not null").groupBy("len", "prefix", "full")
                    .agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
                    .select("len", "prefix", "full", "n", (-F.col("best.minus")).alias("keep")), "groups")
    joined = rows.join(groups, ["len", "prefix", "full"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
                         F.col("id").eqNullSafe(keep).alias("kept"), *(carry or {}))
