"""Line dedup: lines found in many documents stay in one of them only. Columns and SQL functions throughout."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` does the same on pure ASCII and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """(id, kept_text, n_lines, n_dropped) per row of ``docs``.

    Lines end at \\n. A line's key is the line without blanks at its ends and with A-Z in lower
    case. Keys of at least ``min_chars`` code points that ``min_docs`` ids hold lose all their
    lines except in the largest of those ids. A null or empty text is one empty line; a text that
    loses all its lines is empty. Rows of the same id are one document and each is treated on its
    own; rows without an id are not counted as documents and never keep such a line. Other
    columns are not read.

    Lines are counted by two 64-bit hashes of the key, first per document, then per key, so that
    a line that all documents share arrives pre-aggregated. Only line positions travel back.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("id", "t", F.xxhash64("t").alias("sig"))
    exploded = rows.select("id", "sig", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    keyed = exploded.filter(F.char_length("line") >= min_chars).select("id", "sig", "pos", line_key(F.col("line")).alias("k"))
    lines = staged(keyed.filter(F.char_length("k") >= min_chars)
                   .select("id", "sig", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")), "lines")
    frequent = staged(lines.groupBy("h1", "h2")
                      .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
                      .filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "frequent")
    drops = (lines.join(frequent, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("id").alias("d_id"), F.col("sig").alias("d_sig")).agg(F.collect_set("pos").alias("drop")))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("sig") == F.col("d_sig")), "left")
    n = F.size(F.split("t", "\n"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(parts) - 1), drop), i -> parts[i]), '\n')")
    return (joined.withColumn("parts", F.when(F.col("drop").isNotNull(), F.split("t", "\n")))
            .select("id", F.when(F.col("drop").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
                    n.cast("bigint").alias("n_lines"),
                    F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped")))
