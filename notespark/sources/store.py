"""Stored tables: writing and reading by course, what to read in again, merged sources."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.headers import entry_id

# Versions of what an ingest writes; rows of an older version are read in again.
FORMATS = {"knowledge": 6, "sheet": 7, "slides": 2, "plan": 2}


def write_store(df: DataFrame, root: str, name: str) -> None:
    """One Parquet table per name, partitioned by course: reading a course prunes the rest.
    Only the courses in ``df`` are replaced."""
    # Few files per course, but a course that holds a third of the rows is split at run time.
    df.hint("rebalance", "course").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("course").parquet(os.path.join(root, name))


def read_store(spark: SparkSession, root: str, name: str, course: str | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(root, name))
    return df if course is None else df.filter(F.col("course") == course)


def plan_ingest(sources: DataFrame, stored: DataFrame, keys: list[str], current_format: int,
                by_mtime: bool = True, remove_gone: bool = True) -> DataFrame:
    """(keys, action): ``read`` what is missing, older than its source, or of an older format;
    ``delete`` what lost its source; else ``skip``. Sheets are not read again for a newer
    file (``by_mtime`` off); scripts are kept when the source is gone (``remove_gone`` off).

    ``sources``: (keys, mtime); ``stored``: (keys, mtime, format).
    """
    s = sources.select(*keys, F.col("mtime").alias("__source"))
    t = stored.select(*keys, F.col("mtime").alias("__stored"), F.coalesce("format", F.lit(1)).alias("__format"))
    newer = F.col("__stored") < F.col("__source") if by_mtime else F.lit(False)
    action = (
        F.when(F.col("__source").isNull(), "delete" if remove_gone else "skip")
        .when(F.col("__format").isNull() | newer | (F.col("__format") < current_format), "read")
        .otherwise("skip")
    )
    return s.join(t, keys, "full").select(*keys, action.alias("action"))


def set_changed(sources: DataFrame, stamps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changed): whether the set of (path, mtime) of a course differs from the one its
    rows were made from. A difference is found line by line, no list is built."""
    line = [*keys, "path", "mtime"]
    a = sources.select(*line).distinct().withColumn("__a", F.lit(True))
    b = stamps.select(*line).distinct().withColumn("__b", F.lit(True))
    return a.join(b, line, "full").groupBy(*keys).agg(
        F.bool_or(F.col("__a").isNull() | F.col("__b").isNull()).alias("changed"))


def _prefixed(root: Column, key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat_ws(".", root, key)).otherwise(root)


def merge_sources(entries: DataFrame, nodes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, nodes) of other scripts under a root ``Z<i>`` per source: keys get the prefix,
    ids the source's name; what has no section goes to the root.

    ``sources``: (course, i, doc_id, name, pdf).
    """
    src = sources.withColumn("__root", F.concat(F.lit("Z"), F.col("i").cast("string")))
    roots = src.select("course", F.col("__root").alias("key"), F.lit(1).alias("level"), F.col("name").alias("title"),
                       F.lit(1).alias("page"), "pdf")
    below = nodes.select("doc_id", "key", "level", "title", "page").join(src, "doc_id").select(
        "course", _prefixed(F.col("__root"), F.col("key")).alias("key"), (F.col("level") + 1).alias("level"),
        "title", "page", "pdf")
    plain = entries.withColumn("id", entry_id())
    merged = plain.join(src.withColumnRenamed("name", "source"), "doc_id").select(
        "course", "pos", F.concat_ws(": ", "source", "id").alias("id"), "type", "number", "name", "page", "text", "proof",
        _prefixed(F.col("__root"), F.col("section")).alias("section"), "source", "pdf")
    return merged, roots.unionByName(below)


def load_entries(script: DataFrame, slides: DataFrame, extras: DataFrame) -> DataFrame:
    """Script, slides and other scripts as one table; ``ord`` keeps that order."""
    parts = [d.withColumn("ord", F.lit(i)) for i, d in enumerate((script, slides, extras))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
