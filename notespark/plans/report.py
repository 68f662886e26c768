"""Quality reports over whole corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import keys as K, predicates as P
from ..scan import upper_median

# --- Fixed values ----------------------------------------------------------------------
LEAKED_PROOF = r"(?Umd)^(?:Beweis|Proof)(?:\s+(?:von|of)\s+\w+\s+[\d.]+)?\s*[.:]"
# ---------------------------------------------------------------------------------------


def health_report(entries: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: entries, statements, sections, used sections, share placed (whole
    percent), proofs, biggest section and statements that hold a proof."""
    statement = P.is_statement(F.col("type"))
    # One row per section first, then one per document.
    parts = entries.groupBy(*keys, "section").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(statement).alias("s"),
        F.count_if(F.coalesce("proof", F.lit("")) != "").alias("p"),
        F.count_if(statement & F.col("text").rlike(LEAKED_PROOF)).alias("l"))
    placed = F.coalesce("section", F.lit("")) != ""
    per_doc = parts.groupBy(*keys).agg(
        F.sum("n").alias("entries"), F.sum("s").alias("statements"),
        F.count_if(placed & (F.col("s") > 0)).alias("used"),
        F.sum(F.when(placed, F.col("n")).otherwise(0)).alias("__placed"), F.sum("p").alias("proofs"),
        F.coalesce(F.max(F.when(placed, F.col("s"))), F.lit(0)).alias("biggest"), F.sum("l").alias("leaks"))
    sections = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("sections"))
    return per_doc.join(sections, keys, "left").select(
        *keys, "entries", "statements", F.coalesce("sections", F.lit(0)).alias("sections"), "used",
        F.expr("100 * __placed div greatest(1, entries)").alias("placed_pct"), "proofs", "biggest", "leaks")


def type_histogram(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.filter(P.is_statement(F.col("type"))).groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def pick_report(picks: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: picks per task, percent from the task's own chapter, tasks without picks,
    upper median and maximum of the seconds.

    ``tasks``: (keys, task_ref, section, seconds); ``picks``: (task_ref, section).
    """
    own = tasks.select(*keys, "task_ref", K.root(F.col("section")).alias("chapter"), "seconds")
    hit = picks.select("task_ref", K.root(F.col("section")).alias("__chapter"))
    each = own.join(hit, "task_ref", "left").groupBy(*keys, "task_ref", "seconds").agg(
        F.count("__chapter").alias("n"), F.count_if(F.col("__chapter") == F.col("chapter")).alias("mine"))
    share = F.when(F.col("n") > 0, F.col("mine") / F.col("n")).otherwise(0.0)
    summary = each.groupBy(*keys).agg(
        F.avg("n").alias("avg_picks"), (100 * F.avg(share)).alias("own_pct"),
        F.count_if(F.col("n") == 0).alias("empty"), F.max("seconds").alias("max_seconds"))
    return summary.join(upper_median(each, keys, "seconds", "median_seconds"), keys)
