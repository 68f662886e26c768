"""Cutting the contexts of a sheet's tasks to a common size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scan import key_sizes, running_sum, scan


def shrink_to_fit(items: DataFrame, keys: list[str], room: int) -> DataFrame:
    """Items left when, while a sheet is over ``room``, the largest context of its largest task
    gives up its last item. ``items``: (keys, task, ctx, pos, size); ties go to the first.

    What a context gives up next, and how large it is then, does not depend on other
    contexts; the same holds for tasks. So all removals of a task are one order by the
    size of the context before each, all removals of a sheet one order by the size of the
    task before each, and the cut is where the running sum has taken enough.
    """
    sizes = key_sizes(items, keys)  # finer keys are not larger
    in_ctx = scan(items, [*keys, "task", "ctx"], ["pos"], sizes, __ctx=running_sum(F.col("size")))
    in_ctx = in_ctx.withColumn("__c", -F.col("__ctx")).withColumn("__p", -F.col("pos"))
    per_task = items.groupBy(*keys, "task").agg(F.sum("size").alias("__task_total"))
    in_task = scan(in_ctx, [*keys, "task"], ["__c", "ctx", "__p"], sizes, __gone=running_sum(F.col("size"), inclusive=False))
    in_task = in_task.join(per_task, [*keys, "task"]).withColumn("__t", F.col("__gone") - F.col("__task_total"))
    total = items.groupBy(*keys).agg(F.sum("size").alias("__total"))
    in_sheet = scan(in_task, keys, ["__t", "task", "__c", "ctx", "__p"], sizes, __all_gone=running_sum(F.col("size"), inclusive=False))
    return in_sheet.join(total, keys).filter(F.col("__total") - F.col("__all_gone") <= room).select(*items.columns)
