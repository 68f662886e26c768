"""Ordered scans: running sums and neighbour values per key, safe for hot keys.

A plain window puts all rows of a key into one task. ``scan`` first counts the largest key.
If it is small enough, it uses the plain window (one shuffle). Otherwise rows are
range-partitioned by (keys, order) into even runs that may cut a key anywhere; every run is
scanned on its own, and what a run has to know about the runs before and after it is a table
of at most two rows per run, which is joined back. Ties in ``order`` are broken by the other
columns, so that both ways give the same result: rows equal in all columns are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from .session import staged

GROUP_ROWS = 500_000
GROUP_ROWS_SETTING = "spark.notespark.groupRows"


@dataclass(frozen=True)
class Scan:
    kind: str  # "sum" | "min" | "last" | "next"
    value: Column
    inclusive: bool


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    return Scan("sum", value, inclusive)


def running_min(value: Column) -> Scan:
    return Scan("min", value, True)


def row_number() -> Scan:
    return Scan("sum", F.lit(1).cast("bigint"), True)


def last_value(value: Column, inclusive: bool = True) -> Scan:
    """The last non-null value at or before the row (strictly before if not inclusive)."""
    return Scan("last", value, inclusive)


def next_value(value: Column, inclusive: bool = False) -> Scan:
    """The first non-null value after the row (at or after it if inclusive)."""
    return Scan("next", value, inclusive)


def previous(*values: Column) -> Scan:
    """The row before as a struct, NULL for the first row. Fields may be NULL."""
    return Scan("last", F.struct(*values), False)


def following(*values: Column) -> Scan:
    return Scan("next", F.struct(*values), False)


def group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_ROWS_SETTING, str(GROUP_ROWS)))


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all): one pre-aggregated pass over the key columns."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counted.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return int(row["top"] or 0), int(row["total"] or 0)


def _over(s: Scan, keys: list[str], order: list[str]) -> Column:
    first = Window.unboundedPreceding
    if s.kind == "next":
        # Backwards: a frame that ends at the last row is filled anew for every row.
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        return F.last(s.value, ignorenulls=True).over(back.rowsBetween(first, 0 if s.inclusive else -1))
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(first, 0 if s.inclusive else -1)
    if s.kind == "last":
        return F.last(s.value, ignorenulls=True).over(frame)
    if s.kind == "min":
        return F.min(s.value).over(frame)
    return F.coalesce(F.sum(s.value).over(frame), F.lit(0))


def _orderable(t: DataType) -> bool:
    if isinstance(t, (MapType, VariantType)):
        return False
    inner = [f.dataType for f in getattr(t, "fields", [])] + ([t.elementType] if hasattr(t, "elementType") else [])
    return all(map(_orderable, inner))


def scan(df: DataFrame, keys: list[str], order: list[str], sizes: tuple[int, int] | None = None,
         **outputs: Scan) -> DataFrame:
    """Add one column per output. ``order`` names columns sorted ascending.

    ``sizes`` is a result of ``key_sizes``, or an upper bound of it (of the source rows, or of
    coarser keys), for callers that scan the same rows repeatedly.
    """
    order = [*order, *[f.name for f in df.schema.fields if f.name not in (*keys, *order) and _orderable(f.dataType)]]
    limit = group_rows(df)
    top, total = sizes or key_sizes(df, keys)
    if top <= limit:
        return df.select("*", *[_over(s, keys, order).alias(name) for name, s in outputs.items()])
    return _scan_runs(df, keys, order, outputs, total, limit)


def _scan_runs(df, keys, order, outputs, total, limit) -> DataFrame:
    runs = max(2, -(-total // max(1, limit // 2)))
    run = staged(
        df.repartitionByRange(runs, *keys, *order).withColumn("__run", F.spark_partition_id()),
        "runs",
    )
    position = F.struct(*order)
    parts = [F.count(F.lit(1)).alias("__rows")]
    for name, s in outputs.items():
        present = F.when(s.value.isNotNull(), position)
        if s.kind in ("sum", "min"):
            parts.append(getattr(F, s.kind)(s.value).alias(f"__p_{name}"))
        elif s.kind == "last":
            parts.append(F.max_by(s.value, present).alias(f"__p_{name}"))
        else:
            parts.append(F.min_by(s.value, present).alias(f"__p_{name}"))
    per_run = run.groupBy("__run", *keys).agg(*parts)

    # Only a key at the border of a run can go on in another one: at most two keys per run.
    spread = per_run.withColumn("__runs", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy("__run")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    carried = []
    for name, s in outputs.items():
        c = F.col(f"__p_{name}")
        if s.kind in ("sum", "min"):
            carried.append(getattr(F, s.kind)(c).over(before).alias(f"__c_{name}"))
        elif s.kind == "last":
            carried.append(F.last(c, ignorenulls=True).over(before).alias(f"__c_{name}"))
        else:
            carried.append(F.first(c, ignorenulls=True).over(after).alias(f"__c_{name}"))
    carry = spread.filter("__runs > 1").select(
        F.col("__run").alias("__carry_run"), *[F.col(k).alias(f"__k_{k}") for k in keys], *carried
    )

    local = run.select(
        "*", *[_over(s, ["__run", *keys], order).alias(f"__l_{name}") for name, s in outputs.items()]
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
        F.col("__run") == F.col("__carry_run"),
    )
    # Bounded by 2 x runs rows, so the broadcast does not grow with the data.
    joined = local.join(F.broadcast(carry), same, "left")
    result = []
    for name, s in outputs.items():
        mine, theirs = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if s.kind == "sum":
            value = mine + F.coalesce(theirs, F.lit(0))
        elif s.kind == "min":
            value = F.least(mine, theirs)
        else:
            value = F.coalesce(mine, theirs)
        result.append(value.alias(name))
    return joined.select(*df.columns, *result)


def bounded(df: DataFrame, keys: list[str]) -> bool:
    """Whether every key's rows fit one task."""
    return key_sizes(df, keys)[0] <= group_rows(df)


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Per key the element at index ``n div 2`` of the sorted values (not an interpolation).

    Works on counts per distinct value, so a hot key is pre-aggregated first.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = scan(counted, keys, [value], __upto=running_sum(F.col("__n")))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    hit = upto.join(total, keys).filter(F.col("__upto") > F.expr("__total div 2"))
    return hit.groupBy(*keys).agg(F.min(value).alias(name))
