"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, staged


def _pull(pairs: DataFrame, center: str, other: str, keep: str) -> DataFrame:
    """Per ``center`` the smallest of itself and its ``other`` ends; every end allowed by ``keep`` is tied to it.

    The minima are staged, so that the join back is between two plain exchanges: adaptive
    execution splits the rows of a hot center among tasks.
    """
    low = staged(pairs.groupBy(F.col(center).alias("c")).agg(F.min(other).alias("m"))
                 .select("c", F.least("c", "m").alias("m")), "low")
    tied = pairs.join(low, F.col(center) == F.col("c")).select(center, other, "m")
    if keep == "larger":
        edges = tied.filter(F.col(other) > F.col(center)).select(F.col(other).alias("a"), F.col("m").alias("b"))
    else:
        ends = F.explode(F.array(F.col(center), F.col(other))).alias("a")
        edges = tied.select(ends, F.col("m").alias("b"))
    out = staged(edges.filter("a != b").distinct(), "edges")
    discard(low)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges(a bigint, b bigint)`` the smallest node it can reach.

    Large-star and small-star steps (Kiveris et al., 2014) take turns until the edges stay the
    same; then they are one star per component. A step is a minimum per node and one join back:
    no neighbourhood is gathered, and nothing but a count and a checksum reaches the driver.
    Loops and repeated edges do no harm; rows with a null end are left out; no edges, no rows.
    """
    current = staged(edges.filter("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _pull(both, "a", "b", "larger")
        downhill = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = _pull(downhill, "a", "b", "all")
        discard(current)
        discard(large)
        current = small
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
