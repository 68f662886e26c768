"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import staged
from .components import connected_components

COSINE = 0.9
#: Expected share of pairs right at the threshold that some table brings together; closer pairs fare better.
RECALL = 0.97
#: Width of a quantisation step, for unit vectors.
STEP = 2.0
#: Unrelated vectors a bucket holds on average.
BUCKET_ROWS = 128
#: Rows compared at a time; larger buckets are cut into parts, and every two parts meet in a block.
PART_ROWS = 1024


def _same_step(distance: float) -> float:
    """Chance that two vectors at a distance fall into the same step of one projection (Datar et al., 2004)."""
    t = STEP / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections per table, tables): buckets of unrelated vectors stay small, near pairs are found with RECALL."""
    near, far = _same_step(math.sqrt(2 - 2 * cosine)), _same_step(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS + 1) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sign(kind: str, k: int, tables: int, seed: int = 7):
    """Distinct vectors to (rep, n, dim, v as bytes, keys): the bucket of each table as a 64-bit key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            sizes = batch["v"].map(len)
            for dim, part in batch.groupby(sizes):
                if dim not in drawn:
                    rng = np.random.default_rng([seed, dim])
                    drawn[dim] = (rng.normal(size=(dim, k * tables)), rng.uniform(0, STEP, k * tables),
                                  rng.integers(1, 2**63, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                project, shift, mix = drawn[dim]
                raw = np.array(part["v"].tolist(), dtype=kind)
                steps = np.floor((_unit(raw) @ project + shift) / STEP).astype(np.int64).astype(np.uint64)
                keys = (steps.reshape(-1, tables, k) * mix).sum(axis=2, dtype=np.uint64)
                keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pd.DataFrame({"rep": part["rep"], "n": part["n"], "dim": dim, "v": [r.tobytes() for r in raw],
                                    "keys": list(keys.view(np.int64))})

    return run


def _compare(kind: str, cosine: float):
    """Sorted rows of blocks to counted links and to a forest of them per block.

    A link is counted only in the first table that brings its two vectors together, which both
    carry in their keys: so no list of pairs has to be made distinct.
    """
    names = ["a", "b", "links"]

    def block(rows: pd.DataFrame) -> pd.DataFrame | None:
        x = _unit(np.stack([np.frombuffer(v, dtype=kind) for v in rows["v"]]))
        keys, part = np.stack(rows["keys"].to_list()), rows["part"].to_numpy()
        rep, n, table = rows["rep"].to_numpy(), rows["n"].to_numpy(), int(rows["tab"].iat[0])
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if rows["low"].iat[0] != rows["high"].iat[0]:
            near &= part[:, None] != part[None, :]
        links = np.zeros(len(rep), dtype=np.int64)
        one, two = np.nonzero(near)
        for s in range(0, len(one), 100_000):
            i, j = one[s:s + 100_000], two[s:s + 100_000]
            first = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
            links += np.bincount(i[first], n[j[first]], len(rep)).astype(np.int64)
        out = [(rep[links > 0], None, links[links > 0])]
        left = near.any(axis=1)
        while left.any():
            root = int(np.flatnonzero(left)[0])
            reached = np.zeros(len(rep), dtype=bool)
            reached[root], edge = True, np.array([root])
            while len(edge):
                more = near[edge].any(axis=0) & ~reached
                reached |= more
                edge = np.flatnonzero(more)
            left &= ~reached
            reached[root] = False
            out.append((rep[reached], rep[root], 0))
        frames = [pd.DataFrame({"a": a, "b": pd.array([b] * len(a), dtype="Int64"), "links": c}) for a, b, c in out if len(a)]
        return pd.concat(frames) if frames else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        by = ["tab", "dim", "bucket", "low", "high"]
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            ids = rows[by].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            found = [f for s, e in zip(bounds, bounds[1:]) if e - s > 1 and (f := block(rows.iloc[s:e])) is not None]
            kept = rows.iloc[bounds[-1]:] if len(rows) else None
            if found:
                yield pd.concat(found)[names]
        if kept is not None and len(kept) > 1 and (last := block(kept)) is not None:
            yield last[names]

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component) per row: the other rows linked directly, and the smallest id reachable.

    Linked are pairs of cosine ``cosine`` or more in double precision that share a bucket in one
    of the tables, and equal vectors always. A vector that is null, empty or zero, or holds a
    null or non-finite component, links with nothing, nor does one without an id or of another
    dimension; the component is its own id. Repeated rows are rows like others. Further columns
    are not read.

    Equal vectors are compared once, with their number. Buckets are counted first: those with
    one vector are left out before vectors travel, and a bucket too large for a task is dealt
    to blocks of two parts each, so all its pairs are compared, in many tasks. Counts of links
    and a forest leave a block, never all pairs of it.
    """
    kind = "f8" if vectors.schema[column].dataType == ArrayType(DoubleType()) else "f4"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(column).alias("v"))
    usable = F.expr("""id is not null and v is not null and size(v) > 0
        and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)""")
    hashed = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    hashed = hashed.select("id", "ok", "v", F.when(F.col("ok"), F.xxhash64("v")).alias("h1"),
                           F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    ids = staged(hashed.select("id", "h1", "h2"), "ids")
    distinct = staged(hashed.filter("ok").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v")), "distinct")
    k, tables = shape(distinct.count(), cosine)
    signed = staged(distinct.select("rep", "n", "v").mapInPandas(
        _sign(kind, k, tables), "rep bigint, n bigint, dim int, v binary, keys array<bigint>"), "signed")

    spots = signed.select("rep", "dim", F.posexplode("keys").alias("tab", "bucket"))
    sizes = staged(spots.groupBy("tab", "dim", "bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                   .withColumn("parts", F.expr(f"cast(ceil(rows / {PART_ROWS}) as int)")), "buckets")
    members = spots.join(sizes, ["tab", "dim", "bucket"]).withColumn("part", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
    blocks = members.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "rep", "tab", "dim", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    by = ["tab", "dim", "bucket", "low", "high"]
    full = blocks.join(signed.select("rep", "n", "v", "keys"), "rep")
    compared = staged(
        full.repartition(*by).sortWithinPartitions(*by).mapInPandas(_compare(kind, cosine), "a bigint, b bigint, links bigint"), "compared")

    components = connected_components(compared.filter("b is not null").select("a", "b"))
    links = compared.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    found = staged(distinct.select("h1", "h2", "rep", "n").join(links, "rep", "left")
                   .join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
                   .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("component", "rep").alias("component")), "found")
    return ids.join(found, ["h1", "h2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
