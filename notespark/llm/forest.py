"""Approximate nearest neighbours by a forest of hash prefixes (Bawa, Condie and Ganesan, 2005).

A tree is the sorted array of the points' hash strings. A query descends to the points that share
the longest prefix with it, and all trees ascend together, a bit at a time, until they hold enough
candidates: at one depth per query, in each tree, the candidates are one stretch of the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .vectors import finite, kind as kind_of, unit

NEIGHBOURS = 5
TREES, BITS = 16, 48
#: Share of true neighbours that the drawn queries must find; sets how far the trees ascend.
RECALL = 0.95
#: Points and queries drawn by hash to fit on, on average at most so many.
SAMPLE_POINTS, SAMPLE_QUERIES = 16_384, 256
#: Rows of a stretch of an array that a task holds, and queries put to it at a time.
SHARD_ROWS, ASK_ROWS = 20_000, 20_000


def _planes(dim: int) -> np.ndarray:
    """Directions of the hash bits of all trees, orthogonal as far as the dimension goes."""
    rng = np.random.default_rng([11, dim])
    bases = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-TREES * BITS // dim))]
    return np.concatenate(bases, axis=1)[:, :TREES * BITS]


def labels(units: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A hash string per row and tree, as a number below 2**BITS: its first bit is the highest."""
    bits = (units @ planes > 0).reshape(len(units), TREES, BITS)
    packed = np.packbits(bits, axis=2)
    whole = np.concatenate([np.zeros((len(units), TREES, 8 - BITS // 8), np.uint8), packed], axis=2)
    return np.ascontiguousarray(whole).view(">i8")[:, :, 0].astype(np.int64)


def _stretch(label: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest string that share ``depth`` bits with ``label``."""
    rest = BITS - depth
    low = (label >> rest) << rest
    return low, low + ((np.int64(1) << rest) - 1)


def _sizes(own: np.ndarray, arrays: np.ndarray) -> np.ndarray:
    """(query, depth 0..BITS): entries of the sorted ``arrays`` (one per tree) that share so many bits, over all trees."""
    depth = np.arange(BITS + 1, dtype=np.int64)
    out = np.zeros((len(own), BITS + 1), dtype=np.int64)
    for t in range(TREES):
        low, high = _stretch(own[:, t, None], depth[None, :])
        out += np.searchsorted(arrays[t], high, "right") - np.searchsorted(arrays[t], low, "left")
    return out


def _depths(sizes: np.ndarray, scale: float, wanted: float) -> np.ndarray:
    """Per query the deepest level at which the trees hold ``wanted`` points, the root where none does."""
    enough = sizes * scale >= wanted
    return np.where(enough.any(axis=1), BITS - enough[:, ::-1].argmax(axis=1), 0).astype(np.int64)


def _sign(kind: str):
    """Distinct vectors to rows with their hash strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                if dim not in planes:
                    planes[dim] = _planes(dim)
                raw = np.array(part["v"].tolist(), dtype=kind)
                yield part[["h1", "h2", "rep", "asked"]].assign(
                    dim=dim, v=[r.tobytes() for r in raw], labels=list(labels(unit(raw), planes[dim])))

    return run


def _best(scores: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, ties to the smaller ``rep``."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= border)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((rep[places], -scores[places]))[:k]]


def _nearest_to(sample: dict[int, np.ndarray], kind: str, k: int):
    """Per task the ``k`` points nearest to each drawn query, with their hash strings: all rows, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], pd.DataFrame] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim not in sample:
                    continue
                points = unit(np.stack([np.frombuffer(v, dtype=kind) for v in part["v"]]))
                rep = part["rep"].to_numpy()
                for q, scores in enumerate(sample[dim] @ points.T):
                    scores = np.where(scores >= 1 - 1e-12, -2.0, scores)  # the query itself
                    top = _best(scores, rep, k)
                    mine = pd.DataFrame({"q": q, "dim": dim, "score": scores[top], "rep": rep[top], "labels": part["labels"].iloc[top].tolist()})
                    both = pd.concat([held[dim, q], mine], ignore_index=True) if (dim, q) in held else mine
                    held[dim, q] = both.iloc[_best(both["score"].to_numpy(), both["rep"].to_numpy(), k)]
        if held:
            yield pd.concat(held.values())

    return run


def _enough(asked: pd.DataFrame, truth: pd.DataFrame, arrays: dict[int, np.ndarray], counts: dict[int, int], k: int) -> float:
    """How many candidates the trees must hold together for RECALL of the drawn queries' true neighbours."""
    met, sizes = [], []
    for dim, part in asked.groupby("dim"):
        own = np.stack(part["labels"].tolist())
        size = _sizes(own, arrays[dim]) * (counts[dim] / len(arrays[dim][0]))
        for q, near in truth[truth["dim"] == dim].groupby("q"):
            differ = own[q][None, :] ^ np.stack(near["labels"].tolist())
            shared = BITS - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64)
            met.append(shared.max(axis=1))
            sizes.append(np.repeat(size[q][None, :], len(near), axis=0))
    most = float(TREES * max(counts.values()))
    if not met:
        return most
    met, sizes, wanted = np.concatenate(met), np.concatenate(sizes), float(k * TREES)
    while wanted < most and (met >= _depths(sizes, 1.0, wanted)).mean() < RECALL:
        wanted *= 1.15
    return min(wanted, most)


def _descend(arrays: dict[int, np.ndarray], counts: dict[int, int], wanted: float):
    """Queries to their stretch of each tree at the depth where all trees together hold enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own = np.stack(part["labels"].tolist())
                depth = _depths(_sizes(own, arrays[dim]), counts[dim] / len(arrays[dim][0]), wanted)
                low, high = _stretch(own, depth[:, None])
                yield pd.DataFrame({"h1": np.repeat(part["h1"].to_numpy(), TREES), "h2": np.repeat(part["h2"].to_numpy(), TREES), "dim": dim,
                                    "tree": np.tile(np.arange(TREES), len(part)), "low": low.ravel(), "high": high.ravel()})

    return run


def _score(kind: str, k: int):
    """A shard of an array and the queries put to it: per query its best points within its stretch."""
    names = ["q1", "q2", "h1", "h2", "rep", "score"]

    def run(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(points) and len(asks):
            for (dim, tree), mine in asks.groupby(["dim", "tree"]):
                own = points[(points["dim"] == dim) & (points["tree"] == tree)].sort_values("label")
                if not len(own):
                    continue
                array, rep = own["label"].to_numpy(), own["rep"].to_numpy()
                x = unit(np.stack([np.frombuffer(v, dtype=kind) for v in own["v"]]))
                h1, h2 = own["h1"].to_numpy(), own["h2"].to_numpy()
                asking = unit(np.stack([np.frombuffer(v, dtype=kind) for v in mine["v"]]))
                starts = np.searchsorted(array, mine["low"].to_numpy(), "left")
                ends = np.searchsorted(array, mine["high"].to_numpy(), "right")
                for i, (q1, q2) in enumerate(zip(mine["h1"], mine["h2"])):
                    s, e = starts[i], ends[i]
                    if s < e:
                        top = s + _best(x[s:e] @ asking[i], rep[s:e], k)
                        # Summed row by row, so that a pair has the same score in every tree.
                        found.append((np.full(len(top), q1), np.full(len(top), q2), h1[top], h2[top], rep[top], (x[top] * asking[i]).sum(axis=1)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.array([], np.int64)] * 5 + [np.array([], np.float64)]
        return pd.DataFrame(dict(zip(names, columns)))

    return run


def nearest(vectors: DataFrame, asked: Column, id_col: str = "vec_id", column: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """(query, rank, id, score): for every row where ``asked`` its ``k`` nearest rows by cosine that the forest finds.

    Rank 1 is nearest; ties go to the smaller id. A row is no candidate of a query with its own
    id. Fewer than ``k`` rows come back only where there are no more. A vector that is null,
    empty or zero, or holds a null or non-finite entry, takes no part, nor does a row without an
    id; rows of different dimension do not meet. A repeated row is one query and one candidate.
    ``asked`` is read from ``vectors``, further columns are not. No rows or no queries, no rows.

    Equal vectors are one point with its first ids. How many candidates are enough is fitted:
    queries drawn by hash are compared with all points in blocks, and the number is the least
    that finds RECALL of their neighbours, with the arrays' sizes taken from points drawn by
    hash. All points lie in all arrays; arrays are cut into shards in sorted order, and a query
    goes to those that its stretch meets, so neither a dense place nor a long stretch is cut off.
    """
    kind, most = kind_of(vectors, column), k + 1
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(column).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    usable = rows.filter(F.col("id").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0))
    hashed = usable.select("id", "asked", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    ids = staged(hashed.select("id", "asked", "h1", "h2").distinct(), "ids")
    # A limit of ranks, which Spark also applies before the shuffle: a vector's copies do not meet in one task.
    first = ids.select("id", "h1", "h2").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("n") <= most)
    copies = staged(first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")), "copies")
    distinct = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.bool_or("asked").alias("asked"), F.any_value("v").alias("v"))
    points = staged(distinct.mapInPandas(_sign(kind), "h1 bigint, h2 bigint, rep bigint, asked boolean, dim int, v binary, labels array<bigint>"), "points")

    by_dim = {r["dim"]: r for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked")).collect()}
    counts = {d: r["n"] for d, r in by_dim.items() if r["asked"]}
    schema = "q1 bigint, q2 bigint, h1 bigint, h2 bigint, rep bigint, score double"
    if counts:
        found = _search(points.filter(F.col("dim").isin(list(counts))), counts, {d: by_dim[d]["asked"] for d in counts}, kind, k, schema)
    else:
        found = points.sparkSession.createDataFrame([], schema)

    pairs = found.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"))
    named = pairs.join(copies, ["h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    best = named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    answers = staged(best.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near")), "answers")
    own = ids.filter("asked").select(F.col("id").alias("query"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).join(answers, ["q1", "q2"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k)
    return own.select("query", F.posexplode(others).alias("p", "x")).select(
        "query", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def _search(points: DataFrame, counts: dict[int, int], asked: dict[int, int], kind: str, k: int, schema: str) -> DataFrame:
    total = sum(counts.values())
    # Of small dimensions every point is drawn, so that none is without an array.
    step = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // SAMPLE_POINTS))) for d, n in counts.items()])
    drawn = points.filter(F.pmod("h1", step) == 0).select("dim", "labels").toPandas()
    arrays = {}
    for d in counts:
        part = drawn[drawn["dim"] == d]["labels"].tolist()
        arrays[d] = np.sort(np.stack(part).T, axis=1) if part else np.full((TREES, 1), 2**BITS, np.int64)
    every = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // SAMPLE_QUERIES))) for d, n in asked.items()])
    sample = points.filter(F.col("asked") & (F.pmod("h2", every) == 0)).select("dim", "v", "labels").toPandas()
    own = {d: unit(np.stack([np.frombuffer(v, dtype=kind) for v in part["v"]])) for d, part in sample.groupby("dim")}
    near = points.select("dim", "v", "rep", "labels").mapInPandas(
        _nearest_to(own, kind, k), "q bigint, dim int, score double, rep bigint, labels array<bigint>")
    rank = F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "rep"))
    truth = near.withColumn("n", rank).filter(F.col("n") <= k).select("dim", "q", "labels").toPandas()
    wanted = _enough(sample, truth, arrays, counts, k)

    stretches = staged(points.filter("asked").mapInPandas(
        _descend(arrays, counts, wanted), "h1 bigint, h2 bigint, dim int, tree int, low bigint, high bigint"), "stretches")
    entries = points.select("dim", F.posexplode("labels").alias("tree", "label"), F.lit(0).alias("place"), "h1", "h2", "rep", "v")
    no = [F.lit(None).cast(t).alias(c) for c, t in (("rep", "bigint"), ("v", "binary"))]
    ends = [stretches.select("dim", "tree", F.col(c).alias("label"), F.lit(p).alias("place"), "h1", "h2", *no) for c, p in (("low", -1), ("high", 1))]
    shards = max(1, -(-total * TREES // SHARD_ROWS))
    laid = staged(entries.unionByName(ends[0]).unionByName(ends[1])
                  .repartitionByRange(shards, "dim", "tree", "label", "place", "h1", "h2").withColumn("shard", F.spark_partition_id()), "arrays")
    met = laid.filter("place != 0").groupBy("dim", "tree", "h1", "h2").agg(F.min("shard").alias("a"), F.max("shard").alias("b"))
    put = met.join(stretches, ["dim", "tree", "h1", "h2"]).withColumn("shard", F.explode(F.expr("sequence(a, b)")))
    put = staged(put.select("shard", "dim", "tree", "h1", "h2", "low", "high"), "asks")
    # Where many stretches meet a shard, it takes them in turns, each with a copy of the shard.
    turns = staged(put.groupBy("shard").agg(F.expr(f"cast(ceil(count(1) / {ASK_ROWS}) as int)").alias("turns")), "turns")
    asks = put.join(turns, "shard").withColumn("turn", F.expr("cast(pmod(xxhash64(h1, h2), turns) as int)"))
    asks = asks.join(points.filter("asked").select("h1", "h2", "v"), ["h1", "h2"]).drop("turns")
    arrays_of = laid.filter("place = 0").join(turns, "shard").withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))).drop("turns", "place")
    return arrays_of.groupBy("shard", "turn").cogroup(asks.groupBy("shard", "turn")).applyInPandas(_score(kind, k + 1), schema)
