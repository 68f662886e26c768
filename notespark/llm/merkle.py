"""Merkle manifest of a dataset, with a proof for every row (octopus multiproofs per partition)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

#: Children of a node.
FANOUT = 16
#: Rows of a leaf partition: fewer are not worth a task, more do not fit one.
LEAST_ROWS, MOST_ROWS = 2_000, 200_000


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    count = 0
    while n > 1:
        n, count = -(-n // FANOUT), count + 1
    return count


def width(n: int, level: int) -> int:
    """Nodes at a level above ``n`` leaves."""
    for _ in range(level):
        n = -(-n // FANOUT)
    return n


def leaf(*fields: Column) -> Column:
    """Digest of a row: per field ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _climb(known: dict[tuple[int, int], str], low: int, high: int, n: int) -> None:
    """Adds to ``known`` every node above the leaves ``low`` to ``high`` of a tree of ``n``; what lies beside them is known."""
    for level in range(levels(n)):
        size = width(n, level)
        low, high = low // FANOUT, high // FANOUT
        for i in range(low, high + 1):
            if (level + 1, i) not in known:
                known[level + 1, i] = _h("".join(known[level, c] for c in range(i * FANOUT, min(size, (i + 1) * FANOUT))))


def _beside(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) that the leaves ``low`` to ``high`` of a tree of ``n`` lack to reach its root: at most 30 a level."""
    out = []
    for level in range(levels(n)):
        size = width(n, level)
        out += [(level, i) for i in range(low // FANOUT * FANOUT, low)]
        out += [(level, i) for i in range(high + 1, min(size, (high // FANOUT + 1) * FANOUT))]
        low, high = low // FANOUT, high // FANOUT
    return out


def _covered(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """The greatest nodes of a tree of ``n`` that stand on leaves ``low`` to ``high`` alone, together on all of them."""
    out = []
    for level in range(levels(n) + 1):
        if low > high:
            break
        if level == levels(n):
            out.append((level, 0))
            break
        last = high == width(n, level) - 1
        start, end = -(-low // FANOUT), (high if last else (high + 1) // FANOUT * FANOUT - 1) // FANOUT
        if start > end:
            out += [(level, i) for i in range(low, high + 1)]
            break
        out += [(level, i) for i in range(low, start * FANOUT)]
        out += [(level, i) for i in range((end + 1) * FANOUT, high + 1)]
        low, high = start, end
    return out


def _frontier(rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a leaf partition that other partitions may need."""
    digests, out = rows.sort_values("idx")["leaf"].tolist(), []
    for run in runs.itertuples():
        end = run.low + run.n - 1
        known = {(0, run.low + i): d for i, d in enumerate(digests[run.first:run.first + run.n])}
        nodes = _covered(run.low, end, run.total)
        low, high = run.low, end
        for level in range(max(level for level, _ in nodes)):
            # Only whole nodes: a run that another partition holds a part of is left to it.
            size, cut = width(run.total, level), high == width(run.total, level) - 1
            low, high = -(-low // FANOUT), (high if cut else (high + 1) // FANOUT * FANOUT - 1) // FANOUT
            for i in range(low, high + 1):
                known[level + 1, i] = _h("".join(known[level, c] for c in range(i * FANOUT, min(size, (i + 1) * FANOUT))))
        out += [(run.rank, run.total, level, i, known[level, i]) for level, i in nodes]
    return pd.DataFrame(out, columns=["rank", "total", "level", "i", "digest"])


def _lacking(trees: int):
    """Coordinates that a leaf partition must fetch, of its trees and (rank -1) of the tree over their roots."""

    def run(runs: pd.DataFrame) -> pd.DataFrame:
        part = int(runs["part"].iat[0])
        out = [(part, r.rank, *c) for r in runs.itertuples() if r.n < r.total for c in _beside(r.low, r.low + r.n - 1, r.total)]
        out += [(part, -1, *c) for c in _beside(int(runs["rank"].min()), int(runs["rank"].max()), trees)]
        return pd.DataFrame(out, columns=["part", "rank", "level", "i"])

    return run


class _Paths:
    """Siblings on the way up a tree, shared by all leaves below a node."""

    def __init__(self, known: dict[tuple[int, int], str], n: int, above: tuple[str, tuple]):
        self.known, self.n, self.top, self.above = known, n, levels(n), above
        self.memory: dict[tuple[int, int], tuple[str, tuple]] = {}

    def up(self, level: int, i: int) -> tuple[str, tuple]:
        """(all siblings joined, what to put before and after the digest at each level) from a node to the root of roots."""
        if level == self.top:
            return self.above
        if (level, i) in self.memory:
            return self.memory[level, i]
        run = i // FANOUT
        children = range(run * FANOUT, min(width(self.n, level), (run + 1) * FANOUT))
        before = "".join(self.known[level, c] for c in children if c < i)
        after = "".join(self.known[level, c] for c in children if c > i)
        joined, steps = self.up(level + 1, run)
        path = before + after + joined, ((before, after), *steps)
        if level:  # a leaf's own path serves nothing else
            self.memory[level, i] = path
        return path


def _prove(trees: int, listed: bool):
    def run(rows: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        runs, fetched = extra[extra["level"].isna()], extra[extra["level"].notna()]
        beside: dict[int, dict[tuple[int, int], str]] = {}
        for r in fetched.itertuples():
            beside.setdefault(r.rank, {})[int(r.level), int(r.i)] = r.digest
        leaves, top, known = rows["leaf"].tolist(), beside.get(-1, {}), {}
        for r in runs.itertuples():
            first, n, low, total = int(r.first), int(r.n), int(r.low), int(r.total)
            own = known[r.rank] = beside.get(r.rank, {})
            own.update({(0, low + i): d for i, d in enumerate(leaves[first:first + n])})
            _climb(own, low, low + n - 1, total)
            top[0, int(r.rank)] = own[levels(total), 0]
        _climb(top, int(runs["rank"].min()), int(runs["rank"].max()), trees)
        root, over = top[levels(trees), 0], _Paths(top, trees, ("", ()))
        out: list[tuple] = [()] * len(rows)
        changed = rows["changed"].tolist()
        for r in runs.itertuples():
            total, own = int(r.total), known[r.rank]
            paths = _Paths(own, total, over.up(0, int(r.rank)))
            for i in range(int(r.n)):
                at = int(r.first) + i
                joined, steps = paths.up(0, int(r.low) + i)
                digest = changed[at] or leaves[at]
                for before, after in steps:
                    digest = _h(before + digest + after)
                proof = [joined[c:c + 64] for c in range(0, len(joined), 64)] if listed else None
                out[at] = (own[levels(total), 0], root, _h(joined), digest, digest == root, proof)
        names = ["subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
        return pd.concat([rows[["id", "leaf"]], pd.DataFrame(out, columns=names)], axis=1)

    return run


def _tree(nodes: DataFrame, highest: int) -> DataFrame:
    """All nodes that follow from ``nodes(rank, total, level, i, digest)``, level by level: a node has FANOUT children at most."""
    found, at = nodes, nodes.filter("level = 0")
    for level in range(highest):
        join = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), "")
        open_ = at.filter(F.col("total") > FANOUT ** level)
        parents = staged(open_.groupBy("rank", "total", F.expr(f"i div {FANOUT}").alias("p")).agg(F.sha2(join, 256).alias("digest"))
                         .select("rank", "total", F.lit(level + 1).alias("level"), F.col("p").alias("i"), "digest"), "parents")
        found = found.unionByName(parents)
        at = nodes.filter(F.col("level") == level + 1).unionByName(parents)
    return found


def prove(docs: DataFrame, fields: list[str], id_col: str = "doc_id", source: str = "source", changed: Column | None = None,
          proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row; with ``proofs`` also the proof's digests as an array.

    A leaf is the digest of ``fields``. Per ``source`` (null is one), leaves ascend by id (null
    first), then by digest; 16 consecutive nodes become one until one is left, and so do the
    sources' roots in the order of their names (null first, bytewise). ``changed`` is another leaf
    that a row is checked with, where not null: folded with the row's proof it gives
    ``folded_root``, and ``verified`` says whether that is the root. Rows equal in all fields have
    leaves side by side and may take each other's place. No rows, no rows; further columns are not
    read, whatever their names.

    Leaves are dealt in order to partitions of bounded size, so a source of any size is spread.
    A partition publishes the greatest nodes that stand on its leaves alone; what is above these
    is built level by level from so few rows. Then each partition lists the coordinates beside its
    leaves that it lacks (at most 30 a level and tree), fetches them once, derives what its leaves'
    paths share and expands the proofs on the spot.
    """
    other = F.lit(None).cast("string") if changed is None else changed
    # Equal rows are told apart by where they are read, so that many of them do not make one partition.
    read = staged(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), leaf(*map(F.col, fields)).alias("leaf"), other.alias("changed"),
                              F.monotonically_increasing_id().alias("twin")), "digests")
    spark = docs.sparkSession
    rows = read.count()
    parts = max(1, min(-(-rows // LEAST_ROWS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MOST_ROWS))))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("id"), "leaf", "twin"]
    dealt = read.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("at", F.monotonically_increasing_id())
    leaves = staged(placed.select("id", "source", "leaf", "changed", F.expr("cast(shiftright(at, 33) as int)").alias("part"),
                                  F.expr("at & 8589934591").alias("idx")), "leaves")

    whole = Window.partitionBy("source")
    runs = leaves.groupBy("part", "source").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("*", F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("low"),
                       F.sum("n").over(whole).alias("total"), F.min("part").over(whole).alias("part0"),
                       F.min_by("first", "part").over(whole).alias("first0"))
    runs = staged(runs.withColumn("nth", F.dense_rank().over(Window.partitionBy("part0").orderBy("first0")) - 1), "runs")
    # One row per partition, so one task counts the sources that start in the partitions before.
    starts = runs.filter("part = part0").groupBy("part0").agg(F.count(F.lit(1)).alias("s"))
    starts = starts.select("part0", (F.sum("s").over(Window.orderBy("part0")) - F.col("s")).alias("before"))
    runs = staged(runs.join(starts, "part0").select("part", "first", "n", "low", "total", (F.col("before") + F.col("nth")).alias("rank")), "runs")
    trees, largest = runs.agg(F.max("rank") + 1, F.max("total")).first()
    node = "rank bigint, total bigint, level int, i bigint, digest string"
    if trees is None:
        found = spark.createDataFrame([], "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>")
        return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).drop(*([] if proofs else ["proof"]))

    by_part = leaves.groupBy("part")
    frontier = staged(by_part.cogroup(runs.groupBy("part")).applyInPandas(_frontier, node), "frontier")
    nodes = _tree(frontier, levels(largest))
    # The level of a root is the first that holds all leaves.
    subroots = nodes.filter(F.expr(f"i = 0 and power({FANOUT}, level) >= total and (level = 0 or power({FANOUT}, level - 1) < total)"))
    roots = staged(subroots.select(F.lit(-1).cast("bigint").alias("rank"), F.lit(trees).cast("bigint").alias("total"), F.lit(0).alias("level"),
                                   F.col("rank").alias("i"), "digest"), "roots")
    nodes = staged(nodes.unionByName(_tree(roots, levels(trees))).select("rank", "level", "i", "digest"), "nodes")

    lacking = runs.groupBy("part").applyInPandas(_lacking(trees), "part int, rank bigint, level int, i bigint")
    fetched = lacking.join(nodes, ["rank", "level", "i"])
    extra = staged(runs.unionByName(fetched, allowMissingColumns=True), "extra")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"
    found = by_part.cogroup(extra.groupBy("part")).applyInPandas(_prove(trees, proofs), schema)
    return found if proofs else found.drop("proof")
